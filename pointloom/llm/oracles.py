"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from pointloom.llm import chat, rules

SAID = "\\### Assistant: </turn> ok"
FRAME = len(chat.HEAD) + len(chat.AFTER_ROLE) + len(chat.END)

OP9 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
  coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY turn, role, txt) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({FRAME} + length(role) + length(regexp_replace(txt, '{chat.CONTROL}', '\1\\\2', 'g')))::BIGINT AS formatted_chars,
  true AS round_trip
FROM t GROUP BY conv_id"""


RAW = "coalesce(text, '')"


def op4() -> str:
    """Counts, histograms, pooled references and distances of the quality rules."""
    p = rules.RuleParams()
    steps = []
    for k, (_, pattern) in enumerate(rules.CLASSES):
        shown = pattern.replace("'", "''")
        before = RAW if k == 0 else f"t{k}"
        steps.append(f"regexp_replace({before}, '{shown}', '', 'g') AS t{k + 1}")
    layers = "docs"
    for k, step in enumerate(steps):
        layers = f"(SELECT *, {step} FROM {layers})"
    names = [f"c_{n}" for n, _ in rules.CLASSES] + ["c_other"]
    counts = [
        f"length({RAW if k == 0 else f't{k}'}) - length(t{k + 1}) AS {names[k]}"
        for k in range(len(rules.CLASSES))
    ] + [f"length(t{len(rules.CLASSES)}) AS c_other"]
    bins = [f"coalesce(len(list_filter(lw, lambda w: w = common[{k + 1}])), 0) AS w{k}" for k in range(rules.BINS)]
    words = [f"w{k}" for k in range(rules.BINS + 1)]
    rest = " + ".join(f"w{k}" for k in range(rules.BINS))

    def shares(cols: list[str], total: str, least: int) -> str:
        used = f"FILTER (NOT failed AND {total} >= {least})"
        return ", ".join(
            f"CASE WHEN count(*) {used} >= {p.least_docs} THEN avg({c} / {total}::DOUBLE) {used} END AS q_{c}" for c in cols
        )

    def distance(cols: list[str], total: str) -> str:
        parts = []
        for c in cols:
            x, q = f"({c} / {total}::DOUBLE)", f"q_{c}"
            for side in (x, q):
                parts.append(f"CASE WHEN {side} > 0 THEN {side} * log2({side} / (({x} + {q}) / 2)) ELSE 0 END")
        return f"sqrt(greatest(0.0::DOUBLE, ({' + '.join(parts)}) / 2))"

    return rf"""
WITH docs AS (SELECT doc_id, text, coalesce(lang, '') AS lg FROM documents),
classed AS (SELECT *, {', '.join(counts)}, length(coalesce(text, '')) AS n_all,
    list_filter(string_split_regex(coalesce(text, ''), '{rules.SPACE}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {layers}),
listed AS (SELECT *, len(ws) AS n, list_transform(ws, lambda x: lower(x)) AS lw FROM classed),
df AS (SELECT lg, w, count(*) AS c FROM (SELECT lg, unnest(list_distinct(lw)) AS w FROM listed WHERE n >= {p.least_words}) GROUP BY lg, w),
top AS (SELECT lg, w, row_number() OVER (PARTITION BY lg ORDER BY c DESC, w) AS place FROM df QUALIFY place <= {rules.BINS}),
words AS (SELECT lg, list(w ORDER BY place) AS common FROM top GROUP BY lg),
binned AS (SELECT *, {', '.join(bins)} FROM listed LEFT JOIN words USING (lg)),
hist AS (SELECT *, n - ({rest}) AS w{rules.BINS} FROM binned),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + {p.window - 1}], ' ') AS gram FROM hist, unnest(range(1, n - {p.window - 2})) u(i) WHERE n >= {p.window}),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS r FROM twice, unnest(range(i, i + {p.window})) v(k) GROUP BY doc_id),
based AS (SELECT hist.*, coalesce(r, 0) AS rep, n < {p.least_words} OR 100 * coalesce(r, 0) > {p.most_repeat_percent} * n AS failed
  FROM hist LEFT JOIN covered USING (doc_id)),
refs AS (SELECT lg, {shares(names, 'n_all', p.least_chars)}, {shares(words, 'n', p.least_common_words)} FROM based GROUP BY lg),
verdict AS (SELECT based.*, {p.slack}::DOUBLE / sqrt(greatest(n, 1)) AS noise,
    CASE WHEN n_all >= {p.least_chars} AND q_{names[0]} IS NOT NULL THEN {distance(names, 'n_all')} END AS cd,
    CASE WHEN n >= {p.least_common_words} AND q_w0 IS NOT NULL THEN {distance(words, 'n')} END AS wd
  FROM based LEFT JOIN refs USING (lg))
SELECT doc_id, n::BIGINT AS n_words, (n_all - c_space)::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(cd, 0) <= {p.char_base}::DOUBLE + noise AND coalesce(wd, 0) <= {p.word_base}::DOUBLE + noise AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM verdict"""


#: Whole numbers of 128 bits; every source of a language with each of its kept terms.
OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
raw AS (SELECT k, lang, source, unnest(words) AS w FROM docs),
terms AS (SELECT k, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM raw),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
vs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_lang FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS n_group FROM counts GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n_group, 0) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 2)) // (n_lang + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vs USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
fs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN fs ON fs.lang = a.lang AND fs.source = a.source AND fs.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM dense WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM tops)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10"""


#: Every window of 50 bytes as hexadecimal text, from pieces of 512; runs of removed bytes are windows at most 50 apart.
OP12 = """
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT k, doc_id, c * 512 AS first, substring(h, c * 1024 + 1, 1024 + 98) AS p
  FROM docs, range(0, greatest(0, length(h) // 2 - 49 + 511) // 512) t(c)),
wins AS (SELECT k, doc_id, first + i AS i, substring(p, 2 * i + 1, 100) AS w FROM cut, range(0, length(p) // 2 - 49) t(i)),
mins AS (SELECT w, min(doc_id) AS m FROM wins GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT k, i FROM wins JOIN mins USING (w) WHERE doc_id > m),
begun AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 50, true) AS new FROM gone),
numbered AS (SELECT k, i, count(*) FILTER (new) OVER (PARTITION BY k ORDER BY i) AS run FROM begun),
runs AS (SELECT k, run, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY k, run),
pieces AS (
  SELECT k, s AS place, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS x, s AS y FROM runs
  UNION ALL SELECT docs.k, length(h) // 2 + 1, coalesce(max(runs.e), 0), length(h) // 2 FROM docs LEFT JOIN runs USING (k) GROUP BY docs.k, h),
kept AS (SELECT k, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY place) AS rest FROM pieces JOIN docs USING (k) GROUP BY k),
spans AS (SELECT k, count(*) AS n FROM runs GROUP BY k)
SELECT doc_id, length(h) // 2 AS n_bytes, length(h) // 2 - length(rest) // 2 AS n_removed,
  coalesce(n, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM docs JOIN kept USING (k) LEFT JOIN spans USING (k)"""
