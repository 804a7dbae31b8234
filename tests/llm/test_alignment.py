import hashlib
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SF
from tests.llm import odd

from pointloom.llm import alignment, packing
from pointloom.llm.planes import pack

PATHS = [packing.public_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
PARAMS = alignment.AlignParams(*PATHS)
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def plain_bytes(tools, text):
    """Tokens of both sides as (id, bytes), or None."""
    a, b = tools
    letters = {c: n for n, c in enumerate(alignment.byte_letters())}
    if not text:
        return None
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    wanted = (" " + text).encode()
    return (one, two) if all(b"".join(x for _, x in side) == wanted for side in (one, two)) else None


def brute(tools, rows):
    """Every pair of tokens of a group, by their byte ranges."""
    cut = [plain_bytes(tools, text) for _, text in rows]
    counts, parts = Counter(), []
    for found in cut:
        if found is None:
            parts.append(None)
            continue
        ranges = []
        for side in found:
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(own)
        ends = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        groups, links, start = [], [], 0
        k = [0, 0]
        for end in ends:
            members = []
            for s in (0, 1):
                own = []
                while k[s] < len(ranges[s]) and ranges[s][k[s]][2] <= end:
                    own.append(ranges[s][k[s]])
                    k[s] += 1
                members.append(own)
            groups.append(members)
            links += [(x[0], y[0]) for x in members[0] for y in members[1] if max(x[1], y[1]) < min(x[2], y[2])]
            start = end
        assert start == ranges[0][-1][2]
        counts.update(links)
        shown = ";".join("|".join(",".join(str(t[0]) for t in side) for side in g) for g in groups)
        parts.append((len(found[0]), len(found[1]), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (key, _), part in zip(rows, parts, strict=True):
        if part is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links, sha = part
            out.append((key, a, b, groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def got(df):
    return order(tuple(r[n] for n in NAMES) for r in df.collect())


def test_table_equals_brute_force(spark, tools):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(alignment.align(docs, PARAMS)) == order(brute(tools, [(r["doc_id"], r["text"]) for r in docs.collect()]))


ODD = [
    "  two spaces  inside and at the end ", "\ttabs\tand\nlines\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "第一章 中文字符 mixed", "naïve ÜBER ﬁ ligature ½",
    "\U0001f600\U0001f468‍\U0001f469 emoji", "a\x00b\x07c", "1234567890 12.5%", "é combining", "x" * 3000, "ab " * 4000, "don't we'll I'd", "▁ own mark", "\xa0nbsp", " ",
]


@pytest.mark.parametrize("bounds", [(4096, 600_000), (3, 20), (7, 1)])
def test_odd_documents_in_small_runs(spark, tools, monkeypatch, bounds):
    monkeypatch.setattr(alignment, "RUN", bounds[0])
    monkeypatch.setattr(alignment, "BUFFER", bounds[1])
    long = odd.long_text(3000 if bounds[1] < 100 else 60_000)
    rows = [(r[0], long if r[0] == 7 else r[1]) for r in odd.rows()] + [(100 + k, t) for k, t in enumerate(ODD)]
    rows += [(200, "the same row again and again")] * 5
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, _first int").repartition(3)
    assert got(alignment.align(docs, PARAMS)) == order(brute(tools, rows))


def test_empty_table_and_string_ids(spark):
    assert alignment.align(odd.empty(spark), PARAMS).count() == 0
    docs = spark.createDataFrame([("k", "some words")], "name string, body string")
    assert alignment.align(docs, PARAMS, "name", "body").first()["n_groups"] > 0


def test_ranks_give_the_ids_of_the_file(tools):
    tool = alignment.ByteTokenizer(PATHS[0])
    assert tool.ranks is not None
    texts = [t for t in [*ODD, odd.PLAIN, odd.long_text(2000)]]
    assert tool.ids(texts) == [tools[0].encode(f" {t}", add_special_tokens=False).ids for t in texts]


def test_a_block_holds_a_bounded_number_of_ends():
    """Events of one endless document: after each block only what no group has ended is held."""
    machine = alignment.Sweep([b"", b"a", b"aa"], [b"", b"a", b"aaa"])
    held, blocks = [], 0
    for k in range(400):
        for side, ids, width in (("a", [2] * 30, 60), ("b", [2] * 20, 60)):
            data = pack(np.array(ids, "<u4"))
            machine.feed((1, 1), 1, side, width * k + 2 + (side == "b"), data)
            machine.block(True)
            blocks += 1
            held.append(machine.held)
    assert max(held) <= 30 and blocks > 50
    last = machine.block(False)["rows"][-1]
    assert (last["n_a"], last["n_b"], last["n_groups"], last["n_links"]) == (12_000, 8_000, 4_000, 16_000)
