"""Label research: sampling, agreement, gates, ledgers and expansion."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.geojoin import grid_join
from pointloom.operators.graph import connected_components


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the lowest SHA-256 of the key."""
    return df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).orderBy("_h", key).limit(n).drop("_h")


def stratified_draw(df: DataFrame, key: str, stratum: str, cell: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """Per stratum, a round-robin over cells in hash order until the quota, with inclusion probabilities.

    The r-th row of each cell comes before any (r+1)-th, cells in their order.
    """
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    within = Window.partitionBy(stratum, cell).orderBy("_h", key)
    ranked = df.withColumn("_h", h).withColumn("_r", F.row_number().over(within))
    turn = Window.partitionBy(stratum).orderBy("_r", cell)
    # only rows that can be drawn need an order: a cell gives at most its stratum's quota
    quota = F.element_at(F.create_map(*[F.lit(v) for pair in quotas.items() for v in pair]), F.col(stratum))
    population = df.groupBy(stratum).agg(F.count("*").alias("population"))
    drawn = (
        ranked.withColumn("_q", quota)
        .where(F.col("_r") <= F.col("_q"))
        .withColumn("draw_order", F.row_number().over(turn))
        .where(F.col("draw_order") <= F.col("_q"))
    )
    share = F.round(F.least(F.lit(1.0), F.col("_q") / F.col("population")), 8)
    return drawn.join(population, stratum).withColumn("inclusion", share).drop("_h", "_r", "_q")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two label columns; kappa is null when chance agreement is 1."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("_a").alias("k")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col("_b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    po = F.col("same") / F.col("n")
    pe = F.col("x") / (F.col("n") * F.col("n"))
    # one row each
    return total.crossJoin(F.broadcast(chance)).select(
        "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa")
    )


def aligned(packet: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Full alignment of three tables by id with flags of what is missing."""
    p = packet.select(key).distinct().withColumn("in_packet", F.lit(True))
    a = first.select(key).distinct().withColumn("in_first", F.lit(True))
    b = second.select(key).distinct().withColumn("in_second", F.lit(True))
    out = p.join(a, key, "full_outer").join(b, key, "full_outer")
    return out.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_packet", "in_first", "in_second")])


TIERS = ["LOW", "MEDIUM", "HIGH"]


def lowest_tier(a: Column, b: Column) -> Column:
    """The lower of two confidence tiers; blanks are ignored."""
    ranks = F.array_compact(F.array(*[F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), x), F.lit(0)) for x in (a, b)]))
    return F.when(F.size(ranks) > 0, F.element_at(F.array(*map(F.lit, TIERS)), F.array_min(ranks).cast("int")))


def needs_adjudication(label_a: Column, label_b: Column, context_a: Column, context_b: Column) -> Column:
    return ~label_a.eqNullSafe(label_b) | ~context_a.eqNullSafe(context_b)


def label_gate(df: DataFrame, label: str, group: str, least: int = 30, least_groups: int = 8, least_classes: int = 2) -> DataFrame:
    """Classes with enough labels and distinct groups, and whether the gate opens."""
    eligible = df.groupBy(label).agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"))
    passed = (F.col("n") >= least) & (F.col("groups") >= least_groups)
    classes = F.count_if(F.col("passes")).over(Window.partitionBy())  # classes are few
    return eligible.withColumn("passes", passed).withColumn("gate_open", classes >= least_classes)


def annotation_errors(label: Column, tier: Column, types: Column, reference: Column, annotator: Column, labels: list[str]) -> Column:
    """Errors of one annotation row."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    used = F.filter(F.split(F.coalesce(types, F.lit("")), ";"), lambda t: t != "")
    other = F.size(F.filter(used, lambda t: t != "FIRMS_PATTERN_ONLY")) > 0
    strong = F.coalesce(tier.isin("HIGH", "MEDIUM"), F.lit(False))
    tests = [
        (blank(annotator), "missing annotator id"),
        (~F.coalesce(label.isin(*labels), F.lit(False)), "label not allowed"),
        ((F.coalesce(label == "UNSURE", F.lit(False))) != blank(tier), "tier must be empty iff label is UNSURE"),
        (~blank(tier) & ~F.coalesce(tier.isin(*TIERS), F.lit(False)), "bad tier"),
        (strong & ~other, "strong tier requires other evidence"),
        (other & blank(reference), "evidence needs a reference"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def final_label_blocks(ledger: DataFrame, insufficient: list[str], linking: list[str]) -> DataFrame:
    """(source_id, reasons): what blocks the final label of each source.

    The ledger has source_id, record_kind, role, reviewer_id, evidence_category,
    evidence_stance, reference, final_label, adjudication_status, site_complex_id.
    """
    item = F.col("record_kind") == "EVIDENCE_ITEM"
    adj = F.col("record_kind") == "ADJUDICATION"
    reviewer = F.nullif(F.trim("reviewer_id"), F.lit(""))
    people = lambda role: F.collect_set(F.when(item & (F.col("role") == role), reviewer))
    stance = lambda s: F.collect_set(F.when(item & (F.col("evidence_stance") == s), F.col("evidence_category")))
    link = item & (F.col("evidence_stance") == "SUPPORTS") & F.col("evidence_category").isin(*linking) & (F.trim("reference") != "")
    g = ledger.groupBy("source_id").agg(
        F.count_if(adj).alias("n_adj"),
        F.count_if(item).alias("n_items"),
        F.max(F.when(adj, F.col("final_label"))).alias("final_label"),
        F.max(F.when(adj, F.col("adjudication_status"))).alias("adj_status"),
        F.collect_set(F.when(adj, reviewer)).alias("judges"),
        people("ANNOTATOR_1").alias("a1"),
        people("ANNOTATOR_2").alias("a2"),
        F.max(F.upper(reviewer).rlike("^(AI|CHATGPT|CLAUDE|GPT|LLM)").cast("int")).alias("machine"),
        F.count("site_complex_id").alias("n_complex"),
        stance("SUPPORTS").alias("supports"),
        F.count_if(link).alias("n_link"),
    )
    labelled = F.coalesce(F.col("final_label"), F.lit("")).isin("", "UNKNOWN") == F.lit(False)
    weak = F.size(F.array_except("supports", F.array(*map(F.lit, insufficient)))) == 0
    tests = [
        (F.col("n_complex") == 0, "site complex missing"),
        ((F.col("n_adj") != 1) | F.col("final_label").isNull() | ~F.col("adj_status").eqNullSafe("ADJUDICATED"), "adjudication missing or incomplete"),
        ((F.size("a1") == 0) | (F.size("a2") == 0), "two independent annotators required"),
        (F.size(F.array_intersect("a1", "a2")) > 0, "annotators must differ"),
        (F.size(F.array_intersect("judges", F.array_union("a1", "a2"))) > 0, "adjudicator must not be an annotator"),
        (F.coalesce("machine", F.lit(0)) == 1, "machine reviewer"),
        (F.col("n_items") == 0, "no evidence recorded"),
        (labelled & (F.size("supports") == 0), "no supporting evidence"),
        (labelled & (F.size("supports") > 0) & weak, "only insufficient evidence"),
        (labelled & (F.col("n_link") == 0), "no linking evidence"),
    ]
    return g.select("source_id", F.array_sort(F.array_compact(F.array(*[F.when(t, n) for t, n in tests]))).alias("reasons"))


def blind_ids(df: DataFrame, key: str, salt: bytes, out: str = "blind_id") -> DataFrame:
    """``ANN-`` and twelve hex digits of an HMAC of the key (X31, N07); Spark has no HMAC."""

    @F.pandas_udf("string")
    def sealed(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: "ANN-" + hmac.new(salt, k.encode(), hashlib.sha256).hexdigest()[:12])

    return df.withColumn(out, sealed(F.col(key).cast("string")))


def site_complexes(sites: DataFrame, key: str, link_km: float = 5.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, complex_id): sites chained within ``link_km`` and a hash of their sorted keys."""
    a = sites.select(F.col(key).alias("_a"), F.col(lat).alias("_alat"), F.col(lon).alias("_alon"))
    b = sites.select(F.col(key).alias("_b"), F.col(lat).alias("_blat"), F.col(lon).alias("_blon"))
    pairs = grid_join(a, b, link_km, ("_alat", "_alon"), ("_blat", "_blon"), extra=F.col("_a") < F.col("_b"))
    parts = connected_components(pairs.select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
    named = sites.select(key).join(parts.withColumnRenamed("node", key), key, "left").withColumn(
        "component", F.coalesce("component", F.col(key))
    )
    members = named.groupBy("component").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("m"))
    ids = members.select("component", F.concat(F.lit("SC-"), F.substring(F.sha2(F.array_join("m", "|"), 256), 1, 10)).alias("complex_id"))
    return named.join(ids, "component").select(key, "complex_id")


def expand_labels(pairs: DataFrame, source: str, site: str, kind: str, group: str, reach_km: float = 2.0) -> DataFrame:
    """Candidates: one type of site within reach gives REVIEW, several UNKNOWN; first of each group first."""
    near = pairs.where(F.col("distance_km") <= reach_km).withColumn("distance_km", F.round("distance_km", 4))
    by = near.groupBy(source).agg(
        F.array_sort(F.collect_set(kind)).alias("kinds"),
        F.min("distance_km").alias("nearest_km"),
        F.min_by(group, F.struct("distance_km", site)).alias(group),
    )
    status = F.when(F.size("kinds") > 1, "UNRESOLVED_MULTI_TYPE").otherwise("REVIEW")
    label = F.when(F.size("kinds") > 1, "UNKNOWN").otherwise(F.get("kinds", F.lit(0)))
    out = by.withColumns({"status": status, "label": label})
    first = F.row_number().over(Window.partitionBy(group).orderBy("nearest_km", source)) == 1
    return out.withColumn("first_in_group", first)


def class_capacity(candidates: DataFrame, labelled: DataFrame, kind: str, group: str) -> DataFrame:
    """(class, candidates, groups, new_groups): how many are left to label, and groups without a label yet."""
    fresh = candidates.join(labelled.select(group).distinct().withColumn("_has", F.lit(True)), group, "left")
    return fresh.groupBy(kind).agg(
        F.count("*").alias("candidates"), F.countDistinct(group).alias("groups"),
        F.countDistinct(F.when(F.col("_has").isNull(), F.col(group))).alias("new_groups"),
    )


def pilot_candidates(queue: DataFrame, most: int) -> DataFrame:
    """The rows that a pick of at most ``most`` can reach: a few of each class, whatever the queue's length.

    Of the heads of groups, of each class and cell the first ``most`` + 1, and of
    these the first (``most`` + 1)**2 of each class.  A pick passes over a row only if
    its cell is used, which at most ``most`` cells are, or if it is picked itself.
    So of each cell no more than ``most`` + 1 rows matter, and before the first row
    of the (``most`` + 1)-th cell come at most ``most`` * (``most`` + 1) such rows.
    """
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("rank", "id"))
    heads = queue.withColumn("_n", number("group")).where("_n = 1")
    spread = heads.withColumn("_n", number("kind", "cell")).where(F.col("_n") <= most + 1)
    return spread.withColumn("_n", number("kind")).where(F.col("_n") <= (most + 1) ** 2).drop("_n")


def pilot(queue: DataFrame, quotas: dict[str, int], most: int = 10) -> list[dict]:
    """A pilot by quota: each class in turn, then any class, one of a group, unused region cells first.

    queue: id, kind, group, cell, rank.  A greedy pick over :func:`pilot_candidates`,
    equal to one over the whole queue.
    """
    rows = pilot_candidates(queue, most).orderBy("rank", "id").collect()
    picked, groups, cells = [], set(), set()

    def take(wanted: int, kind: str | None) -> None:
        for new_cell in (True, False):
            for r in rows:
                if wanted <= 0:
                    return
                if (kind is not None and r["kind"] != kind) or r["group"] in groups or (new_cell and r["cell"] in cells):
                    continue
                picked.append({k: r[k] for k in ("id", "kind", "group", "cell")} | {"place": len(picked) + 1})
                groups.add(r["group"])
                cells.add(r["cell"])
                wanted -= 1

    for kind, n in quotas.items():
        take(min(n, most - len(picked)), kind)
    take(most - len(picked), None)
    return picked


def audited(drawn: DataFrame, again: DataFrame, population: DataFrame, key: str, stratum: str) -> DataFrame:
    """(check, n_bad, ok) of a draw: the same rows drawn again, populations and probabilities recomputed."""
    counts = population.groupBy(stratum).agg(F.count("*").alias("_p"))
    sizes = drawn.groupBy(stratum).agg(F.count("*").alias("_n"))
    both = drawn.select(key, stratum, "population", "inclusion").join(counts, stratum).join(sizes, stratum)
    off = both.agg(
        F.count_if(F.col("population") != F.col("_p")).alias("population"),
        F.count_if(F.abs(F.col("inclusion") - F.least(F.lit(1.0), F.col("_n") / F.col("_p"))) > 5e-9).alias("inclusion"),
    )
    rows = off.select(F.expr("stack(2, 'population', population, 'inclusion', inclusion) AS (check, n_bad)"))
    columns = [key, stratum, "draw_order"]
    a, b = drawn.select(*columns), again.select(*columns)
    same = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n_bad")).select(F.lit("redraw").alias("check"), "n_bad")
    return rows.unionByName(same).withColumn("ok", F.col("n_bad") == 0)


def intake(packet: DataFrame, first: DataFrame, second: DataFrame, judged: DataFrame, key: str, context: Column, allowed: list[str]) -> dict[str, DataFrame]:
    """Two annotators' sheets taken in as one run (D23): alignment, errors, agreement, disputes and final labels.

    first and second: key, label, tier, sources, reference, annotator.  judged: key, final_label.
    """
    aligned_ids = aligned(packet, first, second, key)
    errors = []
    for name, sheet in (("first", first), ("second", second)):
        found = annotation_errors(F.col("label"), F.col("tier"), F.col("sources"), F.col("reference"), F.col("annotator"), allowed)
        errors.append(sheet.select(key, F.lit(name).alias("sheet"), F.explode(found).alias("error")))
    a = first.select(key, F.col("label").alias("a"), F.col("tier").alias("tier_a"))
    both = packet.join(a, key).join(second.select(key, F.col("label").alias("b"), F.col("tier").alias("tier_b")), key)
    dispute = needs_adjudication(F.col("a"), F.col("b"), context, F.lit("y"))
    disputed = both.where(dispute).select(key)
    final = both.join(judged.select(key, F.col("final_label").alias("_j")), key, "left").withColumns(
        {"disputed": dispute, "tier": lowest_tier(F.col("tier_a"), F.col("tier_b"))}
    )
    label = F.when(F.col("disputed"), F.col("_j")).otherwise(F.col("a"))
    status = F.when(~F.col("disputed"), "AGREED").when(F.col("_j").isNotNull(), "ADJUDICATED").otherwise("OPEN")
    return {
        "alignment": aligned_ids, "errors": errors[0].unionByName(errors[1]), "agreement": kappa(both, "a", "b"), "disputed": disputed,
        "unasked": judged.join(disputed, key, "left_anti").select(key),
        "final": final.select(key, label.alias("label"), "tier", status.alias("status")),
    }
