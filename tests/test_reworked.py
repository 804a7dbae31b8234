"""Rules that were given another plan, held against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pointloom.operators import folds, research, stats
from pointloom.streaming.late import Gate


def plain_scores(values, least=3):
    out = []
    for k, x in enumerate(values):
        others = values[:k] + values[k + 1 :]
        if len(others) < least:
            continue
        m = statistics.median(others)
        apart = [abs(v - m) for v in others]
        mad, mean = statistics.median(apart), sum(apart) / len(apart)
        if mad > 1e-9:
            out.append(max(0.0, 0.6745 * (x - m) / mad))
        elif mean > 1e-9:
            out.append(max(0.0, (x - m) / (1.253314 * mean)))
    return sorted(out)


def test_leave_one_out_of_many_shapes(spark):
    draw = random.Random(4)
    cases = [[draw.choice([1.0, 2.0, 2.0, 5.0, -3.0]) for _ in range(n)] for n in range(0, 30)]
    cases += [[draw.gauss(0, 10) for _ in range(n)] for n in range(4, 40)] + [[7.0] * 9, [7.0] * 9 + [8.0], [0.0, 0.0, 0.0, 1e6]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, v array<double>")
    got = {r["k"]: sorted(r["z"]) for r in rows.select("k", stats.leave_one_out(F.col("v")).alias("z")).collect()}
    for k, values in enumerate(cases):
        assert got[k] == pytest.approx(plain_scores(values), abs=1e-9), values


def test_leave_one_out_of_ten_thousand_values(spark):
    draw = random.Random(5)
    values = [round(draw.lognormvariate(1, 1), 3) for _ in range(10_001)]
    row = spark.createDataFrame([(values,)], "v array<double>").select(stats.leave_one_out(F.col("v")).alias("z")).first()
    assert len(row["z"]) == 10_001
    ordered = sorted(values)
    for k in (0, 17, 4999, 5000, 5001, 9998, 10_000):
        assert row["z"][k] == pytest.approx(max(0.0, plain_one(ordered, k)), abs=1e-9)


def plain_one(values, k):
    others = values[:k] + values[k + 1 :]
    m = statistics.median(others)
    return 0.6745 * (values[k] - m) / statistics.median([abs(v - m) for v in others])


def whole_queue(rows, quotas, most=10):
    """The plain greedy pick over all rows, one head of each group."""
    rows = sorted(rows, key=lambda r: (r[4], r[0]))
    heads, seen = [], set()
    for r in rows:
        if r[2] not in seen:
            seen.add(r[2])
            heads.append(r)
    out, groups, cells = [], set(), set()

    def take(wanted, kind):
        for new in (True, False):
            for r in heads:
                if wanted <= 0:
                    return
                if (kind and r[1] != kind) or r[2] in groups or (new and r[3] in cells):
                    continue
                out.append(r[0])
                groups.add(r[2])
                cells.add(r[3])
                wanted -= 1

    for kind, n in quotas.items():
        take(min(n, most - len(out)), kind)
    take(most - len(out), None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pilot_equals_the_pick_from_the_whole_queue(spark, seed):
    draw = random.Random(seed)
    crowd = [(f"a{k:05d}", "A", f"g{k}", "used", k) for k in range(900)]  # the first 900 rows share one cell
    rest = [(f"b{k:05d}", draw.choice("ABCD"), f"h{draw.randrange(900)}", f"c{draw.randrange(30 if seed else 3)}", 900 + k) for k in range(2000)]
    rows = crowd + rest
    queue = spark.createDataFrame(rows, "id string, kind string, group string, cell string, rank int").repartition(3)
    for quotas, most in (({"A": 3, "B": 3, "D": 1}, 10), ({"C": 2}, 4), ({"A": 10}, 10), ({"E": 5}, 6)):
        got = [r["id"] for r in research.pilot(queue, quotas, most)]
        assert got == whole_queue(rows, quotas, most)
    assert research.pilot_candidates(queue, 10).count() <= 4 * 121


def test_folds_keep_groups_whole_and_shares_even(spark):
    draw = random.Random(6)
    rows, size = [], {}
    for g in range(700):
        label = draw.choices("xyz", weights=(6, 3, 1))[0]
        for _ in range(draw.choice([1, 1, 1, 2, 3, 9])):
            rows.append((f"g{g}", label if draw.random() < 0.8 else draw.choice("xyz")))
    rows += [(None, "x"), ("g1", None)]
    for g, _ in rows:
        size[g] = size.get(g, 0) + 1
    df = spark.createDataFrame(rows, "grp string, label string")
    got = {r["grp"]: r["fold"] for r in folds.stratified_folds(df, "label", "grp").collect()}
    assert set(got) == set(size) and set(got.values()) == set(range(5))
    again = {r["grp"]: r["fold"] for r in folds.stratified_folds(df.repartition(7), "label", "grp").collect()}
    assert got == again != {r["grp"]: r["fold"] for r in folds.stratified_folds(df, "label", "grp", seed=1).collect()}
    for label in "xyz":
        total = sum(c == label for _, c in rows)
        held = [sum(c == label and got[g] == f for g, c in rows) for f in range(5)]
        assert all(abs(h - total / 5) <= max(size.values()) for h in held), (label, held)
        assert all(abs(h / total - 0.2) < 0.03 for h in held), (label, held)


def test_dealing_by_vectors():
    """Every group gets a fold, and no class is further apart than the largest groups of all classes together."""
    vectors = [((4, 0), 7), ((1, 1), 11), ((0, 3), 2), ((2, 1), 1)]
    own = folds.dealt(vectors, 3)
    assert [len(x) for x in own] == [7, 11, 2, 1]
    for c in (0, 1):
        held = [sum(v[c] * x.count(f) for (v, _), x in zip(vectors, own, strict=True)) for f in range(3)]
        assert max(held) - min(held) <= 4 + 3
    assert folds.dealt([((1,), 0)], 3) == [[]]


def test_late_and_repeated_rows_are_kept_apart_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "id int, k string, t string").select("id", "k", F.col("t").cast("timestamp").alias("ts"))
    gate = Gate(spark, str(tmp_path), ["k"], "ts", ["id"])
    batches = [
        rows((1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 09:00:00"), (3, "b", "2024-01-05 00:00:00")),
        rows((4, "b", "2024-01-05 12:00:00"), (5, "c", "2024-01-02 00:00:00"), (6, "d", "2024-01-03 00:00:00")),
        rows(),
        rows((7, "d", "2024-01-04 00:00:00"), (8, "e", "2024-01-04 00:00:00"), (9, "a", "2024-01-01 00:00:00")),
    ]
    for number, batch in enumerate(batches):
        gate.place(batch, number)
    gate.place(batches[1], 1)  # a batch that is repeated after a failure
    gate.place(batches[3], 3)
    assert sorted((r["id"], r["_batch"]) for r in gate.kept().collect()) == [(2, 0), (3, 0), (6, 1), (8, 3)]
    dead = sorted((r["id"], r["_batch"], r["reason"]) for r in gate.dead().collect())
    assert dead == [(1, 0, "REPEATED"), (4, 1, "REPEATED"), (5, 1, "LATE"), (7, 3, "REPEATED"), (9, 3, "LATE")]
