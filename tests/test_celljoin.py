import math
import random

import pytest

from pointloom.functions.geo import EARTH_KM
from pointloom.operators import celljoin


def km(a, b):
    (x, y), (u, v) = [(math.radians(p[0]), math.radians(p[1])) for p in (a, b)]
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def scattered(draw, size, hot):
    """Places in three regions, one near a pole, a third of them around one place if ``hot``."""
    out = []
    for k in range(size):
        lat0, lon0 = draw.choice([(20.0, 80.0), (-0.01, 10.0), (84.0, -100.0)])
        if hot and k % 3 == 0:
            out.append((20.0 + draw.gauss(0, 2e-5), 80.0 + draw.gauss(0, 2e-5)) if k % 2 else (20.0, 80.0))
        else:
            out.append((lat0 + draw.uniform(-0.06, 0.06), lon0 + draw.uniform(-0.06, 0.06) / math.cos(math.radians(lat0))))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_joins_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(celljoin, "MOST_LEFT", 8)
    monkeypatch.setattr(celljoin, "MOST_RIGHT", 4)
    draw = random.Random(2)
    left, right = scattered(draw, 500, hot), scattered(draw, 400, hot)
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(left)] + [(-1, None, 80.0)], "k int, a double, b double")
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(right)], "s int, c double, d double")
    wanted = {}
    for k, p in enumerate(left):
        near = min((km(p, q), s) for s, q in enumerate(right))
        if near[0] <= 0.8:
            wanted[k] = near
    got = {r["k"]: (r["distance_km"], r["s"]) for r in celljoin.nearest_within(a, b, 0.8, "s", ("a", "b"), ("c", "d")).collect()}
    assert set(got) == set(wanted) and len(got) > 100
    assert all(got[k][0] == pytest.approx(wanted[k][0], abs=1e-6) for k in got)
    close = {k for k in got if got[k][1] != wanted[k][1]}  # equal distances to the last bits
    assert all(abs(km(left[k], right[got[k][1]]) - wanted[k][0]) < 1e-6 for k in close)
    least = {r["k"]: r["distance_km"] for r in celljoin.least_distance(a, b, 0.8, ("a", "b"), ("c", "d")).collect()}
    assert set(least) == set(wanted)


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(celljoin, "MOST_LEFT", 8)
    monkeypatch.setattr(celljoin, "MOST_RIGHT", 4)
    points = scattered(random.Random(3), 240, True)
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lat double, lon double")
    got = {(r["a"], r["b"]) for r in celljoin.pairs_within(df, "k", 0.9).collect()}
    assert got == {(i, j) for i in range(240) for j in range(i + 1, 240) if km(points[i], points[j]) <= 0.9}


def test_pairs_of_a_hot_place_come_from_arrays_of_bounded_size(spark, monkeypatch):
    """Repeated places in several arrays; the long result is made from arrays, after the last shuffle."""
    monkeypatch.setattr(celljoin, "MOST_KEYS", 3)
    points = [(20.0, 80.0)] * 30 + [(20.0, 80.0 + 0.001 * (k % 4)) for k in range(20)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lat double, lon double")
    found = celljoin.pairs_within(df, "k", 0.25, decimals=6)
    got = [(r["a"], r["b"], r["distance_km"]) for r in found.collect()]
    wanted = {(i, j): km(points[i], points[j]) for i in range(50) for j in range(i + 1, 50) if km(points[i], points[j]) <= 0.25}
    assert len(got) == len(wanted) and {(a, b): d for a, b, d in got} == pytest.approx(wanted, abs=1e-6)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(celljoin.pairs_within(df, "k", 0.25)._jdf.queryExecution(), "simple")
    assert plan.rindex("Generate explode") < plan.index("Exchange")


def met_places(spark, rows):
    df = spark.createDataFrame(rows, "lat double, lon double")
    grid = celljoin.Grid(0.375)
    placed = celljoin._places(df, ("lat", "lon"), grid)
    sizes, total = [], 0
    for level, pairs in celljoin.cell_pairs(placed, placed, grid, True):
        cell = celljoin.F.struct(*celljoin._cell(level))
        p = placed.select(cell.alias("l"))
        q = placed.select(cell.alias("r"))
        counts = pairs.join(p, "l").join(q, "r").groupBy("l", "r").count().collect()
        total += sum(r["count"] for r in counts)
        sizes += [r["count"] for r in counts]
    return total, max(sizes)


def test_a_hot_cell_costs_like_an_even_table(spark):
    """A third of all points in one cell: points that meet, and the most that meet under one key."""
    draw = random.Random(4)
    even = [(20 + draw.random(), 80 + draw.random()) for _ in range(6000)]
    hot = even[:4000] + [(20.5 + draw.random() * 0.002, 80.5 + draw.random() * 0.002) for _ in range(2000)]
    total_even, _ = met_places(spark, even)
    total_hot, most_hot = met_places(spark, hot)
    assert most_hot <= celljoin.MOST_LEFT * celljoin.MOST_RIGHT
    # each place meets its own cell and the cells around it; all pairs of the hot cell are 4,000,000
    assert total_hot < 25 * celljoin.MOST_RIGHT * len(hot) / 3, (total_even, total_hot)
