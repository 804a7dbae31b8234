"""Gates and decisions of the whole run, and runs without optional parts."""

import datetime

import pytest
from pyspark.sql import functions as F

from pointloom.operators import assess, core

LOCKED = assess.AssessParams(elevated=0.5, abnormal=0.8)


@pytest.mark.parametrize(
    "reasons,short,score,parts,p,status,codes",
    [
        ([], False, 0.9, 2, LOCKED, "Abnormal", []),
        ([], False, 0.9, 1, LOCKED, "Elevated", ["SINGLE_DIMENSION_EVIDENCE_CAPPED"]),
        ([], False, 0.6, 1, LOCKED, "Elevated", []),
        ([], False, 0.1, 2, LOCKED, "Normal", []),
        ([], True, None, 0, LOCKED, "Insufficient History", ["INSUFFICIENT_HISTORY"]),
        ([], True, 0.9, 1, LOCKED, "Elevated", ["SINGLE_DIMENSION_EVIDENCE_CAPPED"]),
        ([], False, None, 0, LOCKED, "Insufficient Evidence", ["NO_COMPUTABLE_ABNORMALITY_COMPONENT"]),
        ([], False, 0.9, 2, assess.AssessParams(), "Insufficient Evidence (thresholds not calibrated)", ["THRESHOLDS_NOT_CALIBRATED"]),
        (["X"], False, 0.9, 2, LOCKED, "Insufficient Evidence", ["G4_NOT_PASSED", "X"]),
        (["X"], False, 0.9, 1, LOCKED, "Insufficient Evidence", ["G4_NOT_PASSED", "X"]),
    ],
)
def test_decision(spark, reasons, short, score, parts, p, status, codes):
    row = spark.createDataFrame([(reasons, short, score, parts)], "r array<string>, s boolean, f double, n int")
    found = row.select(core.decided(F.col("r"), F.col("s"), F.col("f"), F.col("n"), p).alias("d")).first()["d"]
    assert (found["status"], found["codes"]) == (status, codes)


def test_gate(spark):
    rows = [
        (True, "Industrial", {"Industrial": 0.6, "Other": 0.4}, True, []),
        (True, "Industrial", {"Industrial": 0.59, "Other": 0.41}, True, ["NOT_INDUSTRIAL_ABOVE_GATE"]),
        (True, "Other", {"Industrial": 0.9}, True, ["NOT_INDUSTRIAL_ABOVE_GATE"]),
        (True, "Industrial", None, True, ["NOT_INDUSTRIAL_ABOVE_GATE"]),
        (False, None, None, None, ["CLASSIFIER_NOT_AVAILABLE", "FACILITY_ASSOCIATION_NOT_COMPUTED"]),
        (True, "Industrial", {"Industrial": 0.7}, False, ["NO_USABLE_FACILITY_ASSOCIATION"]),
    ]
    df = spark.createDataFrame(rows, "k boolean, c string, p map<string,double>, a boolean, want array<string>")
    for r in df.select("want", core.gate_reasons(F.col("k"), F.col("c"), F.col("p"), F.col("a")).alias("got")).collect():
        assert r["got"] == r["want"]


SCHEMA = "physical_key string, ts timestamp, day date, lat double, lon double, sensor string, value double"


def rows(spark, n):
    first = datetime.datetime(2024, 1, 1, 3)
    made = []
    for i in range(n):
        t = first + datetime.timedelta(days=i)
        made.append((f"k{i:03d}", t, t.date(), 20.0, 80.0, "V", 10.0 + i % 4 if i < n - 1 else 90.0))
    return spark.createDataFrame(made, SCHEMA)


def test_without_optional_parts_it_abstains(spark):
    out = core.run_core(rows(spark, 15), F.lit("2024-01-15 12:00:00").cast("timestamp")).collect()
    assert len(out) == 1
    r = out[0]
    assert r["event"]["n"] == 15 and r["event"]["state"] == "active" and r["association"] is None
    assert r["baseline"]["status"] == "OK" and r["baseline"]["n_eligible"] == 14 and r["baseline"]["t_anom"] == 1.0
    assert r["persistence"]["status"] == "OBSERVATION_OPPORTUNITY_UNKNOWN" and r["fused_score"] == 1.0
    assert r["decision"]["status"] == "Insufficient Evidence"
    assert r["decision"]["codes"] == ["G4_NOT_PASSED", "CLASSIFIER_NOT_AVAILABLE", "FACILITY_ASSOCIATION_NOT_COMPUTED"]


def test_a_short_history_is_scored_if_asked(spark):
    """The score is shown as the SQL of the whole run shows it; status and shares abstain as before."""
    end = F.lit("2024-01-15").cast("timestamp")
    for asked in (False, True):
        p = core.CoreParams(baseline=core.baseline.BaselineParams(least_history=5, least_reference=5, score_short=asked))
        b = core.run_core(rows(spark, 4), end, p=p).first()["baseline"]
        assert b["status"] == "INSUFFICIENT_HISTORY" and b["n_eligible"] == 3 and b["t_anom"] is None
        # history 10, 11, 12: median 11, MAD 1
        assert b["robust_z"] == (pytest.approx(0.6745 * 79) if asked else None)
    assert core.run_core(rows(spark, 1), end, p=p).first()["baseline"]["robust_z"] is None  # no history at all


def test_no_observations(spark):
    assert core.run_core(rows(spark, 0), F.lit("2024-01-15").cast("timestamp")).count() == 0


def test_repeated_windows_against_a_plain_loop(spark):
    from pointloom.operators import coverage

    day = lambda d: datetime.date(2024, 1, 1) + datetime.timedelta(days=d)
    hits = {"a": {3, 4, 9, 20, 28, 29}, "b": {5}, "c": {1, 2}}
    seen = {"a": set(range(0, 31, 2)), "b": {5, 6, 7}}
    table = lambda m: spark.createDataFrame([(s, day(d)) for s, ds in m.items() for d in ds for _ in range(2)], "source_id string, day date")
    found = {(r["source_id"], r["k"]): r["onrr"] for r in coverage.window_rates(table(hits), table(seen), "source_id", "day", 5, 4).collect()}
    want = {}
    for s in seen:
        end, first = max(hits[s]), min(hits[s])
        for k in range(5):
            low, high = end - 5 * k - 4, end - 5 * k
            possible = {d for d in seen[s] | hits[s] if low <= d <= high}
            if possible and high >= first:
                want[s, k] = len([d for d in hits[s] if low <= d <= high]) / len(possible)
    assert found == want
