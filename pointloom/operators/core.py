"""The whole run from valid observations to assessed events.

Formation, sessions, own-history baseline, persistence, facility association and the
decision are the library's own operators; this module only joins them by source and
event.  Formed observations are written once, since five steps read them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators import assess, baseline, coverage, facility, sessions
from pointloom.operators.formation import FormationParams, form_sources
from pointloom.plans.scratch import written


@dataclass(frozen=True)
class CoreParams:
    formation: FormationParams = field(default_factory=FormationParams)
    baseline: baseline.BaselineParams = field(default_factory=baseline.BaselineParams)
    assess: assess.AssessParams = field(default_factory=assess.AssessParams)
    facility: facility.FacilityParams = field(default_factory=facility.FacilityParams)
    gap_hours: float = 36.0
    window_days: int = 30
    windows: int = 24
    #: A string column of the observations whose values form sources of their own.
    within: str | None = None
    #: The class, and the probability from which on it lets a decision be made.
    wanted_class: str = "Industrial"
    least_probability: float = 0.60


def gate_reasons(known: Column, source_class: Column, probabilities: Column, associated: Column, p: CoreParams = CoreParams()) -> Column:
    """Why no decision may be made on an event; empty if one may.

    known: whether the source was classified at all.  probabilities: map by class; the
    wanted class must have the probability asked for, and no other may have more.
    """
    own = F.coalesce(F.element_at(probabilities, F.lit(p.wanted_class)), F.lit(0.0))
    best = F.array_max(F.map_values(probabilities))
    sure = F.coalesce((source_class == p.wanted_class) & (own >= p.least_probability) & (own >= best), F.lit(False))
    tests = [
        (~known, "CLASSIFIER_NOT_AVAILABLE"), (known & ~sure, "NOT_INDUSTRIAL_ABOVE_GATE"),
        (associated.isNull(), "FACILITY_ASSOCIATION_NOT_COMPUTED"), (~associated, "NO_USABLE_FACILITY_ASSOCIATION"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def decided(reasons: Column, history_short: Column, score: Column, n_parts: Column, p: assess.AssessParams) -> Column:
    """Struct (status, codes) of an event: abstaining first, and Abnormal only on more than one kind of evidence."""
    ready = p.elevated is not None and p.abnormal is not None
    single = F.lit(ready) & (score >= F.lit(p.abnormal).cast("double")) & (n_parts < 2)
    plain = assess.decision(F.size(reasons) == 0, history_short & (n_parts == 0), score, p)
    capped = (F.size(reasons) == 0) & F.coalesce(single, F.lit(False))
    codes = (
        F.when(F.size(reasons) > 0, F.concat(F.array(F.lit("G4_NOT_PASSED")), reasons))
        .when(history_short & (n_parts == 0), F.array(F.lit("INSUFFICIENT_HISTORY")))
        .when(score.isNull(), F.array(F.lit("NO_COMPUTABLE_ABNORMALITY_COMPONENT")))
        .when(~F.lit(ready), F.array(F.lit("THRESHOLDS_NOT_CALIBRATED")))
        .when(capped, F.array(F.lit("SINGLE_DIMENSION_EVIDENCE_CAPPED")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(F.when(capped, "Elevated").otherwise(plain).alias("status"), codes.alias("codes"))


def run_core(
    obs: DataFrame,
    as_of: Column,
    opportunity: Callable[[DataFrame], DataFrame] | None = None,
    sites: DataFrame | None = None,
    classes: Callable[[DataFrame], DataFrame] | None = None,
    p: CoreParams = CoreParams(),
) -> DataFrame:
    """One row for the latest event of each source, with every part of its assessment.

    obs: physical_key, ts, day, lat, lon, sensor, value, valid rows only.
    opportunity: from formed observations (with source_id) to (source_id, day), the days
    on which a source could have been seen; without it persistence is unknown.  sites:
    site_id, s_lat, s_lon, ring; without them no association is computed.  classes: from
    the latest events to (source_id, source_class, probabilities).
    """
    asked = obs.select("physical_key", "ts", "lat", "lon", *([p.within] if p.within else []))
    ids = form_sources(asked, "physical_key", "ts", p.formation, within=p.within)
    formed = written(obs.join(ids.select("physical_key", "source_id"), "physical_key"), "core")
    cut = sessions.sessionize(formed, "source_id", "ts", ["physical_key"], p.gap_hours)
    table = sessions.session_table(cut, "source_id", "ts", "sensor", as_of).withColumn("event_id", sessions.event_id())
    places = cut.groupBy("source_id", "session").agg(F.avg("lat").alias("e_lat"), F.avg("lon").alias("e_lon"))
    events = written(assess.latest_events(table, "source_id", "end", "event_id").join(places, ["source_id", "session"]), "events")

    own = baseline.baseline(formed, "source_id", "day", "sensor", "value", None, p.baseline)
    out = events.join(own.select("source_id", F.struct("status", "robust_z", "t_anom", "n_eligible").alias("baseline")), "source_id", "left")
    if opportunity is None:
        rates = formed.select("source_id").limit(0).selectExpr("source_id", "0 AS k", "CAST(NULL AS DOUBLE) AS onrr")
    else:
        rates = coverage.window_rates(formed, opportunity(formed), "source_id", "day", p.window_days, p.windows)
    lasting = assess.persistence(events, rates, "source_id", p.assess)
    parts = F.struct("onrr", "n_windows", F.col("p_status").alias("status"), F.col("p_z").alias("robust_z"), "p_norm")
    out = out.join(lasting.select("source_id", parts.alias("persistence")), "source_id", "left")
    if sites is None:
        out = out.withColumn("association", F.lit(None).cast("struct<status:string,basis:string,selected:string,n_candidates:int>"))
    else:
        near = facility.candidates(events.select("event_id", "e_lat", "e_lon"), sites, "event_id", "site_id", p.facility)
        found = facility.decide(near, events, "event_id", "site_id", p.facility)
        out = out.join(found.select("event_id", F.struct("status", "basis", F.col("selected").cast("string").alias("selected"), "n_candidates").alias("association")), "event_id", "left")
    if classes is None:
        known, named, likely = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("map<string,double>")
    else:
        out = out.join(classes(events).select("source_id", "source_class", "probabilities"), "source_id", "left")
        known, named, likely = F.col("source_class").isNotNull(), F.col("source_class"), F.col("probabilities")

    components = {"p_norm": F.col("persistence.p_norm"), "t_anom": F.col("baseline.t_anom")}
    n_parts = sum((c.isNotNull().cast("int") for c in components.values()), F.lit(0))
    score = assess.fused({k: (c, 1.0) for k, c in components.items()})
    reasons = gate_reasons(known, named, likely, F.col("association.status") == "ASSOCIATED", p)
    short = F.coalesce(F.col("baseline.status") == "INSUFFICIENT_HISTORY", F.lit(False))
    return out.select(
        "event_id", "source_id", F.struct("n", "start", "end", "state", "sensors", "e_lat", "e_lon").alias("event"),
        "baseline", "persistence", "association", score.alias("fused_score"), decided(reasons, short, score, n_parts, p.assess).alias("decision"),
    )
