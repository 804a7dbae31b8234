"""Robust statistics over groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.lets import let


@dataclass(frozen=True)
class RobustParams:
    #: Scale of the MAD and of the mean absolute deviation for normal data.
    mad_scale: float = 0.6745
    mean_scale: float = 1.253314
    eps: float = 1e-9


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, mad (median of the deviations from it) and mean_ad per group."""
    centred = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias("median"))
    apart = df.where(F.col(value).isNotNull()).join(centred, keys)
    deviation = F.abs(F.col(value) - F.col("median"))
    return apart.groupBy(*keys, "median").agg(
        F.count("*").alias("n"), F.median(deviation).alias("mad"), F.avg(deviation).alias("mean_ad")
    )


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, p10, median, p90 and max per group, linearly interpolated."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(value).alias("min"),
        F.percentile(value, 0.1).alias("p10"),
        F.median(value).alias("median"),
        F.percentile(value, 0.9).alias("p90"),
        F.max(value).alias("max"),
    )


def robust_score(x: Column, median: Column, mad: Column, mean_ad: Column, p: RobustParams = RobustParams()) -> Column:
    """(x - median) over the MAD, over the mean deviation if that is zero, else null."""
    return F.when(mad > p.eps, p.mad_scale * (x - median) / mad).when(
        mean_ad > p.eps, (x - median) / (p.mean_scale * mean_ad)
    )


def score_method(mad: Column, mean_ad: Column, p: RobustParams = RobustParams()) -> Column:
    return F.when(mad > p.eps, "MAD").when(mean_ad > p.eps, "MEAN_AD").otherwise("DEGENERATE")


def empirical_cdf(x: Column, reference: Column) -> Column:
    """Share of an array of reference values that are at most ``x``."""
    below = F.size(F.filter(reference, lambda r: r <= x))
    return F.when(F.size(reference) > 0, below / F.size(reference))


def share_at_most(df: DataFrame, keys: list[str], value: str, x: Column) -> DataFrame:
    """(keys, share) of known values that are at most ``x``, without gathering them."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg((F.count_if(F.col(value) <= x) / F.count("*")).alias("share"))


def array_median(values: Column) -> Column:
    """Median of an array without nulls."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        low = F.get(s, F.floor((n - 1) / 2).cast("int"))
        return (low + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return let(F.array_sort(values), middle)


def array_robust_score(x: Column, others: Column, p: RobustParams = RobustParams()) -> Column:
    """Robust score of ``x`` against an array of other values."""

    def about(m: Column) -> Column:
        apart = F.transform(others, lambda v: F.abs(v - m))
        mean = F.aggregate(apart, F.lit(0.0), lambda acc, v: acc + v) / F.size(others)
        return let(
            F.struct(array_median(apart).alias("mad"), mean.alias("mean_ad")),
            lambda d: robust_score(x, m, d["mad"], d["mean_ad"], p),
        )

    return let(array_median(others), about)


def leave_one_out(values: Column, least_others: int = 3, p: RobustParams = RobustParams()) -> Column:
    """Positive robust scores of each value against all others, in order of the values.

    Values with fewer than ``least_others`` others, or a degenerate reference, are
    left out.  The values are sorted once: what is left without one of them has one
    of three medians.  For each of these the deviations of all values are sorted
    once; without a value's own deviation, the one at a place is the next one if
    its own is not above it.  So the work is that of four sorts.
    """

    def scores(s: Column) -> Column:
        n = F.size(s)
        h = F.floor(n / 2).cast("int")
        at = lambda k: F.get(s, k)
        even = n % 2 == 0
        medians = F.when(even, F.array(at(h), at(h - 1))).otherwise(
            F.array((at(h) + at(h + 1)) / 2, (at(h - 1) + at(h + 1)) / 2, (at(h - 1) + at(h)) / 2)
        )
        which = lambda i: F.when(i < h, 0).when(even, 1).when(i == h, 1).otherwise(2)

        def about(m: Column) -> Column:
            apart = F.array_sort(F.transform(s, lambda v: F.abs(v - m)))
            total = lambda d: F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)
            return let(apart, lambda d: F.struct(m.alias("m"), d.alias("d"), total(d).alias("total")))

        def score(v: Column, own: Column, ref: Column) -> Column:
            others = lambda k: F.when(own > F.get(ref["d"], k), F.get(ref["d"], k)).otherwise(F.get(ref["d"], k + 1))
            low, high = F.floor((n - 2) / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
            mad = (others(low) + others(high)) / 2
            mean = (ref["total"] - own) / (n - 1)
            return let(F.struct(mad.alias("a"), mean.alias("b")), lambda d: robust_score(v, ref["m"], d["a"], d["b"], p))

        def each(refs: Column) -> Column:
            one = lambda i: let(
                F.struct(at(i).alias("v"), which(i).alias("c")),
                lambda x: score(x["v"], F.abs(x["v"] - F.get(refs, x["c"])["m"]), F.get(refs, x["c"])),
            )
            found = F.transform(F.sequence(F.lit(0), n - 1), one)
            return F.transform(F.filter(found, lambda z: z.isNotNull()), lambda z: F.greatest(F.lit(0.0), z))

        return F.when(n > least_others, let(F.transform(medians, about), each)).otherwise(F.array().cast("array<double>"))

    return let(F.array_sort(values), scores)


def daily(df: DataFrame, keys: list[str], day: str, value: str, how: str = "max") -> DataFrame:
    """One value a day and key by max, mean or median; a day without known values is null."""
    fold = {"max": F.max, "mean": F.avg, "median": F.median}[how]
    return df.groupBy(*keys, day).agg(fold(value).alias("daily"), F.count("*").alias("n_obs"))
