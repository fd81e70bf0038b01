"""Comparing two series or two flags over the same bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date


def differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both have values, with their absolute difference."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("diff", F.abs(F.col(a) - F.col(b)))


def compare(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest and mean difference by ticker, and the first date of the largest; null if there is none."""
    d = differences(df, a, b)
    out = d.groupBy("ticker").agg(F.count("*").alias("n"), F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"), F.max_by("date", F.struct("diff", (-F.unix_date("date")).alias("_d"))).alias("worst"))
    return out.withColumn("worst", F.when(F.col("max_diff") > 0, F.col("worst")))


def largest(df: DataFrame, a: str, b: str, n: int = 5) -> DataFrame:
    """The ``n`` largest differences of each ticker, the earlier date first on ties."""
    w = Window.partitionBy("ticker").orderBy(F.desc("diff"), "date")
    return differences(df, a, b).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("ticker", "nth", "date", "diff")


def by_era(df: DataFrame, a: str, b: str, early: dt.date, late: dt.date, exact: float = 1e-12, close: float = 1e-6) -> DataFrame:
    """Differences before ``early`` and from ``late`` on, and whether they fade out as the series goes on."""
    d = differences(df, a, b)
    old, new = F.col("date") < F.lit(early), F.col("date") >= F.lit(late)
    out = d.groupBy("ticker").agg(F.max(F.when(old, F.col("diff"))).alias("max_early"), F.max(F.when(new, F.col("diff"))).alias("max_late"), F.avg(F.when(new, F.col("diff"))).alias("mean_late"), F.max("diff").alias("max_diff"))
    kind = F.when(F.col("max_diff") <= exact, "same").when(F.col("max_late") <= close, "converges").otherwise("differs")
    return out.withColumn("kind", kind)


def precision(df: DataFrame, a: str, b: str, noise: float = 1e-12) -> DataFrame:
    """How exactly two series agree: absolute differences and those relative to the larger value, equal values, equal null positions, and a verdict."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    gap = F.abs(x - y)
    d = df.withColumns({"_abs": F.when(both, gap), "_rel": F.when(both, F.try_divide(gap, F.greatest(F.abs(x), F.abs(y))))})
    out = d.groupBy("ticker").agg(
        F.max("_abs").alias("max_abs"), F.max("_rel").alias("max_rel"), F.max_by("_rel", F.when(F.col("_rel").isNotNull(), F.col("date"))).alias("last_rel"), F.count_if(F.col("_abs") > 0).alias("n_different"), F.bool_and(x.isNull() == y.isNull()).alias("same_nulls")
    )
    verdict = F.when(F.col("max_abs").isNull(), "nothing to compare").when(F.col("max_abs") == 0, "exact").when(F.col("max_abs") < noise, "float noise").when(F.coalesce("max_rel", F.lit(0.0)) < noise, "relative").otherwise("different")
    return out.withColumn("verdict", verdict)


def disagreement(df: DataFrame, a: str, b: str, around: int = 3) -> DataFrame:
    """Rows on which two flags agree or not, rates and containment, and how many disagreements lie within ``around`` rows of the other flag.

    Rows on which a flag is null aren't judged and count as not fired, but they keep their place in the neighbourhood.
    """
    w = by_date().rowsBetween(-around, around)
    judged = F.col(a).isNotNull() & F.col(b).isNotNull()
    fired = df.withColumns({"_ok": judged, "_a": F.coalesce(F.col(a) & judged, F.lit(False)), "_b": F.coalesce(F.col(b) & judged, F.lit(False))})
    x, y = F.col("_a"), F.col("_b")
    d = fired.withColumns({"_na": F.max(x.cast("int")).over(w) == 1, "_nb": F.max(y.cast("int")).over(w) == 1})
    only_a, only_b = x & ~y, y & ~x
    out = d.groupBy("ticker").agg(
        F.count_if("_ok").alias("n_days"), F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("n_both"), F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"), F.count_if(~x & ~y & F.col("_ok")).alias("neither"),
        F.count_if(only_a & F.col("_nb")).alias("only_a_timing"), F.count_if(only_b & F.col("_na")).alias("only_b_timing"),
    )
    n = F.col
    timing, either = n("only_a_timing") + n("only_b_timing"), n("n_both") + n("only_a") + n("only_b")
    out = out.where("n_days > 0").withColumns({"timing": timing, "real": n("only_a") + n("only_b") - timing})
    percent = lambda x, of: F.try_divide(x * 100.0, of)
    return out.withColumns({
        "rate_a": percent(n("n_a"), n("n_days")), "rate_b": percent(n("n_b"), n("n_days")), "frequency_ratio": F.try_divide(n("n_a").cast("double"), n("n_b")), "a_in_b": percent(n("n_both"), n("n_a")), "b_in_a": percent(n("n_both"), n("n_b")),
        "disagreement": percent(n("only_a") + n("only_b"), either), "real_disagreement": percent(n("real"), either),
    })
