"""Exact quantiles of groups of any size, by selection: no group's values meet in one buffer.

Values are counted by group and value first. A sketch of bounded size gives each group's values about ``RANGES`` ranges; a histogram of these says which ranges hold the
wanted ranks, and only the rows of those ranges are ranked. The ranges only share out the work: ranks are counted, not estimated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import once

RANGES = 128


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """A join on ``keys`` in which nulls are equal; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + ([also] if also is not None else []))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """A row a group that has a value: ``by`` and a column for each wanted quantile, interpolated between neighbours in rank. Nulls don't count."""
    cells = once(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_k")))
    borders = cells.groupBy(*by).agg(F.percentile_approx("_x", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10 * RANGES)).alias("_borders"), F.sum("_k").alias("_n"))
    # a value equal to a border belongs above it, so equal values share a range
    dealt = matched(cells, borders, by).withColumn("_range", F.size(F.filter("_borders", lambda b: b <= F.col("_x")))).drop("_borders")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    histogram = dealt.groupBy(*by, "_range", "_n").agg(F.sum("_k").alias("_held")).withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ends = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), F.least(F.floor(at(q)) + side, F.col("_n") - 1).alias("rank"), (at(q) - F.floor(at(q))).alias("share")) for name, q in wanted.items() for side in (0, 1)]
    ranks = histogram.select(*by, "_range", "_held", "_before", F.explode(F.array(*ends)).alias("w")).where("w.rank >= _before AND w.rank < _before + _held")
    inside = Window.partitionBy(*by, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    needed = ranks.groupBy(*by, "_range").agg(F.collect_list("w").alias("_wanted"), F.first("_before").alias("_before"))  # two a quantile at most
    ranked = matched(dealt.drop("_n"), needed, [*by, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_k").over(inside))
    found = ranked.select(*by, "_x", F.explode(F.filter("_wanted", lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_k")))).alias("w"))
    value_at = lambda name, side: F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == side), F.col("_x")))
    share = lambda name: F.max(F.when(F.col("w.name") == name, F.col("w.share")))
    out = {name: value_at(name, 0) + share(name) * (value_at(name, 1) - value_at(name, 0)) for name in wanted}
    return found.groupBy(*by).agg(*[x.alias(name) for name, x in out.items()])
