"""Checks of bars: each one is a DataFrame of its own, evaluated on demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.windows import previous

COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")

RULES = ("high < low", "high < open", "high < close", "low > open", "low > close")


def coverage(bars: DataFrame) -> DataFrame:
    years = F.datediff(F.max("date"), F.min("date")) / C.CALENDAR_DAYS
    return bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.round(F.try_divide(F.count("*"), years), 1).alias("rows_per_year"))


def duplicates(bars: DataFrame) -> DataFrame:
    """Rows after the first of each date and ticker."""
    return bars.groupBy("ticker", "date").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_duplicate"))


def missing(bars: DataFrame) -> DataFrame:
    """Nulls and non-positive values by column."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in COLUMNS] + [F.count_if(F.col(c) <= 0).alias(f"{c}_low") for c in COLUMNS]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_null").alias("n_null"), F.col(f"{c}_low").alias("n_nonpositive")) for c in COLUMNS]))
    return bars.agg(*counts).select(rows.alias("r")).select("r.name", "r.n_null", "r.n_nonpositive")


def violations(bars: DataFrame) -> DataFrame:
    """Bars whose high or low isn't outermost."""
    return bars.where(reduce(lambda a, b: a | b, [F.expr(r) for r in RULES]))


def ohlc_summary(bars: DataFrame) -> DataFrame:
    bad = violations(bars).groupBy("ticker").count().withColumnRenamed("count", "n_violation")
    gap = bars.groupBy("ticker").agg(F.round(F.avg(F.try_divide(F.abs(F.col("close") - F.col("adj_close")), F.col("close"))), 6).alias("adjustment"))
    return gap.join(bad, "ticker", "left").select("ticker", F.coalesce("n_violation", F.lit(0)).alias("n_violation"), "adjustment")


def gaps(bars: DataFrame, days: int = C.GAP_DAYS) -> DataFrame:
    """Calendar gaps of ``days`` or more before a bar."""
    return bars.select("ticker", previous(F.col("date")).alias("after"), "date").withColumn("days", F.datediff("date", "after")).where(F.col("days") >= days)


def shock_pivot(shocks: DataFrame) -> DataFrame:
    """Shock days by year, down and up; years without one direction show zero."""
    side = F.when(F.col("daily_return") < 0, "down").otherwise("up")
    return shocks.groupBy(F.year("date").alias("year")).pivot("_side", ["down", "up"]).count().na.fill(0) if "_side" in shocks.columns else shock_pivot(shocks.withColumn("_side", side))


def shock_counts(bars: DataFrame, threshold: float = C.SHOCK) -> DataFrame:
    """Shock days of every ticker, zero where there is none."""
    moves = bars.select("ticker", (F.col("close") / previous(F.col("close")) - 1).alias("_r"))
    return moves.groupBy("ticker").agg(F.count_if(F.abs("_r") >= threshold).alias("n"))


def extremes(shocks: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` worst and best shock days, the earlier date and ticker first on ties."""
    def ends(side: str, *order: Column) -> DataFrame:
        few = shocks.orderBy(*order).limit(n)
        return few.withColumn("nth", F.row_number().over(Window.orderBy(*order))).select(F.lit(side).alias("side"), "nth", "ticker", "date", "daily_return")

    return ends("worst", F.col("daily_return"), F.col("date"), F.col("ticker")).unionByName(ends("best", F.desc("daily_return"), F.col("date"), F.col("ticker")))


def preview(found: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of a finding by ticker and date."""
    return found.orderBy("ticker", "date").limit(n)


def summary(bars: DataFrame, shock: float = C.SHOCK, gap: int = C.GAP_DAYS) -> DataFrame:
    """All eight checks in one table: name, item (a ticker or column, empty if the check has none) and value."""
    row = lambda df, name, item, value: df.select(F.lit(name).alias("name"), item.alias("item"), F.col(value).cast("double").alias("value"))
    none, ticker = F.lit(""), F.col("ticker")
    cover, nulls, ohlc = coverage(bars), missing(bars), ohlc_summary(bars)
    every = bars.select("ticker").distinct()
    counted = every.join(gaps(bars, gap).groupBy("ticker").agg(F.count("*").alias("n_gap")), "ticker", "left").na.fill(0, ["n_gap"])
    parts = [row(cover, "rows", ticker, "n"), row(cover, "rows_per_year", ticker, "rows_per_year"), row(duplicates(bars), "duplicates", none, "n_duplicate"), row(nulls, "nulls", F.col("name"), "n_null"), row(nulls, "nonpositive", F.col("name"), "n_nonpositive"),
             row(ohlc, "violations", ticker, "n_violation"), row(counted, "gaps", ticker, "n_gap"), row(shock_counts(bars, shock), "shocks", ticker, "n")]
    return reduce(DataFrame.unionByName, parts)


def write_report(findings: DataFrame, path: str) -> None:
    """The columns of a table of findings as lines of text, in order; for reports of bounded size."""
    findings.orderBy(*findings.columns).select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in findings.columns]).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(table: DataFrame, digits: int = 4) -> str:
    """A small table of results as markdown, doubles to ``digits`` places."""
    cells = [F.coalesce(F.format_number(c, digits) if t in ("double", "float") else F.col(c).cast("string"), F.lit("-")) for c, t in table.dtypes]
    lines = table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).collect()
    return "\n".join(["| " + " | ".join(table.columns) + " |", "| " + " | ".join("---" for _ in table.columns) + " |", *(r["line"] for r in lines)])


def ensure(df: DataFrame, ok: Column, message: str, *shown: str) -> DataFrame:
    """``df``, whose evaluation fails at a row for which ``ok`` isn't true. The check is part of the plan and no job of its own.

    It looks at the rows of ``df`` only: a condition that isn't deterministic is not moved below joins or before earlier filters.
    """
    said = F.concat_ws(" ", F.lit(message), *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in shown])
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.spark_partition_id() >= 0).otherwise(F.raise_error(said).cast("boolean")))


def unique_on(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, which fails if a key repeats: what a many-to-one join needs on its right side. Rows are dealt by the key as the join deals them."""
    counted = df.withColumn("_same", F.count("*").over(Window.partitionBy(*keys)))
    return ensure(counted, F.col("_same") == 1, "repeated key:", *keys).drop("_same")


def all_matched(joined: DataFrame, column: str, *shown: str) -> DataFrame:
    """``joined``, which fails if a row of the left side has not found its ``column``."""
    return ensure(joined, F.col(column).isNotNull(), f"no {column}:", *shown)


def reconciled(joined: DataFrame, a: str, b: str, within: float = 1e-15) -> DataFrame:
    """``joined`` without ``b``, which fails unless both columns agree, nulls included."""
    same = (F.col(a).isNull() & F.col(b).isNull()) | (F.abs(F.col(a) - F.col(b)) <= within)
    return ensure(joined, same, f"{a} and {b} differ:", a, b).drop(b)


def positive(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame``, which fails if a column has a null or a value at or below zero, of which no log can be taken."""
    return ensure(frame, reduce(lambda x, y: x & y, [F.col(c) > 0 for c in columns]), "not above zero:", *columns)


def gate_record(bars: DataFrame, rows_per_year: float = C.TRADING_DAYS, tolerance: float = 10.0) -> DataFrame:
    """What the gate looks at: name, item, value and whether it passes. No duplicates, no inner highs or lows, about as many rows a year as expected."""
    one = lambda df, name, item, value, ok: df.select(F.lit(name).alias("name"), item.alias("item"), F.col(value).cast("double").alias("value"), ok.alias("ok"))
    ticker = F.col("ticker")
    return reduce(DataFrame.unionByName, [
        one(duplicates(bars), "duplicates", F.lit(""), "n_duplicate", F.col("n_duplicate") == 0), one(ohlc_summary(bars), "violations", ticker, "n_violation", F.col("n_violation") == 0),
        one(coverage(bars), "rows_per_year", ticker, "rows_per_year", F.coalesce(F.abs(F.col("rows_per_year") - rows_per_year) <= tolerance, F.lit(False))),
    ])


def gated(bars: DataFrame, rows_per_year: float = C.TRADING_DAYS, tolerance: float = 10.0) -> DataFrame:
    """``bars``, which fail if they don't pass the gate."""
    outer = reduce(lambda a, b: a & b, [F.expr(f"NOT coalesce({r}, false)") for r in RULES])
    whole = ensure(unique_on(bars, "ticker", "date"), outer, "inner high or low:", "ticker", "date")
    rate = coverage(bars).select(F.col("ticker").alias("_t"), "rows_per_year")  # a row a ticker
    joined = whole.join(rate, F.col("ticker").eqNullSafe(F.col("_t")))
    return ensure(joined, F.abs(F.col("rows_per_year") - rows_per_year) <= tolerance, "rows a year:", "ticker", "rows_per_year").drop("_t", "rows_per_year")


def calendar_differences(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Dates that only one of the calendars has."""
    p, r = prices.select("date").distinct(), rates.select("date").distinct()
    return p.join(r, "date", "left_anti").withColumn("side", F.lit("price_only")).unionByName(r.join(p, "date", "left_anti").withColumn("side", F.lit("rate_only")))
