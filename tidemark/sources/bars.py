"""Bars and rates: normalising, reading, writing, and their derivation from the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long"
TRADES = "signal_id string, holding_days int, entry_date date, exit_date date, entry_price double, exit_price double, size double, pnl double, return_pct double, exit_reason string"


def normalize(raw: DataFrame, ticker: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Bars in the canonical columns: dates at midnight, ``adj_close`` the close if missing, volume null if missing.

    NaN prices become null; rows without any price go. A missing price column is an error.
    """
    lower = {c: (names or {}).get(c, c.lower().replace(" ", "_")) for c in raw.columns}
    df = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in lower.items()])
    if missing := [c for c in ("date", *PRICES) if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if ticker is not None:
        df = df.withColumn("ticker", F.lit(ticker))
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in PRICES}
    adjusted = F.coalesce(F.col("adj_close").cast("double"), clean["close"]) if "adj_close" in df.columns else clean["close"]
    volume = F.col("volume").cast("long") if "volume" in df.columns else F.lit(None).cast("long")
    out = df.select(F.to_date("date").alias("date"), F.col("ticker").cast("string").alias("ticker"), *[clean[c].alias(c) for c in PRICES], adjusted.alias("adj_close"), volume.alias("volume"))
    return out.dropna("all", subset=list(PRICES))


def collect_bars(frames: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Bars of all tickers, and why a ticker failed; a failed ticker doesn't stop the others."""
    good, failed = [], {}
    for ticker, raw in frames.items():
        try:
            good.append(normalize(raw, ticker))
        except ValueError as e:
            failed[ticker] = str(e)
    return (reduce(DataFrame.unionByName, good) if good else None), failed


def write_bars(bars: DataFrame, path: str) -> None:
    bars.orderBy("ticker", "date").write.mode("overwrite").parquet(path)


def read_bars(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Bars in the canonical schema; a file without one of its columns gives nulls there. ``ordered`` sorts them by ticker and date."""
    bars = spark.read.schema(SCHEMA).parquet(path)
    return bars.orderBy("ticker", "date") if ordered else bars


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """One CSV with a header; for reports of bounded size. With ``mark`` it starts with a UTF-8 byte-order mark, which goes before the first column's name."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    named.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRADES).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_signals(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").partitionBy("signal_id").parquet(path)


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority: a path of integer cents that each order's price moves.

    Moves are summed up by day first; where a day starts is a running sum over these few rows (a row a
    ticker and day of the calendar), and only inside a day are orders put in sequence. So the work is dealt by day.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("long") - 25_000_000
    moves = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_orderdate", F.col("o_orderkey").alias("k"), cents.alias("move"))
    before = F.sum("_day").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    starts = moves.groupBy("ticker", "date").agg(F.sum("move").alias("_day")).select("ticker", "date", (F.coalesce(before, F.lit(0)) + 10_000_000_000).alias("_start"))
    inside = F.sum("move").over(Window.partitionBy("ticker", "date").orderBy("o_orderdate", "k").rowsBetween(Window.unboundedPreceding, 0))
    ticks = moves.withColumn("_in", inside).join(starts, ["ticker", "date"]).withColumn("px", (F.col("_start") + F.col("_in")).cast("double") / 100)
    return ticks.groupBy("ticker", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.max_by("px", "k").alias("adj_close"), F.count("*").alias("volume")
    )


def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily annual rate in percent, from line item taxes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_tax") * 100, 3).alias("rate"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by event type and hour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )
