"""Market regimes: inclusive date ranges, the last one open. Labels are for looking back only."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.quantiles import exact_quantiles, matched
from tidemark.functions.stats import excess_kurtosis, skew
from tidemark.functions.tables import once
from tidemark.functions.windows import log_return


def regime_of(date: Column, regimes: tuple[C.Regime, ...] = C.REGIMES) -> Column:
    """The regime of a date, the last one that holds it; null before the first. A handful of branches, no join."""
    out = F.lit(None).cast("string")
    for r in regimes:
        inside = (date >= F.lit(r.start)) & (F.lit(True) if r.end is None else date <= F.lit(r.end))
        out = F.when(inside, r.key).otherwise(out)
    return out


def near_boundary(date: Column, days: int = 1, regimes: tuple[C.Regime, ...] = C.REGIMES) -> Column:
    """Whether a regime starts or ends within ``days`` of a date."""
    edges = [F.lit(d) for r in regimes for d in (r.start, r.end) if d]
    return F.exists(F.array(*edges), lambda b: F.abs(F.datediff(date, b)) <= days)


#: Regimes of a table at most, which one process holds as sorted segments.
MOST_REGIMES = 1 << 20


def segments(regimes: list[tuple[str, dt.date, dt.date | None, int]]) -> tuple[np.ndarray, list[str | None]]:
    """Days at which the regime in force changes, sorted, and the regime from each of them on: of several the one of the largest ordinal, of equal ordinals the last listed.

    A sweep over starts and ends; the regimes that have begun wait in a heap and leave it when they have ended.
    """
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    opened = sorted((day(a), k) for k, (_, a, b, _) in enumerate(regimes) if a is not None and (b is None or b >= a))
    marks = sorted({x for a, k in opened for x in (a, None if regimes[k][2] is None else day(regimes[k][2]) + 1) if x is not None})
    heap: list[tuple[int, int, float, str]] = []
    days, names, at = [], [], 0
    for mark in marks:
        while at < len(opened) and opened[at][0] <= mark:
            k = opened[at][1]
            key, _, b, ordinal = regimes[k]
            heappush(heap, (-ordinal, -k, np.inf if b is None else day(b), key))
            at += 1
        while heap and heap[0][2] < mark:
            heappop(heap)
        days.append(mark)
        names.append(heap[0][3] if heap else None)
    return np.array(days, dtype=np.int64), names


def tagged(df: DataFrame, table: DataFrame, date: str = "date", name: str = "regime", near: int | None = None) -> DataFrame:
    """``df`` with the regime of each date from a table (key, start, end, ordinal), and with ``near`` whether a regime starts or ends within so many days (``near_boundary``).

    Both ends are inclusive, a null end is open, and of regimes that overlap the one of the largest ordinal holds; regimes without a start hold nowhere. Segments are searched for each date that there is, not for each row.
    """
    found = table.select("key", "start", "end", "ordinal").limit(MOST_REGIMES + 1).collect()
    if len(found) > MOST_REGIMES:
        raise ValueError(f"more than {MOST_REGIMES} regimes")
    rows = sorted((tuple(r) for r in found), key=lambda r: (r[3], str(r[0])))
    days, names = segments(rows)
    edges = np.array(sorted({(d - dt.date(1970, 1, 1)).days for _, a, b, _ in rows for d in (a, b) if d is not None}), dtype=np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(0).cast(pa.int32()).to_numpy().astype(np.int64)
            at = np.searchsorted(days, d, "right") - 1
            columns = [batch.column(0), pa.array([names[k] if k >= 0 else None for k in at], pa.string())]
            if near is not None:
                columns.append(pa.array(np.searchsorted(edges, d + near, "right") > np.searchsorted(edges, d - near)))
            yield pa.RecordBatch.from_arrays(columns, names=["_date", name, "near_boundary"][: len(columns)])

    dates = df.select(F.col(date).alias("_date")).where("_date is not null").distinct()
    looked = dates.mapInArrow(search, f"_date date, {name} string" + (", near_boundary boolean" if near is not None else ""))
    return df.join(looked, F.col(date) == F.col("_date"), "left").drop("_date")


def return_statistics(bars: DataFrame) -> DataFrame:
    """Return statistics by ticker and regime; the drawdown starts anew in each regime."""
    r = bars.withColumn("lr", log_return(F.col("close"))).withColumn("regime", regime_of(F.col("date"))).where("lr IS NOT NULL AND regime IS NOT NULL")
    w = Window.partitionBy("ticker", "regime").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("dd", F.col("close") / F.max("close").over(w) - 1)
    n, lr = F.count("lr").cast("double"), F.col("lr")
    return r.groupBy("ticker", "regime").agg(
        F.count("lr").alias("n"), (F.exp(F.sum(lr)) - 1).alias("cum_return"), (F.avg(lr) * C.TRADING_DAYS).alias("ann_log_return"), (F.pow(F.exp(F.sum(lr)), C.TRADING_DAYS / n) - 1).alias("cagr"),
        (F.stddev_samp(lr) * F.sqrt(F.lit(C.TRADING_DAYS))).alias("volatility"), skew(lr).alias("skew"), excess_kurtosis(lr).alias("kurtosis"), F.sqrt(6 / n).alias("skew_se"), F.sqrt(24 / n).alias("kurtosis_se"),
        F.min("dd").alias("max_drawdown"), F.min("date").alias("first"), F.max("date").alias("last"),
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Distribution of a column by ticker and regime, with exact quantiles."""
    x = F.col(value)
    kept = df.withColumn("regime", regime_of(F.col("date"))).where(x.isNotNull() & F.col("regime").isNotNull()).select("ticker", "regime", value)
    kept, by = once(kept), ["ticker", "regime"]
    out = kept.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    named = {f"q{round(100 * v):02d}": v for v in C.QUANTILES}
    whole = matched(out, exact_quantiles(kept, by, value, named), by)
    return whole.select(*by, "n", "mean", "std", F.try_divide("std", F.abs("mean")).alias("cv"), *named, "low", "high")


def spread(distributions: DataFrame) -> DataFrame:
    """Largest and smallest regime mean of a ticker, their ratio, and which regimes (the earlier on ties)."""
    top, low = F.struct("mean", (-F.substring("regime", 2, 9).cast("int")).alias("_k")), F.struct("mean", F.substring("regime", 2, 9).cast("int").alias("_k"))
    return distributions.groupBy("ticker").agg(F.max("mean").alias("max_mean"), F.min("mean").alias("min_mean"), F.max_by("regime", top).alias("max_regime"), F.min_by("regime", low).alias("min_regime")).withColumn(
        "ratio", F.try_divide("max_mean", "min_mean")
    )


def firing_rate(df: DataFrame, flag: str) -> DataFrame:
    """Percent of judged rows (those with a value) on which a 0/1 column fires, by ticker and regime."""
    r = df.withColumn("regime", regime_of(F.col("date"))).where("regime IS NOT NULL")
    return r.groupBy("ticker", "regime").agg(F.count(flag).alias("judged"), F.count_if(F.col(flag) == 1).alias("fired")).withColumn("rate", F.try_divide(F.col("fired") * 100.0, F.col("judged")))


def pass_through(distributions: DataFrame, returns: DataFrame) -> DataFrame:
    """How much of the spread of volatility over regimes an indicator's spread shows, on a log scale; its medians' ratio and mean CV."""
    own = distributions.groupBy("ticker").agg(F.try_divide(F.max("mean"), F.min("mean")).alias("ratio"), F.try_divide(F.max("q50"), F.min("q50")).alias("median_ratio"), F.avg("cv").alias("mean_cv"))
    vol = returns.groupBy("ticker").agg(F.try_divide(F.max("volatility"), F.min("volatility")).alias("volatility_ratio"))
    return own.join(vol, "ticker").withColumn("log_pass_through", F.try_divide(F.ln("ratio"), F.ln("volatility_ratio")))


def panel(df: DataFrame, windows: dict[str, tuple[dt.date, dt.date]]) -> DataFrame:
    """Days, mean ATR in percent, mean band width, mean and deviation of RSI by ticker, over named windows that may overlap."""
    named = F.array_compact(F.array(*[F.when(F.col("date").between(F.lit(a), F.lit(b)), F.lit(k)) for k, (a, b) in windows.items()]))
    rows = df.withColumn("panel", F.explode(named))
    return rows.groupBy("ticker", "panel").agg(F.count("*").alias("n"), F.avg("atr_pct").alias("atr_pct"), F.avg("bb_width").alias("bb_width"), F.avg("rsi_wilder_14").alias("rsi_mean"), F.stddev_samp("rsi_wilder_14").alias("rsi_std"))


def inside_band(df: DataFrame, position: str = "bb_percent_b") -> DataFrame:
    """Percent of judged days above, below and inside the band, by ticker and regime."""
    x = F.col(position)
    r = df.withColumn("regime", regime_of(F.col("date"))).where(F.col("regime").isNotNull() & x.isNotNull())
    share = lambda c: F.avg(c.cast("double")) * 100
    return r.groupBy("ticker", "regime").agg(F.count("*").alias("judged"), share(x > 1).alias("upper"), share(x < 0).alias("lower")).withColumn("inside", 100 - F.col("upper") - F.col("lower"))


def tails(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Median, mean, percent beyond each threshold and their ratio, and the thresholds that would be as rare on both sides."""
    x, kept = F.col(value), once(df.where(F.col(value).isNotNull()).select("ticker", value))
    out = kept.groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), (F.avg((x < low).cast("double")) * 100).alias("low_pct"), (F.avg((x > high).cast("double")) * 100).alias("high_pct"), F.try_divide(F.avg((x > high).cast("double")), F.avg((x < low).cast("double"))).alias("ratio")
    )
    return matched(out, exact_quantiles(kept, ["ticker"], value, {"median": 0.5, "even_low": 0.05, "even_high": 0.95}), ["ticker"])
