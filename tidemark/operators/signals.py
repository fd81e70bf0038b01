"""Signals: level conditions, edges, and the returns that follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.windows import by_date, edge, forward_return, previous

Definition = tuple[str, str, Callable[[], Column]]
RSI = f"rsi_wilder_{C.RSI_PERIOD}"
SIGNALS: list[Definition] = [
    ("S1", "RSI below its low threshold", lambda: F.col(RSI) < C.RSI_LOW),
    ("S2", "RSI above its high threshold", lambda: F.col(RSI) > C.RSI_HIGH),
    ("S3", "close below the lower band", lambda: F.col("close") < F.col("bb_lower")),
    ("S4", "close above the upper band", lambda: F.col("close") > F.col("bb_upper")),
    ("S5", "MACD above its signal line", lambda: F.col("macd_line") > F.col("macd_signal")),
]


def make_signals(indicators: DataFrame, definitions: list[Definition] | None = None, keep_condition: bool = True) -> DataFrame:
    """One row per date, ticker and signal: its level condition and whether it has just begun.

    Edges are taken before the rows are multiplied, so all signals share one window.
    """
    named = {i: F.coalesce(f(), F.lit(False)) for i, _, f in definitions or SIGNALS}
    level = indicators.select("date", "ticker", *[c.alias(f"_c{i}") for i, c in named.items()])
    edged = level.select("*", *[edge(F.col(f"_c{i}")).alias(f"_e{i}") for i in named])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("signal_id"), F.col(f"_c{i}").alias("condition"), F.col(f"_e{i}").alias("signal")) for i in named]))
    out = edged.select("date", "ticker", rows.alias("s")).select("date", "ticker", "s.signal_id", "s.condition", "s.signal")
    return out if keep_condition else out.drop("condition")


def judge(x: Column, threshold: float, direction: str = "below") -> Column:
    """1 or 0 by a threshold, null where there is no value."""
    below = C.choose(direction, ("below", "above"), "direction") == "below"
    return F.when(x.isNotNull(), ((x < threshold) if below else (x > threshold)).cast("double"))


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = C.HORIZONS) -> DataFrame:
    close = F.col("close")
    return bars.withColumns({"entry_price": F.lead(close, 1).over(by_date())} | {f"fwd_ret_{h}": forward_return(close, h) for h in horizons})


def shocks(bars: DataFrame, threshold: float = C.SHOCK) -> DataFrame:
    """Days on which the close moved by ``threshold`` or more."""
    moved = bars.withColumn("daily_return", F.try_divide(F.col("close"), previous(F.col("close"))) - 1)
    return moved.where(F.abs("daily_return") >= threshold)


def by_horizon(df: DataFrame, keep: list[str], horizons: tuple[int, ...] = C.HORIZONS) -> DataFrame:
    """``df`` with one row per horizon: h and ret."""
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"fwd_ret_{h}").alias("ret")) for h in horizons]))
    return df.select(*keep, rows.alias("x")).select(*keep, "x.h", "x.ret")
