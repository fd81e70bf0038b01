"""Performance of equity curves and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.blocks import DAYS, Prefix, prefixes
from tidemark.functions.tables import once
from tidemark.operators.backtest import RUN
from tidemark.operators.regimes import near_boundary, regime_of

#: Excess within float noise of zero, as on days in cash, is zero.
NOISE = 1e-12
KEYS = list(RUN)


def curve_metrics(curves: DataFrame, days: int = DAYS) -> DataFrame:
    """Return, growth, volatility, Sharpe, Sortino, drawdown and Calmar of each run.

    The Sharpe ratio of a run whose excess is float noise is null. Sortino takes the deviation of
    negative excess only, of which there must be two.
    """
    held = prefixes(curves, {"_top": Prefix("max", F.col("equity")), "_before": Prefix("last", F.struct("equity"), before=True)}, RUN, days=days)
    c = held.withColumns({"r": F.col("equity") / F.col("_before.equity") - 1, "dd": F.col("equity") / F.col("_top") - 1})
    c = c.withColumn("x", F.col("r") - F.coalesce("risk_free", F.lit(0.0)))
    x, year = F.col("x"), F.lit(float(C.TRADING_DAYS))
    a = c.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min_by("equity", "date").alias("e0"), F.max_by("equity", "date").alias("e1"), F.stddev_samp("r").alias("sd"), F.avg(x).alias("mx"), F.stddev_samp(x).alias("sx"),
        F.stddev_samp(F.when(x < -NOISE, x)).alias("sn"), F.min("dd").alias("mdd"),
    )
    growth = F.col("e1") / F.col("e0")
    a = a.withColumns({"total_return": (growth - 1) * 100, "cagr": F.when(growth > 0, (F.pow(growth, year / F.col("n")) - 1) * 100), "volatility": F.col("sd") * F.sqrt(year) * 100, "max_drawdown": F.col("mdd") * 100})
    return a.select(
        *KEYS, "n", "total_return", "cagr", "volatility", F.when(F.col("sx") > NOISE, F.col("mx") / F.col("sx") * F.sqrt(year)).alias("sharpe"), F.when(F.col("sn") > NOISE, F.col("mx") / F.col("sn") * F.sqrt(year)).alias("sortino"),
        "max_drawdown", F.when(F.col("mdd") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
    )


def trade_metrics(trades: DataFrame) -> DataFrame:
    pnl = F.col("pnl")
    return trades.groupBy(*KEYS).agg(
        F.count("*").alias("trades"), (F.avg((pnl > 0).cast("double")) * 100).alias("win_rate"), F.try_divide(F.sum(F.when(pnl > 0, pnl)), -F.sum(F.when(pnl < 0, pnl))).alias("profit_factor"), F.avg("holding_days").alias("average_holding")
    )


def summarize(curves: DataFrame, trades: DataFrame) -> DataFrame:
    """A row a run: the metrics of its curve and of its trades, and the percent of days in position."""
    curves = once(curves)
    exposure = curves.groupBy(*KEYS).agg((F.avg(F.col("in_position").cast("double")) * 100).alias("exposure"))
    return curve_metrics(curves).join(trade_metrics(trades), KEYS, "left").join(exposure, KEYS)


def without_cash(with_cash: DataFrame, no_cash: DataFrame) -> DataFrame:
    """Growth without interest on idle cash, and what the interest adds in percentage points."""
    return with_cash.select(*KEYS, "cagr").join(no_cash.select(*KEYS, F.col("cagr").alias("cagr_nocash")), KEYS).withColumn("cash_contrib_pp", F.col("cagr") - F.col("cagr_nocash"))


def regime_matrix(trades: DataFrame, least: int = C.LEAST_TRADES) -> DataFrame:
    """Trades by signal, holding and regime of the entry; every cell is kept, and trades outside of all regimes are ``none``. The win rate is a fraction."""
    t = trades.withColumns({"regime": F.coalesce(regime_of(F.col("entry_date")), F.lit("none")), "near": near_boundary(F.col("entry_date"))})
    r = F.col("return_pct")
    cells = t.groupBy("signal_id", "holding_days", "regime").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_samp(r).alias("sd"), F.avg((r > 0).cast("double")).alias("win_rate"), F.count_if("near").alias("n_boundary"))
    regimes = F.explode(F.array(*[F.lit(x.key) for x in C.REGIMES]))
    every = trades.select("signal_id", "holding_days").distinct().withColumn("regime", regimes).unionByName(cells.where("regime = 'none'").select("signal_id", "holding_days", "regime"))
    return every.join(cells, ["signal_id", "holding_days", "regime"], "left").na.fill(0, ["n", "n_boundary"]).withColumn("sufficient", F.col("n") >= least)
