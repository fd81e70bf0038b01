"""Fixed-holding trades without overlap, rates, and daily returns of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.blocks import DAYS, Prefix, prefixes, spaced
from tidemark.functions.windows import previous
from tidemark.operators.audit import ensure, unique_on

RUN = ("signal_id", "ticker", "holding_days")


def aligned_rates(prices: DataFrame, rates: DataFrame, missing: str = "ffill", days: int = DAYS) -> DataFrame:
    """date, rate_raw and risk_free (simple daily) on the price calendar.

    Rates on other dates are left out before anything is filled, so they never carry forward.
    ``ffill`` takes the last rate on an earlier price date; ``zero`` takes none.
    """
    fill = C.choose(missing, ("ffill", "zero"), "missing") == "ffill"
    daily = F.col("rate") / 100 / C.TRADING_DAYS
    # by ticker, so that calendars of several tickers are filled apart
    on = prices.select("ticker", "date").join(rates.select("date", daily.alias("rate_raw")), "date", "left")
    filled = prefixes(on, {"risk_free": Prefix("last", F.col("rate_raw"))}, days=days) if fill else on.withColumn("risk_free", F.coalesce("rate_raw", F.lit(0.0)))
    return filled.select("ticker", "date", "rate_raw", "risk_free")


def rate_summary(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("ticker").agg(F.count("*").alias("days"), F.count_if(F.col("rate_raw").isNull()).alias("missing_before"), F.count_if(F.col("risk_free").isNull()).alias("missing_after"), F.count_if(F.col("risk_free") < 0).alias("negative_days"))


def rate_range(aligned: DataFrame) -> DataFrame:
    """By ticker: lowest and highest annual rate in percent, first and last date with one, and the dates on which it is below zero, joined by commas."""
    rate, there = F.col("rate_raw") * C.TRADING_DAYS * 100, F.when(F.col("rate_raw").isNotNull(), F.col("date"))
    below = F.array_sort(F.collect_list(F.when(rate < 0, F.col("date").cast("string"))))  # as many as a calendar has days
    return aligned.groupBy("ticker").agg(F.min(rate).alias("lowest"), F.max(rate).alias("highest"), F.min(there).alias("first"), F.max(there).alias("last"), F.count_if(rate < 0).alias("n_negative"), F.array_join(below, ",").alias("negative_days"))


def trade_positions(rows: DataFrame, horizons: tuple[int, ...] = C.HORIZONS) -> DataFrame:
    """signal_id, ticker, holding_days, entry_pos and exit_pos of each run's trades.

    A signal at t enters at t + 1 and exits h later; signals before the exit are passed over, one on
    the exit day may enter again; a trade that the data end cuts off is left out. ``rows`` has
    signal_id, ticker, pos and signal for every day. A run's signals are dealt over tasks by blocks of positions.
    """
    ends = rows.groupBy("signal_id", "ticker").agg(F.max("pos").alias("_last"))
    hits = rows.where("signal").select("signal_id", "ticker", F.col("pos").cast("long").alias("pos"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("holding_days"))
    whole = hits.join(ends, ["signal_id", "ticker"]).where(F.col("pos") + 1 + F.col("holding_days") <= F.col("_last"))
    taken = spaced(whole.select(*RUN, "pos", (F.col("holding_days") + 1).alias("gap")), RUN)
    return taken.select(*RUN, (F.col("pos") + 1).alias("entry_pos"), (F.col("pos") + 1 + F.col("holding_days")).alias("exit_pos"))


def trade_log(positions: DataFrame, prices: DataFrame, cost: float = C.COST, capital: float = C.CAPITAL) -> DataFrame:
    """Trades at a fixed notional; prices stay raw and costs are in pnl and return_pct. ``prices`` has ticker, pos, date, close."""
    at = lambda side: prices.select("ticker", F.col("pos").alias(f"{side}_pos"), F.col("date").alias(f"{side}_date"), F.col("close").alias(f"{side}_price"))
    prices = unique_on(prices, "ticker", "pos")
    t = positions.join(at("entry"), ["ticker", "entry_pos"]).join(at("exit"), ["ticker", "exit_pos"])
    paid, got = F.col("entry_price") * (1 + cost), F.col("exit_price") * (1 - cost)
    size = capital / paid
    return t.select("signal_id", "ticker", "holding_days", "entry_date", "exit_date", "entry_price", "exit_price", size.alias("size"), (size * (got - paid)).alias("pnl"), ((got / paid - 1) * 100).alias("return_pct"), F.lit("time_stop").alias("exit_reason"))


def run_record(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """By run: signals, trades, and trades that overlap the one before, don't last as long as they should, or follow no signal; and whether none of these is there."""
    by = Window.partitionBy(*RUN).orderBy("entry_pos")
    hits = unique_on(rows.where("signal").select("signal_id", "ticker", (F.col("pos") + 1).alias("entry_pos")), "signal_id", "ticker", "entry_pos").withColumn("_hit", F.lit(True))
    t = positions.withColumn("_before", F.lag("exit_pos").over(by)).join(hits, ["signal_id", "ticker", "entry_pos"], "left")
    found = t.groupBy(*RUN).agg(
        F.count("*").alias("trades"), F.count_if(F.col("entry_pos") <= F.col("_before")).alias("overlapping"), F.count_if(F.col("exit_pos") - F.col("entry_pos") != F.col("holding_days")).alias("wrong_length"), F.count_if(F.col("_hit").isNull()).alias("unsignalled"),
    )
    signals = hits.groupBy("signal_id", "ticker").agg(F.count("*").alias("signals"))
    out = found.join(signals, ["signal_id", "ticker"], "left")
    return out.withColumn("verified", (F.col("overlapping") == 0) & (F.col("wrong_length") == 0) & (F.col("unsignalled") == 0))


def verified_trades(positions: DataFrame) -> DataFrame:
    """``positions``, which fail if a trade enters before the one before it has left, or lasts other than it should."""
    before = F.lag("exit_pos").over(Window.partitionBy(*RUN).orderBy("entry_pos"))
    t = positions.withColumn("_before", F.coalesce(before, F.lit(-1)))
    return ensure(t, (F.col("entry_pos") > F.col("_before")) & (F.col("exit_pos") - F.col("entry_pos") == F.col("holding_days")), "not a trade of this run:", *RUN, "entry_pos", "exit_pos").drop("_before")


def position_returns(positions: DataFrame, prices: DataFrame, cost: float = C.COST) -> DataFrame:
    """Daily return of the position on each day of a trade: the cost on the entry day, price moves after it, the cost again on the exit day."""
    moved = prices.select("ticker", "pos", (F.col("close") / previous(F.col("close")) - 1).alias("move"))
    days = positions.select("signal_id", "ticker", "holding_days", "entry_pos", "exit_pos", F.explode(F.sequence("entry_pos", "exit_pos")).alias("pos"))
    r = F.when(F.col("pos") == F.col("entry_pos"), F.lit(-cost)).when(F.col("pos") == F.col("exit_pos"), (1 + F.col("move")) * (1 - cost) - 1).otherwise(F.col("move"))
    # a trade may enter on the day another exits: both returns compound
    return days.join(moved, ["ticker", "pos"]).groupBy("signal_id", "ticker", "holding_days", "pos").agg((F.product(1 + r) - 1).alias("position_return"), F.max((F.col("pos") > F.col("entry_pos")).cast("int")).alias("exposed"))


def equity_curve(positions: DataFrame, prices: DataFrame, rates: DataFrame, cash: str = "risk_free", capital: float = C.CAPITAL, block: int = DAYS) -> DataFrame:
    """date, position_return (null when flat), risk_free, equity and in_position for every run and day.

    Flat days earn the risk-free rate or nothing; a day without a rate earns nothing.
    """
    idle = F.coalesce("risk_free", F.lit(0.0)) if C.choose(cash, ("risk_free", "zero"), "cash") == "risk_free" else F.lit(0.0)
    runs = positions.select("signal_id", "ticker", "holding_days").distinct()
    days = runs.join(prices.select("ticker", "pos", "date"), "ticker").join(rates.select("ticker", "date", "risk_free"), ["ticker", "date"], "left")
    d = days.join(position_returns(positions, prices), ["signal_id", "ticker", "holding_days", "pos"], "left")
    grown = prefixes(d, {"_growth": Prefix("product", 1 + F.coalesce("position_return", idle))}, RUN, days=block)
    return grown.select("signal_id", "ticker", "holding_days", "date", "position_return", "risk_free", (F.col("_growth") * capital).alias("equity"), F.coalesce(F.col("exposed") == 1, F.lit(False)).alias("in_position"))


def benchmark_curves(prices: DataFrame, rates: DataFrame, capital: float = C.CAPITAL, days: int = DAYS) -> DataFrame:
    """Buy-and-hold by ticker, and cash at the risk-free rate; both carry the rate."""
    rated = prices.join(unique_on(rates.select("ticker", "date", "risk_free"), "ticker", "date"), ["ticker", "date"], "left")
    p = ensure(rated, F.col("close").isNotNull(), "no close of the benchmark:", "ticker", "date")
    sums = prefixes(p, {"_first": Prefix("first", F.col("close")), "_cash": Prefix("product", 1 + F.coalesce("risk_free", F.lit(0.0)))}, days=days)
    both = sums.withColumns({"hold": F.col("close") / F.col("_first") * capital, "cash": F.col("_cash") * capital})
    rows = F.explode(F.array(F.struct(F.lit("hold").alias("signal_id"), F.col("hold").alias("equity")), F.struct(F.lit("cash").alias("signal_id"), F.col("cash").alias("equity"))))
    return both.select("ticker", "date", "risk_free", rows.alias("r")).select("r.signal_id", "ticker", F.lit(0).alias("holding_days"), "date", "risk_free", "r.equity")


def numbered(bars: DataFrame, start=C.START, days: int = DAYS) -> DataFrame:
    """Prices from ``start`` on with their place in the series."""
    kept = bars.where(F.col("date") >= F.lit(start)).select("ticker", "date", "close")
    return prefixes(kept, {"pos": Prefix("sum", F.lit(1).cast("long"))}, days=days).withColumn("pos", F.col("pos") - 1)
