"""Event study: what follows signals, against all days of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.quantiles import exact_quantiles, matched
from tidemark.functions.tables import once
from tidemark.functions.windows import by_date, log_return, position
from tidemark.operators.audit import unique_on
from tidemark.operators.regimes import regime_of
from tidemark.operators.signals import by_horizon, forward_returns, make_signals


def by_signal() -> WindowSpec:
    return Window.partitionBy("signal_id", "ticker").orderBy("date")


def frames(indicators: DataFrame, ticker: str | None = C.SIGNAL_TICKER) -> tuple[DataFrame, DataFrame]:
    """(signal rows, calendar), both with forward returns and ``pos``, from the analysis start on.

    Windows see the whole collection; the start cuts their results.
    """
    fwd = forward_returns(indicators).withColumn("pos", position()).select("date", "ticker", "close", "pos", "entry_price", *[f"fwd_ret_{h}" for h in C.HORIZONS])
    kept = F.col("date") >= F.lit(C.START)
    if ticker is not None:
        kept &= F.col("ticker") == ticker
    rows = make_signals(indicators).join(unique_on(fwd, "date", "ticker"), ["date", "ticker"], "left")  # so it keeps the number of signal rows
    return rows.where(kept), fwd.where(kept)


def signal_counts(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("signal_id").agg(F.count("*").alias("days"), F.count_if("condition").alias("level_days"), F.count_if("signal").alias("events"))
    return out.withColumns({"level_pct": F.try_divide(F.col("level_days") * 100.0, F.col("days")), "mean_duration": F.try_divide(F.col("level_days").cast("double"), F.col("events"))})


def run_lengths(rows: DataFrame) -> DataFrame:
    """Lengths of unbroken level conditions."""
    runs = once(rows.withColumn("run", F.sum(F.col("signal").cast("int")).over(by_signal())).where("condition").groupBy("signal_id", "ticker", "run").count())
    out = runs.groupBy("signal_id").agg(F.count("*").alias("n"), F.avg("count").alias("mean"), F.max("count").alias("longest"))
    return matched(out, exact_quantiles(runs, ["signal_id"], "count", {"median": 0.5, "p90": 0.9}), ["signal_id"])


def contingency(rows: DataFrame) -> DataFrame:
    """Events by signal and regime; absent cells are zero."""
    events = rows.where("signal").withColumn("regime", regime_of(F.col("date")))
    return events.groupBy("signal_id").pivot("regime", [r.key for r in C.REGIMES]).count().na.fill(0)


def baseline(calendar: DataFrame) -> DataFrame:
    """n, mean and standard deviation of each horizon's return over all days."""
    return by_horizon(calendar, []).groupBy("h").agg(F.count("ret").alias("n_all"), F.avg("ret").alias("mean_all"), F.stddev_samp("ret").alias("sd_all"))


def event_study(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    r = F.col("ret")
    hits = once(by_horizon(rows.where("signal"), ["signal_id"]))
    sums = hits.groupBy("signal_id", "h").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), (F.avg((r > 0).cast("double")) * 100).alias("win_pct"))
    events = matched(sums, exact_quantiles(hits, ["signal_id", "h"], "ret", {"median": 0.5}), ["signal_id", "h"], "left")
    return events.join(baseline(calendar), "h").withColumn("difference", F.col("mean") - F.col("mean_all"))


def variance_diagnostic(study: DataFrame) -> DataFrame:
    """t with the calendar's deviation and with the events' own, and how far these differ."""
    root, ratio = F.sqrt(F.col("n").cast("double")), F.try_divide("sd", "sd_all")
    kind = F.when(ratio > 1.5, "high").when(ratio >= 1.2, "raised").otherwise("normal")
    return study.select("signal_id", "h", "n", ratio.alias("sd_ratio"), F.try_divide(F.col("difference"), F.col("sd_all") / root).alias("t_naive"), F.try_divide(F.col("difference"), F.col("sd") / root).alias("t_adj"), F.when(ratio.isNotNull(), kind).alias("variance_class"))


def overlap(rows: DataFrame) -> DataFrame:
    """Trading days between events of a signal, and the horizons longer than their median."""
    gap = F.col("pos") - F.lag("pos").over(by_signal())
    out = rows.where("signal").withColumn("gap", gap).groupBy("signal_id").agg(F.count("*").alias("events"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.avg("gap").alias("mean_gap"))
    severe = F.filter(F.array(*[F.lit(h) for h in C.HORIZONS]), lambda h: F.col("median_gap") < h)
    return out.withColumn("severe", F.concat_ws(";", severe.cast("array<string>")))


def regime_diagnostic(rows: DataFrame, h: int = 20) -> DataFrame:
    """Event rates and returns by signal and regime; every combination is kept."""
    tagged = rows.withColumn("regime", regime_of(F.col("date"))).where("regime IS NOT NULL")
    ret, hit = F.col(f"fwd_ret_{h}"), F.col("signal")
    cells = tagged.groupBy("signal_id", "regime").agg(F.count("*").alias("days"), F.count_if(hit).alias("events"), F.avg(F.when(hit, ret)).alias("mean_signal"), F.avg(ret).alias("mean_all"))
    every = Window.partitionBy("signal_id")
    rate, whole = F.try_divide(F.col("events").cast("double"), F.col("days")), F.try_divide(F.sum("events").over(every).cast("double"), F.sum("days").over(every))
    return cells.select(
        "signal_id", "regime", "days", "events", rate.alias("rate"), F.try_divide(rate, whole).alias("rate_ratio"), F.try_divide(F.col("events").cast("double"), F.sum("events").over(every)).alias("share_signal"),
        F.try_divide(F.col("days").cast("double"), F.sum("days").over(every)).alias("share_days"), "mean_signal", "mean_all",
    )


def event_path(rows: DataFrame, calendar: DataFrame, around: int = 5) -> DataFrame:
    """Mean price at each offset from an event relative to the event's close; offsets outside the data are left out."""
    at = F.explode(F.sequence(F.lit(-around), F.lit(around)))
    events = rows.where("signal").select("signal_id", "ticker", F.col("close").alias("base"), "pos", at.alias("tau")).withColumn("pos", F.col("pos") + F.col("tau"))
    met = events.join(calendar.select("ticker", "pos", F.col("close").alias("there")), ["ticker", "pos"])
    return met.groupBy("signal_id", "tau").agg(F.count("*").alias("n"), (F.avg(F.col("there") / F.col("base")) - 1).alias("mean_change"))


def without_worst(rows: DataFrame, h: int = 20, k: int = 3) -> DataFrame:
    """Means with and without the dates of each signal's ``k`` worst events."""
    ret = F.col(f"fwd_ret_{h}")
    order = F.row_number().over(Window.partitionBy("signal_id").orderBy(ret, "date"))
    e = rows.where(F.col("signal") & ret.isNotNull()).withColumn("nth", order)
    return e.groupBy("signal_id").agg(F.count("*").alias("n"), F.avg(ret).alias("mean_full"), F.count_if(F.col("nth") > k).alias("n_kept"), F.avg(F.when(F.col("nth") > k, ret)).alias("mean_kept"))


def without_dates(rows: DataFrame, calendar: DataFrame, dates: DataFrame, h: int = 20) -> DataFrame:
    """Each signal's mean, deviation and t with and without its events on given ``dates`` (date), against all days of the calendar."""
    ret = F.col(f"fwd_ret_{h}")
    listed = dates.select("date").distinct().withColumn("_out", F.lit(True))
    e = rows.where(F.col("signal") & ret.isNotNull()).join(listed, "date", "left").withColumn("_kept", F.col("_out").isNull())
    kept = F.when(F.col("_kept"), ret)
    sums = e.groupBy("signal_id").agg(F.count("*").alias("n_full"), F.count(kept).alias("n_kept"), F.avg(ret).alias("mean_full"), F.avg(kept).alias("mean_kept"), F.stddev_samp(ret).alias("sd_full"), F.stddev_samp(kept).alias("sd_kept"))
    pool = calendar.agg(F.avg(ret).alias("mean_pool"), F.stddev_samp(ret).alias("sd_pool"))  # one row
    t = lambda side: F.try_divide(F.col(f"mean_{side}") - F.col("mean_pool"), F.col(f"sd_{side}") / F.sqrt(F.col(f"n_{side}").cast("double")))
    return sums.join(F.broadcast(pool)).withColumns({f"sd_ratio_{x}": F.try_divide(f"sd_{x}", "sd_pool") for x in ("full", "kept")} | {f"t_adj_{x}": t(x) for x in ("full", "kept")})


def with_p(diagnostic: DataFrame, tested: DataFrame) -> DataFrame:
    """A variance diagnostic with the permutation test's ``p`` (signal_id, h, p) of each row, null where none was made; a p given twice is an error."""
    p = unique_on(tested.select("signal_id", "h", F.col("p").alias("p_perm")), "signal_id", "h")
    return diagnostic.join(p, ["signal_id", "h"], "left")


def concentration(rows: DataFrame, calendar: DataFrame, h: int = 20, k: int = 5) -> DataFrame:
    """Share of the ``k`` worst events in all losses, and in the deviation from the calendar's mean."""
    ret = F.col(f"fwd_ret_{h}")
    mean = calendar.agg(F.avg(ret).alias("mu"))  # one row
    e = rows.where(F.col("signal") & ret.isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("signal_id").orderBy(ret, "date"))).join(F.broadcast(mean))
    worst = F.col("nth") <= k
    return e.groupBy("signal_id").agg(
        F.count("*").alias("n"), F.try_divide(F.sum(F.when(worst, ret)), F.sum(F.when(ret < 0, ret))).alias("share_of_losses"), F.try_divide(F.sum(F.when(worst, ret - F.col("mu"))), F.sum(ret - F.col("mu"))).alias("share_of_deviation")
    )


def variance_ratio(calendar: DataFrame, h: int = 20) -> DataFrame:
    """Variance of h-day over h times that of one-day log returns by ticker, with plain and robust standard errors.

    The robust error sums products of squared deviations over all lags under h.
    """
    whole = Window.partitionBy("ticker")
    r = calendar.withColumns({"r": log_return(F.col("close")), "rh": log_return(F.col("close"), h)})
    r = r.withColumn("d2", F.pow(F.col("r") - F.avg("r").over(whole), 2))
    lagged = {f"l{j}": F.col("d2") * F.lag("d2", j).over(by_date()) for j in range(1, h)}
    n = F.col("n")
    sums = r.withColumns(lagged).groupBy("ticker").agg(F.count("r").alias("n"), F.var_samp("r").alias("v1"), F.var_samp("rh").alias("vh"), F.sum("d2").alias("s2"), *[F.sum(c).alias(c) for c in lagged])
    theta = sum(((2.0 * (h - j) / h) ** 2 * F.col(f"l{j}") for j in range(1, h)), F.lit(0.0)) * n / (F.col("s2") * F.col("s2"))
    out = sums.select("ticker", "n", F.try_divide("vh", h * F.col("v1")).alias("vr"), F.sqrt(2.0 * (2 * h - 1) * (h - 1) / (3.0 * h * n)).alias("se_iid"), theta.alias("theta"), (n / float(h)).alias("effective_n"))
    out = out.withColumn("se_robust", F.sqrt(F.col("theta") / n))
    return out.withColumns({"z_iid": F.try_divide(F.col("vr") - 1, F.col("se_iid")), "z_robust": F.try_divide(F.col("vr") - 1, F.col("se_robust"))})
