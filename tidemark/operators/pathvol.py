"""Volatility before and after signals, in strata of earlier volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.blocks import spaced
from tidemark.functions.quantiles import exact_quantiles, matched
from tidemark.functions.ranks import expanding_bins
from tidemark.functions.tables import once
from tidemark.functions.windows import framed, log_return, position, rolling
from tidemark.operators.audit import ensure, positive, unique_on
from tidemark.operators.resample import combined, stratum_sums

BINS = 5
#: Least ratio over all days at which a verdict is given, and the shares of its excess that part the verdicts.
FLOOR, NONE_SHARE, EXISTS_SHARE = 1.15, 0.22, 0.44
#: Percent by which signals' earlier volatility may exceed that of their bin's other days.
UNEVEN_GAP = 20.0


def volatility_frame(bars: DataFrame, signals: DataFrame, signal_id: str, bins: int = BINS, least: int = C.LEAST_HISTORY) -> DataFrame:
    """date, ticker, pos, pre_vol, post_vol, post_vol_1, stratum, is_signal and fwd returns over all days.

    ``post_vol`` covers the returns two to 21 days ahead, ``post_vol_1`` one to 20. Strata are bins of
    ``pre_vol`` by quantiles of strictly earlier days of the whole collection.
    """
    r = bars.select("date", "ticker", "close").withColumns({"pos": position(), "lr": log_return(F.col("close"))})
    n, k = C.POST_WINDOW, C.POST_OFFSET
    r = r.withColumns(
        {
            "pre_vol": rolling(F.stddev_samp, F.col("lr"), C.PRE_WINDOW), "post_vol": framed(F.stddev_samp, F.col("lr"), k, k + n - 1), "post_vol_1": framed(F.stddev_samp, F.col("lr"), 1, n),
        }
    )
    r = expanding_bins(r, "pre_vol", "stratum", bins, least)
    mine = unique_on(signals.where(F.col("signal_id") == signal_id).select("date", "ticker", "signal"), "date", "ticker")
    return r.join(mine, ["date", "ticker"], "left").withColumn("is_signal", F.coalesce("signal", F.lit(False))).drop("signal")


def analysis(frame: DataFrame, truncation: str = "d8b", strict: bool = True) -> DataFrame:
    """Days from the analysis start on with a stratum and volatilities above zero, and their logs.

    ``d8b`` keeps the days that have ``post_vol``; ``own`` those that have ``post_vol_1``. A volatility at or below zero
    is an error; without ``strict`` it is left out.
    """
    mask = "post_vol" if C.choose(truncation, ("d8b", "own"), "truncation") == "d8b" else "post_vol_1"
    there = frame.where((F.col("date") >= F.lit(C.START)) & F.col("stratum").isNotNull() & F.col(mask).isNotNull())
    kept = positive(there, "pre_vol", "post_vol_1") if strict else there.where((F.col("pre_vol") > 0) & (F.col("post_vol_1") > 0))
    return kept.withColumns({"log_pre_vol": F.ln("pre_vol"), "log_vol_post": F.ln("post_vol_1")})


def path_ratio(frame: DataFrame, bins: int = BINS) -> DataFrame:
    """Mean later volatility of signal and other days, and their ratio: bin 0 for all rows, then every bin, empty ones too."""
    s, post, pre = F.col("is_signal"), F.col("post_vol"), F.col("pre_vol")
    usable = frame.where("post_vol IS NOT NULL AND pre_vol IS NOT NULL AND stratum IS NOT NULL").where(F.col("date") >= F.lit(C.START))
    both = usable.withColumn("bin", F.explode(F.array(F.lit(0), F.col("stratum"))))
    cells = both.groupBy("bin").agg(
        F.count_if(s).alias("n_signal"), F.count_if(~s).alias("n_other"), F.avg(F.when(s, post)).alias("post_signal"), F.avg(F.when(~s, post)).alias("post_other"), F.avg(F.when(s, pre)).alias("pre_signal"), F.avg(F.when(~s, pre)).alias("pre_other")
    )
    every = frame.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = every.join(cells, "bin", "left").na.fill(0, ["n_signal", "n_other"])
    return out.select("bin", "n_signal", "n_other", "post_signal", "post_other", F.try_divide("post_signal", "post_other").alias("ratio"), ((F.try_divide("pre_signal", "pre_other") - 1) * 100).alias("pre_gap_pct")).withColumns({
        "stratification": F.when(F.col("bin") == 0, None).when(F.col("pre_gap_pct").isNull(), "no sample").when(F.col("pre_gap_pct") >= UNEVEN_GAP, "incomplete").otherwise("good"), "in_mean": F.when(F.col("bin") > 0, F.col("n_signal") >= C.LEAST_SIGNALS),
    })


def weighted_ratio(ratios: DataFrame) -> DataFrame:
    """The ratio over bins with enough signals, weighted by signals; the bins left out; and the verdict."""
    usable = (F.col("n_signal") >= C.LEAST_SIGNALS) & F.col("ratio").isNotNull()
    inner = F.col("bin") > 0
    n = F.col("n_signal")
    out = ratios.agg(
        F.max(F.when(F.col("bin") == 0, F.col("ratio"))).alias("r0"), F.try_divide(F.sum(F.when(inner & usable, n * F.col("ratio"))), F.sum(F.when(inner & usable, n))).alias("weighted"),
        F.coalesce(F.sum(F.when(inner & usable, n)), F.lit(0)).alias("n_used"), F.concat_ws(";", F.array_sort(F.collect_list(F.when(inner & ~usable, F.col("bin").cast("string"))))).alias("excluded"),
    )
    low, high = 1 + NONE_SHARE * (F.col("r0") - 1), 1 + EXISTS_SHARE * (F.col("r0") - 1)
    verdict = F.when(F.col("r0").isNull() | (F.col("r0") < FLOOR) | F.col("weighted").isNull(), "not_performed").when(F.col("weighted") <= low, "none").when(F.col("weighted") > high, "exists").otherwise("unclear")
    return out.withColumn("verdict", verdict)


def stratum_returns(rows: DataFrame) -> DataFrame:
    """Forward returns (``ret``) of signals and of the pool by stratum, and each stratum's part of the weighted difference."""
    s, r = F.col("is_signal"), F.col("ret")
    t = rows.where("ret IS NOT NULL AND stratum IS NOT NULL").groupBy("stratum").agg(F.count_if(s).alias("n_signal"), F.count_if(~s).alias("n_pool"), (F.avg(F.when(s, r)) * 100).alias("signal_pct"), (F.avg(F.when(~s, r)) * 100).alias("pool_pct"))
    t = t.withColumns({"difference": F.col("signal_pct") - F.col("pool_pct"), "included": F.col("n_signal") >= C.LEAST_SIGNALS})
    part = F.when(F.col("included"), F.col("n_signal") * F.col("difference"))
    return t.withColumn("contribution", F.try_divide(part, F.sum(part).over(Window.partitionBy())))


def welch_table(frame: DataFrame, y: str = "log_vol_post") -> DataFrame:
    """Log means, their difference, its exponent and Welch error by stratum, and weights of the strata that count."""
    pre = F.avg(F.when(F.col("is_signal"), F.col("log_pre_vol"))) - F.avg(F.when(~F.col("is_signal"), F.col("log_pre_vol")))
    t = frame.groupBy("stratum").agg(*stratum_sums([], "is_signal", y), pre.alias("pre_gap"))
    t = t.withColumns({"delta": F.col("m_sig") - F.col("m_ctl"), "se": F.sqrt(F.try_divide("v_sig", F.col("n_sig")) + F.try_divide("v_ctl", F.col("n_ctl"))), "included": (F.col("n_sig") >= C.LEAST_SIGNALS) & (F.col("n_ctl") >= C.LEAST_CONTROLS)})
    n = F.when(F.col("included"), F.col("n_sig"))
    return t.withColumns({"exp_delta": F.exp("delta"), "weight": F.try_divide(n.cast("double"), F.sum(n).over(Window.partitionBy()))})


def gap_ratio(frame: DataFrame, within: int = C.POST_WINDOW, bins: int = BINS) -> DataFrame:
    """Share of gaps under ``within`` days between neighbours of a group and stratum; empty cells are kept."""
    group = F.when(F.col("is_signal"), "signal").otherwise("control")
    g = frame.withColumn("grp", group)
    g = g.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("ticker", "grp", "stratum").orderBy("pos")))
    g, by = once(g.select("grp", "stratum", "gap")), ["grp", "stratum"]
    sums = g.groupBy(*by).agg(F.count("*").alias("n"), F.count("gap").alias("n_gap"), F.count_if(F.col("gap") < within).alias("n_close"))
    cells = matched(sums, exact_quantiles(g, by, "gap", {"median_gap": 0.5}), by, "left")
    every = frame.sparkSession.range(2 * bins).select(F.when(F.col("id") < bins, "signal").otherwise("control").alias("grp"), (F.col("id") % bins + 1).cast("int").alias("stratum"))
    out = every.join(cells, ["grp", "stratum"], "left").na.fill(0, ["n", "n_gap", "n_close"])
    return out.withColumn("overlap", F.try_divide(F.col("n_close").cast("double"), F.col("n_gap")))


def thin(positions: DataFrame, by: list[str], least: int) -> DataFrame:
    """Greedy thinning of ``pos`` by group: keep the first, then each one ``least`` or more after the last kept."""
    return spaced(positions.select(*by, F.col("pos").cast("long").alias("pos"), F.lit(least).alias("gap")), tuple(by)).drop("gap")


def away_from(positions: DataFrame, anchors: DataFrame, by: list[str], least: int) -> DataFrame:
    """``positions`` that have no anchor nearer than ``least``: the nearest ones come by window, not by a theta join."""
    both = positions.select(*by, "pos", F.lit(None).cast("long").alias("anchor")).unionByName(anchors.select(*by, "pos", F.col("pos").alias("anchor")))
    back = Window.partitionBy(*by).orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("pos").rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumns({"_b": F.max("anchor").over(back), "_a": F.min("anchor").over(ahead)}).where("anchor IS NULL")
    far = (F.col("_b").isNull() | (F.col("pos") - F.col("_b") >= least)) & (F.col("_a").isNull() | (F.col("_a") - F.col("pos") >= least))
    return near.where(far).select(*by, "pos")


def decluster(frame: DataFrame, least: int = C.POST_WINDOW) -> DataFrame:
    """Rows of ``frame`` after thinning signals, dropping controls near the kept ones, and thinning the rest."""
    frame = once(frame)
    kept = thin(frame.where("is_signal").select("ticker", "pos"), ["ticker"], least)
    kept = once(kept)
    controls = thin(away_from(frame.where(~F.col("is_signal")).select("ticker", "pos"), kept, ["ticker"], least), ["ticker"], least)
    wanted = kept.withColumn("is_signal", F.lit(True)).unionByName(controls.withColumn("is_signal", F.lit(False)))
    return frame.join(wanted, ["ticker", "pos", "is_signal"], "left_semi")


def counts(frame: DataFrame, thinned: DataFrame) -> DataFrame:
    """Signals and controls by stratum before and after thinning, with a total row (stratum null)."""
    both = frame.select("stratum", "is_signal", F.lit(0).alias("after")).unionByName(thinned.select("stratum", "is_signal", F.lit(1).alias("after")))
    # a row of no stratum and no kind, so that there is a total even if no other row is
    both = both.unionByName(frame.sparkSession.createDataFrame([(None, None, None)], "stratum int, is_signal boolean, after int"))
    n = lambda sig, after: F.count_if((F.col("is_signal") == sig) & (F.col("after") == after))
    sums = [n(True, 0).alias("signals"), n(False, 0).alias("controls"), n(True, 1).alias("signals_thinned"), n(False, 1).alias("controls_thinned")]
    return both.rollup("stratum").agg(F.grouping_id().alias("_total"), *sums).where("_total = 1 OR stratum IS NOT NULL").drop("_total")


def gap_distribution(frame: DataFrame) -> DataFrame:
    """Gaps between neighbouring signals of a stratum: quartiles, ends, and how many are under 1, 5, 10 and 20 days."""
    g = frame.where("is_signal").withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("ticker", "stratum").orderBy("pos")))
    under = [F.count_if(F.col("gap") < k).alias(f"under_{k}") for k in (1, 5, 10, 20)]
    g = once(g.select("stratum", "gap"))
    out = g.groupBy("stratum").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), *under)
    return matched(out, exact_quantiles(g, ["stratum"], "gap", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), ["stratum"], "left")


def stratum_gaps(rows: DataFrame, least: int = C.LEAST_SIGNALS) -> DataFrame:
    """Median gap between neighbouring signals with a return, by stratum that has ``least`` of them. ``rows`` has ticker, pos, stratum, is_signal and ret."""
    g = rows.where("is_signal AND ret IS NOT NULL AND stratum IS NOT NULL").withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("ticker", "stratum").orderBy("pos")))
    g = once(g.select("stratum", "gap"))
    sums = g.groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return matched(sums, exact_quantiles(g, ["stratum"], "gap", {"median_gap": 0.5}), ["stratum"], "left")


# Limits of the diagnostics.
DOMINANT, OPPOSITE, OVERLAPS, PRE_GAP, P_RATIO, FEW_SIGNALS, FEW_EXTREMES = 0.50, 0.25, 0.20, 0.10, 3.0, 40, 10


def difference_summary(table: DataFrame) -> DataFrame:
    """The weighted difference of a ``welch_table``, its exponent, error and t, and the same weights' difference before the signal."""
    w, kept = F.col("weight"), table.where("included")
    out = kept.agg(F.sum("n_sig").alias("n_signal"), F.sum(w * F.col("delta")).alias("delta"), F.sqrt(F.sum(w * w * F.col("se") * F.col("se"))).alias("se"), F.sum(w * F.col("pre_gap")).alias("delta_pre"))
    return out.withColumns({"t": F.try_divide("delta", "se"), "exp_delta": F.exp("delta")})


def two_routes(frame: DataFrame, y: str = "log_vol_post", within: float = 1e-12) -> DataFrame:
    """The weighted difference and its error by the table of strata and by their sums, and whether both routes agree."""
    one = difference_summary(welch_table(frame, y)).select("delta", "se")
    sums = frame.groupBy("stratum").agg(*stratum_sums([], "is_signal", y)).where((F.col("n_sig") >= C.LEAST_SIGNALS) & (F.col("n_ctl") >= C.LEAST_CONTROLS))
    two = combined(sums, []).select(F.col("delta").alias("delta_sums"), F.col("se").alias("se_sums"))
    return one.join(F.broadcast(two)).withColumn("agree", (F.abs(F.col("delta") - F.col("delta_sums")) <= within) & (F.abs(F.col("se") - F.col("se_sums")) <= within))


def structure_flags(table: DataFrame, gap_table: DataFrame) -> DataFrame:
    """Whether one stratum dominates, strata point the other way, signals overlap, groups differed before, or signals are few."""
    whole = difference_summary(table)
    kept = table.where("included").join(F.broadcast(whole.select(F.col("delta").alias("_all"))))
    w = F.col("weight")
    signs = kept.agg(F.max(w).alias("max_weight"), F.coalesce(F.sum(F.when(F.signum("delta") != F.signum("_all"), w)), F.lit(0.0)).alias("opposite_weight"))
    close = gap_table.where(F.col("grp") == "signal").join(table.where("included").select("stratum"), "stratum").where(F.col("overlap") >= OVERLAPS)
    named = close.agg(F.concat_ws(";", F.array_sort(F.collect_list(F.col("stratum").cast("string")))).alias("overlapping"))
    raw = table.agg(F.sum("n_sig").alias("n_raw"))
    one = signs.join(F.broadcast(named)).join(F.broadcast(whole.select("delta_pre"))).join(F.broadcast(raw))
    return one.withColumns({
        "dominance": F.col("max_weight") >= DOMINANT, "mixed_signs": F.col("opposite_weight") >= OPPOSITE, "overlap": F.col("overlapping") != "", "unequal_before": F.abs("delta_pre") >= PRE_GAP, "low_power": F.col("n_raw") < FEW_SIGNALS,
    })


def p_shift(tested: DataFrame, alpha: float = C.ALPHA) -> DataFrame:
    """Whether the raw and the studentized p of a label test lie on two sides of ``alpha`` or far apart."""
    far = F.abs(F.ln(F.col("p_stud") / F.col("p_raw")))
    return tested.select("p_raw", "p_stud", ((F.col("p_stud") < alpha) != (F.col("p_raw") < alpha)).alias("crossing"), far.alias("log_ratio")).withColumn("shifted", F.col("crossing") | (F.col("log_ratio") >= F.ln(F.lit(P_RATIO))))


def check_counts(found: DataFrame, expected: dict[int | None, tuple[int, int]]) -> DataFrame:
    """``found`` (stratum, signals, controls), which fails unless the numbers are those that a sample must have; a null stratum is the total, and one not there has none."""
    wanted = found.sparkSession.createDataFrame([(k, *v) for k, v in expected.items()], "_stratum int, _signals long, _controls long")
    both = found.join(F.broadcast(wanted), F.col("stratum").eqNullSafe(F.col("_stratum")), "full")  # a row a stratum
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    same = (n("signals") == n("_signals")) & (n("controls") == n("_controls"))
    shown = both.withColumns({"_name": F.coalesce("stratum", "_stratum")})
    checked = ensure(shown, same, "unexpected numbers of signals and controls:", "_name", "signals", "_signals", "controls", "_controls")
    return checked.where("signals is not null").select(found.columns)
