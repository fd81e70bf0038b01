"""Permutation tests. P-values are (1 + draws at least as extreme) / (1 + draws), two-sided.

A draw orders its pool by a hash of seed, iteration and key and takes the first n. That is the
same under any partitioning and in any engine. Blocks of iterations are spread over the tasks, so all
draws of all tests are one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.tables import once


#: Iterations of one block, which is one row of work.
BLOCK = 250


def draw_sums(pool: DataFrame, y: str, iterations: int, by: list[str], seed: int = C.SEED, key: str = "date") -> DataFrame:
    """Count, mean and variance of ``y`` over the drawn and the other rows of ``pool``, for each draw.

    ``pool`` has ``by``, key, y and ns: the numbers of rows to draw, an array that is the same in a whole group. One row
    for each of ``by``, n of ns and iteration: n_sig, m_sig, v_sig of the drawn, n_ctl, m_ctl, v_ctl of the rest.
    A group of the pool is one array, as long as a calendar has days; it goes to the tasks with a block of iterations each, so
    that no draw is shuffled, and all numbers of a group share the order of an iteration.
    """
    members = pool.select(*by, "ns", F.struct(F.col(key).cast("string").alias("k"), F.col(y).cast("double").alias("y")).alias("m"))
    groups = members.groupBy(*by).agg(F.first("ns").alias("ns"), F.sort_array(F.collect_list("m")).alias("pool"))
    blocks = -(-iterations // BLOCK)
    work = groups.select(*by, "ns", F.col("pool.k").alias("k"), F.col("pool.y").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(blocks)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*by).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.to_dict("records"):
                keys, values, out = [k.encode() for k in r["k"]], np.asarray(r["y"], dtype=float), []
                for i in range(r["block"] * BLOCK + 1, min((r["block"] + 1) * BLOCK, iterations) + 1):
                    start = md5(f"{seed}|{i}|".encode())
                    order = values[hashed_order(start, keys)]
                    out += [(n, i, *moments(order[:n]), *moments(order[n:])) for n in r["ns"]]
                found = pd.DataFrame(out, columns=["n", "iteration", "n_sig", "m_sig", "v_sig", "n_ctl", "m_ctl", "v_ctl"])
                for c in by:
                    found[c] = r[c]
                yield found

    schema = ", ".join([*kinds, "n long, iteration int, n_sig long, m_sig double, v_sig double, n_ctl long, m_ctl double, v_ctl double"])
    return work.mapInPandas(run, schema)


def hashed_order(start, keys: list[bytes]) -> np.ndarray:  # noqa: ANN001
    """Positions of ``keys`` by the MD5 of what ``start`` has seen and the key."""
    digests = []
    for k in keys:
        h = start.copy()
        h.update(k)
        digests.append(h.digest())
    high, low = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).T
    return np.lexsort((low, high))


def moments(x: np.ndarray) -> tuple[int, float, float]:
    """Count, mean and sample variance; exactly no variance for equal values, and NaN (null in the table) where it isn't defined."""
    if not len(x):
        return 0, np.nan, np.nan
    if len(x) == 1 or x.min() == x.max():
        return len(x), float(x[0]), 0.0 if len(x) > 1 else np.nan
    return len(x), float(x.mean()), float(x.var(ddof=1))


def p_value(extreme: Column, total: Column) -> Column:
    return (1.0 + extreme) / (1.0 + total)


def mc_interval(p: Column, b: int) -> dict[str, Column]:
    """Monte Carlo error of a p-value, its 95 % interval, cut at zero, how many errors it lies under the level of one of all tests, and whether the interval holds that level."""
    se, level = F.sqrt(p * (1.0 - p) / float(b)), C.ALPHA / C.TESTS
    low, high = F.greatest(p - 1.96 * se, F.lit(0.0)), p + 1.96 * se
    return {"mc_se": se, "ci_low": low, "ci_high": high, "distance": F.try_divide(level - p, se), "straddles": (low < level) & (high > level)}


def mean_test(events: DataFrame, pool: DataFrame, iterations: int, studentized: bool = False, seed: int = C.SEED) -> DataFrame:
    """Mean (or mean over its own error) of each signal's events against draws from all days.

    ``events`` has signal_id and ret, ``pool`` has date and ret. Draws without spread don't count.
    """
    ev = events.where("ret IS NOT NULL").groupBy("signal_id").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    usable = pool.where("ret IS NOT NULL").select("date", "ret")
    mu = usable.agg(F.avg("ret").alias("mu"))  # one row
    # all signals draw from one pool; the number of signals is the size of a registry
    rows = usable.join(F.broadcast(ev.agg(F.sort_array(F.collect_set("n")).alias("ns")))).withColumn("_one", F.lit(1))
    stat = draw_sums(rows, "ret", iterations, ["_one"], seed).select("n", F.col("m_sig").alias("m"), F.sqrt("v_sig").alias("s"))
    root = F.sqrt(F.col("n").cast("double"))
    scored = stat.join(F.broadcast(ev), "n").join(F.broadcast(mu))
    if studentized:
        scored = scored.where("s > 0").withColumns({"drawn_t": F.abs((F.col("m") - F.col("mu")) / (F.col("s") / root)), "seen_t": F.abs((F.col("mean") - F.col("mu")) / (F.col("sd") / root))})
    else:
        scored = scored.withColumns({"drawn_t": F.abs(F.col("m") - F.col("mu")), "seen_t": F.abs(F.col("mean") - F.col("mu"))})
    out = scored.groupBy("signal_id").agg(F.max("n").alias("n"), F.max("seen_t").alias("statistic"), F.count_if(F.col("drawn_t") >= F.col("seen_t")).alias("extreme"), F.count("*").alias("draws"))
    p = p_value(F.col("extreme"), F.col("draws"))
    return out.withColumns({"p": p, "passes": p < C.ALPHA / C.TESTS} | mc_interval(p, iterations))


def stratum_draws(rows: DataFrame, iterations: int, seed: int = C.SEED) -> tuple[DataFrame, DataFrame]:
    """By stratum: count and sums of the signals' returns, centred on the stratum's other days; and by stratum and iteration the count, mean and variance of as many drawn from these.

    A stratum's draws don't depend on which other strata are looked at, so they are made once for all tests.
    """
    kept = rows.where("ret IS NOT NULL AND stratum IS NOT NULL")
    per, sig = Window.partitionBy("stratum"), F.col("is_signal")
    c = once(kept.withColumns({"n_sig": F.count_if(sig).over(per), "mu": F.avg(F.when(~sig, F.col("ret"))).over(per)}).where("n_sig > 0").withColumn("e", F.col("ret") - F.col("mu")).select("date", "stratum", "is_signal", "n_sig", "e"))
    seen = c.where(sig & F.col("e").isNotNull()).groupBy("stratum").agg(F.count("*").alias("n_sig"), F.sum("e").alias("s1"), F.sum(F.col("e") * F.col("e")).alias("s2"))
    sums = draw_sums(c.where(~sig).withColumn("ns", F.array("n_sig")), "e", iterations, ["stratum"], seed)
    return once(seen), once(sums.select("stratum", "iteration", "n_sig", "m_sig", "v_sig"))


def student(n: Column, s1: Column, s2: Column) -> Column:
    """|mean / (deviation / sqrt(n))| from a count, a sum and a sum of squares."""
    spread = F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))
    return F.when(n > 1, F.abs(F.try_divide(s1 / n, spread / F.sqrt(n.cast("double")))))


def tested_strata(seen: DataFrame, sums: DataFrame, variants: DataFrame) -> DataFrame:
    """The studentized test for each of ``variants`` (variant, least, dropped): on the strata with ``least`` signals, without the dropped one. They are a few rows."""
    fits = lambda s: (F.col(f"{s}.n_sig") >= F.col("v.least")) & ~F.col(f"{s}.stratum").eqNullSafe(F.col("v.dropped"))
    v = F.broadcast(variants).alias("v")
    n, s1, s2 = F.sum("n_sig"), F.sum("s1"), F.sum("s2")
    whole = seen.alias("s").join(v, fits("s")).groupBy("variant").agg(n.alias("n"), (s1 / n).alias("mean_diff"), student(n, s1, s2).alias("statistic"))
    parts = sums.withColumns({"s1": F.col("n_sig") * F.col("m_sig"), "s2": (F.col("n_sig") - 1) * F.coalesce("v_sig", F.lit(0.0)) + F.col("n_sig") * F.col("m_sig") * F.col("m_sig")}).where("n_sig > 0")
    drawn = parts.alias("d").join(v, fits("d")).groupBy("variant", "iteration").agg(student(n, s1, s2).alias("drawn_t")).where("drawn_t IS NOT NULL")
    out = drawn.join(F.broadcast(whole), "variant").groupBy("variant").agg(
        F.max("n").alias("n"), F.max("mean_diff").alias("mean_diff"), F.max("statistic").alias("statistic"), F.count_if(F.col("drawn_t") >= F.col("statistic")).alias("extreme"), F.count("*").alias("draws")
    )
    every = variants.select("variant").join(out, "variant", "left").na.fill(0, ["extreme", "draws"])  # also where no stratum has enough signals
    return every.withColumn("p", p_value(F.col("extreme"), F.col("draws")))


VARIANT = "variant string, least int, dropped int"


def stratified_test(rows: DataFrame, iterations: int, seed: int = C.SEED, least: int = C.LEAST_SIGNALS, drop: int | None = None) -> DataFrame:
    """Studentized mean of signals, centred on the non-signal days of their stratum, against draws from these.

    ``rows`` has date, stratum, is_signal and ret. Strata with fewer than ``least`` signals are out;
    ``drop`` leaves one more out.
    """
    variants = rows.sparkSession.createDataFrame([("one", least, drop)], VARIANT)
    return tested_strata(*stratum_draws(rows, iterations, seed), variants).drop("variant")


def stratified_report(rows: DataFrame, iterations: int, seed: int = C.SEED, least: int = C.LEAST_SIGNALS) -> DataFrame:
    """The stratified test, its largest p without one stratum, its p with all strata, and whether few draws were extreme. All of them share the draws."""
    seen, sums = stratum_draws(rows, iterations, seed)
    fixed = rows.sparkSession.createDataFrame([("whole", least, None), ("every", 1, None)], VARIANT)
    out = seen.where(F.col("n_sig") >= least).select(F.concat(F.lit("without "), F.col("stratum").cast("string")).alias("variant"), F.lit(least).alias("least"), F.col("stratum").cast("int").alias("dropped"))
    found = once(tested_strata(seen, sums, fixed.unionByName(out)))
    rest = found.agg(F.max(F.when(F.col("variant") == "every", F.col("p"))).alias("p_all_strata"), F.max(F.when(F.col("variant").startswith("without"), F.col("p"))).alias("p_leave_one_out"))
    whole = found.where("variant = 'whole'").drop("variant").withColumn("low_resolution", F.col("extreme") < 10)
    return whole.join(F.broadcast(rest)).withColumn("dominated", F.coalesce(F.col("p_leave_one_out") > C.ALPHA, F.lit(False)))


def stratum_sums(by: list[str], flag: str, y: str) -> list[Column]:
    s = F.col(flag)
    return [F.count_if(s).alias("n_sig"), F.count_if(~s).alias("n_ctl"), F.avg(F.when(s, F.col(y))).alias("m_sig"), F.avg(F.when(~s, F.col(y))).alias("m_ctl"), F.var_samp(F.when(s, F.col(y))).alias("v_sig"), F.var_samp(F.when(~s, F.col(y))).alias("v_ctl")]


def combined(table: DataFrame, by: list[str]) -> DataFrame:
    """Weighted difference of log means over strata, its Welch error and their ratio; weights are shares of signals."""
    w = F.col("n_sig") / F.sum("n_sig").over(Window.partitionBy(*by))
    d, se2 = F.col("m_sig") - F.col("m_ctl"), F.col("v_sig") / F.col("n_sig") + F.col("v_ctl") / F.col("n_ctl")
    rows = table.withColumns({"_w": w, "_d": d, "_se2": se2})
    out = rows.groupBy(*by).agg(F.sum(F.col("_w") * F.col("_d")).alias("delta"), F.sqrt(F.sum(F.col("_w") * F.col("_w") * F.col("_se2"))).alias("se"))
    return out.withColumn("t", F.try_divide("delta", "se"))


def label_test(frame: DataFrame, iterations: int, y: str = "log_vol_post", seed: int = C.SEED) -> DataFrame:
    """Difference of ``y`` between signals and controls within strata, against shuffled labels.

    ``frame`` has date, stratum and is_signal. The raw and the studentized p-value come from the same
    shuffles; strata need enough signals and controls.
    """
    per = Window.partitionBy("stratum")
    kept = frame.withColumns({"k": F.count_if("is_signal").over(per), "c": F.count_if(~F.col("is_signal")).over(per)}).where((F.col("k") >= C.LEAST_SIGNALS) & (F.col("c") >= C.LEAST_CONTROLS))
    seen = combined(kept.withColumn("_one", F.lit(1)).groupBy("_one", "stratum").agg(*stratum_sums([], "is_signal", y)), ["_one"]).select(F.col("delta").alias("seen_delta"), F.col("se").alias("seen_se"), F.col("t").alias("seen_t"))
    drawn = combined(draw_sums(kept.select("date", "stratum", F.array("k").alias("ns"), y), y, iterations, ["stratum"], seed), ["iteration"])
    both = drawn.join(F.broadcast(seen))
    out = both.agg(
        F.max("seen_delta").alias("delta"), F.max("seen_se").alias("se"), F.max("seen_t").alias("t"), F.count_if(F.abs("delta") >= F.abs("seen_delta")).alias("extreme_raw"), F.count_if(F.abs("t") >= F.abs("seen_t")).alias("extreme_stud"), F.count("*").alias("draws")
    )
    return out.withColumns({"p_raw": p_value(F.col("extreme_raw"), F.col("draws")), "p_stud": p_value(F.col("extreme_stud"), F.col("draws"))})
