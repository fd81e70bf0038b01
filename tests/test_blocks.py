"""Series split over tasks: recursive means, prefixes, thinning, expanding bins and exact quantiles against plain loops."""

from __future__ import annotations

import bisect
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.blocks import Prefix, prefixes, spaced
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.ranks import expanding_bins
from tidemark import config as C
from tidemark.operators import backtest, indicators, regimes

START = dt.date(2000, 1, 1)


def series(spark, values, ticker="T"):
    rows = [(ticker, START + dt.timedelta(days=i), None if v is None or v != v else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def holed(n, seed, share=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, n).cumsum() + 50
    return np.where(rng.random(n) < share, np.nan, x)


def column(df, name):
    return [math.nan if r[name] is None else r[name] for r in df.orderBy("ticker", "date").collect()]


def wilder(x, n):
    """Wilder's mean with a mean seed, row by row."""
    out, valid = [math.nan] * len(x), [i for i, v in enumerate(x) if v == v]
    if valid and valid[0] + n <= len(x):
        at = valid[0] + n - 1
        state = out[at] = sum(x[valid[0] : at + 1]) / n
        for i in range(at + 1, len(x)):
            if x[i] == x[i]:
                state += (x[i] - state) / n
                out[i] = state
    return out


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_recursive_means_at_any_block_size(spark, days):
    x = np.concatenate((holed(5, 1, 1.0), [50.0] * 4, holed(120, 2)))  # no hole among the first rows that have a value
    frame = series(spark, x)
    got = indicators.recursive(frame, {"w": indicators.rma("close", 4), "f": indicators.rma("close", 3, "first"), "e": indicators.ema("close", 5), "one": indicators.rma("close", 1)}, days)
    s = pd.Series(x)
    for name, want in (("w", wilder(x, 4)), ("f", s.ewm(alpha=1 / 3, adjust=False, min_periods=3).mean()), ("e", s.ewm(span=5, adjust=False, min_periods=5).mean()), ("one", wilder(x, 1))):
        np.testing.assert_allclose(column(got, name), want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("days", [1, 40])
def test_a_hole_in_the_seed_leaves_no_mean_and_short_series_none(spark, days):
    assert all(v != v for v in column(indicators.recursive(series(spark, [1, 2, None, 4, 5, 6, 7, 8]), {"w": indicators.rma("close", 4)}, days), "w"))
    assert all(v != v for v in column(indicators.recursive(series(spark, [1, 2, 3]), {"w": indicators.rma("close", 4)}, days), "w"))
    assert column(indicators.recursive(series(spark, [1, 2, None, 5]), {"w": indicators.rma("close", 2)}, days), "w")[1:] == pytest.approx([1.5, math.nan, 3.25], nan_ok=True)
    assert indicators.recursive(series(spark, []), {"w": indicators.rma("close", 2)}, days).count() == 0


@pytest.mark.parametrize("seed", ["sma", "first"])
def test_rsi_with_holes_at_any_block_size(spark, seed):
    x = np.concatenate(([50.0, 51.0, 49.5, 50.5], holed(90, 4)))
    frame = series(spark, x)
    name = "rsi_wilder_3" + ("_first" if seed == "first" else "")
    d = np.diff(x, prepend=np.nan)
    side = lambda k: np.where(np.isnan(d), 0.0 if seed == "first" else np.nan, np.maximum(k * d, 0.0))
    mean = (lambda v: pd.Series(v).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean().to_numpy()) if seed == "first" else (lambda v: np.array(wilder(v, 3)))
    g, low = mean(side(1)), mean(side(-1))
    with np.errstate(all="ignore"):
        want = np.where(np.isnan(g) | np.isnan(low), np.nan, np.where(low == 0, np.where(g == 0, 50.0, 100.0), 100 - 100 / (1 + g / low)))
    for days in (1, 1000):
        np.testing.assert_allclose(column(indicators.rsi_wilder(frame, 3, seed, days), name), want, rtol=1e-9, equal_nan=True)


def test_one_ticker_runs_in_many_tasks(spark):
    frame = series(spark, holed(2000, 3))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = indicators.rsi_wilder(frame, days=50).select(F.spark_partition_id().alias("p")).distinct().count()
        binned = expanding_bins(frame, "close", "bin", 5, 100, days=50).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got >= 8 and binned >= 8


@pytest.mark.parametrize("days", [1, 7])
def test_prefixes(spark, days):
    x = holed(40, 5)
    got = prefixes(series(spark, x), {"s": Prefix("sum", F.col("close")), "top": Prefix("max", F.col("close")), "low": Prefix("min", F.col("close"), before=True), "p": Prefix("product", 1 + F.col("close") / 1000), "l": Prefix("last", F.col("close")), "one": Prefix("first", F.col("close"))}, days=days)
    seen = [[v for v in x[: i + 1] if v == v] for i in range(len(x))]
    for name, want in (
        ("s", [sum(v) if v else math.nan for v in seen]), ("top", [max(v, default=math.nan) for v in seen]), ("low", [min((u for u in x[:i] if u == u), default=math.nan) for i in range(len(x))]),
        ("p", [math.prod(1 + u / 1000 for u in v) if v else math.nan for v in seen]), ("l", [v[-1] if v else math.nan for v in seen]), ("one", [v[0] if v else math.nan for v in seen]),
    ):
        np.testing.assert_allclose(column(got, name), want, rtol=1e-12, equal_nan=True)


def greedy(positions, gap):
    kept = []
    for p in sorted(set(positions)):
        if not kept or p - kept[-1] >= gap:
            kept.append(p)
    return kept


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_thinning_at_any_block_size(spark, size):
    rng = np.random.default_rng(size)
    sets = {(g, k): sorted(int(p) for p in rng.choice(400, 120, replace=False)) for k, g in enumerate((1, 2, 5, 21, 70))}
    rows = [(k, p, g) for (g, k), ps in sets.items() for p in [*ps, ps[3]]]
    got = spaced(spark.createDataFrame(rows, "k int, pos long, gap int"), ("k",), size).collect()
    assert len(got) == len({(r["k"], r["pos"]) for r in got})
    for (g, k), ps in sets.items():
        assert sorted(r["pos"] for r in got if r["k"] == k) == greedy(ps, g)


def test_a_million_signals(spark):
    rows = spark.range(1_000_000).select(F.lit("S").alias("signal_id"), F.lit("T").alias("ticker"), F.col("id").alias("pos"), F.lit(True).alias("signal"))
    got = backtest.trade_positions(rows, (4,)).agg(F.count("*").alias("n"), F.min("entry_pos").alias("a"), F.max("exit_pos").alias("b"), F.sum("entry_pos").alias("s")).first()
    entries = range(1, 999_996, 5)
    assert (got["n"], got["a"], got["s"]) == (len(entries), 1, sum(entries)) and got["b"] == entries[-1] + 4


def plain_bins(x, bins, least):
    held, out = [], []
    for v in x:
        if v != v:
            out.append(math.nan)
            continue
        found = math.nan
        if len(held) >= least:
            at = [(len(held) - 1) * k / bins for k in range(1, bins)]
            edges = [held[int(a)] + (a - int(a)) * (held[min(int(a) + 1, len(held) - 1)] - held[int(a)]) for a in at]
            found = 1 + bisect.bisect_right(edges, v)
        out.append(found)
        bisect.insort(held, v)
    return out


@pytest.mark.parametrize("days", [1, 9, 1000])
@pytest.mark.parametrize("kind", ["smooth", "tied", "same"])
def test_expanding_bins(spark, days, kind):
    x = holed(150, 6)
    x = {"smooth": x, "tied": np.round(x / 3), "same": np.where(np.isnan(x), x, 2.0)}[kind]
    for bins, least in ((5, 20), (2, 1)):
        got = column(expanding_bins(series(spark, x), "close", "bin", bins, least, days=days), "bin")
        np.testing.assert_allclose(got, plain_bins(x, bins, least), equal_nan=True)
    assert column(expanding_bins(series(spark, [3, None]), "close", "bin", 1, 9, days=days), "bin") == pytest.approx([1, math.nan], nan_ok=True)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    groups = {"many": rng.normal(size=3000), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=50), "same": np.full(400, 3.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    wanted = {"low": 0.0, "q05": 0.05, "half": 0.5, "p90": 0.9, "high": 1.0}
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert [got[k][n] for n in wanted] == pytest.approx([float(np.quantile(vs, q)) for q in wanted.values()], rel=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", wanted).count() == 0


def test_regimes_of_a_table(spark):
    """10,000 spans, many of them overlapping, open or empty, against a nested loop."""
    rng = np.random.default_rng(8)
    day = lambda k: START + dt.timedelta(days=int(k))
    spans = [(f"R{k}", day(a), None if k % 997 == 0 else day(a + n), int(o)) for k, (a, n, o) in enumerate(zip(rng.integers(0, 9000, 10_000), rng.integers(-2, 60, 10_000), rng.permutation(10_000), strict=True))] + [("none", None, None, 99_999)]
    dates = [day(k) for k in rng.integers(-20, 9200, 300)] + [None]
    table = spark.createDataFrame(spans, "key string, start date, end date, ordinal int")
    got = regimes.tagged(spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, day date"), table, "day", near=1).collect()
    edges = {d for _, a, b, _ in spans for d in (a, b) if d}
    for r in got:
        d = dates[r["i"]]
        held = [(o, k) for k, a, b, o in spans if d and a and a <= d and (b is None or d <= b)]
        assert r["regime"] == (max(held)[1] if held else None)
        assert r["near_boundary"] == (any(d + dt.timedelta(days=k) in edges for k in (-1, 0, 1)) if d else None)


def test_a_table_of_the_constants_gives_the_same_regimes(spark):
    table = spark.createDataFrame([(r.key, r.start, r.end, r.ordinal) for r in C.REGIMES], "key string, start date, end date, ordinal int")
    dates = spark.range(0, 2600).select(F.date_add(F.lit(dt.date(1995, 6, 1)), F.col("id").cast("int")).alias("date"))
    both = regimes.tagged(dates, table).withColumns({"same": F.col("regime").eqNullSafe(regimes.regime_of(F.col("date")))})
    assert both.count() == 2600 and both.where("NOT same").count() == 0
