"""Indicators on series with known answers."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, signals

SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long"


def bars(spark, close, high=None, low=None, ticker="TEST"):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=i) for i in range(len(close))]
    rows = [(d, ticker, float(c), float(h), float(x), float(c), float(c), None) for d, c, h, x in zip(days, close, high or close, low or close, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


@pytest.mark.parametrize(("close", "value"), [(range(1, 60), 100.0), (range(60, 1, -1), 0.0), ([50.0] * 40, 50.0)])
def test_rsi_of_plain_series(spark, close, value):
    b = bars(spark, list(close))
    for df, name, lead in ((indicators.rsi_simple(b), "rsi_simple_14", 14), (indicators.rsi_wilder(b), "rsi_wilder_14", 14), (indicators.rsi_wilder(b, seed="first"), "rsi_wilder_14_first", 13)):
        got = column(df, name)
        assert got[:lead] == [None] * lead
        assert set(got[lead:]) == {value}


def test_macd_warm_up_and_equal_spans(spark):
    b = bars(spark, np.random.default_rng(42).normal(0, 1, 80).cumsum() + 100)
    m = indicators.macd(b)
    assert column(m, "macd_line").index(next(x for x in column(m, "macd_line") if x is not None)) == 25
    assert column(m, "macd_signal").index(next(x for x in column(m, "macd_signal") if x is not None)) == 33
    assert {x for x in column(indicators.macd(b, 12, 12), "macd_line") if x is not None} == {0.0}


def test_true_range_and_atr(spark):
    flat = bars(spark, [100] * 20, [102] * 20, [98] * 20)
    got = indicators.true_range(flat)
    assert column(got, "true_range") == [None] + [4.0] * 19
    assert set(column(got, "tr_source")[1:]) == {"tr_hl"}
    gap = indicators.true_range(bars(spark, [100, 121, 121], [101, 122, 122], [99, 120, 120]))
    assert (column(gap, "true_range")[1], column(gap, "tr_source")[1]) == (22.0, "tr_hc")
    atr = column(indicators.atr(flat), "atr_14")
    assert atr[:14] == [None] * 14 and set(atr[14:]) == {4.0}


def test_bollinger_of_a_flat_series(spark):
    last = indicators.bollinger(bars(spark, [7.0] * 25)).orderBy(F.desc("date")).first()
    assert (last["bb_upper"], last["bb_middle"], last["bb_lower"], last["bb_percent_b"], last["bb_width"]) == (7.0, 7.0, 7.0, 0.5, 0.0)


def test_tickers_stay_apart(spark):
    a, b = bars(spark, range(1, 40), ticker="A"), bars(spark, range(40, 1, -1), ticker="B")
    got = indicators.rsi_wilder(a.unionByName(b)).where("rsi_wilder_14 IS NOT NULL").groupBy("ticker").agg(F.min("rsi_wilder_14").alias("lo"), F.max("rsi_wilder_14").alias("hi"))
    assert {(r["ticker"], r["lo"], r["hi"]) for r in got.collect()} == {("A", 100.0, 100.0), ("B", 0.0, 0.0)}


def test_edges_and_forward_returns(spark):
    b = bars(spark, [1, 2, 2, 2, 1, 2, 1])
    rule = [("X", "high", lambda: F.col("close") > 1)]
    assert column(signals.make_signals(b, rule), "signal") == [False, True, False, False, False, True, False]
    f = signals.forward_returns(bars(spark, [1, 2, 4, 8]), (1, 2))
    assert column(f, "fwd_ret_1") == [1.0, 1.0, None, None]
    assert column(f, "fwd_ret_2") == [3.0, None, None, None]


def test_unknown_policies_raise(spark):
    with pytest.raises(ValueError, match="seed"):
        indicators.rsi_wilder(bars(spark, [1, 2]), seed="median")
    with pytest.raises(ValueError, match="direction"):
        signals.judge(F.col("close"), 1.0, "beside")
