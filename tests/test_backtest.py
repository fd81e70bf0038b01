"""Trades, thinning, rates and audits on small cases worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from tests.test_indicators import bars
from tidemark.operators import audit, backtest, pathvol, regimes
from tidemark.sources import bars as source


def days(spark, n, hits):
    return spark.createDataFrame([("S", "T", p, p in hits) for p in range(n)], "signal_id string, ticker string, pos long, signal boolean")


@pytest.mark.parametrize(("n", "hits", "want"), [(20, {0, 4}, [(1, 4), (5, 8)]), (20, {0, 1, 2}, [(1, 4)]), (20, {18, 19}, []), (20, {16}, []), (20, {15}, [(16, 19)])])
def test_trades(spark, n, hits, want):
    got = backtest.trade_positions(days(spark, n, hits), (3,))
    assert sorted((r["entry_pos"], r["exit_pos"]) for r in got.collect()) == want


def test_costs(spark):
    prices = spark.createDataFrame([("T", p, dt.date(2000, 1, 1 + p), 100.0) for p in range(3)], "ticker string, pos long, date date, close double")
    positions = spark.createDataFrame([("S", "T", 1, 1, 2)], "signal_id string, ticker string, holding_days int, entry_pos long, exit_pos long")
    assert round(backtest.trade_log(positions, prices).first()["return_pct"], 4) == -0.1998


def test_thinning(spark):
    rows = spark.createDataFrame([("T", p) for p in (0, 5, 20, 39, 40)], "ticker string, pos long")
    assert sorted(r["pos"] for r in pathvol.thin(rows, ["ticker"], 20).collect()) == [0, 20, 40]
    anchors = spark.createDataFrame([("T", 20)], "ticker string, pos long")
    controls = spark.createDataFrame([("T", p) for p in (0, 1, 39, 40, 41)], "ticker string, pos long")
    assert sorted(r["pos"] for r in pathvol.away_from(controls, anchors, ["ticker"], 20).collect()) == [0, 40, 41]


def test_rates_off_the_calendar_never_carry_forward(spark):
    d = [dt.date(2000, 1, k) for k in (3, 4, 5, 6)]
    prices = spark.createDataFrame([("T", d[0]), ("T", d[2]), ("T", d[3])], "ticker string, date date")
    rates = spark.createDataFrame([(d[0], 2.52), (d[1], 25.2), (d[3], 5.04)], "date date, rate double")
    got = {r["date"]: r["risk_free"] for r in backtest.aligned_rates(prices, rates).collect()}
    assert [round(got[x], 10) for x in (d[0], d[2], d[3])] == [0.0001, 0.0001, 0.0002]
    zero = {r["date"]: r["risk_free"] for r in backtest.aligned_rates(prices, rates, "zero").collect()}
    assert zero[d[2]] == 0.0


def test_regimes_are_inclusive(spark):
    rows = spark.createDataFrame([(dt.date(1995, 12, 31),), (dt.date(1996, 1, 1),), (dt.date(1996, 12, 31),), (dt.date(2030, 1, 1),)], "date date")
    from pyspark.sql import functions as F

    assert [r["g"] for r in rows.select(regimes.regime_of(F.col("date")).alias("g")).collect()] == [None, "R1", "R1", "R6"]


def test_audit_gate(spark):
    good = bars(spark, [1, 2, 3])
    assert audit.duplicates(good).first()["n_duplicate"] == 0
    assert audit.gated(good, 548, 5).count() == 3
    for bad, named in ((good.unionByName(good), "repeated key"), (bars(spark, [5, 5], [4, 6], [5, 5]), "inner high or low")):
        with pytest.raises(Exception, match=named):
            audit.gated(bad, 365, 5000).count()
    with pytest.raises(Exception, match="rows a year"):
        audit.gated(good, 365, 10).count()
    record = {(r["name"], r["item"]): r["ok"] for r in audit.gate_record(good.unionByName(bars(spark, [5, 5], [4, 6], [5, 5], "U")), 548, 50).collect()}
    assert record == {("duplicates", ""): True, ("violations", "TEST"): True, ("violations", "U"): False, ("rows_per_year", "TEST"): True, ("rows_per_year", "U"): False}


def test_trades_are_verified(spark):
    rows = days(spark, 20, {0, 4, 9})
    good = backtest.trade_positions(rows, (3,))
    assert backtest.verified_trades(good).count() == 3
    r = backtest.run_record(good, rows).first()
    assert (r["signals"], r["trades"], r["overlapping"], r["wrong_length"], r["unsignalled"], r["verified"]) == (3, 3, 0, 0, 0, True)
    bad = good.unionByName(spark.createDataFrame([("S", "T", 3, 7, 11)], good.schema))
    with pytest.raises(Exception, match="not a trade"):
        backtest.verified_trades(bad).count()
    r = backtest.run_record(bad, rows).first()
    assert (r["overlapping"], r["wrong_length"], r["unsignalled"], r["verified"]) == (2, 1, 1, False)


def test_a_missing_benchmark_close_is_an_error(spark):
    prices = spark.createDataFrame([("T", 0, dt.date(2000, 1, 3), 1.0), ("T", 1, dt.date(2000, 1, 4), None)], "ticker string, pos long, date date, close double")
    rates = spark.createDataFrame([("T", dt.date(2000, 1, 3), 0.0), ("T", dt.date(2000, 1, 4), 0.0)], "ticker string, date date, risk_free double")
    with pytest.raises(Exception, match="no close of the benchmark"):
        backtest.benchmark_curves(prices, rates).count()
    with pytest.raises(Exception, match="repeated key"):
        backtest.benchmark_curves(prices.where("pos = 0"), rates.union(rates)).count()


def test_normalize_and_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("2000-01-03", 1.0, 2.0, 0.5, float("nan")), ("2000-01-04", None, None, None, None)], "Date string, Open double, High double, Low double, Close double")
    got = source.normalize(raw, "T")
    assert got.count() == 1 and got.first()["close"] is None and got.first()["volume"] is None
    with pytest.raises(ValueError, match="close"):
        source.normalize(raw.drop("Close"), "T")
    frame, failed = source.collect_bars({"T": raw, "U": raw.drop("Close")})
    assert frame.count() == 1 and list(failed) == ["U"]
    source.write_bars(got, str(tmp_path / "b"))
    assert source.read_bars(spark, str(tmp_path / "b")).columns == got.columns
