"""Checks that raise, text reports, and tables read back."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark import config as C
from tidemark.operators import audit, metrics, pathvol, regimes, resample
from tidemark.sources import bars as sources

DAY = dt.date(1997, 3, 3)


def test_joins_are_guarded(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5), (2, None, None)], "k int, a double, b double")
    assert audit.unique_on(rows, "k").count() == 2
    with pytest.raises(Exception, match="repeated key: k=1"):
        audit.unique_on(rows.union(rows.limit(1)), "k").count()
    with pytest.raises(Exception, match="no a: k=2"):
        audit.all_matched(rows, "a", "k").count()
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert audit.all_matched(left.where("k < 3").join(rows.na.fill(0.0), "k", "left"), "a").count() == 2
    with pytest.raises(Exception, match="no a: k=3"):
        audit.all_matched(left.join(rows.na.fill(0.0), "k", "left"), "a", "k").count()
    assert audit.reconciled(rows, "a", "b").columns == ["k", "a"]
    with pytest.raises(Exception, match="a and b differ"):
        audit.reconciled(rows.union(spark.createDataFrame([(3, 0.5, None)], rows.schema)), "a", "b").count()


def test_volatilities_and_counts_are_guarded(spark):
    frame = spark.createDataFrame([(DAY, 1, 0.0, 0.1, 0.1)], "date date, stratum int, pre_vol double, post_vol double, post_vol_1 double")
    assert pathvol.analysis(frame, strict=False).count() == 0
    with pytest.raises(Exception, match="not above zero"):
        pathvol.analysis(frame).count()
    found = spark.createDataFrame([(1, 3, 9), (None, 3, 9)], "stratum int, signals long, controls long")
    assert pathvol.check_counts(found, {1: (3, 9), None: (3, 9), 2: (0, 0)}).count() == 2
    for wrong in ({1: (4, 9), None: (3, 9)}, {1: (3, 9)}, {1: (3, 9), None: (3, 9), 2: (1, 0)}):
        with pytest.raises(Exception, match="unexpected numbers"):
            pathvol.check_counts(found, wrong).count()


def test_reports_are_text(spark, tmp_path):
    table = spark.createDataFrame([("b", 1.5, None), ("a", 2.0, 3)], "name string, x double, n long")
    audit.write_report(table, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a\t2.0\t3", "b\t1.5\t-"]
    assert audit.markdown(table, 2).split("\n") == ["| name | x | n |", "| --- | --- | --- |", "| b | 1.50 | - |", "| a | 2.00 | 3 |"]


def test_trades_from_a_file_and_outside_of_regimes(spark, tmp_path):
    days = [DAY, DAY, dt.date(1990, 1, 2)]
    rows = [("S1", 5, d, d + dt.timedelta(days=7), 10.0, 11.0, 1.0, 1.0, r, "time_stop") for d, r in zip(days, (10.0, -4.0, 2.0), strict=True)]
    sources.write_csv(spark.createDataFrame(rows, sources.TRADES), str(tmp_path / "trades"))
    cells = {r["regime"]: r for r in metrics.regime_matrix(sources.read_trades_csv(spark, str(tmp_path / "trades"))).collect()}
    assert set(cells) == {r.key for r in C.REGIMES} | {"none"} and sum(r["n"] for r in cells.values()) == 3
    own = next(r.key for r in C.REGIMES if r.start <= DAY and (r.end is None or DAY <= r.end))
    assert (cells[own]["n"], cells[own]["mean"], cells["none"]["n"]) == (2, 3.0, 1)


def test_late_regimes_are_ordered_by_number(spark):
    d = spark.createDataFrame([("T", "R10", 1.0), ("T", "R2", 1.0), ("T", "R9", 1.0)], "ticker string, regime string, mean double")
    assert tuple(regimes.spread(d).first()[3:5]) == ("R2", "R2")


def test_stratified_report_leaves_each_stratum_out(spark):
    rows = [(DAY + dt.timedelta(days=k), k % 2 + 1, k % 7 < 2, 0.01 * (k * 13 % 17) + (0.05 if k % 7 < 2 else 0)) for k in range(140)]
    frame = spark.createDataFrame(rows, "date date, stratum int, is_signal boolean, ret double")
    got = resample.stratified_report(frame, 40).first()
    alone = {k: resample.stratified_test(frame, 40, drop=k).first()["p"] for k in (1, 2)}
    assert got["p_leave_one_out"] == max(alone.values()) and got["dominated"] == (max(alone.values()) > C.ALPHA)
    assert got["p"] == resample.stratified_test(frame, 40).first()["p"] == got["p_all_strata"] and got["low_resolution"] == (got["extreme"] < 10)
