"""A stream of bars gives the signals that the batch operators give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_indicators import SCHEMA, bars
from tidemark.operators import indicators, signals
from tidemark.streaming.signals import rsi_edges


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    whole = bars(spark, rng.normal(0, 1, 120).cumsum() + 100, ticker="A").unionByName(bars(spark, rng.normal(0, 1, 120).cumsum() + 90, ticker="B")).cache()
    days = sorted(r["date"] for r in whole.select("date").distinct().collect())
    path = str(tmp_path / "in")
    whole.coalesce(1).where(F.col("date") < days[40]).write.parquet(path)
    query = rsi_edges(spark.readStream.schema(SCHEMA).parquet(path)).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    for lo, hi in ((40, 41), (30, 41), (41, 120)):  # the second comes too late and changes nothing
        whole.coalesce(1).where(F.col("date").between(days[lo], days[hi - 1])).write.mode("append").parquet(path)
        query.processAllAvailable()
    query.stop()
    got = {(r["ticker"], r["date"]): (r["rsi"], r["signal"]) for r in spark.table("edges").collect()}
    want = signals.make_signals(indicators.add_indicators(whole)).where("signal_id = 'S1'").join(indicators.rsi_wilder(whole).select("ticker", "date", "rsi_wilder_14"), ["ticker", "date"])
    rows = want.collect()
    assert len(got) == len(rows) == 240 and any(r["signal"] for r in rows)
    for r in rows:
        rsi, signal = got[r["ticker"], r["date"]]
        assert signal == r["signal"] and (rsi is None) == (r["rsi_wilder_14"] is None) and (rsi is None or rsi == pytest.approx(r["rsi_wilder_14"]))
