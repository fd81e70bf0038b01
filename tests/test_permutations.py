"""The permutation tests with all draws, against brute force on a small fixture."""

from __future__ import annotations

import datetime as dt
import hashlib
import statistics
from pathlib import Path

import pytest

from tidemark import config as C
from tidemark.operators import resample
from tidemark.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_mean_test_with_all_draws_can_pass(spark):
    days = [(dt.date(2000, 1, 1) + dt.timedelta(days=k), 0.001 * (k * 7 % 16)) for k in range(16)]
    pool = spark.createDataFrame(days, "date date, ret double")
    events = spark.createDataFrame([("high", 0.0145)] * 4 + [("mid", 0.0081)] * 4, "signal_id string, ret double")
    mu, want = sum(r for _, r in days) / len(days), {"high": 0, "mid": 0}
    for i in range(1, C.DRAWS + 1):
        first = sorted(days, key=lambda d: hashlib.md5(f"{C.SEED}|{i}|{d[0]}".encode()).hexdigest())[:4]
        for signal, mean in (("high", 0.0145), ("mid", 0.0081)):
            want[signal] += abs(sum(r for _, r in first) / 4 - mu) >= abs(mean - mu) - 1e-12
    got = {r["signal_id"]: r for r in resample.mean_test(events, pool, C.DRAWS).collect()}
    assert {k: (r["extreme"], r["draws"]) for k, r in got.items()} == {k: (n, C.DRAWS) for k, n in want.items()}
    assert got["high"]["passes"] and not got["mid"]["passes"]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize(("name", "test"), [("perm_mean", "mean_test"), ("perm_student", "mean_test"), ("perm_strat", "stratified_test"), ("perm_label", "label_test")])
def test_registered_with_all_draws(spark, monkeypatch, name, test):
    seen = []

    def noted(*args, **more):
        seen.append(next(x for x in args if isinstance(x, int)))
        return original(*args, **more)

    original = getattr(resample, test)
    monkeypatch.setattr(resample, test, noted)
    registry.UNCHECKED[name](spark, SMALL)
    assert seen == [C.DRAWS]


def test_sums_of_draws_equal_brute_force(spark):
    """Several counts over one pool with repeated rows, groups of one row, and counts over the pool's size."""
    rows = [("a", k // 2, float(k % 5), [1, 3, 99]) for k in range(14)] + [("a", 0, 0.0, [1, 3, 99])] + [("b", 4, 2.0, [1])]
    got = resample.draw_sums(spark.createDataFrame(rows, "g string, date long, y double, ns array<long>"), "y", 300, ["g"]).collect()
    assert len(got) == 300 * 4 and {r["iteration"] for r in got} == set(range(1, 301))
    for r in got:
        pool = sorted((hashlib.md5(f"{C.SEED}|{r['iteration']}|{k}".encode()).hexdigest(), k, y) for g, k, y, _ in rows if g == r["g"])
        drawn, rest = [y for *_, y in pool[: r["n"]]], [y for *_, y in pool[r["n"] :]]
        for x, n, m, v in ((drawn, r["n_sig"], r["m_sig"], r["v_sig"]), (rest, r["n_ctl"], r["m_ctl"], r["v_ctl"])):
            assert n == len(x)
            assert m == (pytest.approx(statistics.mean(x)) if x else None)
            assert v == (pytest.approx(statistics.variance(x)) if len(x) > 1 else None)
