"""Indicators appended to bars. Windows where a frame suffices; recursive means are scans of affine maps over blocks of a series."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.blocks import DAYS, Prefix, block_of, carried, compose, prefixes
from tidemark.functions.windows import previous, rolling

@dataclass(frozen=True)
class Mean:
    """A recursive mean of the column ``x`` as affine maps of its state, y -> a y + b.

    ``seed`` is ``sma`` (Wilder's: the mean of the first n rows from the first value on; nulls give nulls and keep the state; a hole among those rows leaves no result) or ``first`` (the first value;
    nulls repeat the mean, and what comes after them weighs more; shown from the n-th value on). With ``side`` the mean is of the moves of ``x`` up (1) or down (-1) from
    the row before, of which a series' first row has none, or zero with ``first_zero``.
    """

    x: str
    n: int
    alpha: float
    seed: str
    side: int = 0
    first_zero: bool = False

    def series(self, x: np.ndarray, before: float) -> np.ndarray:
        """What the mean is taken of, in a block that comes after the value ``before`` (NaN if there is none)."""
        if not self.side:
            return x
        moved = self.side * np.diff(x, prepend=before)
        return np.where(np.isnan(moved), 0.0 if self.first_zero else np.nan, np.maximum(moved, 0.0))

    def maps(self, v: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
        """The map of each row of a series under way; ``gap`` rows without a value lie before them."""
        there = ~np.isnan(v)
        if self.seed == "sma":
            return np.where(there, 1 - self.alpha, 1.0), np.where(there, self.alpha * v, 0.0)
        at = np.arange(len(v))
        before = np.concatenate(([-1 - gap], np.maximum.accumulate(np.where(there, at, -1 - gap))[:-1])) if len(v) else at
        w = (1 - self.alpha) ** (at - before)
        return np.where(there, w / (w + self.alpha), 1.0), np.where(there, self.alpha * v / (w + self.alpha), 0.0)

    def from_row(self, v: np.ndarray, at: int) -> tuple[float, float]:
        """One map of all rows from ``at`` on, with a value right before them."""
        a, b = compose(*self.maps(v[at:], 0))
        return (float(a[-1]), float(b[-1])) if len(a) else (1.0, 0.0)

    def summary(self, v: np.ndarray) -> list[float]:
        """Rows, values, rows before the first and after the last; then sums of seeding rows and the map of what follows, for each way a block may meet the seed."""
        there = np.flatnonzero(~np.isnan(v))
        lead, tail = (int(there[0]), len(v) - 1 - int(there[-1])) if len(there) else (len(v), len(v))
        head = [float(len(v)), float(len(there)), float(lead), float(tail)]
        if self.seed == "first":
            return [*head, float(v[lead]) if len(there) else 0.0, *self.from_row(v, lead + 1)]
        ends = [*range(min(self.n, len(v)) + 1), min(lead + self.n, len(v))]  # where seeding may end: begun before the block, or at its first value
        a, b = self.from_row(v, max(ends))
        after = {max(ends): (a, b)}
        row_a, row_b = self.maps(v[: max(ends)], 0)
        for at in range(max(ends) - 1, -1, -1):
            a, b = a * row_a[at], a * row_b[at] + b
            after[at] = (a, b)
        sums = [float(v[:e].sum()) for e in ends[:-1]] + [float(v[lead : ends[-1]].sum())]
        return [*head, *(y for e, total in zip(ends, sums, strict=True) for y in (total, *after[e]))]

    def step(self, state: list[float], block: list[float]) -> list[float]:
        """The state after a block: values so far, rows of the seed and their sum, whether it is done, the mean, and rows since the last value."""
        count, rows, total, done, y, gap = state
        m, valid, lead, tail, *ways = block
        if self.seed == "first":
            if valid:
                x, a, b = ways
                w = (1 - self.alpha) ** (gap + lead + 1)
                y = a * ((w * y + self.alpha * x) / (w + self.alpha) if count else x) + b
                done = 1.0
        elif done:
            y = ways[1] * y + ways[2]
        elif rows or valid:
            size = m if rows else m - lead
            took = int(min(self.n - rows, size))
            s, a, b = ways[3 * took : 3 * took + 3] if rows else ways[-3:]
            rows, total = rows + took, total + s
            if rows == self.n:
                done, y = 1.0, a * (total / self.n) + b
        return [count + valid, rows, total, done, y, tail if valid else gap + m]

    def values(self, v: np.ndarray, start: list[float]) -> np.ndarray:
        count, rows, total, done, y, gap = start
        out, there = np.full(len(v), np.nan), ~np.isnan(v)
        at = 0
        if not done:
            if not rows and not there.any():
                return out
            at = 0 if rows else int(there.argmax())
            if self.seed == "first":
                y, out[at] = v[at], v[at]
                at, gap = at + 1, 0.0
            else:
                left = int(self.n - rows)
                if len(v) - at < left:
                    return out
                y = (total + v[at : at + left].sum()) / self.n
                at += left
                out[at - 1] = y
        if at < len(v):
            a, b = compose(*self.maps(v[at:], gap))
            out[at:] = a * y + b
        shown = there if self.seed == "sma" else count + np.cumsum(there) >= self.n
        return np.where(shown, out, np.nan)


def ema(x: str, n: int) -> Mean:
    """Exponential mean with weight 2 / (n + 1), seeded by the first value."""
    return Mean(x, n, 2 / (n + 1), "first")


def rma(x: str, n: int, seed: str = "sma") -> Mean:
    """Wilder's mean, of weight 1 / n."""
    return Mean(x, n, 1 / n, C.choose(seed, ("sma", "first"), "seed"))


#: Numbers in the state of a mean; with them comes the last value of its column.
STATE = 6


def recursive(bars: DataFrame, means: dict[str, Mean], days: int = DAYS) -> DataFrame:
    """``bars`` with a column for each mean over a ticker's rows in date order. A ticker is split into blocks of ``days`` calendar days.

    The first row of a block may need the value before it, so a block is summed up as its first value, its last, and the rest of its rows.
    """

    def summary(rows: pa.Table) -> list[float]:
        out = []
        for m in means.values():
            x = rows[m.x].to_numpy().astype(float)
            rest = m.summary(m.series(x, np.nan)[1:])
            out += [float(len(rest)), x[0], x[-1], *rest]
        return out

    def chain(blocks: list[list[float]]) -> list[list[float]]:
        states = [[0.0] * STATE + [np.nan] for _ in means]
        out = []
        for block in blocks:
            out.append([y for s in states for y in s])
            at = 0
            for i, m in enumerate(means.values()):
                size, first, last = int(block[at]), *(np.nan if v is None else v for v in block[at + 1 : at + 3])
                head = m.summary(m.series(np.array([first]), states[i][STATE]))
                states[i] = [*m.step(m.step(states[i][:STATE], head), block[at + 3 : at + 3 + size]), last]
                at += 3 + size
        return out

    def columns(rows: pa.Table, start: list[float] | None) -> dict[str, np.ndarray]:
        out = {}
        for i, (name, m) in enumerate(means.items()):
            *state, before = start[i * (STATE + 1) : (i + 1) * (STATE + 1)] if start else [0.0] * STATE + [np.nan]
            out[name] = m.values(m.series(rows[m.x].to_numpy().astype(float), before), state)
        return out

    return carried(bars, summary, chain, columns, list(means), block=block_of("date", days))


def with_previous(bars: DataFrame, days: int = DAYS) -> DataFrame:
    """``bars`` with ``_before``, the close of the row before in a struct (none on a ticker's first row)."""
    return prefixes(bars, {"_before": Prefix("last", F.struct("close"), before=True)}, days=days)


def gains(bars: DataFrame) -> DataFrame:
    """Upward and downward moves of the close; a ticker's first row has none."""
    d = F.col("close") - previous(F.col("close"))
    return bars.withColumn("_d", d).withColumns({"_gain": F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_d").isNotNull(), 0.0), "_loss": F.when(F.col("_d") < 0, -F.col("_d")).when(F.col("_d").isNotNull(), 0.0)})


def wilder_moves(n: int, seed: str = "sma") -> dict[str, Mean]:
    """Wilder's means of moves of the close up and down."""
    sides = {"_g": 1, "_l": -1}
    return {name: replace(rma("close", n, seed), side=side, first_zero=seed == "first") for name, side in sides.items()}


def rsi_of(gain: Column, loss: Column) -> Column:
    """100 with gains only, 50 if nothing moved, null if either mean is."""
    return F.when(gain.isNull() | loss.isNull(), None).when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss)))


def rsi_simple(bars: DataFrame, n: int = C.RSI_PERIOD) -> DataFrame:
    means = gains(bars).withColumns({"_g": rolling(F.avg, F.col("_gain"), n), "_l": rolling(F.avg, F.col("_loss"), n)})
    return means.withColumn(f"rsi_simple_{n}", rsi_of(F.col("_g"), F.col("_l"))).drop("_d", "_gain", "_loss", "_g", "_l")


def rsi_wilder(bars: DataFrame, n: int = C.RSI_PERIOD, seed: str = "sma", days: int = DAYS) -> DataFrame:
    name = f"rsi_wilder_{n}" + ("_first" if C.choose(seed, ("sma", "first"), "seed") == "first" else "")
    return recursive(bars, wilder_moves(n, seed), days).withColumn(name, rsi_of(F.col("_g"), F.col("_l"))).drop("_g", "_l")


def macd(bars: DataFrame, fast: int = C.MACD_FAST, slow: int = C.MACD_SLOW, signal: int = C.MACD_SIGNAL, days: int = DAYS) -> DataFrame:
    lines = recursive(bars, {"_fast": ema("close", fast), "_slow": ema("close", slow)}, days).withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return recursive(lines, {"macd_signal": ema("macd_line", signal)}, days).withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def true_range(bars: DataFrame, days: int = DAYS) -> DataFrame:
    """The three ranges, the largest and its name (the first on ties); null on a ticker's first row."""
    before = F.col("_before.close")
    out = with_previous(bars, days).withColumns({"tr_hl": F.col("high") - F.col("low"), "tr_hc": F.abs(F.col("high") - before), "tr_lc": F.abs(F.col("low") - before)}).drop("_before")
    known = F.col("tr_hl").isNotNull() & F.col("tr_hc").isNotNull() & F.col("tr_lc").isNotNull()
    out = out.withColumn("true_range", F.when(known, F.greatest("tr_hl", "tr_hc", "tr_lc")))
    source = F.when(F.col("true_range").isNull(), None)
    for name in ("tr_hl", "tr_hc", "tr_lc"):
        source = source.when(F.col("true_range") == F.col(name), F.lit(name))
    return out.withColumn("tr_source", source)


def atr(bars: DataFrame, n: int = C.ATR_PERIOD, days: int = DAYS) -> DataFrame:
    """Wilder's mean of the true range, which is used if it is there already."""
    ranged = bars if "true_range" in bars.columns else true_range(bars, days)
    return recursive(ranged, {f"atr_{n}": rma("true_range", n)}, days)


def bollinger(bars: DataFrame, n: int = C.BB_PERIOD, k: float = C.BB_WIDTH) -> DataFrame:
    mid, sd, close = rolling(F.avg, F.col("close"), n), rolling(F.stddev_pop, F.col("close"), n), F.col("close")
    out = bars.withColumns({"bb_middle": mid, "_sd": sd}).withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")})
    room = F.col("bb_upper") - F.col("bb_lower")
    inside = F.when(room == 0, C.BB_FLAT).otherwise(F.try_divide(close - F.col("bb_lower"), room))
    return out.withColumns({"bb_percent_b": F.when(room.isNotNull(), inside), "bb_width": F.try_divide(room, F.col("bb_middle")) * 100}).drop("_sd")


def add_indicators(bars: DataFrame, days: int = DAYS) -> DataFrame:
    """RSI, Bollinger bands and MACD: all that the signals read, with one scan for the means of closes and one for MACD's signal."""
    n = C.RSI_PERIOD
    means = recursive(bars, wilder_moves(n) | {"_fast": ema("close", C.MACD_FAST), "_slow": ema("close", C.MACD_SLOW)}, days)
    lines = means.withColumns({f"rsi_wilder_{n}": rsi_of(F.col("_g"), F.col("_l")), "macd_line": F.col("_fast") - F.col("_slow")}).drop("_g", "_l", "_fast", "_slow")
    signal = recursive(lines, {"macd_signal": ema("macd_line", C.MACD_SIGNAL)}, days)
    return bollinger(signal.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")))
