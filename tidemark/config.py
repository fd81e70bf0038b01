"""Constants of the analysis, and the parameters that fit the derived bars."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Indicator, test, backtest and metric settings.
RSI_PERIOD, RSI_LOW, RSI_HIGH = 14, 30.0, 70.0
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ATR_PERIOD, BB_PERIOD, BB_WIDTH, BB_FLAT = 14, 20, 2.0, 0.5
HORIZONS = (1, 5, 10, 20)
ALPHA, TESTS, DRAWS, SEED, LEAST_EVENTS = 0.05, 20, 10_000, 42, 30
COST = 0.0005 + 0.0005  # commission and slippage a side
CAPITAL, TRADING_DAYS, CALENDAR_DAYS = 100_000.0, 252, 365.25
GAP_DAYS, SHOCK = 6, 0.05
PRE_WINDOW, POST_WINDOW, POST_OFFSET = 14, 20, 2
LEAST_HISTORY, LEAST_SIGNALS, LEAST_CONTROLS, LEAST_TRADES = 750, 5, 10, 20
QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)


@dataclass(frozen=True)
class Regime:
    key: str
    start: dt.date
    end: dt.date | None  # inclusive; None is open
    ordinal: int


def _regimes(*starts: tuple[int, int]) -> tuple[Regime, ...]:
    days = [dt.date(y, m, 1) for y, m in starts]
    ends = [d - dt.timedelta(days=1) for d in days[1:]] + [None]
    return tuple(Regime(f"R{i + 1}", a, b, i) for i, (a, b) in enumerate(zip(days, ends, strict=True)))


#: Of the bars derived from orders.
START = dt.date(1996, 1, 1)
SIGNAL_TICKER, BENCHMARK_TICKER = "1-URGENT", "2-HIGH"
REGIMES = _regimes((1996, 1), (1997, 1), (1998, 1), (1999, 1), (2000, 1), (2000, 7))


def choose(value: str, known: tuple[str, ...], what: str) -> str:
    """A policy switch, checked before any plan is made."""
    if value not in known:
        raise ValueError(f"{what} must be one of {', '.join(known)}, not {value!r}")
    return value
