"""RSI signals of bars as they arrive: the Wilder state of each ticker is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import config as C

OUT = "ticker string, date date, rsi double, signal boolean"
STATE = "n long, close double, gain double, loss double, low boolean, last date"


def rsi_edges(bars: DataFrame, n: int = C.RSI_PERIOD, low: float = C.RSI_LOW) -> DataFrame:
    """date, ticker, rsi and whether the RSI has just fallen below ``low``, for a stream of bars.

    Inside a batch bars are sorted. A bar that isn't later than the last one of its ticker in an earlier batch comes too late: it is passed over, changes nothing and has no
    row. Else the results equal those of the batch operators over the same bars.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, close, gain, loss, below, last = state.get if state.exists else (0, float("nan"), 0.0, 0.0, False, None)
        rows = pd.concat(list(batches)).sort_values("date")
        rows = rows if last is None else rows[rows["date"] > last]
        out = []
        for date, price in zip(rows["date"], rows["close"], strict=True):
            rsi = None
            if seen:
                up, down = max(price - close, 0.0), max(close - price, 0.0)
                if seen <= n:  # the seed is the mean of the first n moves
                    gain, loss = gain + up / n, loss + down / n
                else:
                    gain, loss = gain + (up - gain) / n, loss + (down - loss) / n
                if seen >= n:
                    rsi = 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
            seen, close = seen + 1, price
            now = rsi is not None and rsi < low
            out.append((key[0], date, rsi, now and not below))
            below = now
        state.update((seen, close, gain, loss, below, rows["date"].iloc[-1] if len(rows) else last))
        yield pd.DataFrame(out, columns=["ticker", "date", "rsi", "signal"])

    return bars.select("ticker", "date", "close").groupBy("ticker").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
