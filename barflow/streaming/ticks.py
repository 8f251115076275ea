"""The tick vector on a stream: a key's newest ticks and running values are its state, and a tick costs the same whatever the windows are."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series_features import BOOK, TINY

SHORT, LONG, RSI = 60, 300, 14
NAMES = ["log_ret_1", "log_ret_10", "log_ret_60", "spread", "realized_vol_60", "realized_vol_300", "spread_bp", "spread_z_300", "sma60_dev", "sma300_dev", "bollinger_b", "tick_velocity", "range60", "minute_sin", "minute_cos", "rsi_14", "atr_14", "macd", "macd_gap"]


class _Window:
    """The newest LONG mids and SHORT times of a key, with sums that each tick moves on and extremes as monotone queues."""

    def __init__(self, n: int, mids: list[float], times: list[int], slow: list[float]):
        self.n, self.mids, self.times = n, deque(mids, LONG + 1), deque(times, SHORT)
        self.gain, self.loss, self.fast, self.slow, self.atr, self.signal = slow
        self.returns: deque[float] = deque()
        self.high: deque[tuple[int, float]] = deque()
        self.low: deque[tuple[int, float]] = deque()
        first = n - len(self.mids) + 1
        m = list(self.mids)
        for k in range(max(1, len(m) - SHORT), len(m)):
            self.returns.append(_log(m[k], m[k - 1]))
        for k in range(max(0, len(m) - SHORT), len(m)):
            self._extremes(first + k, m[k])
        self._sums()

    def _sums(self) -> None:
        """From the newest values themselves; done once in LONG ticks, so that rounding never adds up."""
        m = list(self.mids)
        self.sum60, self.sum300 = sum(m[-SHORT:]), sum(m[-LONG:])
        self.s, self.q, self.moves = sum(self.returns), sum(r * r for r in self.returns), sum(r != 0 for r in self.returns)

    def _extremes(self, n: int, x: float) -> None:
        for queue, sign in ((self.high, 1), (self.low, -1)):
            while queue and sign * queue[-1][1] <= sign * x:
                queue.pop()
            queue.append((n, x))
            while queue[0][0] <= n - SHORT:
                queue.popleft()

    def push(self, ts: int, bid: float, ask: float, mid: float) -> list[float]:
        m, n, before = self.mids, self.n + 1, self.n
        last = m[-1] if m else mid
        back = lambda k: _log(mid, m[-k]) if before >= k else 0.0
        ret = [back(k) for k in (1, 10, 60)]
        self.sum60 += mid - (m[-SHORT] if before >= SHORT else 0.0)
        self.sum300 += mid - (m[-LONG] if before >= LONG else 0.0)
        if before:
            if len(self.returns) == SHORT:
                old = self.returns.popleft()
                self.s, self.q, self.moves = self.s - old, self.q - old * old, self.moves - (old != 0)
            self.returns.append(ret[0])
            self.s, self.q, self.moves = self.s + ret[0], self.q + ret[0] * ret[0], self.moves + (ret[0] != 0)
        m.append(mid)
        self.times.append(ts)
        self.n = n
        self._extremes(n, mid)
        if n % LONG == 0:
            self._sums()
        spread, diff = ask - bid, mid - last
        up, down = max(diff, 0.0), max(-diff, 0.0)
        if n <= RSI + 1:  # sums of the first gains and losses, which become their means
            self.gain, self.loss = self.gain + up, self.loss + down
            if n == RSI + 1:
                self.gain, self.loss = self.gain / RSI, self.loss / RSI
        else:
            self.gain, self.loss = (self.gain * (RSI - 1) + up) / RSI, (self.loss * (RSI - 1) + down) / RSI
        ema = lambda y, x, span: x if n == 1 else y + (x - y) * 2 / (span + 1)
        self.fast, self.slow, self.atr = ema(self.fast, mid, SHORT), ema(self.slow, mid, LONG), ema(self.atr, spread, RSI)
        macd = self.fast - self.slow
        self.signal = ema(self.signal, macd, 9)
        var = max(0.0, self.q - self.s * self.s / SHORT) / SHORT if n > SHORT and self.moves else 0.0
        safe = mid if mid != 0 else 2.220446049250313e-16
        m60, m300, band = self.sum60 / min(n, SHORT), self.sum300 / min(n, LONG), math.sqrt(5 * var)
        span = (ts - self.times[0]) / 1000
        theta = 2 * math.pi * (ts % 3_600_000 // 1000) / 3600
        rsi = 50.0 if n <= RSI else 100.0 if self.loss == 0 else 100 - 100 / (1 + self.gain / self.loss)
        return [
            *ret, spread, math.sqrt(var), band, spread / safe * 1e4 if abs(safe) > TINY else 0.0, 0.0, (mid - m60) / safe, (mid - m300) / safe, (mid - m300 + 2 * band) / (4 * band) if band > 0 else 0.5,
            min(n, SHORT) / span if span > 1e-9 else 0.0, (self.high[0][1] - self.low[0][1]) / safe if n >= SHORT else 0.0, math.sin(theta), math.cos(theta), rsi, self.atr, macd, self.signal - macd,
        ]

    def state(self) -> tuple:
        return self.n, list(self.mids), list(self.times), [self.gain, self.loss, self.fast, self.slow, self.atr, self.signal]


def _log(x: float, before: float) -> float:
    return math.log(x / before) if x > 0 and before > 0 else 0.0


def tick_stream(ticks: DataFrame, tie: str = "event_id", warm_up: int = LONG) -> DataFrame:
    """
    tick_features() on a stream (R4): instrument, ts_ms, `tie`, bid, ask, mid and the tick vector, from each instrument's `warm_up`-th tick
    on. ticks may have the book's columns beside them, as a stream joined with books has; else they are 0. Rows of a micro-batch are
    taken in order; a row that comes in a later batch than its successor is taken when it comes.
    """
    books = [c for c in BOOK if c in ticks.columns]
    given = ["ts_ms", tie, "bid", "ask", "mid"]
    types = {f.name: f.dataType.simpleString() for f in ticks.schema}
    out = ", ".join(f"{c} {types[c]}" for c in ["instrument", *given]) + ", " + ", ".join(f"{c} double" for c in [*NAMES, *BOOK])

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        window = _Window(*(held.get if held.exists else (0, [], [], [0.0] * 6)))
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts_ms", tie]).to_dict("records"):
            vector = window.push(r["ts_ms"], r["bid"], r["ask"], r["mid"])
            if window.n >= warm_up:
                rows.append([*key, *(r[c] for c in given), *vector, *(r[c] if c in books and r[c] == r[c] else 0.0 for c in BOOK)])
        held.update(window.state())
        yield pd.DataFrame(rows, columns=["instrument", *given, *NAMES, *BOOK])

    return ticks.select("instrument", *given, *books).groupBy("instrument").applyInPandasWithState(run, out, "n long, mids array<double>, times array<long>, running array<double>", "append", GroupStateTimeout.NoTimeout)
