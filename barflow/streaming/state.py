"""Stateful operators of streams: rows of a key enter in order, and a small state is kept for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.research import FLAT, trade_step


def stateful(rows: DataFrame, by: list[str], order: list[str], step: Callable[[tuple, dict], tuple[tuple, list[tuple]]], start: tuple, state: str, out: str) -> DataFrame:
    """
    step(state, row) gives the next state and the rows to emit (without the key), for each row of a key in `order`. Rows of one
    micro-batch are sorted; a row that comes in a later batch than its successor is taken when it comes. state and out: schemas, `out`
    without the key, whose columns come first.
    """
    names = [c.split()[0] for c in out.split(", ")]
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        emitted = []
        for row in pd.concat(list(batches)).sort_values(order).to_dict("records"):
            now, more = step(now, row)
            emitted += [(*key, *m) for m in more]
        held.update(now)
        yield pd.DataFrame(emitted, columns=[*by, *names])

    return rows.groupBy(*by).applyInPandasWithState(run, f"{keys}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def trade_stream(bars: DataFrame, params: dict[str, float]) -> DataFrame:
    """
    trade_decisions() on a stream, for one set of parameters (R8). Their id is part of the key, so a query that starts with other
    parameters starts flat (R7). bars: instrument, params_id, ts_ms, close, p_long, p_short, sigma.
    """

    def step(now: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        now, done = trade_step(params, tuple(now), row["close"], row["p_long"], row["p_short"], row["sigma"])
        return now, [(row["ts_ms"], *done)]

    return stateful(bars, ["instrument", "params_id"], ["ts_ms"], step, FLAT, "side int, entry double, held int, wait int", "ts_ms long, action string, reason string, realized_r double")


def position_stream(fills: DataFrame, tie: str = "event_id") -> DataFrame:
    """positions() on a stream (R9). fills: instrument, ts_ms, units, price and `tie`, a long."""

    def step(now: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        (net, price), u, px = now, float(row["units"]), row["price"]
        if u == 0:
            return now, []
        after, gain = net + u, 0.0
        if net * u < 0:
            gain = min(abs(u), abs(net)) * (1 if net > 0 else -1) * (px - price)
        price = 0.0 if after == 0 else px if net == 0 or net * after < 0 else (price * net + px * u) / after if net * u > 0 else price
        return (after, price), [(row["ts_ms"], row[tie], after, price, gain)]

    return stateful(fills, ["instrument"], ["ts_ms", tie], step, (0.0, 0.0), "net double, price double", f"ts_ms long, {tie} long, net_units double, avg_price double, realized double")


def cooldown_stream(signals: DataFrame, cooldown_ms: int, tie: str = "event_id") -> DataFrame:
    """Of the signals that would move a position, those that aren't in the cooldown of the last one emitted."""

    def step(now: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        if row["units_delta"] == 0 or (now[0] is not None and row["ts_ms"] - now[0] < cooldown_ms):
            return now, []
        return (row["ts_ms"],), [(row["ts_ms"], row[tie], row["units_delta"])]

    return stateful(signals, ["instrument"], ["ts_ms", tie], step, (None,), "last long", f"ts_ms long, {tie} long, units_delta long")


def book_stream(deltas: DataFrame, tie: str = "event_id", levels: int = 20) -> DataFrame:
    """The book after each delta, once it has both sides (R11). The state is the live levels of one instrument."""

    def step(now: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        sides = {"bid": dict(zip(now[0], now[1], strict=True)), "ask": dict(zip(now[2], now[3], strict=True))}
        own = sides[row["side"]]
        if row["size"] > 0:
            own[row["price"]] = float(row["size"])
        else:
            own.pop(row["price"], None)
        bids, asks = sorted(sides["bid"].items(), reverse=True), sorted(sides["ask"].items())
        now = ([p for p, _ in bids], [s for _, s in bids], [p for p, _ in asks], [s for _, s in asks])
        top = tuple(part[:levels] for part in now)
        return now, [(row["ts_ms"], row[tie], *top)] if bids and asks else []

    four = "bid_px array<double>, bid_size array<double>, ask_px array<double>, ask_size array<double>"
    return stateful(deltas, ["instrument"], ["ts_ms", tie], step, ([], [], [], []), four, f"ts_ms long, {tie} long, {four}")


def skip_stream(decisions: DataFrame, most: int = 100, tie: str = "event_id") -> DataFrame:
    """compact_skips() on a stream: a run is emitted when an action ends it or it has `most` rows."""

    def step(now: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        first, last, n, reasons = now[0], now[1], now[2], dict(zip(now[3], now[4], strict=True))
        done = [(first, last, n, list(reasons), list(reasons.values()))] if n else []
        if row["action"] != "skip":
            return (0, 0, 0, [], []), done
        reasons[row["reason"]] = reasons.get(row["reason"], 0) + 1
        now = (first if n else row["ts_ms"], row["ts_ms"], n + 1, list(reasons), list(reasons.values()))
        return ((0, 0, 0, [], []), [now]) if n + 1 == most else (now, [])

    five = "first_ms long, last_ms long, n long, reasons array<string>, counts array<long>"
    return stateful(decisions, ["instrument"], ["ts_ms", tie], step, (0, 0, 0, [], []), five, five)


def rolling_stream(bars: DataFrame, length: int = 600, lags: tuple[int, ...] = (1, 5, 20, 60), tie: str = "ts_ms") -> DataFrame:
    """Log changes, deviation of one-bar changes and drawdown over each key's newest `length` closes, which are its state."""
    import math

    def step(now: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        closes = [*now[0], row["close"]][-length:]
        logs = [math.log(max(c, 1e-12)) for c in closes[-(max(lags) + 1) :]]
        back = [logs[-1] - logs[-1 - k] if len(logs) > k else 0.0 for k in lags]
        moves = [b - a for a, b in zip(logs, logs[1:], strict=False)]
        mean = sum(moves) / len(moves) if moves else 0.0
        sd = math.sqrt(sum((m - mean) ** 2 for m in moves) / (len(moves) - 1)) if len(moves) > 1 else 0.0
        return (closes,), [(row["ts_ms"], *back, sd, row["close"] / max(closes) - 1)]

    out = ", ".join(["ts_ms long", *(f"log_ret_{k} double" for k in lags), "vol double", "drawdown double"])
    return stateful(bars, ["instrument"], [tie], step, ([],), "closes array<double>", out)
