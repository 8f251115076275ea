"""The best set of intervals that don't overlap, in series of any length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept
from .asof import asof_join
from .positions import FAN, chained
from .rolling import number_rows

#: Rows of a task's block. END is the place behind the last row.
BLOCK, END = 1 << 12, 1 << 62


def _crossings(pdf: pd.DataFrame) -> pd.DataFrame:
    """
    A block's rows at which paths enter it, each with the best path to every exit. An exit is left out if an earlier one is worth as
    much: from there all that the later one reaches can be reached.
    """
    pdf = pdf.sort_values("_rn", ignore_index=True)
    rn, to, worth = pdf["_rn"].to_numpy(), pdf["_to"].tolist(), pdf["_w"].tolist()
    targets = np.concatenate(to)
    exits = np.unique(targets[targets > rn[-1]])
    best = np.full((len(rn), len(exits)), -1, np.int64)  # -1: no path
    for i in range(len(rn) - 1, -1, -1):
        for t, w in zip(to[i], worth[i], strict=True):
            if t > rn[-1]:
                j = np.searchsorted(exits, t)
                best[i, j] = max(best[i, j], w)
            else:
                further = best[np.searchsorted(rn, t)]
                np.maximum(best[i], np.where(further >= 0, further + w, -1), out=best[i])
    entered = np.flatnonzero(pdf["_enter"].to_numpy(bool))
    paths = best[entered]
    before = np.maximum.accumulate(np.hstack([np.full((len(entered), 1), -1), paths]), axis=1)[:, :-1]
    pick = paths > before
    out = pdf.iloc[entered].drop(columns=["_block", "_enter"])
    return out.assign(_to=[exits[p].tolist() for p in pick], _w=[v[p].tolist() for v, p in zip(paths, pick, strict=True)])


def _solved(pdf: pd.DataFrame, exits: pd.DataFrame) -> pd.DataFrame:
    """The worth of what follows from each of a block's rows, and which of its ways is the best, given that of the exits."""
    pdf = pdf.sort_values("_rn", ignore_index=True)
    best = dict(zip(exits["_at"].tolist(), exits["_best"].tolist(), strict=True)) | {END: 0}
    way = np.zeros(len(pdf), np.int32)
    for i, rn, to, worth in zip(range(len(pdf) - 1, -1, -1), reversed(pdf["_rn"].tolist()), reversed(pdf["_to"].tolist()), reversed(pdf["_w"].tolist())):
        totals = [w + best[t] for t, w in zip(to.tolist(), worth.tolist(), strict=True)]
        best[rn] = max(totals)
        way[i] = totals.index(best[rn])
    return pdf.assign(_best=[best[r] for r in pdf["_rn"].tolist()], _way=way).drop(columns=["_block", "_to", "_w"])


def best_schedule(intervals: DataFrame, score: str, by: list[str], start: str = "ts_ms", end: str = "t1_ms", tie: list[str] | None = None, block: int = BLOCK, slice_ms: int = 86_400_000) -> DataFrame:
    """
    Of each key's intervals those that don't overlap (one may start where another ends) and have the greatest sum of `score`, a whole
    number. Of sets of equal sums the one that takes the first interval in the order of (start, end, tie) at which they differ. Intervals
    without a key, a start, an end or a score, that end before they start or have a negative score take no part.

    From each interval one may go on to the next (worth nothing), or take it and go on to the first that starts at or after its end; the
    best set is the most valuable path. Blocks of numbered intervals turn, each on its own, into the best paths from where one may enter
    them to where one may leave them; only these rows go on to the next level, whose blocks span FAN times as many. From the top down
    each block then learns what its exits are worth. Rows at which a block is left are as many as intervals are open there (at most its own
    rows); a task holds its rows times these.
    """
    whole = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)) & (F.col(score) >= 0))
    rows = kept(number_rows(whole, by, start, [end, *(tie or [])], slice_ms, "_rn"))
    place = rows.select(*by, start, F.col("_rn").alias("_next"))
    ends = rows.select(*by, "_rn", F.col(score).cast("long").alias("_s"), F.col(end).alias(start))
    ahead = asof_join(ends, place, by, ["_next"], "forward", start, ["_next"], slice_ms=slice_ms)
    most = F.max("_rn").alias("_most")
    sized = ahead.join(rows.groupBy(*by).agg(most), by)
    after = F.when(F.col("_rn") < F.col("_most"), F.col("_rn") + 1).otherwise(F.lit(END))
    jump = F.greatest(F.coalesce("_next", F.lit(END)), after)  # an interval of no length would point at itself
    nodes = kept(sized.select(*by, "_rn", F.array(jump, after).alias("_to"), F.array(F.col("_s"), F.lit(0).cast("long")).alias("_w")))
    schema, links, size, levels = nodes.schema, nodes, block, []
    length = rows.agg(most).first()[0] or 0
    at = lambda c, size: F.floor((F.col(c) - 1) / size)
    outside = lambda size: (F.col("_at") < END) & (at("_at", size) != F.col("_block"))
    while size < length:
        levels.append((nodes, size))
        cut = nodes.withColumn("_block", at("_rn", size))
        entries = cut.select(*by, "_block", F.explode("_to").alias("_at")).where(outside(size)).select(*by, F.col("_at").alias("_rn"))
        entries = entries.unionByName(nodes.where("_rn = 1").select(*by, "_rn")).distinct().withColumn("_enter", F.lit(True))
        marked = cut.join(entries, [*by, "_rn"], "left").fillna(False, ["_enter"])
        nodes, size = kept(marked.groupBy(*by, "_block").applyInPandas(_crossings, schema)), size * FAN
    worth = nodes.select(*by, "_rn", F.lit(0).cast("long").alias("_best"), F.lit(0).alias("_way")).where("false")
    for nodes, size in reversed([*levels, (nodes, size)]):
        cut = nodes.withColumn("_block", at("_rn", size))
        known = worth.select(*by, F.col("_rn").alias("_at"), "_best")
        exits = cut.select(*by, "_block", F.explode("_to").alias("_at")).where(outside(size)).distinct().join(known, [*by, "_at"])
        exits = exits.select(*(F.col(c).alias(c) for c in exits.columns))  # columns of their own, as both sides of the cogroup come from one table
        worth = kept(cut.groupBy(*by, "_block").cogroup(exits.groupBy(*by, "_block")).applyInPandas(_solved, worth.schema))
    chosen = links.join(worth, [*by, "_rn"]).select(*by, "_rn", F.get("_to", F.col("_way")).alias("_to"), (F.col("_way") == 0).alias("_taken"))
    chosen = kept(chosen.withColumn("_to", F.when(F.col("_to") < END, F.col("_to")).otherwise(F.lit(-1).cast("long"))))
    met = chained(chosen.select(*by, "_rn", "_to"), by, length)
    taken = chosen.where("_taken").join(met, [*by, "_rn"], "left_semi").select(*by, "_rn")
    return rows.join(taken, [*by, "_rn"], "left_semi").select(*intervals.columns)
