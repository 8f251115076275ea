"""
First-order recurrences y = a * y_before + b over long series.

Steps compose: a block of steps is one step (product of a, and what b's come to). Each block is solved once, from 0, together with what
its start would add to each row; blocks are stored, the few block steps of a series are chained, and each row adds its share of its
block's start. So the rows are read once, and no task sees more than one block of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept

BLOCK = 1 << 14


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row all steps up to it as one: products of a, and the values from a start of 0. Steps of 1, 2, 4, ... rows are joined."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] = b[d:] + a[d:] * b[:-d]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b


def ordered_scan(df: DataFrame, steps: dict[str, tuple[str, str]], by: list[str], rn: str = "rn", block: int = BLOCK, chained: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """
    steps: output column to the columns of a and b. Every series starts from 0, so its first row has its start value as b.
    Null a or b counts as a = 1, b = 0: the value is carried on. chained: to b of an output is added each named earlier output's value
    in the same row, times the column given for it; so a recurrence over others' results needs no second pass.
    """
    names, chained = list(steps), chained or {}
    share = {n: [m for m in names if m == n or any(m in share_of for share_of in _reach(n, chained))] for n in names}
    extra = [f"_{n}_of_{m}" for n in names for m in share[n]]
    blocked = df.withColumn("_block", F.floor((F.col(rn) - 1) / block))
    schema = T.StructType([*blocked.schema.fields, *(T.StructField(c, T.DoubleType()) for c in [*names, *extra])])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by(rn)
        value: dict[str, np.ndarray] = {}
        part: dict[str, dict[str, np.ndarray]] = {}
        for n in names:
            a, b = (table.column(c).to_pandas().astype("float64").to_numpy() for c in steps[n])
            skip = np.isnan(a) | np.isnan(b)
            a, b = np.where(skip, 1.0, a), np.where(skip, 0.0, b)
            own: dict[str, np.ndarray] = {}
            for other, factor in chained.get(n, {}).items():
                f = table.column(factor).to_pandas().astype("float64").to_numpy()
                b = b + f * value[other]
                for m, x in part[other].items():
                    own[m] = own.get(m, 0.0) + f * x
            product, value[n] = composed(a, b)
            part[n] = {m: composed(a, x)[1] for m, x in own.items()} | {n: product}
        for n in names:
            table = table.append_column(n, pa.array(value[n]))
        for n in names:
            for m in share[n]:
                table = table.append_column(f"_{n}_of_{m}", pa.array(part[n][m]))
        return table

    done = kept(blocked.groupBy(*by, "_block").applyInArrow(solve, schema))
    heads = done.groupBy(*by, "_block").agg(F.max_by(F.struct(*names, *extra), rn).alias("_h")).select(*by, "_block", "_h.*")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, start, rows = pdf.sort_values("_block"), dict.fromkeys(names, 0.0), []
        for r in pdf.to_dict("records"):
            rows.append([start[n] for n in names])
            start = {n: r[n] + sum(r[f"_{n}_of_{m}"] * start[m] for m in share[n]) for n in names}
        return pd.concat([pdf[[*by, "_block"]].reset_index(drop=True), pd.DataFrame(rows, columns=[f"_start_{n}" for n in names])], axis=1)

    keys = [blocked.schema[k] for k in [*by, "_block"]]
    starts = heads.groupBy(*by).applyInPandas(chain, T.StructType([*keys, *(T.StructField(f"_start_{n}", T.DoubleType()) for n in names)]))
    whole = {n: F.col(n) + sum((F.col(f"_{n}_of_{m}") * F.col(f"_start_{m}") for m in share[n]), F.lit(0.0)) for n in names}
    return done.join(starts, [*by, "_block"]).withColumns(whole).select(*df.columns, *names)


def _reach(n: str, chained: dict[str, dict[str, str]]) -> list[set[str]]:
    """The outputs that n's value takes up, directly and through others."""
    return [{m, *(x for r in _reach(m, chained) for x in r)} for m in chained.get(n, {})]
