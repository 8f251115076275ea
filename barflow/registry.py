"""All queries of the library outside the corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import files, market, models, positions, records, research, scalars, ticks, trades

MODULES = (market, ticks, trades, positions, scalars, models, records, research, files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their windows, from ticks."""
    return market.w1_w17_price_windows(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in MODULES for n, f in m.P.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.P.sql.items()}
