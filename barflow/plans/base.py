"""What all plan modules share: registration, rounding, SQL with a table expression in front."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Plans:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, *tables: str):
        """Registers a query under its function's name. tables: table expressions that its SQL starts with."""

        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = ("WITH RECURSIVE " + ", ".join(tables) + " " if tables else "") + sql
            return f

        return put


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, digits) + F.lit(0.0)  # no negative zero
    return out.alias(name or c) if name or isinstance(c, str) else out


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
