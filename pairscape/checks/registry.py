"""Registry of queries: a Spark function, its result columns and the SQL to compare with.

Result columns are written once, as ``name:type`` with ``i`` integer, ``s`` text,
``b`` boolean, ``d`` double rounded to six digits (``d3``: three digits).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .views import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def spark(self, spark, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[_spark_column(n, t) for n, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        select = ", ".join(_sql_column(n, t) for n, t in self.columns)
        inner = with_views(self.sql, "duck")
        return f"SELECT {select} FROM (\n{inner}\n) AS result"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, spec, build, sql)
        return build

    return register


def _spark_column(name: str, kind: str):
    col = F.col(f"`{name}`")
    if kind[0] == "d":
        return F.round(col.cast("double"), int(kind[1:] or 6)).alias(name)
    return col.cast({"i": "bigint", "s": "string", "b": "boolean"}[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind[0] == "d":
        return f'round(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + 0e0 AS "{name}"'
    return f'CAST("{name}" AS {dict(i="BIGINT", s="VARCHAR", b="BOOLEAN")[kind]}) AS "{name}"'
