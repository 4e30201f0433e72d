"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skybias.plans.check_tables import with_tables
from skybias.plans.domain import Domain, domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
NUDGE = "1e-9"  # lifts exact halves off the rounding edge, so that both engines round them alike


def finish(df: DataFrame, coarse: dict[str, int] | None = None) -> DataFrame:
    """Comparable output: zone-free timestamps, long integers, doubles rounded."""
    coarse, columns = coarse or {}, []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        digits = coarse.get(field.name, DIGITS)
        if isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.expr(f"round(`{field.name}` + {NUDGE}, {digits}) + 0D")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.DoubleType):
            c = F.expr(f"transform(`{field.name}`, x -> round(x + {NUDGE}, {digits}) + 0D)")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, tables: str = "", doubles: str = "", coarse: dict[str, int] | None = None):
    """Register a function of the domain under ``name``.

    ``sql`` is the DuckDB check over the named derived ``tables``; its ``doubles`` are rounded as in
    ``finish``. Without SQL only the rows are checked.
    """
    def register(build: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(build(domain(spark, sf_dir)), coarse)

        run.__name__ = run.__qualname__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f'round("{c}" + {NUDGE}, {(coarse or {}).get(c, DIGITS)}) + 0.0 AS "{c}"'
                                for c in doubles.split())
            body = f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS q" if rounded else sql
            ORACLES[name] = with_tables(tables.split(), body)
        return build

    return register
