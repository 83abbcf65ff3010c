"""Query registry: a Spark plan and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.views import VIEWS, Tables, sources_of, tables
from ledgerloom.session import cut_lineage

_STAGES: dict = {}


def stage(name):
    """A stage several queries read: written once per folder and application, as a job would write it."""

    def wrap(fn):
        def once(t):
            key = (t.spark.sparkContext.applicationId, t.folder, name)
            if key not in _STAGES:
                _STAGES[key] = cut_lineage(fn(t))
            return _STAGES[key]

        return once

    return wrap


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a DuckDB statement with the CTEs of the views it names."""
    needed = sources_of(sql)
    ctes = [f"{n} AS (\n{VIEWS[n].duck}\n)" for n in needed]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def flat(df: DataFrame) -> DataFrame:
    """Plain output types: dates as text, money as double, arrays as joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "; ")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    """Register `fn(tables)` under `name`; `oracle` is DuckDB SQL over tables and views."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: flat(fn(tables(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add
