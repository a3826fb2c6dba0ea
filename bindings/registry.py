"""Registry of queries and of the logical tables they read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings.tables import DEALT, DRIVER_TABLES, LOGICAL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PLACE = re.compile(r"\{(\w+)\}")
_EPOCH_US = re.compile(r"EPOCH_US\((\w+)\)")


def _dialect(sql: str, spark: bool) -> str:
    """The two spellings that differ between the engines."""
    sql = _EPOCH_US.sub(r"unix_micros(CAST(\1 AS TIMESTAMP))" if spark else r"epoch_us(\1)", sql)
    return sql.replace("JSON_TEXT(", "get_json_object(" if spark else "json_extract_string(")


class Tables:
    """Driver tables and logical tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        known = self.__dict__["_known"]
        if name not in known:
            if name in DRIVER_TABLES:
                known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in LOGICAL:
                known[name] = self._logical(name)
            else:
                raise AttributeError(name)
        return known[name]

    def _logical(self, name: str, **instead: DataFrame) -> DataFrame:
        sql = _dialect(LOGICAL[name], spark=True)
        return self.spark.sql(sql, **{n: instead[n] if n in instead else getattr(self, n) for n in set(_PLACE.findall(sql))})

    def dealt(self, name: str) -> DataFrame:
        """The same table, for jobs that join many of its columns by `DEALT`: rows are shuffled, not the wider sums of few."""
        source, *keys = DEALT[name]
        return self._logical(name, **{source: getattr(self, source).repartition(*map(F.expr, keys))})


def _needed(sql: str, order: list[str]) -> list[str]:
    for name in dict.fromkeys(_PLACE.findall(sql)):
        if name in LOGICAL and name not in order:
            _needed(LOGICAL[name], order)
            order.append(name)
    return order


def oracle_text(sql: str) -> str:
    """SQL with its logical tables as leading common table expressions."""
    parts = [f"{n} AS ({_PLACE.sub(r'\1', _dialect(LOGICAL[n], spark=False))})" for n in _needed(sql, [])]
    body = _PLACE.sub(r"\1", sql).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def _plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that both engines show them alike."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out.append(F.col(f"`{f.name}`").cast("string").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(f"`{f.name}`", "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(out)


def query(name: str, sql: str | None = None):
    """Register `f(tables) -> DataFrame` under a name, with its SQL twin if there is one."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: _plain(f(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def r6(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0e0)"


def ts_text(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def d_text(expression: str) -> str:
    return f"CAST(CAST({expression} AS DATE) AS VARCHAR)"
