"""Literal rows for rules that the driver tables never trigger, for Spark and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


class Rows:
    """A small literal table: ``schema`` is a list of (column, Spark type)."""

    def __init__(self, schema: str, *rows: tuple):
        self.columns = [tuple(c.split(":", 1)) for c in schema.split()]
        self.rows = rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], ", ".join(f"`{n}` {t}" for n, t in self.columns))

    def sql(self, name: str) -> str:
        body = ", ".join("(" + ", ".join(f"CAST({_literal(v)} AS {_SQL[t]})" for v, (_, t) in zip(row, self.columns)) + ")" for row in self.rows)
        return f"{name}({', '.join(n for n, _ in self.columns)}) AS (VALUES {body})"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(_literal(v) for v in value) + "]"
    return "'" + value.replace("'", "''") + "'"
