"""Rows from CSV files of key, time in ms, and the other columns in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.model import Names

_BAD = "tempora_line"


def _lines(spark: SparkSession, path: str, schema: T.StructType, names: Names) -> DataFrame:
    """(file, line, row) of each line that is not blank; lines are tried whole, whatever columns are asked for."""
    fields = [T.StructField(f.name, T.LongType() if f.name == names.ts else f.dataType) for f in schema]
    kind = T.StructType([*fields, T.StructField(_BAD, T.StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    row = F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.input_file_name().alias("file"), F.col("value").alias("line"), row.alias("row"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, names: Names = Names()) -> DataFrame:
    """Rows of the lines that fit the schema; the time column is read as milliseconds.  rejected_lines() has the others."""
    good = _lines(spark, path, schema, names).filter(F.col(f"row.{_BAD}").isNull()).select("row.*").drop(_BAD)
    kind = schema[names.ts].dataType
    if isinstance(kind, T.LongType):
        return good
    moment = F.timestamp_millis(names.ts)
    return good.withColumn(names.ts, moment.cast(kind)).select(schema.names)


def rejected_lines(spark: SparkSession, path: str, schema: T.StructType, names: Names = Names()) -> DataFrame:
    """(file, line) for each line that read_csv() leaves out: too few or too many fields, or a value of another type."""
    return _lines(spark, path, schema, names).filter(F.col(f"row.{_BAD}").isNotNull()).select("file", "line")
