"""What every operator of this subpackage takes from the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources.folders import new_folder

#: The place of a null id in any order: after all others.
LAST_ID = 2**63 - 1


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written once to a table in the shared folder, so that a lost executor costs no more than its own tasks.

    The table lives until the driver ends or tempora.sources.folders.clear_scratch() is called.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows with a number of their own, and its column.

    Ids may be null or repeated and whole rows may be equal, so no column tells
    one row from another.  The numbers are written with the rows: a task that
    runs again cannot give others.
    """
    name = free_name(df, "row")
    return kept(df.withColumn(name, F.monotonically_increasing_id())), name


def with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; those that `df` lacks are null."""
    has = {c.lower() for c in df.columns}
    return df.select(*((F.col(c) if c.lower() in has else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
