"""The four reads, each one declarative plan, for one key or for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.predicates import bucket_of, in_span, key_is, keys_in, type_of, value_filter, window_start
from tempora.model import BUCKET, NO_DOUBLE, NO_INTEGER, OWN, AggregateRequest, Aggregator, DownsampleRequest, LatestRequest, Names, RangeRequest

#: Requested keys that are compared one by one at most, so that the scan skips other files, and that are broadcast at
#: most; more are joined by a shuffle.
FEW_KEYS, BROADCAST_KEYS = 1000, 100_000


def project(df: DataFrame, names: Names, columns: tuple[str, ...]) -> DataFrame:
    """Key, time and the named columns; none named: all."""
    wanted = columns or tuple(c for c in df.columns if c not in (names.key, names.ts) and not c.startswith(OWN))
    for c in wanted:
        type_of(df, c)
    return df.select(names.key, names.ts, *(c for c in dict.fromkeys(wanted) if c not in (names.key, names.ts)))


def latest(df: DataFrame, request: LatestRequest, names: Names = Names(), buckets: int | None = None) -> DataFrame:
    """The row of greatest time of each key; a requested key without rows is skipped, one named twice comes twice.

    Rows without key or time are in no series.  The greatest times are found from key and time alone, by hashing; only
    the rows at them are sorted, to settle ties.
    """
    rows, asked = df, None
    if request.keys is not None:
        kind, distinct = type_of(df, names.key), list(dict.fromkeys(request.keys))
        schema = T.StructType([T.StructField(names.key, kind)])
        asked = df.sparkSession.createDataFrame([(k,) for k in request.keys], schema)
        if 0 < len(distinct) <= FEW_KEYS:
            rows = rows.filter(keys_in(df, names, distinct, buckets))
        else:
            wanted, on = asked.distinct(), [names.key]
            if buckets and BUCKET in df.columns:
                # Joined on the bucket too, so that its values reach the scan when they are known.
                wanted, on = wanted.withColumn(BUCKET, bucket_of(F.col(names.key), buckets)), [names.key, BUCKET]
            rows = rows.join(F.broadcast(wanted) if len(distinct) <= BROADCAST_KEYS else wanted, on, "left_semi")
    top = last_rows(project(rows, names, request.columns), names)
    if asked is None:
        return top
    return top.join(F.broadcast(asked) if len(request.keys) <= BROADCAST_KEYS else asked, names.key).select(top.columns)


def last_rows(rows: DataFrame, names: Names) -> DataFrame:
    """One row for each key: that of its greatest time, of several the one whose other columns are least."""
    others = [c for c in rows.columns if c not in (names.key, names.ts)]
    times = rows.groupBy(names.key).agg(F.max(names.ts).alias(names.ts))
    at = rows.join(times, [names.key, names.ts])
    if not others:
        return at.distinct().select(rows.columns)
    first = F.min(F.struct(*others)).alias(f"{OWN}row")
    return at.groupBy(names.key, names.ts).agg(first).select(names.key, names.ts, f"{OWN}row.*").select(rows.columns)


def time_range(df: DataFrame, request: RangeRequest, names: Names = Names(), buckets: int | None = None) -> DataFrame:
    """Rows of one key from the span's lower bound up to, not including, its upper bound."""
    return project(df.filter(key_is(df, names, request.key, buckets) & in_span(df, names, request.span)), names, request.columns)


def _number(df: DataFrame, column: str) -> T.DataType:
    kind = type_of(df, column)
    if not isinstance(kind, (T.IntegerType, T.LongType, T.DoubleType)):
        raise ValueError(f"{column!r} holds no numbers")
    return kind


def folded(df: DataFrame, column: str, aggregator: Aggregator, counts: Column) -> Column:
    """AVG is a double; MAX and MIN keep the type and pass over NaN.  Null where no value counts."""
    kind, col = _number(df, column), F.col(column)
    if aggregator is not Aggregator.AVG:
        best = F.max if aggregator is Aggregator.MAX else F.min
        return best(F.when(counts & ~F.isnan(col), col) if isinstance(kind, T.DoubleType) else F.when(counts, col))
    value = F.when(counts, col)
    if isinstance(kind, T.DoubleType):
        return F.avg(value)
    # The exact sum of whole numbers, divided once.
    return F.sum(value.cast("long")) / F.count(value)


def _keyed(df: DataFrame, key, names: Names, buckets: int | None) -> DataFrame:
    return df if key is None else df.filter(key_is(df, names, key, buckets))


def aggregate(df: DataFrame, request: AggregateRequest, names: Names = Names(), buckets: int | None = None) -> DataFrame:
    """(key, ts, column): one row for each key with rows in the span, at the span's lower bound."""
    rows = _keyed(df.filter(in_span(df, names, request.span)), request.key, names, buckets)
    value = folded(df, request.column, request.aggregator, F.lit(True)).alias(request.column)
    out = rows.groupBy(names.key).agg(value).filter(F.col(request.column).isNotNull())
    return out.select(names.key, F.lit(request.span.lower).cast("long").alias(names.ts), request.column)


def sentinel(df: DataFrame, column: str, aggregator: Aggregator) -> Column:
    """What a window shows that has rows, none of which counts."""
    kind = _number(df, column)
    if aggregator is Aggregator.AVG or isinstance(kind, T.DoubleType):
        return F.lit(NO_DOUBLE)
    return F.lit(NO_INTEGER).cast(kind)


def downsample(df: DataFrame, request: DownsampleRequest, names: Names = Names(), buckets: int | None = None) -> DataFrame:
    """(key, ts, column): one row for each window with rows, at the window's start.

    The filter picks which values count, as FILTER does in SQL; it never drops a window.
    """
    rows = _keyed(df.filter(in_span(df, names, request.span)), request.key, names, buckets)
    counts = value_filter(df, request.column, request.where)
    value = F.coalesce(folded(df, request.column, request.aggregator, counts), sentinel(df, request.column, request.aggregator))
    start = window_start(df, names, request.span.lower, request.interval)
    windows = rows.withColumn("__start", start).groupBy(names.key, "__start").agg(value.alias(request.column))
    return windows.select(names.key, F.col("__start").alias(names.ts), request.column)
