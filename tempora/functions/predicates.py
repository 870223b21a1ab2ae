"""Column predicates over raw columns, so that they reach the Parquet scan."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.model import BUCKET, Compare, Names, Span, ValueFilter

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def type_of(df: DataFrame, column: str) -> T.DataType:
    """A column's type; an unknown column is an error."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}; there are {df.columns}")
    return df.schema[column].dataType


def moment(kind: T.DataType, ms: int) -> Column:
    """A literal of a time column's type at `ms` milliseconds."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestamp_ntz'{(_EPOCH + timedelta(milliseconds=ms)).replace(tzinfo=None).isoformat(sep=' ')}'")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_millis(F.lit(ms).cast("long"))
    if isinstance(kind, T.LongType):
        return F.lit(ms).cast("long")
    raise ValueError(f"no time column: {kind.simpleString()}")


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time column."""
    kind = type_of(df, ts)
    if isinstance(kind, T.LongType):
        return F.col(ts) * 1000
    if isinstance(kind, T.TimestampNTZType):
        # Counted as UTC whatever the session's zone.
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def in_span(df: DataFrame, names: Names, span: Span) -> Column:
    kind = type_of(df, names.ts)
    return (F.col(names.ts) >= moment(kind, span.lower)) & (F.col(names.ts) < moment(kind, span.upper))


def window_start(df: DataFrame, names: Names, lower: int, interval: int) -> Column:
    """Milliseconds at which the window of `interval` ms that holds a row begins, counted from `lower`."""
    offset = micros(df, names.ts) - F.lit(lower * 1000).cast("long")
    inside = F.pmod(offset, F.lit(interval * 1000).cast("long"))
    return F.lit(lower).cast("long") + ((offset - inside) / 1000).cast("long")


def value_filter(df: DataFrame, column: str, where: ValueFilter | None) -> Column:
    """Whether a row's value counts: a literal of another type matches nothing, NaN is not greater."""
    if where is None:
        return F.lit(True)
    kind, literal = type_of(df, column), where.literal
    own = {T.StringType: str, T.IntegerType: int, T.LongType: int, T.DoubleType: float}.get(type(kind))
    if where.op is Compare.GREATER and own is str:
        raise ValueError("GREATER is for numbers")
    if own is None or type(literal) is not own:
        return F.lit(False)
    col, lit = F.col(column), F.lit(literal).cast(kind)
    if where.op is Compare.EQUAL:
        return col == lit
    return (col > lit) & ~F.isnan(col) if own is float else col > lit


def key_is(df: DataFrame, names: Names, key, buckets: int | None = None) -> Column:
    """Exact equality with a key, and with its bucket where the table has buckets."""
    return keys_in(df, names, [key], buckets)


def keys_in(df: DataFrame, names: Names, keys: list, buckets: int | None = None) -> Column:
    """Whether a row's key is one of a few, and, where the table has buckets, its bucket one of theirs."""
    literals = [F.lit(k).cast(type_of(df, names.key)) for k in keys]
    same = F.col(names.key) == literals[0] if len(keys) == 1 else F.col(names.key).isin(literals)
    if buckets and BUCKET in df.columns:
        # Literals after constant folding, so that other buckets' folders are not listed.
        return same & F.col(BUCKET).isin([bucket_of(x, buckets) for x in literals])
    return same


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
