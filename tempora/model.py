"""What a caller asks for: requests, aggregators and value filters, checked when made."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

#: What stands for "data, but all filtered out".
NO_INTEGER, NO_DOUBLE = -2147483648, float("-inf")

#: The column types of a series and their Spark types.
STRING, INTEGER, DOUBLE = "STRING", "INTEGER", "DOUBLE"
TYPES = {STRING: T.StringType(), INTEGER: T.IntegerType(), DOUBLE: T.DoubleType()}


#: Columns that a store and its roll-up add begin with this; no column of a table may.
OWN = "tempora_"
BUCKET, BLOCK = f"{OWN}bucket", f"{OWN}block"


class Aggregator(Enum):
    AVG = "avg"
    MAX = "max"
    MIN = "min"


class Compare(Enum):
    EQUAL = "="
    GREATER = ">"


@dataclass(frozen=True)
class ValueFilter:
    """A comparison of a column's value with one literal (int, float or str)."""

    op: Compare
    literal: int | float | str


@dataclass(frozen=True)
class Names:
    """The key and time columns of a table."""

    key: str = "key"
    ts: str = "ts"


@dataclass(frozen=True)
class Span:
    """Milliseconds from `lower`, included, to `upper`, excluded."""

    lower: int
    upper: int

    def __post_init__(self):
        if self.lower >= self.upper:
            raise ValueError(f"empty span: {self.lower} >= {self.upper}")


@dataclass(frozen=True)
class LatestRequest:
    """Latest rows of `keys`, one for each time a key is named; None: of every key.  No columns: all.

    Of rows at one key's latest time the one counts whose other columns are least, taken in order, nulls first.
    """

    keys: tuple | None = None
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class RangeRequest:
    """Rows of one key in a span.  No columns: all."""

    key: object
    span: Span
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class AggregateRequest:
    """One column over a span; key None: every key for itself."""

    column: str
    aggregator: Aggregator
    span: Span
    key: object = None


@dataclass(frozen=True)
class DownsampleRequest:
    """One column over windows of `interval` ms from the span's start; key None: every key for itself."""

    column: str
    aggregator: Aggregator
    span: Span
    interval: int
    where: ValueFilter | None = None
    key: object = None

    def __post_init__(self):
        if self.interval <= 0 or (self.span.upper - self.span.lower) % self.interval:
            raise ValueError(f"interval {self.interval} does not divide the span")
