"""Partial aggregates of time blocks, and range aggregates answered from them.

A block holds count, sum, maximum and minimum of each number column.  A range
takes whole blocks from the roll-up and scans only the rows of the blocks at its
two edges, and rows that are in no roll-up yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.predicates import in_span, key_is, type_of, window_start
from tempora.model import BLOCK, OWN, AggregateRequest, Aggregator, Names, Span


def numbers(df: DataFrame, names: Names) -> list[str]:
    kinds = (T.IntegerType, T.LongType, T.DoubleType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in (names.key, names.ts) and not f.name.startswith(OWN)]


def _named(column: str) -> list[str]:
    return [f"{OWN}{part}_{column}" for part in ("n", "sum", "max", "min")]


def _parts(df: DataFrame, column: str) -> list:
    col = F.col(column)
    real = isinstance(type_of(df, column), T.DoubleType)
    known = F.when(~F.isnan(col), col) if real else col
    values = F.count(col), F.sum(col if real else col.cast("long")), F.max(known), F.min(known)
    return [v.alias(name) for v, name in zip(values, _named(column), strict=True)]


def build_rollup(df: DataFrame, names: Names, block_ms: int, *also: str) -> DataFrame:
    """(also..., key, block, parts...): block is the start in ms, a multiple of `block_ms`."""
    parts = [p for c in numbers(df, names) for p in _parts(df, c)]
    block = window_start(df, names, 0, block_ms)
    return df.withColumn(BLOCK, block).groupBy(*also, names.key, BLOCK).agg(F.count("*").alias(f"{OWN}rows"), *parts)


def rollup_aggregate(
    df: DataFrame, rollup: DataFrame, block_ms: int, request: AggregateRequest, names: Names = Names(), buckets: int | None = None, beside: DataFrame | None = None
) -> DataFrame:
    """The same result as aggregate() over `df` and `beside`, for `rollup` built over the rows of `df`."""
    column, span = request.column, request.span
    if column not in numbers(df, names):
        raise ValueError(f"{column!r} holds no numbers")
    first, last = -(-span.lower // block_ms) * block_ms, span.upper // block_ms * block_ms
    if first >= last:
        edges, inner = in_span(df, names, span), None
    else:
        edges, inner = F.lit(False), (F.col(BLOCK) >= first) & (F.col(BLOCK) < last)
        for a, b in ((span.lower, first), (last, span.upper)):
            if a < b:
                edges = edges | in_span(df, names, Span(a, b))

    def mine(rows: DataFrame) -> DataFrame:
        return rows if request.key is None else rows.filter(key_is(rows, names, request.key, buckets))

    wanted = _named(column)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(names.key).agg(*_parts(rows, column)).select(names.key, *wanted)

    parts = summed(mine(df).filter(edges))
    if beside is not None:
        parts = parts.unionByName(summed(mine(beside).filter(in_span(beside, names, span))))
    if inner is not None:
        parts = parts.unionByName(mine(rollup).filter(inner).select(names.key, *wanted))
    n, total, most, least = wanted
    value = {Aggregator.MAX: F.max(most), Aggregator.MIN: F.min(least), Aggregator.AVG: F.sum(total) / F.sum(n)}[request.aggregator]
    counted = parts.filter(F.col(n) > 0).groupBy(names.key).agg(value.alias(column)).filter(F.col(column).isNotNull())
    return counted.select(names.key, F.lit(span.lower).cast("long").alias(names.ts), column)
