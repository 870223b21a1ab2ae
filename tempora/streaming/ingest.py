"""Continuous append from a landing folder, and windows over a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.functions.predicates import in_span, key_is, micros, value_filter
from tempora.model import DownsampleRequest, Names
from tempora.operators.reads import folded, sentinel
from tempora.sources.store import Table


def append_stream(rows: DataFrame, table: Table, checkpoint: str, dedupe: bool = False, every: str | None = None) -> StreamingQuery:
    """Start a query that appends each micro-batch once, also if it comes again after a failure.

    The table remembers the number of the last batch from `checkpoint`.  every: the time between batches, as "10 seconds",
    until the query is stopped; None: what is there now, then the query ends.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        table.append(batch, dedupe, (stream, number))

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def downsample_stream(rows: DataFrame, request: DownsampleRequest, late: str, names: Names = Names()) -> DataFrame:
    """(key, ts, column), ts in ms: the windows of a stream, as the batch read gives them; any kind of time column will do.

    Only rows of the request's key and span count.  Windows are closed once `late` has passed.
    """
    mine = rows.filter(in_span(rows, names, request.span))
    if request.key is not None:
        mine = mine.filter(key_is(mine, names, request.key))
    mine = mine.withColumn(names.ts, F.timestamp_micros(micros(mine, names.ts)))
    shift = request.span.lower % request.interval
    length = f"{request.interval} milliseconds"
    window = F.window(names.ts, length, length, f"{shift} milliseconds")
    counts = value_filter(mine, request.column, request.where)
    value = F.coalesce(folded(mine, request.column, request.aggregator, counts), sentinel(mine, request.column, request.aggregator))
    grouped = mine.withWatermark(names.ts, late).groupBy(names.key, window.alias("tempora_window")).agg(value.alias(request.column))
    return grouped.select(names.key, F.unix_millis("tempora_window.start").alias(names.ts), request.column)
