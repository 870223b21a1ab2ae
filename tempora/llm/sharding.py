"""Minimax contiguous partition into shards of near-equal bytes.

Groups of equal texts are atoms, ordered by the SHA-256 of the text.  The
smallest capacity that lets a greedy pass put all atoms into the shards is
found by bisection.  The pass works on cells of the digest order: at most
4096 at first, and only cells in which some cut can lie are split further, so
what the driver holds does not grow with the rows.  Under that capacity the
cuts then lie as near to even shares as the rest still fits.

A row's size is its text's UTF-8 bytes plus 1; null text has no bytes and is in
one group with empty text.  Repeated rows are rows of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import kept

#: Hex digits by which cells are split at a time.
DIGITS = 3
#: Buckets of rows inside a shard; slots are counted inside each.
BUCKETS = 1024


def _reach(ends: list[int], start: int, capacity: int) -> int:
    """The furthest cell end that is at most `capacity` after `start`."""
    return ends[i - 1] if (i := bisect_right(ends, start + capacity)) else 0


def _path(ends: list[int], start: int, shards: int, capacity: int) -> list[int]:
    cuts = []
    for _ in range(shards):
        start = max(start, _reach(ends, start, capacity))
        cuts.append(start)
    return cuts


def _smallest(ends: list[int], shards: int, low: int) -> int:
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _path(ends, 0, shards, middle)[-1] == ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _cells(groups: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
    rows = groups.groupBy(F.substring("digest", 1, digits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return {r.cell: (r.bytes, r.n) for r in rows.collect()}


def shard_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Capacity and the digest prefixes at which the shards after the first begin, from `groups` (digest, bytes)."""
    most = groups.agg(F.max("bytes")).first()[0]
    if most is None:
        return 0, []
    cells, digits = _cells(groups, DIGITS), DIGITS
    while True:
        names = sorted(cells)
        ends = list(accumulate(cells[x][0] for x in names))
        low = max(most, -(-ends[-1] // shards))
        high = _smallest(ends, shards, low)
        slack = _path(ends, 0, shards, low)
        windows = [(slack[j], min(ends[-1], (j + 1) * high)) for j in range(shards)]
        split = [x for x, end in zip(names, ends, strict=True) if cells[x][1] > 1 and len(x) == digits and any(end - cells[x][0] < b and end > a for a, b in windows)]
        if not split or low == high:
            break
        digits += DIGITS
        found = _cells(groups.filter(F.substring("digest", 1, digits - DIGITS).isin(split)), digits)
        for x in split:
            del cells[x]
        cells |= found
    capacity, start, cuts = high, 0, []
    for left in range(shards, 1, -1):
        even = start + (ends[-1] - start) / left
        i = bisect_left(ends, even)
        near = sorted({ends[min(i, len(ends) - 1)], ends[max(i - 1, 0)]}, key=lambda e: abs(e - even))
        fits = [e for e in near if start <= e <= start + capacity and _path(ends, e, left - 1, capacity)[-1] == ends[-1]]
        start = fits[0] if fits else max(start, _reach(ends, start, capacity))
        cuts.append(start)
    begins = [names[bisect_right(ends, c)] if c < ends[-1] else "g" for c in cuts]  # "g" comes after every digest
    return capacity, begins


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row for each of `docs`: doc_id, size, text_crc32, shard, and slot, gapless in each shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest")))
    _, begins = shard_cuts(kept(rows.groupBy("digest").agg(F.sum("size").alias("bytes"))), shards)
    shard = sum((F.when(F.col("digest") >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(BUCKETS)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), bucket.alias("bucket"))
    # At most shards * BUCKETS rows, whatever the input.
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return placed.withColumn("place", F.row_number().over(order)).join(F.broadcast(before), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def op4_minimax_shards(spark, sf_dir) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
