"""Exact copies through a cuckoo-filter index of live digests.

Two texts are equal when they are after each run of white space became one
space.  An index holds short fingerprints in buckets of four; a hit is settled
against the whole digests that the two buckets keep, so no copy is guessed.
When an insertion finds no room, the index doubles and fills again from its
stored digests.  Digests can be deleted, which frees their slots.

Each task first passes its rows through an index of its own, so one digest
leaves a task once for each chunk, however many copies there are.

Null text is empty and a null doc_id comes after all others.  One row of each
group stays: where rows share its smallest doc_id, whole rows repeated included,
the one with the smallest row number, which any of them may be.  Whole digests
of 256 bits stand for the content.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import LAST_ID, kept, shuffle_parts, with_columns

#: Digests that one task's first index holds before it sends them on.
CHUNK = 1 << 19


class CuckooIndex:
    """Live digests with, for each, the least (id, row) and the number of rows."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1 << 10):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = bytearray(buckets * self.SLOTS)
        self.held: list = [None] * (buckets * self.SLOTS)
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = digest[0] or 1
        one = int.from_bytes(digest[1:8], "little") & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, digest: bytes):
        """What is held for a digest, or None: fingerprints first, then the whole digest."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            at, end = bucket * 4, bucket * 4 + 4
            at = self.marks.find(mark, at, end)
            while at >= 0:
                entry = self.held[at]
                if entry[0] == digest:
                    return entry
                at = self.marks.find(mark, at + 1, end)
        return None

    def add(self, digest: bytes, first: tuple[int, int], rows: int = 1) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[1] = min(entry[1], first)
            entry[2] += rows
            return
        self._insert([digest, first, rows])

    def _insert(self, entry: list) -> None:
        mark, one, two = self._places(entry[0])
        for turn in range(self.KICKS):
            for bucket in (one, two):
                at = self.marks.find(0, bucket * 4, bucket * 4 + 4)
                if at >= 0:
                    self.marks[at], self.held[at] = mark, entry
                    self.live += 1
                    return
            at = two * 4 + turn % 4
            entry, self.held[at] = self.held[at], entry
            mark, self.marks[at] = self.marks[at], mark
            one = two
            two = one ^ (mark * 0x5BD1E995 & self.mask)
        entries = [*self.entries(), entry]
        self._empty((self.mask + 1) * 2)
        for x in entries:
            self._insert(x)

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for at in range(bucket * 4, bucket * 4 + 4):
                if self.marks[at] == mark and self.held[at][0] == digest:
                    self.marks[at], self.held[at] = 0, None
                    self.live -= 1
                    return True
        return False

    def entries(self):
        return (x for x in self.held if x is not None)


_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_DDL = "digest binary, keep_id long, keep_row long, group_size long"


def _emit(index: CuckooIndex):
    found = list(index.entries())
    for at in range(0, len(found), 50_000):
        part = found[at : at + 50_000]
        columns = [x[0] for x in part], [x[1][0] for x in part], [x[1][1] for x in part], [x[2] for x in part]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _indexed(whole: bool):
    """One row for each digest of a partition; of each chunk of CHUNK digests, unless `whole`.  group_size -1 deletes."""

    def run(batches):
        index = CuckooIndex()
        for b in batches:
            for digest, id_, row, rows in zip(*(b.column(f.name).to_pylist() for f in _ARROW), strict=True):
                if rows >= 0:
                    index.add(digest, (id_, row), rows)
                else:
                    index.delete(digest)
            if not whole and index.live >= CHUNK:
                yield from _emit(index)
                index = CuckooIndex()
        yield from _emit(index)

    return run


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, row, digest): SHA-256 of the text with each run of white space as one space.

    `row` names the column of `docs` that tells its rows apart; without it rows are numbered as they are read.
    """
    own = with_columns(docs, doc_id="long", text="string", **({row: "long"} if row else {}))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    number = F.col(row) if row else F.monotonically_increasing_id()
    return own.select("doc_id", number.alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"))


def build_index(rows: DataFrame) -> DataFrame:
    """One row (digest, keep_id, keep_row, group_size) for each digest of `rows` (doc_id, digest, and row, or 0 for all)."""
    tasks = shuffle_parts(rows.sparkSession)
    id_ = F.coalesce("doc_id", F.lit(LAST_ID)).alias("keep_id")
    number = (F.col("row") if "row" in rows.columns else F.lit(0)).cast("long").alias("keep_row")
    one = rows.select("digest", id_, number, F.lit(1).cast("long").alias("group_size"))
    return one.mapInArrow(_indexed(False), _DDL).repartition(tasks, "digest").mapInArrow(_indexed(True), _DDL)


def update_index(index: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """An index without the digests of `deleted` (digest) and then with the rows of `added` (doc_id, row, digest)."""
    tasks = shuffle_parts(index.sparkSession)
    none = F.lit(0).cast("long")
    gone = deleted.select("digest", none.alias("keep_id"), none.alias("keep_row"), F.lit(-1).cast("long").alias("group_size"))
    every = [x.withColumn("step", F.lit(i)) for i, x in enumerate((index, gone, build_index(added)))]
    steps = every[0].unionByName(every[1]).unionByName(every[2])
    return steps.repartition(tasks, "digest").sortWithinPartitions("step").drop("step").mapInArrow(_indexed(True), _DDL)


def exact_dedup(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row for each of `docs`: doc_id, row, keep_id, group_size, kept, digest.

    The join with the index is by digest; a digest that a large share of the rows has is split by the adaptive
    skew join, since the index holds one row for it.
    """
    rows = kept(digests(docs, row))
    joined = rows.join(build_index(rows), "digest")
    keep = F.when(F.col("keep_id") != LAST_ID, F.col("keep_id"))
    return joined.select("doc_id", "row", keep.alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def op8_columns(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir) -> DataFrame:
    return op8_columns(exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t
"""
