"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to floor(scale * x).  Vectors stand in blocks; a block
keeps, for each dimension, one bitmap for each bit of its values above the
block's least.  A query adds the bitmaps of its dimensions, shifted by the bits
of its own components, with carry-save bitmap arithmetic, and a negative
component adds complements.  The top rows are then selected from the most
significant slice of the sum downward; rows that tie at the boundary are
resolved by their exact scores and the smaller id.

Queries are blocks too: every block of queries meets every block of vectors
once, so nothing is broadcast.  Vectors that are null or hold null or non-finite
components take no part.  A vector of fewer dimensions has zeros in the others.
Rows of a query's own id are no candidates of it; repeated query rows count
once; a null id comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import parcels
from .session import LAST_ID, kept, shuffle_parts

SCALE, BLOCK, QUERIES = 64, 1 << 15, 256
_DDL = "kind int, body binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "query_id long, query_key long, vec_id long, score long"


class SlicedBlock:
    """Bit slices of integer vectors, rows in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, dims = self.values.shape
        self.words = -(-n // 64)
        low = self.values.min(0)
        above = self.values - low
        self.low = low
        self.bits = np.array([int(x).bit_length() for x in above.max(0)], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.bits)])
        # Slices, then their complements.
        self.slices = np.zeros((2, int(self.begin[-1]), self.words), np.uint64)
        for d in range(dims):
            for j in range(int(self.bits[d])):
                self.slices[0, self.begin[d] + j] = self._bitmap((above[:, d] >> j) & 1)
        self.slices[1] = ~self.slices[0]
        self.every = self._bitmap(np.ones(n, np.uint8))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray | None]:
        """Slices of each row's score, less a constant, least significant first."""
        dims = min(len(query), len(self.bits))
        weight, row, side = [], [], []
        for d in range(dims):
            q, n = int(query[d]), int(self.bits[d])
            for k in range(abs(q).bit_length()):
                if abs(q) >> k & 1:
                    weight += range(k, k + n)
                    row += range(self.begin[d], self.begin[d] + n)
                    side += [q < 0] * n
        weight, row, side = np.array(weight, np.int64), np.array(row, np.int64), np.array(side, np.int64)
        out: list[np.ndarray | None] = []
        carry = np.empty((0, self.words), np.uint64)
        w, top = 0, int(weight.max()) if len(weight) else -1
        while w <= top or len(carry):
            here = weight == w
            x = np.concatenate([carry, self.slices[side[here], row[here]]])
            carries = []
            while len(x) > 2:
                m = len(x) // 3
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                ab ^= c
                x = np.concatenate([ab, x[3 * m :]])
            if len(x) == 2:
                carries.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else None)
            carry = np.concatenate(carries) if carries else np.empty((0, self.words), np.uint64)
            w += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, best first."""
        sure, open_ = np.zeros(self.words, np.uint64), self.every.copy()
        a, b = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")
        for own in range(a, b):
            open_[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        for s in reversed(self.sums(query)):
            high = open_ & s if s is not None else np.zeros(self.words, np.uint64)
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                open_ = high
            else:
                sure |= high
                open_ = open_ & ~high
                if n == k:
                    open_[:] = 0
                    break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(open_)[: k - len(rows)]])
        dims = min(len(query), self.values.shape[1])
        scores = self.values[rows, :dims] @ query[:dims]
        order = np.lexsort((self.ids[rows], -scores))
        return self.ids[rows][order], scores[order]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(vectors: list) -> np.ndarray:
    dims = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _dump(kind: int, ids: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[int, bytes]:
    head = np.zeros(len(ids), [("id", "<i8"), ("key", "<i8")])
    head["id"], head["key"] = ids, keys
    return kind, parcels.pack(head, values.astype("<i8").tobytes())


def _load(body: bytes):
    head, rest = parcels.unpack(body, np.dtype([("id", "<i8"), ("key", "<i8")]))
    return head["id"], head["key"], np.frombuffer(rest, "<i8").reshape(len(head), -1)


def _blocks(kind: int, most: int):
    def run(batches):
        ids, keys, values = [], [], []

        def emit():
            k, body = _dump(kind, np.array(ids, np.int64), np.array(keys, np.int64), _matrix(values))
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary())], names=["kind", "body"])

        for b in batches:
            for i, key, v in zip(b.column("vec_id").to_pylist(), b.column("key").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids.append(i)
                keys.append(key)
                values.append(v)
                if len(ids) == most:
                    yield emit()
                    ids, keys, values = [], [], []
        if ids:
            yield emit()

    return run


def _meet(k: int):
    def run(batches):
        block = None
        for b in batches:
            for kind, body in zip(b.column("kind").to_pylist(), b.column("body").to_pylist(), strict=True):
                ids, keys, values = _load(body)
                if kind == 0:
                    block = SlicedBlock(ids, values)
                    continue
                out: list[list] = [[], [], [], []]
                for q, key, query in zip(ids.tolist(), keys.tolist(), values, strict=True):
                    found, scores = block.top(q, query, k)
                    for column, x in zip(out, ([q] * len(found), [key] * len(found), found.tolist(), scores.tolist()), strict=True):
                        column += x
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_FOUND)

    return run


def _numbered(blocks: DataFrame) -> DataFrame:
    """`blocks` with `number`, from 1.  Only their names, a long for each block, are ordered in one place; bodies join them."""
    names = blocks.select(F.col("name"), F.row_number().over(Window.orderBy("name")).alias("number"))
    return blocks.join(names, "name")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for each of `queries` over `vectors`, both (vec_id, embedding)."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        rows = df.filter(F.col("embedding").isNotNull()).filter(~bad)
        return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vec_id"), v.alias("v")).withColumn("key", F.xxhash64("v"))

    rows, asked = whole(vectors), whole(queries).dropDuplicates(["vec_id", "key"])
    n, q = rows.count(), asked.count()
    one = rows.repartition(max(1, -(-n // BLOCK))).mapInArrow(_blocks(0, BLOCK), _DDL)
    two = asked.repartition(max(1, -(-q // QUERIES))).mapInArrow(_blocks(1, QUERIES), _DDL)
    one, two = (kept(x.select("kind", "body", F.monotonically_increasing_id().alias("name"))) for x in (one, two))
    blocks, tasks = max(1, one.count()), shuffle_parts(spark)
    # Few blocks of vectors stand several times, each time for a share of the queries, so that all tasks have work.
    shares = max(1, min(-(-q // QUERIES), -(-2 * tasks // blocks)))
    one = _numbered(one).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("block", F.col("number"))
    two = _numbered(two).withColumns({"share": F.pmod("number", F.lit(shares)), "block": F.explode(F.sequence(F.lit(1), F.lit(blocks)))})
    cells = one.select("block", "share", "kind", "body").unionByName(two.select("block", "share", "kind", "body"))
    grid = cells.repartition(max(tasks, 1), "block", "share").sortWithinPartitions("block", "share", "kind").select("kind", "body")
    found = grid.mapInArrow(_meet(k), _FOUND_DDL)
    best = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    top = found.withColumn("rank", best).filter(F.col("rank") <= k)
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return top.select(back("query_id"), F.col("rank").cast("int").alias("rank"), back("vec_id"), "score")


def op9_top_k(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP9_SQL = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM t q JOIN t c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 20
"""
