"""Arrays as rows (part, body): whole columns cross a shuffle as few large values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "part int, body binary"
_ARROW = pa.schema([("part", pa.int32()), ("body", pa.binary())])


def pack(rows: np.ndarray, tail: bytes = b"") -> bytes:
    """Bytes of a structured array, column after column, and of what follows it."""
    columns = b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)
    return zstandard.compress(len(rows).to_bytes(8, "little") + columns + tail, 1)


def unpack(body: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(body)
    n, at = int.from_bytes(raw[:8], "little"), 8
    rows = np.empty(n, dtype)
    for name in dtype.names:
        rows[name] = np.frombuffer(raw, dtype[name], n, at)
        at += n * dtype[name].itemsize
    return rows, raw[at:]


def gathered(bodies, dtype: np.dtype) -> np.ndarray:
    found = [unpack(x, dtype)[0] for x in bodies]
    return np.concatenate(found) if found else np.empty(0, dtype)


def dealt(rows: np.ndarray, part: np.ndarray):
    """Yield (part, its rows), each part's rows in their order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
        if b > a:
            yield int(part[a]), rows[order[a:b]]


def batch(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], schema=_ARROW)


def bodies(batches):
    """The bodies of a partition's rows."""
    for b in batches:
        yield from b.column("body").to_pylist()


def places(partitions: int) -> np.ndarray:
    """A number for each partition that repartition(partitions, column) puts there: one target each, so that a task sends no more parcels than there are partitions."""
    found = np.full(partitions, -1, np.int32)
    at, step = 0, max(64, 4 * partitions)
    while (found < 0).any():
        numbers = np.arange(at, at + step, dtype=np.int32)
        to = _spark_hash(numbers).astype(np.int64) % partitions
        first, index = np.unique(to, return_index=True)
        empty = found[first] < 0
        found[first[empty]] = numbers[index[empty]]
        at += step
    return found


def _spark_hash(numbers: np.ndarray) -> np.ndarray:
    """Spark's hash() of ints: 32-bit Murmur3 with seed 42."""
    word = np.uint32

    def turned(x, n):
        return (x << word(n)) | (x >> word(32 - n))

    h = word(42) ^ (turned(numbers.astype(word) * word(0xCC9E2D51), 15) * word(0x1B873593))
    h = turned(h, 13) * word(5) + word(0xE6546B64)
    h ^= word(4)
    h = (h ^ (h >> word(16))) * word(0x85EBCA6B)
    h = (h ^ (h >> word(13))) * word(0xC2B2AE35)
    return (h ^ (h >> word(16))).view(np.int32)


def hash_long(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64() of longs: XXH64 of eight bytes with seed 42, as unsigned numbers."""
    # The primes of the public algorithm.
    one, two, three = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    four, five = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    word = np.uint64

    def turned(v, n):
        return (v << word(n)) | (v >> word(64 - n))

    h = turned(x.astype(np.int64).view(word) * word(two), 31) * word(one)
    h = turned(h ^ word((42 + five + 8) % 2**64), 27) * word(one) + word(four)
    h = (h ^ (h >> word(33))) * word(two)
    h = (h ^ (h >> word(29))) * word(three)
    return h ^ (h >> word(32))


def spread(keys: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """One of `targets` for each 64-bit key."""
    x = keys.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    return targets[(x % np.uint64(len(targets))).astype(np.int64)]
