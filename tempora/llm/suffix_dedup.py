"""Removal of repeated byte strings by bucket-pointer refinement.

Every 100-byte string that starts earlier too (in a row of smaller doc_id, or
earlier in the same text) loses its bytes.  The order of suffixes is never
built whole.  Each 100-byte window belongs to the bucket of one 32-byte gram in
it, chosen by content, so equal windows share a bucket.  Buckets are refined by
the identifiers of later offsets, 32 to 64 to 100 bytes, each from the one
before it:

1. `_cut`: runs of windows with one anchor are named by their first and last
   window's identifiers.  Of runs with one name only the first of each chunk
   leaves its task, so no bucket or name gathers more rows than there are
   chunks.
2. `_settle`: buckets meet.  A run whose name came earlier goes.  Runs of one
   bucket with other names may share some windows; these are refined further.
3. `_spell` and `_refine`: their bytes meet by bucket, or window by window
   where a bucket is very large, and windows are sorted by identifier.

Null text is empty.  Rows that share doc_id and text count as one document and
get one result.  Documents are in order of doc_id, null last, and those of one
doc_id, or of none, in order of their texts' hash; each is a document of its
own.  Texts under 100 bytes stay whole.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parcels
from .grams import FIRST, SECOND, WINDOW, mixed, segments
from .session import LAST_ID, kept, shuffle_parts, with_columns

#: Runs that a task holds before it sends on what it has; windows that it refines at a time.
CHUNK, SLICE = 1 << 20, 1 << 21
#: A bucket is very large from so many runs on, and from this share of its task's.
LARGE, SHARE = 2048, 16
#: Bytes of text that a task should hold.
PART_BYTES = 64 << 20

_ALONE, _GONE, _OPEN, _COUNT = range(4)
#: A document is doc, tag and more: its doc_id and 96 bits of its text's hash.
_DOC = [("doc", "<i8"), ("tag", "<u8"), ("more", "<u4")]
_OF = ("doc", "tag", "more")
_RUN = np.dtype([("bucket", "<u8"), ("name", "<u8"), *_DOC, ("pos", "<u4"), ("run", "<u4"), ("kind", "u1")])
_PLACE = np.dtype([("bucket", "<u8"), *_DOC, ("pos", "<u4"), ("run", "<u4"), ("kind", "u1")])
_WIN = np.dtype([("a", "<u8"), ("b", "<u8"), *_DOC, ("pos", "<u4")])


def _texts(ids, texts):
    """Documents (doc, tag, more), all bytes, and where each text starts and ends."""
    # Cast first: parts of a column that hold over 2 GB together do not fit 32-bit offsets.
    texts = (texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts)).cast(pa.large_binary())
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    docs, view = np.zeros(len(texts), _DOC), memoryview(data)
    docs["doc"] = np.asarray(ids.fill_null(LAST_ID)).astype(np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        docs["tag"][i] = xxhash.xxh64_intdigest(view[a:b], 42)
        docs["more"][i] = xxhash.xxh3_64_intdigest(view[a:b]) & 0xFFFFFFFF
    return docs, data, offsets[:-1], offsets[1:]


def _named(rows: np.ndarray, docs: np.ndarray) -> None:
    for key in _OF:
        rows[key] = docs[key]


def _keys(docs: np.ndarray):
    return zip(*(docs[key].tolist() for key in _OF), strict=True)


def _part_of(docs: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The same as _doc_part in Spark: documents spread evenly whatever their ids are, equal texts and null ids too."""
    return parts[np.mod((parcels.hash_long(docs["doc"]) ^ docs["tag"]).view(np.int64), len(parts))]


def _doc_part(parts: np.ndarray):
    targets = F.split(F.lit(",".join(map(str, parts.tolist()))), ",").cast("array<int>")
    mark = F.xxhash64(F.coalesce("doc_id", F.lit(LAST_ID))).bitwiseXOR(F.xxhash64(F.coalesce("text", F.lit(""))))
    return F.element_at(targets, (F.pmod(mark, F.lit(len(parts))) + 1).cast("int"))


def _ranked(rows: np.ndarray, keys: list[str]) -> np.ndarray:
    return rows[np.lexsort([rows[k] for k in reversed(keys)])]


def _new(rows: np.ndarray, *keys: str) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        out[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    return out


def _merged(rows: np.ndarray) -> np.ndarray:
    """Runs of windows that touch or overlap become one."""
    rows = _ranked(rows, [*_OF, "pos"])
    if len(rows) < 2:
        return rows
    end = rows["pos"].astype(np.int64) + rows["run"]
    # Runs have bounded length unless merged before, so a running maximum by text is needed.
    text = np.cumsum(_new(rows, *_OF)).astype(np.int64) << 33
    reach = np.maximum.accumulate(end + text)
    head = np.ones(len(rows), bool)
    head[1:] = rows["pos"][1:] + text[1:] > reach[:-1]
    at = np.flatnonzero(head)
    out = rows[at]
    out["run"] = np.maximum.reduceat(reach - text, at) - out["pos"]
    return out


def _again(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows at the place of the first of their name: a document that stands in several rows is no earlier place of its own."""
    lead = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return np.logical_and.reduce([rows[k] == rows[k][lead] for k in (*_OF, "pos")]) & ~first


def _resolved(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by bucket and name; which are first of their name; each bucket's number of names, at its rows."""
    rows = _ranked(rows, ["bucket", "name", *_OF, "pos"])
    first = _new(rows, "bucket", "name")
    bucket = np.cumsum(_new(rows, "bucket")) - 1
    again = _again(rows, first)
    rows, first, bucket = rows[~again], first[~again], bucket[~again]
    names = np.bincount(bucket, weights=first).astype(np.int64)
    return rows, first, names[bucket]


def _cut(parts: np.ndarray):
    def chunk(found: list[np.ndarray]) -> pa.RecordBatch:
        rows, first, names = _resolved(np.concatenate(found))
        gone = rows[~first]
        gone["kind"] = _GONE
        gone = _merged(gone)
        alone = rows[first & (names == 1)]
        many = rows[first & (names > 1)]
        count = many[_new(many, "bucket")]
        count["kind"], count["name"] = _COUNT, names[first & (names > 1)][_new(many, "bucket")]
        many["kind"] = _OPEN
        met, own = np.concatenate([alone, count]), np.concatenate([gone, many])
        own["name"] = 0
        every = np.concatenate([met, own])
        part = np.concatenate([parcels.spread(met["bucket"], parts), parcels.spread(own["doc"] ^ own["tag"].view(np.int64), parts)])
        return parcels.batch((p, parcels.pack(r)) for p, r in parcels.dealt(every, part))

    def run(batches):
        found, n = [], 0
        for b in batches:
            docs, data, starts, ends = _texts(b.column("doc_id"), b.column("text"))
            for at, length, bucket, name in segments(data, starts, ends):
                of = np.searchsorted(starts, at, side="right") - 1
                rows = np.empty(len(at), _RUN)
                _named(rows, docs[of])
                rows["bucket"], rows["name"], rows["pos"] = bucket, name, at - starts[of]
                rows["run"], rows["kind"] = length, _ALONE
                found.append(rows)
                n += len(rows)
                if n >= CHUNK:
                    yield chunk(found)
                    found, n = [], 0
        if n:
            yield chunk(found)

    return run


def _settle(parts: np.ndarray):
    def run(batches):
        rows = parcels.gathered(parcels.bodies(batches), _RUN)
        if not len(rows):
            return
        done = rows[(rows["kind"] == _GONE) | (rows["kind"] == _OPEN)]
        counts = rows[rows["kind"] == _COUNT]
        rows, first, names = _resolved(rows[rows["kind"] == _ALONE])
        marked = np.isin(rows["bucket"], counts["bucket"])
        gone, many = rows[~first], rows[first & ((names > 1) | marked)]
        gone["kind"], many["kind"] = _GONE, _OPEN
        every = np.concatenate([np.concatenate([done, many, gone])[list(_PLACE.names)]]).astype(_PLACE)
        sizes = np.concatenate([counts[["bucket", "name"]], many[["bucket", "name"]]])
        sizes["name"][len(counts) :] = 1
        sizes = _ranked(sizes, ["bucket"])
        if len(sizes):
            at = np.flatnonzero(_new(sizes, "bucket"))
            total = np.add.reduceat(sizes["name"], at)
            large = sizes["bucket"][at][total > max(LARGE, (len(rows) + int(counts["name"].sum())) // SHARE)]
        else:
            large = np.empty(0, np.uint64)
        marks = np.zeros(len(large), _PLACE)
        marks["bucket"], marks["kind"] = large, _COUNT
        open_ = every["kind"] == _OPEN
        every = np.concatenate([_merged(every[~open_]), every[open_]])
        home = [(p, parcels.pack(r)) for p, r in parcels.dealt(every, _part_of(every, parts))]
        yield parcels.batch(home + ([(-1, parcels.pack(marks))] if len(marks) else []))

    return run


def _by_text(docs: np.ndarray) -> dict:
    rows: dict = {}
    for i, key in enumerate(_keys(docs)):
        rows.setdefault(key, i)
    return rows


def _bytes_of(data: np.ndarray, at: np.ndarray, runs: np.ndarray) -> bytes:
    """The bytes of runs of windows, one after another."""
    return b"".join(data[a : a + n].tobytes() for a, n in zip(at.tolist(), (runs + (WINDOW - 1)).tolist(), strict=True))


def _spell(parts: np.ndarray, large: list[int]):
    hot = np.array(sorted(large), np.uint64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = parcels.gathered(right.column("body").to_pylist(), _PLACE)
        rows = rows[rows["kind"] == _OPEN]
        if not len(rows) or not left.num_rows:
            return pa.Table.from_batches([parcels.batch([])])
        docs, data, starts, _ = _texts(left.column("doc_id"), left.column("text"))
        where = _by_text(docs)
        at = np.array([starts[where[k]] for k in _keys(rows)], np.int64) + rows["pos"]
        many = np.isin(rows["bucket"], hot)
        out = []
        few, lo = rows[~many], at[~many]
        for p, index in parcels.dealt(np.arange(len(few)), parcels.spread(few["bucket"], parts)):
            out.append((p, b"s" + parcels.pack(few[index], _bytes_of(data, lo[index], few["run"][index]))))
        if many.any():
            wins, first = _first_windows(_windows(rows[many], _bytes_of(data, at[many], rows["run"][many])))
            out += [(p, b"w" + parcels.pack(r)) for p, r in parcels.dealt(wins[first], parcels.spread(wins["a"][first], parts))]
            gone = wins[~first]
            out += [(p, b"g" + parcels.pack(r)) for p, r in parcels.dealt(gone, _part_of(gone, parts))]
        return pa.Table.from_batches([parcels.batch(out)])

    return run


def _windows(rows: np.ndarray, body: bytes) -> np.ndarray:
    """The windows of runs whose bytes stand one after another in `body`."""
    data = np.frombuffer(body, np.uint8)
    run = rows["run"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(run + WINDOW - 1)[:-1]])
    step = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    at = np.repeat(begin, run) + step
    out = np.empty(len(at), _WIN)
    lo, block = 0, 1 << 18
    for lo in range(0, len(data) - WINDOW + 1, block):
        part = data[lo : lo + block + WINDOW - 1]
        i, j = np.searchsorted(at, lo), np.searchsorted(at, min(lo + block, len(data) - WINDOW + 1))
        if j > i:
            out["a"][i:j] = FIRST.windows(part)[at[i:j] - lo]
            out["b"][i:j] = SECOND.windows(part)[at[i:j] - lo]
    for key in _OF:
        out[key] = np.repeat(rows[key], run)
    out["pos"] = np.repeat(rows["pos"], run) + step
    return out


def _first_windows(wins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by identifier and place, and which are the first of their identifier."""
    wins = _ranked(wins, ["a", "b", *_OF, "pos"])
    first = _new(wins, "a", "b")
    same = _again(wins, first)
    return wins[~same], first[~same]


def _some(rows: np.ndarray, body: bytes, which: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Some of the runs whose bytes stand in `body`, with theirs."""
    if which.all():
        return rows, body
    run = rows["run"].astype(np.int64) + (WINDOW - 1)
    begin = np.cumsum(run) - run
    return rows[which], _bytes_of(np.frombuffer(body, np.uint8), begin[which], rows["run"][which].astype(np.int64))


def _runs_of(wins: np.ndarray) -> np.ndarray:
    rows = np.zeros(len(wins), _PLACE)
    _named(rows, wins)
    rows["pos"], rows["run"], rows["kind"] = wins["pos"], 1, _GONE
    return _merged(rows)


def _refine(parts: np.ndarray):
    def run(batches):
        held, wins, lost, n = [], [np.empty(0, _WIN)], [np.empty(0, _PLACE)], 0
        for body in parcels.bodies(batches):
            kind, body = body[:1], body[1:]
            if kind == b"s":
                held.append(parcels.unpack(body, _PLACE))
                n += int(held[-1][0]["run"].sum())
            elif kind == b"w":
                wins.append(parcels.unpack(body, _WIN)[0])
            else:
                lost.append(_runs_of(parcels.unpack(body, _WIN)[0]))
        found, first = _first_windows(np.concatenate(wins))
        lost.append(_runs_of(found[~first]))
        # Equal windows share a bucket, so some buckets at a time are enough.
        slices = max(1, -(-n // SLICE))
        for turn in range(slices):
            some = [_some(rows, body, rows["bucket"] % np.uint64(slices) == turn) for rows, body in held]
            found, first = _first_windows(np.concatenate([np.empty(0, _WIN), *(_windows(*x) for x in some if len(x[0]))]))
            lost.append(_runs_of(found[~first]))
        rows = _merged(np.concatenate(lost))
        if len(rows):
            yield parcels.batch((p, parcels.pack(r)) for p, r in parcels.dealt(rows, _part_of(rows, parts)))

    return run


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])
_OUT_DDL = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _OUT.empty_table()
    rows = parcels.gathered(right.column("body").to_pylist(), _PLACE)
    rows = _merged(rows[rows["kind"] == _GONE])
    rows["run"] += WINDOW - 1
    rows = _merged(rows)
    docs, data, starts, ends = _texts(left.column("doc_id"), left.column("text"))
    spans: dict = {}
    for key, p, n in zip(_keys(rows), rows["pos"].tolist(), rows["run"].tolist(), strict=True):
        spans.setdefault(key, []).append((p, p + n))
    view, kept_bytes, found = memoryview(data), [], []
    for key, a, b in zip(_keys(docs), starts.tolist(), ends.tolist(), strict=True):
        own, at, pieces = spans.get(key, []), a, []
        for s, e in own:
            pieces.append(view[at : a + s])
            at = a + e
        kept_bytes.append(b"".join([*pieces, view[at:b]]))
        found.append([{"start": s, "end": e} for s, e in own])
    ids = left.column("doc_id").cast(pa.int64())
    return pa.table([ids, pa.array(ends - starts, pa.int64()), pa.array(found, pa.list_(_SPAN)), pa.array(kept_bytes, pa.binary())], schema=_OUT)


def parts_for(rows: DataFrame) -> int:
    """Tasks of a shuffle of whole texts: those of the session, or more where each would hold over PART_BYTES."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_parts(rows.sparkSession), -(-size // PART_BYTES))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each of `docs` (doc_id, text): n_bytes, removed spans of bytes, and the bytes kept."""
    rows = with_columns(docs, doc_id="long", text="string")
    tasks = parts_for(rows)
    parts = parcels.places(tasks)
    cut = rows.mapInArrow(_cut(parts), parcels.SCHEMA)
    settled = kept(cut.repartition(tasks, "part").mapInArrow(_settle(parts), parcels.SCHEMA))
    marks = settled.filter("part < 0").collect()  # at most SHARE buckets from each task
    large = [x for row in marks for x in parcels.unpack(bytes(row.body), _PLACE)[0]["bucket"].tolist()]
    settled = settled.filter("part >= 0")
    by_part = rows.select(_doc_part(parts).alias("part"), "doc_id", "text")
    spelled = by_part.groupBy("part").cogroup(settled.groupBy("part")).applyInArrow(_spell(parts, large), parcels.SCHEMA)
    refined = spelled.repartition(tasks, "part").mapInArrow(_refine(parts), parcels.SCHEMA)
    every = settled.unionByName(refined).groupBy("part")
    return by_part.groupBy("part").cogroup(every).applyInArrow(_finish, _OUT_DDL)


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"]).alias("n_removed")
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return out.select("doc_id", "n_bytes", removed, n_spans, F.sha2("kept", 256).alias("kept_sha256"))
