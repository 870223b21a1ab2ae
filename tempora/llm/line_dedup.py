"""Removal of repeated passages by windows of three consecutive lines.

Every window of three lines that occurs earlier too (in a row of smaller doc_id,
or earlier in the same text) is a later occurrence; a line goes when any later
occurrence covers it.  Windows overlap, and their covered lines merge into
spans.  Windows are judged on the input.

A task sends each window that it met once for each chunk and settles the other
occurrences itself, so a very common passage fills no single task.  Lines end at
"\\n".  Null text is one empty line; texts under three lines stay whole.  Rows
that share doc_id and text count as one document; documents are in order of
doc_id, null last, and those of one doc_id, or of none, in order of their texts'
hash.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parcels
from .session import with_columns
from .suffix_dedup import _OF, _SPAN, _WIN, _doc_part, _first_windows, _keys, _named, _part_of, _texts, parts_for

LINES, CHUNK = 3, 1 << 20


def _split(data: np.ndarray, a: int, b: int) -> list[bytes]:
    return data[a:b].tobytes().split(b"\n")


def _hash(parts: np.ndarray):
    def chunk(found):
        wins, first = _first_windows(np.concatenate(found))
        gone = wins[~first]
        return parcels.batch([
            *((p, b"w" + parcels.pack(r)) for p, r in parcels.dealt(wins[first], parcels.spread(wins["a"][first], parts))),
            *((p, b"g" + parcels.pack(r)) for p, r in parcels.dealt(gone, _part_of(gone, parts))),
        ])

    def run(batches):
        found, n = [], 0
        for b in batches:
            docs, data, starts, ends = _texts(b.column("doc_id"), b.column("text"))
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                names = [xxhash.xxh3_128_digest(x) for x in _split(data, s, e)]
                count = len(names) - LINES + 1
                if count < 1:
                    continue
                joined = b"".join(names)
                keys = b"".join(xxhash.xxh3_128_digest(joined[16 * k : 16 * (k + LINES)]) for k in range(count))
                rows = np.empty(count, _WIN)
                pair = np.frombuffer(keys, "<u8").reshape(-1, 2)
                _named(rows, docs[i])
                rows["a"], rows["b"], rows["pos"] = pair[:, 0], pair[:, 1], np.arange(count)
                found.append(rows)
                n += count
                if n >= CHUNK:
                    yield chunk(found)
                    found, n = [], 0
        if n:
            yield chunk(found)

    return run


def _later(parts: np.ndarray):
    def run(batches):
        wins, gone = [np.empty(0, _WIN)], [np.empty(0, _WIN)]
        for body in parcels.bodies(batches):
            (wins if body[:1] == b"w" else gone).append(parcels.unpack(body[1:], _WIN)[0])
        found, first = _first_windows(np.concatenate(wins))
        lost = np.concatenate([found[~first], *gone])
        lost = lost[np.lexsort([lost[k] for k in ("pos", *reversed(_OF))])]
        if len(lost):
            yield parcels.batch((p, parcels.pack(r)) for p, r in parcels.dealt(lost, _part_of(lost, parts)))

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.string())])
_OUT_DDL = "doc_id long, n_lines long, spans array<struct<start: long, end: long>>, kept string"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _OUT.empty_table()
    rows = parcels.gathered(right.column("body").to_pylist(), _WIN)
    docs, data, starts, ends = _texts(left.column("doc_id"), left.column("text"))
    covered: dict = {}
    for key, p in zip(_keys(rows), rows["pos"].tolist(), strict=True):
        covered.setdefault(key, set()).update(range(p, p + LINES))
    counts, spans, texts = [], [], []
    for key, a, b in zip(_keys(docs), starts.tolist(), ends.tolist(), strict=True):
        lines, gone = _split(data, a, b), covered.get(key, ())
        own: list = []
        for k in sorted(gone):
            if own and own[-1]["end"] == k:
                own[-1]["end"] = k + 1
            else:
                own.append({"start": k, "end": k + 1})
        counts.append(len(lines))
        spans.append(own)
        texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone))
    ids, kept = left.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())
    return pa.table([ids, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN)), kept], schema=_OUT)


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row for each of `docs` (doc_id, text): n_lines, removed spans of line numbers, and the text kept."""
    rows = with_columns(docs, doc_id="long", text="string")
    tasks = parts_for(rows)
    parts = parcels.places(tasks)
    later = rows.mapInArrow(_hash(parts), parcels.SCHEMA).repartition(tasks, "part").mapInArrow(_later(parts), parcels.SCHEMA)
    by_part = rows.select(_doc_part(parts).alias("part"), "doc_id", "text")
    return by_part.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_finish, _OUT_DDL)


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"]).alias("n_removed")
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return out.select("doc_id", "n_lines", removed, n_spans, F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM d),
w AS (SELECT doc_id, k, count(*) OVER f AS n, sha256(list(sha256(line)) OVER f ::VARCHAR) AS h FROM l
      WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS nth FROM w WHERE n = 3),
c AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM r WHERE nth > 1),
m AS (SELECT l.doc_id, l.k, l.line, c.k IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.k = c.k),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS head FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE head) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""
