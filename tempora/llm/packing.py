"""Best-fit packing with certified bin counts.

Texts become token ids and end with the end id; those longer than a sequence are
cut into whole sequences, the first piece taking what is left over.  Pieces are
dealt to partitions, and each packs its pieces best fit decreasing.  A dual
feasible function of the piece lengths bounds each partition's sequences from
below.  A partition over its bound empties its sequences that are not full and
fills them again one by one, each with the set of pieces that leaves least room;
the smaller number of sequences counts.  One that meets its bound then is
certified and done.  The others keep their full sequences, exchange the pieces
of the rest in fewer partitions, and pack again, until all are certified, one
partition is left, or an exchange saves no sequence.  `certified` says of each
piece whether its partition met its bound; packing to the least number always
is not within reach of any method that ends in time.

Null text is empty and packs as the end id alone.  Null doc_ids and repeated
rows are rows of their own.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import kept, shuffle_parts, with_columns

LENGTH, END = 1024, 2
#: Pieces that a partition packs together.
GROUP = 1 << 16
#: Texts that may hold the string of a special token, which only the tokenizers library resolves.
SPECIAL = "<|endoftext|>"
#: Runs of white space on which the fast encoder's pattern goes back too often; the tokenizers library takes any.
_BLANK = re.compile(r"\s{4096}")

_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("key", pa.int64())])
_PLACED_DDL = f"{_PIECES_DDL}, bin long, offset long, certified boolean, done boolean"
_PLACED = pa.schema([*_PIECES, ("bin", pa.int64()), ("offset", pa.int64()), ("certified", pa.bool_()), ("done", pa.bool_())])


def encoder(vocabulary: str):
    """A function from text to ids of the tokenizers file `vocabulary`.

    The .tiktoken file beside it holds the same byte-level vocabulary as ranks
    and encodes five times as fast to the same ids; where it is missing, or a
    text holds a special token's string or a very long blank, the tokenizers
    library encodes.
    """
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(vocabulary)
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if SPECIAL in text or _BLANK.search(text):
            return whole(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:
            # What the fast encoder gives up on comes as a panic, which is no Exception.
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return whole(text)

    return encode


def _cut(vocabulary: str, length: int, end: int):
    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            out: list[list] = [[] for _ in _PIECES]
            for n, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                ids = array("I", encode(text or ""))
                ids.append(end)
                at, piece = 0, 0
                while at < len(ids):
                    to = at + ((len(ids) - 1) % length + 1 if at == 0 else length)
                    crc = zlib.crc32(memoryview(ids)[at:to])
                    for column, value in zip(out, (doc, piece, at, to - at, crc, zlib.crc32(f"{doc}.{piece}.{n}".encode())), strict=True):
                        column.append(value)
                    at, piece = to, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, key) of the ids of `docs` (doc_id, text)."""
    rows = with_columns(docs, doc_id="long", text="string")
    return rows.mapInArrow(_cut(vocabulary, length, end), _PIECES_DDL)


def lower_bound(lengths: list[int], length: int) -> int:
    """Sequences that pieces need at least.

    For each a up to half a sequence: pieces over length - a count as whole
    sequences, pieces under a as nothing, pieces over half as such, others by
    their length.
    """
    count = [0] * (length + 1)
    for x in lengths:
        count[x] += 1
    best = -(-sum(lengths) // length)
    below = weight = 0
    large = sum(count[length // 2 + 1 :])
    # Pieces of [a, length/2], and of (length/2, length - a], for falling a.
    half = over = over_n = 0
    for a in range(length // 2, 0, -1):
        half += a * count[a]
        if (big := length - a) > length // 2:
            over += big * count[big]
            over_n += count[big]
        below, weight = large - over_n, half - (over_n * length - over)
        best = max(best, below + over_n + max(0, -(-weight // length)))
    return best


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, packed best fit decreasing, and each bin's room left."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, offsets, left = [0] * len(lengths), [0] * len(lengths), []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order:
        need = lengths[i]
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            at, room = len(left), length
            left.append(length)
        bins[i], offsets[i] = at, length - room
        left[at] = room - need
        if left[at]:
            by_room[left[at]].append(at)
            rooms |= 1 << left[at]
    return bins, offsets, left


def _fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """Sizes, from those waiting in rising order and how many wait of each, that leave least of `room`."""
    every, reach, steps = (1 << room + 1) - 1, 1, []
    for k in range(bisect.bisect_right(sizes, room) - 1, -1, -1):
        size = sizes[k]
        left = min(counts[size], room // size)
        times = 1
        while left:
            times = min(times, left)
            more = (reach | reach << size * times) & every
            steps.append((size, times, reach))
            reach, left, times = more, left - times, times * 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, []
    for size, times, before in reversed(steps):
        if not before >> at & 1:
            out += [size] * times
            at -= size * times
    return out


def filled(lengths: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Like best_fit, bin by bin: the largest piece that is left, then those that fill the rest best."""
    waiting: dict[int, list[int]] = {}
    for i, size in enumerate(lengths):
        waiting.setdefault(size, []).append(i)
    # Sizes that still wait, and how many of each, kept up piece by piece: a bin looks only at those it may need.
    sizes, counts = sorted(waiting), [0] * (length + 1)
    for size, x in waiting.items():
        counts[size] = len(x)
    bins, offsets, left = [0] * len(lengths), [0] * len(lengths), []

    def put(size: int, at: int) -> int:
        i = waiting[size].pop()
        counts[size] -= 1
        if not counts[size]:
            del sizes[bisect.bisect_left(sizes, size)]
        bins[i], offsets[i] = len(left), at
        return at + size

    while sizes:
        at = put(sizes[-1], 0)
        for size in _fullest(sizes, counts, length - at):
            at = put(size, at)
        left.append(length - at)
    return bins, offsets, left


def packed(lengths: list[int], length: int) -> tuple[list[int], list[int], list[int], bool]:
    """Bin and offset of each piece, each bin's room left, and whether no packing has fewer bins."""
    bound = lower_bound(lengths, length)
    bins, offsets, left = best_fit(lengths, length)
    if len(left) > bound:
        open_ = [i for i, b in enumerate(bins) if left[b]]
        for some in (open_, range(len(lengths))):
            again, places, room = filled([lengths[i] for i in some], length)
            full = {b: n for n, b in enumerate(b for b, x in enumerate(left) if not x)} if some is open_ else {}
            if len(full) + len(room) < len(left):
                bins = [full.get(b, 0) for b in bins]
                for i, b, at in zip(some, again, places, strict=True):
                    bins[i], offsets[i] = len(full) + b, at
                left = [0] * len(full) + room
            if len(left) == bound:
                break
    return bins, offsets, left, len(left) == bound


def _pack(length: int, stage: int):
    """Packs one group's pieces, so that a task holds one group at a time however many it is dealt."""

    def run(t: pa.Table) -> pa.Table:
        group, sizes = t.column("group")[0].as_py(), t.column("length").to_pylist()
        where, start, left, certified = packed(sizes, length)
        first = (stage << 54) + (group << 24)
        done = [certified or left[b] == 0 for b in where]
        placed = [[first + b for b in where], start, [certified] * len(where), done]
        columns = [pa.array(x, f.type) for x, f in zip(placed, list(_PLACED)[len(_PIECES) :], strict=True)]
        return pa.Table.from_arrays([*(t.column(f.name) for f in _PIECES), *columns], schema=_PLACED)

    return run


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`pieces` with sequence_id, offset and certified; each sequence has at most `length` ids."""
    spark = pieces.sparkSession
    columns = [f.name for f in _PIECES]
    settled: list[DataFrame] = []
    waiting, stage, before = pieces, 0, None
    while True:
        groups = max(1, -(-waiting.count() // group))
        dealt = waiting.select(*columns, F.pmod("key", F.lit(groups)).cast("int").alias("group")).repartition(min(groups, shuffle_parts(spark)), "group")
        placed = kept(dealt.groupBy("group").applyInArrow(_pack(length, stage), _PLACED_DDL))
        # A sequence has one piece at its beginning.
        bins = placed.filter("offset = 0").agg(F.count("*").alias("all"), F.count_if(~F.col("done")).alias("open")).first()
        if before is not None and bins["all"] >= before:
            settled.append(open_)  # as it was
            break
        if groups == 1 or not bins["open"]:
            settled.append(placed)
            break
        settled.append(placed.filter("done"))
        open_ = placed.filter("NOT done")
        # The same number of pieces in a group, so groups become fewer as pieces settle; another deal.
        key = F.pmod(F.xxhash64("key", F.lit(stage)), F.lit(2**31)).cast("long")
        waiting, stage, before = open_.select(*columns).withColumn("key", key), stage + 1, bins["open"]
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", "certified")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all `docs` with their place in sequences of at most `length` ids."""
    return pack(kept(token_pieces(docs, vocabulary, length, end)), length)


def op6_pack(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
