"""Near copies through SetSketch registers.

A text's set holds its distinct five-word shingles, as 64-bit names.  A
SetSketch keeps, for each register, the minimum of an exponential variable over
the set, stored as its exponent to the base 1.001 and truncated to 16 bits.
Registers of a union are the larger ones of both, and two sets' registers agree
about as often as their shingles do.

1. Texts with one set become one class, named by its smallest doc_id.
2. Bands of BAND registers put classes in groups.  Each member of a group is
   paired with its least member only, first inside each task, so that a band's
   own task meets one row for each chunk that has it; the other members go
   straight on.  A member is also paired with the one that meets most classes,
   as the original of many copies does.  Of either kind a class's partner of
   most bands is confirmed on full sets.
3. Classes that share a band but not yet a component are compared two by two:
   in blocks of registers first, where the likelihood of all registers together
   estimates the similarity, and then, if that is near the bound, on full sets.
   A band's largest component meets the other classes only, and where these are
   more than SPLIT the band is first split by the bands of the spare registers,
   so that its blocks grow with the classes that meet twice.
4. Components of the confirmed links are found with stars.

A link of similarity 0.75 shares no band once in 400,000 times, one of 0.8 once
in 10 million; in a band that is split, as often again.  Registers only find
candidates: links are confirmed word by word, save that texts whose sets have
the same 128-bit name count as equal.

Every row is a node of its own, whatever its doc_id: rows of one doc_id, or of
none, are linked only by their texts.  Null or wordless texts are linked with
nothing.  A component's id is its smallest doc_id, null where it has none; the
row that stays is the one of that doc_id, of several the one with the smallest
row number.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parcels
from .components import components
from .session import LAST_ID, identified, kept, shuffle_parts, with_columns

WORDS, BAND, BANDS = 5, 5, 48
#: Registers in all; those after the bands' own are spare: they sharpen the estimate and split very large bands.
REGISTERS = 2 * BAND * BANDS
#: A link: NEED[1] * |intersection| >= NEED[0] * |union|.
NEED = (75, 100)
#: SetSketch parameters: base, rate and largest exponent.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Estimates this far below the bound are still confirmed: three and a half deviations of REGISTERS registers.
SLACK = 0.07
#: Bytes of text handled at a time; band keys held before they leave a task.
BLOCK, CHUNK = 1 << 19, 1 << 20
#: Classes outside a band's largest component from which it is split; members of a block.
SPLIT, SQUARE = 8192, 2048

_draw = np.random.default_rng(30_003)
_LETTER = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = _draw.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_REGISTER = (_draw.integers(0, 2**31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and name of each word in bytes: the sum of a random value for each pair of letter and place, mixed."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.zeros(len(data), np.int64)
    first[start] = start
    place = (np.arange(len(data)) - np.maximum.accumulate(first)).astype(np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_mix(_LETTER[_LOWER[data]] + place * _STEP), out=total[1:])
    return start, _mix(total[end] - total[start] + (end - start).astype(np.uint64))


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The sorted set of each text data[starts[i]:ends[i]]; texts stand one after another."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo = starts[i]
        # A white-space byte after each text keeps words of two texts apart.
        part = np.insert(data[lo : ends[j - 1]], ends[i:j] - lo, 32)
        begin, names = _words(part)
        cuts = np.searchsorted(begin, np.append(starts[i:j] - lo + np.arange(j - i), len(part)))
        grams = np.zeros(max(0, len(names) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            grams += names[k : k + len(grams)] * _WORD[k]
        grams = _mix(grams)
        for k in range(j - i):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                yield _mix(np.array([(names[a:b] * _WORD[: b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
        i = j


def sketch(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.empty(REGISTERS, np.uint32)
    for j in range(REGISTERS):
        least[j] = (low * _REGISTER[j] ^ _SHIFT[j]).min()
    return _exponents(least)


def _exponents(least: np.ndarray) -> np.ndarray:
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def sketches(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of many sets that stand one after another, none empty."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(starts)), np.uint32)
    for j in range(REGISTERS):
        np.minimum.reduceat(low * _REGISTER[j] ^ _SHIFT[j], starts, out=least[j])
    return _exponents(least.T)


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, two)


def _banded(registers: np.ndarray, half: int = 0) -> np.ndarray:
    at = half * BAND * BANDS
    return registers[:, at : at + BAND * BANDS].reshape(len(registers), BANDS, BAND)


def band_keys(registers: np.ndarray, half: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each row of registers; half 1: of the spare registers."""
    bands = _banded(registers, half).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, bands.shape[:2]).copy()
    for k in range(BAND):
        keys = _mix(keys + bands[:, :, k])
    return keys


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(above, below, same, n_one, n_two) -> np.ndarray:
    """Likeliest similarity, in hundredths' steps, from how many registers are above, below and the same."""
    above, below, same, n_one, n_two = (np.asarray(x, float)[..., None] for x in (above, below, same, n_one, n_two))
    u, v = n_one / (n_one + n_two), n_two / (n_one + n_two)
    grid = np.arange(0, 1.0001, 0.01)
    most = np.minimum(u / v, v / u)
    j = np.minimum(grid, most)
    more, less = np.clip(_chance(u - v * j), 1e-9, 1), np.clip(_chance(v - u * j), 1e-9, 1)
    likely = above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-9, 1))
    return np.take_along_axis(j, likely.argmax(-1)[..., None], -1)[..., 0]


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets[:-1], offsets[1:]


_SIGNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("registers", pa.binary()),
])
_SIGNED_DDL = "row long, doc_id long, n_shingles long, set_id binary, registers binary"


def _sign(batches):
    """Size and name of each row's set, and registers where a task meets the set for the first time."""
    seen: set = set()
    for b in batches:
        sizes, names, regs = [], [], [None] * b.num_rows
        wait: list = []
        waiting = 0

        def settle(wait=wait, regs=regs):
            if wait:
                sets = [s for _, s in wait]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
                for (i, _), row in zip(wait, sketches(np.concatenate(sets), starts), strict=True):
                    regs[i] = row.tobytes()
                wait.clear()

        for i, items in enumerate(shingle_sets(*_bytes_of(b.column("text")))):
            sizes.append(len(items))
            names.append(xxhash.xxh3_128_digest(items.tobytes()))
            if len(items) and names[-1] not in seen:
                if len(seen) >= CHUNK:
                    seen.clear()
                seen.add(names[-1])
                wait.append((i, items))
                waiting += len(items)
                if waiting >= 1 << 14:
                    settle()
                    waiting = 0
        settle()
        found = pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *found], schema=_SIGNED)


_KEYED = np.dtype([("key", "<u8"), ("id", "<i8"), ("other", "<i8"), ("kind", "u1")])
#: A band's least member in a chunk, alone there or not; a pair of classes; any other member of a shared band.
_ALONE, _LEAST, _PAIR, _MEMBER = range(4)


def _stars(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of band members, each band's least one and the others, paired with it."""
    rows = rows[np.lexsort((rows["id"], rows["key"]))]
    if len(rows) > 1:
        rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1])])]
    new = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.empty(0, bool)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(rows)))
    least, others = rows[new], rows[~new]
    least["kind"] = np.where((size > 1) | (np.maximum.reduceat(rows["kind"], at) == _LEAST), _LEAST, _ALONE) if len(at) else 0
    others["other"], others["kind"] = np.repeat(least["id"], size - 1), _PAIR
    return least, others


def _counted(pairs: np.ndarray, counts: np.ndarray | int = 1) -> np.ndarray:
    """Each pair once, with the number of bands in which it met as key."""
    pairs["key"] = counts
    pairs = pairs[np.lexsort((pairs["other"], pairs["id"]))]
    if len(pairs):
        at = np.flatnonzero(np.concatenate([[True], (pairs["id"][1:] != pairs["id"][:-1]) | (pairs["other"][1:] != pairs["other"][:-1])]))
        total = np.add.reduceat(pairs["key"], at)
        pairs = pairs[at]
        pairs["key"] = total
    return pairs


def _chunk(parts: np.ndarray, found: list[np.ndarray]):
    least, others = _stars(np.concatenate(found))
    members = others.copy()
    members["kind"] = _MEMBER
    rows = np.concatenate([least, _counted(others), members])
    # A band's least members meet by band; all else is known already and is dealt out by class.
    part = parcels.spread(np.where(rows["kind"] <= _LEAST, rows["key"], rows["id"].view(np.uint64)), parts)
    return parcels.batch((p, parcels.pack(r)) for p, r in parcels.dealt(rows, part))


def _band(parts: np.ndarray):
    def run(batches):
        found, n = [], 0
        for b in batches:
            ids = np.asarray(b.column("id")).astype(np.int64)
            if not len(ids):
                continue
            registers = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            rows = np.zeros(len(ids) * BANDS, _KEYED)
            rows["key"], rows["id"] = band_keys(registers).ravel(), np.repeat(ids, BANDS)
            found.append(rows)
            n += len(rows)
            if n >= CHUNK:
                yield _chunk(parts, found)
                found, n = [], 0
        if n:
            yield _chunk(parts, found)

    return run


_MET = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("other", pa.int64())])


def _meet(batches):
    """Pairs (id, other) with their number of bands as key, and members (key, id) of shared bands, other null."""
    rows = parcels.gathered(parcels.bodies(batches), _KEYED)
    least, others = _stars(rows[rows["kind"] <= _LEAST])
    more, members = rows[rows["kind"] == _PAIR], rows[rows["kind"] == _MEMBER]
    members = np.concatenate([least[least["kind"] == _LEAST], others, members])[["key", "id"]]
    pairs = _counted(np.concatenate([others, more]), np.concatenate([np.ones(len(others), np.uint64), more["key"]]))
    for at in range(0, max(len(pairs), len(members)), 1 << 18):
        p, m = pairs[at : at + (1 << 18)], members[at : at + (1 << 18)]
        none = np.concatenate([np.zeros(len(p), bool), np.ones(len(m), bool)])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([p["key"].astype(np.int64), np.ascontiguousarray(m["key"]).view(np.int64)])),
            pa.array(np.concatenate([p["id"], m["id"]])),
            pa.array(np.concatenate([p["other"], np.zeros(len(m), np.int64)]), mask=none),
        ], schema=_MET)


_LINKED = pa.schema([("u", pa.int64()), ("v", pa.int64())])


_LOWERED = bytes(_LOWER)


class Shingles:
    """Sets of shingles as numbers that stand for their words one by one, so that no two shingles share a name."""

    MEMORY = 1 << 20

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """The distinct shingles, sorted, each as the bytes of its words' numbers."""
        words, known = (text or "").encode().translate(_LOWERED).split(), self.words
        numbers = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), ">u4", len(words))
        if len(words) < WORDS:
            # Fewer words are one shingle; 0 stands for no word.
            numbers = np.append(numbers, np.zeros(WORDS - len(words), ">u4")) if words else numbers
        rows = np.lib.stride_tricks.sliding_window_view(numbers, WORDS) if len(numbers) else np.empty((0, WORDS), ">u4")
        return np.unique(np.ascontiguousarray(rows).view(f"V{4 * WORDS}").ravel())


def _confirm(batches):
    """Pairs whose whole texts' sets are similar enough."""
    shingles, last, held = Shingles(), None, None
    for b in batches:
        yes = []
        for one, other in zip(b.column("text").to_pylist(), b.column("other_text").to_pylist(), strict=True):
            if held is None or last != other or len(shingles.words) > Shingles.MEMORY:
                shingles = Shingles()
                last, held = other, shingles.of(other)
            mine = shingles.of(one)
            both = len(np.intersect1d(mine, held, assume_unique=True))
            yes.append(both > 0 and NEED[1] * both >= NEED[0] * (len(mine) + len(held) - both))
        mask = pa.array(yes, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("id").filter(mask), b.column("other").filter(mask)], schema=_LINKED)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) among `pairs` (id, other)."""
    one = texts.withColumnsRenamed({"node": "id"})
    two = texts.withColumnsRenamed({"node": "other", "text": "other_text"})
    met = pairs.join(one, "id").join(two, "other").select("id", "other", "text", "other_text")
    return met.mapInArrow(_confirm, "u long, v long")


def _first_shared(registers: np.ndarray, i: int, near: np.ndarray, half: int) -> np.ndarray:
    """The key of the first band that row i shares with each of others; meaningless where it shares none."""
    one, two = _banded(registers[i : i + 1], half), _banded(registers[near], half)
    return band_keys(registers[i : i + 1], half)[0].view(np.int64)[(one == two).all(2).argmax(1)]


def _spares(batches):
    """Each row (key, id, root, registers) once for each band of its spare registers."""
    for b in batches:
        if b.num_rows:
            registers = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            at = np.repeat(np.arange(b.num_rows), BANDS)
            keys = pa.array(band_keys(registers, 1).ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("key", "id", "root")), keys], names=["key", "id", "root", "spare"])


def _squares(t: pa.Table) -> pa.Table:
    """Pairs of one cell of two blocks that the registers' likelihood does not rule out."""
    registers = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    ids, roots, sizes, block = (np.asarray(t.column(c)) for c in ("id", "root", "n_shingles", "block"))
    key, spare = t.column("key")[0].as_py(), t.column("spare")[0].as_py()
    one, two = block == t.column("low")[0].as_py(), block == t.column("high")[0].as_py()
    a, b = np.flatnonzero(one), np.flatnonzero(two)
    us, vs = [], []
    own = np.array_equal(a, b)
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    for i in a.tolist():
        near = b[(roots[b] != roots[i]) & (ids[b] > ids[i] if own else True)]
        near = near[NEED[1] * np.minimum(sizes[near], sizes[i]) >= NEED[0] * np.maximum(sizes[near], sizes[i])]
        if not len(near):
            continue
        above, below = (registers[i] > registers[near]).sum(1), (registers[i] < registers[near]).sum(1)
        # A pair is looked at in the first band that it shares, once, and there in the first band of spare registers.
        here = _first_shared(registers, i, near, 0) == key
        if spare:
            here &= _first_shared(registers, i, near, 1) == spare
        near, above, below = near[here], above[here], below[here]
        if not len(near):
            continue
        guess = estimate(above, below, REGISTERS - above - below, np.full(len(near), sizes[i]), sizes[near])
        good = near[guess >= NEED[0] / NEED[1] - SLACK]
        us += [ids[i]] * len(good)
        vs += ids[good].tolist()
    return pa.Table.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["id", "other"])


def _partners(pairs: DataFrame) -> DataFrame:
    """For each class its partner of most bands, from `pairs` (id, other, n)."""
    summed = pairs.groupBy("id", "other").agg(F.sum("n").alias("n"))
    return summed.groupBy("id").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("other"))


def _popular(members: DataFrame) -> DataFrame:
    """Pairs (id, other, n) of each band's members with the one that meets most classes in all its bands."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    fame = members.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("fame"))
    leads = members.join(fame, "id").groupBy("key").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("other"))
    return members.join(leads, "key").filter("id <> other").select("id", "other", F.lit(1).cast("long").alias("n"))


def _likely(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (id, other) of `members` (key, id, root) of one band but not one root that the likelihood does not rule out.

    Members of a band's largest root need no comparing among themselves: their blocks meet the others' only.
    """

    def mixed(rows: DataFrame, *keys: str) -> DataFrame:
        roots = rows.groupBy(*keys, "root").agg(F.count("*").alias("n"))
        agg = roots.groupBy(*keys).agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
        return agg.filter("roots > 1").select(*keys, F.col("most.root").alias("major"), F.col("most.n").alias("m"), (F.col("n") - F.col("most.n")).alias("p"))

    bands = mixed(members, "key")
    few = members.join(bands.filter(F.col("p") <= SPLIT), "key").withColumn("spare", F.lit(0).cast("long"))
    many = members.join(bands.filter(F.col("p") > SPLIT).select("key"), "key").join(classes.select("id", "registers"), "id")
    many = many.select("key", "id", "root", "registers").mapInArrow(_spares, "key long, id long, root long, spare long")
    many = many.join(mixed(many, "key", "spare"), ["key", "spare"])
    columns = ["key", "spare", "id", "root", "major", "m", "p"]
    major, place = F.col("root") == F.col("major"), F.xxhash64("id")
    cells = (
        few.select(columns).unionByName(many.select(columns))
        .withColumns({"m": F.ceil(F.col("m") / SQUARE), "p": F.ceil(F.col("p") / SQUARE)})
        .join(classes.select("id", "n_shingles", "registers"), "id")
        .withColumn("block", F.when(major, F.pmod(place, F.col("m"))).otherwise(F.col("m") + F.pmod(place, F.col("p"))))
        .withColumn("with", F.explode(F.sequence(F.when(major, F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("p") - 1)))
        .withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
        .select("key", "spare", "id", "root", "n_shingles", "registers", "block", "low", "high")
    )
    return cells.groupBy("key", "spare", "low", "high").applyInArrow(_squares, "id long, other long")


def near_links(docs: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, class) of `docs`, and (node, root, first) of its classes that have links, `first` the root's (doc_id, row).

    `row` numbers the rows of `docs`, which is read several times and must not change.
    """
    tasks = shuffle_parts(docs.sparkSession)
    parts = parcels.places(tasks)
    rows = with_columns(docs, **{row: "long"}, doc_id="long", text="string").withColumnRenamed(row, "row")
    signed = kept(rows.mapInArrow(_sign, _SIGNED_DDL))
    place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "row")
    named = signed.filter("n_shingles > 0").groupBy("set_id")
    # A class is known by the row of its first document, which has its text.
    classes = named.agg(F.min(place).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    classes = kept(classes.withColumn("id", F.col("first.row")))
    banded = classes.select("id", "registers").mapInArrow(_band(parts), parcels.SCHEMA)
    met = kept(banded.repartition(tasks, "part").mapInArrow(_meet, "key long, id long, other long"))
    members = met.filter("other IS NULL").select("key", "id")
    # All that will be confirmed stands in a shared band: whole texts cross one shuffle here, and only these the later ones.
    shared = members.select(F.col("id").alias("node")).distinct()
    texts = kept(rows.select(F.col("row").alias("node"), "text").join(shared, "node", "left_semi"))
    least = _partners(met.filter("other IS NOT NULL").select("id", "other", F.col("key").alias("n")))
    stars = kept(_confirmed(least.unionByName(_partners(_popular(members))).distinct(), texts))
    roots = components(stars)
    members = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    likely = kept(_likely(members, classes))
    if not likely.isEmpty():
        roots = components(stars.unionByName(kept(_confirmed(likely, texts))))
    linked = roots.join(classes.select(F.col("id").alias("node"), "first"), "node")
    firsts = linked.groupBy("root").agg(F.min("first").alias("first"))
    known = signed.join(classes.select("set_id", F.col("id").alias("class"), F.col("first").alias("own")), "set_id", "left")
    known = known.select("row", "doc_id", "n_shingles", "class", "own")
    return known, roots.join(firsts, "root").select("node", "root", "first")


def near_dedup(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row for each of `docs`: row, doc_id, n_shingles, component_id, kept and stays.

    kept: doc_id is component_id, or, without any doc_id, the row stays; stays: one row of each component.
    """
    if row is None:
        docs, row = identified(with_columns(docs, doc_id="long", text="string"))
    known, roots = near_links(docs, row)
    joined = known.join(roots.withColumnRenamed("node", "class"), "class", "left")
    alone = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "row")
    # A wordless text has no class, a class without links no root.
    first = F.coalesce("first", "own", alone)
    joined = joined.select("row", "doc_id", "n_shingles", first.alias("first"))
    stays = F.col("row") == F.col("first.row")
    component = F.when(F.col("first.doc") != LAST_ID, F.col("first.doc"))
    return joined.select(
        "row", "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, stays).alias("kept"), stays.alias("stays"),
    )


def op3_near_dedup(spark, sf_dir) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
