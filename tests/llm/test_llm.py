"""Every operator against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tempora.llm import chat, exact_dedup, line_dedup, mixing, near_dedup, packing, parcels, sharding, suffix_dedup, topk, toxicity

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("part", T.StringType()), T.StructField("key", T.StringType())])


def corpus(n=60, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randrange(2, 8)))
    text = lambda k: "".join(word() + draw.choice([" ", " ", " ", "\n", "\t "]) for _ in range(k))
    passage = text(60)
    out = [text(draw.randrange(1, 120)) for _ in range(n)]
    for _ in range(n // 3):
        base = out[draw.randrange(n)].split(" ")
        if len(base) > 3:
            base[draw.randrange(len(base))] = word()
        out.append(" ".join(base))
    out += [out[3], out[3], out[3].upper(), passage + out[5], out[6] + passage, passage, "", None, " \n ", "\n\n\n\n\n", "one two", "One  two", "<|endoftext|> x", "a" * 5000, text(6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i, t, "en", ["s1", "s2", "é", None][i % 4] if i % 3 else "s1", None, "x", "y", "z") for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows(docs):
    """Repeated rows, one id with two texts, and null ids."""
    return [*docs, docs[3], (5, "another text " * 30, "en", "s1", None, "", "", ""), (None, docs[3][1], None, None, None, "", "", ""), (None, None, None, None, None, "", "", "")]


def test_parcel_places(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 12):
        found = spark.createDataFrame([(int(x),) for x in parcels.places(n)], "p int").select(F.pmod(F.hash("p"), F.lit(n)).alias("at")).collect()
        assert [r.at for r in found] == list(range(n))


def repeats_of(b, seen):
    gone, end = bytearray(len(b)), 0
    for p in range(len(b) - 99):
        w = b[p : p + 100]
        if w in seen:
            gone[max(p, end) : p + 100] = b"\1" * (p + 100 - max(p, end))
            end = p + 100
        seen.add(w)
    spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
    return len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)


def repeats(rows):
    seen: set = set()
    return {i: repeats_of((t or "").encode(), seen) for i, t in sorted((r[0], r[1]) for r in rows)}


@pytest.mark.parametrize("large", [2048, 1])
def test_suffix_dedup(spark, docs, large, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "SHARE", 2048 // large)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 50)
    found = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()}
    assert found == repeats(docs)
    assert sum(x[1] for x in found.values()) > 1000


def by_document(rows):
    """Rows by the order of their documents: doc_id, null last, then the text's hash."""
    import xxhash

    def place(r):
        text = (r[1] or "").encode()
        return (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(text, 42), xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF)

    return sorted(rows, key=place), place


def test_suffix_dedup_odd_rows(spark, docs):
    draw = random.Random(12)
    passage = " ".join(str(draw.random()) for _ in range(20))
    rows = odd_rows(docs) + [(None, f"{i} {passage} {draw.random()}" if i % 2 else f"{draw.random()}" * 9, None, None, None, "", "", "") for i in range(500)]
    ordered, place = by_document(rows)
    distinct, seen = {}, set()
    for r in ordered:
        distinct.setdefault(place(r), r)
    expected = Counter()
    for key, r in distinct.items():
        found = repeats_of((r[1] or "").encode(), seen)
        expected[(r[0], *found)] += sum(place(x) == key for x in rows)
    found = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found) == expected
    assert suffix_dedup.suffix_dedup(frame(spark, [])).collect() == []


def test_documents_are_dealt_evenly(spark):
    parts = parcels.places(8)
    for rows in ([(8 * i, f"text {i}") for i in range(4000)], [(None, f"text {i}") for i in range(4000)], [(8 * i, "one text") for i in range(4000)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = df.select(suffix_dedup._doc_part(parts).alias("p")).toPandas()["p"]
        import pyarrow as pa

        docs = suffix_dedup._texts(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]))[0]
        assert found.tolist() == suffix_dedup._part_of(docs, parts).tolist()
        assert max(Counter(found).values()) < 700


def test_refined_slice_by_slice(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 100)
    found = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()}
    assert found == {i: x[3] for i, x in repeats(docs).items()}


def sql(name, rows, query):
    with duckdb.connect() as con:
        import pyarrow as pa

        con.register(name, pa.table({f.name: pa.array([r[i] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for i, f in enumerate(SCHEMA)}))
        return sorted(con.execute(query).fetchall(), key=str)


def test_line_dedup(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "CHUNK", 40)
    out = line_dedup.line_dedup(frame(spark, docs))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    found = out.select("doc_id", "n_lines", removed, F.size("spans").cast("long"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, found), key=str) == sql("documents", docs, line_dedup.OP2_SQL)
    rows = odd_rows(docs)
    ordered, place = by_document(rows)
    seen, distinct = set(), {}
    for r in ordered:
        if place(r) not in distinct:
            lines, gone = (r[1] or "").split("\n"), set()
            for k in range(len(lines) - 2):
                window = tuple(lines[k : k + 3])
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
            distinct[place(r)] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert sorted(((r.doc_id, r.kept) for r in line_dedup.line_dedup(frame(spark, rows)).collect()), key=str) == sorted(((r[0], distinct[place(r)]) for r in rows), key=str)
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


def sets(rows):
    out = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    return out


def near_rows(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, rows being nodes of their own."""
    own = list(sets([(i, r[1]) for i, r in enumerate(rows)]).values())
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if own[i] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root[i]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(r[0], len(own[i]), least[root[i]], None if r[0] is None else r[0] == least[root[i]]) for i, r in enumerate(rows)], list(least.values())


@pytest.mark.parametrize("large", [512, 2])
def test_near_dedup(spark, docs, large, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT", large)
    monkeypatch.setattr(near_dedup, "SQUARE", large)
    monkeypatch.setattr(near_dedup, "CHUNK", 500)
    rows = odd_rows(docs)
    found = near_dedup.near_dedup(frame(spark, rows)).collect()
    expected, groups = near_rows(rows)
    # Of null ids only the one that stays is kept, which is none where its component has an id.
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept if r.doc_id is not None else None) for r in found), key=str) == sorted(expected, key=str)
    assert sum(r.stays for r in found) == len(groups) and all(r.kept for r in found if r.stays)
    assert near_dedup.near_dedup(frame(spark, [])).collect() == []


def test_null_ids_are_no_bridge(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "xy")
    found = near_dedup.near_dedup(frame(spark, [(i, t, None, None, None, "", "", "") for i, t in ((1, one), (2, two), (None, one), (None, two))])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.stays) for r in found) == [(0, 1, False), (0, 2, False), (1, 1, True), (2, 2, True)]


def test_long_words_have_names_of_their_own(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    names = near_dedup._words(data)[1]
    assert names[0] != names[1] and names[0] == names[2]
    found = near_dedup.near_dedup(frame(spark, [(1, one, None, None, None, "", "", ""), (2, two, None, None, None, "", "", ""), (3, one, None, None, None, "", "", "")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 2), (3, 1)]


def test_recall_near_the_bound():
    """Of pairs at 0.75 to 0.8 none lacks a shared band or falls under the estimate that is still confirmed."""
    draw = np.random.default_rng(8)
    missed = skipped = 0
    for n in range(600):
        size, j = int(draw.integers(40, 400)), 0.75 + 0.05 * (n % 2)
        items = np.unique(draw.integers(0, 2**64, 2 * size, dtype=np.uint64))
        both = int(np.ceil(size * 2 * j / (1 + j)))
        one, two = items[:size], np.concatenate([items[:both], items[size : 2 * size - both]])
        a, b = near_dedup.sketch(one), near_dedup.sketch(two)
        for half in (0, 1):
            missed += not (near_dedup.band_keys(a[None], half) == near_dedup.band_keys(b[None], half)).any()
        guess = near_dedup.estimate((a > b).sum(), (a < b).sum(), (a == b).sum(), size, size)
        skipped += bool(guess < near_dedup.NEED[0] / near_dedup.NEED[1] - near_dedup.SLACK)
    assert (missed, skipped) == (0, 0)


def test_a_very_large_band_is_split():
    """Members of one band that are mostly unlike each other meet in small groups of spare bands, and every near pair does."""
    draw = np.random.default_rng(9)
    common = draw.integers(0, 2**64, 60, dtype=np.uint64)
    items = [np.unique(np.concatenate([common, draw.integers(0, 2**64, 60, dtype=np.uint64)])) for _ in range(2000)]
    items += [np.unique(np.concatenate([x[:-12], draw.integers(0, 2**64, 12, dtype=np.uint64)])) for x in items[:200]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in items])[:-1]])
    keys = near_dedup.band_keys(near_dedup.sketches(np.concatenate(items), starts), 1)
    groups = Counter(keys.ravel().tolist())
    assert sum(n * n for n in groups.values()) < len(items) ** 2 / 2
    assert all((keys[i] == keys[2000 + i]).any() for i in range(200))


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(1)
    one, two = (np.unique(draw.integers(0, 2**64, 4000, dtype=np.uint64)) for _ in range(2))
    two = np.unique(np.concatenate([two[:1000], one[:3000]]))
    a, b = near_dedup.sketch(one), near_dedup.sketch(two)
    both = np.unique(np.concatenate([one, two]))
    assert (near_dedup.merged(a, b) == near_dedup.sketch(both)).all()
    assert (near_dedup.sketches(np.concatenate([one, two]), np.array([0, len(one)])) == np.stack([a, b])).all()
    true = len(np.intersect1d(one, two)) / len(both)
    assert abs(near_dedup.estimate((a > b).sum(), (a < b).sum(), (a == b).sum(), len(one), len(two)) - true) < 0.12


def test_shards(spark, docs):
    rows = odd_rows(docs)
    found = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    groups, slots, total = Counter(), defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for r in rows:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()] += len((r[1] or "").encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]

    def shards(capacity):
        n, now = 1, 0
        for x in sizes:
            n, now = (n + 1, x) if now + x > capacity else (n, now + x)
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 8)
    assert max(total.values()) <= best
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def test_exact_dedup(spark, docs):
    found = exact_dedup.op8_columns(exact_dedup.exact_dedup(frame(spark, docs))).collect()
    assert sorted(map(tuple, found), key=str) == sql("documents", docs, exact_dedup.OP8_SQL)
    rows = odd_rows(docs)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    found = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len({r.row for r in found}) == len(found) == len(rows)
    kept = {bytes(r.digest): r.doc_id for r in found if r.kept}
    assert len(kept) == len(groups) == sum(r.kept for r in found)
    for text, ids in groups.items():
        digest, least = hashlib.sha256(text.encode()).digest(), min((x for x in ids if x is not None), default=None)
        assert kept[digest] == least
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found if bytes(r.digest) == digest), key=str) == sorted(((i, least, len(ids)) for i in ids), key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_cuckoo_index_grows_and_deletes(spark):
    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.add(k, (i, 1))
        index.add(k, (i, 0))
    assert index.live == 3000 and all(index.find(k)[1:] == [(i, 0), 2] for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0]) and index.live == 1500
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    rows = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys[:20])], "doc_id long, digest binary")
    new = exact_dedup.update_index(exact_dedup.build_index(rows), rows.filter("doc_id < 3"), rows.filter("doc_id < 5").select("digest"))
    assert sorted((r.keep_id, r.group_size) for r in new.collect()) == [(i, 1) for i in (0, 1, 2, *range(5, 20))]


def mixed_targets(total):
    names = sorted(total, key=lambda s: (s is None, s))
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        more = {s for s in names if target[s] > 3 * total[s]}
        if not more:
            return target
        full |= more


def test_mix(spark, docs):
    found = mixing.mix_sources(frame(spark, docs)).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size, total = {}, Counter()
    for r in docs:
        size[r[0]] = len(word.findall(r[1] or ""))
        total[r[3]] += size[r[0]]
    target, names = mixed_targets(total), list(total)
    taken = Counter()
    for r in found:
        source = docs[r.doc_id][3]
        assert (r.size, r.source_size) == (size[r.doc_id], total[source]) and abs(r.target - target[source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert len(mixing.mix_sources(frame(spark, odd_rows(docs))).collect()) == len(docs) + 4
    assert mixing.mix_sources(frame(spark, [])).collect() == []


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 300_000 + "x", "x \t" + " " * 5000 + "y  z", "a" * 200_000, "<|endoftext|> x", "\u3000" * 9000 + "é"])
def test_encoder_takes_any_text(text):
    slow = Tokenizer.from_file(VOCABULARY)
    assert packing.encoder(VOCABULARY)(text) == slow.encode(text, add_special_tokens=False).ids


def test_filled_and_certified():
    draw = random.Random(6)
    saved = 0
    for _ in range(200):
        lengths = []
        for _ in range(draw.randrange(0, 40)):
            cuts = [0, *sorted(draw.sample(range(1, 30), 2)), 30]
            lengths += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        lengths = lengths[draw.randrange(0, 3) :]
        bins, offsets, left, certified = packing.packed(lengths, 30)
        held = defaultdict(list)
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            held[b].append((o, n))
        assert sorted(held) == list(range(len(left)))
        for b, x in held.items():
            x.sort()
            assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) == 30 - left[b]
        assert certified == (len(left) == packing.lower_bound(lengths, 30))
        plain = packing.best_fit(lengths, 30)[2]
        assert len(left) <= len(plain)
        saved += len(plain) - len(left)
    assert saved > 0


@pytest.mark.parametrize("group", [1 << 16, 20])
def test_packing(spark, docs, group):
    pieces = packing.kept(packing.token_pieces(frame(spark, docs), VOCABULARY))
    found = packing.pack(pieces, group=group).collect()
    slow, by_doc, by_sequence = Tokenizer.from_file(VOCABULARY), defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in docs:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for v in by_sequence.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    assert len(by_sequence) <= packing.lower_bound([r.length for r in found], 1024) * 1.2 + 1
    assert packing.pack_documents(frame(spark, []), VOCABULARY).collect() == []
    assert len(packing.pack_documents(frame(spark, odd_rows(docs)), VOCABULARY).collect()) == len(found) + 4


def test_lower_bound_holds():
    draw = random.Random(3)
    for _ in range(200):
        # Bins that are full by construction need just as many.
        n, lengths = draw.randrange(1, 6), []
        for _ in range(n):
            cuts = sorted({0, 30, *(draw.randrange(1, 30) for _ in range(draw.randrange(0, 5)))})
            lengths += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        assert packing.lower_bound(lengths, 30) == n
    assert packing.lower_bound([16] * 7, 30) == 7


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_lexicon_automaton():
    terms = {"idiot": 1.0, "scum": 1.0, "worthless": 1.0, "lowei*": 1.0}
    lexicon, draw = toxicity.Lexicon(terms), random.Random(2)
    words = ["idiot", "idoit", "idot", "idiots", "xidiot", "scum", "scums", "loweisch", "lowisch", "worthles", "", "loweî", "lowe"]
    words += ["".join(draw.choice("idotscumwrhle") for _ in range(draw.randrange(1, 9))) for _ in range(3000)]
    for w in words:
        exact = min((0 if w.startswith(t[:-1]) else 9) if t[-1] == "*" else (0 if w == t else 9) for t in terms)
        near = min(min(distance(w[:k], t[:-1]) for k in range(len(w) + 1)) if t[-1] == "*" else distance(w, t) for t in terms if len(t.rstrip("*")) >= 5)
        best = exact if exact == 0 else near if near <= 1 else 9
        assert lexicon.match(w)[1] == best, w


def test_quotation_and_abuse():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "scum": 2.0})

    def seen(text):
        return [(m[4], m[5], m[6], round(m[-1], 3)) for m in lexicon.features(text, list(toxicity.PRIOR))[1]]

    (phrase,), (open_,), (plain,) = seen('he told me "you are an idiot" and left'), seen('he said "idiot!'), seen("you are an idiot")
    assert phrase[:3] == (True, True, True) and open_[:2] == (False, True) and plain[:3] == (False, False, True)
    assert phrase[3] < 0.3 < open_[3] < plain[3]
    assert [x[0] for x in seen('they wrote "idiot" again, but idiot stays')] == [True, False]
    assert [x[0] for x in seen("„scum“ «scum» ‘scum’ don't scum won't")] == [True, True, True, False]
    assert [x[0] for x in seen('"scum\nscum" scum')] == [False, False, False]
    text = "\u0130\u0130 Idiot"
    assert text[slice(*lexicon.matches(text)[0][0][:2])] == "Idiot"


def test_toxicity(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [word() for _ in range(30)]
        bad = draw.choice(["idiot", "scum", "moron"])
        if toxic:
            text[draw.randrange(30)] = bad
        elif i % 6 == 1:
            text[draw.randrange(30)] = f'"{bad}"'
        rows.append((i, " ".join(text) if i % 50 else None if i % 100 else "", None, None, None, "", "", ""))
        labels.append((i, int(toxic) if i % 97 else None))
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r.score for r in toxicity.score_texts(docs, model, ["doc_id"]).select("row.doc_id", "score").collect()}
    assert len(found) == 900 and all(0 <= s <= 1 for s in found.values())
    if model.terms:
        assert {t[:4] for t in model.terms} <= {"idio", "scum", "moro"}
        # Quoted terms are labelled clean here: the context decides.
        wrong = [i for i, y in labels if y is not None and rows[i][1] and (found[i] >= 0.5) != bool(y)]
        assert len(wrong) < 9 and model.context[2] < 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_texts(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_texts(frame(spark, []), model, ["doc_id"]).collect() == []


def test_toxicity_held_out(spark):
    """Of labelled rows that are not learnt from, at sf0.1; 86 of 97 toxic ones when this was written."""
    folder = "/root/testdata/sf0.1"
    out = toxicity.op5_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    n = Counter((r.toxic, r.predicted) for r in out.select("toxic", "predicted").collect())
    assert n[1, 1] >= 0.85 * (n[1, 0] + n[1, 1]) and n[0, 1] <= 0.005 * (n[0, 0] + n[0, 1])


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    draw = np.random.default_rng(4)
    vectors = [draw.normal(0, 0.3, 8).astype(np.float32).tolist() for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[0]) for i in range(60)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, vectors[1][:3])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, body string")
    found = defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    whole = {i: np.pad(np.floor(64 * np.array(v, np.float64)).astype(int), (0, 8 - len(v))) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    asked = [i for i in whole if i % 20 == 0]
    assert sorted(found) == sorted(asked)
    for q in asked:
        assert found[q] == [(-s, i) for s, i in sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]]
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "héllo"), (1, 2, "bob", None), (1, 200, "ann", ""), (1, None, "cy", "late"), (2, 0, "ann", "x"), (2, 0, "ann", "x"), (None, 0, None, "y"), (3, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    found = sorted(map(tuple, chat.rotate_perspectives(df).collect()), key=str)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert found == sorted(con.execute(chat.OP10_SQL).fetchall(), key=str)
    whole = defaultdict(str)
    for r in sorted(found, key=lambda r: r[2]):
        if r[0] == 1:
            assert r[5] == len(whole[r[1]])
            whole[r[1]] += r[4]
    assert whole["bob"].count("<|im_start|>assistant") == 1 and "user name=ann\nhéllo" in whole["bob"]
    assert chat.rotate_perspectives(df.limit(0)).collect() == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage's rows against its input's, with odd rows, an extra column with a clashing name and n_chars missing."""
    draw = random.Random(3)
    extra = [(1000 + i, " ".join(draw.choice(["idiot", "scum"]) if i % 7 == 0 and k == 5 else f"w{draw.randrange(10**6)}" for k in range(20)), "en", "s2", None, "", "", "") for i in range(420)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] % 7 == 6 and r[0] >= 1000)) for r in extra], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(r[0], 1, int(any(w in r[1] for w in ("idiot", "scum")))) for r in extra], labels.schema)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [*odd_rows(docs), (5, "keepme now", "en", "s1", None, "", "", ""), (5, "x y", "en", "s1", None, "", "", ""), (4, "x y", "en", "s1", None, "", "", ""), *extra]
    frame(spark, rows).drop("n_chars").withColumnRenamed("size", "row").withColumnRenamed("part", "score").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        now = corpus_pipeline.kept(stage(spark, now, str(tmp_path)))
        after = [tuple(r) for r in now.collect()]
        if name != "packing":
            assert now.columns == columns
        if name == "toxicity":
            assert Counter(after) == Counter(r for r in before if not {"idiot", "scum"} & set(words(r[1])))
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
            assert not Counter(after) - Counter(before) and len(after) == len(groups)
            least = lambda ids: min((x for x in ids if x is not None), default=None)
            assert Counter((re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r[0]) for r in after) == Counter((t, least([r[0] for r in g])) for t, g in groups.items())
            assert any(r[1] == "keepme now" for r in after)
        if name == "near_dedup":
            assert not Counter(after) - Counter(before) and Counter(r[0] for r in after) == Counter(near_rows(before)[1])
        if name == "mixing":
            sizes, target = Counter(), Counter()
            for r in before:
                sizes[r[3]] += len(words(r[1]))
            for r in after:
                target[r[3]] += len(words(r[1]))
            expected = {s: t for s, t in mixed_targets(sizes).items()}
            assert all(abs(target[s] - expected[s]) <= 1 for s in expected)
            texts = Counter(r[1] for r in before)
            assert all(r[1] in texts or any(t and t.startswith(r[1]) for t in texts) for r in after)
        if name == "packing":
            encode = Tokenizer.from_file(VOCABULARY)
            assert sum(r[3] for r in after) == sum(len(encode.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before)
            full = Counter()
            for r in after:
                full[r[5]] += r[3]
            assert max(full.values()) <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
