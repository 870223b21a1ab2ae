"""Toxicity by a lexicon trie that Levenshtein automata run through.

The lexicon is learnt from labelled rows: words, and stems that any ending may
follow, are chosen one by one for the toxic texts that they explain; a text
counts less with each chosen term that it holds, so other words of
copied texts do not enter.  The trie is
intersected with the automata of edit distance one; the product is built lazily
as one deterministic automaton, so a word costs a table look-up for each letter.
Each match is scored in its context: inside a quotation that is closed in the
same line, with a word of reporting or of address among the CONTEXT characters
on either side, with other matches near.  What each of these weighs is learnt
from the labels, from a prior by which quotation and reporting speak for
citation and address for abuse.  A logistic model weighs what a text holds.

At most SAMPLE labelled rows are used, those of smallest hash; that is the only
bound.  Null or empty texts score as texts without a match; null labels are left
out.  Without labels of both kinds the score is the share of toxic ones, or 0.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import kept, shuffle_parts, with_columns

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Lengths of stems (a longer word is met by its stem of the last length), letters that a term has at least to be met
#: with an error, and words remembered by a task.
STEMS, FUZZY, MEMORY = range(4, 17), 5, 1 << 19
#: Log-likelihood ratios that a term must reach over all texts and with explained texts discounted, the share of
#: toxic texts among its own, and what a text still counts after each chosen term that it holds.
EVIDENCE, FRESH, PURE, FADE = 20.0, 8.0, 0.8, 0.7
#: Characters on each side of a match that are its context, and between matches that are near each other.
CONTEXT, NEAR = 48, 192
_WORD = re.compile(r"[^\W_]+")
#: Marks that open a quotation with those that close it, and words of reporting and of address in
#: English, German, French and Spanish.
_CLOSES = {
    '"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "'": "'", "‘": "’", "‚": "‘’",
}
_REPORT = frozenset(
    "said says say told wrote writes called calls calling quoted quote word words term insult sagte sagt schrieb nannte nennt wort"
    " begriff dit disait écrit appelé appelle mot insulte dijo dice escribió llamó llama palabra insulto".split()
)
_ADDRESS = frozenset("you your youre u du dich dir dein ihr euch tu toi te vous ton ta tú usted eres".split())
_MARK = re.compile(r"[\n\"“”„«»‹›]|(?<!\w)['‘‚](?=\S)|(?<=\S)['’‘](?!\w)")
#: What a match's context weighs before any label is seen: constant, error, quoted, reported, addressed, others near.
PRIOR = (0.0, -0.5, -2.0, -1.0, 0.5, 0.5)


def _lowered(text: str) -> str:
    """The text in lower case, letter for letter, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def quotations(text: str) -> list[tuple[int, int]]:
    """First and last mark of each quotation; one that its line does not close is none."""
    found, opened = [], None
    for m in _MARK.finditer(text):
        c = m.group()
        if c == "\n":
            opened = None
        elif opened is None:
            opened = (m.start(), _CLOSES[c]) if c in _CLOSES else None
        elif c in opened[1]:
            found.append((opened[0], m.start()))
            opened = None
    return found


def _ratio(bad, all_, n_bad: float, n_all: float):
    """Log-likelihood ratio of `bad` toxic ones among `all_` texts, where n_bad of n_all are."""
    bad, all_ = np.asarray(bad, float), np.asarray(all_, float)
    base = n_bad / n_all
    p = bad / all_
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.nan_to_num(bad * np.log(p / base)) + np.nan_to_num((all_ - bad) * np.log((1 - p) / (1 - base)))
    return np.where(p > base, 2 * part, 0)


class Lexicon:
    """Trie of words and stems, and the lazily built automaton of words within one error of it."""

    def __init__(self, terms: dict[str, float]):
        self.terms = sorted(terms)
        self.weight = [terms[t] for t in self.terms]
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        for i, term in enumerate(self.terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                node = self.next[node][c]
            (self.stem if term.endswith("*") else self.word)[node] = i
        self.letters = {c for n in self.next for c in n}
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.ends: list[tuple[int, int]] = []
        self.start = self._state({(0, 0, -1)})
        self.seen: dict[str, tuple[int, int]] = {}

    def _state(self, items: set) -> int:
        """The number of a set of (node, errors, stem met), closed under letters left out."""
        todo, closed = list(items), set(items)
        while todo:
            node, errors, met = todo.pop()
            more = [(child, errors + 1, met) for child in self.next[node].values()] if errors == 0 and met < 0 else []
            if met < 0 and self.stem[node] >= 0 and (errors == 0 or len(self.terms[self.stem[node]]) > FUZZY):
                more.append((0, errors, self.stem[node]))
            for x in more:
                if x not in closed:
                    closed.add(x)
                    todo.append(x)
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.ends.append(self._end(key))
        return self.states[key]

    def _end(self, items: frozenset) -> tuple[int, int]:
        best = (-1, 9)
        for node, errors, met in sorted(items):
            term = met if met >= 0 else self.word[node]
            if term >= 0 and (errors == 0 or len(self.terms[term].rstrip("*")) >= FUZZY) and errors < best[1]:
                best = (term, errors)
        return best

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, errors, met in self.sets[state]:
            if met >= 0:
                out.add((node, errors, met))
                continue
            if letter in self.next[node]:
                out.add((self.next[node][letter], errors, met))
            if errors == 0:
                out.add((node, 1, met))
                out.update((child, 1, met) for child in self.next[node].values())
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[int, int]:
        """Term and errors of a word, or (-1, 9)."""
        found = self.seen.get(word)
        if found is None:
            state = self.start
            for c in word:
                key = c if c in self.letters else ""
                to = self.moves[state].get(key)
                if to is None:
                    to = self.moves[state][key] = self._step(state, key)
                state = to
                if state < 0:
                    break
            found = self.ends[state] if state >= 0 else (-1, 9)
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            self.seen[word] = found
        return found

    def matches(self, text: str) -> tuple[list[tuple], int]:
        """(start, end, term, errors, quoted, reported, addressed, company) of each match in a whole text, and its number of words."""
        low = _lowered(text)
        words = _WORD.findall(low)
        hits = {w for w in set(words) if self.match(w)[0] >= 0}
        if not hits:
            return [], len(words)
        places = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(low) if m.group() in hits]
        quotes, out = quotations(text), []
        begins = [a for a, _ in quotes]
        for i, (start, end, word) in enumerate(places):
            at = bisect_left(begins, start) - 1
            quoted = at >= 0 and quotes[at][1] >= end
            around = set(_WORD.findall(low[max(0, start - CONTEXT) : start])) | set(_WORD.findall(low[end : end + CONTEXT]))
            company = i > 0 and start - places[i - 1][0] <= NEAR or i + 1 < len(places) and places[i + 1][0] - start <= NEAR
            out.append((start, end, *self.match(word), quoted, not around.isdisjoint(_REPORT), not around.isdisjoint(_ADDRESS), company))
        return out, len(words)

    def features(self, text: str, context: list[float]) -> tuple[list[float], list[tuple]]:
        """What a text holds, and its matches, each with its context's score from 0, a citation, to 1, abuse."""
        found, words = self.matches(text)
        scored = [(*m, _context_score(m, context)) for m in found]
        kinds = Counter((m[3] > 0, m[4]) for m in found)
        exact, cited, near_miss, cited_miss = (kinds[k] for k in ((False, False), (False, True), (True, False), (True, True)))
        scores = [m[-1] for m in scored]
        heavy = max((self.weight[m[2]] * m[-1] for m in scored), default=0.0)
        total = sum(scores)
        return [
            float(exact > 0), float(cited > 0), float(near_miss > 0), float(cited_miss > 0), np.log1p(exact), np.log1p(near_miss),
            max(scores, default=0.0), np.log1p(total), heavy, total / max(words, 1) * 10,
        ], scored


def _signs(match: tuple) -> tuple[int, ...]:
    """Error, quoted, reported, addressed, others near."""
    return (int(match[3] > 0), *map(int, match[4:8]))


def _context_score(match: tuple, context: list[float]) -> float:
    z = context[0] + sum(w * x for w, x in zip(context[1:], _signs(match), strict=True))
    return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, count=None, prior=None) -> np.ndarray:
    """Weights of a logistic model, the constant first, by Newton's method; rows count `count` times, weights are drawn to `prior`."""
    x = np.hstack([np.ones((len(x), 1)), x])
    count = np.ones(len(x)) if count is None else np.asarray(count, float)
    mean = (count * y).sum() / count.sum()
    w = np.zeros(x.shape[1]) if prior is None else np.array(prior, float)
    aim = w.copy()
    w[0] += np.log((mean + 1e-6) / (1 - mean + 1e-6))
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6 if prior is None else ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (count * (p - y)) + keep * (w - aim))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


_COUNTED = pa.schema([("term", pa.string()), ("bad", pa.int64()), ("n", pa.int64())])


def _count_bad(batches):
    """How many toxic texts of a partition hold each term."""
    counts: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            counts.update(_terms_of(text or ""))
    terms = [t for t, n in counts.items()]
    for at in range(0, len(terms), 100_000):
        part = terms[at : at + 100_000]
        n = pa.array([counts[t] for t in part], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), n, n], schema=_COUNTED)


def _held(terms: dict[str, int]):
    """The candidate terms that each text holds."""

    def run(batches):
        for b in batches:
            rows = [[terms[t] for t in _terms_of(x or "") & terms.keys()] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), b.column("toxic").cast(pa.int32())], names=["held", "toxic"])

    return run


def choose_terms(held: list[tuple[list[int], int]], terms: list[str]) -> dict[str, float]:
    """Terms with weights, chosen while they explain toxic texts that are not yet explained."""
    n_all, n_bad = len(held), sum(y for _, y in held)
    good, texts = np.zeros(len(terms)), [[] for _ in terms]
    for i, (own, y) in enumerate(held):
        for t in own:
            if y:
                texts[t].append(i)
            else:
                good[t] += 1
    bad = np.array([len(x) for x in texts], float)
    total, open_ = bad.copy(), bad.copy()
    share = np.ones(n_all)
    free = np.ones(len(terms), bool)
    bare = [t.rstrip("*") for t in terms]
    order = sorted(range(len(terms)), key=bare.__getitem__)
    ranked, spelled = [bare[t] for t in order], {}
    for t, b in enumerate(bare):
        spelled.setdefault(b, []).append(t)
    # Among equals the longer term, so that no stem is shorter than it must be, and words before stems.
    longer = np.array([1e-6 * (2 * len(b) + (b == t)) for b, t in zip(bare, terms, strict=True)])
    chosen: dict[str, float] = {}
    while len(terms):
        gain = np.where(free & (open_ > 0), _ratio(open_, np.maximum(open_ + good, 1e-9), n_bad, n_all), 0)
        best = int(np.argmax(gain + longer * (gain > 0)))
        if gain[best] < FRESH:
            break
        chosen[terms[best]] = float(np.log((total[best] + 0.5) / (n_bad + 1)) - np.log((good[best] + 0.5) / (n_all - n_bad + 1)))
        # Terms that begin with this one, and those that it begins with.
        own = bare[best]
        free[order[bisect_left(ranked, own) : bisect_left(ranked, own + chr(0x10FFFF))]] = False
        for n in range(1, len(own)):
            free[spelled.get(own[:n], [])] = False
        for i in texts[best]:
            open_[held[i][0]] -= share[i] * (1 - FADE)
            share[i] *= FADE
    return chosen


class Model:
    """What scores a text: a lexicon, the weights of a match's context and those of a text's features, or a constant."""

    def __init__(self, terms: dict[str, float], weights: list[float] | None, base: float, context: list[float] | None = None):
        self.terms, self.weights, self.base, self.context, self._lexicon = terms, weights, base, list(context or PRIOR), None

    def __getstate__(self):
        return self.__dict__ | {"_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms)
        return self._lexicon

    def score(self, text: str | None) -> tuple[float, list[tuple]]:
        if self.weights is None:
            return self.base, []
        x, found = self.lexicon.features(text or "", self.context)
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], x, strict=True))
        return float(1 / (1 + np.exp(-min(max(z, -30), 30)))), found


def held_out(doc_id):
    """Rows whose labels are not learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE rows of `labels` (doc_id, toxic), held-out rows left aside, and the texts of `docs`."""
    known = with_columns(labels, doc_id="long", toxic="int").withColumnRenamed("doc_id", "of")
    known = known.filter("of IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("of")))
    # SAMPLE rows at most, so this side is small whatever the input.
    chosen = known.groupBy("of").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(SAMPLE)
    texts = with_columns(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "of").join(F.broadcast(chosen), "of")
    # Copies meet in each task first, and the few texts then spread over all tasks.
    distinct = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = kept(distinct.repartition(shuffle_parts(docs.sparkSession), "h").select("text", "toxic"))
    n_all, n_bad = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < n_bad < n_all:
        return Model({}, None, n_bad / n_all if n_all else 0.0)
    counts = sample.filter("toxic = 1").select("text").mapInArrow(_count_bad, "term string, bad long, n long")
    # A term in fewer toxic texts cannot reach EVIDENCE, were all its texts toxic.
    least = EVIDENCE / (2 * np.log(n_all / n_bad))
    return _fit(sample, kept(counts.groupBy("term").agg(F.sum("bad").alias("bad")).filter(F.col("bad") >= float(least))), n_all, n_bad)


def _good_counts(terms: set[str]):
    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(_terms_of(text or "") & terms)
        n = pa.array(list(counts.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), n, n], schema=_COUNTED)

    return run


def _fit(sample: DataFrame, candidates: DataFrame, n_all: int, n_bad: int) -> Model:
    bad = {r.term: r.bad for r in candidates.collect()}
    found = sample.filter("toxic = 0").select("text").mapInArrow(_good_counts(set(bad)), "term string, bad long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    good = {r.term: r.n for r in found.collect()}
    names = sorted(bad)
    ratios = _ratio([bad[t] for t in names], [bad[t] + good.get(t, 0) for t in names], n_bad, n_all)
    strong = zip(ratios.tolist(), names, strict=True)
    terms = [t for g, t in strong if g >= EVIDENCE and bad[t] >= PURE * (bad[t] + good.get(t, 0))]
    # SAMPLE rows of a few numbers each at most.
    held = [(r.held, r.toxic) for r in sample.mapInArrow(_held({t: i for i, t in enumerate(terms)}), "held array<int>, toxic int").collect()]
    model = Model(choose_terms(held, terms), [0.0] * 11, n_bad / n_all)
    signs = sample.mapInArrow(_signed(model), "signs int, toxic int, n long").groupBy("signs", "toxic").agg(F.sum("n").alias("n")).collect()
    if signs:
        x = np.array([[r.signs >> k & 1 for k in range(len(PRIOR) - 1)] for r in signs], float)
        y, n = np.array([r.toxic for r in signs], float), np.array([r.n for r in signs], float)
        model.context = logistic(x, y, count=n, prior=PRIOR).tolist()
    rows = [(r.x, r.toxic) for r in sample.mapInArrow(_featured(model), "x array<double>, toxic int").collect()]
    model.weights = logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float)).tolist()
    return model


def _signed(model: Model):
    """How many matches of each kind of context the toxic and the other texts of a partition hold."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for m in model.lexicon.matches(text or "")[0]:
                    counts[sum(x << k for k, x in enumerate(_signs(m))), y] += 1
        signs, toxic = pa.array([k for k, _ in counts], pa.int32()), pa.array([y for _, y in counts], pa.int32())
        yield pa.RecordBatch.from_arrays([signs, toxic, pa.array(list(counts.values()), pa.int64())], names=["signs", "toxic", "n"])

    return run


def _featured(model: Model):
    def run(batches):
        for b in batches:
            rows = [model.lexicon.features(x or "", model.context)[0] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("toxic").cast(pa.int32())], names=["x", "toxic"])

    return run


_FOUND = {"start": "long", "end": "long", "term": "string", "errors": "int", "quoted": "boolean", "reported": "boolean", "addressed": "boolean", "context": "double"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_MATCH = pa.struct([(name, _ARROW[kind]) for name, kind in _FOUND.items()])


def _scored(model: Model):
    def run(batches):
        for b in batches:
            scores, found = [], []
            for text in b.column("text").to_pylist():
                score, hits = model.score(text)
                scores.append(score)
                terms = model.lexicon.terms
                found.append([dict(zip(_FOUND, (m[0], m[1], terms[m[2]], *m[3:7], m[8]), strict=True)) for m in hits])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(_MATCH))], names=["row", "score", "matches"])

    return run


def score_texts(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """(row, score, matches) for each of `docs`: row holds `columns`, matches are those of the whole text with their contexts."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(row, (F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text"))
    match = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in _FOUND.items()))
    out = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(match))])
    return rows.mapInArrow(_scored(model), out)


def op5_toxicity(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_texts(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    out = out.select("row.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
