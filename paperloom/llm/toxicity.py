"""Toxicity of whole texts by a lexicon that misspellings can't hide from.

The lexicon is learned: whole words and word beginnings that stand far more often in texts labelled toxic than
in others, from at most ``SAMPLE`` labelled rows of each class (those with the least hashes); every term that is
significant there is an entry. A text tells of a term once, and texts that have it among the same ``CONTEXT`` words
on either side count as one, so copies and shared passages make no term significant. The lexicon is a trie,
which is intersected with Levenshtein automata: a set of (trie node, edits) pairs is a state, states are
determinised as words need them, and most words die after a few letters. Entries of five letters or more allow
one edit. Every hit is scored in its window of ``WINDOW`` words on either side: between a mark that opens a quotation and
the one that closes it, or shortly after a reporting word, it is a quotation and counts little; other hits count more the
more of them share a window. Reporting words are learned as well: words that stand before terms far more often in clean
texts than in toxic ones (callers can add others). A logistic function of the sums of exact, misspelled and quoted hits and of the densest window gives
the score; its weights are fitted on the same sample.

Defined results: null text is empty and scores as a text without hits; a text without hits scores below 0.5; if
the sample lacks either class all scores are 0; labels of one doc_id are taken together (any 1 makes it 1);
so are those of equal texts; labels that are null or whose doc_id is null or unknown teach nothing. doc_id, lang, source and labels are no inputs.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aliased, lean, mixed, released, runs, text_bytes, word_spans

SAMPLE, WINDOW, CONTEXT, REPORTED, FOLDS = 4000, 8, 3, 3, 5  # REPORTED: words before a hit among which one can report it
SHORTEST, LONGEST, FUZZY = 4, 8, 5  # letters of a beginning; letters from which an edit is allowed
ODDS = float(np.log(4))  # log odds from which a term tells
SHARE = 0.5  # what a misspelling that the sample doesn't have is worth of its entry
BATCH_BYTES, CACHE_WORDS = 1 << 20, 150_000
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^\W+|\W+$")
#: Marks that open a quotation, with those that close it.
_MARKS = {'"': '"”', "“": "”\"", "„": "“”", "«": "»", "‹": "›", "'": "'’", "‘": "’'", "「": "」", "『": "』"}
_ALONE = "“„«‹‘「『", "”»›」』"  # what opens and closes as a word of its own


def folded(word: str) -> str:
    """A word without the marks around it, case-folded, look-alike digits and signs as letters."""
    w = _EDGE.sub("", unicodedata.normalize("NFKC", word)).casefold()
    return w.translate(_LEET) if not w.isalpha() and any(c.isalpha() for c in w) else w


class Lexicon:
    """The trie of (entry, is_beginning) and its lazily determinised intersection with Levenshtein automata."""

    def __init__(self, entries: list[tuple[str, bool]], fuzzy: int = FUZZY):
        self.entries, self.fuzzy = entries, fuzzy
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for e, (term, _) in enumerate(entries):
            at = 0
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                at = self.child[at][c]
            self.ends[at].append(e)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []
        self.begun: list[tuple[int, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With what a left-out letter leads to; a pair with more edits than needed is dropped."""
        more = {(n, 1) for at, e in pairs if e == 0 for n in self.child[at].values()}
        return frozenset((n, e) for n, e in pairs | more if e == 0 or (n, 0) not in pairs)

    def _accepted(self, pairs: frozenset, beginning: bool) -> tuple[int, int] | None:
        """Edits and entry of the best accepted entry."""
        found = [(e, t) for n, e in pairs for t in self.ends[n] if self.entries[t][1] == beginning and (e == 0 or len(self.entries[t][0]) >= self.fuzzy)]
        return min(found, default=None)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.step.append({})
            self.whole.append(self._accepted(pairs, False))
            self.begun.append(self._accepted(pairs, True))
        return self.states[pairs]

    def _next(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for at, e in self.sets[state]:
            if (n := self.child[at].get(c)) is not None:
                out.add((n, e))
            if e == 0:
                out.add((at, 1))
                out |= {(n, 1) for n in self.child[at].values()}
        self.step[state][c] = to = self._state(self._closed(out))
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """Edits and entry of the best entry that the word is, or begins with, within the allowed edits."""
        state, best = self.start, None
        for c in word:
            nxt = self.step[state].get(c)
            state = self._next(state, c) if nxt is None else nxt
            if state == self.dead:
                return best
            if (b := self.begun[state]) is not None and (best is None or b < best):
                best = b
        w = self.whole[state]
        return min(x for x in (w, best) if x is not None) if w is not None else best


class Scorer:
    """Hits of a lexicon in texts, and the logistic function of their sums."""

    def __init__(self, lexicon: Lexicon, value: np.ndarray, weights: np.ndarray | None = None, reporting: frozenset[str] = frozenset()):
        self.lexicon, self.value, self.weights, self.reporting = lexicon, value, weights, reporting
        self.misspelled = 0  # 1: all hits count as misspelled
        self.known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}  # a task starts with its own

    def _code(self, unit: str) -> int:
        """-1, or edits + 2 * entry."""
        hit = self.lexicon.find(folded(unit))
        return -1 if hit is None else (hit[0] | self.misspelled) + 2 * hit[1]

    def features(self, column: pa.Array) -> np.ndarray:
        """Sums of exact, misspelled and quoted hits and the densest window, for each text."""
        raw, offsets = text_bytes(column)
        out = np.zeros((len(offsets) - 1, 4))
        starts, ends, first = word_spans(raw, offsets)
        if not len(starts):
            return out
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        edges = np.append(starts, len(raw)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        names = units.dictionary.to_pylist()
        codes = list(map(self.known.get, names))
        for k, c in enumerate(codes):
            if c is None:
                codes[k] = self.known[names[k]] = self._code(names[k])
        code = np.array(codes, np.int64)[units.indices.to_numpy()]
        at = np.flatnonzero(code >= 0)
        doc = np.searchsorted(first, at, "right") - 1
        words = lambda a, b: [raw[starts[i] : ends[i]].tobytes().decode() for i in range(a, b)]
        value = self.value[code[at]]
        for k, (i, d) in enumerate(zip(at.tolist(), doc.tolist(), strict=True)):
            a, b = max(i - WINDOW, first[d]), min(i + WINDOW + 1, first[d + 1])
            if quoted(words(a, b), i - a, self.reporting):
                out[d, 2] += value[k]
            else:
                out[d, code[i] & 1] += value[k]
                near = (at[max(0, k - 2 * WINDOW) : k + 1] >= a) & (doc[max(0, k - 2 * WINDOW) : k + 1] == d)
                out[d, 3] = max(out[d, 3], value[max(0, k - 2 * WINDOW) : k + 1][near].sum())
        return np.log1p(np.maximum(out, 0))

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.weights is None:
            return np.zeros(n)
        out = np.empty(n)
        for i, j in runs(text_bytes(column)[1], BATCH_BYTES):
            f = self.features(column[i:j])
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.weights[0] + f @ self.weights[1:], -30, 30)))
            out[i:j][(f == 0).all(axis=1)] = min(0.499, 1 / (1 + np.exp(-self.weights[0])))
        return out


def quoted(window: list[str], at: int, reporting: frozenset[str] = frozenset()) -> bool:
    """Whether the word at this place of its window is quoted: between marks that belong together, or reported.

    A mark opens at a word's beginning and closes at its end, whatever punctuation is around it; inside a word it is a
    letter. Words of punctuation alone open and close nothing, but for marks that tell which they do.
    """
    if any(folded(w) in reporting for w in window[max(0, at - REPORTED) : at]):
        return True
    opened: list[tuple[str, int]] = []
    for i, w in enumerate(window):
        inner = w.strip(".,;:!?…()[]{}–—*_-¿¡")
        alone = not any(c.isalnum() for c in w)
        if inner[:1] in _MARKS and (not alone or inner in _ALONE[0]):
            opened.append((_MARKS[inner[0]], i))
        if inner and (not alone or inner in _ALONE[1]):
            k = next((k for k in range(len(opened) - 1, -1, -1) if inner[-1] in opened[k][0]), None)
            if k is not None:
                if opened[k][1] <= at <= i:
                    return True
                del opened[k:]
    return False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def contexts(words: list[str]) -> np.ndarray:
    """A number for the ``CONTEXT`` words on either side of each word."""
    around = np.zeros(len(words) + 2 * CONTEXT, np.uint64)
    around[CONTEXT : len(words) + CONTEXT] = [zlib.crc32(w.encode()) + 1 for w in words]
    out = np.zeros(len(words), np.uint64)
    for j in range(2 * CONTEXT + 1):
        if j != CONTEXT:
            out = mixed(out + around[j : j + len(words)])
    return out.view(np.int64)


@lean
def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct whole words and beginnings of each text: one context, whether they stand in it twice or more, and its label."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            every = [folded(w) for w in (text or "").split()]
            found: dict[tuple[str, bool], tuple[int, bool]] = {}
            for w, c in zip(every, contexts(every).tolist(), strict=True):
                if len(w) >= SHORTEST - 1:
                    for key in ((w, False), *((w[:n], True) for n in range(SHORTEST, min(LONGEST, len(w)) + 1))):
                        known = found.get(key)
                        found[key] = (c, False) if known is None else (min(c, known[0]), True)
            columns = ([t for t, _ in found], [b for _, b in found], [c for c, _ in found.values()], [k for _, k in found.values()], [toxic] * len(found))
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["term", "beginning", "context", "twice", "toxic"])


def chosen(terms: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The entries among significant terms, the most telling first.

    The most telling of the terms that begin one another stands for them; words that allow an edit stay beside
    beginnings, which would take their misspellings' place, and come before them.
    """
    entries, begun, inner = [], set(), set()  # begun: accepted beginnings; inner: what beginnings and short words begin with
    for term, beginning in terms:
        starts = [term[:n] for n in range(1, len(term) + 1)]
        if beginning or len(term) < FUZZY:
            if not begun.isdisjoint(starts) or (beginning and term in inner):
                continue
            inner.update(starts)
            begun.update([term] * beginning)
        entries.append((term, beginning))
    return sorted(entries, key=lambda e: e[1])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, reporting: frozenset[str] = frozenset()) -> Scorer:
    """A scorer from the labelled documents outside the held-out fold; the sample bounds the lexicon."""
    known = aliased(labels, doc_id="doc_id", toxic=F.col("toxic").cast("int")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(3))
    some = known.where("toxic = 1").orderBy(order).limit(sample).unionByName(known.where("toxic = 0").orderBy(order).limit(sample))
    docs = aliased(documents, doc_id="doc_id", text="text").join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).cache()  # at most two samples of rows
    try:
        sizes = {r.toxic: r["count"] for r in docs.groupBy("toxic").count().collect()}
        if len(sizes) < 2:
            return Scorer(Lexicon([]), np.zeros(0), reporting=reporting)
        bad, clean, all_rows = F.col("toxic") == 1, F.col("toxic") == 0, sizes[0] + sizes[1]
        counts = {"t": bad, "c": clean, "t2": bad & F.col("twice"), "c2": clean & F.col("twice")}
        told = docs.mapInArrow(_terms, "term string, beginning boolean, context long, twice boolean, toxic int").repartition("term", "beginning")
        # Near copies and shared passages have a term in one context: it counts once.
        told = told.groupBy("term", "beginning", "context").agg(*[F.max(c).alias(k) for k, c in counts.items()])
        seen = told.groupBy("term", "beginning").agg(*[F.count_if(k).alias(k) for k in counts])

        def odds(t: str, c: str) -> Column:
            return F.log((F.col(t) + 0.5) / (sizes[1] + 1) / ((F.col(c) + 0.5) / (sizes[0] + 1)))

        def surprise(t: str, c: str) -> Column:
            """The log-likelihood ratio: terms of chance, or of copies of one text, are too rare or not significant."""
            part = lambda k, n: F.col(k) * F.log(F.greatest(k, F.lit(1)) / F.greatest((F.col(t) + F.col(c)) * n / all_rows, F.lit(1e-9)))
            return 2 * (part(t, sizes[1]) + part(c, sizes[0]))

        # A term tells by standing in a text, and more so by standing in it twice; the significant ones are no more than
        # a part of the sample's words.
        seen = seen.where(F.col("t") >= 3)
        seen = seen.withColumns({"odds": odds("t", "c"), "surprise": F.greatest(surprise("t", "c"), surprise("t2", "c2"))})
        rows = seen.where((F.col("surprise") >= 20) & (F.col("odds") >= ODDS)).orderBy(F.desc("surprise"), "beginning", F.desc(F.length("term")), "term").collect()
        entries = chosen([(r.term, r.beginning) for r in rows])
        scorer = Scorer(Lexicon(entries), np.ones(2 * len(entries)), reporting=reporting)
        hits = docs.mapInArrow(partial(_codes, scorer), "code int, toxic int").groupBy("code").agg(F.sum("toxic").alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).collect()
        scorer.value = _values(hits, len(scorer.value), sizes)
        scorer.reporting |= _reporting(docs.mapInArrow(partial(_cues, scorer), "cue string, toxic int"))
        rows = np.array([[*r.f, r.toxic] for r in docs.mapInArrow(partial(_features, scorer), "f array<double>, toxic int").collect()])  # five numbers a row of the sample, twice for a toxic one
        scorer.weights = _logistic(rows[:, :-1], rows[:, -1])
        return scorer
    finally:
        docs.unpersist()


@lean
def _codes(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hits of each text, with its label."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            codes = {c for w in set((text or "").split()) if (c := scorer._code(w)) >= 0}
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array([toxic] * len(codes), pa.int32())], ["code", "toxic"])


@lean
def _cues(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words shortly before the hits of each text that has some, and the empty word for each such text, with its label."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = (text or "").split()
            at = [i for i, w in enumerate(words) if scorer._code(w) >= 0]
            cues = {folded(w) for i in at for w in words[max(0, i - REPORTED) : i]} | ({""} if at else set())
            yield pa.RecordBatch.from_arrays([pa.array(cues, pa.string()), pa.array([toxic] * len(cues), pa.int32())], ["cue", "toxic"])


def _reporting(cues: DataFrame) -> frozenset[str]:
    """Words that stand before hits significantly more often in clean texts than in toxic ones."""
    seen = cues.groupBy("cue").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.sum("toxic").alias("t")).where("cue = '' OR c >= 3").collect()  # of the sample's hits
    every = next(((r.c, r.t) for r in seen if not r.cue), (0, 0))
    if 0 in every:
        return frozenset()

    def tells(c: int, t: int) -> bool:
        clean, bad = (c + 0.5) / (every[0] + 1), (t + 0.5) / (every[1] + 1)
        part = lambda k, n: k * np.log(max(k, 1) * sum(every) / ((c + t) * n))
        return np.log(clean / bad) >= ODDS and 2 * (part(c, every[0]) + part(t, every[1])) >= 20

    return frozenset(r.cue for r in seen if r.cue and tells(r.c, r.t))


@lean
def _features(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text, and of the toxic ones also as if all their hits were misspelled: the sample may have few such."""
    other = Scorer(scorer.lexicon, scorer.value, reporting=scorer.reporting)
    other.misspelled = 1
    for batch in batches:
        for i, j in runs(text_bytes(batch.column("text"))[1], BATCH_BYTES):
            text, toxic = batch.column("text")[i:j], batch.column("toxic")[i:j]
            bad = toxic.to_numpy() == 1
            again = other.features(text)[bad]
            again = again[again.any(axis=1)]
            f = np.concatenate((scorer.features(text), again)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), pa.array([*toxic.to_pylist(), *[1] * len(again)], pa.int32())], ["f", "toxic"])


def _values(hits: list, n: int, sizes: dict[int, int]) -> np.ndarray:
    """The log odds, at least 0, of each entry's exact and misspelled hits: how many texts of either class hold one.

    Misspellings that no text of the sample holds are worth a share of the entry; those that clean texts show are
    worth nothing unless they tell as much as an entry has to.
    """
    seen = np.zeros((2, n))
    for r in hits:
        seen[:, r.code] = r.c, r.t
    rate = (seen + 0.5) / np.array([[sizes[0] + 1], [sizes[1] + 1]])
    value = np.maximum(np.log(rate[1] / rate[0]), 0) * (seen[1] > 0)
    near, shown = value[1::2], seen[0, 1::2] > 0
    value[1::2] = np.where(seen[:, 1::2].any(axis=0), near * ~(shown & (near < ODDS)), SHARE * value[::2])
    return value


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method; classes weigh the same."""
    x = np.column_stack((np.ones(len(x)), x))
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (balance * (p - y)) + ridge * w
        hessian = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def scored(scorer: Scorer, text: Column) -> Column:
    """The score of a text column, without an exchange."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        released()
        for texts in batches:
            yield pa.array(scorer.score(texts))
        scorer.known.clear()
        released()

    return score(text)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of every document."""
    score = scored(fit(documents, labels), F.col("text"))
    docs = aliased(documents, doc_id="doc_id", text="text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return docs.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    return documents.where(scored(fit(documents, labels), documents["text"]) < 0.5)
