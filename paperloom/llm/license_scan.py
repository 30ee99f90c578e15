"""License notices in texts: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates are cut into words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased) and
five-word shingles. For a template of n words, windows of n + s words start every s = max(1, n // 4) words, so
each stretch of n words lies in a window. A window that holds 0.8 of a template's shingles has a Jaccard
similarity of at least 0.5 with it; ``BANDS`` bands of ``ROWS`` minima collide at 0.5 with a probability of
1 - (1 - 0.5**ROWS)**BANDS > 0.9999. Windows without any template shingle have similarity zero with all
templates and get no signature. Each retrieved template is held against the window exactly, by the 64-bit hashes
of their shingles. A notice with
inserted words can be longer than n + 1 words and lie in no window: a template that no window of a text holds is
looked for once more in windows longer by as many words as shingles may be missing (similarity 0.48 at least).

Defined results: null and empty texts and texts of fewer than five words match nothing; a template of fewer
than five words is refused; rows are judged one by one, so repeated rows are reported each, null doc_ids too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notices import NOTICES
from .shared import aliased, mixed, runs, span_hashes, text_bytes, word_hashes

SHINGLE, CONTAINED, BANDS, ROWS = 5, 0.8, 40, 2
BATCH_BYTES, MOST_WINDOWS = 1 << 22, 4096  # windows that are compared at a time
_BASE = 0xC2B2AE3D27D4EB4F

TEMPLATES = NOTICES  # a caller can pass any other bounded set
_INNER = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes by their first word (a last word of a text starts none) and each text's first word."""
    raw, offsets = text_bytes(column)
    raw = _LOWER[raw]
    inside = np.concatenate((_INNER[raw], [False]))
    begin = np.concatenate(([True], ~inside[:-1]))
    begin[offsets] = True
    starts = np.flatnonzero(inside & begin)
    close = np.concatenate((~inside[1:], [True]))
    close[offsets[1:] - 1] = True
    ends = np.flatnonzero(inside & close) + 1
    return word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


class Templates:
    """Shingle sets, window sizes and band keys of a set of templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        rng = np.random.default_rng(11)
        self.a = rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = [n for n, _ in templates]
        words, first = _tokens(pa.array([t for _, t in templates], pa.string()))
        self.size = np.diff(first)
        if (self.size < SHINGLE).any():
            raise ValueError(f"a template has fewer than {SHINGLE} words")
        self.sets = [np.unique(shingles(words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.all = np.unique(np.concatenate(self.sets))
        self.step = np.maximum(1, self.size // 4)
        # Band keys by window size; templates of one size share their windows.
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.own = {int(n): np.unique(np.concatenate([self.sets[t] for t in np.flatnonzero(self.size == n)])) for n in np.unique(self.size)}
        for t, s in enumerate(self.sets):
            table = self.bands.setdefault(int(self.size[t]), {})
            for band, key in enumerate(self.keys(self.minima(s[None, :]))[0].tolist()):
                table.setdefault((band, key), []).append(t)

    def minima(self, windows: np.ndarray) -> np.ndarray:
        """Signature of each row of shingle hashes."""
        return np.stack([mixed(windows * a).min(axis=1) for a in self.a], axis=1)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        grouped = signature.reshape(len(signature), BANDS, ROWS)
        return mixed((grouped * np.array([_BASE, 0x165667B19E3779F9], np.uint64)[:ROWS]).sum(axis=2, dtype=np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - SHINGLE + 1)
    at = np.arange(n)
    return span_hashes(words, at, at + SHINGLE, _BASE)


@lru_cache(4)
def _built(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def matches(t: Templates, words: np.ndarray) -> list[tuple[str, int, int, float]]:
    """License, first word, words and containment of each window of one text that holds a template."""
    own = shingles(words)
    every = np.flatnonzero(np.isin(own, t.all))
    out: list[tuple[str, int, int, float]] = []
    for n, table in t.bands.items():
        hit = every[np.isin(own[every], t.own[n])]
        if not len(hit):
            continue
        found = _held(t, table, words, own, hit, n, 0, set())
        out += found
        slack = int((1 - CONTAINED) * (n - SHINGLE + 1) + 1e-9)
        if slack:
            out += _held(t, table, words, own, hit, n, slack, {m[0] for m in found})
    return out


def _held(t: Templates, table: dict[tuple[int, int], list[int]], words: np.ndarray, own: np.ndarray, hit: np.ndarray, n: int, slack: int, known: set[str]) -> list[tuple[str, int, int, float]]:
    """Matches of the templates of n words, but the known ones, in windows with ``slack`` further words."""
    out: list[tuple[str, int, int, float]] = []
    s = max(1, n // 4)
    span = n + s + slack - SHINGLE + 1  # shingles of a window
    near = np.unique(np.concatenate([(hit - d) // s for d in range(0, span + s, s)]))
    near = near[(near >= 0) & (near * s < len(own))]
    if slack:  # only windows with enough template shingles can hold one
        least = CONTAINED * min(len(t.sets[c]) for c in {c for some in table.values() for c in some})
        near = near[np.searchsorted(hit, near * s + span) - np.searchsorted(hit, near * s) >= least]
    for part in range(0, len(near), MOST_WINDOWS):
        some = near[part : part + MOST_WINDOWS]
        windows = own[np.minimum(some[:, None] * s + np.arange(span), len(own) - 1)]  # a last window repeats its last shingle
        keys = t.keys(t.minima(windows))
        for row, (k, window) in enumerate(zip(some.tolist(), windows, strict=True)):
            for c in sorted({c for band, key in enumerate(keys[row].tolist()) for c in table.get((band, key), ())}):
                share = np.isin(t.sets[c], window).sum() / len(t.sets[c])
                if share >= CONTAINED and t.names[c] not in known:
                    out.append((t.names[c], k * s, min(n + s + slack, len(words) - k * s), float(share)))
    return out


def _scanned(templates: tuple[tuple[str, str], ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _built(templates)
    for batch in batches:
        for i, j in runs(text_bytes(batch.column("text"))[1], BATCH_BYTES):
            words, first = _tokens(batch.column("text")[i:j])
            n = max(0, len(words) - SHINGLE + 1)
            found = np.flatnonzero(np.isin(shingles(words), t.all)) if n else np.empty(0, np.int64)
            rows: list[tuple] = []
            ids = batch.column("doc_id")[i:j].to_pylist()
            for d in np.unique(np.searchsorted(first, found, "right") - 1).tolist():
                by: dict[str, list[tuple[int, int, float]]] = {}
                for name, *rest in matches(t, words[first[d] : first[d + 1]]):
                    by.setdefault(name, []).append(tuple(rest))
                rows += [(ids[d], name, [{"first_word": a, "words": n, "containment": c} for a, n, c in found]) for name, found in sorted(by.items())]
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("containment", pa.float64())]))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], kind)], ["doc_id", "license", "windows"])


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license and windows (first_word, words, containment) of each text and template that it holds."""
    given = tuple((templates or TEMPLATES).items())
    docs = aliased(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    return docs.mapInArrow(partial(_scanned, given), "doc_id long, license string, windows array<struct<first_word:int,words:int,containment:double>>")


def summary(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "license", F.size("windows").cast("long").alias("n_windows"), F.array_max("windows.containment").alias("containment"), F.array_min("windows.first_word").cast("long").alias("first_word"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


ORACLE_SQL = f"""
WITH t AS (SELECT license, {_sql_words("body")} AS w FROM (VALUES {", ".join(f"('{k}', '{_quoted(v)}')" for k, v in TEMPLATES.items())}) v(license, body)),
ts AS (SELECT license, len(w) AS n, greatest(1, len(w) // 4) AS s, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')))) AS shingle FROM t),
tn AS (SELECT license, any_value(n) AS n, any_value(s) AS s, count(*) AS total FROM ts GROUP BY license),
d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
h AS (SELECT p.doc_id, ts.license, ts.shingle, p.i - 1 AS at FROM p JOIN ts ON ts.shingle = concat_ws(' ', p.w[p.i], p.w[p.i+1], p.w[p.i+2], p.w[p.i+3], p.w[p.i+4])),
k AS (SELECT h.doc_id, h.license, h.shingle, tn.total, tn.s, unnest(range(greatest(0, CAST(ceil((h.at - (tn.n + tn.s - 5)) / tn.s) AS BIGINT)), h.at // tn.s + 1)) AS k FROM h JOIN tn USING (license)),
m AS (SELECT doc_id, license, k * any_value(s) AS first_word, count(DISTINCT shingle) / any_value(total) AS containment FROM k GROUP BY doc_id, license, k HAVING count(DISTINCT shingle) / any_value(total) >= 0.8),
l AS (SELECT *, CAST(floor(0.2 * (n - 4) + 1e-9) AS BIGINT) AS slack FROM tn),
k2 AS (SELECT h.doc_id, h.license, h.shingle, l.total, l.s, unnest(range(greatest(0, CAST(ceil((h.at - (l.n + l.s + l.slack - 5)) / l.s) AS BIGINT)), h.at // l.s + 1)) AS k FROM h JOIN l USING (license) WHERE slack > 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id IS NOT DISTINCT FROM h.doc_id AND m.license = h.license)),
m2 AS (SELECT doc_id, license, k * any_value(s) AS first_word, count(DISTINCT shingle) / any_value(total) AS containment FROM k2 GROUP BY doc_id, license, k HAVING count(DISTINCT shingle) / any_value(total) >= 0.8)
SELECT doc_id, license, count(*) AS n_windows, max(containment) AS containment, CAST(min(first_word) AS BIGINT) AS first_word FROM (SELECT * FROM m UNION ALL SELECT * FROM m2) GROUP BY doc_id, license
"""
