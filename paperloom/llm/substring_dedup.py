"""Removal of word windows that stand more than once, by matching statistics on compressed FM-indexes.

A window is ``window`` consecutive words of one document. Runs of windows with one minimiser (the least hash of
their ``GRAM``-word grams) form segments; equal windows have equal minimisers, so all that can match meets in
the shard of a minimiser's hash, and each shard gets an FM-index of its own:

1. counts: minimisers that stand once in the corpus are out; those that stand often are hot,
2. claims: segments of the others, and single windows where the minimiser is hot, are named by content hashes;
   each content is counted, and one chunk of the corpus is chosen to send it,
3. shards: the contents of a shard are indexed (suffix order, BWT in a wavelet matrix, marks where neighbours
   share fewer than window - 1 words) and streamed against the index from their last word to their first:
   every step is one backward-search step, after the match is shortened to window - 1 words by the marks where
   it had reached the window (the matching statistics, cut off at the window). A window is repeated if the
   contents in its interval stand at least twice in the corpus,
4. removal: every chunk gets the repeated windows of its contents and drops the words that they cover.

So the documents that are streamed against a shard's index are their segments with a repeated minimiser, each
distinct content once; all else can't match. Nothing but counts, hashes and one copy of each repeated content is
exchanged; texts stay in their chunk of a staged table, and each chunk's part of a result is a folder beside it. A
minimiser or text that a third of the documents share is one count or one content for each chunk. Keys are dealt
into buckets whose number follows the bytes of text (``BUCKET_BYTES``), a chunk sends a row a bucket at most and
never more rows than keys, and no index holds more than ``INDEX_WORDS`` words and one key's contents. Words are
told apart by 64-bit hashes.

Defined results: null text has no words; repeated rows are documents of their own, so all their windows stand
elsewhere; doc_id may be null or repeated; texts shorter than a window lose nothing; a word may be long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import fresh, opened, released, runs, scratch_dir, shuffle_partitions, span_hashes, staged, text_bytes, word_hashes, word_spans
from .wavelet import WaveletMatrix

WINDOW, GRAM, HOT, MOST = 35, 8, 256, 32  # MOST: windows of a segment, one bit each in a mask
BATCH_BYTES, HELD, INDEX_WORDS, BUCKET_BYTES = 1 << 22, 1 << 20, 1 << 20, 1 << 25
_GRAM_BASE, _TEXT_BASE = 0x9FB21C651E98DF25, 0xA0761D6478BD642F
_ROWS = "bucket int, chunk int, kind int, a binary, b binary, c binary, d binary"
_BACK = "chunk int, bucket int, a binary, b binary, c binary"


@dataclass
class Piece:
    """Words and segments of some whole documents."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # each document's first word, n + 1
    words: np.ndarray  # hashes
    at: np.ndarray  # each segment's first word
    n: np.ndarray  # its windows
    mini: np.ndarray  # its minimiser
    grams: np.ndarray  # hashes of all grams
    window: int

    def places(self) -> np.ndarray:
        """How often each segment's minimiser stands in it: windows of one segment are equal only if it stands twice."""
        span = self.n + self.window - min(GRAM, self.window)
        begin = np.cumsum(span) - span
        grams = self.grams[np.repeat(self.at - begin, span) + np.arange(span.sum())]
        return np.add.reduceat(grams == np.repeat(self.mini, span), begin, dtype=np.uint64) if len(span) else np.empty(0, np.uint64)

    def keys(self, chosen: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, windows and two key parts of the contents: chosen segments, or their windows where hot."""
        whole, split = chosen & ~hot, chosen & hot
        at, n = self.at[whole], self.n[whole]
        a, b = self.mini[whole], span_hashes(self.words, at, at + n + self.window - 1, _TEXT_BASE)
        n2 = self.n[split]
        at2 = np.repeat(self.at[split] - np.cumsum(n2) + n2, n2) + np.arange(n2.sum())
        a2 = span_hashes(self.words, at2, at2 + self.window, _TEXT_BASE)
        return np.concatenate((at, at2)), np.concatenate((n, np.ones(len(at2), np.int64))), np.concatenate((a, a2)), np.concatenate((b, ~a2))


def cut_up(column: pa.Array, window: int) -> Piece:
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    gram = min(GRAM, window)
    i = np.arange(max(0, len(words) - gram + 1))
    low = grams = span_hashes(words, i, i + gram, _GRAM_BASE)
    width, reach = 1, window - gram + 1  # the least of ``reach`` grams, by doubling
    while width < reach:
        step = min(width, reach - width)
        low = np.minimum(low[: max(0, len(low) - step)], low[step:])
        width += step
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(np.arange(len(words)) + window <= first[1:][doc])
    mini = low[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (whole[1:] != whole[:-1] + 1) | (doc[whole[1:]] != doc[whole[:-1]])
    begin = np.flatnonzero(new)
    run = np.arange(len(whole)) - np.repeat(begin, np.diff(np.append(begin, len(whole))))
    cut = np.flatnonzero(run % MOST == 0)
    return Piece(raw, starts, ends, first, words, whole[cut], np.diff(np.append(cut, len(whole))), mini[cut], grams, window)


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[int, pa.RecordBatch, Piece]]:
    released()
    for batch in batches:
        chunks = batch.column("_chunk").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            some = batch.slice(lo, hi - lo)
            for i, j in runs(text_bytes(some.column("text"))[1], BATCH_BYTES):
                yield int(chunks[lo]), some.slice(i, j - i), cut_up(some.column("text").slice(i, j - i), window)


def beside(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the shards answered to one chunk, ordered by the first key part."""
    fs, path = opened(f"{folder}/chunk={chunk}")
    files = [f.path for f in fs.get_file_info(_selector(path)) if f.path.endswith(".parquet")]
    found: list[list[bytes]] = [[], [], []]
    for f in files:
        with fs.open_input_file(f) as source:
            table = pq.ParquetFile(source).read(["a", "b", "c"])
        for k, name in enumerate("abc"):
            found[k] += table.column(name).to_pylist()
    a, b = (np.frombuffer(b"".join(x), np.uint64) for x in found[:2])
    c = np.frombuffer(b"".join(found[2]), np.uint64)
    order = np.lexsort((b, a)) if len(b) == len(a) else np.argsort(a)
    return a[order], b[order] if len(b) else b, c[order] if len(c) else c


def _selector(path: str):
    from pyarrow.fs import FileSelector

    return FileSelector(path, allow_not_found=True)


class Sides:
    """The answers of one round for the chunk at hand."""

    def __init__(self, folder: str | None):
        self.folder, self.chunk, self.found = folder, None, None

    def of(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if chunk != self.chunk:
            self.chunk, self.found = chunk, beside(self.folder, chunk)
        return self.found


def looked_up(a: np.ndarray, b: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of (a, b) in a table ordered by (a, b), or -1; a table without b is ordered by a."""
    ta, tb, _ = table
    if not len(ta):
        return np.full(len(a), -1)
    at = np.searchsorted(ta, a)
    if len(tb):
        one = mixed_pair(a, b)
        names = mixed_pair(ta, tb)
        order = np.argsort(names)
        at = np.minimum(np.searchsorted(names[order], one), len(ta) - 1)
        at = order[at]
        return np.where((ta[at] == a) & (tb[at] == b), at, -1)
    at = np.minimum(at, len(ta) - 1)
    return np.where(ta[at] == a, at, -1)


def mixed_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b * np.uint64(0x9E3779B97F4A7C15))


def _sent(kind: int, chunk: int, a: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Arrays dealt into one row for each bucket of the first key part."""
    bucket = (a >> np.uint64(24)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    ends = np.append(edge[1:], len(a))
    columns = [[x[order[s:e]].tobytes() for s, e in zip(edge, ends, strict=True)] for x in (a, *more)]
    columns += [[None] * len(edge)] * (4 - len(columns))
    head = [pa.array(bucket[edge].astype(np.int32)), pa.array([chunk] * len(edge), pa.int32()), pa.array([kind] * len(edge), pa.int32())]
    yield pa.RecordBatch.from_arrays([*head, *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "chunk", "kind", "a", "b", "c", "d"])


def _merged(keys: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (a, b) and their summed counts."""
    a, b, n = (np.concatenate(x) for x in zip(*keys, strict=True))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[edge], b[edge], np.add.reduceat(n, edge) if len(edge) else n


def _counts(window: int, buckets: int, side: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rounds 1 (no side: minimisers) and 2 (contents): distinct keys of a chunk with their counts."""
    sides, held, size, now = Sides(side), [], 0, None

    def told() -> Iterator[pa.RecordBatch]:
        if held:
            a, b, n = _merged(held)
            yield from _sent(0, now, a, buckets, *((n,) if side is None else (b, n)))

    for chunk, _, p in _pieces(batches, window):
        if chunk != now or size > HELD:
            yield from told()
            held, size, now = [], 0, chunk
        if side is None:
            a = b = p.mini
            n = p.places()
        else:
            row = looked_up(p.mini, p.mini, (sides.of(chunk)[0], np.empty(0, np.uint64), sides.of(chunk)[2]))
            status = sides.of(chunk)[2][row] if len(sides.of(chunk)[2]) else np.zeros(len(row), np.uint64)
            _, _, a, b = p.keys(row >= 0, status == 2)
            n = np.ones(len(a), np.uint64)
        if len(a):
            held.append(_merged([(a, b, n)]))
            size += len(held[-1][0])
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0][0])
    yield from told()


def _by_bucket(batches: Iterator[pa.RecordBatch], least: int = 1, size=lambda row: 1) -> Iterator[list[dict]]:
    """Rows of whole buckets, which stand together; buckets are taken together until they hold ``least``."""
    held, now, total = [], None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if total >= least:
                    yield held
                    held, total = [], 0
                now = row["bucket"]
            held.append(row)
            total += size(row)
    if held:
        yield held


def _answer(chunk: int, bucket: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple:
    return chunk, bucket, a.tobytes(), b.tobytes(), c.astype(np.uint64).tobytes()


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["chunk", "bucket", "a", "b", "c"])


def _numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint64)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1: tell each chunk which of its minimisers stand twice or more (1), and which are hot (2)."""
    for rows in _by_bucket(batches):
        names = [_numbers(r["a"]) for r in rows]
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(at, np.concatenate([_numbers(r["b"]) for r in rows])).astype(np.uint64)
        status = (total > 1).astype(np.uint64) + (total > HOT)
        out = []
        for r, a in zip(rows, names, strict=True):
            s = status[np.searchsorted(every, a)]
            out.append(_answer(r["chunk"], r["bucket"], a[s > 0], np.empty(0, np.uint64), s[s > 0]))
        yield _answers(out)


def _claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2: tell each chunk the corpus counts of its contents that may repeat, doubled, plus one if it shall send."""
    for rows in _by_bucket(batches):
        a, b, n = (np.concatenate([_numbers(r[k]) for r in rows]) for k in "abc")
        chunks, of = np.unique(np.array([r["chunk"] for r in rows]), return_inverse=True)
        of = np.repeat(of, [len(r["a"]) // 8 for r in rows])
        order = np.lexsort((of, b, a))
        a, b, n, of = a[order], b[order], n[order], of[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_a | np.concatenate(([True], b[1:] != b[:-1]))
        total = np.bincount(np.cumsum(new_a) - 1, n)[np.cumsum(new_a) - 1]
        count = np.bincount(np.cumsum(new) - 1, n)[np.cumsum(new) - 1].astype(np.uint64)
        own = new | np.concatenate(([True], of[1:] != of[:-1]))  # a chunk told in parts may name a content in each: one answer
        keep = own & ((total > 1) | (b != ~a))  # a single window must stand twice, a segment may repeat itself
        a, b, code, of = a[keep], b[keep], (count * np.uint64(2) + new)[keep], of[keep]
        by = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(len(chunks) + 1))
        yield _answers([_answer(c, rows[0]["bucket"], *(x[by[s:e]] for x in (a, b, code))) for c, s, e in zip(chunks.tolist(), cuts[:-1], cuts[1:], strict=True) if e > s])


def _contents(window: int, buckets: int, first: str, second: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 3: the contents that a chunk shall send, each with its corpus count and its words' hashes."""
    status, claims, now, done = Sides(first), Sides(second), None, set()
    for chunk, _, p in _pieces(batches, window):
        if chunk != now:
            now, done = chunk, set()
        a0, _, s0 = status.of(chunk)
        row = looked_up(p.mini, p.mini, (a0, np.empty(0, np.uint64), s0))
        at, n, a, b = p.keys(row >= 0, (s0[row] if len(s0) else np.zeros(len(row), np.uint64)) == 2)
        row = looked_up(a, b, claims.of(chunk))
        code = claims.of(chunk)[2][row] if len(claims.of(chunk)[2]) else np.zeros(len(row), np.uint64)
        mine = np.flatnonzero((row >= 0) & (code & np.uint64(1) == 1))
        _, once = np.unique(row[mine], return_index=True)
        mine = np.array([m for m in mine[once].tolist() if int(row[m]) not in done], np.int64)
        done.update(row[mine].tolist())
        if not len(mine):
            continue
        bucket = (a[mine] >> np.uint64(24)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        mine, bucket = mine[order], bucket[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        cols: list[list] = [[], [], [], []]
        for s, e in zip(edge, np.append(edge[1:], len(mine)), strict=True):
            m = mine[s:e]
            length = n[m] + window - 1
            words = p.words[np.repeat(at[m] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            head = np.stack((code[m] >> np.uint64(1), n[m].astype(np.uint64)), axis=1)
            for c, x in zip(cols, (a[m], b[m], head, words), strict=True):
                c.append(x.tobytes())
        k = len(edge)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array([chunk] * k, pa.int32()), pa.array([1] * k, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "chunk", "kind", "a", "b", "c", "d"])


class FMIndex:
    """FM-index of contents (arrays of codes from 1): suffix order by the first words, BWT in a wavelet matrix."""

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        rank, width, short = text.astype(np.int64), 1, None
        while width < window:  # order by the first ``width`` codes; patterns are no longer than that
            width = min(width * 2, window + 1) if width * 2 < window else width * 2
            step = width // 2
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        self.order = np.argsort(rank, kind="stable")
        self.n = n
        bwt = text[self.order - 1]
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.planes = WaveletMatrix.build(bwt.astype(np.uint32), self.levels)
        codes = np.arange(int(text.max(initial=0)) + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(codes)))))[:-1]
        self.base, _ = self.planes.span(codes, np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64))
        # Marks where neighbours in the order share fewer than window - 1 words.
        share = span_hashes_at(text, window - 1)
        mark = np.ones(n + 1, bool)
        mark[1:n] = share[self.order[1:]] != share[self.order[:-1]]
        at = np.arange(n + 1)
        self.down = np.maximum.accumulate(np.where(mark, at, 0))
        self.up = np.minimum.accumulate(np.where(mark, at, n)[::-1])[::-1]

    def extended(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step."""
        a, b = self.planes.span(code, lo, hi)
        return self.before[code] + a - self.base[code], self.before[code] + b - self.base[code]


def span_hashes_at(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` codes from each position on; zeros follow the text."""
    padded = np.concatenate((text.astype(np.uint64), np.zeros(width, np.uint64)))
    i = np.arange(len(text))
    return span_hashes(padded + np.uint64(1), i, i + width, _TEXT_BASE)


def repeated_windows(words: np.ndarray, length: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Masks of each content's windows (bit k: the k-th) that stand twice, counting each content by its weight."""
    _, code = np.unique(words, return_inverse=True)
    code = code.astype(np.int64) + 1
    ends = np.cumsum(length)
    text = np.insert(code, ends, 0)  # a zero ends each content
    begin = np.concatenate(([0], (ends + np.arange(1, len(ends) + 1))[:-1]))
    index = FMIndex(text, window)
    of = np.searchsorted(begin, index.order, "right") - 1
    weights = np.concatenate(([0], np.cumsum(weight[of])))
    lo, hi, matched = np.zeros(len(length), np.int64), np.full(len(length), index.n), np.zeros(len(length), np.int64)
    masks = np.zeros(len(length), np.uint64)
    at = length.astype(np.int64) - 1
    live = np.flatnonzero(at >= 0)
    while len(live):
        a, b, m = lo[live], hi[live], matched[live]
        full = m == window
        a, b = np.where(full, index.down[a], a), np.where(full, index.up[b], b)
        a, b = index.extended(text[begin[live] + at[live]], a, b)
        m = np.minimum(m - full + 1, window)
        twice = (m == window) & (weights[b] - weights[a] > 1)
        masks[live[twice]] |= np.uint64(1) << at[live[twice]].astype(np.uint64)
        lo[live], hi[live], matched[live] = a, b, m
        at[live] -= 1
        live = live[at[live] >= 0]
    return masks


def _indexed(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 3: index the contents of some buckets, and tell each chunk the repeated windows of what it claimed."""
    for rows in _by_bucket(batches, INDEX_WORDS, lambda r: len(r["d"]) // 8 if r["kind"] else 0):
        sent = [r for r in rows if r["kind"]]
        if not sent:
            continue
        a, b = (np.concatenate([_numbers(r[k]) for r in sent]) for k in "ab")
        head = np.concatenate([_numbers(r["c"]).reshape(-1, 2) for r in sent])
        words, length = np.concatenate([_numbers(r["d"]) for r in sent]), head[:, 1].astype(np.int64) + window - 1
        # A chunk that is read in parts, or a task that runs twice, may send a content twice.
        order = np.lexsort((b, a))
        once = order[np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))]
        begin, length = (np.cumsum(length) - length)[once], length[once]
        words = words[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())]
        a, b, weight = a[once], b[once], head[once, 0].astype(np.int64)
        # Equal windows have equal first key parts: an index for each run of them.
        before = np.concatenate(([0], np.cumsum(length)))
        first = np.searchsorted(a, a)
        cuts = [0, *(np.flatnonzero(np.diff(before[first] // INDEX_WORDS)) + 1).tolist(), len(a)]
        masks = np.concatenate([repeated_windows(words[before[s] : before[e]], length[s:e], weight[s:e], window) for s, e in zip(cuts[:-1], cuts[1:], strict=True)])
        table = (a, b, masks)
        out = []
        for r in rows:
            if not r["kind"]:
                ra, rb = _numbers(r["a"]), _numbers(r["b"])
                row = looked_up(ra, rb, table)
                mask = np.where(row >= 0, table[2][row], 0)
                if mask.any():
                    out.append(_answer(r["chunk"], r["bucket"], ra[mask > 0], rb[mask > 0], mask[mask > 0]))
        yield _answers(out)


def covered(p: Piece, status: tuple, masks: tuple) -> np.ndarray:
    """Whether each word lies in a repeated window."""
    a0, _, s0 = status
    row = looked_up(p.mini, p.mini, (a0, np.empty(0, np.uint64), s0))
    at, n, a, b = p.keys(row >= 0, (s0[row] if len(s0) else np.zeros(len(row), np.uint64)) == 2)
    row = looked_up(a, b, masks)
    edge = np.zeros(len(p.words) + 1, np.int64)
    hit = row >= 0
    if hit.any():
        mask, start, most = masks[2][row[hit]], at[hit], n[hit]
        for k in range(MOST):
            w = start[(mask >> np.uint64(k) & np.uint64(1) == 1) & (k < most)] + k
            np.add.at(edge, w, 1)
            np.add.at(edge, w + p.window, -1)
    return np.cumsum(edge[:-1]) > 0


def kept(p: Piece, drop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words that stay, each followed by one blank, and where each document's begin."""
    stay = ~drop
    length = np.where(stay, p.ends - p.starts, 0)
    out = np.concatenate(([0], np.cumsum(length + stay)))
    inside = np.zeros(len(p.raw) + 1, np.int8)
    inside[p.starts[stay]] += 1
    inside[p.ends[stay]] -= 1
    blank = np.zeros(out[-1], bool)
    blank[out[1:][stay] - 1] = True
    joined = np.full(out[-1], 0x20, np.uint8)
    joined[~blank] = p.raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return joined.tobytes(), out[p.first]


def _removed(window: int, first: str, third: str, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 4: each document with its counts and the words that stay, as their digest or as its text."""
    status, masks = Sides(first), Sides(third)
    for chunk, batch, p in _pieces(batches, window):
        drop = covered(p, status.of(chunk), masks.of(chunk))
        data, at = kept(p, drop)
        total = np.concatenate(([0], np.cumsum(drop)))
        texts = [data[s : max(s, e - 1)] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        words, gone = np.diff(p.first), np.diff(total[p.first])
        if digest:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(gone), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        else:  # a text that loses nothing stays as it is
            text = batch.column("text").to_pylist()
            new = pa.array([t.decode() if g else old for t, g, old in zip(texts, gone.tolist(), text, strict=True)], pa.string())
            names = [c for c in batch.schema.names if c != "_chunk"]
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in names], names)


def _remove(documents: DataFrame, schema: str, digest: bool, window: int) -> DataFrame:
    spark = documents.sparkSession
    n, size = shuffle_partitions(spark), Observation()
    measured = documents.observe(size, F.sum(F.octet_length("text")).alias("bytes"))
    table = staged(measured.withColumn("_chunk", F.spark_partition_id()), "chunks")
    buckets = max(8 * n, (size.get["bytes"] or 0) // BUCKET_BYTES)
    narrow = table.select("_chunk", "text")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    def filed(df: DataFrame, name: str) -> str:
        path = scratch_dir(spark, name)
        df.repartition(n, "chunk").write.partitionBy("chunk").option("compression", "none").parquet(path)
        return path

    first = filed(dealt(narrow.mapInArrow(partial(_counts, window, buckets, None), _ROWS)).mapInArrow(_repeated, _BACK), "repeated")
    second = filed(dealt(narrow.mapInArrow(partial(_counts, window, buckets, first), _ROWS)).mapInArrow(_claimed, _BACK), "claimed")
    claims = spark.read.schema(_BACK).parquet(second).select("bucket", "chunk", F.lit(0).alias("kind"), "a", "b", "c", F.lit(None).cast("binary").alias("d"))
    sent = narrow.mapInArrow(partial(_contents, window, buckets, first, second), _ROWS)
    third = filed(dealt(claims.unionByName(sent)).mapInArrow(partial(_indexed, window), _BACK), "masks")
    return table.mapInArrow(partial(_removed, window, first, third, digest), schema)


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _remove(docs, "doc_id long, n_words long, n_removed long, kept_sha256 string", True, window)


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns; a text that loses words is the rest of its words, joined by one blank."""
    names = documents.columns
    inner = [fresh(documents, "_own_chunk") if c.lower() == "_chunk" else c for c in names]  # the operator's own name
    documents = documents.toDF(*inner)
    return _remove(documents, documents.schema, False, window).toDF(*names)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 0) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS n FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM h WHERE n > 1),
k AS (SELECT d.doc_id, x.j, x.word FROM d, (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) x WHERE x.doc_id = d.doc_id),
s AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.j) AS kept, count(*) AS n FROM k ANTI JOIN c ON c.doc_id = k.doc_id AND c.j = k.j GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
