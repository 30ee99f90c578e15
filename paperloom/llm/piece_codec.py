"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding is an agenda of adjacent symbol pairs in score order: every pair whose join is a piece waits in a
heap, the best-scored pair (the leftmost among equals) is joined, and its new neighbours enter the heap. A
piece of such a vocabulary has its space mark at the front only, so a text falls into units of spaces (the mark
itself, U+2581, is one) and the characters after them that can't influence each other; each distinct unit of an
Arrow batch goes through the agenda once, and its ids are held against the sentencepiece library's. One whole
text of every run of texts is held against the library as well; should they differ, all texts of that run are.

Defined results: null text is empty; an empty text is the begin and the end id alone and decodes to nothing; a
character without a piece becomes its UTF-8 bytes; where the library disagrees with the agenda, on a unit or on a
whole text, its ids count and ``checked`` is false for the document. doc_id is passed on as it is, rows are
neither joined nor dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import UnitCache, aliased, held, runs, text_bytes

MARK = "▁"
BATCH_BYTES = 1 << 21
_WRONG = np.uint32(1 << 31)  # set in the ids of a unit on which the library disagrees


class PieceCodec:
    """One vocabulary: the agenda, its check and the library's decoder."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(sp.get_piece_size())
        usual = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in every):
            raise ValueError("a vocabulary with unused pieces isn't supported")
        self.id = {sp.id_to_piece(i): i for i in usual}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces reach over spaces; texts can't be cut into units")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.cache = UnitCache(self._units)

    def agenda(self, unit: str) -> list[int]:
        """Ids of one unit, whose spaces are marks already."""
        score, sym = self.score, list(unit)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-score[p], i, i + 1, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in score]
        heapify(heap)
        while heap:
            _, i, j, piece = heappop(heap)
            if right[i] != j or not sym[i] or sym[i] + sym[j] != piece:
                continue  # one of the two has been joined since
            sym[i], sym[j] = piece, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (p := piece + sym[k]) in score:
                    heappush(heap, (-score[p], i, k, p))
            if (h := left[i]) >= 0 and (p := sym[h] + piece) in score:
                heappush(heap, (-score[p], h, i, p))
        out: list[int] = []
        for s in sym:
            if s:
                if (i := self.id.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.byte[b] for b in s.encode()]
        return out

    def _units(self, units: list[str]) -> list[np.ndarray]:
        own = [self.agenda(u.replace(" ", MARK)) for u in units]
        said = self.library.encode([u[1:] for u in units], num_threads=1)  # the library puts the first mark itself
        return [np.array(a, np.uint32) if a == b or u == " " else np.array(b, np.uint32) | _WRONG for u, a, b in zip(units, own, said, strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end, each text's count, and whether the library agrees."""
        raw, offsets = spaced(*text_bytes(column))
        first = offsets[:-1][np.diff(offsets) > 0]
        raw = np.insert(raw, first, 0x20)
        offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        cut = raw == 0x20
        cut[1:] &= raw[:-1] != 0x20
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        ids, counts = self.cache.ids(raw, offsets, np.flatnonzero(cut))
        ends = np.concatenate(([0], np.cumsum(counts)))
        wrong = np.concatenate(([0], np.cumsum(ids & _WRONG != 0)))
        ids, agreed = ids & ~_WRONG, np.diff(wrong[ends]) == 0
        if len(counts) and self.library.encode(column[0].as_py() or "", num_threads=1) != ids[: ends[1]].tolist():
            said = [np.array(x, np.uint32) for x in self.library.encode(column.fill_null("").to_pylist(), num_threads=1)]
            agreed &= [x.tolist() == ids[a:b].tolist() for x, a, b in zip(said, ends[:-1], ends[1:], strict=True)]
            ids, counts = np.concatenate(said), np.array([len(x) for x in said], np.int64)
        return ids, counts, agreed


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank for each space mark: the vocabulary has one symbol for both."""
    a, b, c = MARK.encode()
    at = np.flatnonzero(raw[:-2] == a) if len(raw) > 2 else np.empty(0, np.int64)
    at = at[(raw[at + 1] == b) & (raw[at + 2] == c)]
    if not len(at):
        return raw, offsets
    raw = raw.copy()
    raw[at] = 0x20
    return np.delete(raw, np.concatenate((at + 1, at + 2))), offsets - 2 * np.searchsorted(at, offsets)


def piece_codec(model: str) -> PieceCodec:
    """One codec for all tasks of a worker process, so that its cache lasts."""
    return held(f"piece codec {model}", lambda: PieceCodec(model))


def _coded(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids with begin and end, decoded text, checked."""
    codec = piece_codec(model)
    sp = codec.library
    bos, eos = sp.bos_id(), sp.eos_id()
    for batch in batches:
        _, offsets = text_bytes(batch.column("text"))
        for i, j in runs(offsets, BATCH_BYTES):
            texts = batch.column("text")[i:j].fill_null("")
            ids, counts, agreed = codec.encode(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, np.repeat(np.concatenate(([0], ends)), [1, *[2] * (len(ends) - 1), 1]), 0)
            at = np.concatenate(([0], np.cumsum(counts + 2)))
            ids[at[:-1]], ids[at[1:] - 1] = bos, eos
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            flat, cuts = ids.tolist(), at.tolist()
            decoded = sp.decode([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], lists, pa.array(decoded, pa.string()), pa.array(agreed)], ["doc_id", "ids", "decoded", "checked"])


def _digested(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _coded(model, batches):
        lists = batch.column("ids")
        at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        hexes = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(hexes), pa.array(texts), batch.column("checked")], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "checked"])


def _input(documents: DataFrame) -> DataFrame:
    return aliased(documents, doc_id=F.col("doc_id").cast("long"), text="text")


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded and checked of every document; no exchange, bounded batches."""
    return _input(documents).mapInArrow(partial(_coded, model), "doc_id long, ids array<int>, decoded string, checked boolean")


def digests(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and checked, made of what ``encode_documents`` returns in the same pass."""
    return _input(documents).mapInArrow(partial(_digested, model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, checked boolean")
