"""Token ids of whole texts in wavelet-matrix shard files.

Texts are put in ascending document order by a range exchange, encoded with a public tokenizer, closed with
an end id and cut into shards of about ``SHARD_TOKENS`` ids. A shard file holds the sorted list of the ids that
occur (the codes), one zstd-compressed bit-plane a code bit, and the documents' ids and lengths; access,
counting and occurrence lookup work on the planes (``ShardFile``).

Defined results: null text is empty (its document is the end id alone); null doc_id comes first; equal doc_ids
are ordered by the hash of their text; repeated rows stay; an empty table writes no file and returns no row;
a text longer than a shard makes one shard of its own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import UnitCache, aliased, held, read_file, runs, scratch_dir, shuffle_partitions, staged, text_bytes, write_file
from .wavelet import WaveletMatrix, packed, unpacked

SHARD_TOKENS = 1 << 21
BATCH_BYTES = 1 << 24
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


class UnitEncoder:
    """The tokenizers library behind a bounded cache of text units.

    A byte-level BPE vocabulary with the usual word pattern never joins ids across a blank or newline that
    follows no other white space, so each text is cut before those, Arrow numbers the distinct units of a batch,
    and the library encodes the units that aren't known. A text in which such a cut isn't certain (three white-
    space characters in a row, or two at its end), or which holds one of the tokenizer's added strings, goes to the
    library whole. A vocabulary that doesn't cut a sample of texts that way is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.length = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())])
        self.cache = UnitCache(self._ids, limit=800_000)
        for text in _PROBES:
            if self.encode(pa.array([text]))[0].tolist() != self.library.encode(text, add_special_tokens=False).ids:
                raise ValueError("this tokenizer joins ids over blanks; texts can't be cut into units")

    def _ids(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units, many in one call: those that are one blank or newline and one word stand side by side as in a text."""
        joint = [u[:1] in (" ", "\n") and u.split() == [u[1:]] and not any(a in u for a in self.added) for u in units]
        plain = [u for u, j in zip(units, joint, strict=True) if j]
        alone = iter([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([u for u, j in zip(units, joint, strict=True) if not j], add_special_tokens=False)])
        together: list[np.ndarray] = []
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = np.array(self.library.encode("".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(u.encode()) for u in some]), "left") + 1
            together += np.split(ids, cuts[:-1])
        rest = iter(together)
        return [next(rest) if j else next(alone) for j in joint]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and each text's count."""
        raw, offsets = text_bytes(column)
        whole = self._uncertain(raw, offsets, column)
        cut = (raw == 0x20) | (raw == 0x0A)
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        for k in np.flatnonzero(whole):
            cut[offsets[k] : offsets[k + 1]] = False
            cut[offsets[k]] = True
        return self.cache.ids(raw, offsets, np.flatnonzero(cut))

    def _uncertain(self, raw: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
        """Texts that aren't cut: white space may stand before a cut and after it."""
        blank = _BLANK[raw]
        pair = np.zeros(len(raw), bool)
        pair[1:] = blank[1:] & blank[:-1]
        pair[1:] |= _WIDE[raw[:-1]] & ((raw[1:] & 0xC0) == 0x80) & ((raw[:-1] != 0xC2) | (raw[1:] == 0x85) | (raw[1:] == 0xA0))
        out = np.zeros(len(offsets) - 1, bool)
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero(pair), "right") - 1):
            out[k] = bool(_RUN.search(column[int(k)].as_py()))
        for a in self.added:
            out |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        return out


def unit_encoder(path: str) -> UnitEncoder:
    """One encoder for all tasks of a worker process, so that its cache lasts."""
    return held(f"unit encoder {path}", lambda: UnitEncoder(path))


_PROBES = ("Two words, then 12 more; don't  stop.\nA line\n\nanother \t tab", "é 漢字 🙂 x\xa0y  z", " a b\n")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WIDE = np.zeros(256, bool)  # first bytes of white space beyond ASCII
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_RUN = re.compile(r"\s\s(?:\s|\Z)")


class ShardFile:
    """One shard: token access, counting and occurrence lookup on the planes."""

    def __init__(self, data: bytes):
        self.arrays, self.planes = unpacked(data)
        self.alphabet = self.arrays["alphabet"]

    @staticmethod
    def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
        alphabet = np.flatnonzero(np.bincount(ids)).astype("<u4")
        code = np.zeros(int(alphabet[-1]) + 1, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        planes = WaveletMatrix.build(code[ids], max(1, (len(alphabet) - 1).bit_length()))
        arrays = {
            "alphabet": alphabet,
            "doc": np.array([d or 0 for d in doc_ids], "<i8"),
            "null": np.array([d is None for d in doc_ids], "u1"),
            "length": np.array(lengths, "<i8"),
        }
        return packed(arrays, planes)

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.planes.decode()]

    def access(self, i: np.ndarray) -> np.ndarray:
        return self.alphabet[self.planes.access(np.asarray(i))]

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def count(self, token: int) -> int:
        code = self._code(token)
        return 0 if code is None else self.planes.count(code)

    def occurrences(self, token: int) -> np.ndarray:
        code = self._code(token)
        return np.empty(0, np.int64) if code is None else self.planes.select(code, np.arange(self.planes.count(code)))


def _writer(folder: str, tokenizer: str, end_id: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = unit_encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/shard-{part:06d}-{seq:06d}.plwm"
            write_file(path, ShardFile.build(docs, lengths, np.concatenate(ids)))
            row = ([part], [seq], [path], [len(docs)], [held])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "n_docs", "n_tokens"])

        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for i, j in runs(offsets, BATCH_BYTES):
                flat, counts = encoder.encode(batch.column("text")[i:j].fill_null(""))
                ends = np.cumsum(counts)
                flat, counts = np.insert(flat, ends, end_id), counts + 1
                names, a, ends = batch.column("doc_id")[i:j].to_pylist(), 0, np.cumsum(counts)
                while a < len(names):
                    b = min(len(names), int(np.searchsorted(ends, ends[a] - counts[a] + shard_tokens - held)) + 1)
                    docs += names[a:b]
                    lengths += counts[a:b].tolist()
                    ids.append(flat[ends[a] - counts[a] : ends[b - 1]])
                    held += len(ids[-1])
                    a = b
                    if held >= shard_tokens:
                        yield flush()
                        docs, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return write


def write_shards(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files and return their manifest with each shard's global ``start``."""
    spark = documents.sparkSession
    folder = folder or scratch_dir(spark, "token-shards")
    docs = aliased(documents, doc_id=F.col("doc_id").cast("long"), text="text").withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), F.col("tie"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie")).drop("tie")
    manifest = staged(dealt.mapInArrow(_writer(folder, tokenizer, end_id, shard_tokens), MANIFEST), "token-manifest")
    # Two levels of running sums: one row a range partition, then the few shards of each partition.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(F.col("before"), F.lit(0)) + F.coalesce(own, F.lit(0))
    return manifest.join(parts.select("part", "before"), "part").select("path", "n_docs", "n_tokens", start.cast("long").alias("start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = ShardFile(read_file(row["path"]))
            ids, length = shard.tokens().astype("<u4"), shard.arrays["length"]
            ends = np.cumsum(length)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            doc = pa.array(shard.arrays["doc"], pa.int64(), mask=shard.arrays["null"].astype(bool))
            yield pa.RecordBatch.from_arrays([doc, pa.array(row["start"] + ends - length), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files that a manifest lists."""
    n = max(1, shuffle_partitions(manifest.sparkSession))
    return manifest.select("path", "start").repartition(n).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
