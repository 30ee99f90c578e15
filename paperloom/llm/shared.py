"""Pieces that the operators of this subpackage share: scratch tables in the shared folder, files in any
store that pyarrow can open, and vectorised word splitting and hashing over Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


_OWN_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, where it may be unset, a folder of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN_ROOTS.setdefault(app, f"file://{os.path.join(tempfile.gettempdir(), f'paperloom-{app}')}")
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and return the table."""
    path = scratch_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, on any machine."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_file(uri: str, data: bytes) -> None:
    """Write whole files so that a task that runs twice leaves one complete file: write aside, then move.

    Stores differ in whether a move replaces a file; where it doesn't, the other attempt's file has the same content.
    """
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(aside) as out:
        out.write(data)
    try:
        fs.move(aside, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(aside)


def exists(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def read_file(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aliased(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns: further input columns, with whatever names, can't clash with an operator's own."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (n + 1) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most ``limit`` bytes each; a longer document is its own range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``WORD`` (or of what stands between other bytes) and each document's first word (n + 1)."""
    inside = ~between[raw]
    edge = offsets[offsets < len(raw)]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(raw):
        before[0] = after[-1] = False
        before[edge] = False
        after[offsets[(offsets > 0) & (offsets <= len(raw))] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place of an avalanche step."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, at least n of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())

        def table(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS[base] = table(base), table(pow(base, -1, 1 << 64))
    return _POWERS[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of values[starts:ends], the same wherever a span stands."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash for each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, "right")))
        base = starts[i]
        out[i:j] = span_hashes(_BYTE[raw[base : ends[j - 1]]], starts[i:j] - base, ends[i:j] - base, _BASE)
        i = j
    return out


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What one operator keeps for all tasks of a worker process; it takes the place of what another one kept."""
    if name not in _HELD:
        released()
        _HELD[name] = make()
    return _HELD[name]


def released() -> None:
    """Give back what former operators and tasks have left in this worker process, which Spark uses again for other stages."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(function: Callable) -> Callable:
    """A function over a task's batches that gives its memory back before it begins and when it has ended: idle workers stay small."""

    @wraps(function)
    def run(*args):
        released()
        yield from function(*args)
        released()

    return run


class UnitCache:
    """Ids of text units: Arrow numbers the distinct units of a batch, and only units that aren't known are encoded.

    A full cache forgets the half that fewest batches used.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.used = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def _forget(self) -> None:
        names, length = list(self.known), np.diff(self.ends)
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.flat = self.flat[np.repeat(self.ends[stay] - np.cumsum(length[stay]) + length[stay], length[stay]) + np.arange(length[stay].sum())]
        self.ends, self.used = np.concatenate(([0], np.cumsum(length[stay]))), self.used[stay] // 2

    def _rows(self, units: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self._forget()
        rows = list(map(self.known.get, units))
        new = [u for u, r in zip(units, rows, strict=True) if r is None]
        if new:
            first, ids = len(self.known), self.encode(new)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *ids])
            self.ends = np.concatenate([self.ends, np.cumsum([len(i) for i in ids]) + self.ends[-1]])
            fresh = iter(range(first, first + len(new)))
            rows = [next(fresh) if r is None else r for r in rows]
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        at = np.array(rows, np.int64)
        self.used[at] += 1  # the units of a batch are distinct
        return at

    def ids(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents at offsets, whose units begin at starts, one after the other; and each document's count."""
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        edges = np.append(starts, len(raw)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        rows = self._rows(units.dictionary.to_pylist())[units.indices.to_numpy()]
        flat, ends = self.flat, self.ends
        length = ends[rows + 1] - ends[rows]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat(ends[rows] - total[:-1], length) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])
