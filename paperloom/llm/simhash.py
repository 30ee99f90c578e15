"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the 64-bit majority of the XXH64 hashes of its word shingles. Fingerprints link at
``radius`` or fewer differing bits. Each bit position gets a vector of radius + 1 bits; table v (each vector but
zero) keeps the positions whose vector has an odd inner product with v. The vectors of at most ``radius``
differing positions leave a v that is orthogonal to all of them, so every linked pair agrees in table v on all
kept bits: no pair is missed. Buckets hold distinct fingerprints; large ones are cut into blocks and compared
block against block, so no task holds an unbounded bucket, and a task returns at most one link for each
fingerprint it saw (a spanning forest). Components come from rounds of hooking and contraction of the links.

Defined results: null text is empty; a text without words has fingerprint zero; null doc_ids never name a
component unless it has no other; repeated rows stay; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import aliased, fresh, released, runs, shuffle_partitions, staged, text_bytes, word_spans

SHINGLE, SEED, RADIUS, BLOCK = 4, 42, 4, 4096
BATCH_BYTES, PART = 1 << 20, 1 << 15  # PART: shingles that are hashed at a time


def _fingerprints(shingle: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released()
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for i, j in runs(text_bytes(batch.column("text"))[1], BATCH_BYTES):
            raw, offsets = text_bytes(batch.column("text")[i:j])
            starts, ends, first = word_spans(raw, offsets)
            upper = (raw >= 65) & (raw <= 90)
            # The words of all texts, lower-cased and each followed by one blank.
            length = ends - starts
            at = np.concatenate(([0], np.cumsum(length + 1)))
            joined = np.full(at[-1], 0x20, np.uint8)
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            keep = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            blank = np.zeros(at[-1], bool)
            blank[at[1:] - 1] = True
            joined[~blank] = (raw | (upper.view(np.uint8) << 5))[keep]
            data = joined.tobytes()
            words = np.diff(first)
            count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
            doc = np.repeat(np.arange(j - i), count)
            begin = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
            stop = np.minimum(begin + shingle, first[1:][doc])
            ones = np.zeros((j - i, 64), np.int64)
            for p in range(0, len(doc), PART):
                d, a, b = doc[p : p + PART], at[begin[p : p + PART]], at[stop[p : p + PART]] - 1
                hashes = np.array([digest(data[x:y], seed) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
                bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                edge = np.flatnonzero(np.diff(d, prepend=-1))
                ones[d[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
            more = (ones * 2 > count[:, None]).astype(np.uint8)
            prints = np.packbits(more, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""
    docs = aliased(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    return docs.mapInArrow(partial(_fingerprints, shingle, seed), "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: 2**(radius + 1) - 1 of them, each keeping about half of the bits."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked values a, b: each value and the least of its component, without the least ones."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (hop := new[new]).tobytes() != new.tobytes():
            new = hop
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _group_links(f: np.ndarray, group: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within groups of fingerprints that stand together."""
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.empty(0, np.int64)
    length = np.diff(np.append(edge, len(f)))
    a, b = [], []
    for s, n in zip(edge[length > 48].tolist(), length[length > 48].tolist(), strict=True):  # by search: a tree of each component
        rest = f[s : s + n]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    found = rest[near]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    front += list(found)
                    rest = rest[~near]
    small = np.repeat(length <= 48, length)
    f, group = f[small], group[small]
    for d in range(1, int(min(48, length.max(initial=0)))):
        near = (group[d:] == group[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)
        a.append(f[:-d][near])
        b.append(f[d:][near])
    return a, b


def _links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    left: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def told() -> pa.RecordBatch:
        x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])

    for batch in _ended(batches):
        if batch is not None:
            f = np.concatenate((left[0], batch.column("fp").to_numpy().view(np.uint64)))
            g = np.concatenate((left[1], batch.column("g").to_numpy()))
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            left, f, g = (f[cut:], g[cut:]), f[:cut], g[:cut]
        else:
            f, g = left
        x, y = _group_links(f, g, radius)
        a += x
        b += y
        held += sum(map(len, x))
        if held > 1 << 20:
            yield told()
            a, b, held = [], [], 0
    if held:
        yield told()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """u, v: pairs of distinct fingerprints of a table with fp, which join all that are within the radius."""
    n = shuffle_partitions(prints.sparkSession)
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for t, m in enumerate(masks(radius))])
    rows = prints.select("fp", F.explode(tables).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = merged(rows, sizes, "k")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = shared.select("k", "fp", mine.alias("mine"), other.alias("other"))
    group = F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("g")
    dealt = dealt.select("fp", group).repartition(n, "g").sortWithinPartitions("g", "fp")
    return dealt.mapInArrow(partial(_links, radius), "u long, v long")


def merged(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by exchange. Staged tables are small as files, so Spark would send them whole through the driver, whose memory
    they then outgrow: fingerprints and their labels are as many as the documents."""
    return a.join(b.hint("merge"), on, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for every node of the links u, v a node that stands for its component."""
    less = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("x"))  # noqa: E731  a random order keeps the rounds few
    edges, label = staged(edges.where("u <> v").distinct(), "links"), None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        ends = edges.select(less("u").alias("a"), less("v").alias("b"))
        hook = staged(ends.select(F.greatest("a", "b")["x"].alias("node"), F.least("a", "b").alias("low")).groupBy("node").agg(F.min("low")["x"].alias("low")), "hooks")
        # One hop further where the lower node moves as well.
        up = hook.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        hook = staged(merged(hook, up, "low", "left").select("node", F.coalesce("lower", "low").alias("low")), "hooks")
        to = lambda df, c, hook=hook: merged(df, hook.select(F.col("node").alias(c), F.col("low").alias("_low")), c, "left").withColumn(c, F.coalesce("_low", c)).drop("_low")
        label = hook.select("node", F.col("low").alias("root")) if label is None else to(label, "root").unionByName(merged(hook, label, "node", "left_anti").select("node", F.col("low").alias("root")))
        label = staged(label, "labels")
        edges = staged(to(to(edges, "u"), "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    else:
        raise RuntimeError(f"components are not closed after {rounds} rounds")
    if label is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return label.unionByName(label.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach)."""
    docs = staged(fingerprints(documents, shingle, seed), "fingerprints")
    prints = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    label = components(links(prints, radius, block))
    linked = staged(merged(label.withColumnRenamed("node", "fp"), prints, "fp").select("fp", "root", "least"), "linked")
    least = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = merged(linked, least, "root").select("fp", "component_id")
    named = staged(merged(prints, known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return merged(docs, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, **settings) -> DataFrame:
    """The documents, with all their columns, but only one of each group: the one with the group's least doc_id.

    Of several rows with that doc_id the one with the least fingerprint, text hash and position in the staged
    table stays; documents without a doc_id are in no group's name, so they stay unless they are copies of a named one.
    """
    row = fresh(documents, "_row")
    table = staged(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = table.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text")
    prints_of = staged(fingerprints(narrow.select(F.col("row").alias("doc_id"), "text"), settings.get("shingle", SHINGLE), settings.get("seed", SEED)), "fingerprints")
    named = merged(narrow.select("row", "id", F.xxhash64("text").alias("tie")), prints_of.select(F.col("doc_id").alias("row"), "fp"), "row")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tie", "row")
    prints = staged(named.groupBy("fp").agg(F.min(order).alias("least")), "prints")
    label = components(links(prints, settings.get("radius", RADIUS), settings.get("block", BLOCK)))
    group = staged(merged(prints, label.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least"), "groups")
    stay = group.groupBy("root").agg(F.min("least")["row"].alias(row)).select(row)
    return merged(table, stay, row, "left_semi").select(*documents.columns)
