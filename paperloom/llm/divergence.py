"""Source divergence audit: how far the words of each source are from every other source of its language.

Words are counted once: per batch by sorting, then by Spark's partial aggregation. A language's terms are dealt to
shards by their hash, its sources to blocks by theirs, so that a seat (language, shard, block) holds the counts of a
few sources for a bounded number of terms, as a compressed sparse vector. Seats stay where they are, cached by
partition. The vectors then rotate as in a round-robin tournament (the circle method): in each round every seat's
vector travels to the seat of the block that it meets in this round, and both directions of all source pairs are
evaluated there, so no block meets another twice and a round moves each vector at most once. A round's partial sums
are written before the next begins. In a round of its own the language's vector visits every seat, and a heap for
each source keeps the terms that it uses far more often; the heaps of the shards are merged by rank.

Values are exact: shares are integers of parts in 10**9, products that could leave 64 bits are taken in Python's
integers, and sums over all terms stay below 2**63 (a sum of (p - q)**2 / q is at most about the square of the sum
of p). Terms that neither block has are added as one product.

Defined results: null text, lang and source are empty; rows are documents, whatever their doc_id; a source without
words takes part with count 0 everywhere; a language without kept terms gives value 0 to each pair; a language's
only source has no pair; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import aliased, released, runs, scratch_dir, shuffle_partitions, staged, text_bytes, word_spans

LEAST_DOCUMENTS, UNIT, TOP = 3, 1_000_000_000, 200
BATCH_BYTES, SHARD_ENTRIES, BLOCK_SOURCES, COLUMNS = 8 << 20, 1 << 18, 8, 1 << 14
#: Bytes that stand between terms: what is ASCII and no letter.
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_SEAT = "lang string, shard int, block int"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language, source and term of some texts: how often it stands there and in how many texts."""
    released()
    for batch in batches:
        for i, j in runs(text_bytes(batch.column("text"))[1], BATCH_BYTES):
            raw, offsets = text_bytes(batch.column("text")[i:j])
            starts, ends, first = word_spans(raw, offsets, _BETWEEN)
            if not len(starts):
                continue
            letters = np.where(_UPPER[raw], raw | 0x20, raw)[~_BETWEEN[raw]]
            edges = np.concatenate(([0], np.cumsum(ends - starts)))
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(letters)).dictionary_encode()
            size = len(words.dictionary)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            each, n = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
            pairs = pa.StructArray.from_arrays([pc.fill_null(batch.column(c)[i:j].cast(pa.string()), "") for c in ("lang", "source")], ["lang", "source"])
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in pairs.to_pylist()])
            keys, at = np.unique(group[each // size] * size + each % size, return_inverse=True)
            listed = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())
            where = pa.array(keys // size)
            yield pa.RecordBatch.from_arrays(
                [listed[0].take(where), listed[1].take(where), words.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at))],
                ["lang", "source", "term", "n", "docs"],
            )


def counted(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of each term of each source."""
    docs = aliased(documents, lang="lang", source="source", text="text")
    rows = docs.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _pack(value: object) -> bytes:
    return zlib.compress(pickle.dumps(value, 5), 1)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard, whose rows stand together by term: a vector for each block, the language's vector and each source's sum."""
    released()
    now, held = None, []
    for batch in batches:
        key = pa.StructArray.from_arrays([batch.column("lang"), batch.column("shard")], ["lang", "shard"])
        edge = [0, *(np.flatnonzero(pc.not_equal(batch.column("shard")[1:], batch.column("shard")[:-1]).to_numpy(zero_copy_only=False) | pc.not_equal(batch.column("lang")[1:], batch.column("lang")[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            here = (key[a]["lang"].as_py(), key[a]["shard"].as_py())
            if held and here != now:
                yield _shard(now, held)
                held = []
            now = here
            held.append(batch.slice(a, b - a))
    if held:
        yield _shard(now, held)


def _shard(seat: tuple[str, int], batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    words = table.column("term").combine_chunks().dictionary_encode()  # in the order of the rows: by term
    term, docs, n = words.indices.to_numpy(), table.column("docs").to_numpy(), table.column("n").to_numpy()
    keep = np.bincount(term, docs).astype(np.int64) >= LEAST_DOCUMENTS
    row = keep[term]
    index = np.cumsum(keep) - 1
    term, n, block = index[term[row]], n[row], table.column("block").to_numpy()[row]
    sources = table.column("source").combine_chunks().filter(pa.array(row)).dictionary_encode()
    source, names = sources.indices.to_numpy(), sources.dictionary.to_pylist()
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, source, n)
    out: list[tuple] = [(None, s, t, None) for s, t in enumerate(sums.tolist())]
    totals = np.zeros(int(keep.sum()), np.int64)
    np.add.at(totals, term, n)
    out.append((-1, None, len(totals), _pack((words.dictionary.filter(pa.array(keep)).to_pylist(), _narrow(totals)))))
    for b in np.unique(block).tolist():
        some = block == b
        used, at = np.unique(source[some], return_inverse=True)
        out.append((b, None, None, _pack(([names[s] for s in used], _narrow(np.diff(term[some], prepend=0)), _narrow(at), _narrow(n[some])))))
    columns = list(zip(*out, strict=True))
    listed = [pa.array([seat[0]] * len(out), pa.string()), pa.array([seat[1]] * len(out), pa.int32()), pa.array(columns[0], pa.int32()), pa.array([None if s is None else names[s] for s in columns[1]], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())]
    return pa.RecordBatch.from_arrays(listed, ["lang", "shard", "block", "source", "total", "vector"])


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """Each count's part in 10**9 of a source's words, with one more of each term."""
    if counts.size and int(counts.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (c + 1) // (total + terms) for c in counts.tolist()], np.int64)
    return 1 + UNIT * (counts.astype(np.int64) + 1) // (total + terms)


class Vectors:
    """The counts of a block's sources in a shard."""

    def __init__(self, members: list[dict], vector: bytes | None, vocabulary: int):
        self.names, self.totals, self.vocabulary = [m["source"] for m in members], [m["total"] for m in members], vocabulary
        own, steps, source, self.n = pickle.loads(zlib.decompress(vector)) if vector is not None else ([], *[np.zeros(0, np.int64)] * 3)
        at = {s: k for k, s in enumerate(self.names)}
        self.term, self.source = np.cumsum(steps.astype(np.int64)), np.array([at[s] for s in own], np.int64)[source] if len(own) else source
        self.unused = [int(shares(np.zeros(1, np.int64), t, vocabulary)[0]) if vocabulary else 1 for t in self.totals]

    def dense(self, terms: np.ndarray) -> np.ndarray:
        """The shares of these terms (in order) for each source."""
        a, b = (int(np.searchsorted(self.term, t, side)) for t, side in ((terms[0], "left"), (terms[-1], "right")))
        counts = np.zeros((len(self.names), len(terms)), np.int64)
        counts[self.source[a:b], np.searchsorted(terms, self.term[a:b])] = self.n[a:b]
        return np.array([shares(c, t, self.vocabulary) for c, t in zip(counts, self.totals, strict=True)])


def meeting(a: Vectors, b: Vectors, terms: int, same: bool) -> list[tuple[str, str, int]]:
    """source, other and the sum of floor((p - q)**2 / q) over a shard's terms, for the sources of two blocks, both directions."""
    used = np.union1d(a.term, b.term)
    there, back = np.zeros((2, len(a.names), len(b.names)), np.int64)
    for k in range(0, len(used), COLUMNS):
        p, q = (v.dense(used[k : k + COLUMNS]) for v in (a, b))
        for i in range(len(a.names)):
            squares = (p[i] - q) ** 2
            there[i] += (squares // q).sum(axis=1)
            back[i] += (squares // p[i]).sum(axis=1)
    out = []
    for i, s in enumerate(a.names):
        for j, t in enumerate(b.names):
            if not same or i < j:
                square, rest = (a.unused[i] - b.unused[j]) ** 2, terms - len(used)
                out += [(s, t, int(there[i, j]) + rest * (square // b.unused[j])), (t, s, int(back[i, j]) + rest * (square // a.unused[i]))]
    return out


def _met(same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            a = Vectors(row["members"], row["vector"], row["vocabulary"])
            b = a if same else Vectors(row["visitors"], row["visitor"], row["vocabulary"])
            found = meeting(a, b, row["terms"], same)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(found), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["lang", "source", "item", "value"])


def telling(a: Vectors, words: list[str], totals: np.ndarray, lang_total: int, top: int) -> list[tuple[str, str, int]]:
    """source, term and value of each source's ``top`` terms that it uses more than its language does."""
    q = shares(totals, lang_total, a.vocabulary)
    out = []
    for i, s in enumerate(a.names):
        mine = a.source == i
        term = a.term[mine]
        p = shares(a.n[mine], a.totals[i], a.vocabulary)
        more = p > q[term]
        term, p = term[more], p[more]
        value = (p - q[term]) ** 2 // q[term]
        if len(value) > top:
            some = value >= np.partition(value, -top)[-top]
            term, value = term[some], value[some]
        best = heapq.nsmallest(top, zip((-value).tolist(), [words[t] for t in term.tolist()], strict=True))
        out += [(s, w, -v) for v, w in best]
    return out


def _told(top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words, totals = pickle.loads(zlib.decompress(row["visitor"]))
            found = telling(Vectors(row["members"], row["vector"], row["vocabulary"]), words, totals, row["lang_total"], top)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(found), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["lang", "source", "item", "value"])


def opponent(block: Column, blocks: Column, turn: int) -> Column:
    """The block that this one meets in a round of the circle method; none (null) in its free rounds and after its last."""
    ring = blocks + blocks % 2 - 1
    to = F.when(block == ring, F.lit(turn)).when(block == turn, ring).otherwise(F.pmod(F.lit(2 * turn) - block, ring))
    return F.when((F.lit(turn) < ring) & (to < blocks), to)


def seats(counts: DataFrame, documents: DataFrame, block_sources: int = BLOCK_SOURCES, shard_entries: int = SHARD_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The seats with their sources' vectors, and the languages' vectors by shard."""
    spark = counts.sparkSession
    n = shuffle_partitions(spark)
    sources = staged(aliased(documents, lang=F.coalesce("lang", F.lit("")), source=F.coalesce("source", F.lit(""))).distinct(), "sources")
    entries = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("entries"))
    sizes = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(entries, "lang", "left")
    blocks, shards = F.ceil(F.col("sources") / block_sources).cast("int"), F.greatest(F.lit(1), F.ceil(F.coalesce("entries", F.lit(0)) / shard_entries)).cast("int")
    sizes = staged(sizes.select("lang", blocks.alias("blocks"), shards.alias("shards")), "sizes")  # a row a language
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    rows = counts.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term", F.lit(1)), F.col("shards")).cast("int").alias("shard"), block, "source", "term", "n", "docs")
    dealt = rows.repartition(n, "lang", "shard").sortWithinPartitions("lang", "shard", "term", "source")
    packed = staged(dealt.mapInArrow(_packed, f"{_SEAT}, source string, total long, vector binary"), "vectors")
    languages = packed.where("block = -1").select("lang", "shard", F.col("total").alias("terms"), F.col("vector").alias("visitor"))
    words = packed.where("block IS NULL").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    members = sources.join(sizes, "lang").join(words, ["lang", "source"], "left").select("lang", block, "blocks", "shards", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("member"))
    whole = members.groupBy("lang").agg(F.sum("member.total").alias("lang_total")).join(languages.groupBy("lang").agg(F.sum("terms").alias("vocabulary")), "lang", "left")
    # A block holds about ``block_sources`` sources: they are dealt by their hash.
    by_block = members.groupBy("lang", "block", "blocks", "shards").agg(F.collect_list("member").alias("members"))
    each = by_block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    vectors = packed.where("block >= 0").select("lang", "shard", "block", "vector")
    out = each.join(vectors, ["lang", "shard", "block"], "left").join(languages.drop("visitor"), ["lang", "shard"], "left").join(whole, "lang")
    out = out.withColumns({"terms": F.coalesce("terms", F.lit(0)), "vocabulary": F.coalesce("vocabulary", F.lit(0))})
    return staged(out, "seats"), languages


def audit(documents: DataFrame, top: int = TOP, block_sources: int = BLOCK_SOURCES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distance to the others, and the terms that tell it apart."""
    spark = documents.sparkSession
    n = shuffle_partitions(spark)
    residents, languages = seats(staged(counted(documents), "counts"), documents, block_sources, shard_entries)
    residents = residents.repartition(n, "lang", "shard", "block").persist()
    schema = "lang string, source string, item string, value long"
    try:
        pairs = residents.select("lang", "members", "vector", "vocabulary", "terms").mapInArrow(partial(_met, True), schema)
        path = scratch_dir(spark, "meetings")
        pairs.write.parquet(path)
        most = residents.agg(F.max("blocks")).first()[0] or 1
        for turn in range(most + most % 2 - 1 if most > 1 else 0):
            to = opponent(F.col("block"), F.col("blocks"), turn)
            moved = residents.select("lang", "shard", to.alias("block"), F.col("members").alias("visitors"), F.col("vector").alias("visitor"), F.col("block").alias("home")).where("block < home").drop("home")
            met = residents.join(moved.hint("shuffle_hash"), ["lang", "shard", "block"]).select("lang", "members", "vector", "vocabulary", "terms", "visitors", "visitor")
            met.mapInArrow(partial(_met, False), schema).write.mode("append").parquet(path)
        visited = residents.join(languages.drop("terms"), ["lang", "shard"]).select("lang", "members", "vector", "vocabulary", "lang_total", "visitor")
        terms = staged(visited.mapInArrow(partial(_told, top), schema), "terms")
    finally:
        residents.unpersist()
    distances = spark.read.schema(schema).parquet(path).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(distances).unionByName(ranked(terms.withColumn("part", F.lit("term"))).where(F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
s AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS n FROM s LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(t.n + v.v AS HUGEINT) AS p
  FROM t JOIN k ON t.lang = k.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // CAST(v.n + v.v AS HUGEINT) AS q FROM k JOIN v ON k.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= 200
"""
