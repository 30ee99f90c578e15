"""Exact top-k inner products with a KD-tree per shard.

Each shard of at most ``SHARD_ROWS`` vectors becomes one KD-tree: median splits of the widest dimension, and
around each node the tight box of its vectors. A query visits the tree best first: nodes wait in a heap by the
largest inner product that their box allows, and the search of a tree ends when that bound falls below the
query's k-th best score so far. That k-th score is propagated: each block of queries goes through one shard
first (the one of its number), and takes what it found there as the start for all others.

Trees and query blocks are files in the shared folder; a task holds one of each at a time. Rows are dealt to parts
by the hash of their number in the staged table, so copies of one vector spread like any others. A part that got no
row has no file; a block whose home is such a shard starts without a bound. No tree is skipped but by its bound, so
the result is exact: highest scores, ties to the smaller vec_id.

Scores are exact integers: double arithmetic where no partial sum can pass 2**53, 64-bit integers where none can
pass 2**63, Python's integers beyond; a score whose size is beyond 2**63 - 1 counts as that number with its sign.
Components of more than 1e150 count as 1e150, so that bounds stay finite, and bounds are widened by more than their
rounding.

Defined results: a vector that is null or holds null or non-finite components takes no part; a null vec_id takes
no part; vectors of another length than the query's are no candidates; repeated rows are candidates each, but a
query's own vec_id never is; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import aliased, exists, read_file, scratch_dir, shuffle_partitions, staged, write_file

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK, MOST, LARGEST = 4096, 64, 256, 1e150, (1 << 63) - 1
_FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as a double: whole numbers beyond 64 bits stay what they are."""

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(MOST)), F.lit(-MOST))
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def products(rows: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers that are held in doubles, within 64 bits; most: what no partial sum passes."""
    if most < 2.0**53:
        return (rows @ query).astype(np.int64)
    if most < 2.0**62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query.tolist()]
    return np.array([min(max(sum(int(x) * y for x, y in zip(r, q, strict=True)), -LARGEST), LARGEST) for r in rows.tolist()], np.int64)


class Tree:
    """A KD-tree in arrays; nodes are numbered as they are split, leaves hold ranges of the ordered rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        lo, hi, child, span = [], [], [], []

        def node(a: int, b: int) -> int:
            at = len(span)
            part = rows[order[a:b]]
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            span.append((a, b))
            child.append((-1, -1))
            return at

        todo = [node(0, len(ids))] if len(ids) else []
        while todo:
            at = todo.pop()
            a, b = span[at]
            wide = hi[at] - lo[at]
            if b - a <= leaf or not wide.any():
                continue
            d, mid = int(wide.argmax()), (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(rows[order[a:b], d], mid - a)]
            child[at] = node(a, mid), node(mid, b)
            todo += child[at]
        self.ids, self.rows = ids[order], rows[order]
        self.lo, self.hi = (np.array(x).reshape(len(span), -1) for x in (lo, hi))
        self.child, self.span = child, span
        self.most = np.abs(rows).max(axis=0, initial=0.0) * (1 + 2.0**-20)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product that the node's box allows."""
        bound = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        size = np.abs(queries) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T
        return np.where(size < 2.0**52, bound, bound + size * 2.0**-30)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """best: a heap of (score, -vec_id) with at most k entries, which is improved."""
        heap = [(-bound[0], 0)] if len(self.span) else []
        most = self.most @ np.abs(query)
        while heap:
            b, at = heapq.heappop(heap)
            if len(best) == k and max(-b, -LARGEST) < best[0][0]:
                break  # an equal bound may still hold a smaller vec_id
            left, right = self.child[at]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            a, z = self.span[at]
            scores, ids = products(self.rows[a:z], query, most), self.ids[a:z]
            some = np.flatnonzero(ids != own)
            if len(best) == k:
                some = some[scores[some] >= best[0][0]]
            if len(some) > k:
                some = some[np.lexsort((ids[some], -scores[some]))[:k]]
            for s, i in zip(scores[some].tolist(), ids[some].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Ids and vectors of each part, whose rows stand together."""
    now, ids, vectors = None, [], []
    for batch in batches:
        for p, i, v in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if p != now and ids:
                yield now, np.array(ids, np.int64), vectors
                ids, vectors = [], []
            now = p
            ids.append(i)
            vectors.append(np.array(v, np.float64))
    if ids:
        yield now, np.array(ids, np.int64), vectors


def _filed(folder: str, make, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file for each part, with what ``make`` makes of it."""
    for part, ids, vectors in _parts(batches):
        path = f"{folder}/{part:08d}.bin"
        write_file(path, pickle.dumps(make(ids, vectors), 5))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path])], ["part", "path"])


def _trees(ids: np.ndarray, vectors: list[np.ndarray]) -> dict[int, Tree]:
    """A tree for each length of vectors."""
    sizes = np.array([len(v) for v in vectors])
    return {int(n): Tree(ids[sizes == n], np.array([v for v in vectors if len(v) == n]).reshape(-1, n)) for n in np.unique(sizes)}


def numbered(rows: DataFrame) -> DataFrame:
    """With a number for each row, to be staged: equal rows are told apart by it."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def files(rows: DataFrame, parts: int, make, name: str) -> DataFrame:
    """part and path of the files into which staged rows (id, v, row) are dealt evenly by the hash of their number."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    dealt = rows.select(part.alias("part"), "id", "v").repartition(min(parts, shuffle_partitions(spark)), "part").sortWithinPartitions("part")
    return staged(dealt.mapInArrow(partial(_filed, scratch_dir(spark, name), make), "part int, path string"), name)


def _searched(k: int, first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of a query block and a shard the better finds; on the first shard they are also filed beside the block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors = pickle.loads(read_file(row["queries"]))
            trees: dict[int, Tree] = pickle.loads(read_file(row["trees"]))
            known: dict[int, list[tuple[int, int]]] = {} if first or not exists(row["queries"] + ".kth") else pickle.loads(read_file(row["queries"] + ".kth"))
            out: list[tuple[int, int, int]] = []
            sizes = np.array([len(v) for v in vectors])
            for n, tree in trees.items():
                some = np.flatnonzero(sizes == n)
                if not len(some):
                    continue
                queries = np.array([vectors[r] for r in some]).reshape(-1, n)
                for q, bound, own in zip(queries, tree.bounds(queries), ids[some].tolist(), strict=True):
                    before = known.get(own, [])
                    best = list(before)
                    heapq.heapify(best)
                    tree.search(q, own, bound, best, k)
                    out += [(own, -i, int(s)) for s, i in (Counter(best) - Counter(before)).elements()]
                    if first:
                        known[own] = best
            if first:
                write_file(row["queries"] + ".kth", pickle.dumps(known, 5))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score; both tables have id (long) and v (array of integers)."""
    as_rows = lambda t: t.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    candidates = staged(numbered(as_rows(candidates)), "vectors")
    queries = staged(numbered(as_rows(queries).groupBy("id").agg(F.min("v").alias("v"))), "queries")
    shards, blocks = max(1, -(-candidates.count() // shard_rows)), max(1, -(-queries.count() // block))
    trees = files(candidates, shards, _trees, "trees").select(F.col("part").alias("shard"), F.col("path").alias("trees"))
    packs = files(queries, blocks, lambda ids, vectors: (ids, vectors), "query-blocks").select(F.col("part").alias("block"), F.col("path").alias("queries"))
    n, home = shuffle_partitions(candidates.sparkSession), F.pmod(F.col("block"), F.lit(shards)).cast("int")
    search = lambda pairs, first: pairs.repartition(n).mapInArrow(partial(_searched, k, first), _FOUND)
    found = staged(search(packs.withColumn("shard", home).join(trees, "shard").select("queries", "trees"), True), "found")
    others = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    return best_of(found.unionByName(search(others.join(trees, "shard").select("queries", "trees"), False)), k)


def exact_search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top k of the quantised vectors for each row whose vec_id is divisible by ``every``."""
    base = aliased(embeddings, id="vec_id", v="embedding").where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", quantised(F.col("v")))
    return top_k(base, base.where(F.col("id") % every == 0), k)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
