"""Approximate nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Vectors x get the further component sqrt(M**2 - |x|**2), M the largest norm, and queries a zero, so that the
largest inner product is the least distance. They are rotated by a random orthogonal matrix and kept in blocks
of columns. Lists are the cells of a k-means, as many as the root of the number of rows; it is fitted on a sample
(the rows with the least hashes: ``SAMPLE`` or ``FITTED`` a list, but no more than ``SAMPLE_BYTES`` of components
hold, and no more lists than such a sample can fit); every row is put in its list. How many of its nearest lists a
query goes through is measured: as many as hold ``COVERED`` of the true neighbours of ``TRIED`` distinct queries
within the sample. In a list, the partial distance over d of D rotated columns, scaled by
D/d, is tested against the query's k-th distance: a candidate is abandoned once it exceeds it by more than
(1 + EPSILON / sqrt(d)); the survivors of all blocks get their exact inner product of the original vectors. A
query's nearest list is scanned first, and its k-th distance holds for the other lists. Lists of more than
``CHUNK`` rows are cut by row number, and so are their queries.

Each vector length has an index of its own, fitted on its own rows; lengths are taken one after another.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null
vec_ids; vectors of another length than the query's are no candidates; repeated rows are candidates each, of query
rows with one vec_id the least vector asks; a table of fewer candidates than k gives them all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import best_of, numbered, usable
from .shared import aliased, read_file, scratch_dir, shuffle_partitions, staged, write_file

SAMPLE, SAMPLE_BYTES, FITTED, LEAST_PROBED = 16384, 1 << 26, 16, 4
COVERED, TRIED, EPSILON, COLUMNS, CHUNK, QUERY_BLOCK, AT_ONCE = 0.95, 512, 2.1, 16, 4096, 256, 32
_FOUND = "query_id long, vec_id long, score double"


class Index:
    """Rotation, centres (rotated) and the number of lists to probe, fitted on a sample of vectors of one length."""

    def __init__(self, sample: np.ndarray, names: np.ndarray, queries: np.ndarray, own: np.ndarray, lists: int, top: float, k: int, covered: float = COVERED, seed: int = 7, rounds: int = 12):
        """names, own: what the sample's rows and the queries are known by."""
        rng = np.random.default_rng(seed)
        self.top = top
        self.rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1] + 1,) * 2))
        x = self.turned(np.unique(sample, axis=0))  # copies of a vector count once
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds if len(centres) > 1 else 0):
            near = nearest(x, centres)
            count = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        self.centres = centres
        self.probed = self._measured(sample, names, queries, own, k, covered)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0)))) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q, np.zeros(len(q)))) @ self.rotation

    def order(self, q: np.ndarray) -> np.ndarray:
        """Each turned query's lists, nearest first."""
        return np.argsort((self.centres * self.centres).sum(axis=1) - 2 * q @ self.centres.T, axis=1, kind="stable")

    def _measured(self, sample: np.ndarray, names: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, covered: float) -> int:
        """Lists that hold the wanted share of the queries' true neighbours in the sample; it is thinner than the table, so these are no nearer."""
        of, k, found = nearest(self.turned(sample), self.centres), min(k, len(sample) - 1), []
        if k < 1 or not len(queries):
            return len(self.centres)
        queries, one = np.unique(queries, axis=0, return_index=True)
        for q, mine in zip(*[np.split(a, range(AT_ONCE, len(a), AT_ONCE)) for a in (queries, own[one])], strict=True):
            scores = q @ sample.T
            scores[names == mine[:, None]] = -np.inf
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            place = np.argsort(self.order(self.asked(q)), axis=1)  # each list's rank
            found.append(np.take_along_axis(place, of[best], axis=1).ravel())
        ranks = np.sort(np.concatenate(found))
        return min(len(self.centres), max(LEAST_PROBED, 1 + int(ranks[min(len(ranks) - 1, int(np.ceil(covered * len(ranks))))])))


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    norm = (centres * centres).sum(axis=1)
    return np.concatenate([(norm - 2 * x[i : i + block] @ centres.T).argmin(axis=1) for i in range(0, len(x), block)]) if len(x) else np.empty(0, np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _loaded(path: str) -> Index:
    return pickle.loads(read_file(path))


def _assigned(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = _loaded(path)
    for batch in batches:
        if batch.num_rows:
            own = nearest(index.turned(_matrix(batch.column("v"))), index.centres)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[batch.column(c) for c in ("id", "v", "row")]], ["list", "id", "v", "row"])


def _probes(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = _loaded(path)
    for batch in batches:
        for part in (batch.slice(i, QUERY_BLOCK) for i in range(0, batch.num_rows, QUERY_BLOCK)):
            lists = index.order(index.asked(_matrix(part.column("v"))))[:, : index.probed]
            at = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
            rank = np.tile(np.arange(lists.shape[1]), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), pa.array(rank, pa.int32()), *[part.column(c).take(at) for c in ("id", "v", "row")]], ["list", "rank", "id", "v", "row"])


def _groups(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """list, cut and the columns (id, v and more) of each group, whose rows stand together."""
    now, held = None, []
    for batch in batches:
        if batch.num_rows:
            name, cut, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "cut", "id", *more))
            rest.insert(1, _matrix(batch.column("v")))
            edges = [0, *(np.flatnonzero(np.diff(name) | np.diff(cut)) + 1).tolist(), len(name)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and (name[lo], cut[lo]) != now:
                    yield *now, [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                now = int(name[lo]), int(cut[lo])
                held.append([c[lo:hi] for c in rest])
    if held:
        yield *now, [np.concatenate(c) for c in zip(*held, strict=True)]


def _list_files(folder: str, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = _loaded(path)
    for name, cut, (ids, x) in _groups(batches):
        turned = index.turned(x).T
        out = f"{folder}/{name:06d}-{cut:06d}.bin"
        write_file(out, pickle.dumps((ids, x, [np.ascontiguousarray(turned[d : d + COLUMNS]) for d in range(0, len(turned), COLUMNS)]), 5))
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([out])], ["list", "data"])


def _query_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, cut, (ids, vectors, kth) in _groups(batches, "kth"):
        path = f"{folder}/{name:06d}-{cut:06d}.bin"
        write_file(path, pickle.dumps((ids, vectors, np.where(np.isnan(kth), -np.inf, kth)), 5))
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([path])], ["list", "queries"])


def scan(owns: np.ndarray, q: np.ndarray, turned: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray, blocks: list[np.ndarray], top: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a query and a row of one list that may be among the query's k best, and their exact scores."""
    kth = kth.copy()
    for i in np.flatnonzero(kth == -np.inf):  # no bound yet: the k-th of a first part
        head = exact(x[(ids != owns[i]).nonzero()[0][: 8 * k]], q[i])
        if len(head) >= k:
            kth[i] = np.partition(head, len(head) - k)[len(head) - k]
    limit = np.where(kth > -np.inf, (q * q).sum(axis=1) + top - 2 * kth, np.inf)  # squared distance of the k-th
    total, d, pairs = turned.shape[1], 0, None
    for block in blocks:
        n = len(block)
        mine = turned[:, d : d + n]
        d += n
        if pairs is None:  # all pairs of the first block by one product
            part = (mine * mine).sum(axis=1)[:, None] + (block * block).sum(axis=0) - 2 * (mine @ block)
            alive = ids != owns[:, None]
        else:
            part = sums + np.einsum("ij,ij->j", *[block[:, pairs[1]] - mine[pairs[0]].T] * 2)
        bound = limit if d == total else limit * (d / total) * (1 + EPSILON / np.sqrt(d)) ** 2
        slack = 1e-9 * (1 + top)  # for rounding
        if pairs is None:
            pairs = np.nonzero(alive & (part <= bound[:, None] + slack))
            sums = part[pairs]
        else:
            stay = part <= bound[pairs[0]] + slack
            pairs, sums = (pairs[0][stay], pairs[1][stay]), part[stay]
    out: list[tuple[np.ndarray, ...]] = []
    edge = np.searchsorted(pairs[0], np.arange(len(owns) + 1))
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        at = pairs[1][a:b]
        scores = exact(x[at], q[i])
        stay = scores >= kth[i]
        at, scores = at[stay], scores[stay]
        best = np.lexsort((ids[at], -scores))[:k]
        out.append((np.full(len(best), i), at[best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components."""
    return np.add.accumulate(x * q, axis=1)[:, -1] if len(x) else np.zeros(0)


def _scanned(path: str, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = _loaded(path)
    for batch in batches:
        for row in batch.to_pylist():
            owns, queries, kth = pickle.loads(read_file(row["queries"]))
            ids, x, blocks = pickle.loads(read_file(row["data"]))
            for i in range(0, len(owns), AT_ONCE):
                own, q = owns[i : i + AT_ONCE], queries[i : i + AT_ONCE]
                at, found, scores = scan(own, q, index.asked(q), kth[i : i + AT_ONCE], ids, x, blocks, index.top, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids[found]), pa.array(scores)], ["query_id", "vec_id", "score"])


def _search(rows: DataFrame, asked: DataFrame, size: int, count: int, top: float, k: int, sample: int, covered: float) -> DataFrame:
    """query_id, vec_id and score of finds among vectors of one length, a query's k best included."""
    spark, n = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    most = max(1, min(SAMPLE_BYTES // (8 * size), max(sample, round(FITTED * count**0.5))))

    def few(df: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and ids of the rows with the least hashes."""
        t = df.orderBy(F.xxhash64("row")).select("id", "v").limit(limit).toArrow()
        return t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size), t.column("id").to_numpy()

    some, names = few(rows, most)
    lists = max(1, min(round(count**0.5), len(some) // FITTED))
    path = f"{scratch_dir(spark, 'index')}/index.bin"
    write_file(path, pickle.dumps(Index(some, names, *few(asked, TRIED), lists, top, k, covered), 5))

    def cut(df: DataFrame, most: int) -> DataFrame:
        """Number the parts into which a list's rows are cut: one row a list, which a bounded sample has fitted."""
        parts = df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
        return df.join(F.broadcast(parts), "list").withColumn("cut", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def filed(df: DataFrame, write, schema: str, name: str) -> DataFrame:
        return staged(df.repartition(n, "list", "cut").sortWithinPartitions("list", "cut").mapInArrow(write, schema), name)

    assigned = staged(rows.select("id", "v", "row").mapInArrow(partial(_assigned, path), "list int, id long, v array<double>, row long"), "assigned")
    data = filed(cut(assigned, CHUNK), partial(_list_files, scratch_dir(spark, "lists"), path), "list int, data string", "lists")
    asked = staged(asked.mapInArrow(partial(_probes, path), "list int, rank int, id long, v array<double>, row long"), "probes")

    def scanned(queries: DataFrame) -> DataFrame:
        packs = filed(cut(queries, QUERY_BLOCK), partial(_query_files, scratch_dir(spark, "queries")), "list int, queries string", "queries")
        return packs.join(data, "list").select("queries", "data").repartition(n).mapInArrow(partial(_scanned, path, k), _FOUND)

    first = staged(scanned(asked.where("rank = 0").withColumn("kth", F.lit(None).cast("double"))), "found")
    # The k-th score, where the first list holds k candidates.
    kth = staged(best_of(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "kth")
    return first.unionByName(scanned(asked.where("rank > 0").join(kth, "id", "left")))


def search(embeddings: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, covered: float = COVERED) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose vec_id is divisible by ``every``."""
    rows = aliased(embeddings, id=F.col("vec_id").cast("long"), v=F.col("embedding").cast("array<double>"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = staged(numbered(rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("norm", norm).where("norm > 0")), "vectors")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "row")).alias("s")).select("id", "s.v", "s.row")
    asked = staged(asked, "asked")
    # One row a vector length.
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
    sizes = sizes.join(asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1))), "d").orderBy("d").collect()
    of = lambda df, d: df.where(F.size("v") == d)
    found = [_search(of(rows, s.d), of(asked, s.d), s.d, s.n, s.top, k, sample, covered) for s in sizes]
    if not found:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best_of(reduce(DataFrame.unionByName, found), k)
