"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source, the mixture's size (a share of all words) is dealt to the sources by weight, no
source takes more than ``cap`` times its words, and what a capped source can't take goes to the others by
weight. A source's rate is target over size; a document is emitted floor(rate) times, and once more if a
number in [0, 1) lies below the rate's fraction, hashed from the seed, a digest of the document's doc_id, source and
text, and its number among the documents that have all three in common. So rows without a doc_id, or with a repeated
one, draw apart, and reruns agree.

Sizes are worked out for each different (doc_id, source, text) once, with its number of rows, so that copies of one row
don't meet in a task as rows. Of whole documents only those that have such a copy are numbered, in salted parts.

Defined results: null text is empty and counts 0 words; null source is a source of its own, last in order; a null
doc_id is a value like any other; an empty table gives no row; sources without words get target 0. The only global
order is over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, aliased, fresh, shuffle_partitions, staged

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
ROWS, SALTS = 1 << 16, 64  # rows of an identity that come out together; parts in which they are numbered
_HEX_DIGITS = 13  # 52 bits: exact in a double


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(doc_id: Column, source: Column, text: Column) -> Column:
    """A digest of what a document is: rows of one identity are copies of each other."""
    parts = F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(source), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))
    return F.md5(F.concat_ws(":", *parts))


def draw(key: Column, nth: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) for the n-th copy of an identity, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, nth.cast("string"))), 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**_HEX_DIGITS))


def _copies(rate: Column, key: Column, nth: Column, seed: str) -> Column:
    return (F.floor(rate) + (draw(key, nth, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target and rate of each source of a table with source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth % len(weights) + 1).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("full_at", F.col("most") / F.col("weight"))
    # Sources fill up in the order of full_at; the level is the first at which the rest, dealt by weight, overfills no one.
    before = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"])
    target = F.least("most", F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _by_source(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Join on a source that may be null; the tables' own sizes decide whether Spark broadcasts, else it splits hot sources."""
    key = fresh(docs, "_source")
    t = targets.withColumnRenamed("source", key)
    return docs.join(t, docs["source"].eqNullSafe(t[key])).drop(key)


def mix_sizes(documents: DataFrame, seed: str = SEED, **mix) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of each document."""
    key = identity(F.col("doc_id"), F.col("source"), F.col("text"))
    rows = aliased(documents, doc_id="doc_id", source="source", size=words(F.col("text")), key=key)
    rows = staged(rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    targets = source_targets(rows.select("source", (F.col("size") * F.col("rows")).alias("size")), **mix)
    joined = _by_source(rows, targets)
    # The rows of an identity come out block by block, wherever its number of rows was counted.
    parts = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / ROWS)))).repartition(shuffle_partitions(documents.sparkSession))
    nth = parts.withColumn("nth", F.explode(F.sequence(F.col("part") * ROWS, F.least(F.col("rows"), (F.col("part") + 1) * ROWS) - 1)))
    copies = _copies(F.col("rate"), F.col("key"), F.col("nth"), seed)
    return nth.select("doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _numbered(rows: DataFrame, key: str, row: str, nth: str) -> DataFrame:
    """Staged rows with their number (from 0) among those of one key, in ``SALTS`` parts of each key."""
    salt, before = fresh(rows, "_salt"), fresh(rows, "_before")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(SALTS)))
    sizes = salted.groupBy(key, salt).agg(F.count(F.lit(1)).alias(before))
    offsets = sizes.withColumn(before, F.coalesce(F.sum(before).over(W.partitionBy(key).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = salted.withColumn(nth, F.row_number().over(W.partitionBy(key, salt).orderBy(row)) - 1)
    return placed.join(offsets, [key, salt]).withColumn(nth, F.col(nth) + F.col(before)).drop(salt, before)


def mix_documents(documents: DataFrame, seed: str = SEED, **mix) -> DataFrame:
    """The mixture itself: each document's row, with all its columns, as often as it is taken."""
    key, nth, rate, copy, row = (fresh(documents, c) for c in ("_key", "_nth", "_rate", "_copy", "_row"))
    columns = documents.columns
    sizes = staged(aliased(documents, source="source", size=words(F.col("text"))).groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    targets = source_targets(sizes, **mix).select("source", F.col("rate").alias(rate))
    docs = documents.withColumn(key, identity(documents["doc_id"], documents["source"], documents["text"]))
    repeated = staged(docs.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(key), "mix-repeats")
    if repeated.isEmpty():
        rows = docs.withColumn(nth, F.lit(0).cast("long"))
    else:
        copies_of = staged(docs.join(repeated, key, "left_semi").withColumn(row, F.monotonically_increasing_id()), "mix-copies")
        rows = docs.join(repeated, key, "left_anti").withColumn(nth, F.lit(0).cast("long")).unionByName(_numbered(copies_of, key, row, nth).drop(row))
    joined = _by_source(rows, targets)
    copies = _copies(F.col(rate), F.col(key), F.col(nth), seed).cast("int")
    out = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(F.col(copy) <= copies)
    return out.select(*[out[c] for c in columns])


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(source), 'null') || ':' || md5(coalesce(text, ''))) AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(list_extract([{", ".join(map(str, WEIGHTS))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS DOUBLE) AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * CAST({CAP} AS DOUBLE) AS most, source_size * CAST({CAP} AS DOUBLE) / weight AS full_at FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST({SHARE} AS DOUBLE) - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('{SEED}:' || key || ':' || (row_number() OVER (PARTITION BY key) - 1)), 1, {_HEX_DIGITS}) AS BIGINT) / CAST({16**_HEX_DIGITS} AS DOUBLE) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies,
  CAST((CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
