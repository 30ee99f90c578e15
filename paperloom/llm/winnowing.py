"""Winnowing fingerprints of documents, with DataFrame functions only.

A text's units are single characters of scripts that don't part words by blanks, and elsewhere runs of up to ``RUN``
characters between blanks. Each unit is hashed once, and each run of ``GRAM`` units gets a hash of its units' hashes.
Of each ``WINDOW`` consecutive grams the least hash is kept, of equal ones the rightmost, with its position. Any two
texts that share GRAM + WINDOW - 1 consecutive units keep a gram in common, whose positions tell where; grams of
fewer than GRAM units never match. Minima are taken by doubling: two neighbours, then pairs of pairs. A long text is
winnowed in blocks of positions.

For the comparison of each document with the next one, documents are cut into buckets in descending order of doc_id.
The buckets' bounds are keys of the table, found in a table of keys alone (a range exchange of 33 bytes a row), so the
texts are exchanged once, and a bucket's first document is sent to the bucket before it as well. Bounds are at most
``MOST_BUCKETS`` short strings, whatever the table's size.

Defined results: null text is empty; a text without units has the empty fingerprint; a text of fewer than GRAM units
has one gram, of all of them; two empty fingerprints are alike (1), an empty and another one aren't (0); texts that
differ in blanks only have equal fingerprints. Rows of one doc_id stand by the hash of their text, null doc_ids last;
each row that repeats doc_id and text follows its copy, and copies that hold more than a ``HOT`` share of the table are
worked out once. The only document of a table is its own next one; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import aliased, staged

GRAM, WINDOW, RUN, BLOCK = 5, 4, 16, 2048
BUCKET_BYTES, MOST_BUCKETS, HOT = 4 << 20, 1 << 16, 0.001
#: Han, kana, Hangul and Thai stand alone; everything else but blanks goes together.
UNIT = r"[\x{0E00}-\x{0EFF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]|[^\x20\x09-\x0D\x{0E00}-\x{0EFF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]{1,%d}" % RUN
_LOW = 4095  # the lowest bits of a packed gram hold its place in the block, the later the smaller


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _lower(grams: Column, step: int) -> Column:
    """The lesser of each element and the one ``step`` further; of a list that ends before, its least."""

    def pairs(g: Column) -> Column:
        both = F.size(g) - step
        return F.when(both > 0, F.zip_with(F.slice(g, F.lit(1), both), F.slice(g, F.lit(step + 1), both), lambda a, b: F.least(a, b))).otherwise(F.array(F.array_min(g)))

    return let(grams, pairs)


def _minima(grams: Column, window: int) -> Column:
    """The least of each ``window`` elements in a row (of all, if there are fewer)."""
    wide = 1
    while wide < window:
        grams = _lower(grams, min(wide, window - wide))
        wide += min(wide, window - wide)
    return grams


def _block(units: Column, b: Column, count: Column, gram: int, window: int) -> Column:
    """What is kept of the grams of block b, with their positions: all windows that hold one of them are looked at."""
    first = F.greatest(b * BLOCK - (window - 1), F.lit(0))
    grams = F.least((b + 1) * BLOCK + (window - 1), count) - first
    each = F.arrays_zip(*[F.slice(units, first + i + 1, grams).alias(f"u{i}") for i in range(gram)])
    packed = F.transform(each, lambda g, i: F.xxhash64(g).bitwiseAND(F.lit(~_LOW)).bitwiseOR((F.lit(_LOW) - i).cast("long")))
    kept = F.transform(F.array_distinct(_minima(packed, window)), lambda x: F.struct((first + F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int").alias("position"), F.shiftrightunsigned(x, 12).alias("hash")))
    return F.filter(kept, lambda g: (g["position"] >= b * BLOCK) & (g["position"] < (b + 1) * BLOCK))


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The kept grams of a text in order: array<struct<position int, hash long>>; hashes have 52 bits."""

    def kept(units: Column) -> Column:
        count = F.size(units) - (gram - 1)
        blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
        short = F.array(F.struct(F.lit(0).alias("position"), F.shiftrightunsigned(F.xxhash64(units), 12).alias("hash")))
        none = F.array().cast("array<struct<position:int,hash:bigint>>")
        whole = F.flatten(F.transform(blocks, lambda b: _block(units, b, count, gram, window)))
        return F.when(count > 0, whole).when(F.size(units) > 0, short).otherwise(none)

    return let(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)), kept)


def written(grams: Column) -> Column:
    """A fingerprint as text: for each kept gram its hash (13 hex digits) and its distance from the one before, from 1 on."""
    steps = F.zip_with(grams["position"], F.concat(F.array(F.lit(-1)), grams["position"]), lambda p, before: p - before)
    both = F.arrays_zip(grams["hash"].alias("hash"), F.slice(steps, F.lit(1), F.size(grams)).alias("step"))
    return F.array_join(F.transform(both, lambda g: F.concat(F.lower(F.lpad(F.hex(g["hash"]), 13, "0")), F.lower(F.hex(g["step"])))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of two fingerprints' hashes that both have."""
    both = F.size(F.array_intersect(a["hash"], b["hash"]))
    every = F.size(F.array_union(a["hash"], b["hash"]))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def fingerprints(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, position and hash of each kept gram, a row each."""
    kept = F.explode(winnowed(F.coalesce("text", F.lit("")), gram, window))
    return aliased(documents, doc_id="doc_id", kept=kept).select("doc_id", "kept.position", "kept.hash")


def _key(doc_id: Column, text: Column) -> Column:
    """A string by which documents stand in descending order of doc_id, null last, then by the hash of the text."""
    upward = F.lpad(F.hex(F.bitwise_not(doc_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), upward), F.lpad(F.lit("1"), 17, "1")), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def _bounds(keys: DataFrame) -> list[str]:
    """The first key of each bucket, in order, for buckets of about ``BUCKET_BYTES``."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))
    firsts = keys.select("key").repartitionByRange(buckets, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    return sorted(r.key for r in firsts.collect())  # at most a row a bucket


def _placed(rows: DataFrame, bounds: list[str]) -> DataFrame:
    """The rows with their bucket, and each bucket's first row also as the mark behind the bucket before (the last, for the first one)."""
    width = max(1, round(len(bounds) ** 0.5))
    listed = lambda keys: F.split(F.lit(",".join(keys)), ",")  # noqa: E731  folded to a constant
    flat, heads = listed(bounds), listed(bounds[::width])
    rows = rows.withColumn("part", F.size(F.filter(heads, lambda b: b <= F.col("key"))) - 1)
    rows = rows.withColumn("own", F.slice(flat, F.col("part") * width + 1, F.lit(width)))
    rows = rows.withColumn("bucket", F.col("part") * width + F.size(F.filter("own", lambda b: b <= F.col("key"))) - 1)
    here = F.struct("bucket", F.lit(0).alias("mark"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(1).alias("mark"))
    places = F.when(F.array_contains("own", F.col("key")), F.array(here, before)).otherwise(F.array(here))
    return rows.select("doc_id", "text", "key", "copies", F.explode(places).alias("place")).select("doc_id", "text", "key", "copies", "place.bucket", "place.mark")


def with_next(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text, print, next_text and next_print of each document; a print is what ``winnowed`` gives."""
    docs = aliased(documents, doc_id=F.col("doc_id").cast("long"), text=F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", _key(F.col("doc_id"), F.col("text")).alias("key"), F.lit(1).cast("long").alias("copies"))
    keys = staged(rows.select("key", F.octet_length("text").cast("long").alias("bytes")), "keys")
    bounds = _bounds(keys)
    if not bounds:
        bounds = [""]
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(max(1000, HOT * keys.count())))
    hot = [r.key for r in many.collect()]  # at most 1 / HOT keys
    if hot:
        once = rows.where(F.col("key").isin(hot)).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        rows = rows.where(~F.col("key").isin(hot)).unionByName(once)
    dealt = _placed(rows, bounds).repartition("bucket").withColumn("print", winnowed(F.col("text"), gram, window))
    order = W.partitionBy("bucket").orderBy("mark", "key")
    pairs = dealt.withColumns({"next_text": F.lead("text").over(order), "next_print": F.lead("print").over(order)}).where("mark = 0")
    out = pairs.select("doc_id", "text", "print", "next_text", "next_print")
    if hot:
        again = pairs.where("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies"))))
        out = out.unionByName(again.select("doc_id", "text", "print", F.col("text").alias("next_text"), F.col("print").alias("next_print")))
    return out


def compare_edits(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each document against itself with its last third replaced by the beginning of the next, and against the next."""
    rows = with_next(documents, gram, window)
    rows = rows.withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    edited = F.concat(F.left("text", F.col("n") - F.col("cut")), F.left("next_text", F.col("cut")))
    rows = rows.select("doc_id", "n", "print", "next_print", edited.alias("edited"))
    rows = rows.withColumn("edited_print", winnowed(F.col("edited"), gram, window))
    prints, other = F.col("print"), F.col("edited_print")
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written(prints).alias("fingerprint"), written(other).alias("edited_fingerprint"),
        likeness(prints, other).alias("near_edited"), likeness(prints, F.col("next_print")).alias("near_next"),
    )
