"""Exports: files that Spark writes to the shared folder, listed and read again, and their time stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..session import scratch_dir
from ..sources import files


@query("DAT_1_stamps", "SELECT event_id AS id, strftime(date_trunc('second', ts), '%Y%m%d_%H%M%S') AS stamp, epoch(date_trunc('second', ts)) = floor(epoch(ts)) AS whole FROM events")
def stamps(spark, d):
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), files.stamp(at).alias("stamp"), (files.seconds(at).cast("double") == F.floor(at.cast("double"))).alias("whole"))


@query("SNK_5_report", "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id")
def report(spark, d):
    """A report by user, written over an older one, and what readers find in its place."""
    e = table(spark, d, "events")
    rows = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    path = f"{scratch_dir(spark, 'reports')}/users"
    files.write_report(rows.where("errors > 0"), path)
    files.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SRC_13_exports", "SELECT source AS folder, CAST(count(*) > 0 AS BIGINT) AS files, true AS listed FROM documents WHERE lang = 'en' GROUP BY source")
def exports(spark, d):
    """The texts of each source, written as JSON to a folder of its own: its file is listed, and nothing else is."""
    folder = scratch_dir(spark, "exports")
    docs = table(spark, d, "documents").where("lang = 'en'").select(F.col("source").alias("folder"), "doc_id", "text")
    docs.repartition("folder").write.partitionBy("folder").json(folder)
    docs.limit(0).write.parquet(f"{folder}/other")
    found = files.exports(spark, folder, (".json",))
    name = F.regexp_extract("path", "/folder=([^/]*)/[^/]*$", 1)
    return found.groupBy(name.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("length") > 0).alias("listed"))
