"""Batches of records on disk: which are there, which are missing, and their records.

A batch is a gzip JSON file `fetch_<start>_n<count>.json.gz` that holds {requested_start, requested_end, fetched_at, api,
results: id -> record}.
"""

from __future__ import annotations

import gzip
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAME = r"fetch_([0-9]{7})_n([0-9]+)\.json\.gz$"
#: Names of all batches, and of those that hold records.
ALL, FILLED = "fetch_*_n*.json.gz", "fetch_*_n[1-9]*.json.gz"
#: Batches whose islands are found in one task.
STRETCH = 1_000_000


def all_starts(spark: SparkSession, first: int, most: int, size: int) -> DataFrame:
    return spark.range(first, most + 1, size).select(F.col("id").alias("start"))


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """start, n and path of each batch in the folder, from the names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ALL).load(folder).select("path").coalesce(spark.sparkContext.defaultParallelism)
    get = lambda k: F.regexp_extract("path", NAME, k).cast("long")
    return files.filter(F.col("path").rlike(NAME)).select(get(1).alias("start"), get(2).alias("n"), "path")


def missing(starts: DataFrame, have: DataFrame, limit: int | None = None) -> DataFrame:
    """Starts that have no batch yet, in order."""
    todo = starts.join(have, "start", "left_anti").orderBy("start")
    return todo.limit(limit) if limit is not None else todo


def _islands(rows: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Rows (first_id, last_id, batches) that follow each other without a gap, as one; last_id is the end of the range."""
    before = F.lag("last_id").over(W.partitionBy(*by).orderBy("first_id"))
    island = F.sum((F.col("first_id") != F.coalesce(before + 1, F.lit(-1))).cast("int")).over(W.partitionBy(*by).orderBy("first_id"))
    merged = rows.withColumn("_island", island).groupBy(*by, "_island")
    return merged.agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("batches").alias("batches")).drop("_island")


def empty_ranges(found: DataFrame, size: int, least: int = 10) -> DataFrame:
    """first_id, last_id and batches of runs of at least `least` consecutive batches without records. found: start and n.
    Runs are found within stretches of ids first; only those that reach a stretch's edge are then joined."""
    wide = size * STRETCH
    empty = found.filter("n = 0").select(F.col("start").alias("first_id"), (F.col("start") + size - 1).alias("last_id"), F.lit(1).cast("long").alias("batches"), F.floor(F.col("start") / wide).alias("_stretch"))
    runs = _islands(empty, size, ["_stretch"])
    edge = (F.col("first_id") - F.col("_stretch") * wide < size) | ((F.col("_stretch") + 1) * wide - F.col("last_id") <= size)
    joined = _islands(runs.filter(edge).drop("_stretch"), size, [])  # two a stretch at most
    return runs.filter(~edge).drop("_stretch").unionByName(joined).filter(F.col("batches") >= least)


def sweep_summary(starts: DataFrame, have: DataFrame, warn_within: int, max_id: int, max_found: int | None = None) -> DataFrame:
    """One row: batches expected, cached and missing, records, and whether records come close to the end of the range."""
    own = starts.join(have.select("start", "n"), "start", "left")
    top = F.lit(max_found).cast("long") if max_found is not None else F.max(F.when(F.col("n") > 0, F.col("start")))
    return own.agg(F.count("*").alias("expected"), F.count("n").alias("cached"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), top.alias("max_id_found")).withColumns({"complete": F.col("missing") == 0, "near_the_end": F.coalesce(F.col("max_id_found") > max_id - warn_within, F.lit(False))})


def last_id(spark: SparkSession, have: DataFrame) -> int | None:
    """The largest id of the last batch that holds records; that one file is read."""
    last = have.filter("n > 0").orderBy(F.col("start").desc()).limit(1).collect()
    return records(spark, last[0]["path"]).agg(F.max("bacdive_id")).first()[0] if last else None


def records(spark: SparkSession, folder: str) -> DataFrame:
    """bacdive_id, record (JSON text) and fetched_at of each record. Files that are named as empty are not read."""
    text = spark.read.option("pathGlobFilter", FILLED).text(folder, wholetext=True)
    parsed = text.select(F.from_json("value", "fetched_at string, results map<string,string>").alias("b"))
    return parsed.select(F.col("b.fetched_at").alias("fetched_at"), F.explode("b.results").alias("bacdive_id", "record")).select(F.col("bacdive_id").cast("long").alias("bacdive_id"), "record", "fetched_at")


def write(spark: SparkSession, folder: str, start: int, size: int, api: str, fetched_at: str, results: dict[str, object]) -> str:
    """One batch as a file of the folder, in whatever store it lies; written beside, then renamed. Its path."""
    held = {"requested_start": start, "requested_end": start + size - 1, "fetched_at": fetched_at, "api": api, "results": results}
    data = gzip.compress(json.dumps(held, separators=(",", ":"), ensure_ascii=False).encode())
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/fetch_{start:07d}_n{len(results)}.json.gz")
    beside = hadoop.Path(f"{folder}/_{start:07d}.part")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    store.delete(path, False)
    if not store.rename(beside, path):
        raise OSError(f"cannot rename {beside.toString()}")
    return path.toString()
