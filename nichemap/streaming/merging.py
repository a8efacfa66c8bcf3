"""A table of records that grows by batches: of each id the latest version, whatever order versions come in.

Rows lie in buckets of their id's hash. A merge rewrites only the buckets that it has ids of: new rows and those there meet
in one aggregation, which keeps the latest version of each id and doesn't need a state of all ids ever seen. Merging the same
batch again changes nothing, so that a merge which was broken off is simply repeated, and a stream can hand over each of its
batches more than once.

A version is a column that compares, such as the time of fetching; a null version is older than any other, and of rows of one
version the one with the greater hash stays, wherever it comes from. Rows without an id are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import kept, there

#: Buckets of a table; the same for all merges into it. A bucket should be a task's worth of rows.
BUCKETS = 64


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each key, with all columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_bucket"])  # the same hash in every merge
    order = F.struct(F.col(version).isNotNull(), F.col(version), F.xxhash64(F.to_json(own)))
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def merge(new: DataFrame, place: str, key: str = "bacdive_id", version: str = "fetched_at", buckets: int = BUCKETS) -> list[int]:
    """Puts the rows of `new` into the table at this place, which needn't exist yet; the buckets that were rewritten."""
    spark = new.sparkSession
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row without {key}"))).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    own = kept(latest(new, key, version).withColumn("_bucket", checked))
    touched = sorted(r[0] for r in own.rows.select("_bucket").distinct().collect())  # at most all buckets
    rows = own.rows
    if touched:
        if there(spark, place):
            old = spark.read.schema(own.rows.schema).parquet(place).filter(F.col("_bucket").isin(touched))
            rows = latest(old.unionByName(rows), key, version)
        both = kept(rows)  # on disk before what it is made of is replaced
        both.rows.repartition(min(buckets, len(touched)), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(place)
        both.remove()
    own.remove()
    return touched


def read(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(place).drop("_bucket")


def follow(stream: DataFrame, place: str, checkpoint: str, key: str = "bacdive_id", version: str = "fetched_at", buckets: int = BUCKETS) -> None:
    """Merges what the stream holds now; called again with the same checkpoint, what has come since. The stream has no state."""
    run = stream.writeStream.foreachBatch(lambda batch, _: merge(batch, place, key, version, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
