"""Records through Structured Streaming: new files are read once, each id once, with the batch expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import shared_folder


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event_id and the k of its props; an id that comes again is dropped."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    return stream.select("event_id", F.get_json_object("props", "$.k").alias("k")).dropDuplicates(["event_id"])


def trait_rows(spark: SparkSession, folder: str, cfg) -> DataFrame:
    """Cached batches as a stream of typed rows."""
    from ..operators import records

    text = spark.readStream.option("wholetext", True).option("pathGlobFilter", "fetch_*_n*.json.gz").text(folder)
    rows = text.select(F.from_json("value", "fetched_at string, results map<string,string>").alias("b")).select(F.col("b.fetched_at").alias("fetched_at"), F.explode("b.results").alias("id", "record"))
    return records.trait_table(rows.select(F.col("id").cast("long").alias("bacdive_id"), "record", "fetched_at").dropDuplicates(["bacdive_id"]), cfg)


def drain(stream: DataFrame) -> DataFrame:
    """All that the stream holds now, written as Parquet to the shared folder and read from there. The stream's own state goes
    when it has ended; the rows stay for who reads them."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/state")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
