"""What the text operators share: tables, batches, checkpoints and hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches between the JVM and Python end at either bound, so that a run of long texts stays small in memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20

#: The bytes that `[^\x20\x09-\x0D]+` leaves out of words; bytes.split() splits at exactly these.
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch of df; a narrow step with no shuffle. fn sees df's column names, whatever they are."""
    bounded_batches(df.sparkSession)
    names = df.columns
    if any("." in c or "`" in c for c in names):  # which can't be named to Spark one by one
        df, fn = df.toDF(*(f"c{k}" for k in range(len(names)))), lambda batch, own=fn: own(batch.rename_columns(names))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(each, schema)


#: A word with more characters than this is forgotten with the batch that it came in.
LONGEST = 256


class Memory:
    """What a worker has worked out by word, in two generations: of the older one only what is asked for again stays. Long
    words don't stay at all, so that a number of words is a bound on bytes."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.long = most, {}, {}, []

    def fill(self, words: Iterable[str], work_out: Callable[[list[str]], Iterable]) -> dict:
        """A dict with all the words, each of which comes once."""
        for x in self.long:
            self.young.pop(x, None)
        self.long = []
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for x in words:
            if x not in young:
                if x in old:
                    young[x] = old[x]
                else:
                    new.append(x)
        young.update(zip(new, work_out(new), strict=True))
        self.long = [x for x in new if len(x) > LONGEST]
        return young


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session writes to this machine's
    folder for temporary files; a cluster is refused, as its executors would each write to a disk of their own."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|\Z)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Stored(NamedTuple):
    """A table that was written in the shared folder: its rows as a frame, and where it lies."""

    rows: DataFrame
    path: str

    def forget(self) -> None:
        """Removes the table; nothing may read it any more."""
        spark = self.rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> Stored:
    """df written as a table in the shared folder, so that lost executors cost no earlier work; it can be removed by itself."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text of df, and nothing that could clash with what an operator adds."""
    return df.select("doc_id", *extra, F.col("text"))
