"""A dictionary of parsed designations that is kept between runs: a run parses only tokens that no run before it has met.

The dictionary is a table in versions, a folder a run that has learned something, under the digest of what a parse depends on:
another configuration has a dictionary of its own. A token is in one version only, as a run takes those that all versions
before it lack. A version is written whole or not at all; one writer at a time.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import there
from .designations import Normaliser

SCHEMA = "token string, raw string, canonical string, kind string, collection string"


class Book:
    """The dictionary of one configuration in a folder."""

    def __init__(self, folder: str, normaliser: Normaliser):
        self.normaliser = normaliser
        text = json.dumps([sorted((normaliser.aliases or {}).items()) if normaliser.aliases is not None else None, sorted(normaliser.collections) if normaliser.collections is not None else None])
        self.place = f"{folder.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"

    def rows(self, spark) -> DataFrame:
        """token, raw, canonical, kind, collection and the version in which it was learned."""
        if not there(spark, self.place):
            return spark.createDataFrame([], SCHEMA + ", version int")
        return spark.read.schema(SCHEMA + ", version int").parquet(self.place)

    def learn(self, tokens: DataFrame, column: str = "token") -> int:
        """Parses the tokens that the dictionary lacks and adds them as a version; how many they were."""
        spark = tokens.sparkSession
        known = self.rows(spark)
        last = known.agg(F.max("version")).first()[0] or 0
        new = tokens.select(F.col(column).alias("token")).filter("token is not null").distinct().join(known.select("token"), "token", "left_anti")
        place = f"{self.place}/version={last + 1}"
        self.normaliser.dictionary(new).write.mode("overwrite").parquet(place)
        learned = spark.read.parquet(place).count()
        if not learned:  # nothing new is no version
            at = spark._jvm.org.apache.hadoop.fs.Path(place)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return learned
