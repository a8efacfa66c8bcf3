"""Tables from files: catalogues as TSV, results as Parquet, settings and metadata as JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.linkage import REQUIRED

NUMBERS = ("checkm2_completeness", "checkm2_contamination", "genome_size", "ncbi_taxid", "ncbi_species_taxid")


def catalogue(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The columns of a genome catalogue that are needed. A gzip file can't be split: it is read by one task and dealt out
    afterwards."""
    raw = spark.read.csv(path, sep="\t", header=True)
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise KeyError(f"the catalogue lacks columns {missing}")
    own = raw.select(*REQUIRED)
    return own.repartition(partitions or spark.sparkContext.defaultParallelism) if path.endswith(".gz") else own


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metadata(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())
