"""Where results go: Parquet, TSV, JSON, lists, Markdown, and fingerprints of what was written."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where drivers and executors both write: the folder of spark.checkpoint.dir. Where that is unset, a local session writes
    to this machine's folder for temporary files, and a cluster is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "checkpoints")


def there(spark: SparkSession, place: str) -> bool:
    """Whether anything lies at a place, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Kept(NamedTuple):
    """A table in the shared folder: its rows, read from there, and its place."""

    rows: DataFrame
    path: str

    def remove(self) -> None:
        """Nothing may read the rows any more."""
        spark = self.rows.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame) -> Kept:
    """df worked out and written in the shared folder, so that what is made of it has no plan of its own behind it."""
    path = f"{shared_folder(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Kept(df.sparkSession.read.schema(df.schema).parquet(path), path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated with a header; one part only for tables of a report's size."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes))
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_list(df: DataFrame, column: str, path: str, distinct: bool = False) -> None:
    rows = df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull())
    (rows.distinct() if distinct else rows).write.mode("overwrite").text(path)


def write_json(value: Any, path: str | Path) -> None:
    """Written beside, then renamed: a reader never sees half a file."""
    beside = Path(f"{path}.part")
    beside.parent.mkdir(parents=True, exist_ok=True)
    beside.write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str))
    os.replace(beside, path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, columns and the sum of a hash of each row, which doesn't depend on their order. A row is written with the length
    of each value and a mark for each null, so that no two rows are written alike; rows that come twice count twice."""
    texts = [F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    row = F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])
    own = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("content"))


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def pct(k: float, n: float, digits: int = 1) -> str:
    return f"{100 * k / n:.{digits}f}%" if n else "–"


def fmt(v: Any, digits: int = 3) -> str:
    """A value as a report shows it."""
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, int):
        return f"{v:,}"
    if isinstance(v, float):
        return f"{int(v):,}" if v.is_integer() and abs(v) < 1e15 else f"{v:.1e}" if 0 < abs(v) < 10**-digits else f"{v:,.{digits}f}"
    return str(v).replace("|", "\\|")


def markdown(rows: Iterable[Any], columns: list[str]) -> str:
    """A Markdown table of rows (dicts or Spark rows)."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(fmt(r[c]) for c in columns) + " |" for r in rows])


def commit_of(folder: str | Path) -> str | None:
    """The commit of the folder, marked if files differ from it; None outside a repository."""
    run = lambda *a: subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return run("rev-parse", "HEAD") + (" (dirty)" if run("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return None


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
