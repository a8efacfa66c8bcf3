"""What the other stages read, fetched: batches of records that are not there yet, and the catalogue's release."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession

from .. import sinks
from ..config import Config
from ..sources import batches, http

#: Batches that a round fetches for each worker, at first and at most; a round that took less than so many seconds, and held
#: less than so many characters, is followed by one twice as large, any other by one half as large.
ROUND, LARGEST, SECONDS, HELD = 4, 128, 10.0, 1 << 25
#: Missing batches that are listed at a time.
PAGE = 100_000
#: Files that are written at a time.
WRITERS = 8


def summary(spark: SparkSession, cfg: Config) -> dict:
    """What the cache holds of the range of ids, with the long runs of ids that have no records."""
    b, folder = cfg["bacdive"], str(cfg.path("raw") / "bacdive")
    starts, listed = batches.all_starts(spark, b["start_id"], b["max_id"], b["batch_size"]), sinks.kept(batches.cached(spark, folder))
    have = listed.rows
    out = batches.sweep_summary(starts, have, b["warn_if_max_found_within"], b["max_id"], batches.last_id(spark, have)).first().asDict()
    gaps = batches.empty_ranges(have, b["batch_size"]).orderBy("first_id").collect()  # runs of a thousand ids and more
    listed.remove()
    return out | {"range": [b["start_id"], b["max_id"]], "empty_ranges": [[r["first_id"], r["last_id"]] for r in gaps]}


def crawl(spark: SparkSession, cfg: Config, most: int | None = None, get: Callable[[str, float], object] = http.fetch) -> dict:
    """Fetches the batches that are missing, at most `most` of them, a round at a time: as many tasks as the service takes
    callers, each with a pause after a batch. A round's batches are files before the next begins, so that a crawl that
    breaks off goes on where it stopped; rounds grow only while they take seconds, so that little is fetched twice. The range
    is swept whole: runs without records don't end it."""
    b, folder = cfg["bacdive"], str(cfg.path("raw") / "bacdive")
    Path(folder).mkdir(parents=True, exist_ok=True)
    options = {"base_url": b["base_url"], "batch_size": b["batch_size"], "timeout": b["timeout_seconds"], "retries": b["max_retries"], "backoff": b["backoff_seconds"], "delay": b["delay_seconds"]}
    starts = batches.all_starts(spark, b["start_id"], b["max_id"], b["batch_size"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in frame["start"]:
                found, now = http.batch_of({k: str(v) for k, v in options.items()}, int(start), get)
                yield pd.DataFrame({"start": [start], "fetched_at": [now], "results": [json.dumps(found)]})

    done, few, todo = 0, b["workers"] * ROUND, []
    while most is None or done < most:
        if not todo:  # the folder is listed once a page, not once a round
            todo = [r["start"] for r in batches.missing(starts, batches.cached(spark, folder), PAGE if most is None else min(PAGE, most - done)).collect()]
            if not todo:
                break
        now, todo, began = todo[:few], todo[few:], time.monotonic()
        asked = spark.createDataFrame([(k, s) for k, s in enumerate(now)], "k long, start long").repartitionByRange(min(b["workers"], len(now)), "k")
        made = asked.select("start").mapInPandas(run, "start long, fetched_at string, results string").collect()  # a round's batches
        with ThreadPoolExecutor(WRITERS) as pool:
            held = sum(len(r["results"]) for r in made)
            list(pool.map(lambda r: batches.write(spark, folder, r["start"], b["batch_size"], b["base_url"], r["fetched_at"], json.loads(r["results"])), made))
        done += len(now)
        quick = time.monotonic() - began < SECONDS and held < HELD
        few = min(2 * few, b["workers"] * LARGEST) if quick else max(b["workers"] * ROUND, few // 2)
    return summary(spark, cfg) | {"fetched": done}


def release(cfg: Config, refresh: bool = False, open_url=http.opened) -> dict:
    """The catalogue and its version file, downloaded once; what is known of them."""
    g, folder = cfg["gtdb"], cfg.path("raw") / "gtdb"
    version, metadata, known = folder / g["version_file"], folder / g["metadata_file"], folder / "download_info.json"
    if refresh or not version.exists():
        http.download(f"{g['base_url']}/{g['version_file']}", version, open_url)
    info = json.loads(known.read_text()) if known.exists() else {}
    if refresh or not metadata.exists():
        modified = http.download(f"{g['base_url']}/{g['metadata_file']}", metadata, open_url)
        info = {"last_modified": modified, "downloaded_at": sinks.now()}
    if "sha256" not in info:
        info["sha256"] = sinks.file_sha256(metadata)
        sinks.write_json(info, known)
    name, date = http.release(version.read_text())
    return {"release": name, "released": date, "source_url": f"{g['base_url']}/{g['metadata_file']}", "metadata_path": str(metadata), "metadata_sha256": info["sha256"], "metadata_last_modified": info.get("last_modified")}
