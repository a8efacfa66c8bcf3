"""Records from a paged HTTP interface as a Spark data source, as many partitions as the service takes callers; and files to
download.

    spark.dataSource.register(RecordSource)
    spark.read.format("trait_records").option("base_url", ...).option("starts", "1,101").option("workers", 3).load()

Nothing here runs without a network; the parts that do the deciding (retry, checks of an answer) are plain functions.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)


def retry(get: Callable[[], object], tries: int = 8, backoff: float = 5.0, wait: Callable[[float], None] = time.sleep) -> object:
    """get(), again after refusals that may pass and answers that aren't JSON; twice the pause each time, 300 s at most."""
    for n in range(tries):
        try:
            return get()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError):
            if n == tries - 1:
                raise
        wait(min(300.0, backoff * 2**n))
    raise RuntimeError("no try left")


def checked(answer: object, start: int, size: int) -> dict[str, object]:
    """The records of an answer for ids start to start + size - 1, or an error that says what is wrong with it."""
    if not isinstance(answer, dict) or not isinstance(answer.get("results"), (dict, list)):
        raise ValueError(f"batch {start}: no results in the answer")
    results = answer["results"] or {}
    if isinstance(results, list):
        raise ValueError(f"batch {start}: results is a list")
    if answer.get("next"):
        raise ValueError(f"batch {start}: the answer goes on on another page")
    if answer.get("count") is not None and answer["count"] != len(results):
        raise ValueError(f"batch {start}: {answer['count']} records announced, {len(results)} there")
    if stray := [k for k in results if not start <= int(k) < start + size]:
        raise ValueError(f"batch {start}: ids that weren't asked for: {stray[:3]}")
    return results


def user_agent() -> str:
    """What requests say of their sender: $BACDIVE_USER_AGENT, or a name with $BACDIVE_CONTACT_EMAIL."""
    contact = os.environ.get("BACDIVE_CONTACT_EMAIL", "").strip()
    return os.environ.get("BACDIVE_USER_AGENT") or "nichemap/1.0 (research crawl)" + f" contact:{contact}" * bool(contact)


def opened(url: str, timeout: float = 300):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent(), "Accept": "*/*"}), timeout=timeout)


def fetch(url: str, timeout: float) -> object:
    with opened(url, timeout) as answer:
        return json.load(answer)


def batch_of(options: dict[str, str], start: int, get: Callable[[str, float], object]) -> tuple[dict[str, object], str]:
    """The records of the batch from start on, and when they were fetched; then the pause that the service asks for."""
    o, size = options, int(options.get("batch_size", 100))
    url = f"{o['base_url']}/fetch/{';'.join(map(str, range(start, start + size)))}"
    answer = retry(lambda: get(url, float(o.get("timeout", 180))), int(o.get("retries", 8)), float(o.get("backoff", 5)))
    found = checked(answer, start, size)
    time.sleep(float(o.get("delay", 0)))
    return found, datetime.now(timezone.utc).isoformat(timespec="seconds")


class RecordSource(DataSource):
    """bacdive_id, record and fetched_at; options base_url, starts (comma-separated), batch_size, timeout, retries, backoff,
    workers (partitions at most) and delay (seconds after each batch)."""

    @classmethod
    def name(cls) -> str:
        return "trait_records"

    def schema(self) -> str:
        return "bacdive_id long, record string, fetched_at string"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Callable[[str, float], object] = fetch):
        self.options, self.get = options, get

    def partitions(self) -> list[InputPartition]:
        starts = [int(x) for x in self.options["starts"].split(",") if x]
        workers = int(self.options.get("workers", 3))
        return [InputPartition(starts[k::workers]) for k in range(min(workers, len(starts)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for start in partition.value:
            found, now = batch_of(self.options, start, self.get)
            for key, record in found.items():
                yield int(key), json.dumps(record), now


def download(url: str, path: str | Path, open_url=opened) -> str | None:
    """The file at url, written beside and then renamed; its last-modified date, if there is one."""
    beside = Path(f"{path}.part")
    beside.parent.mkdir(parents=True, exist_ok=True)
    with open_url(url) as answer, beside.open("wb") as out:
        while block := answer.read(1 << 20):
            out.write(block)
        modified = answer.headers.get("Last-Modified")
    os.replace(beside, path)
    return modified


def release(text: str) -> tuple[str, str]:
    """(release, date) from the first two lines of a version file."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines or not re.fullmatch(r"v?\d+(\.\d+)?", lines[0]):
        raise ValueError(f"no release in the version file: {lines[:2]}")
    return lines[0], lines[1] if len(lines) > 1 else ""
