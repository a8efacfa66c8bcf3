"""Records merged by batches, in any order, again, and from a stream."""

import os
import random
from pathlib import Path

import pytest

from nichemap.streaming import merging

SCHEMA = "bacdive_id long, fetched_at string, body string, tags array<string>"


def rows(spark, place):
    return sorted((r["bacdive_id"], r["fetched_at"], r["body"]) for r in merging.read(spark, place).collect())


def test_any_order_gives_one_table(spark, tmp_path):
    """Versions that come in different orders and drops, some of them twice; nulls are oldest; ties go by hash."""
    rng = random.Random(2)
    versions = [(k, rng.choice([None, "a", "b", "c"]), f"{k}-{n}", [str(n)]) for k in range(60) for n in range(3)]
    wanted = None
    for turn in range(3):
        rng.shuffle(versions)
        place, at = str(tmp_path / f"t{turn}"), 0
        while at < len(versions):
            n = rng.randrange(40, 120)
            merging.merge(spark.createDataFrame(versions[at : at + n], SCHEMA), place, buckets=8)
            at += max(1, n - 10)  # some come again
        got = rows(spark, place)
        wanted = wanted or got
        assert got == wanted and len(got) == 60
    best = {}
    for k, v, *_ in versions:
        best[k] = max(best.get(k, ""), v or "")
    assert {k: v or "" for k, v, _ in wanted} == best


def test_only_buckets_with_new_ids_are_written(spark, tmp_path):
    place = str(tmp_path / "t")
    assert merging.merge(spark.createDataFrame([(k, "a", "x", None) for k in range(200)], SCHEMA), place, buckets=8) == list(range(8))
    before = {p: os.stat(p).st_mtime_ns for p in Path(place).rglob("*.parquet")}
    touched = merging.merge(spark.createDataFrame([(3, "b", "y", None)], SCHEMA), place, buckets=8)
    assert len(touched) == 1
    after = {p: os.stat(p).st_mtime_ns for p in Path(place).rglob("*.parquet")}
    changed = {p.parent.name for p in before.keys() ^ after.keys()} | {p.parent.name for p in before.keys() & after.keys() if before[p] != after[p]}
    assert changed == {f"_bucket={touched[0]}"} and (3, "b", "y") in rows(spark, place) and len(rows(spark, place)) == 200
    assert merging.merge(spark.createDataFrame([], SCHEMA), place, buckets=8) == [] and len(rows(spark, place)) == 200
    with pytest.raises(Exception, match="without bacdive_id"):
        merging.merge(spark.createDataFrame([(None, "b", "y", None)], SCHEMA), place, buckets=8)


def test_stream_is_merged_by_batches(spark, tmp_path):
    """Two drops of files: the second run takes only the new ones, and a later version replaces an earlier one."""
    source, place = str(tmp_path / "in"), str(tmp_path / "t")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", None)], SCHEMA).coalesce(1).write.parquet(source)
    merging.follow(stream(), place, str(tmp_path / "state"), buckets=4)
    spark.createDataFrame([(1, "c", "y", None), (2, "a", "y", None), (3, "a", "y", None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    merging.follow(stream(), place, str(tmp_path / "state"), buckets=4)
    assert rows(spark, place) == [(1, "c", "y"), (2, "b", "x"), (3, "a", "y")]
