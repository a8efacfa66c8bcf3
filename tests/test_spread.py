"""Tables in one small file, with much work a row, are no task's alone."""

from nichemap import queries, queries_stages
from nichemap.config import Config
from nichemap.operators import records
from nichemap.plans import crawl
from nichemap.sources import batches


def sources(df):
    """How often the plan reads a file."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_records_are_dealt(spark, sf):
    df = queries_stages.raw_records(spark, sf)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == queries.table(spark, sf, "customer").count()


def test_the_joined_table_of_the_reports_is_made_by_all_tasks(spark, sf):
    rows = queries_stages.joined(spark, sf).select("_metadata.file_path").groupBy("file_path").count().collect()
    sizes = [r["count"] for r in rows]  # a task writes a file
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_values_without_bins_read_a_record_once(spark, sf):
    assert sources(records.unbinned(queries_stages.raw_records(spark, sf), queries_stages.CFG)) == 1


def test_a_crawl_lists_its_folder_seldom(spark, tmp_path, monkeypatch):
    listed, cached = [], batches.cached
    monkeypatch.setattr(batches, "cached", lambda *a: listed.append(a) or cached(*a))
    cfg = Config(f"[paths]\nraw = '{tmp_path}'\n[bacdive]\nbase_url = 'x'\nbatch_size = 7\nstart_id = 1\nmax_id = 700\nwarn_if_max_found_within = 0\nworkers = 2\ndelay_seconds = 0\ntimeout_seconds = 1\nmax_retries = 1\nbackoff_seconds = 0\n")
    out = crawl.crawl(spark, cfg, None, queries_stages.answered)
    assert (out["fetched"], out["cached"], out["missing"], out["max_id_found"]) == (100, 100, 0, 699)
    assert len(listed) <= 3 and batches.records(spark, str(tmp_path / "bacdive")).count() == 600


def test_a_record_is_read_once_for_its_row(spark, sf):
    plan = records.trait_table(queries_stages.raw_records(spark, sf), queries_stages.CFG)._jdf.queryExecution().optimizedPlan().toString()
    rows = plan.split("\n", 1)[0]
    assert "get_json_object(record" not in rows and "sections" in rows


def test_sections_are_what_their_paths_hold(spark):
    whole = '{"General": {"doi": 1.50, "DSM-Number": "a\\u00e9 \\"", "NCBI tax id": [1, { "x" : 2}]}, "Morphology": [], "Name and taxonomic classification": {"LPSN": {"phylum": "P"}, "genus": null}, "Literature": "x"}'
    texts = [whole, whole[:60], whole[:95], whole + " x", "[1]", "{}", "", None, '{"General": 7, "Sequence information": {"Genome sequences": {"score": 1e3, "y": [ ]}}}']
    df = spark.createDataFrame([(t,) for t in texts], "record string").withColumn("sections", records.sections(queries.F.col("record")))
    for path in records.PATHS:
        own = df.select(records.text(path).alias("a"), records.at(queries.F.col("record"), *path).alias("b")).collect()
        assert [r["a"] for r in own] == [r["b"] for r in own], path


def test_a_record_is_not_read_to_be_read_again(spark, sf):
    df = queries_stages.raw_records(spark, sf)
    plan = df.select(records.sections(queries.F.col("record")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "$['General']" in plan and ", $)" not in plan  # paths for records with a fault; no copy of the whole


def test_bins_are_worked_out_once_for_a_row(spark, sf):
    made = records.trait_table(queries_stages.raw_records(spark, sf), queries_stages.CFG)
    for t in (*records.CATEGORICAL, *records.NUMERIC):
        plan = made.select(t, f"{t}_fine", f"{t}_conflict", f"{t}_fine_conflict")._jdf.queryExecution().optimizedPlan().toString()
        rows = plan.split("+- Project")[0]
        assert f"parts_{t}#" in rows and "lambda" not in rows  # no list is gone through once more


def test_lists_of_objects_and_of_other_things(spark):
    texts = [None, "5", "[]", "{}", '{"a":1}', '[{"a":1},{"b":"x,"}]', '[7,{"a":1}]', '[{"a":1},7,"x",{"a":[2,{"c":3}]}]', '[{"a":{"c":1},"b":2},null]', '[{"a":"},7"},{"b":"[{"}]', '[[{"a":1}],{"a":2}]', '["x"]']
    wanted = [[], [], [], [(None, None)], [("1", None)], [("1", None), (None, "x,")], [("1", None)], [("1", None), ('[2,{"c":3}]', None)], [('{"c":1}', "2")], [("},7", None), (None, "[{")], [("2", None)], []]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", records.parsed(queries.F.col("t"), "a", "b").alias("got"))
    assert [[tuple(x) for x in r["got"]] for r in df.orderBy("i").collect()] == wanted
