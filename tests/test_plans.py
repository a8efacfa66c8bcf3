"""The stages end to end on a small world, the HTTP source without a network, sinks and streaming."""

import gzip
import io
import json
import urllib.error
from pathlib import Path

import pytest

from nichemap import sinks
from nichemap.config import DEFAULT, Config, column, load_config
from nichemap.operators import maps
from nichemap.plans import pipeline, reports
from nichemap.sources import http
from nichemap.streaming import ingest
from test_operators import GENOMES

NAMES = ["accession", "ncbi_genbank_assembly_accession", "ncbi_strain_identifiers", "gtdb_taxonomy", "gtdb_representative", "gtdb_type_designation_ncbi_taxa", "ncbi_assembly_level", "ncbi_organism_name", "ncbi_taxid", "ncbi_species_taxid"]


def record(k):
    shape, gram, motile = ("rod-shaped", "coccus-shaped")[k % 2], ("positive", "negative")[k // 2 % 2], ("yes", "no")[k // 4 % 2]
    return {"General": {"DSM-Number": 1000 + k}, "Name and taxonomic classification": {"genus": f"G{k % 3}", "species": f"G{k % 3} s{k}", "type strain": "yes"}, "Morphology": {"cell morphology": {"cell shape": shape, "gram stain": gram, "motility": motile}}, "Culture and growth conditions": {"culture temp": {"type": "optimum", "growth": "positive", "temperature": "30"}}}


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    text = DEFAULT.read_text().replace("max_id = 250000", "max_id = 200").replace('core = ["gram", "shape", "motility", "spore", "oxygen", "temperature"]', 'core = ["gram", "shape", "motility"]').replace('no_spore = ["gram", "shape", "motility", "oxygen", "temperature"]', 'no_spore = ["gram", "shape"]').replace('morphology = ["gram", "shape", "motility", "spore"]', 'morphology = ["gram", "shape", "motility"]')
    text = text[: text.index("[[analysis.positive_controls]]")] + '[[analysis.positive_controls]]\npanel = "core"\nname = "x"\ncell = { gram = "negative", shape = "coccus", motility = "no" }\n'
    (root / "config.toml").write_text(text)
    raw = root / "data/raw/bacdive"
    raw.mkdir(parents=True)
    for start, ids in ((1, range(1, 41)), (101, [])):
        with gzip.open(raw / f"fetch_{start:07d}_n{len(ids)}.json.gz", "wt") as file:
            json.dump({"fetched_at": "t", "results": {str(k): record(k) for k in ids}}, file)
    rows = [(f"GB_GCA_{k + 500:09d}.1", f"GCA_{k + 500:09d}.1", f"DSM {1000 + k}", f"d__B;p__P{k % 2};c__C;o__O{k % 2};f__F;g__G{k % 3};s__G{k % 3} s{k}", "t", "type strain of species", "Contig", f"G{k % 3} s{k}", k, k) for k in range(1, 36)] + GENOMES
    with gzip.open(root / "catalogue.tsv.gz", "wt") as file:
        file.write("\t".join([*NAMES, "ncbi_type_material_designation", "checkm2_completeness", "checkm2_contamination", "genome_size", "other"]) + "\n")
        for r in rows:
            file.write("\t".join(map(str, [*r, "na", 99, 1, 1000, "x"])) + "\n")
    return root


def test_stages(spark, world, monkeypatch):
    monkeypatch.setattr(reports, "VIEWS", {k: reports.VIEWS[k] for k in ("primary", "genus-level")})
    cfg = load_config(world / "config.toml")
    traits = pipeline.extract(spark, cfg)
    assert traits.count() == 40
    joined = pipeline.join(spark, cfg, str(world / "catalogue.tsv.gz"))
    assert joined.filter("genome_matched").count() == 35 and joined.filter("core6_complete").count() == 40
    assert json.loads((world / "data/interim/join.json").read_text())["matched"] == 35
    log = spark.read.csv(str(world / "data/interim/unmatched_strains.tsv"), sep="\t", header=True)
    assert {r["reason"] for r in log.collect()} == {"no_bacdive_assembly;designations_not_in_gtdb"} and log.count() == 5
    made = pipeline.report(spark, cfg, n_perm=5)
    att = {r["stage"]: r["n_rows"] for r in made["attrition"].collect()}
    assert att["1. strains retrieved"] == 40 and att["5. core panel complete"] == 40
    assert made["cells_core_primary_global"].count() == 12 and made["occupancy_subsets_all_nulls"].count() == 4
    assert {"views_summary", "panels_side_by_side", "crosstab_core", "unmatched_reasons", "order_level_survivors_all_maps", "positive_control_core", "phylum_occupancy_core", "strata_core", "power_expected_per_cell_core", "minimum_detectable_constraint_no_spore"} <= set(made)
    assert made["power_expected_per_cell_core"].count() == 7
    manifest = json.loads((world / "reports/run_manifest.json").read_text())
    assert manifest["outputs"]["strains"]["n_rows"] == 40 and manifest["outputs"]["unmatched_strains"]["n_rows"] == 5 and manifest["config_sha256"] == cfg.sha256
    assert manifest["counts"] == {"strains": 40, "matched": 35, "core_species": 35, "no_spore_species": 35, "core_order_level_survivors": 0, "no_spore_order_level_survivors": 0}
    assert manifest["records"]["complete"] and manifest["records"]["max_id_found"] == 40 and manifest["records"]["fetched_from"] == "t" and manifest["catalogue"]["n_genomes"] == 35 + len(GENOMES) and manifest["analysis"]["seed"]
    page = (world / "reports/report.md").read_text()
    assert page.startswith("# Occupancy") and "35 (87.5%) have a genome" in page and "No cell is emptier than chance" in page and "Control x: IT FAILS" in page
    assert {"deficit_trend", "order_level_deficit_across_maps", "small_strata_false_positives_core", "doi_dates"} <= set(made)
    assert len("".join(p.read_text() for p in Path(world / "data/final/assembly_accessions_all.txt").glob("part-*")).split()) == 35
    assert {r["rule"] for r in made["findings"].collect()} >= {"no_survivor", "control_fails"} and "No cell stays empty beyond chance within orders." in page


def test_incomplete_sweeps_are_refused(spark, world):
    (world / "more.toml").write_text((world / "config.toml").read_text().replace("max_id = 200", "max_id = 300"))
    with pytest.raises(RuntimeError, match="missing"):
        pipeline.extract(spark, load_config(world / "more.toml"))


def test_stream_of_batches(spark, world):
    cfg = load_config(world / "config.toml")
    assert ingest.drain(ingest.trait_rows(spark, str(world / "data/raw/bacdive"), cfg)).count() == 40


def test_config(world):
    cfg = load_config()
    assert cfg.panel_levels(["gram", "oxygen"], "fine")["oxygen_fine"][2] == "microaerophile" and len(cfg.panel("core")) == 6 and len(cfg.sha256) == 64
    with pytest.raises(ValueError, match="coarse or fine"):
        column("gram", "middling")


def test_retry_and_checks():
    waits, answers = [], [urllib.error.HTTPError("u", 503, "", {}, None), ValueError("no json"), {"ok": 1}]

    def get():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert http.retry(get, 5, 5, waits.append) == {"ok": 1} and waits == [5, 10]
    with pytest.raises(urllib.error.HTTPError):
        http.retry(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", {}, None)), 3, 0, waits.append)
    good = {"count": 1, "results": {"3": {}}}
    assert http.checked(good, 1, 100) == {"3": {}}
    for bad in ([], {"results": [1]}, good | {"next": "u"}, good | {"count": 2}, {"results": {"200": {}}}):
        with pytest.raises(ValueError, match="batch 1"):
            http.checked(bad, 1, 100)


def test_record_source_reads_a_batch():
    reader = http.RecordReader({"base_url": "http://x", "starts": "1,101", "batch_size": "2"}, lambda url, _: {"results": {"1": {"u": url}}} if "1;2" in url else {"results": {}})
    parts = reader.partitions()
    assert [p.value for p in parts] == [[1], [101]]
    assert [p.value for p in http.RecordReader({"starts": "1,2,3,4,5", "workers": "2"}).partitions()] == [[1, 3, 5], [2, 4]]
    (key, rec, _), = reader.read(parts[0])
    assert key == 1 and json.loads(rec) == {"u": "http://x/fetch/1;2"} and http.RecordSource.name() == "trait_records"


def test_download_and_release(tmp_path):
    class Answer(io.BytesIO):
        headers = {"Last-Modified": "today"}

    assert http.download("u", tmp_path / "a" / "f", lambda _: Answer(b"abc")) == "today" and (tmp_path / "a/f").read_bytes() == b"abc"
    assert http.release("v226.1\n\nApril\nx") == ("v226.1", "April") and http.release("226") == ("226", "")
    for bad in ("", "latest\nv1"):
        with pytest.raises(ValueError, match="release"):
            http.release(bad)


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    from nichemap.plans import crawl
    from nichemap.sources import batches

    def answered(url, timeout):
        found = {i: {"k": int(i)} for i in url.rsplit("/", 1)[1].split(";") if 10 < int(i) < 60}
        return {"count": len(found), "results": found or []}

    text = DEFAULT.read_text().replace("max_id = 250000", "max_id = 100").replace("batch_size = 100", "batch_size = 10").replace("delay_seconds = 0.2", "delay_seconds = 0")
    (tmp_path / "c.toml").write_text(text)
    cfg = load_config(tmp_path / "c.toml")
    first = crawl.crawl(spark, cfg, 4, answered)
    assert (first["fetched"], first["cached"], first["missing"], first["complete"]) == (4, 4, 6, False)
    rest = crawl.crawl(spark, cfg, None, answered)
    assert (rest["fetched"], rest["cached"], rest["complete"], rest["records"], rest["max_id_found"]) == (6, 10, True, 49, 59)
    folder = str(cfg.path("raw") / "bacdive")
    assert sorted(r["bacdive_id"] for r in batches.records(spark, folder).collect()) == list(range(11, 60))
    with gzip.open(f"{folder}/fetch_0000011_n10.json.gz") as file:
        held = json.load(file)
    assert (held["requested_start"], held["requested_end"], held["api"]) == (11, 20, cfg["bacdive"]["base_url"]) and held["results"]["11"] == {"k": 11}
    assert crawl.crawl(spark, cfg, None, answered)["fetched"] == 0


def test_release_is_downloaded_once(tmp_path):
    from nichemap.plans import crawl

    class Answer(io.BytesIO):
        headers = {"Last-Modified": "today"}

    asked = []
    cfg = Config(DEFAULT.read_text(), tmp_path)
    open_url = lambda url: asked.append(url) or Answer(b"v226\nApril\n" if "VERSION" in url else b"abc")
    info = crawl.release(cfg, open_url=open_url)
    assert (info["release"], info["released"], info["metadata_last_modified"]) == ("v226", "April", "today") and len(info["metadata_sha256"]) == 64
    assert crawl.release(cfg, open_url=open_url) == info and len(asked) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [])], "k int, v string, a array<int>")
    sinks.write_tsv(df, str(tmp_path / "t"), single=True)
    assert sorted((tmp_path / "t").glob("part-*"))[0].read_text().splitlines()[0] == "k\tv\ta"
    sinks.write_json({"a": 1}, tmp_path / "x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1} and not list(tmp_path.glob("*.part"))
    assert len(sinks.file_sha256(tmp_path / "x.json")) == 64
    assert sinks.fingerprint(df.select("k")).first() == sinks.fingerprint(df.select("k").orderBy("k", ascending=False)).first()
    own = lambda *rows: tuple(sinks.fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first())
    unlike = [own(("x", "y"), ("x", "y")), own(("p", "q"), ("p", "q")), own(("x", "y")), own(("x", None)), own((None, "x")), own(("a|b", "c")), own(("a", "b|c")), own(("", None)), own((None, "")), own(("1:x", "")), own(("", "1:x"))]
    assert len(set(unlike)) == len(unlike) and own(("x", "y"), ("p", "q")) == own(("p", "q"), ("x", "y"))
    assert sinks.fingerprint(df.limit(0)).first()["content"] == "0"
    assert (sinks.pct(1, 3), sinks.pct(1, 0), sinks.fmt(1234), sinks.fmt(0.5), sinks.fmt(None), sinks.fmt(1e-9), sinks.fmt(True)) == ("33.3%", "–", "1,234", "0.500", "", "1.0e-09", "yes")
    assert sinks.markdown([{"a": 1, "b": "x|y"}], ["a", "b"]).splitlines()[2] == "| 1 | x\\|y |"
    assert sinks.commit_of(tmp_path) is None


def test_long_tables_say_so(spark):
    from nichemap.plans import story

    assert "The first 60 of 70 rows; all are in `tables/t.tsv`." in story.shown("t", spark.range(70)) and "first" not in story.shown("t", spark.range(60))


def test_report_has_every_panel(spark, world, monkeypatch):
    """Views with their cells, survivors' tables and coverage, for both panels; here the first cell counts as a survivor."""
    monkeypatch.setattr(reports, "VIEWS", {k: reports.VIEWS[k] for k in ("primary", "genus-level")})
    cfg = load_config(world / "config.toml")
    pipeline.extract(spark, cfg)
    pipeline.join(spark, cfg, str(world / "catalogue.tsv.gz"))
    monkeypatch.setattr(maps, "survivors", lambda made, name: [0])
    made, results = reports.tables(spark.read.parquet(str(world / "data/interim/strains.parquet")), cfg, 5, grid=False)
    for key in ("core", "no_spore"):
        assert {f"cells_{key}_genus-level_global", f"cells_{key}_genus-level_order", f"cells_{key}_primary_family"} <= set(made)
        assert any(n.startswith(f"survivor_{key}_") and n.endswith("_order_contributions") for n in made) and any(n.startswith(f"survivor_{key}_") and n.endswith("_family_carriers") for n in made)
        views, = (made[n] for n in made if n.startswith(f"survivor_{key}_") and n.endswith("_views"))
        assert {(r["view"], r["null"]) for r in views.collect()} == {("primary", n) for n in ("global", "order", "family")} | {("genus-level", n) for n in ("global", "order")}
    rows = {(r["panel"], r["view"], r["null"]) for r in made["views_summary"].select("panel", "view", "null").collect()}
    assert rows == {(p, v, n) for p in ("core", "no_spore") for v, n in [("primary", n) for n in ("global", "phylum", "class", "order")] + [("genus-level", n) for n in ("global", "order")]}
    assert {r["panel"] for r in made["coverage_vs_independence"].collect()} == {"core", "no_spore", "morphology", "core_ph", "original_8"}
    assert all(f"survivors_{key}_{what}" in made and made[f"survivors_{key}_{what}"].count() for key in ("core", "no_spore") for what in ("views", "order_contributions"))
    held = [Path(t.path.removeprefix("file:")) for t in results.held]
    assert all(p.exists() for p in held)
    results.close()
    assert not any(p.exists() for p in held)
