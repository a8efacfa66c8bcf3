"""Stages from the service to a report, and their command line.

    python -m nichemap.plans.pipeline fetch|extract|join|report|all [--config FILE] [--catalogue FILE] [--permutations N]
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import Config, load_config
from ..functions.book import Book
from ..functions.designations import Normaliser
from ..operators import linkage, records
from ..operators.selection import add_panel_flags, analysis_set
from ..sources import batches, http, tables
from . import crawl, findings, reports, story

#: Columns of the lists of a panel's species, before those of its traits.
SPECIES = ("bacdive_id", "species", "gtdb_species", "gtdb_genus", "gtdb_order", "gtdb_class", "gtdb_phylum", "gtdb_accession", "ncbi_assembly_accession", "assembly_genbank", "assembly_refseq", "match_method", "type_strain_bacdive", "gtdb_is_type_strain_of_species")
FLAGS = {"core": "core6_complete", "no_spore": "nospore5_complete"}


def fetch(spark: SparkSession, cfg: Config, most: int | None = None, get=http.fetch, open_url=http.opened) -> dict:
    """Batches that aren't cached yet, and the catalogue; what is there then."""
    out = {"sweep": crawl.crawl(spark, cfg, most, get), "catalogue": crawl.release(cfg, open_url=open_url)}
    sinks.write_json(out, cfg.path("interim") / "fetch.json")
    return out


def extract(spark: SparkSession, cfg: Config, allow_incomplete: bool = False) -> DataFrame:
    """Cached batches to the trait table, by id, with a log of values that got no bin."""
    sweep = crawl.summary(spark, cfg)
    if not sweep["complete"] and not allow_incomplete:
        raise RuntimeError(f"{sweep['missing']} batches are missing; fetch them, or allow an incomplete sweep")
    raw = batches.records(spark, str(cfg.path("raw") / "bacdive"))
    records.check(raw)
    out = cfg.path("interim")
    sinks.write_parquet(records.trait_table(raw, cfg).orderBy("bacdive_id"), str(out / "traits.parquet"))
    sinks.write_tsv(records.unbinned(raw, cfg), str(out / "unmapped_values.tsv"))
    sinks.write_json(sweep, out / "sweep.json")
    return spark.read.parquet(str(out / "traits.parquet"))


def join(spark: SparkSession, cfg: Config, catalogue_path: str | None = None) -> DataFrame:
    """The trait table with its genomes, panel flags and the catalogue's release; and the log of records without a genome."""
    out = cfg.path("interim")
    info = {"metadata_path": catalogue_path, "release": None} if catalogue_path else crawl.release(cfg)
    traits = spark.read.parquet(str(out / "traits.parquet"))
    m, normaliser = cfg["matching"], Normaliser.from_config(cfg)
    genomes = linkage.pref_order(linkage.prepare_catalogue(tables.catalogue(spark, info["metadata_path"]), m["assembly_level_rank"]))
    found, log = linkage.match(traits, genomes, normaliser, m["bare_requires_taxon_agreement"], Book(str(out / "designations"), normaliser))
    joined = add_panel_flags(linkage.one_to_one(traits, found), cfg).withColumn("gtdb_release", F.lit(info["release"]).cast("string"))
    sinks.write_parquet(joined.orderBy("bacdive_id"), str(out / "strains.parquet"))
    sinks.write_tsv(log, str(out / "unmatched_strains.tsv"))
    counts = linkage.catalogue_summary(genomes, normaliser).first().asDict()
    spark.catalog.clearCache()
    done = spark.read.parquet(str(out / "strains.parquet"))
    matched = {"records": done.count(), "matched": done.filter("genome_matched").count()}
    sinks.write_json({"joined_at": sinks.now()} | info | counts | matched, out / "join.json")
    return done


def manifest(df: DataFrame, cfg: Config, made: dict[str, DataFrame], log: DataFrame) -> dict:
    """Where the report's data came from, what was written and how much of it, and the settings it was made with."""
    known = lambda name: json.loads(p.read_text()) if (p := cfg.path("interim") / name).exists() else {}
    dates = reports.doi_dates(df).collect()  # as many as there were releases
    fetched = df.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    survivors = {f"{k}_order_level_survivors": made[f"cells_{k}_primary_order"].filter("empty_beyond_chance").count() for k in FLAGS}
    species = {f"{k}_species": analysis_set(df, cfg.panel(k)).count() for k in FLAGS}
    return {
        "made_at": sinks.now(), "config_sha256": cfg.sha256, "commit": sinks.commit_of(cfg.folder), "made_by": "python -m nichemap.plans.pipeline all",
        "records": {"api": cfg["bacdive"]["base_url"], "release": dates[0]["doi_date"] if dates else None, "doi_dates": {r["doi_date"]: r["count"] for r in dates}, "fetched_from": fetched[0], "fetched_to": fetched[1], "predictions": False} | known("sweep.json"),
        "catalogue": known("join.json"),
        "outputs": {"strains": sinks.fingerprint(df).first().asDict(), "unmatched_strains": sinks.fingerprint(log).first().asDict()},
        "counts": {"strains": df.count(), "matched": df.filter("genome_matched").count()} | species | survivors,
        "analysis": dict(cfg["analysis"]),
        "tables": sorted(made),
    }


def report(spark: SparkSession, cfg: Config, n_perm: int | None = None, grid: bool = True) -> dict[str, DataFrame]:
    """Every table as TSV, lists of accessions and species, a Markdown page, and a manifest with fingerprints."""
    interim, folder, final = cfg.path("interim"), cfg.path("reports"), cfg.path("final")
    df = spark.read.parquet(str(interim / "strains.parquet"))
    log = tables.tsv(spark, str(interim / "unmatched_strains.tsv"))
    lazy, results = reports.tables(df, cfg, n_perm, grid)
    made = {}
    with results:
        for name, table in (lazy | {"unmatched_reasons": reports.reasons(log)}).items():
            if name != "findings":
                made[name] = reports.settled(table)  # writing and showing it works it out once
        made["findings"] = reports.settled(findings.table_of(df, made, cfg))  # from tables that are there
    for name in made:
        sinks.write_tsv(made[name], str(folder / "tables" / f"{name}.tsv"), single=True)
    for key in FLAGS:
        species, traits = analysis_set(df, cfg.panel(key)), cfg.panel(key)
        sinks.write_list(species, "ncbi_assembly_accession", str(final / f"assembly_accessions_{key}_panel_species.txt"))
        sinks.write_tsv(species.select(*SPECIES, *traits, *[f"{t}_fine" for t in traits]), str(final / f"{key}_panel_species.tsv"))
    sinks.write_list(df.filter("genome_matched"), "ncbi_assembly_accession", str(final / "assembly_accessions_all.txt"), distinct=True)
    held = manifest(df, cfg, made, log)
    sinks.write_json(held, folder / "run_manifest.json")
    (folder / "report.md").write_text(story.told(made, cfg, held))
    return made


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("stage", choices=("fetch", "extract", "join", "report", "all"))
    parser.add_argument("--config")
    parser.add_argument("--catalogue")
    parser.add_argument("--allow-incomplete", action="store_true")
    parser.add_argument("--max-batches", type=int)
    parser.add_argument("--permutations", type=int)
    args = parser.parse_args(argv)
    cfg = load_config(args.config)
    spark = SparkSession.builder.appName("nichemap").getOrCreate()
    if args.stage in ("fetch", "all"):
        fetch(spark, cfg, args.max_batches)
    if args.stage in ("extract", "all"):
        extract(spark, cfg, args.allow_incomplete)
    if args.stage in ("join", "all"):
        join(spark, cfg, args.catalogue)
    if args.stage in ("report", "all"):
        report(spark, cfg, args.permutations)
        spark.catalog.clearCache()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
