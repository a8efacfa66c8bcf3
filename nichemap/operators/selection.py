"""Panel flags, analysis sets and dereplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config, column

ALL_TRAITS = ("gram", "shape", "motility", "spore", "oxygen", "temperature", "ph", "halophily_level")


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def add_panel_flags(df: DataFrame, cfg: Config, traits: tuple[str, ...] = ALL_TRAITS) -> DataFrame:
    """df with what is populated and usable, trait by trait and panel by panel."""
    has = lambda names, binning="coarse": all_of([F.col(column(t, binning)).isNotNull() for t in names])
    flags = {f"{t}_populated": F.coalesce(F.col(f"{t}_n_obs") > 0, F.lit(False)) for t in traits}
    flags |= {f"{t}_usable": F.col(t).isNotNull() for t in traits}
    salt = F.coalesce(F.col("nacl_tests_n") > 0, F.lit(False))
    flags |= {
        "nacl_tests_populated": salt,
        "any_trait_populated": any_of([flags[f"{t}_populated"] for t in traits] + [salt]),
        "n_core_usable": reduce(lambda a, b: a + b, [F.col(t).isNotNull().cast("int") for t in cfg.panel("core")]),
        "morph4_complete": has(cfg.panel("morphology")),
        "core6_complete": has(cfg.panel("core")),
        "nospore5_complete": has(cfg.panel("no_spore")),
        "morph4_fine_complete": has(cfg.panel("morphology"), "fine"),
        "core6_fine_complete": has(cfg.panel("core"), "fine"),
        "core6_complete_optimum_temp": has(cfg.panel("core")) & F.coalesce(F.col("temperature_bin_source") == "optimum", F.lit(False)),
        "all8_reference_complete": has(cfg.panel("core")) & F.col("ph").isNotNull() & F.col("halophily_level").isNotNull(),
    }
    return df.withColumns(flags)


def first_of_group(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def dereplicate(df: DataFrame, rank: str = "species") -> DataFrame:
    """One row a taxon of the rank: type strains first, then the preferred assembly, then the least id. Rows without the
    taxon stand for themselves, by accession."""
    key = F.coalesce(F.col(f"gtdb_{rank}"), F.concat(F.lit("acc:"), F.col("gtdb_accession")))
    is_type = F.coalesce(F.col("type_strain_bacdive"), F.lit(False)) | F.coalesce(F.col("gtdb_is_type_strain_of_species"), F.lit(False))
    return first_of_group(df, key, [is_type.desc(), F.col("pref_order").asc_nulls_last(), F.col("bacdive_id").asc()])


def analysis_set(df: DataFrame, traits: list[str], binning: str = "coarse", level: str = "species", temp_source: str = "all", require_genome: bool = True) -> DataFrame:
    """Rows complete on the traits, with a genome, at level strain, species or genus. The filter goes before the choice of one
    row a taxon: a species is in if any of its strains is complete."""
    if temp_source not in ("all", "optimum") or level not in ("strain", "species", "genus"):
        raise ValueError(f"temp_source {temp_source}, level {level}")
    keep = all_of([F.col(column(t, binning)).isNotNull() for t in traits])
    if require_genome:
        keep &= F.col("genome_matched")
    if temp_source == "optimum" and "temperature" in traits:
        keep &= F.col("temperature_bin_source") == "optimum"
    if level == "strain":
        return df.filter(keep)
    if not require_genome:
        raise ValueError("dereplication is defined on the genomes' taxonomy, so it needs a genome")
    return dereplicate(df.filter(keep), level)
