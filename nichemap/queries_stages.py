"""The operators of the stages over a world made of the star-schema tables: every customer is a record with nested sections,
its nation and key decide what the sections hold, and SQL decides the same from the same columns."""

from __future__ import annotations

import atexit
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .sinks import shared_folder
from .config import Config, load_config
from .functions import designations as D
from .functions import values as V
from .operators import linkage, maps, occupancy, records, selection
from .operators.occupancy import spread
from .plans import crawl, reports
from .queries import CUSTOMERS, MIN_STRATUM, SQL_CUSTOMERS, SQL_EXPECTED, SQL_STRATA, customers, query, sql_grid, table
from .sources import batches, tables

CFG = load_config()


def K() -> Column:
    return F.col("c_custkey")


def N() -> Column:
    return F.col("c_nationkey")


def pick(by: Column, *values: object) -> Column:
    """The value at place by; null for None."""
    made = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return reduce(lambda rest, kv: F.when(by == kv[0], kv[1]).otherwise(rest), reversed(list(enumerate(made[:-1]))), made[-1])


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bacdive_id, record and fetched_at; sections are missing, objects, or lists with things that aren't objects."""
    test = lambda kind, growth, value, key="temperature": F.struct(F.lit("1").alias("@ref"), F.lit(kind).alias("type"), F.lit(growth).alias("growth"), F.lit(value).alias(key))
    own = lambda key, *values: F.to_json(F.array(*[F.struct(F.lit(str(k)).alias("@ref"), F.lit(v).alias(key)) for k, v in enumerate(values)]))
    number = K().cast("string")
    gca = F.concat(F.lit("GCA_"), F.lpad(number, 9, "0"))
    listed = F.to_json(F.array(F.struct(F.concat(gca, F.lit(".1")).alias("INSDC accession")), F.struct(F.concat(gca, F.lit(".2")).alias("INSDC accession")), F.struct(F.lit("XX").alias("INSDC accession"))))
    stain = F.when(K() % 5 == 0, None).when(K() % 7 == 0, own("gram stain", "positive", "negative")).when(K() % 2 == 1, own("gram stain", " Negative ")).otherwise(own("gram stain", "positive", "variable"))
    shape = F.when(K() % 6 == 0, None).otherwise(pick(N() % 4, own("cell shape", "rod-shaped"), own("cell shape", "coccus-shaped"), own("cell shape", "spiral-shaped"), own("cell shape", "weird")))
    motile = F.when(N() % 3 == 0, own("motility", "yes")).otherwise(own("motility", "no"))
    # the three lists of observations as one list, with a number and a word among the objects
    inner = lambda c: F.coalesce(F.regexp_replace(c, r"^\[|\]$", ""), F.lit("3"))
    morphology = F.concat(F.lit("["), inner(stain), F.lit(', 7, "x", '), inner(shape), F.lit(", "), inner(motile), F.lit("]"))
    oxygen = pick(K() % 3, own("oxygen tolerance", "microaerophile"), own("oxygen tolerance", "aerobe"), own("oxygen tolerance", "aerobe", "anaerobe"))
    warmth = pick(K() % 5, F.to_json(test("optimum", "positive", "30 °C")), F.to_json(test("growth", "positive", "25-35")), F.to_json(F.array(test("growth", "positive", "10-40"), test("growth", "negative", "30"))), F.to_json(test("optimum", None, "warm")), None)
    salt = pick(K() % 8, own("halophily level", "Halophilic"), own("halophily level", "halophilic", "non-halophilic"), F.lit('{"salt": "NaCl", "growth": "positive", "concentration": "5 %"}'), *[None] * 5)
    ids = pick(K() % 4, F.concat(F.lit('[{"NCBI tax id": '), number, F.lit('}, {"NCBI tax id": '), number, F.lit('}, "x"]')), F.concat(F.lit('{"NCBI tax id": '), number, F.lit("}")), number, None)
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), value))
    text = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    section = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    general = section(part("DSM-Number", F.when(K() % 10 == 0, number)), part("doi", text(F.concat(F.lit("10.1/x.2024010"), K() % 3 + 1, F.lit(".1")))), part("NCBI tax id", ids))
    named = section(part("species", text(F.concat(F.lit("S sp"), K() % 700))), part("genus", text(F.concat(F.lit(" G"), N()))), part("strain designation", F.when(K() % 2 == 0, F.concat(F.lit('["A '), number, F.lit('", "", "B '), number, F.lit('"]'))).otherwise(text(F.concat(F.lit("A "), number)))), part("type strain", F.when(K() % 10 < 2, F.lit('"yes"')).otherwise(F.lit('"no"'))))
    record = section(
        part("General", general), part("Name and taxonomic classification", named), part("Literature", section(part("culture collection no.", F.when(K() % 3 == 0, text(F.concat(F.lit("DSM "), number)))))), part("Morphology", section(part("cell morphology", morphology))),
        part("Culture and growth conditions", section(part("culture temp", warmth), part("culture pH", F.when(K() % 9 == 0, F.to_json(test("optimum", "positive", "pH 7", "pH")))))), part("Physiology and metabolism", section(part("spore formation", F.when(K() % 4 < 3, F.lit('{"spore formation": "no"}'))), part("oxygen tolerance", oxygen), part("halophily", salt))),
        part("Sequence information", section(part("Genome sequences", pick(K() % 4, listed, F.concat(F.lit('{"INSDC accession": "'), gca, F.lit('.7"}')), None)))),
    )
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))  # a record is a hundred times its row
    return rows.select(K().alias("bacdive_id"), record.alias("record"), F.concat(F.lit("2024-01-0"), K() % 9 + 1).alias("fetched_at"))


#: Customers as SQL sees the same records: w has what the records say, g the genomes, m the flags of both.
SQL_WORLD = """
w AS (SELECT c_custkey AS k, c_nationkey AS n, 'GCA_' || lpad(c_custkey::VARCHAR, 9, '0') AS acc,
 CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 OR k % 2 = 0 THEN 2 ELSE 1 END AS gram_n, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL WHEN k % 2 = 1 THEN 'negative' ELSE 'positive' END AS gram, k % 5 > 0 AND k % 7 = 0 AS gram_conflict,
 CASE WHEN k % 6 > 0 THEN ['rod','coccus','spiral','other'][n % 4 + 1] END AS shape_fine, CASE WHEN k % 6 > 0 THEN ['rod','coccus','other','other'][n % 4 + 1] END AS shape, CASE WHEN n % 3 = 0 THEN 'yes' ELSE 'no' END AS motility, CASE WHEN k % 4 < 3 THEN 'no' END AS spore,
 CASE k % 3 WHEN 0 THEN 'microaerophile' WHEN 1 THEN 'aerobe' END AS oxygen_fine, CASE k % 3 WHEN 0 THEN 'facultative' WHEN 1 THEN 'aerobe' END AS oxygen, k % 3 = 2 AS oxygen_conflict,
 CASE WHEN k % 5 < 2 THEN 'meso' END AS temperature, CASE k % 5 WHEN 0 THEN 'optimum' WHEN 1 THEN 'growth_range' WHEN 2 THEN 'growth_range' ELSE 'none' END AS temp_source, CASE k % 5 WHEN 0 THEN 30.0 WHEN 1 THEN 30.0 WHEN 2 THEN 25.0 END AS temp_point, k % 5 = 2 AS temp_conflict, [1, 1, 2, 1, 0][k % 5 + 1] AS temp_n,
 CASE WHEN k % 9 = 0 THEN 'neutrophile' END AS ph, CASE WHEN k % 8 = 0 THEN 'halophilic' END AS halo, k % 8 = 1 AS halo_conflict, CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS halo_n, (k % 8 = 2)::INT AS salt_n
 FROM (SELECT *, c_custkey AS k, c_nationkey AS n FROM customer)),
g AS (SELECT *, k % 10 < 7 AS matched, k % 4 < 2 AS lists, CASE WHEN k % 10 < 7 AND k % 11 > 0 THEN 'sp' || k % 900 END AS species, CASE WHEN k % 10 < 7 THEN 'g' || k % 90 END AS genus, CASE WHEN k % 10 < 7 THEN 'f' || n END AS family, CASE WHEN k % 10 < 7 THEN 'o' || n % 11 END AS ord, CASE WHEN k % 10 < 7 THEN 'c' || n % 5 END AS cls, CASE WHEN k % 10 < 7 THEN 'p' || n % 3 END AS phylum, CASE WHEN k % 10 < 7 THEN k * 7 % 1009 END AS pref, k % 10 < 7 AND k % 13 = 0 AS type_cat, k % 10 < 2 AS type_rec FROM w),
m AS (SELECT *, gram IS NOT NULL AND shape IS NOT NULL AND spore IS NOT NULL AS morph4, gram IS NOT NULL AND shape IS NOT NULL AND oxygen IS NOT NULL AND temperature IS NOT NULL AS nospore5, gram IS NOT NULL AND shape IS NOT NULL AND spore IS NOT NULL AND oxygen IS NOT NULL AND temperature IS NOT NULL AS core6 FROM g)"""


@query(f"""WITH {SQL_WORLD} SELECT k AS bacdive_id, 'S sp' || k % 700 AS species, 'G' || n AS genus, CASE WHEN k % 2 = 0 THEN 'A ' || k || ', B ' || k ELSE 'A ' || k END AS strain_designation_raw, CASE WHEN k % 3 = 0 THEN 'DSM ' || k END AS culture_collection_no_raw, CASE WHEN k % 10 = 0 THEN k::VARCHAR END AS dsm_number, type_rec AS type_strain_bacdive,
CASE WHEN k % 4 < 3 THEN k::VARCHAR ELSE '' END AS tax_ids, '2024010' || (k % 3 + 1) AS doi_date, CASE WHEN lists THEN acc END AS bacdive_gca, lists::BIGINT AS bacdive_gca_n, gram, gram_n::BIGINT AS gram_n_obs, gram_conflict, shape, shape_fine, motility, spore, oxygen, oxygen_fine, oxygen_conflict, k % 3 = 0 AS oxygen_microaerophile_folded,
temperature, temp_source AS temperature_bin_source, temp_point AS temperature_point, temp_conflict AS temperature_conflict, ph, halo AS halophily_level, halo_conflict AS halophily_level_conflict, halo_n::BIGINT AS halophily_level_n_obs, salt_n::BIGINT AS nacl_tests_n, CASE WHEN halo_n > 0 THEN halo_n::BIGINT END AS halophily_raw_entries FROM m""")
def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as typed rows."""
    made = records.trait_table(raw_records(spark, sf_dir), CFG)
    plain = "species genus strain_designation_raw culture_collection_no_raw dsm_number type_strain_bacdive doi_date bacdive_gca bacdive_gca_n gram gram_n_obs gram_conflict shape shape_fine motility spore oxygen oxygen_fine oxygen_conflict oxygen_microaerophile_folded temperature temperature_bin_source temperature_point temperature_conflict ph halophily_level halophily_level_conflict halophily_level_n_obs nacl_tests_n"
    entries = F.json_array_length("halophily_level_raw").cast("long").alias("halophily_raw_entries")
    return made.select("bacdive_id", *plain.split(), F.array_join(V.tax_ids(F.col("ncbi_tax_ids_raw")), ",").alias("tax_ids"), entries)


@query(f"""WITH {SQL_WORLD}, u AS (SELECT 'unmapped' AS kind, 'gram' AS trait, 'variable' AS value, count(*) AS n FROM w WHERE k % 5 > 0 AND k % 7 > 0 AND k % 2 = 0 UNION ALL SELECT 'unmapped', 'shape', 'weird', count(*) FROM w WHERE k % 6 > 0 AND n % 4 = 3 UNION ALL SELECT 'unparsed', 'temperature', 'warm', count(*) FROM w WHERE k % 5 = 3) SELECT * FROM u WHERE n > 0""")
def record_values_without_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unbinned(raw_records(spark, sf_dir), CFG).withColumnRenamed("count", "n")


@query("SELECT c_custkey AS bacdive_id, 'predictions' AS problem FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT c_custkey, 'duplicate' FROM customer WHERE c_custkey % 40 = 0")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that come twice, and records with a section that must not be there."""
    df = raw_records(spark, sf_dir)
    odd = df.withColumn("record", F.when(F.col("bacdive_id") % 50 == 0, F.regexp_replace("record", r"^\{", '{"Genome-based predictions": {"x": 1}, ')).otherwise(F.regexp_replace("record", r"^\{", '{"Genome-based predictions": {}, ')))
    return records.violations(odd.union(df.filter(F.col("bacdive_id") % 40 == 0)))


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined table: typed records with a genome each for seven in ten."""
    df = records.trait_table(raw_records(spark, sf_dir), CFG).withColumnRenamed("bacdive_id", "c_custkey")
    nation = F.regexp_extract("genus", "[0-9]+", 0).cast("long")
    has = K() % 10 < 7
    at = lambda prefix, c: F.when(has, F.concat(F.lit(prefix), c))
    made = {
        "genome_matched": has, "gtdb_accession": at("acc", K()), "ncbi_assembly_accession": at("acc", K()), "gtdb_species": F.when(K() % 11 > 0, at("sp", K() % 900)), "gtdb_genus": at("g", K() % 90), "gtdb_family": at("f", nation), "gtdb_order": at("o", nation % 11), "gtdb_class": at("c", nation % 5), "gtdb_phylum": at("p", nation % 3),
        "pref_order": F.when(has, K() * 7 % 1009), "gtdb_is_type_strain_of_species": has & (K() % 13 == 0), "bacdive_lists_assembly": K() % 4 < 2, "bacdive_assembly_in_gtdb": has & (K() % 4 < 2), "designation_route_hit": has & (K() % 4 >= 2), "match_method": F.when(has & (K() % 4 < 2), "accession").when(has, "designation").otherwise("none"), "match_token_kind": F.when(has & (K() % 4 == 2), "collection").when(has & (K() % 4 == 3), "bare").when(has, "accession"),
    }
    return selection.add_panel_flags(df.withColumns(made).withColumnRenamed("c_custkey", "bacdive_id"), CFG)


_joined: dict[tuple[str, str], DataFrame] = {}


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined table, of which a session makes one for each folder of tables; it goes when the driver's program ends."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _joined:
        made = sinks.kept(world(spark, sf_dir))
        _joined[key] = made.rows
        atexit.register(lambda: spark.sparkContext._jsc and made.remove())
    return _joined[key]


@query(f"""WITH {SQL_WORLD} SELECT k AS bacdive_id, gram_n > 0 AS gram_populated, k % 4 < 3 AS spore_populated, temp_n > 0 AS temperature_populated, halo_n > 0 AS halophily_level_populated, gram IS NOT NULL AS gram_usable, temperature IS NOT NULL AS temperature_usable, ph IS NOT NULL AS ph_usable, salt_n > 0 AS nacl_tests_populated, true AS any_trait_populated,
(gram IS NOT NULL)::INT + (shape IS NOT NULL)::INT + 1 + (spore IS NOT NULL)::INT + (oxygen IS NOT NULL)::INT + (temperature IS NOT NULL)::INT AS n_core_usable, morph4 AS morph4_complete, core6 AS core6_complete, nospore5 AS nospore5_complete, morph4 AS morph4_fine_complete, core6 AS core6_fine_complete, core6 AND temp_source = 'optimum' AS core6_complete_optimum_temp, core6 AND ph IS NOT NULL AND halo IS NOT NULL AS all8_reference_complete FROM m""")
def panel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = "gram_populated spore_populated temperature_populated halophily_level_populated gram_usable temperature_usable ph_usable nacl_tests_populated any_trait_populated n_core_usable morph4_complete core6_complete nospore5_complete morph4_fine_complete core6_fine_complete core6_complete_optimum_temp all8_reference_complete"
    return joined(spark, sf_dir).select("bacdive_id", *flags.split())


def sql_set(where: str, group: str | None) -> str:
    """The rows of m that an analysis set keeps: one a group, type strains first, then the preferred assembly, then the least id."""
    if group is None:
        return f"SELECT * FROM m WHERE {where}"
    return f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY coalesce({group}, 'acc:' || k) ORDER BY (type_rec OR type_cat) DESC, pref, k) AS rn FROM m WHERE {where}) WHERE rn = 1"


SETS = {"species": ("nospore5 AND matched", "species", {}), "genus": ("nospore5 AND matched", "genus", {"level": "genus"}), "strain": ("nospore5 AND matched", None, {"level": "strain"}), "optimum": ("nospore5 AND matched AND temp_source = 'optimum'", "species", {"temp_source": "optimum"}), "any strain": ("nospore5", None, {"level": "strain", "require_genome": False})}


@query(f"WITH {SQL_WORLD} " + " UNION ALL ".join(f"SELECT '{name}' AS view, k AS bacdive_id FROM ({sql_set(where, group)})" for name, (where, group, _) in SETS.items()))
def analysis_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows with a genome, one a species or genus, or all."""
    df = joined(spark, sf_dir)
    return reports.stacked([selection.analysis_set(df, CFG.panel("no_spore"), **how).select(F.lit(name).alias("view"), "bacdive_id") for name, (_, _, how) in SETS.items()])


TRAITS = {"gram": ("gram_n > 0", "gram", "gram_conflict"), "shape": ("k % 6 > 0", "shape", "false"), "motility": ("true", "motility", "false"), "spore": ("k % 4 < 3", "spore", "false"), "oxygen": ("true", "oxygen", "oxygen_conflict"), "temperature": ("temp_n > 0", "temperature", "temp_conflict"), "ph": ("k % 9 = 0", "ph", "false"), "halophily_level": ("halo_n > 0", "halo", "halo_conflict")}
STAGES = {"1. strains retrieved": "true", "2. at least one trait populated (raw)": "true"} | {f"3. {reports.LABELS[t]} — usable value": f"{c} IS NOT NULL" for t, (_, c, _) in TRAITS.items()} | {"3. (NaCl growth tests present, raw only)": "salt_n > 0", "4. morphology panel complete": "morph4", "5. core panel complete": "core6", "5a. core panel, temperature from optimum": "core6 AND temp_source = 'optimum'", "5b. no-spore panel complete": "nospore5", "5c. eight traits complete": "core6 AND ph IS NOT NULL AND halo IS NOT NULL"}


@query(f"WITH {SQL_WORLD}, s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS stage, k, matched, species, {where} AS h FROM m" for name, where in STAGES.items()) + ") SELECT stage, count(*) FILTER (h) AS n_rows, round(100.0 * count(*) FILTER (h) / count(*), 6) AS pct_of_all, count(*) FILTER (h AND matched) AS n_matched, round(100.0 * count(*) FILTER (h AND matched) / nullif(count(*) FILTER (h), 0), 6) AS pct_matched, count(DISTINCT species) FILTER (h AND matched) AS n_distinct FROM s GROUP BY 1")
def report_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attrition(joined(spark, sf_dir), CFG).withColumns({c: F.round(c, 6) for c in ("pct_of_all", "pct_matched")})


@query(f"WITH {SQL_WORLD} " + " UNION ALL ".join(f"SELECT '{reports.LABELS[t]}' AS trait, count(*) FILTER ({p}) AS any_raw, count({c}) AS usable, count(*) FILTER ({x}) AS lost_to_conflict, count(*) FILTER ({p}) - count({c}) - count(*) FILTER ({x}) AS no_binnable_value, count({c}) FILTER (matched) AS usable_with_genome FROM m" for t, (p, c, x) in TRAITS.items()))
def report_per_trait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_trait(joined(spark, sf_dir))


GENOMES = {"in the set": "true", "lists an assembly": "lists", "listed assembly in the catalogue": "lists AND matched", "listed assembly not in the catalogue": "lists AND NOT matched", "matched by accession": "matched AND k % 4 < 2", "matched by a collection''s number": "matched AND k % 4 = 2", "matched by a bare designation": "matched AND k % 4 = 3", "matched": "matched", "unmatched": "NOT matched"}
STRAINS = {"type strain by the record": "type_rec", "type strain by the catalogue": "type_cat", "either": "type_rec OR type_cat", "both": "type_rec AND type_cat", "by the record only": "type_rec AND NOT type_cat"}


def sql_steps(steps: dict[str, str], rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS step, 'set' AS subset, count(*) AS n, count(*) FILTER ({w}) AS k, round(100.0 * count(*) FILTER ({w}) / count(*), 6) AS pct FROM {rows}" for s, w in steps.items())


@query(f"WITH {SQL_WORLD}, r AS (SELECT * FROM m WHERE core6) " + sql_steps(GENOMES, "r"))
def report_genome_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.genome_attrition(joined(spark, sf_dir), F.col("core6_complete")).withColumn("pct", F.round("pct", 6))


@query(f"WITH {SQL_WORLD}, r AS ({sql_set('nospore5 AND matched', 'species')}) " + sql_steps(STRAINS, "r"))
def report_type_strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_strains(selection.analysis_set(joined(spark, sf_dir), CFG.panel("no_spore"))).withColumn("pct", F.round("pct", 6))


@query(f"WITH {SQL_WORLD} SELECT '2024010' || (k % 3 + 1) AS doi_date, count(*) AS n, (SELECT min('2024-01-0' || (k % 9 + 1)) FROM w) AS fetched_from, (SELECT max('2024-01-0' || (k % 9 + 1)) FROM w) AS fetched_to FROM w GROUP BY 1")
def report_release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = joined(spark, sf_dir)
    return reports.doi_dates(df).withColumnRenamed("count", "n").join(df.agg(F.min("fetched_at").alias("fetched_from"), F.max("fetched_at").alias("fetched_to")), how="cross")  # a row a date, and one row


@query(f"WITH {SQL_WORLD}, r AS ({sql_set('nospore5 AND matched', 'species')}), " + "s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS rank, coalesce({c}, '__unassigned__') AS t, count(*) AS n FROM r GROUP BY ALL" for name, c in (("phylum", "phylum"), ("class", "cls"), ("order", "ord"))) + ") SELECT rank, least AS min_size, count(*) FILTER (n >= least) AS strata_used, count(*) FILTER (n < least) AS strata_excluded, coalesce(sum(n) FILTER (n >= least), 0)::BIGINT AS N_used, coalesce(sum(n) FILTER (n < least), 0)::BIGINT AS species_excluded FROM s, (SELECT unnest([2, 5, 10]) AS least) GROUP BY 1, 2")
def report_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.strata_bookkeeping(joined(spark, sf_dir), CFG, CFG.panel("no_spore"))


# A small panel, of which all maps under all nulls can be told in SQL but for what the draws say
SMALL = Config("""
[traits.gram]
coarse_levels = ["negative", "positive"]
fine_levels = ["negative", "positive"]
[traits.shape]
coarse_levels = ["rod", "coccus", "other"]
fine_levels = ["rod", "coccus", "spiral", "filamentous", "other"]
[traits.motility]
coarse_levels = ["no", "yes"]
fine_levels = ["no", "yes"]
[panels]
core = ["gram", "shape", "motility"]
no_spore = ["gram", "shape"]
morphology = ["gram", "motility"]
[analysis]
seed = 1
n_perm_full = 200
n_perm_subset = 100
min_expected_for_test = 3.0
fdr_alpha = 0.05
min_stratum_size = 5
""")
RANKS = {"global": "'all'", "phylum": "coalesce(phylum, '__unassigned__')", "class": "coalesce(cls, '__unassigned__')", "order": "coalesce(ord, '__unassigned__')"}


def sql_map(traits: list[str], null: str, view: str = "primary") -> str:
    """One row of the figures of a map that don't depend on draws."""
    binning, level, _ = reports.VIEWS[view]
    col = {t: f"{t}_fine" if binning == "fine" and t == "shape" else t for t in traits}
    levels = {t: SMALL["traits"][t][f"{binning}_levels"] for t in traits}
    rows = sql_set(" AND ".join(f"{c} IS NOT NULL" for c in col.values()) + " AND matched", {"species": "species", "genus": "genus", "strain": None}[level])
    cells = 1
    for own in levels.values():
        cells *= len(own)
    least = 0 if null == "global" else 5
    parts = " ".join(f"JOIN (SELECT st, {c} AS l{i}, count(*) AS c{i} FROM u GROUP BY ALL) t{i} USING (st)" for i, c in enumerate(col.values()))
    product = " * ".join(["n::DOUBLE"] + [f"(c{i} / n::DOUBLE)" for i in range(len(col))])
    return f"""(WITH a AS (SELECT *, {RANKS[null]} AS st FROM ({rows})), z AS (SELECT st, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= {least}), u AS (SELECT * FROM a SEMI JOIN z USING (st)),
e AS (SELECT {', '.join(f'l{i}' for i in range(len(col)))}, sum({product}) AS e FROM z {parts} GROUP BY ALL), o AS (SELECT {', '.join(col.values())}, count(*) AS c FROM u GROUP BY ALL)
SELECT {len(traits)} AS size, '{' + '.join(traits)}' AS traits, '{view}' AS view, '{null}' AS "null", (SELECT count(*) FROM u) AS N, {cells} AS cells, (SELECT count(*) FROM o) AS occupied, {cells} - (SELECT count(*) FROM o) AS empty_cells, (SELECT count(*) FROM e WHERE e >= 3) AS testable_cells)"""


FIGURES = ("size", "traits", "view", "null", "N", "cells", "occupied", "empty_cells", "testable_cells")


@query(f"WITH {SQL_WORLD} " + " UNION ALL ".join(f"SELECT * EXCLUDE view, traits = 'gram + motility' AS morphology_map FROM {sql_map(t, n)}" for t in reports.subsets(SMALL, (2,)) for n in ("global", "order")))
def report_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subset of a panel, globally and within orders."""
    grid, _ = reports.occupancy_grid(joined(spark, sf_dir), SMALL, (None, "order"), sizes=(2,))
    return grid.select(*[c for c in FIGURES if c != "view"], "morphology_map")


@query(f"WITH {SQL_WORLD} " + " UNION ALL ".join(f"SELECT * EXCLUDE (size, traits) FROM {sql_map(SMALL.panel('core'), n, v)}" for v in reports.VIEWS if v != "optimum-only" for n in ("global", "order")))
def report_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's map in every view, globally and within orders."""
    views = [v for v in reports.VIEWS if v != "optimum-only"]
    own = [reports.one_map(SMALL, f"cells_core_{view}_{reports.name_of(null)}", SMALL.panel("core"), view, null) for view in views for null in (None, "order")]
    with maps.occupy(joined(spark, sf_dir), SMALL, own) as made:
        return reports.settled(reports.view_summaries(SMALL, made, ("core",)).select(*FIGURES[2:]))


SIDES = [("global", "'all'"), ("order", "coalesce(ord, '__unassigned__')")]


@query(f"WITH {SQL_WORLD}, l AS (" + " UNION ALL ".join(f"SELECT \"null\", '{f}' AS figure, '{key}' AS panel, {f}::DOUBLE AS v FROM {sql_map(SMALL.panel(key), n)}" for key in ("core", "no_spore") for n, _ in SIDES for f in ("N", "cells", "occupied", "testable_cells")) + ") SELECT \"null\", figure, max(v) FILTER (panel = 'core') AS core, max(v) FILTER (panel = 'no_spore') AS no_spore FROM l GROUP BY 1, 2")
def report_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two panels' figures beside each other."""
    df = joined(spark, sf_dir)
    own = [reports.one_map(SMALL, f"{key}_{n}", SMALL.panel(key), "primary", None if n == "global" else n) for key in ("core", "no_spore") for n, _ in SIDES]
    with maps.occupy(df, SMALL, own) as made:
        sides = {key: made.summaries_of([f"{key}_{n}" for n, _ in SIDES]) for key in ("core", "no_spore")}
        return reports.settled(reports.side_by_side(sides).filter(F.col("figure").isin("N", "cells", "occupied", "testable_cells")))


# A cell that only strata too small to count hold, one that no stratum holds, and one that lineages explain
CELL = {"segment": "BUILDING", "balance": "b1", "parity": "even"}
SQL_CELL = " AND ".join(f"{k} = '{v}'" for k, v in CELL.items())


@query(f"""WITH c AS (SELECT * REPLACE (CASE WHEN {SQL_CELL} THEN 'small' || c_custkey % 8 ELSE taxon END AS taxon) FROM ({SQL_CUSTOMERS})), k AS (SELECT *, count(*) OVER (PARTITION BY taxon) AS size FROM c), used AS (SELECT * FROM k WHERE size >= 40), {SQL_EXPECTED},
h AS (SELECT segment, balance, parity, count(*) AS n, string_agg(size::VARCHAR, ', ' ORDER BY size) AS sizes FROM k WHERE {SQL_CELL} GROUP BY ALL)
SELECT g.cell_id, segment, balance, parity, n AS observed_all_species, 0 AS observed, round(e, 6) AS expected, true AS would_be_flagged, sizes AS stratum_sizes FROM h JOIN ex USING (segment, balance, parity) JOIN ({sql_grid(CUSTOMERS)}) g USING (segment, balance, parity)""")
def report_small_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that only excluded strata hold, with the sizes of these."""
    df = customers(spark, sf_dir).withColumn("taxon", F.when(F.expr(SQL_CELL), F.concat(F.lit("small"), K() % 8)).otherwise(F.col("taxon")))
    cells, _ = occupancy.occupancy(df, CUSTOMERS, "c_custkey", 2000, "taxon", 40)
    return reports.small_strata(df, cells, list(CUSTOMERS), 0.05, "taxon").select("cell_id", *CUSTOMERS, "observed_all_species", "observed", F.round("expected", 6).alias("expected"), "would_be_flagged", "stratum_sizes")


@query("SELECT 'planted' AS control, true AS fires_global, false AS fires_order, true AS passes UNION ALL SELECT 'inside orders', true, true, false")
def report_positive_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap that lineages explain fires globally only; one inside every lineage fires under both."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(N() < 12, "x").otherwise("y").alias("a"), F.when(N() < 12, "u").otherwise("v").alias("b"), pick(K() % 3, "p", "q", "p").alias("c"), pick(K() % 6, "r", "r", "s", "s", "r", "s").alias("d"), F.concat(F.lit("o"), N()).alias("taxon"))
    rows = []
    for name, panel, cell in (("planted", {"a": ["x", "y"], "b": ["u", "v"]}, {"a": "x", "b": "v"}), ("inside orders", {"c": ["p", "q"], "d": ["r", "s"]}, {"c": "q", "d": "s"})):
        cells = {n: occupancy.occupancy(df.filter("not (c = 'q' and d = 's')"), panel, "c_custkey", 2000, t, 5)[0] for n, t in (("global", None), ("order", "taxon"))}
        rows.append(reports.positive_control(cells, {"name": name, "cell": cell}))
    return reports.stacked(rows)


SQL_GAP = f"c AS (SELECT *, 'family' || c_custkey % 4 AS family FROM ({SQL_CUSTOMERS}) WHERE NOT ({SQL_CELL}))"


def with_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).filter(~F.expr(SQL_CELL)).withColumn("family", F.concat(F.lit("family"), K() % 4))


@query(f"SELECT {', '.join(f'{chr(39)}{v}{chr(39)} AS {k}' for k, v in CELL.items())}, true AS survives")
def report_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that stay empty beyond chance under shuffles within nations: the planted one, and no other."""
    cells, _ = occupancy.occupancy(with_gap(spark, sf_dir), CUSTOMERS, "c_custkey", 4000, "taxon", 20)
    return cells.filter("empty_beyond_chance").select(*CELL, F.lit(True).alias("survives"))


@query(f"WITH {SQL_GAP}, s AS (SELECT taxon AS stratum, count(*) AS N, " + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER ({k} = '{v}')), ','), '') AS with_{k}, avg(({k} = '{v}')::INT) AS share_{k}" for k, v in CELL.items()) + " FROM c GROUP BY 1) SELECT stratum, N, " + ", ".join(f"with_{k}" for k in CELL) + ", array_to_string(list_sort(list_intersect(list_intersect(string_split(with_segment, ','), string_split(with_balance, ',')), string_split(with_parity, ','))), ',') AS with_all, round(least(share_segment, share_balance, share_parity), 9) AS rarest_share FROM s")
def family_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which families of each nation carry the levels of a cell."""
    out = occupancy.carriers(with_gap(spark, sf_dir), CELL, "taxon", "family")
    return out.select("stratum", "N", *[F.array_join(f"with_{k}", ",").alias(f"with_{k}") for k in CELL], F.array_join(F.sort_array("with_all"), ",").alias("with_all"), F.round("rarest_share", 9).alias("rarest_share"))


SQL_PAIRS = "sum(CASE WHEN n > 1 THEN n * (n - 1) * (coalesce(ma.c, 0) * (coalesce(ma.c, 0) - 1) / (n * (n - 1))) * (coalesce(mb.c, 0) * (coalesce(mb.c, 0) - 1) / (n * (n - 1))) * (coalesce(mp.c, 0) * (coalesce(mp.c, 0) - 1) / (n * (n - 1))) ELSE 0 END + n * (coalesce(ma.c, 0) / n) * (coalesce(mb.c, 0) / n) * (coalesce(mp.c, 0) / n) - pow(n * (coalesce(ma.c, 0) / n) * (coalesce(mb.c, 0) / n) * (coalesce(mp.c, 0) / n), 2))"


@query(f"""WITH {SQL_STRATA}, {SQL_EXPECTED}, g AS ({sql_grid(CUSTOMERS)}),
v AS (SELECT g.cell_id, {SQL_PAIRS} AS v, sum(n * (coalesce(ma.c, 0) / n) * (coalesce(mb.c, 0) / n) * (coalesce(mp.c, 0) / n)) AS e FROM g CROSS JOIN st LEFT JOIN ma ON ma.taxon = st.taxon AND ma.segment = g.segment LEFT JOIN mb ON mb.taxon = st.taxon AND mb.balance = g.balance LEFT JOIN mp ON mp.taxon = st.taxon AND mp.parity = g.parity GROUP BY 1)
SELECT cell_id, round(e, 6) AS expected, round(v, 6) AS variance, true AS mean_within, true AS variance_within FROM v""")
def null_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of the report's null against the closed form of a shuffle within strata: a cell's mean within five standard
    errors, its variance within a quarter."""
    n_perm = 2000
    kept = occupancy.strata(customers(spark, sf_dir), "taxon", MIN_STRATUM)
    wide = kept.groupBy("stratum").agg(F.count("*").cast("double").alias("n"), *[F.count_if(F.col(t) == v).alias(f"{t}_{v}") for t, own in CUSTOMERS.items() for v in own])
    grid = occupancy.grid(spark, CUSTOMERS)
    level = lambda t: F.coalesce(*[F.when(F.col(t) == v, F.col(f"{t}_{v}")) for v in CUSTOMERS[t]]).cast("double")
    mean = reduce(lambda a, t: a * level(t) / F.col("n"), CUSTOMERS, F.col("n"))
    pairs = reduce(lambda a, t: a * (level(t) * (level(t) - 1)) / (F.col("n") * (F.col("n") - 1)), CUSTOMERS, F.col("n") * (F.col("n") - 1))
    exact = grid.join(wide, how="cross").select("cell_id", mean.alias("e"), (pairs + mean - mean * mean).alias("v")).groupBy("cell_id").agg(F.sum("e").alias("e"), F.sum("v").alias("v"))  # a panel's cells by strata
    drawn = occupancy.permuted_counts(kept, CUSTOMERS, n_perm).groupBy("cell_id").agg((F.sum("n") / n_perm).alias("m"), (F.sum(F.col("n") * F.col("n")) / n_perm).alias("s"))
    both = exact.join(drawn, "cell_id", "left").fillna(0.0, ["m", "s"])
    close = F.abs(F.col("m") - F.col("e")) <= 5 * F.sqrt(F.col("v") / n_perm) + 1e-9
    return both.select("cell_id", F.round("e", 6).alias("expected"), F.round("v", 6).alias("variance"), close.alias("mean_within"), F.abs(F.col("s") - F.col("m") * F.col("m") - F.col("v")).__le__(0.25 * F.col("v") + 1e-9).alias("variance_within"))


@query(f"""WITH c AS ({SQL_CUSTOMERS}), s AS (SELECT taxon, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= {MIN_STRATUM}), a AS (SELECT taxon, segment, count(*) AS x FROM c GROUP BY ALL), b AS (SELECT taxon, balance, count(*) AS y FROM c GROUP BY ALL),
e AS (SELECT taxon, sum(1 - CASE WHEN x + y > n THEN 0 ELSE exp(lgamma(n - x + 1) - lgamma(n - x - y + 1) - lgamma(n + 1) + lgamma(n - y + 1)) END) AS e FROM s JOIN a USING (taxon) JOIN b USING (taxon) GROUP BY 1) SELECT taxon AS grp, round(e, 4) AS expected, true AS mean_within FROM e""")
def group_null_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each nation occupies when permuted alone, against the closed form for two traits."""
    panel = {t: CUSTOMERS[t] for t in ("segment", "balance")}
    df = customers(spark, sf_dir)
    drawn = occupancy.group_null(df, panel, "taxon", 2000, "c_custkey", MIN_STRATUM)
    counts = lambda t, name: df.groupBy(F.col("taxon").alias("grp"), t).agg(F.count("*").alias(name))
    n = df.groupBy(F.col("taxon").alias("grp")).agg(F.count("*").alias("n"))
    # the chance that none of y rows drawn from n is one of x
    none = F.when(F.col("x") + F.col("y") > F.col("n"), 0.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("y") - 1), F.lit(1.0), lambda p, i: p * (F.col("n") - F.col("x") - i) / (F.col("n") - i)))
    exact = n.join(counts("segment", "x"), "grp").join(counts("balance", "y"), "grp").groupBy("grp").agg(F.sum(1 - none).alias("e"))
    return drawn.join(exact, "grp").select("grp", F.round("e", 4).alias("expected"), (F.abs(F.col("null_occupied_mean") - F.col("e")) < 0.2).alias("mean_within"))


@query("WITH c AS (SELECT c_nationkey AS nation, o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), w AS (SELECT nation, coalesce(max(n) FILTER (s = 'F'), 0) AS f, coalesce(max(n) FILTER (s = 'O'), 0) AS o, coalesce(max(n) FILTER (s = 'P'), 0) AS p FROM c GROUP BY 1) SELECT nation, f >= o AND o >= p AS nonincreasing, f > o AND o > p AS strict FROM w")
def trend_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a nation's orders by status fall from one to the next."""
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == K()).groupBy(N().alias("nation")).agg(F.array(*[F.count_if(F.col("o_orderstatus") == s).cast("double") for s in "FOP"]).alias("v"))
    falls, strictly = occupancy.trend(F.col("v"))
    return own.select("nation", falls.alias("nonincreasing"), strictly.alias("strict"))


# Linkage with raw strings that hit, and routes that clash
SQL_ROUTES = """j AS (SELECT c_custkey AS k, c_custkey % 4 AS q, a.s_suppkey IS NOT NULL AS e, coalesce(c_nationkey = a.s_nationkey, false) AS agree, (c_custkey % 8 = 0 AND b.s_suppkey IS NOT NULL) OR (c_custkey % 8 = 3 AND a.s_suppkey IS NOT NULL) AS acc, c_custkey % 8 IN (0, 3) AS lists FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN supplier b ON b.s_suppkey = c_custkey - 1),
r AS (SELECT *, e AND (q IN (0, 3) OR agree) AS hit, q = 0 AND e AS whole, e AND (q = 0 OR q = 1 AND agree) AS token, e AND q < 2 AS unchecked FROM j)"""


def routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .queries import catalogue

    number, null = K().cast("string"), F.lit(None).cast("string")
    gca = lambda k: F.concat(F.lit("GCA_"), F.lpad(k.cast("string"), 9, "0"))
    raw = pick(K() % 4, F.concat(F.lit("DSM "), number, F.lit("; XK "), number), F.concat(F.lit("XK "), number), F.concat(F.lit("XK-"), number), F.concat(F.lit("DSMZ "), number, F.lit("T")))
    strains = table(spark, sf_dir, "customer").select(
        K().alias("bacdive_id"), F.concat(F.lit("Nation"), N()).alias("genus"), F.concat(F.lit("Nation"), N(), F.lit(" x")).alias("species"), null.alias("culture_collection_no_raw"), raw.alias("strain_designation_raw"), null.alias("dsm_number"),
        F.when(K() % 8 == 0, gca(K() - 1)).when(K() % 8 == 3, gca(K())).alias("bacdive_gca"), null.alias("ncbi_tax_ids_raw"),
    )
    return strains, catalogue(spark, sf_dir)


@query(f"WITH {SQL_ROUTES} SELECT k AS bacdive_id, CASE WHEN acc THEN 'accession' WHEN hit THEN 'designation' ELSE 'none' END AS match_method, whole AS baseline_raw_full_hit, token AS baseline_raw_token_hit, unchecked AS baseline_raw_token_hit_unchecked, hit AS designation_route_hit, CASE WHEN acc AND hit THEN k % 8 = 3 END AS designation_agrees_with_accession, CASE WHEN acc AND k % 8 = 0 THEN k - 1 WHEN acc OR hit THEN k END AS genome FROM r")
def linkage_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What raw strings and tokens find by themselves, and whether accession and designation lead to the same genome."""
    rows, _ = linkage.match(*routes(spark, sf_dir), D.Normaliser())
    return rows.select("bacdive_id", "match_method", "baseline_raw_full_hit", "baseline_raw_token_hit", "baseline_raw_token_hit_unchecked", "designation_route_hit", "designation_agrees_with_accession", F.regexp_extract("gtdb_accession", "GCA_0*([0-9]+)", 1).try_cast("long").alias("genome"))


@query(f"""WITH {SQL_ROUTES}, s AS (SELECT unnest(['A. raw whole strings', 'B. + split into tokens, raw', 'C. + normalised keys', 'D. accession route alone', 'E. accession or normalised designation', '(info) raw tokens without the taxon check']) AS step, unnest([whole, whole OR token, whole OR token OR hit, acc, acc OR hit, unchecked]) AS h, lists FROM r)
SELECT step, subset, count(*) FILTER (m) AS n, count(*) FILTER (m AND h) AS k FROM (SELECT step, h, unnest(['all', 'listed']) AS subset, unnest([true, lists]) AS m FROM s) GROUP BY 1, 2""")
def linkage_route_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = linkage.match(*routes(spark, sf_dir), D.Normaliser())
    return linkage.stage_table(rows, {"all": F.lit(True), "listed": F.col("bacdive_lists_assembly")}).select("step", "subset", "n", "k")


@query("SELECT count(*) AS n_genomes, count(*) AS n_genomes_with_strain_ids, count(DISTINCT s_nationkey % 5) AS n_phyla, count(*) AS n_species, 2 * count(*) AS n_designation_keys FROM supplier")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.catalogue_summary(routes(spark, sf_dir)[1], D.Normaliser())


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT c_custkey AS k, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0) ON k = c_custkey")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that refuses keys that come twice."""
    c = table(spark, sf_dir, "customer")
    right = c.filter("c_acctbal > 0").join(table(spark, sf_dir, "nation"), N() == F.col("n_nationkey")).select("c_custkey", "n_name")
    return linkage.one_to_one(c.select("c_custkey", "c_nationkey"), right, "c_custkey")


def answered(url: str, timeout: float) -> dict:
    """A service with a record for each id that isn't a multiple of seven."""
    found = {i: {"square": int(i) ** 2} for i in url.rsplit("/", 1)[1].split(";") if int(i) % 7}
    return {"count": len(found), "results": found or []}


@query("WITH s AS (SELECT unnest(range(1, (SELECT max(s_suppkey) FROM supplier) + 1, 7)) AS start), b AS (SELECT start, unnest(range(start, start + 7)) AS id FROM s) SELECT id AS bacdive_id, id * id AS square, (SELECT count(*) FROM s) AS cached, 0 AS missing, (SELECT max(id) FROM b WHERE id % 7 > 0) AS max_id_found FROM b WHERE id % 7 > 0")
def crawl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches fetched from a service in two goes, cached as files, listed and read again."""
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    text = f'''[paths]\nraw = "{shared_folder(spark).removeprefix("file://")}/crawl/{uuid.uuid4().hex}"\n[bacdive]\nbase_url = "x"\nbatch_size = 7\nstart_id = 1\nmax_id = {last}\nwarn_if_max_found_within = 0\nworkers = 3\ndelay_seconds = 0\ntimeout_seconds = 1\nmax_retries = 1\nbackoff_seconds = 0\n'''
    cfg = Config(text)
    crawl.crawl(spark, cfg, 5, answered)
    s = crawl.crawl(spark, cfg, None, answered)
    read = batches.records(spark, str(cfg.path("raw") / "bacdive"))
    return read.select("bacdive_id", F.get_json_object("record", "$.square").cast("long").alias("square"), F.lit(s["cached"]).alias("cached"), F.lit(s["missing"]).alias("missing"), F.lit(s["max_id_found"]).alias("max_id_found"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'a | \"b\" ' || s_suppkey END AS note, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS nations FROM supplier")
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as Parquet and TSV, and a column as a list, written to the shared folder and read again."""
    place = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit('a | "b" '), "s_suppkey")).alias("note"), "s_nationkey")
    sinks.write_parquet(df, f"{place}/a")
    sinks.write_tsv(tables.parquet(spark, f"{place}/a").drop("s_nationkey"), f"{place}/b")
    sinks.write_list(df, "s_nationkey", f"{place}/c", distinct=True)
    n = spark.read.text(f"{place}/c").agg(F.count("*").alias("nations"))
    return tables.tsv(spark, f"{place}/b").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "note").join(n, how="cross")  # one row


@query("SELECT t.trait, t.binning, t.pos, t.level FROM (VALUES " + ", ".join(f"('{t}', '{b}', {i}, '{v}')" for t in ("gram", "shape", "motility") for b in ("coarse", "fine") for i, v in enumerate({"gram": ["negative", "positive"], "shape": ["rod", "coccus", "other"] if b == "coarse" else ["rod", "coccus", "spiral", "filamentous", "other"], "motility": ["no", "yes"]}[t])) + ") t(trait, binning, pos, level)")
def configured_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a settings file by column, as written to JSON and read again."""
    rows = [(t, b, i, v) for b in ("coarse", "fine") for t, own in zip(SMALL.panel("core"), SMALL.panel_levels(SMALL.panel("core"), b).values(), strict=True) for i, v in enumerate(own)]
    return spark.createDataFrame([tuple(r) for r in json.loads(json.dumps(rows))], "trait string, binning string, pos int, level string")
