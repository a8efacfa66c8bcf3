"""Every operator applied to the star-schema tables, with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_config
from .functions import designations as D
from .functions import values as V
from .operators import coverage, linkage, occupancy, records, selection
from .operators.occupancy import spread
from .sources import batches
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Panels over the tables: parts by type, brand and size; customers by segment, balance and parity, with nations as strata.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BRANDS = [f"Brand#{k}" for k in range(1, 26)]
SIZE_EDGES, SIZES = [10.0, 20.0, 30.0, 40.0, 50.0], [f"s{k}" for k in range(6)]
PARTS = {"p_type": TYPES, "p_brand": BRANDS, "size_bin": SIZES}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BALANCE_EDGES, BALANCES = [0.0, 3000.0, 6000.0], ["b0", "b1", "b2", "b3"]
CUSTOMERS = {"segment": SEGMENTS, "balance": BALANCES, "parity": ["even", "odd"]}
MIN_STRATUM, N_PERM = 55, 20

SQL_PARTS = "SELECT p_partkey, p_type, p_brand, 's' || (p_size // 10) AS size_bin FROM part"
SQL_CUSTOMERS = "SELECT c_custkey, c_nationkey, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'b0' WHEN c_acctbal < 3000 THEN 'b1' WHEN c_acctbal < 6000 THEN 'b2' ELSE 'b3' END AS balance, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 'nation' || c_nationkey AS taxon FROM customer"


def sql_grid(panel: occupancy.Panel) -> str:
    own = list(panel.items())
    steps = occupancy.strides(panel)
    frm = ", ".join(f"(SELECT unnest({names(v)}) AS {t}, unnest(range({len(v)})) AS i{k}) t{k}" for k, (t, v) in enumerate(own))
    return f"SELECT {' + '.join(f'i{k} * {s}' for k, s in enumerate(steps))} AS cell_id, {', '.join(panel)} FROM {frm}"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", V.bin_value(F.col("p_size"), SIZE_EDGES, SIZES).alias("size_bin"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"), V.bin_value(F.col("c_acctbal"), BALANCE_EDGES, BALANCES).alias("balance"),
        F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("parity"), F.concat(F.lit("nation"), "c_nationkey").alias("taxon"),
    )


@query(f"""
WITH p AS ({SQL_PARTS}), g AS ({sql_grid(PARTS)}), n AS (SELECT count(*)::DOUBLE AS n FROM p),
a AS (SELECT p_type, count(*) AS c FROM p GROUP BY 1), b AS (SELECT p_brand, count(*) AS c FROM p GROUP BY 1), s AS (SELECT size_bin, count(*) AS c FROM p GROUP BY 1),
o AS (SELECT p_type, p_brand, size_bin, count(*) AS c FROM p GROUP BY ALL)
SELECT g.cell_id, g.p_type, g.p_brand, g.size_bin, coalesce(o.c, 0) AS observed,
 round(coalesce(n.n * (a.c / n.n) * (b.c / n.n) * (s.c / n.n), 0), 9) AS expected,
 coalesce(n.n * (a.c / n.n) * (b.c / n.n) * (s.c / n.n), 0) >= 3 AS testable
FROM g CROSS JOIN n LEFT JOIN a USING (p_type) LEFT JOIN b USING (p_brand) LEFT JOIN s USING (size_bin) LEFT JOIN o USING (p_type, p_brand, size_bin)""")
def occupancy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of type x brand x size with its count and what independence expects."""
    df = parts(spark, sf_dir)
    own = occupancy.expected(df.withColumn("stratum", F.lit("all")), PARTS)
    out = occupancy.counts(df, PARTS).join(own, "cell_id", "left").fillna(0.0, ["expected"])
    return out.select("cell_id", *PARTS, "observed", F.round("expected", 9).alias("expected"), (F.col("expected") >= 3).alias("testable"))


SQL_STRATA = f"c AS ({SQL_CUSTOMERS}), k AS (SELECT *, count(*) OVER (PARTITION BY taxon) AS size FROM c), used AS (SELECT * FROM k WHERE size >= {MIN_STRATUM})"
SQL_EXPECTED = """lv AS (SELECT taxon, size, segment, balance, parity FROM used), st AS (SELECT taxon, any_value(size)::DOUBLE AS n FROM used GROUP BY 1),
ma AS (SELECT taxon, segment, count(*) AS c FROM lv GROUP BY ALL), mb AS (SELECT taxon, balance, count(*) AS c FROM lv GROUP BY ALL), mp AS (SELECT taxon, parity, count(*) AS c FROM lv GROUP BY ALL),
ex AS (SELECT segment, balance, parity, sum(n * (ma.c / n) * (mb.c / n) * (mp.c / n)) AS e FROM st JOIN ma USING (taxon) JOIN mb USING (taxon) JOIN mp USING (taxon) GROUP BY ALL)"""


@query(f"""
WITH {SQL_STRATA}, {SQL_EXPECTED}, g AS ({sql_grid(CUSTOMERS)}),
oa AS (SELECT segment, balance, parity, count(*) AS c FROM c GROUP BY ALL), o AS (SELECT segment, balance, parity, count(*) AS c FROM used GROUP BY ALL)
SELECT g.cell_id, segment, balance, parity, coalesce(oa.c, 0) AS observed_all, coalesce(o.c, 0) AS observed, round(coalesce(e, 0), 6) AS expected, coalesce(o.c, 0) = 0 AND coalesce(oa.c, 0) > 0 AS emptied
FROM g LEFT JOIN oa USING (segment, balance, parity) LEFT JOIN o USING (segment, balance, parity) LEFT JOIN ex USING (segment, balance, parity)""")
def occupancy_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with nations as strata, small ones left out, and the counts over all rows beside."""
    df = customers(spark, sf_dir)
    kept = occupancy.strata(df, "taxon", MIN_STRATUM)
    both = occupancy.counts(df, CUSTOMERS, "observed_all").join(occupancy.counts(kept, CUSTOMERS).select("cell_id", "observed"), "cell_id").join(occupancy.expected(kept, CUSTOMERS), "cell_id", "left").fillna(0.0, ["expected"])
    return both.select("cell_id", *CUSTOMERS, "observed_all", "observed", F.round("expected", 6).alias("expected"), ((F.col("observed") == 0) & (F.col("observed_all") > 0)).alias("emptied"))


@query("WITH c AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) > 0), m AS (SELECT unnest([2, 55, 65]) AS min_size) SELECT min_size, count(*) FILTER (n >= min_size) AS strata_used, count(*) FILTER (n < min_size) AS strata_excluded, coalesce(sum(n) FILTER (n >= min_size), 0)::BIGINT AS N_used, coalesce(sum(n) FILTER (n < min_size), 0)::BIGINT AS species_excluded FROM c, m GROUP BY 1")
def strata_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customers(spark, sf_dir)
    out = [occupancy.strata_summary(df, "taxon", m).withColumn("min_size", F.lit(m)) for m in (2, 55, 65)]
    return out[0].unionByName(out[1]).unionByName(out[2])


FLAG_FINE, FLAG_COARSE = {"a": "accepted", "r": "returned"}, {"accepted": "final", "returned": "final"}


@query("""
WITH o AS (SELECT o_orderkey, count(l_orderkey) AS n_obs, list_sort(list_distinct(list(CASE lower(l_returnflag) WHEN 'a' THEN 'accepted' WHEN 'r' THEN 'returned' END))) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
d AS (SELECT *, list_filter(f, lambda x: x IS NOT NULL) AS v FROM o)
SELECT o_orderkey, n_obs, CASE WHEN len(v) = 1 THEN v[1] END AS fine, CASE WHEN len(v) >= 1 THEN 'final' END AS coarse, coalesce(len(v), 0) > 1 AS fine_conflict, false AS coarse_conflict FROM d""")
def trait_conflict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of an order's lines as observations of a trait: one value, none, or a conflict, at both levels of detail."""
    settings = {"fine_map": FLAG_FINE, "coarse_map": FLAG_COARSE, "unmapped": "null"}
    obs = F.struct(F.col("l_linenumber").cast("string").alias("ref"), F.col("l_returnflag").alias("value"))
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(obs).alias("obs"))
    df = table(spark, sf_dir, "orders").select("o_orderkey").join(own, "o_orderkey", "left").withColumn("obs", F.coalesce("obs", F.array().cast("array<struct<ref:string,value:string>>")))
    df = df.withColumn("parts", records.categorical_parts(F.col("obs"), settings))
    made = records.categorical("flag", F.col("obs"), F.col("parts"), settings)
    return df.select("o_orderkey", *(made[k].alias(v) for k, v in {"flag_n_obs": "n_obs", "flag_fine": "fine", "flag": "coarse", "flag_fine_conflict": "fine_conflict", "flag_conflict": "coarse_conflict"}.items()))


NUMERIC = {"fine_edges": [15.0, 30.0, 45.0], "fine_levels": ["low", "mid", "high", "top"], "coarse_map": {"low": "low", "mid": "rest", "high": "rest", "top": "rest"}}


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested records: each line a test of growth at a range of its quantity."""
    kind = F.element_at(F.array(F.lit("optimum"), F.lit("growth"), F.lit("growth"), F.lit("maximum")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    line = F.struct(F.col("l_linenumber").cast("string").alias("@ref"), kind.alias("type"), F.when(F.col("l_linenumber") % 4 == 0, None).when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("growth"), F.concat(F.col("l_quantity").cast("int"), F.lit("-"), (F.col("l_quantity") + 5).cast("int"), F.lit(" °C")).alias("temperature"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bacdive_id")).agg(F.sort_array(F.collect_list(line)).alias("t"))
    section = F.when(F.size("t") == 1, F.to_json(F.get("t", F.lit(0)))).otherwise(F.to_json("t"))
    return lines.select("bacdive_id", F.concat(F.lit('{"Culture and growth conditions": {"culture temp": '), section, F.lit("}}")).alias("record"))


SQL_MEASURED = """m AS (SELECT l_orderkey AS id, ['optimum','growth','growth','maximum'][l_linenumber % 4 + 1] AS type, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'neg' ELSE 'pos' END AS res, trunc(l_quantity) AS lo, trunc(l_quantity + 5) AS hi FROM lineitem),
a AS (SELECT id, count(*) AS n_obs, list((lo + hi) / 2) FILTER (type = 'optimum' AND (res IS NULL OR res = 'pos')) AS opt, min(lo) FILTER (type <> 'optimum' AND res = 'pos') AS gmin, max(hi) FILTER (type <> 'optimum' AND res = 'pos') AS gmax, list({'lo': lo, 'hi': hi}) FILTER (type <> 'optimum' AND res = 'neg') AS neg FROM m GROUP BY 1),
b AS (SELECT *, (gmin + gmax) / 2 AS mid, coalesce(len(list_filter(neg, lambda x: x.lo <= gmax AND x.hi >= gmin)), 0) > 0 AS hit FROM a)"""


@query(f"""
WITH {SQL_MEASURED}, c AS (SELECT *, list_distinct(list_transform(opt, lambda x: CASE WHEN x < 15 THEN 'low' WHEN x < 30 THEN 'mid' WHEN x < 45 THEN 'high' ELSE 'top' END)) AS bins FROM b),
d AS (SELECT *, list_distinct(list_transform(bins, lambda x: CASE x WHEN 'low' THEN 'low' ELSE 'rest' END)) AS cbins, CASE WHEN mid < 15 THEN 'low' WHEN mid < 30 THEN 'mid' WHEN mid < 45 THEN 'high' WHEN mid IS NOT NULL THEN 'top' END AS gbin FROM c)
SELECT id AS order_id, n_obs, round(list_avg(opt), 6) AS opt, gmin AS growth_min, gmax AS growth_max, CASE WHEN opt IS NOT NULL THEN 'optimum' WHEN gmin IS NULL THEN 'none' WHEN gmin <> gmax THEN 'growth_range' ELSE 'growth_single_point' END AS bin_source,
 CASE WHEN opt IS NOT NULL THEN CASE WHEN len(bins) = 1 THEN bins[1] END WHEN NOT hit THEN gbin END AS fine,
 CASE WHEN opt IS NOT NULL THEN CASE WHEN len(cbins) = 1 THEN cbins[1] END WHEN NOT hit THEN CASE gbin WHEN 'low' THEN 'low' ELSE CASE WHEN gbin IS NOT NULL THEN 'rest' END END END AS coarse,
 CASE WHEN opt IS NOT NULL THEN len(bins) > 1 ELSE gmin IS NOT NULL AND hit END AS fine_conflict FROM d""")
def trait_numeric_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units out of nested records, binned from optima, else from growth, with contradictions found."""
    df = measured(spark, sf_dir).withColumn("obs", records.numeric_observations(F.col("record"), *records.NUMERIC["temperature"])).withColumn("parts", records.numeric_parts(F.col("obs"), NUMERIC))
    made = records.numeric("t", F.col("obs"), F.col("parts"), NUMERIC)
    return df.select(F.col("bacdive_id").alias("order_id"), made["t_n_obs"].alias("n_obs"), F.round(made["t_opt"], 6).alias("opt"), made["t_growth_min"].alias("growth_min"), made["t_growth_max"].alias("growth_max"), made["t_bin_source"].alias("bin_source"), made["t_fine"].alias("fine"), made["t"].alias("coarse"), made["t_fine_conflict"].alias("fine_conflict"))


@query(f"WITH {SQL_MEASURED} SELECT count(*) AS orders, count(*) FILTER (hit) AS contradicted, count(*) FILTER (hit AND opt IS NULL) AS deciding FROM b WHERE gmin IS NOT NULL")
def interval_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measured(spark, sf_dir).withColumn("obs", records.numeric_observations(F.col("record"), *records.NUMERIC["temperature"]))
    own = df.select(records.numeric_parts(F.col("obs")).alias("p"))
    grown, hit = F.size("p.positive") > 0, F.coalesce(records.contradicted(F.col("p")), F.lit(False))
    return own.agg(F.count_if(grown).alias("orders"), F.count_if(grown & hit).alias("contradicted"), F.count_if(grown & hit & (F.size("p.optima") == 0)).alias("deciding"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section that is an object, a list with things that aren't objects, or a scalar."""
    section = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit(", 7, "), "props", F.lit(', "x"]'))).otherwise(F.lit("5"))
    df = table(spark, sf_dir, "events").withColumn("found", records.entries(F.concat(F.lit('{"a b": {"c": '), section, F.lit("}}")), "a b", "c"))
    return df.select("event_id", F.size("found").alias("n"), records.field(F.get("found", F.lit(0)), "k").alias("k"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def unmapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = V.mapping({"click": "c", "view": "v"})[F.lower("event_type")]
    return table(spark, sf_dir, "events").filter(seen.isNull()).groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")


SQL_TOKENS = "SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'DSMZ ' || lpad(c_custkey::VARCHAR, 6, '0') || 'T' WHEN 1 THEN 'strain ATCC-00' || c_custkey WHEN 2 THEN 'bs ' || c_custkey || 'x' WHEN 3 THEN ' none ' WHEN 4 THEN 'NCIB ' || c_custkey || ' (T)' WHEN 5 THEN 'JCM' ELSE c_name END AS token FROM customer"
SQL_PARSED = r"""f AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(upper(token)), '^(TYPE\s+STRAIN|STRAIN|STR\.?|ISOLATE|TYPE)\s+', '')), '\s*[\(\[]\s*(TYPE\s*STRAIN|TYPE|T)\s*[\)\]]\s*$', '')), '\^\s*T$', '')) AS s FROM t),
l AS (SELECT *, regexp_extract(s, '^([A-Z]{2,8})[\s\-_.:]*[A-Z0-9]', 1) AS lead FROM f), c AS (SELECT *, CASE lead WHEN 'DSMZ' THEN 'DSM' WHEN 'NCIB' THEN 'NCIMB' ELSE lead END AS code FROM l),
k AS (SELECT *, lead <> '' AND code IN (%s) AS known, regexp_replace(regexp_replace(substr(s, length(lead) + 1), '^([\s\-_.:]*[0-9][\w.\-]*?)\s*T$', '\1'), '[^A-Z0-9]', '', 'g') AS rest, regexp_replace(s, '[^A-Z0-9]', '', 'g') AS bare FROM c),
r AS (SELECT *, CASE WHEN regexp_matches(rest, '^[0-9]+$') THEN regexp_replace(rest, '^0+([0-9])', '\1') ELSE rest END AS num FROM k),
parsed AS (SELECT *, CASE WHEN known THEN code || num ELSE bare END AS canonical, CASE WHEN known AND regexp_matches(num, '[0-9]') THEN 'collection' WHEN known THEN 'unusable' WHEN length(bare) >= 3 AND bare NOT IN (%s) AND regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[A-Z]') THEN 'bare' ELSE 'unusable' END AS kind FROM r)""" % (", ".join(f"'{x}'" for x in D.COLLECTIONS), ", ".join(f"'{x}'" for x in D.PLACEHOLDERS))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("c_custkey") % 7, F.col("c_custkey")
    text = F.when(k == 0, F.concat(F.lit("DSMZ "), F.lpad(key.cast("string"), 6, "0"), F.lit("T"))).when(k == 1, F.concat(F.lit("strain ATCC-00"), key)).when(k == 2, F.concat(F.lit("bs "), key, F.lit("x"))).when(k == 3, " none ").when(k == 4, F.concat(F.lit("NCIB "), key, F.lit(" (T)"))).when(k == 5, "JCM").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), text.alias("token"))


@query(f"WITH t AS ({SQL_TOKENS}), {SQL_PARSED} SELECT id, token, canonical, kind, CASE WHEN known THEN code END AS collection FROM parsed")
def designation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many spellings of a designation, one key."""
    return D.Normaliser().parse_tokens(tokens(spark, sf_dir)).select("id", "token", "canonical", "kind", "collection")


@query(r"WITH t AS (SELECT c_custkey AS id, trim(x) AS token, i FROM (SELECT c_custkey, unnest(string_split_regex(c_name || ' ; DSM ' || c_custkey || '/' || 'dsmz ' || c_custkey || ', |=none', '[,;/|=]')) AS x, generate_subscripts(string_split_regex(c_name || ' ; DSM ' || c_custkey || '/' || 'dsmz ' || c_custkey || ', |=none', '[,;/|=]'), 1) AS i FROM customer) WHERE trim(x) <> ''), " + SQL_PARSED + ", u AS (SELECT id, canonical, min(i) AS i FROM parsed WHERE kind <> 'unusable' GROUP BY ALL) SELECT id, string_agg(canonical, ';' ORDER BY i) AS keys FROM u GROUP BY 1")
def designation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of several designations, split; their keys without repeats, in order."""
    text = F.concat("c_name", F.lit(" ; DSM "), "c_custkey", F.lit("/"), F.lit("dsmz "), "c_custkey", F.lit(", |=none"))
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("raw"))
    return D.canonical_keys(df, "raw", ["id"]).select("id", F.array_join("keys", ";").alias("keys"))


@query("SELECT doc_id, md5(upper(strip_accents(replace(text, 'ß', 'ss')))) AS folded FROM documents")
def unicode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fold(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "folded").select("doc_id", F.md5(F.col("folded").cast("binary")).alias("folded"))


def strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records to link: numbers of a collection, bare numbers, listed accessions."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("bacdive_id"), F.concat(F.lit("Nation"), "c_nationkey").alias("genus"), F.concat(F.lit("Nation"), "c_nationkey", F.lit(" x")).alias("species"), F.when(key % 3 == 0, F.concat(F.lit("DSMZ "), key, F.lit("T; "), F.lit("none"))).alias("culture_collection_no_raw"),
        F.when(key % 3 != 2, F.concat(F.lit("XK-"), key)).alias("strain_designation_raw"), F.when(key % 11 == 0, key.cast("string")).alias("dsm_number"), F.when(key % 4 == 0, F.concat(F.lit("GCA_"), F.lpad(key.cast("string"), 9, "0"), F.lit("|GCA_999999999"))).alias("bacdive_gca"), F.lit(None).cast("string").alias("ncbi_tax_ids_raw"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as genomes."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    raw = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("GB_GCA_"), F.lpad(key.cast("string"), 9, "0"), F.lit(".1")).alias("accession"), F.concat(F.lit("GCA_"), F.lpad(key.cast("string"), 9, "0"), F.lit(".1")).alias("ncbi_genbank_assembly_accession"), F.concat(F.lit("DSM "), key, F.lit("; XK "), key).alias("ncbi_strain_identifiers"),
        F.concat(F.lit("d__D;p__P"), nation % 5, F.lit(";c__C;o__O;f__F;g__Nation"), nation, F.lit("_A;s__S"), key).alias("gtdb_taxonomy"), F.when(key % 2 == 0, "t").otherwise("f").alias("gtdb_representative"), F.lit("type strain of species").alias("gtdb_type_designation_ncbi_taxa"), F.lit("none").alias("ncbi_type_material_designation"), F.lit("Contig").alias("ncbi_assembly_level"), F.concat(F.lit("Nation"), nation, F.lit(" x")).alias("ncbi_organism_name"),
        F.lit(99.0).alias("checkm2_completeness"), F.lit(1.0).alias("checkm2_contamination"), F.lit(1).cast("long").alias("genome_size"), key.alias("ncbi_taxid"), key.alias("ncbi_species_taxid"),
    )
    return linkage.prepare_catalogue(raw, {"Complete Genome": 4, "Chromosome": 3, "Scaffold": 2, "Contig": 1})


SQL_LINK = """j AS (SELECT c_custkey AS id, s_suppkey AS s, c_nationkey = s_nationkey AS agree, c_custkey % 3 = 0 OR c_custkey % 11 = 0 AS coll_key, c_custkey % 3 <> 2 AS bare_key, c_custkey % 4 = 0 AS lists FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
k AS (SELECT *, s IS NOT NULL AND coll_key AS coll, s IS NOT NULL AND bare_key AND agree AS bare, s IS NOT NULL AND bare_key AND NOT agree AS rejected, s IS NOT NULL AND lists AS acc, coll_key::INT + bare_key::INT AS n_keys FROM j)"""


@query(f"""WITH {SQL_LINK} SELECT id AS bacdive_id, CASE WHEN acc THEN 'accession' WHEN coll OR bare THEN 'designation' ELSE 'none' END AS match_method, CASE WHEN acc THEN NULL WHEN coll THEN 'DSM' || id WHEN bare THEN 'XK' || id END AS match_key,
CASE WHEN acc THEN 'accession' WHEN coll THEN 'collection' WHEN bare THEN 'bare' END AS match_token_kind, (acc OR coll OR bare)::BIGINT AS n_gtdb_candidates, (acc OR coll OR bare) AND agree AS taxon_agree, lists AS bacdive_lists_assembly, acc AS bacdive_assembly_in_gtdb, n_keys::BIGINT AS n_designation_keys,
coll OR bare AS designation_route_hit, rejected AND NOT bare AS designation_bare_hit_rejected, CASE WHEN acc AND (coll OR bare) THEN true END AS designation_agrees_with_accession, CASE WHEN acc OR coll OR bare THEN 'GB_GCA_' || lpad(id::VARCHAR, 9, '0') || '.1' END AS gtdb_accession, acc OR coll OR bare AS genome_matched FROM k""")
def linkage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accession first, then designations; bare ones only where the taxon agrees; the best candidate of each record."""
    rows, _ = linkage.match(strains(spark, sf_dir), catalogue(spark, sf_dir), D.Normaliser())
    return rows.select("bacdive_id", "match_method", "match_key", "match_token_kind", F.col("n_gtdb_candidates").cast("long").alias("n_gtdb_candidates"), "taxon_agree", "bacdive_lists_assembly", "bacdive_assembly_in_gtdb", "n_designation_keys", "designation_route_hit", "designation_bare_hit_rejected", "designation_agrees_with_accession", "gtdb_accession", "genome_matched")


@query(f"""WITH {SQL_LINK} SELECT id AS bacdive_id, CASE WHEN lists THEN 'bacdive_assembly_not_in_gtdb' ELSE 'no_bacdive_assembly' END || ';' || CASE WHEN n_keys = 0 THEN 'no_usable_designation' WHEN rejected THEN 'bare_designation_taxon_mismatch' ELSE 'designations_not_in_gtdb' END AS reason,
concat_ws(';', CASE WHEN id % 3 = 0 THEN 'DSM' || id END, CASE WHEN id % 3 <> 2 THEN 'XK' || id END, CASE WHEN id % 11 = 0 AND id % 3 <> 0 THEN 'DSM' || id END) AS keys_tried FROM k WHERE NOT (acc OR coll OR bare)""")
def linkage_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match(strains(spark, sf_dir), catalogue(spark, sf_dir), D.Normaliser())[1].select("bacdive_id", "reason", "keys_tried")


@query(f"""WITH {SQL_LINK}, st AS (SELECT *, false AS a, false AS b FROM k),
s AS (SELECT unnest(['A. raw whole strings', 'B. + split into tokens, raw', 'C. + normalised keys', 'D. accession route alone', 'E. accession or normalised designation', '(info) raw tokens without the taxon check']) AS step, unnest([a, b, b OR coll OR bare, acc, acc OR coll OR bare, false]) AS hit, lists FROM st)
SELECT step, subset, count(*) FILTER (m) AS n, count(*) FILTER (m AND hit) AS k, round(100.0 * count(*) FILTER (m AND hit) / count(*) FILTER (m), 6) AS pct FROM (SELECT step, hit, unnest(['all', 'listed']) AS subset, unnest([true, lists]) AS m FROM s) GROUP BY 1, 2""")
def linkage_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = linkage.match(strains(spark, sf_dir), catalogue(spark, sf_dir), D.Normaliser())
    return linkage.stage_table(rows, {"all": F.lit(True), "listed": F.col("bacdive_lists_assembly")}).withColumn("pct", F.round("pct", 6))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 2 <> 0, 'GB_GCA_' || lpad(s_suppkey::VARCHAR, 9, '0')) - 1 AS pref_order FROM supplier")
def catalogue_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linkage.pref_order(catalogue(spark, sf_dir))
    return out.select(F.col("ncbi_taxid").alias("s_suppkey"), "pref_order")


@query("SELECT n_nationkey, r_name AS domain, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS phylum, lower(regexp_replace(n_name || '_AB', '_[A-Z]{1,3}$', '')) AS genus, CASE WHEN n_nationkey % 2 = 0 THEN 'nation' ELSE lower(n_name) END AS organism FROM nation JOIN region ON r_regionkey = n_regionkey")
def taxonomy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks out of a lineage, a genus without its suffix, and the genus of an organism's name."""
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    lineage = F.concat(F.lit("d__"), "r_name", F.lit(";p__"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).otherwise(" "), F.lit(";c__;x"))
    ranks = V.rank_names(lineage)
    organism = F.when(F.col("n_nationkey") % 2 == 0, F.lit("Candidatus 'Nation' x")).otherwise(F.concat(F.lit("["), "n_name", F.lit("] sp. 1")))
    return df.select("n_nationkey", ranks["domain"].alias("domain"), ranks["phylum"].alias("phylum"), V.plain_genus(F.concat("n_name", F.lit("_AB"))).alias("genus"), V.organism_genus(organism).alias("organism"))


@query("SELECT c_custkey, taxon FROM (SELECT c_custkey, CASE WHEN c_nationkey % 6 > 0 THEN 'n' || c_nationkey END AS taxon, row_number() OVER (PARTITION BY coalesce(CASE WHEN c_nationkey % 6 > 0 THEN 'n' || c_nationkey END, 'acc:' || c_custkey) ORDER BY c_mktsegment = 'BUILDING' DESC, (c_acctbal * 100)::BIGINT, c_custkey) AS rn FROM customer) WHERE rn = 1")
def dereplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer a nation by preference; those without one stand for themselves."""
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("bacdive_id"), F.when(F.col("c_nationkey") % 6 > 0, F.concat(F.lit("n"), "c_nationkey")).alias("gtdb_species"), F.col("c_custkey").cast("string").alias("gtdb_accession"),
        F.when(F.col("c_mktsegment") == "BUILDING", True).alias("type_strain_bacdive"), F.lit(False).alias("gtdb_is_type_strain_of_species"), F.round(F.col("c_acctbal") * 100).cast("long").alias("pref_order"),
    )
    return selection.dereplicate(df).select(F.col("bacdive_id").alias("c_custkey"), F.col("gtdb_species").alias("taxon"))


FUNNEL = {"1. all": "true", "2. large": "o_totalprice > 100000", "3. urgent": "o_orderpriority = '1-URGENT'", "4. large and urgent": "o_totalprice > 100000 AND o_orderpriority = '1-URGENT'"}


@query("WITH s AS (SELECT o_orderstatus = 'F' AS g, o_custkey, " + f"unnest({names(list(FUNNEL))}) AS stage, unnest([{', '.join(FUNNEL.values())}]) AS m FROM orders) SELECT stage, count(*) FILTER (m) AS n_rows, round(100.0 * count(*) FILTER (m) / (SELECT count(*) FROM orders), 6) AS pct_of_all, count(*) FILTER (m AND g) AS n_matched, round(100.0 * count(*) FILTER (m AND g) / count(*) FILTER (m), 6) AS pct_matched, count(DISTINCT o_custkey) FILTER (m AND g) AS n_distinct FROM s GROUP BY 1")
def attrition_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.funnel(table(spark, sf_dir, "orders"), {k: F.expr(v) for k, v in FUNNEL.items()}, F.col("o_orderstatus") == "F", "o_custkey")
    return out.withColumns({c: F.round(c, 6) for c in ("pct_of_all", "pct_matched")})


FLAGS = {"discounted": "l_discount > 0.04", "taxed": "l_tax > 0.03", "large": "l_quantity > 40", "returned": "l_returnflag = 'R'"}


@query("WITH " + f"f AS (SELECT {', '.join(f'({v})::INT AS {k}' for k, v in FLAGS.items())} FROM lineitem), n AS (SELECT count(*)::DOUBLE AS n FROM f), " + "p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS fa, '{b}' AS fb, sum({a} * {b})::BIGINT AS ab, sum({a}) AS x, sum({b}) AS y FROM f" for a in FLAGS for b in FLAGS) + ") SELECT fa AS \"row\", fb AS \"col\", ab AS \"both\", round(ab / x, 9) AS conditional, CASE WHEN fa <> fb THEN round(n * ab / (x::DOUBLE * y), 9) END AS lift FROM p, n")
def co_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.co_coverage(table(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in FLAGS.items()})
    return out.withColumns({c: F.round(c, 9) for c in ("conditional", "lift")})


@query("WITH " + f"f AS (SELECT {', '.join(f'({v})::INT AS {k}' for k, v in FLAGS.items())} FROM lineitem), " + "a AS (SELECT 'two' AS panel, 2 AS traits, sum(discounted * taxed)::BIGINT AS o, avg(discounted * taxed) AS x, avg(discounted) * avg(taxed) AS p, count(*) AS n FROM f UNION ALL SELECT 'four', 4, sum(discounted * taxed * large * returned)::BIGINT, avg(discounted * taxed * large * returned), avg(discounted) * avg(taxed) * avg(large) * avg(returned), count(*) FROM f) SELECT panel, traits, o AS observed_complete, round(x, 9) AS observed_frac, round(p, 9) AS product_of_marginals, round(p * n, 4) AS expected_complete, round(x / p, 6) AS ratio FROM a")
def independence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.expr(v) for v in FLAGS.values()]
    out = coverage.independence(table(spark, sf_dir, "lineitem"), {"two": flags[:2], "four": flags})
    return out.withColumns({"observed_frac": F.round("observed_frac", 9), "product_of_marginals": F.round("product_of_marginals", 9), "expected_complete": F.round("expected_complete", 4), "ratio": F.round("ratio", 6)})


SQL_NUMBER = " + ".join(f"({v})::INT" for v in FLAGS.values())


@query(f"WITH l AS (SELECT {SQL_NUMBER} AS k, l_linestatus = 'F' AS y FROM lineitem), a AS (SELECT k, count(*) AS N, avg(y::INT) AS share FROM l GROUP BY 1) SELECT r.k, coalesce(N, 0) AS N, round(share, 9) AS share FROM (SELECT unnest(range(7)) AS k) r LEFT JOIN a USING (k)")
def availability_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = sum((F.expr(v).cast("int") for v in FLAGS.values()), F.lit(0))
    return coverage.rate_by_number(table(spark, sf_dir, "lineitem"), number, 6, F.col("l_linestatus") == "F").withColumn("share", F.round("share", 9))


@query(" UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER ({v}) AS N, round(avg((l_linestatus = 'F')::INT) FILTER ({v}), 9) AS share_with, round(avg((l_linestatus = 'F')::INT) FILTER (NOT ({v})), 9) AS share_without FROM lineitem" for k, v in FLAGS.items()))
def availability_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.with_without(table(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in FLAGS.items()}, F.col("l_linestatus") == "F")
    return out.withColumns({c: F.round(c, 9) for c in ("share_with", "share_without")})


@query("""WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels),
x AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS i FROM t),
p AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(c + d - (a + c - i) + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1))) AS p FROM x)
SELECT a, b, c, d, round(any_value(a * d / (b * c)), 6) AS odds_ratio, round(least(1, sum(p) FILTER (p <= (SELECT p * 1.0000001 FROM p WHERE i = a))), 6) AS p_value FROM p GROUP BY a, b, c, d""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.fisher_of(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.withColumns({c: F.round(c, 6) for c in ("odds_ratio", "p_value")})


@query(f"WITH {SQL_STRATA} SELECT taxon AS stratum, count(*) AS N, round(avg((segment = 'BUILDING')::INT), 9) AS share_segment, round(avg((balance = 'b1')::INT), 9) AS share_balance, round(count(*) * avg((segment = 'BUILDING')::INT) * avg((balance = 'b1')::INT), 6) AS expected_in_cell FROM used GROUP BY 1 HAVING avg((segment = 'BUILDING')::INT) * avg((balance = 'b1')::INT) > 0")
def stratum_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = occupancy.contributions(customers(spark, sf_dir), {"segment": "BUILDING", "balance": "b1"}, "taxon", MIN_STRATUM)
    return out.withColumns({"share_segment": F.round("share_segment", 9), "share_balance": F.round("share_balance", 9), "expected_in_cell": F.round("expected_in_cell", 6)})


@query(f"""WITH p AS ({SQL_PARTS}), a AS (SELECT p_brand AS grp, p_type, size_bin, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT grp, sum(n)::BIGINT AS N, count(*) AS cells FROM a GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY N DESC, grp) AS place FROM s),
f AS (SELECT p_type, size_bin, min(place) AS place, count(*) AS owners FROM a JOIN o USING (grp) GROUP BY ALL), l AS (SELECT a.grp, count(*) AS n FROM a JOIN f USING (p_type, size_bin) WHERE owners = 1 GROUP BY 1)
SELECT o.grp, o.N, cells AS cells_occupied, coalesce(l.n, 0) AS cells_only_here, (SELECT count(*) FROM f WHERE f.place <= o.place) AS cumulative_occupied, round((SELECT count(*) FROM f WHERE f.place <= o.place) / (SELECT count(*) FROM f), 9) AS cumulative_share FROM o LEFT JOIN l USING (grp)""")
def group_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = occupancy.group_occupancy(parts(spark, sf_dir), {"p_type": TYPES, "size_bin": SIZES}, "p_brand")
    return out.withColumn("cumulative_share", F.round("cumulative_share", 9))


@query("""WITH p AS (SELECT p_partkey, p_brand, round((p_retailprice - 899) / 102, 3) AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, rank() OVER (PARTITION BY p_brand ORDER BY p) + count(*) OVER (PARTITION BY p_brand, p) - 1 AS rk FROM p)
SELECT p_partkey, p, round(least(1, min(p * n / rk) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round((F.col("p_retailprice") - 899) / 102, 3).alias("p"))
    return occupancy.bh_qvalues(df, "p", ("p_brand",)).select("p_partkey", "p", F.round("q", 9).alias("q"))


def sql_null(strata: str) -> str:
    steps = dict(zip(CUSTOMERS, occupancy.strides(CUSTOMERS), strict=True))
    code = lambda t: f"(list_position({names(CUSTOMERS[t])}, {t}) - 1) * {steps[t]}"
    return f"""lo AS (SELECT {strata} AS stratum, c_custkey AS id, unnest([0, 1, 2]) AS k, unnest([{', '.join(code(t) for t in CUSTOMERS)}]) AS part FROM used),
pl AS (SELECT stratum, perm, part, row_number() OVER (PARTITION BY stratum, perm, k ORDER BY md5('0|' || perm || '|' || k || '|' || id), id) AS place FROM lo, (SELECT unnest(range({N_PERM})) AS perm)),
nu AS (SELECT perm, cell_id, count(*) AS n FROM (SELECT stratum, perm, place, sum(part)::BIGINT AS cell_id FROM pl GROUP BY ALL) GROUP BY ALL)"""


SQL_CELLS = f"""g AS ({sql_grid(CUSTOMERS)}), oa AS (SELECT segment, balance, parity, count(*) AS c FROM c GROUP BY ALL), o AS (SELECT segment, balance, parity, count(*) AS c FROM used GROUP BY ALL),
ba AS (SELECT g.cell_id, segment, balance, parity, coalesce(o.c, 0) AS observed, coalesce(oa.c, 0) AS observed_all_species, coalesce(e, 0) AS expected FROM g LEFT JOIN o USING (segment, balance, parity) LEFT JOIN oa USING (segment, balance, parity) LEFT JOIN ex USING (segment, balance, parity)),
dn AS (SELECT ba.*, perm, coalesce(n, 0) AS n FROM ba CROSS JOIN (SELECT unnest(range({N_PERM})) AS perm) LEFT JOIN nu USING (perm, cell_id)),
st1 AS (SELECT cell_id, segment, balance, parity, observed, observed_all_species, expected, avg(n) AS null_mean, avg((n = 0)::INT) AS p_empty_under_null, (1 + sum((n <= observed)::INT)) / {N_PERM + 1} AS p_low, (1 + sum((n >= observed)::INT)) / {N_PERM + 1} AS p_high, expected >= 3 AS testable FROM dn GROUP BY ALL),
qq AS (SELECT cell_id, least(1, min(p_low * m / rk) OVER (ORDER BY p_low RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_low FROM (SELECT cell_id, p_low, count(*) OVER () AS m, rank() OVER (ORDER BY p_low) + count(*) OVER (PARTITION BY p_low) - 1 AS rk FROM st1 WHERE testable)),
ct AS (SELECT st1.*, q_low, coalesce(testable AND q_low < 0.5 AND observed < expected, false) AS emptier_than_chance FROM st1 LEFT JOIN qq USING (cell_id))"""


def null_cells(spark: SparkSession, sf_dir: str, taxon: str | None = "taxon", seed: str = "0") -> tuple[DataFrame, DataFrame]:
    df = customers(spark, sf_dir)
    null = occupancy.permuted(occupancy.strata(df, taxon, MIN_STRATUM), CUSTOMERS, N_PERM, "c_custkey", seed)
    return occupancy.cell_table(df, CUSTOMERS, null, N_PERM, taxon, MIN_STRATUM, alpha=0.5), null


@query(f"WITH {SQL_STRATA}, {SQL_EXPECTED}, {sql_null('taxon')}, {SQL_CELLS} SELECT cell_id, segment, balance, parity, observed, observed_all_species, observed = 0 AND observed_all_species > 0 AS emptied_by_exclusion, round(expected, 6) AS expected, round(null_mean, 6) AS null_mean, round(p_empty_under_null, 6) AS p_empty_under_null, round(p_low, 9) AS p_low, round(q_low, 9) AS q_low, round(p_high, 9) AS p_high, testable, emptier_than_chance, emptier_than_chance AND observed_all_species = 0 AS empty_beyond_chance FROM ct")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell table under a null that permutes within nations, by md5 order."""
    cells, _ = null_cells(spark, sf_dir)
    return cells.withColumns({c: F.round(c, 6) for c in ("expected", "null_mean", "p_empty_under_null")} | {c: F.round(c, 9) for c in ("p_low", "q_low", "p_high")})


@query(f"WITH c AS ({SQL_CUSTOMERS}), used AS (SELECT *, count(*) OVER () AS size FROM c), {SQL_EXPECTED.replace('taxon', 'one').replace('FROM used', '''FROM (SELECT *, 'all' AS one FROM used)''')}, {sql_null(chr(39) + 'all' + chr(39))}, {SQL_CELLS} SELECT cell_id, observed, round(expected, 6) AS expected, round(null_mean, 6) AS null_mean, round(p_low, 9) AS p_low, round(q_low, 9) AS q_low FROM ct")
def permutation_null_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = null_cells(spark, sf_dir, None)
    return cells.select("cell_id", "observed", F.round("expected", 6).alias("expected"), F.round("null_mean", 6).alias("null_mean"), F.round("p_low", 9).alias("p_low"), F.round("q_low", 9).alias("q_low"))


@query(f"""WITH {SQL_STRATA}, {SQL_EXPECTED}, {sql_null('taxon')}, {SQL_CELLS}, oc AS (SELECT perm, count(*) AS occ FROM nu GROUP BY 1), ow AS (SELECT sum(observed)::BIGINT AS N, count(*) AS cells, count(*) FILTER (observed > 0) AS occupied, count(*) FILTER (testable) AS testable_cells, count(*) FILTER (emptier_than_chance) AS flagged_cells FROM ct)
SELECT N, cells, occupied, testable_cells, flagged_cells, round(avg(occ), 6) AS null_occupied_mean, round(quantile_cont(occ, 0.025), 6) AS null_occupied_lo, round(quantile_cont(occ, 0.975), 6) AS null_occupied_hi, round((1 + count(*) FILTER (occ <= occupied)) / {N_PERM + 1}, 9) AS p_fewer_occupied_than_null FROM oc, ow GROUP BY ALL""")
def null_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, null = null_cells(spark, sf_dir)
    out = occupancy.summary(cells, null, N_PERM)
    return out.select("N", "cells", "occupied", "testable_cells", "flagged_cells", *(F.round(c, 6).alias(c) for c in ("null_occupied_mean", "null_occupied_lo", "null_occupied_hi")), F.round("p_fewer_occupied_than_null", 9).alias("p_fewer_occupied_than_null"))


@query(f"""WITH {SQL_STRATA}, {SQL_EXPECTED}, {sql_null('taxon')}, {SQL_CELLS}, w AS (SELECT expected, (1 + {N_PERM} * p_empty_under_null) / {N_PERM + 1} AS p0, count(*) FILTER (testable) OVER () AS m FROM ct),
v AS (SELECT *, coalesce(p0 <= 5.0 / nullif(m, 0) AND expected >= 3, false) AS ok FROM w), u AS (SELECT *, bool_and(ok) OVER (ORDER BY expected RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM v),
z AS (SELECT *, min(expected) FILTER (up) OVER () AS emp, CASE WHEN m > 0 THEN ln(m / 5.0) END AS poi FROM u), y AS (SELECT *, greatest(3, coalesce(poi, 3), coalesce(emp, 3)) AS mde FROM z)
SELECT any_value(m) AS testable_cells, round(any_value(poi), 6) AS guaranteed_poisson, round(any_value(emp), 6) AS guaranteed_empirical, round(any_value(mde), 6) AS minimum_detectable, count(*) FILTER (expected >= mde) AS cells_above, round(sum(CASE WHEN expected >= mde THEN expected ELSE 0 END) / sum(expected), 6) AS expected_share_above, count(*) FILTER (ok) AS cells_detected_alone FROM y""")
def power_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large a gap would have been found; alpha is large here, as twenty permutations can't show more."""
    out = occupancy.detectable(null_cells(spark, sf_dir)[0], N_PERM, alpha=5.0)
    return out.select("testable_cells", *(F.round(c, 6).alias(c) for c in ("guaranteed_poisson", "guaranteed_empirical", "minimum_detectable")), "cells_above", F.round("expected_share_above", 6).alias("expected_share_above"), "cells_detected_alone")


@query(f"""SELECT s.cell_id, s.observed_all_species AS observed_all, CASE WHEN s.empty_beyond_chance THEN 'SURVIVES nation-level shuffle (both seeds)'
WHEN g.expected >= 3 AND g.q_low < 0.5 AND g.observed < g.expected AND g.observed = 0 THEN 'phylogenetic structure — fires under global only; ' || CASE WHEN s.emptied_by_exclusion THEN 'occupants only in excluded small nations' WHEN NOT s.testable THEN 'untestable at nation level' ELSE 'tested at nation level, not significant' END
WHEN s.observed_all_species = 0 AND (s.testable OR g.expected >= 3) THEN 'empty, testable, not significant under any null' WHEN s.observed_all_species = 0 THEN 'empty, untestable under every null' ELSE '' END AS category
FROM ({SQL['permutation_null']}) s JOIN ({SQL['permutation_null_global']}) g ON s.cell_id = g.cell_id""")
def null_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"global": null_cells(spark, sf_dir, None)[0], "nation": null_cells(spark, sf_dir)[0]}
    out = occupancy.merge_nulls(tables, CUSTOMERS, "nation", {"nation": null_cells(spark, sf_dir, seed="777777")[0]})
    return out.select("cell_id", "observed_all", "category")


@query("SELECT l_returnflag AS row, " + ", ".join(f"max(CASE WHEN l_linestatus = '{c}' THEN n END) AS \"{c}\"" for c in ("F", "O")) + " FROM (SELECT l_returnflag, l_linestatus, count(*)::VARCHAR AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
    return occupancy.crosstab(occupancy.counts(table(spark, sf_dir, "lineitem"), panel), ["l_returnflag"], ["l_linestatus"], panel, F.col("observed").cast("string"))


SUBSETS = [["p_type"], ["p_brand"], ["size_bin"], ["p_type", "p_brand"], ["p_type", "size_bin"], ["p_brand", "size_bin"], ["p_type", "p_brand", "size_bin"]]


def sql_capacity(own: list[str]) -> str:
    product = " * ".join(["n.n"] + [f"(coalesce(m{k}.c, 0) / n.n)" for k in range(len(own))])
    joins = " ".join(f"LEFT JOIN (SELECT {t}, count(*) AS c FROM p GROUP BY 1) m{k} USING ({t})" for k, t in enumerate(own))
    return f"SELECT {len(own)} AS size, '{' + '.join(own)}' AS traits, any_value(n.n)::BIGINT AS N, count(*) AS cells, min({product}) AS lo, quantile_cont({product}, 0.5) AS med, max({product}) AS hi, avg(({product} >= 3)::INT) AS frac FROM ({sql_grid({t: PARTS[t] for t in own})}) g CROSS JOIN n {joins}"


@query(f"WITH p AS ({SQL_PARTS}), n AS (SELECT count(*)::DOUBLE AS n FROM p), a AS ({' UNION ALL '.join(sql_capacity(s) for s in SUBSETS)}) SELECT size, traits, N, cells, round(lo, 6) AS expected_min, round(med, 6) AS expected_median, round(hi, 6) AS expected_max, round(frac, 6) AS testable_cell_frac FROM a")
def capacity_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parts(spark, sf_dir)
    out = occupancy.capacity({" + ".join(s): (df, {t: PARTS[t] for t in s}) for s in SUBSETS})
    return out.select("size", "traits", "N", "cells", *(F.round(c, 6).alias(c) for c in ("expected_min", "expected_median", "expected_max", "testable_cell_frac")))


@query(f"WITH p AS ({SQL_PARTS}), n AS (SELECT count(*)::DOUBLE AS n FROM p), a AS ({' UNION ALL '.join(sql_capacity(s) for s in SUBSETS)}) SELECT size, count(*) AS maps, min(cells) AS cells_min, max(cells) AS cells_max, min(N) AS N_min, max(N) AS N_max, round(quantile_cont(med, 0.5), 6) AS expected_median_median, round(min(lo), 6) AS expected_min FROM a GROUP BY 1")
def capacity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parts(spark, sf_dir)
    out = occupancy.capacity_summary(occupancy.capacity({" + ".join(s): (df, {t: PARTS[t] for t in s}) for s in SUBSETS}))
    return out.select("size", "maps", "cells_min", "cells_max", "N_min", "N_max", F.round("expected_median_median", 6).alias("expected_median_median"), F.round("expected_min", 6).alias("expected_min"))


@query("""WITH b AS (SELECT o_custkey AS start, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(range(0, (SELECT max(start) FROM b) + 1)) AS start), f AS (SELECT start, coalesce(n, 0) > 5 AS filled FROM s LEFT JOIN b USING (start)),
i AS (SELECT *, row_number() OVER (ORDER BY start) - row_number() OVER (PARTITION BY filled ORDER BY start) AS island FROM f) SELECT min(start) AS first_id, max(start) AS last_id, count(*) AS batches FROM i WHERE NOT filled GROUP BY island""")
def sweep_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of batches with (nearly) nothing in them, as ranges of ids."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("start")).agg(F.count("*").alias("n"))
    most = own.agg(F.max("start")).first()[0]
    found = batches.all_starts(spark, 0, most, 1).join(own, "start", "left").select("start", F.when(F.col("n") > 5, F.col("n")).otherwise(0).alias("n"))
    return batches.empty_ranges(found, 1, 1)


@query("WITH p AS (SELECT unnest([1, 2]) AS copy), t AS (SELECT concat(" + ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END", "o_orderpriority")) + ") AS r FROM orders, p WHERE copy = 1 OR o_orderkey % 5 = 0) SELECT count(*) AS n_rows, 4 AS n_columns, sum(('0x' || substr(md5(r), 1, 15))::BIGINT)::VARCHAR AS content FROM t")
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sinks import fingerprint

    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return fingerprint(df.union(df.filter("o_orderkey % 5 = 0")))  # rows that come twice count twice


@query("SELECT user_id, count(*) AS n, min(ts) AS first_ts, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT c_custkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is what is asked for."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")


@query("SELECT 'customers without orders' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'nations of both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'nations of either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    a, b = c.select("c_nationkey"), s.select("s_nationkey")
    one = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return one("customers without orders", c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")).unionByName(one("nations of both", a.intersect(b))).unionByName(one("nations of either", a.union(b).distinct()))


@query("SELECT coalesce(a.n_nationkey, b.n_nationkey) AS nation, coalesce(x, 0) AS customers, coalesce(y, 0) AS suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS x FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS y FROM supplier GROUP BY 1) b ON a.n_nationkey = b.n_nationkey")
def counts_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer").fillna(0)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream, each id once."""
    return ingest.drain(ingest.events(spark, f"{sf_dir}/events.parquet"))


def full_map(spark: SparkSession, sf_dir: str, taxon: str | None = "taxon", offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells, summary) at the settings' number of permutations and alpha, by the report's own draws. The queries by md5 above have
    N_PERM, as many as SQL can follow, and can't tell a gap from noise; these can."""
    a = load_config()["analysis"]
    return occupancy.occupancy(customers(spark, sf_dir), CUSTOMERS, "c_custkey", a["n_perm_full"], taxon, MIN_STRATUM, a["min_expected_for_test"], a["fdr_alpha"], a["seed"] + offset)


@query()
def permutation_null_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_map(spark, sf_dir)[0]


@query()
def permutation_null_global_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_map(spark, sf_dir, None)[0].select("cell_id", "observed", "expected", "null_mean", "p_low", "q_low", "emptier_than_chance", "empty_beyond_chance")


@query()
def null_interval_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_map(spark, sf_dir)[1]


@query()
def power_threshold_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load_config()["analysis"]
    return occupancy.detectable(full_map(spark, sf_dir)[0], a["n_perm_full"], a["fdr_alpha"], a["min_expected_for_test"])


@query()
def null_categories_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from the nulls of two seeds each."""
    runs = [{"global": full_map(spark, sf_dir, None, offset)[0], "nation": full_map(spark, sf_dir, offset=offset + 1)[0]} for offset in (0, 777_777)]
    return occupancy.merge_nulls(runs[0], CUSTOMERS, "nation", runs[1]).select("cell_id", "observed_all", "category")


from . import queries_maps, queries_stages  # noqa: E402, F401 - add the queries of the maps and of the stages
