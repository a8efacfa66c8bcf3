"""Linking records to a catalogue of genomes: by listed accession, else by designation, with a check of the taxon.

No index and no loop: both sides are exploded to keys and joined on them; each record's candidates are then reduced by one
aggregation. Placeholder words, the keys that would be hot, are no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.book import Book
from ..functions.designations import Normaliser

# Columns that a catalogue must have, and those a match takes from it.
REQUIRED = ("accession", "ncbi_genbank_assembly_accession", "ncbi_strain_identifiers", "gtdb_taxonomy", "gtdb_representative", "gtdb_type_designation_ncbi_taxa", "ncbi_type_material_designation", "ncbi_assembly_level", "ncbi_organism_name", "checkm2_completeness", "checkm2_contamination", "genome_size", "ncbi_taxid", "ncbi_species_taxid")
TAKEN = ("accession", "assembly_genbank", "assembly_refseq", "gtdb_phylum", "gtdb_class", "gtdb_order", "gtdb_family", "gtdb_genus", "gtdb_species", "gtdb_is_representative", "gtdb_type_designation_ncbi_taxa", "ncbi_type_material_designation", "gtdb_is_type_strain_of_species", "ncbi_assembly_level", "checkm2_completeness", "checkm2_contamination", "genome_size", "pref_order", "ncbi_organism_name")
SOURCES = ("culture_collection_no_raw", "strain_designation_raw")


def prepare_catalogue(raw: DataFrame, level_rank: dict[str, int]) -> DataFrame:
    """raw with ranks, accessions, genera, and `preference`: an order that compares as the wanted order of genomes, smaller
    first, with no global sort behind it."""
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise KeyError(f"the catalogue lacks columns {missing}")
    g = raw.select(*REQUIRED)
    prefix, acc = F.substring("accession", 1, 3), F.col("ncbi_genbank_assembly_accession")
    tail = F.expr("substring(accession, 4)")
    names = V.rank_names(F.col("gtdb_taxonomy"))
    g = g.withColumns({"gtdb_prefix": prefix, "assembly_genbank": F.coalesce(F.when(acc.startswith("GC"), acc), F.when(prefix == "GB_", tail)), "assembly_refseq": F.when(prefix == "RS_", tail)} | {f"gtdb_{r}": c for r, c in names.items()})
    g = g.withColumns({
        "gca_base": V.accession_base(F.col("assembly_genbank")), "genus_gtdb": V.plain_genus(F.col("gtdb_genus")), "genus_ncbi": V.organism_genus(F.col("ncbi_organism_name")),
        "gtdb_is_representative": V.is_true(F.col("gtdb_representative")), "gtdb_is_type_strain_of_species": F.coalesce(F.col("gtdb_type_designation_ncbi_taxa") == "type strain of species", F.lit(False)),
        **{c: F.col(c).try_cast("double") for c in ("checkm2_completeness", "checkm2_contamination", "genome_size")}, **{c: F.col(c).try_cast("double").try_cast("long") for c in ("ncbi_taxid", "ncbi_species_taxid")},
        "assembly_level_rank": F.coalesce(V.mapping({k: str(v) for k, v in level_rank.items()})[F.col("ncbi_assembly_level")].cast("int"), F.lit(0)),
    })
    better = F.struct((~F.col("gtdb_is_representative")).alias("a"), (F.col("gtdb_prefix") != "RS_").alias("b"), (-F.col("assembly_level_rank")).alias("c"), (-V.quality(F.col("checkm2_completeness"), F.col("checkm2_contamination"))).alias("d"), F.col("accession").alias("e"))
    return g.withColumn("preference", better)


def pref_order(catalogue: DataFrame) -> DataFrame:
    """The catalogue with pref_order, its place from 0 in the order of preference: range partitions are sorted apart and
    numbered from the sizes of those before, so that no task sorts all."""
    ranged = catalogue.repartitionByRange("preference").sortWithinPartitions("preference").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    ranged = ranged.persist()
    sizes = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}  # a row a partition
    before, total = [], 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    start = F.coalesce(V.mapping({str(k): str(n) for k, n in before})[F.col("_part").cast("string")].cast("long"), F.lit(0)) if before else F.lit(0)
    return ranged.withColumn("pref_order", start + F.col("_at")).drop("_part", "_at")


def via(genus: Column, ids: Column) -> Column:
    """How record and genome agree on the taxon: genus, ncbi_taxid, or null."""
    low = F.lower(genus)
    by_genus = F.coalesce((low == F.col("genus_gtdb")) | (low == F.col("genus_ncbi")), F.lit(False)) & F.coalesce(genus != "", F.lit(False))
    by_id = F.coalesce(F.array_contains(ids, F.col("ncbi_taxid")), F.lit(False)) | F.coalesce(F.array_contains(ids, F.col("ncbi_species_taxid")), F.lit(False))
    return F.when(by_genus, "genus").when(by_id, "ncbi_taxid")


def accepted(kind: Column, agrees: Column, need_taxon: bool) -> Column:
    """By the record's side of a designation: a collection's number needs no more, a bare one needs the taxon."""
    return (kind == "collection") | ((kind == "bare") & (agrees.isNotNull() | F.lit(not need_taxon)))


KEY = "bacdive_id"
#: What the catalogue's side of a key carries through the join, so that nothing has to be looked up after it.
LIGHT = ("accession", "gca_base", "genus_gtdb", "genus_ncbi", "ncbi_taxid", "ncbi_species_taxid", "gtdb_species", "preference")


def designation_hits(own: DataFrame, theirs: DataFrame, need_taxon: bool) -> DataFrame:
    """A row a pair of record and genome that share a designation: how they agree on the taxon, whether a collection's number
    or a bare one is accepted, the first accepted key, and how many keys were rejected. own: the records' keys with genus
    and _ids; theirs: the genomes' with LIGHT."""
    hits = own.join(theirs, "canonical").withColumn("via", via(F.col("genus"), F.col("_ids")))
    hits = hits.withColumn("ok", accepted(F.col("kind"), F.col("via"), need_taxon))
    collection, place = F.col("kind") == "collection", F.struct((F.col("kind") != "collection").alias("k"), F.struct("source", "pos").alias("p"))
    return hits.groupBy(KEY, "accession").agg(
        *[F.first(c).alias(c) for c in ("gtdb_species", "preference", "via", "genus_gtdb", "genus_ncbi")],
        F.max(collection).alias("coll"),
        F.max(F.col("ok") & (F.col("kind") == "bare")).alias("bare"),
        F.min_by(F.when(F.col("ok"), F.col("canonical")), F.when(F.col("ok"), place)).alias("match_key"),
        F.sum((~F.col("ok")).cast("long")).alias("rejected"),
    )


def accession_hits(s: DataFrame, genomes: DataFrame) -> DataFrame:
    """The same by listed accessions."""
    listed = s.select(KEY, "genus", "_ids", F.explode(F.array_distinct(F.split("bacdive_gca", r"\|"))).alias("gca_base"))
    found = listed.join(genomes, "gca_base").withColumn("via", via(F.col("genus"), F.col("_ids"))).dropDuplicates([KEY, "accession"])
    none = {"coll": F.lit(False), "bare": F.lit(False), "match_key": F.lit(None).cast("string"), "rejected": F.lit(0).cast("long")}
    return found.select(KEY, "accession", "gtdb_species", "preference", "via", "genus_gtdb", "genus_ncbi", *(c.alias(k) for k, c in none.items()))


def best_of(by_accession: DataFrame, by_name: DataFrame) -> DataFrame:
    """A row a record: its best genome (accessions first, then agreement on the taxon, then the catalogue's preference), and
    how many genomes and which species each route found."""
    every = by_accession.withColumn("route", F.lit(0)).unionByName(by_name.filter("coll or bare").withColumn("route", F.lit(1)))
    order = F.struct(F.col("route"), F.col("via").isNull().alias("no_taxon"), F.col("preference"))
    on = lambda route, c: F.when(F.col("route") == route, F.col(c))
    return every.groupBy(KEY).agg(
        F.min_by(F.struct("accession", "route", "via", "match_key", "coll", "genus_gtdb", "genus_ncbi"), order).alias("b"),
        F.count_if(F.col("route") == 0).alias("n0"), F.count_if(F.col("route") == 1).alias("n1"), F.max("coll").alias("coll"), F.max("bare").alias("bare"),
        F.collect_set(on(0, "gtdb_species")).alias("s0"), F.collect_set(on(1, "gtdb_species")).alias("s1"), F.collect_set(on(1, "accession")).alias("a1"),
    )


def match(strains: DataFrame, catalogue: DataFrame, normaliser: Normaliser, need_taxon: bool = True, book: Book | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row a record with its match, the log of records without). With a book, only tokens that it lacks are parsed, and it
    learns them. strains: bacdive_id, genus, species, the two raw
    designations, dsm_number, bacdive_gca and ncbi_tax_ids_raw; the catalogue comes from `prepare_catalogue`. What both
    results need more than once is cached; whoever writes them clears the cache."""
    s = strains.select(KEY, "genus", "species", *SOURCES, "dsm_number", "bacdive_gca", "ncbi_tax_ids_raw").withColumn("_ids", V.tax_ids(F.col("ncbi_tax_ids_raw"))).persist()
    genomes = catalogue.select(*LIGHT)
    named = catalogue.filter(F.col("ncbi_strain_identifiers").isNotNull() & (F.trim("ncbi_strain_identifiers") != ""))

    # designations, first writing of each key; a trailing DSM number comes last. Every distinct token of either side is parsed once.
    dsm = F.when(F.coalesce(F.col("dsm_number"), F.lit("")) != "", F.concat(F.lit("DSM "), F.col("dsm_number")))
    ours, ids = [F.col(SOURCES[0]), F.col(SOURCES[1]), dsm], [F.col("ncbi_strain_identifiers")]
    tokens = normaliser.tokens(s, [], ours).select("token").union(normaliser.tokens(named, [], ids).select("token"))
    if book is None:
        parsed = normaliser.dictionary(tokens).persist()
    else:
        book.learn(tokens)
        parsed = book.rows(s.sparkSession).drop("version")
    own = normaliser.parse(s, [KEY, "genus", "_ids"], ours, parsed).filter("kind <> 'unusable'").persist()
    theirs = normaliser.parse(named, list(LIGHT), ids, parsed).filter("kind <> 'unusable'").select("canonical", *LIGHT)
    by_name = designation_hits(own, theirs, need_taxon)
    rejected = by_name.groupBy(KEY).agg(F.sum("rejected").alias("rejected"))
    keys = own.groupBy(KEY).agg(F.count("*").alias("n_keys"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "pos", "canonical"))), lambda x: x["canonical"]), ";").alias("keys_tried"))
    m = s
    for part in (best_of(accession_hits(s, genomes), by_name), rejected, keys, baselines(s, named, normaliser, need_taxon, parsed)):
        m = m.join(part, KEY, "left")
    return described(m, catalogue), unmatched(m)


def described(m: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A row a record: how it was matched, by which routes and baselines, and its genome's columns."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    n0, n1, lists = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0)), F.col("bacdive_gca").isNotNull()
    low = F.lower("genus")
    made = {
        "match_method": F.when(n0 > 0, "accession").when(n1 > 0, "designation").otherwise("none"),
        "match_key": F.when((n0 == 0) & (n1 > 0), F.col("b.match_key")),
        "match_token_kind": F.when(n0 > 0, "accession").when(n1 > 0, F.when(F.col("b.coll"), "collection").otherwise("bare")),
        "n_gtdb_candidates": F.when(n0 > 0, n0).otherwise(n1),
        "match_ambiguous_species": F.coalesce(F.size(F.when(n0 > 0, F.col("s0")).otherwise(F.col("s1"))) > 1, F.lit(False)),
        "genus_agree": F.coalesce((low == F.col("b.genus_gtdb")) | (low == F.col("b.genus_ncbi")), F.lit(False)),
        "taxon_agree": F.col("b.via").isNotNull(),
        "taxon_agree_via": F.col("b.via"),
        "bacdive_lists_assembly": lists,
        "bacdive_assembly_in_gtdb": n0 > 0,
        "n_designation_keys": F.coalesce("n_keys", F.lit(0)),
        "designation_route_hit": n1 > 0,
        "designation_collection_hit": no("coll"),
        "designation_bare_hit": no("bare"),
        "designation_bare_hit_rejected": F.coalesce(F.col("rejected") > 0, F.lit(False)) & ~no("bare"),
        "designation_agrees_with_accession": F.when((n0 > 0) & (n1 > 0), F.array_contains("a1", F.col("b.accession")) | F.coalesce(F.arrays_overlap("s0", "s1"), F.lit(False))),
        "baseline_raw_full_hit": no("raw_full"),
        "baseline_raw_token_hit": no("raw_token"),
        "baseline_raw_token_hit_unchecked": no("raw_any"),
        "_chosen": F.col("b.accession"),
    }
    rows = m.select(KEY, *(c.alias(k) for k, c in made.items()))
    taken = catalogue.select(*[F.col(c).alias("gtdb_accession" if c == "accession" else c) for c in TAKEN if c in catalogue.columns])
    out = rows.join(taken, rows["_chosen"] == taken["gtdb_accession"], "left").drop("_chosen")
    return out.withColumns({"genome_matched": F.col("gtdb_accession").isNotNull(), "ncbi_assembly_accession": F.coalesce("assembly_refseq", "assembly_genbank"), "gtdb_is_representative": no("gtdb_is_representative"), "gtdb_is_type_strain_of_species": no("gtdb_is_type_strain_of_species")})


def unmatched(m: DataFrame) -> DataFrame:
    """The log of records without a genome, with the keys that were tried and the reason."""
    by_accession = F.when(F.col("bacdive_gca").isNotNull(), "bacdive_assembly_not_in_gtdb").otherwise("no_bacdive_assembly")
    by_name = F.when(F.col("n_keys").isNull(), "no_usable_designation").when(F.col("rejected") > 0, "bare_designation_taxon_mismatch").otherwise("designations_not_in_gtdb")
    return m.filter(F.col("b").isNull()).select(KEY, "species", "genus", *SOURCES, "dsm_number", "bacdive_gca", F.coalesce("keys_tried", F.lit("")).alias("keys_tried"), F.concat(by_accession, F.lit(";"), by_name).alias("reason"))


def one_to_one(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """left with right's columns by key; refuses a key that either side has twice."""
    for name, side in (("left", left), ("right", right)):
        twice = side.groupBy(key).count().filter("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"{key} is not unique on the {name}: {[r[0] for r in twice]}")
    return left.join(right, key, "left")


def catalogue_summary(catalogue: DataFrame, normaliser: Normaliser) -> DataFrame:
    """One row: genomes, those with designations, their distinct keys, phyla and species."""
    keys = normaliser.parse(catalogue, ["accession"], [F.col("ncbi_strain_identifiers")]).filter("kind <> 'unusable'").agg(F.countDistinct("canonical").alias("n_designation_keys"))
    own = catalogue.agg(F.count("*").alias("n_genomes"), F.count("ncbi_strain_identifiers").alias("n_genomes_with_strain_ids"), F.countDistinct("gtdb_phylum").alias("n_phyla"), F.countDistinct("gtdb_species").alias("n_species"))
    return own.join(keys, how="cross")  # one row and one row


def baselines(s: DataFrame, named: DataFrame, normaliser: Normaliser, need_taxon: bool, parsed: DataFrame) -> DataFrame:
    """What raw strings alone would find: whole strings, tokens, and tokens without the check. A whole string is judged by the
    best kind among its tokens, a token by its own."""
    strings = s.select(KEY, "genus", "_ids", F.explode(F.array(*SOURCES)).alias("text")).filter(F.trim("text") != "").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    tokens = normaliser.parse_tokens(strings.withColumn("token", F.explode(normaliser.raw_tokens(F.col("text")))), parsed=parsed)
    # a token that folds to nothing has no kind of its own
    tokens = tokens.withColumn("kind", F.when(F.col("canonical") == "", "unusable").otherwise(F.col("kind")))
    rank = F.max(F.when(F.col("kind") == "collection", 2).when(F.col("kind") == "bare", 1).otherwise(0))
    whole = tokens.groupBy(KEY, "text").agg(rank.alias("r"), F.first("genus").alias("genus"), F.first("_ids").alias("_ids")).withColumn("kind", F.when(F.col("r") == 2, "collection").when(F.col("r") == 1, "bare").otherwise("unusable"))
    text = F.regexp_replace("ncbi_strain_identifiers", r"^\s+|\s+$", "")
    ok, no = accepted(F.col("kind"), via(F.col("genus"), F.col("_ids")), need_taxon), F.lit(False)
    full = whole.join(named.select(*LIGHT, text.alias("text")), "text").select(KEY, ok.alias("raw_full"), no.alias("raw_token"), no.alias("raw_any"))
    split = tokens.join(named.select(*LIGHT, F.explode(normaliser.raw_tokens(F.col("ncbi_strain_identifiers"))).alias("token")), "token").select(KEY, no.alias("raw_full"), ok.alias("raw_token"), F.lit(True).alias("raw_any"))
    return full.unionByName(split).groupBy(KEY).agg(*[F.max(c).alias(c) for c in ("raw_full", "raw_token", "raw_any")])


def stage_table(df: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Records with a genome at each step of the matching, by subset; refuses a table whose last step isn't its matches."""
    from .coverage import mask_counts

    a = F.col("baseline_raw_full_hit")
    b = a | F.col("baseline_raw_token_hit")
    c, d = b | F.col("designation_route_hit"), F.col("bacdive_assembly_in_gtdb")
    e = d | F.col("designation_route_hit")
    if not df.filter(e != F.col("genome_matched")).isEmpty():
        raise AssertionError("the last step does not reproduce genome_matched")
    steps = {"A. raw whole strings": a, "B. + split into tokens, raw": b, "C. + normalised keys": c, "D. accession route alone": d, "E. accession or normalised designation": e, "(info) raw tokens without the taxon check": F.col("baseline_raw_token_hit_unchecked")}
    return mask_counts(df, steps, subsets)
