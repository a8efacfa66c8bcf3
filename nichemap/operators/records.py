"""Typed rows from nested JSON records whose sections may be missing, an object, or a list of objects.

A record is JSON text; it is parsed once, into the texts of its sections, each of these once into an array of its objects, and
every trait is an expression on such an array. No step needs more than its own row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import values as V

# Where the record holds what.
CATEGORICAL = {
    "gram": (("Morphology", "cell morphology"), "gram stain"),
    "shape": (("Morphology", "cell morphology"), "cell shape"),
    "motility": (("Morphology", "cell morphology"), "motility"),
    "spore": (("Physiology and metabolism", "spore formation"), "spore formation"),
    "oxygen": (("Physiology and metabolism", "oxygen tolerance"), "oxygen tolerance"),
}
NUMERIC = {
    "temperature": (("Culture and growth conditions", "culture temp"), "temperature"),
    "ph": (("Culture and growth conditions", "culture pH"), "pH"),
}
HALOPHILY = ("Physiology and metabolism", "halophily")
GENOMES = ("Sequence information", "Genome sequences")
PREDICTIONS = "Genome-based predictions"
NAMES = "Name and taxonomic classification"
CULTURE_NUMBERS = ("Literature", "culture collection no.")
NAMED = ("species", "genus", "full scientific name", "phylum", "strain designation", "type strain")

#: All that is read of a record, but for its predictions.
PATHS = list(dict.fromkeys([p for p, _ in CATEGORICAL.values()] + [p for p, _ in NUMERIC.values()] + [HALOPHILY, GENOMES, CULTURE_NUMBERS, *((NAMES, k) for k in NAMED), (NAMES, "LPSN", "phylum"), ("General", "DSM-Number"), ("General", "doi"), ("General", "NCBI tax id")]))


UNREAD = "_unread"  # a field of sections, set where a record can't be read to its end


def json_path(*path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def at(record: Column, *path: str) -> Column:
    return F.get_json_object(record, json_path(*path))


def entries(record: Column, *path: str) -> Column:
    """The objects of the section, as JSON texts: those of a list, a lone one, or none. Anything else in a list is dropped."""
    return objects(at(record, *path))


def objects(section: Column) -> Column:
    """The same of the section's text, which is worked out once."""

    def listed(found: Column) -> Column:
        every = F.when(found.startswith("["), F.from_json(found, "array<string>")).when(found.startswith("{"), F.array(found))
        return F.coalesce(F.filter(every, lambda x: x.startswith("{")), F.array().cast("array<string>"))

    return V.let(section, listed)


def nested(paths: list[tuple[str, ...]], leaf: Callable[[tuple[str, ...]], Any], node: Callable[[str, dict], Any], above: tuple[str, ...] = ()) -> dict[str, Any]:
    """What leaf makes of each path, put together by node wherever paths share their beginning."""
    out = {}
    for name in dict.fromkeys(p[0] for p in paths):
        below = [p[1:] for p in paths if p[0] == name and len(p) > 1]
        out[name] = node(name, nested(below, leaf, node, (*above, name))) if below else leaf((*above, name))
    return out


def sections(record: Column) -> Column:
    """The texts at PATHS as a struct of structs, out of one reading of the record: strings without quotes, everything else as
    JSON without white space, as `at` gives them. To be a column of its own. A text that can't be read to its end is read
    path by path, for what comes before its fault."""
    fields = lambda own: T.StructType([T.StructField(k, t) for k, t in own.items()])
    schema = fields(nested(PATHS, lambda _: T.StringType(), lambda _, own: fields(own)))
    struct = lambda own: F.struct(*[c.alias(k) for k, c in own.items()])
    apart = struct(nested(PATHS, lambda p: at(record, *p), lambda _, own: struct(own)))
    schema, apart = schema.add(UNREAD, T.StringType()), apart.withField(UNREAD, F.lit(None).cast("string"))
    return V.let(F.from_json(record, schema, {"columnNameOfCorruptRecord": UNREAD}), lambda own: F.when(own.isNotNull() & own[UNREAD].isNull(), own).otherwise(apart))


def text(path: tuple[str, ...]) -> Column:
    """The text at one of PATHS, of a row with a column of sections."""
    return reduce(lambda c, k: c.getField(k), path, F.col("sections"))


def read(path: tuple[str, ...]) -> Column:
    """The column that holds a section's objects, as structs of the fields that are read of them."""
    return F.col(f"`read {path[-1]}`")


def field(entry: Column, key: str) -> Column:
    return V.clean(F.get_json_object(entry, json_path(key)))


def parsed(section: Column, *keys: str) -> Column:
    """The objects of the section's text, each as a struct of the named fields. A list of objects alone is read at once; one
    that may hold anything else is read into its elements' texts first, as it would be no list of objects at all."""
    one = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    mixed = lambda found: ~found.startswith("[{") | found.rlike(r"\},[^{]")  # the first element is no object, or what follows one; other texts may match too

    def listed(found: Column) -> Column:
        each = F.transform(objects(found), lambda e: F.from_json(e, one))
        every = F.when(found.startswith("{"), F.array(F.from_json(found, one))).when(~found.startswith("["), None).when(mixed(found), each).otherwise(F.from_json(found, T.ArrayType(one)))
        return F.coalesce(every, F.array().cast(T.ArrayType(one)))

    return V.let(section, listed)


def observations(entries: Column, key: str) -> Column:
    """array of (ref, value) with a value, of a section's objects."""
    rows = F.transform(entries, lambda o: F.struct(o["@ref"].alias("ref"), V.clean(o[key]).alias("value")))
    return F.filter(rows, lambda o: o["value"].isNotNull())


def numeric_observations(record: Column, path: tuple[str, ...], key: str) -> Column:
    """array of (ref, type, result, value, span); span is the parsed interval."""
    return measured(parsed(at(record, *path), *_measures(key)), key)


def _measures(key: str) -> tuple[str, ...]:
    return "@ref", "type", "growth", "ability", key


def measured(entries: Column, key: str) -> Column:
    """The same of a section's objects."""

    def observed(o: Column) -> Column:
        return F.struct(o["@ref"].alias("ref"), F.lower(V.clean(o["type"])).alias("type"), V.test_result(o["growth"], o["ability"]).alias("result"), V.clean(o[key]).alias("value"), V.parse_interval(o[key]).alias("span"))

    return F.transform(entries, observed)


def fine_value(value: Column, settings: dict) -> Column:
    found = V.mapping(settings["fine_map"])[F.lower(value)]
    return F.coalesce(found, F.lit("other")) if settings.get("unmapped") == "other" else found


def distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull()))


def with_coarse(fine: Column, coarse_map: dict[str, str]) -> Column:
    """struct(fine, coarse): the distinct values of both levels of detail."""
    return V.let(distinct(fine), lambda own: F.struct(own.alias("fine"), distinct(F.transform(own, lambda x: V.mapping(coarse_map)[x])).alias("coarse")))


def categorical_parts(obs: Column, settings: dict) -> Column:
    """struct(fine, coarse) of observations. To be a column of its own, so that it is worked out once for all that
    `categorical` makes of it."""
    return with_coarse(F.transform(obs, lambda o: fine_value(o["value"], settings)), settings["coarse_map"])


def categorical(trait: str, obs: Column, parts: Column, settings: dict) -> dict[str, Column]:
    """The trait's columns from its observations. Values without a bin are no conflict; they count as observations."""
    (f, f_conflict), (c, c_conflict) = V.settled(parts["fine"]), V.settled(parts["coarse"])
    out = {f"{trait}_raw": F.when(F.size(obs) > 0, F.to_json(obs)), f"{trait}_n_obs": F.size(obs).cast("long"), f"{trait}_fine": f, trait: c, f"{trait}_fine_conflict": f_conflict, f"{trait}_conflict": c_conflict}
    if "folded_flag_fine" in settings:
        out[f"{trait}_microaerophile_folded"] = c.isNotNull() & F.coalesce(f == settings["folded_flag_fine"], F.lit(False))
    return out


def numeric_parts(obs: Column, settings: dict | None = None) -> Column:
    """struct(optima, positive, negative) of numeric observations: midpoints of optima, ends of spans with growth, and spans
    without; with settings also lo, hi (of growth), against (whether a span without growth overlaps it), middle (its bin, if
    none does) and bins (struct(fine, coarse) of the optima). To be a column of its own, so that it is worked out once for
    all that `numeric` makes of it."""

    def of(read: Column) -> Column:
        optima = F.transform(F.filter(read, lambda o: (o["type"] == "optimum") & (o["result"].isNull() | (o["result"] == "pos"))), lambda o: (o["span"]["lo"] + o["span"]["hi"]) / 2)
        return V.let(F.filter(read, lambda o: o["type"].isin("growth", "minimum", "maximum")), lambda grown: F.struct(optima.alias("optima"), ends(grown).alias("positive"), spans(grown, "neg").alias("negative")))

    def spans(grown: Column, result: str) -> Column:
        return F.transform(F.filter(grown, lambda o: o["result"] == result), lambda o: o["span"])

    def ends(grown: Column) -> Column:
        return F.flatten(F.transform(spans(grown, "pos"), lambda s: F.array(s["lo"], s["hi"])))

    seen = V.let(F.filter(obs, lambda o: o["span"].isNotNull()), of)
    return seen if settings is None else V.let(seen, lambda parts: _binned(parts, settings))


def _binned(parts: Column, settings: dict) -> Column:
    bins = lambda x: V.bin_value(x, settings["fine_edges"], settings["fine_levels"])

    def of(grown: Column) -> Column:
        lo, hi = grown["lo"], grown["hi"]
        against = F.exists(parts["negative"], lambda s: (s["lo"] <= hi) & (s["hi"] >= lo))
        middle = F.when(~against, V.let((lo + hi) / 2, bins))
        fine = with_coarse(F.transform(parts["optima"], bins), settings["coarse_map"])
        return F.struct(*(parts[k].alias(k) for k in ("optima", "positive", "negative")), lo.alias("lo"), hi.alias("hi"), against.alias("against"), middle.alias("middle"), fine.alias("bins"))

    return V.let(F.struct(F.array_min(parts["positive"]).alias("lo"), F.array_max(parts["positive"]).alias("hi")), of)


def contradicted(parts: Column) -> Column:
    """Whether a span without growth overlaps the span of growth."""
    return F.exists(parts["negative"], lambda s: (s["lo"] <= F.array_max(parts["positive"])) & (s["hi"] >= F.array_min(parts["positive"])))


def numeric(trait: str, obs: Column, parts: Column, settings: dict) -> dict[str, Column]:
    """Bins from the optima, else from the span of growth, else from its one value. A conflict of optima stays one, whatever
    the growth says; growth that a test without growth overlaps is a conflict too."""
    coarse_map = settings["coarse_map"]
    optima, positive, lo, hi = (parts[k] for k in ("optima", "positive", "lo", "hi"))
    has_optimum, has_growth = F.size(optima) > 0, F.size(positive) > 0
    optimum = F.when(has_optimum, F.aggregate(optima, F.lit(0.0), lambda a, x: a + x) / F.size(optima))
    (f, f_conflict), (c, c_conflict) = V.settled(parts["bins"]["fine"]), V.settled(parts["bins"]["coarse"])
    against, grown_fine = parts["against"], parts["middle"]
    pick = lambda a, b, none: F.when(has_optimum, a).when(has_growth, b).otherwise(none)
    null = F.lit(None)
    source = F.when(F.size(F.array_distinct(positive)) >= 2, "growth_range").otherwise("growth_single_point")
    shown = F.transform(obs, lambda o: F.struct(o["ref"].alias("ref"), o["type"].alias("type"), o["result"].alias("result"), o["value"].alias("value")))
    return {
        f"{trait}_raw": F.when(F.size(obs) > 0, F.to_json(shown, {"ignoreNullFields": "false"})), f"{trait}_n_obs": F.size(obs).cast("long"), f"{trait}_opt": optimum,
        f"{trait}_growth_min": F.when(has_growth, lo), f"{trait}_growth_max": F.when(has_growth, hi), f"{trait}_point": pick(optimum, (lo + hi) / 2, null), f"{trait}_bin_source": pick(F.lit("optimum"), source, F.lit("none")),
        f"{trait}_fine": pick(f, grown_fine, null), trait: pick(c, V.mapping(coarse_map)[grown_fine], null),
        f"{trait}_fine_conflict": pick(f_conflict, against, F.lit(False)), f"{trait}_conflict": pick(c_conflict, against, F.lit(False)),
    }


SAID = ("salt", "growth", "tested relation", "concentration")


def halophily() -> dict[str, Column]:
    own, said = read(HALOPHILY), SAID
    levels = F.filter(F.transform(own, lambda o: F.struct(o["@ref"].alias("ref"), V.clean(o["halophily level"]).alias("value"))), lambda o: o["value"].isNotNull())
    tests = F.filter(F.transform(own, lambda o: F.struct(o["@ref"].alias("ref"), *(V.clean(o[k]).alias(k.replace(" ", "_")) for k in said))), lambda t: t["salt"].isNotNull() | t["concentration"].isNotNull())
    value, conflict = V.resolve(F.transform(levels, lambda o: F.lower(o["value"])))
    return {"halophily_level_raw": F.when(F.size(levels) > 0, F.to_json(levels)), "halophily_level_n_obs": F.size(levels).cast("long"), "halophily_level": value, "halophily_level_conflict": conflict, "nacl_tests_raw": F.when(F.size(tests) > 0, F.to_json(tests, {"ignoreNullFields": "false"})), "nacl_tests_n": F.size(tests).cast("long")}


def identity(bacdive_id: Column, fetched_at: Column) -> dict[str, Column]:
    tax, general = (lambda *k: text((NAMES, *k))), (lambda *k: text(("General", *k)))
    genomes = read(GENOMES)
    accession = lambda o: V.clean(o["INSDC accession"])
    bases = F.array_distinct(F.filter(F.transform(genomes, lambda e: V.matched(accession(e), V.GENOME_ACCESSION)), lambda x: x.isNotNull()))
    shown = F.transform(genomes, lambda e: F.struct(accession(e).alias("insdc_accession"), V.clean(e["assembly level"]).alias("assembly_level"), e["score"].alias("score"), V.clean(e["description"]).alias("description")))
    doi, is_type, ids = V.clean(general("doi")), V.clean(tax("type strain")), general("NCBI tax id")
    return {
        "bacdive_id": bacdive_id.cast("long"), "species": V.clean(tax("species")), "genus": V.clean(tax("genus")), "full_scientific_name": V.clean(tax("full scientific name")), "bacdive_phylum": V.clean(tax("phylum")), "lpsn_phylum": V.clean(tax("LPSN", "phylum")),
        "strain_designation_raw": V.joined(tax("strain designation")), "culture_collection_no_raw": V.joined(text(CULTURE_NUMBERS)), "dsm_number": V.clean(general("DSM-Number")), "type_strain_bacdive": F.lower(is_type) == "yes",
        "ncbi_tax_ids_raw": F.when(ids.isNotNull() & ~ids.isin("", "0", "[]", "{}", "false"), F.when(ids.startswith("["), ids).otherwise(F.concat(F.lit("["), ids, F.lit("]")))), "doi": doi, "doi_date": V.doi_date(doi), "fetched_at": fetched_at,
        "bacdive_gca": F.nullif(F.array_join(bases, "|"), F.lit("")), "bacdive_gca_n": F.size(bases).cast("long"), "genome_candidates_raw": F.when(F.size(genomes) > 0, F.to_json(shown, {"ignoreNullFields": "false"})),
    }


def with_observations(records: DataFrame) -> DataFrame:
    """records (bacdive_id, record, fetched_at) with the objects of each section and an array of observations for each trait;
    records and sections are parsed once."""
    wanted = {p: _measures(key) for p, key in NUMERIC.values()} | {HALOPHILY: ("@ref", "halophily level", *SAID), GENOMES: ("INSDC accession", "assembly level", "score", "description")}
    for path, key in CATEGORICAL.values():
        wanted[path] = (*wanted.get(path, ("@ref",)), key)
    whole = records.withColumn("sections", sections(F.col("record")))
    split = whole.withColumns({f"read {p[-1]}": parsed(text(p), *keys) for p, keys in wanted.items()})
    own = {f"obs_{t}": observations(read(p), key) for t, (p, key) in CATEGORICAL.items()}
    seen = split.withColumns(own | {f"obs_{t}": measured(read(p), key) for t, (p, key) in NUMERIC.items()})
    return seen


def trait_table(records: DataFrame, cfg: Config) -> DataFrame:
    """One typed row a record. Records that hold predictions, and ids that occur twice, are refused by `check`."""
    df = with_observations(records)
    parts = {t: categorical_parts(F.col(f"obs_{t}"), cfg["traits"][t]) for t in CATEGORICAL} | {t: numeric_parts(F.col(f"obs_{t}"), cfg["traits"][t]) for t in NUMERIC}
    df = df.withColumns({f"parts_{t}": c for t, c in parts.items()})
    columns = identity(F.col("bacdive_id"), F.col("fetched_at"))
    for t in CATEGORICAL:
        columns |= categorical(t, F.col(f"obs_{t}"), F.col(f"parts_{t}"), cfg["traits"][t])
    for t in NUMERIC:
        columns |= numeric(t, F.col(f"obs_{t}"), F.col(f"parts_{t}"), cfg["traits"][t])
    return df.select(*(c.alias(n) for n, c in (columns | halophily()).items()))


def violations(records: DataFrame) -> DataFrame:
    """bacdive_id and problem: ids that occur twice (duplicate), and records with a non-empty section of predictions."""
    found = at(F.col("record"), PREDICTIONS)
    odd = records.filter(found.isNotNull() & ~found.isin("", "{}", "[]", "0", "false")).select("bacdive_id", F.lit("predictions").alias("problem"))
    twice = records.groupBy("bacdive_id").count().filter("count > 1").select("bacdive_id", F.lit("duplicate").alias("problem"))
    return odd.distinct().unionByName(twice)


def check(records: DataFrame) -> None:
    """Raises if there are violations."""
    few = violations(records).limit(5).collect()
    if any(r["problem"] == "predictions" for r in few):
        raise ValueError(f"records hold predictions, which must not enter the trait table; first ids: {[r[0] for r in few]}")
    if few:
        raise ValueError(f"duplicate ids across batches; first ids: {[r[0] for r in few]}")


def unbinned(records: DataFrame, cfg: Config) -> DataFrame:
    """kind (unmapped, unparsed), trait, value and how often, most frequent first: values that got no bin of their own."""
    df, found = with_observations(records), []
    said = lambda kind, t, obs: F.transform(obs, lambda o: F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("trait"), o["value"].alias("value")))
    unmapped = lambda pairs: lambda o: V.mapping(pairs)[F.lower(o["value"])].isNull()
    for t in CATEGORICAL:
        found.append(said("unmapped", t, F.filter(f"obs_{t}", unmapped(cfg["traits"][t]["fine_map"]))))
    for t in NUMERIC:
        found.append(said("unparsed", t, F.filter(f"obs_{t}", lambda o: o["value"].isNotNull() & o["span"].isNull())))
    every = df.select(F.explode(F.concat(*found)).alias("o")).select("o.*")  # one reading of a record
    return every.groupBy("kind", "trait", "value").count().orderBy("kind", F.col("count").desc(), "trait", "value")
