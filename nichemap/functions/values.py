"""Column builders for single values: cleaning, bins, results, numbers with units, taxonomy and accessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GENOME_ACCESSION = r"^(GC[AF]_[0-9]{9})(\.[0-9]+)?$"
DOI_DATE = r"\.([0-9]{8})\."
RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """text without white space at its ends; null if nothing is left."""
    return let(F.btrim(text.cast("string"), F.lit(" \t\n\x0b\f\r")), lambda s: F.when(s != "", s))


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return let(F.regexp_extract(text, pattern, group), lambda s: F.when(s != "", s))  # empty where nothing matches


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.lit(None).cast("map<string,string>")


def as_list(json: Column) -> Column:
    """The elements of a JSON list as JSON texts; a single value as a list of itself; null as an empty list."""
    # As array<string>, objects and lists stay JSON, and strings come without quotes.
    many = F.from_json(json, "array<string>")
    one = F.when(json.startswith("{"), json).otherwise(F.coalesce(F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0)), json))
    empty = F.array().cast("array<string>")
    return F.when(json.isNull(), empty).when(json.startswith("["), F.coalesce(many, empty)).otherwise(F.array(one))


def joined(json: Column, separator: str = ", ") -> Column:
    """The elements that aren't null or empty, in one string; null if there are none."""
    return F.nullif(F.array_join(F.filter(as_list(json), lambda x: x.isNotNull() & (x != "")), separator), F.lit(""))


def resolve(values: Column) -> tuple[Column, Column]:
    """(value, conflict) of an array of observed values: one distinct value, or null and whether there are several."""
    return settled(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))


def settled(distinct: Column) -> tuple[Column, Column]:
    """The same of the distinct values."""
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))), F.coalesce(F.size(distinct) > 1, F.lit(False))


def bin_index(x: Column, edges: list[float]) -> Column:
    """How many edges are at or below x: bins hold their lower edge."""
    return reduce(lambda a, b: a + b, [(x >= F.lit(e)).cast("int") for e in edges], F.lit(0))


def bin_value(x: Column, edges: list[float], levels: list[str]) -> Column:
    return F.when(x.isNotNull(), F.element_at(F.array(*map(F.lit, levels)), bin_index(x, edges) + 1))


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def parse_interval(text: Column) -> Column:
    """struct(lo, hi) of a number, a range or a bound with its unit; null for anything else. A range whose lower end is not
    negative and whose upper end is negative is a slip of the pen, not a range."""
    pattern = rf"^(?i:ph\s*)?(?:[<>]=?)?\s*({NUMBER})(?:\s*(?:-|to)\s*({NUMBER}))?\s*(?i:(?:[\x85\u2028\u2029]\s*)?(?:°\s*c|°|c|degrees?)\s*)?$(?s:.*)"

    def plain(s: Column) -> Column:
        dashed = F.when(s.contains("–") | s.contains("−"), F.translate(s, "–−", "--")).otherwise(s)
        return F.when(s.contains("("), F.regexp_replace(dashed, rf"\(({NUMBER})\)", "$1")).otherwise(dashed)

    def ends(s: Column) -> Column:
        # one match for both ends; where there is none, the text stays what it is
        return let(F.regexp_replace(s, pattern, "$1;$2"), lambda m: let(F.when(m != s, F.struct(F.substring_index(m, ";", 1).alias("a"), F.substring_index(m, ";", -1).alias("b"))), numbers))

    def numbers(p: Column) -> Column:
        a, b = (F.when(p[k] != "", p[k].try_cast("double")) for k in "ab")  # '' where the pattern doesn't match; to cast it costs an exception
        return let(F.struct(a.alias("a"), F.coalesce(b, a).alias("b")), span)

    def span(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.when(a.isNotNull() & ~((b < 0) & (a >= 0)), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))

    return let(let(clean(text), plain), ends)


def test_result(growth: Column, ability: Column) -> Column:
    """pos, neg, other, or null if neither is given; growth goes before ability."""
    said = lambda r: F.when(r.isin("positive", "yes", "+"), "pos").when(r.isin("negative", "no", "-"), "neg").when(r.isNotNull(), "other")
    return let(F.lower(F.coalesce(clean(growth), clean(ability))), said)


test_result.__test__ = False


def doi_date(doi: Column) -> Column:
    return matched(doi, DOI_DATE)


def rank_names(lineage: Column) -> dict[str, Column]:
    """The seven names of a lineage `d__A;p__B;...`; null where a rank is absent, blank or has no prefix."""
    parts = F.split(lineage, ";")
    out = {}
    for k, rank in enumerate(RANKS):
        part = F.get(parts, F.lit(k))
        out[rank] = F.when(part.contains("__"), clean(F.regexp_replace(part, r"^.*?__", "")))
    return out


def plain_genus(genus: Column) -> Column:
    """Lower case, without a suffix like _A."""
    return F.lower(F.regexp_replace(genus, r"_[A-Z]{1,3}$", ""))


def organism_genus(name: Column) -> Column:
    """The first word of an organism's name in lower case, past quotes, brackets and a leading Candidatus."""
    words = F.filter(F.transform(F.split(name, r"\s+"), lambda x: F.regexp_replace(x, r"""^[\[\]"'()]+|[\[\]"'()]+$""", "")), lambda x: x != "")
    first = F.when((F.size(words) > 1) & (F.lower(F.get(words, F.lit(0))) == "candidatus"), F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))
    return F.lower(first)


def accession_base(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def tax_ids(json: Column) -> Column:
    """Distinct whole numbers in a JSON list of numbers, or of objects that hold one as "NCBI tax id"."""
    inner = F.transform(as_list(json), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$['NCBI tax id']")).otherwise(x))
    return F.array_distinct(F.filter(F.transform(inner, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def quality(completeness: Column, contamination: Column) -> Column:
    return F.coalesce(completeness, F.lit(0.0)) - 5 * F.coalesce(contamination, F.lit(100.0))


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")).isin("t", "true", "1"), F.lit(False))
