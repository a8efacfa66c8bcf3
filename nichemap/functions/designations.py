"""Strain designations brought to one key: `DSMZ 00123T`, `DSM-123` and `dsm 123` are all `DSM123`.

Everything is column expressions, but for Unicode folding, which Spark has no function for: `fold` runs on the distinct
strings that are not ASCII, as an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import mapping

# Delimiters, aliases, codes of culture collections and words that stand for no designation.
DELIMITERS = (",", ";", "/", "|", "=")
ALIASES = {"DSMZ": "DSM", "NCIB": "NCIMB"}
COLLECTIONS = ("DSM", "ATCC", "NCTC", "NCIMB", "CIP", "JCM", "LMG", "KCTC", "CCUG", "CGMCC", "BCRC", "NBRC", "IFO", "VKM", "CECT", "CCM", "CFBP", "IAM", "MTCC", "NRRL", "NCCB", "CBS", "UCC", "CCTCC", "KACC", "NZP", "PCM", "TISTR", "VTT", "ICMP", "LMD", "BCCM", "MCCC", "HAMBI", "IMET", "CCAP", "IBRC")
PLACEHOLDERS = ("NONE", "NA", "NAN", "NULL", "UNKNOWN", "UNK", "NOTAVAILABLE", "MISSING", "TYPESTRAIN", "STRAIN")

KEY = "struct<raw:string,canonical:string,kind:string,collection:string>"


def fold_text(s: str | None) -> str | None:
    """Upper-case ASCII where there is any: no trademark signs, plain dashes, no accents."""
    if s is None:
        return None
    s = s.translate({0xAE: None, 0x2122: None, 0xA0: " "})
    s = unicodedata.normalize("NFKC", s).translate(dict.fromkeys([*range(0x2010, 0x2016), 0x2212], "-"))
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper().strip()


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7f]")


def fold_ascii(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))


def fold(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with the folded column; only distinct strings that aren't ASCII reach Python."""
    odd = df.filter(~is_ascii(F.col(column))).select(F.col(column).alias("_odd")).distinct().withColumn("_folded", _fold("_odd"))
    return df.join(odd, df[column] == odd["_odd"], "left").withColumn(to, F.coalesce("_folded", fold_ascii(F.col(column)))).drop("_odd", "_folded")


def split(text: Column, delimiters: Iterable[str] = DELIMITERS) -> Column:
    """The pieces between delimiters, trimmed, without empty ones."""
    pattern = "|".join(f"\\Q{d}\\E" for d in delimiters)
    return F.coalesce(F.filter(F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.array().cast("array<string>"))


def parse_folded(raw: Column, folded: Column, aliases: dict[str, str] | None = None, collections: Iterable[str] | None = None) -> Column:
    """raw, canonical, kind and collection of one designation whose folded form is given."""
    aliases, codes = ALIASES if aliases is None else aliases, list(COLLECTIONS if collections is None else collections)
    s = F.trim(F.regexp_replace(folded, r"(?i)^(?:type\s+strain|strain|str\.?|isolate|type)\s+", ""))
    s = F.trim(F.regexp_replace(s, r"(?i)\s*[\(\[]\s*(?:type\s*strain|type|t)\s*[\)\]]\s*$", ""))
    s = F.trim(F.regexp_replace(s, r"\^\s*T$", ""))
    lead = F.regexp_extract(s, r"^([A-Z]{2,8})(?=[\s\-_.:]*[A-Z0-9])", 1)
    code = F.coalesce(F.get(F.filter(F.array(mapping(aliases)[lead]), lambda x: x.isNotNull()), F.lit(0)), lead) if aliases else lead
    known = (lead != "") & code.isin(codes)
    rest = F.substr(s, F.length(lead) + 1)
    rest = F.regexp_replace(rest, r"^([\s\-_.:]*[0-9][\w.\-]*?)\s*T$", "$1")
    rest = F.regexp_replace(rest, "[^A-Z0-9]", "")
    rest = F.when(rest.rlike("^[0-9]+$"), F.regexp_replace(rest, "^0+(?=[0-9])", "")).otherwise(rest)
    bare = F.regexp_replace(s, "[^A-Z0-9]", "")
    canonical = F.when(known, F.concat(code, rest)).otherwise(bare)
    fit = (F.length(bare) >= 3) & ~bare.isin(*PLACEHOLDERS) & bare.rlike("[0-9]") & bare.rlike("[A-Z]")
    kind = F.when(known & rest.rlike("[0-9]"), "collection").when(known, "unusable").when(fit, "bare").otherwise("unusable")
    return F.struct(raw.alias("raw"), canonical.alias("canonical"), kind.alias("kind"), F.when(known, code).alias("collection"))


@dataclass(frozen=True)
class Normaliser:
    """Delimiters, aliases and codes of one configuration."""

    delimiters: tuple[str, ...] = DELIMITERS
    aliases: dict[str, str] | None = None
    collections: tuple[str, ...] | None = None

    @classmethod
    def from_config(cls, cfg) -> Normaliser:
        m = cfg["matching"]
        return cls(tuple(m["delimiters"]), dict(m["aliases"]), tuple(m["collections"]))

    def raw_tokens(self, text: Column) -> Column:
        return split(text, self.delimiters)

    def dictionary(self, tokens: DataFrame, column: str = "token") -> DataFrame:
        """Each distinct token with raw, canonical, kind and collection."""
        distinct = fold(tokens.select(column).distinct(), column, "_f")
        return distinct.select(column, parse_folded(F.col(column), F.col("_f"), self.aliases, self.collections).alias("_d")).select(column, "_d.*")

    def parse_tokens(self, tokens: DataFrame, column: str = "token", parsed: DataFrame | None = None) -> DataFrame:
        """tokens with raw, canonical, kind and collection of the column; each distinct token is parsed once, or not at all if
        a dictionary of them is given."""
        return tokens.join(self.dictionary(tokens, column) if parsed is None else parsed, column, "left")

    def tokens(self, df: DataFrame, key: list[str], sources: list[Column]) -> DataFrame:
        """key, source, pos and token of every piece of the sources."""

        def numbered(n: int, source: Column) -> Column:
            return F.transform(self.raw_tokens(source), lambda x, i: F.struct(F.lit(n).alias("source"), i.alias("pos"), x.alias("token")))

        every = F.flatten(F.array(*[numbered(n, s) for n, s in enumerate(sources)]))
        return df.select(*key, F.explode(every).alias("_t")).select(*key, "_t.*")

    def parse(self, df: DataFrame, key: list[str], sources: list[Column], parsed: DataFrame | None = None) -> DataFrame:
        """A row a designation of each row of df: key, source, pos, token and its parse, the first of each canonical key over
        the sources in order; unusable ones too, but no empty keys."""
        rows = self.parse_tokens(self.tokens(df, key, sources), parsed=parsed).filter(F.col("canonical") != "")
        best = F.min_by(F.struct("source", "pos", "token", "raw", "kind", "collection"), F.struct("source", "pos")).alias("_b")
        return rows.groupBy(*key, "canonical").agg(best).select(*key, "canonical", "_b.*")


def parse_designations(df: DataFrame, column: str, key: list[str], normaliser: Normaliser | None = None) -> DataFrame:
    return (normaliser or Normaliser()).parse(df, key, [F.col(column)])


def canonical_keys(df: DataFrame, column: str, key: list[str], normaliser: Normaliser | None = None) -> DataFrame:
    """key, and the array keys of matchable designations in order."""
    rows = parse_designations(df, column, key, normaliser).filter("kind <> 'unusable'")
    keys = rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "canonical"))), lambda x: x["canonical"]).alias("keys"))
    return df.select(*key).join(keys, key, "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def parse_text(spark, text: str, normaliser: Normaliser | None = None) -> list[dict]:
    """The designations of one string, in order: raw, canonical, kind and collection."""
    df = parse_designations(spark.createDataFrame([(0, text)], "id int, text string"), "text", ["id"], normaliser)
    return [r.asDict() for r in df.orderBy("pos").select("raw", "canonical", "kind", "collection").collect()]


def keys_of(spark, text: str, normaliser: Normaliser | None = None) -> list[str]:
    """The matchable keys of one string."""
    return [x["canonical"] for x in parse_text(spark, text, normaliser) if x["kind"] != "unusable"]
