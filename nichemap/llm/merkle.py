"""Fingerprints of documents that are Merkle trees: paragraphs are leaves, runs of paragraphs are sections, sections hang from
the root. Equal roots mean equal texts, and where roots differ the branches that differ say where the texts do.

A paragraph is a sentence or a line with the blanks and the line's end behind it; what goes on for longer than that is cut into
blocks of BLOCK code points. Every code point is in one paragraph. A section ends behind a paragraph whose hash is divisible
by SECTION, so that an edit leaves all sections but its own, at most its neighbour too, as they are. Paragraphs and sections
are 64-bit hashes; the root is a SHA-256 of the sections' hashes and the number of code points.

A fingerprint is a string: the root's first 32 hex digits, then for each section `-`, 8 digits of its hash, `:`, and 8 digits for
each of its paragraphs. `likeness` and `edits` need nothing but two such strings.

Everything is DataFrame functions. Finding a document's neighbour takes no window over all rows: ranges of ids are dealt out by
quantiles, each with the first document of the next range beside its own, so that texts are shuffled once, next to their
neighbours. The driver holds a few numbers a range; ranges are RANGES a shuffle partition.

Rows: a null text is empty; an empty text has a root and no branches. Neighbours are by id; null ids come after all others, and
rows that share an id are in order of their texts and lie in one range. A single document is its own neighbour. No rows give
no rows. Only doc_id and text are read, so that other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points of a paragraph's sentence at most, and of a block where there is no sentence.
SENTENCE, BLOCK = 126, 64
#: One paragraph in so many ends a section.
SECTION = 8
#: Ranges of ids a shuffle partition, least documents in one, and ranges whose bounds are quantiles; more are cut evenly.
RANGES, LEAST, QUANTILES = 8, 64, 256

PARAGRAPH = rf"(?s)[^\n.!?]{{0,{SENTENCE}}}(?:[.!?]+[ \t]*\n?|\n)|.{{1,{BLOCK}}}"


def leaves(text: Column) -> Column:
    """Hashes of a text's paragraphs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.xxhash64(x))


def short(x: Column) -> Column:
    return F.right(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit(8))


def with_fingerprint(df: DataFrame, hashes: str, n_chars: str, name: str) -> DataFrame:
    """df with the fingerprint of a text of so many code points whose paragraphs have these hashes."""
    h, ends, sections = F.col(hashes), F.col("_ends"), F.col("_sections")
    last = F.size(h)
    every = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_ends", F.filter(every, lambda i: (i == last) | (F.pmod(F.element_at(h, i), F.lit(SECTION)) == 0)))
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
    df = df.withColumn("_sections", F.transform(ends, lambda end, k: F.slice(h, start(k) + 1, end - start(k))))
    df = df.withColumn("_nodes", F.transform(sections, lambda s: F.xxhash64(s)))
    root = F.substring(F.sha2(F.concat_ws(",", F.col(n_chars).cast("string"), F.col("_nodes").cast("array<string>")), 256), 1, 32)
    branch = F.zip_with("_nodes", "_sections", lambda node, s: F.concat(F.lit("-"), short(node), F.lit(":"), F.array_join(F.transform(s, short), "")))
    return df.withColumn(name, F.concat(root, F.array_join(F.transform(branch, lambda x: x), ""))).drop("_ends", "_sections", "_nodes")


def shared(a: Column, b: Column, same: Column) -> Column:
    """1 if the texts are the same; else the share of paragraphs that they have in common, below 1: twice the paragraphs of both
    by those of each."""
    one, other, both = F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.size(F.array_intersect(a, b))
    return F.when(same, 1.0).otherwise(F.least(2.0 * both, one + other - 1.0) / F.greatest(one + other, F.lit(1)))


def root_of(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 32)


def branches(fingerprint: Column) -> Column:
    """(node, paragraphs) of each section of a fingerprint."""
    parts = lambda s: F.struct(F.substring(s, 1, 8).alias("node"), F.regexp_extract_all(F.substring(s, 10, 1 << 30), F.lit("[0-9a-f]{8}"), F.lit(0)).alias("paragraphs"))
    return F.transform(F.filter(F.split(F.substring(fingerprint, 33, 1 << 30), "-"), lambda s: s != ""), parts)


def likeness(one: Column, other: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; 1 only if their roots are equal."""
    paragraphs = lambda f: F.flatten(F.transform(branches(f), lambda s: s["paragraphs"]))
    return shared(paragraphs(one), paragraphs(other), root_of(one) == root_of(other))


def edits(df: DataFrame, one: str, other: str) -> DataFrame:
    """df with `edited`: what of fingerprint `one` isn't in `other`, as (section, paragraphs) by place from 0. Sections that
    `other` has anywhere are passed over whole; only in the rest are paragraphs compared."""
    df = df.withColumns({"_one": branches(F.col(one)), "_other": branches(F.col(other))})
    df = df.withColumns({"_nodes": F.col("_other.node"), "_kept": F.flatten(F.col("_other.paragraphs"))})
    place = lambda s, k: F.struct(k.alias("section"), F.array_except(F.transform(s["paragraphs"], lambda p, j: F.when(~F.array_contains("_kept", p), j)), F.array(F.lit(None).cast("int"))).alias("paragraphs"), F.array_contains("_nodes", s["node"]).alias("same"))
    found = F.filter(F.transform("_one", place), lambda s: ~s["same"])
    out = F.when(root_of(F.col(one)) == root_of(F.col(other)), F.array().cast("array<struct<section:int,paragraphs:array<int>>>")).otherwise(F.transform(found, lambda s: F.struct(s["section"].alias("section"), s["paragraphs"].alias("paragraphs"))))
    return df.withColumn("edited", out).drop("_one", "_other", "_nodes", "_kept")


def ranges(ids: DataFrame, wanted: int) -> tuple[Column, int] | None:
    """(the range of column `_id`, number of ranges), about as many as wanted, higher ids in higher ranges; None for no ids."""
    coarse = min(QUANTILES, wanted)
    cuts = F.percentile_approx("_id", [k / coarse for k in range(1, coarse)] or [0.5], 10_000)
    row = ids.agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), cuts.alias("cuts")).first()
    if row["lo"] is None:
        return None
    low = [row["lo"], *sorted({c + 1 for c in row["cuts"] if c < row["hi"]} - {row["lo"]})] if coarse > 1 else [row["lo"]]
    wide = [b - a for a, b in zip(low, [*low[1:], row["hi"] + 1], strict=True)]
    fine = -(-wanted // coarse)
    at = F.size(F.filter(F.lit(low), lambda b: b <= F.col("_id")))
    within = F.floor((F.col("_id") - F.element_at(F.lit(low), at)).cast("double") * fine / F.element_at(F.lit(wide), at).cast("double"))
    return (at - 1) * fine + F.least(F.lit(fine - 1), within).cast("int"), len(low) * fine


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (doc_id, text and others) with `next`, a struct of these columns of the document that follows by descending id; after
    the last comes the first."""
    spark = df.sparkSession
    least = df.agg(F.min("doc_id")).first()[0]
    own = df.withColumn("_id", F.coalesce("doc_id", F.lit(0 if least is None else least - 1).cast("long")))  # null ids last
    ids = own.select("_id")
    wanted = max(1, min(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), ids.count() // LEAST))
    made = ranges(ids, wanted)
    if made is None:
        return df.withColumn("next", F.struct(*columns))
    of = made[0]
    firsts = sorted(((r["_range"], r["_first"]) for r in ids.groupBy(of.alias("_range")).agg(F.max("_id").alias("_first")).collect()), reverse=True)
    # the first document of each range is also a guest of the range above, that of the highest a guest of the lowest
    guests = [(first, above) for (_, first), (above, _) in zip([*firsts[1:], firsts[0]], firsts, strict=True)]
    table = spark.range(1).select(F.explode(F.arrays_zip(F.lit([g[0] for g in guests]).alias("_guest"), F.lit([g[1] for g in guests]).alias("_host"))).alias("_g")).select("_g._guest", "_g._host")
    hosts = table.groupBy("_guest").agg(F.collect_list("_host").alias("_hosts"))
    home = F.array(F.struct(of.alias("range"), F.lit(False).alias("guest")))
    away = F.transform(F.coalesce("_hosts", F.array().cast("array<int>")), lambda r: F.struct(r.alias("range"), F.lit(True).alias("guest")))
    dealt = own.join(F.broadcast(hosts), own["_id"] == hosts["_guest"], "left").withColumn("_at", F.explode(F.concat(home, away))).drop("_guest", "_hosts")  # a row a range
    window = W.partitionBy("_at.range").orderBy("_at.guest", F.desc("_id"), "text")
    found = dealt.withColumn("next", F.lead(F.struct(*columns)).over(window))
    return found.filter("not _at.guest").drop("_at", "_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", F.length("text").cast("long").alias("n_chars"), leaves(F.col("text")).alias("_leaves"))
    return with_fingerprint(own, "_leaves", "n_chars", "fingerprint").drop("_leaves")


def against_edits(docs: DataFrame) -> DataFrame:
    """Every text beside its edited self, whose later half of code points is as many first ones of the next document, or all of
    them: doc_id, n_chars, edited_sha256, both fingerprints, and the likeness of the text's fingerprint to the edited one and
    to the next document's."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumns({"n_chars": F.length("text").cast("long"), "leaves": leaves(F.col("text"))})
    own = with_next(own, ["text", "leaves"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half))
    own = own.withColumn("edited", edited)
    own = own.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.length("edited").cast("long").alias("_n"), "leaves", leaves(F.col("edited")).alias("_leaves"), F.col("next.leaves").alias("_next"), F.length("next.text").alias("_next_n"), (F.col("edited") == F.col("text")).alias("_same"), (F.col("next.text") == F.col("text")).alias("_same_next"))
    own = with_fingerprint(own, "leaves", "n_chars", "fingerprint")
    own = with_fingerprint(own, "_leaves", "_n", "edited_fingerprint")
    near = {"near_edited": shared(F.col("leaves"), F.col("_leaves"), F.col("_same")), "near_next": shared(F.col("leaves"), F.col("_next"), F.col("_same_next"))}
    return own.withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
