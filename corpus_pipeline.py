"""A corpus from raw documents to packed sequences: five stages, each by an operator of subpackage llm.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Every stage but the last returns the
columns of documents, whatever else these are called; the last returns a row a piece, with its sequence and place.

No stage knows a row by its doc_id: rows with a null id, and rows that share one, are each judged, masked and packed in
their own right, with the exceptions named below. A null text counts as empty. An empty table stays empty. Very long texts
are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichemap.llm import packing, pii, quality, repeats, simhash, spans
from nichemap.llm.common import cut, table
from nichemap.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have no words and go; rows that repeat are judged alike."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least doc_id, of each group of near-duplicates; null ids come last, and of rows alike in id
    and text one stays. Different texts with one id, or none, are kept or dropped with the groups of their own. Texts without
    words have one fingerprint and so are near-duplicates."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 20 words that an earlier text (by doc_id, null first), or an earlier place, has. Rows that share
    an id count as one document: equal rows leave each other alone. Null texts stay null."""
    return repeats.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, disguised or not, masked; null texts stay null, and n_chars, where there is one, is that of
    the new text."""
    out = spans.redact(docs, pii.find)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the texts, packed: a row a piece, of which a null or empty text has one, its end id."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [(f.__name__, f) for f in (quality_rules, near_dedup, substring_dedup, personal_data, best_fit_packing)]

#: Components, disguises and the packing plan are beyond SQL; a test holds run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
