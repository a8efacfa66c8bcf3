"""Audit of how filters interact: for every order in which they can be applied, what each step removes, which of it was
removed already, and what it costs in good documents.

What an order does to a document is told by the set of filters that the document fails: 32 sets of five filters and 120
orders make a table of first failures that is worked out once. Tasks index it with their documents' sets and add up removals
by part, order, step and label with bincount; their arrays are sums, and all that is shuffled. Everything else follows from
the summed arrays: what a filter fails in a part is what it removes as the first of an order, what it alone fails is
what it removes as the last, and its Shapley value is the sum over all orders.

Rows: a null text is empty; empty texts are alike. A row is a document in its own right, whether or not its id repeats; rows
with one id and text leave each other alone, and a null id comes after all others. A document is good, or toxic, if any row of
labels with its id says so. A null part is the empty string. No documents give no rows. Of documents only doc_id, text and the
part's column are read, of labels doc_id, quality and toxic, so that other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, stored, texts_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
SIGNS, UPPER = b"#$%&*|", bytes(range(65, 91))
#: Parts whose arrays a task holds at once; beyond, it sends what it has.
HELD = 500


def first_failures() -> np.ndarray:
    """Step (0 to 4) at which an order removes documents of a set of failed filters, 5 if it keeps them; a row a set, whose bit
    k is filter k, and a column an order."""
    sets = np.arange(1 << STEPS)
    out = np.full((len(sets), len(ORDERS)), STEPS)
    for j, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            out[(sets >> FILTERS.index(order[step])) & 1 == 1, j] = step
    return out


def failed_bits(text: str) -> int:
    """The filters A to D that a text fails, as bits: few words, few different words, many capitals, signs."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at the bytes that words leave out
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * len(text)) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3


def documents_failing(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, fails (bits), good and toxic (0 or 1), and n, the documents that are so. Texts are compared by 128 bits of a
    cryptographic hash. Copies of a text are counted by part and label, with the least id among them, before those of one
    text meet: however many there are, they are a row a part and label, and no text is shuffled."""
    own = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        print_of = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array([failed_bits(t) for t in texts], pa.int32()), pa.array(print_of, pa.binary())], names=["doc_id", "part", "fails", "print"])

    narrow = map_arrow(own, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, fails int, print binary")
    told = labels.groupBy(F.col("doc_id").alias("_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    narrow = narrow.join(told, narrow["doc_id"] == told["_id"], "left").drop("_id").fillna(0, ["good", "toxic"])
    kinds = ("print", "part", "fails", "good", "toxic")
    by_id = narrow.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))  # rows that share an id are no copies of each other
    copies = stored(by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"))).rows
    least = copies.groupBy(F.col("print").alias("_print")).agg(F.min("first").alias("least"))
    alone = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first") == F.col("least"), F.col("firsts")).otherwise(0)
    kept = copies.join(least, copies["print"] == least["_print"]).withColumn("_alone", alone)
    both = F.array(F.struct(F.col("fails").alias("fails"), F.col("_alone").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("_alone")).alias("n")))
    return kept.select("part", "good", "toxic", F.explode(both).alias("_of")).select("part", "_of.fails", "good", "toxic", "_of.n").filter("n > 0")


def removals(failing: DataFrame) -> DataFrame:
    """(part, order_no, step, removed, good, toxic): documents that an order removes at a step, those that it keeps as step
    5; rows of zeros are left out. failing: part, fails, good, toxic and n."""
    table, orders = first_failures(), len(ORDERS)
    shape = (orders, STEPS + 1, 4)
    # place of (set, order, label) in a part's array, without the label
    place = (np.arange(orders)[None, :] * (STEPS + 1) + table) * 4
    bounded_batches(failing.sparkSession)

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, total in held.items():
            total = total.reshape(shape)
            order, step = np.nonzero(total.any(axis=2))
            n = total[order, step]
            columns = [pa.array([part] * len(order), pa.string()), pa.array(order), pa.array(step), pa.array(n.sum(axis=1)), pa.array(n[:, 1] + n[:, 3]), pa.array(n[:, 2] + n[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "order_no", "step", "removed", "good", "toxic"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            label = batch.column("good").to_numpy() + 2 * batch.column("toxic").to_numpy()
            sets = batch.column("fails").to_numpy()
            at, of = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            counts = np.bincount((at * len(table) + sets) * 4 + label, batch.column("n").to_numpy(), len(of) * len(table) * 4).reshape(len(of), len(table), 4)
            for k, part in enumerate(of):
                some, kind = np.nonzero(counts[k])
                where = place[some] + kind[:, None]
                own = np.bincount(where.ravel(), np.repeat(counts[k][some, kind], orders), minlength=np.prod(shape)).astype(np.int64)
                held[part] = held[part] + own if part in held else own
            if len(held) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    made = failing.mapInArrow(each, "part string, order_no long, step long, removed long, good long, toxic long")
    return made.groupBy("part", "order_no", "step").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def interactions(failing: DataFrame) -> DataFrame:
    """A row a part, order and step, zeros included, from the sums of `removals`, of which a part has 720 rows at most."""
    orders = len(ORDERS)
    letters = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])

    def each(group: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((3, orders, STEPS + 1), np.int64)
        for k, c in enumerate(("removed", "good", "toxic")):
            n[k, group["order_no"], group["step"]] = group[c]
        removed = n[0, :, :STEPS]
        fails, alone, shapley = (np.zeros(STEPS, np.int64) for _ in range(3))
        fails[letters[:, 0]] = removed[:, 0]
        alone[letters[:, -1]] = removed[:, -1]
        np.add.at(shapley, letters, removed)
        columns = {"kept": n[0].sum(axis=1, keepdims=True) - removed.cumsum(axis=1), "removed": removed, "redundant": fails[letters] - removed, "unique_fails": alone[letters], "good_lost": n[1, :, :STEPS], "toxic_lost": n[2, :, :STEPS], "shapley": shapley[letters]}
        head = {"part": group["part"].iloc[0], "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1), orders)}
        return pd.DataFrame(head | {k: v.ravel() for k, v in columns.items()})

    return removals(failing).groupBy("part").applyInPandas(each, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    return interactions(documents_failing(docs, labels, part))
