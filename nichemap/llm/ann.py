"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix; the signs of its components are its code, one bit each, and two
scalars correct it: its length, and the inner product of its direction with its code's. A query, rotated likewise, is
rounded to four bits a component, so that its inner product with a code is a sum of bit counts; from that the inner
product with the vector is estimated as length * <code, query> / correction, and bounded: the error is above
length * |query| * sqrt((1 - correction^2) / correction^2) * EPSILON / sqrt(d - 1) with a chance that falls as
exp(-EPSILON^2 / 2), and rounding adds a like term. For each query the vectors with the best estimates are scored first, with
the original vectors in double precision; every vector whose upper bound reaches the k-th best of these scores is then
reranked in the same way.

Vectors lie in cells, about CELL to a cell and CELLS at most, by the centre that their direction is nearest to; centres are
fitted to a bounded sample of FIT vectors a dimension, and every vector has its cell. A vector stays in the one place of its
cell; queries travel to the cells with the best centres, as many as on the sample hold RECALL of its own neighbours, which
for vectors without clusters is all of them, and as many more as it takes to hold k candidates. A cell beyond BLOCK vectors
is several places, and only where more than QUERIES queries come to a place are its vectors sent twice. A place puts out at
most k rows a query; these are ranked over the places.

Equal vectors are one candidate with its k + 1 least ids, so that copies of one vector, however many, cost nothing and ties
stay exact. Vectors null, zero or holding null or non-finite components take no part, nor do rows with a null id. Vectors are
compared with those of their own dimension only. Rows that repeat an id count as one row, with the least of their vectors. A
query with fewer than k candidates gets them all; an empty table, or one without queries, gives no rows. Other columns of the
table play no part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, map_arrow

K, EPSILON, SEED = 20, 1.9, 11
#: Vectors of a cell, about; cells, vectors that they are fitted to, and rounds of the fit at most; the share of a sample's
#: neighbours that the cells a query goes to have to hold; vectors and queries of a place at most.
CELL, CELLS, FIT, ROUNDS, RECALL, BLOCK, QUERIES = 16_384, 4_096, 32_768, 8, 0.985, 65_536, 32_768
#: Bits that a component of a query is rounded to; pairs scored at once; how many times k vectors are scored for the first
#: bound; queries of the sample that the number of cells is chosen by.
LEVELS, PAIRS, AHEAD, TRIED = 4, 1_000, 5, 256


@lru_cache(8)
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same at every call."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    held = np.packbits(bits, axis=1)
    wide[:, : held.shape[1]] = held
    return wide.view(np.uint64)


class Codes:
    """The codes of vectors, with their lengths and corrections."""

    def __init__(self, x: np.ndarray):
        y = x @ rotation(x.shape[1])
        self.d, words = x.shape[1], packed_bits(y > 0)
        self.words = np.ascontiguousarray(words.T)  # a row for each 64 bits
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.length = np.linalg.norm(y, axis=1)
        self.correction = np.abs(y).sum(axis=1) / np.sqrt(self.d) / self.length
        self.scale = self.length / self.correction / np.sqrt(self.d)
        self.spread = np.sqrt(np.maximum(0, 1 - self.correction**2)) / self.correction * self.length / np.sqrt(max(1, self.d - 1))

    def estimates(self, query: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Of <query, vector> for each vector the estimate and its upper bound; the query is rotated."""
        low, high = float(query.min()), float(query.max())
        step = (high - low) / (2**LEVELS - 1) or 1.0
        level = np.rint((query - low) / step).astype(np.uint8)
        rounded = low + step * level
        planes = packed_bits((level[None, :] >> np.arange(LEVELS, dtype=np.uint8)[:, None]) & 1)
        count = np.zeros(len(self.ones), np.int32)
        for words, plane in zip(self.words, planes.T, strict=True):
            for j, bits in enumerate(plane):
                count += np.left_shift(np.bitwise_count(words & bits), j, dtype=np.int32)
        # of a code of signs: twice what the set bits add up to, less the whole
        estimate = (2 * (low * self.ones + step * count) - rounded.sum()) * self.scale
        off = epsilon * np.linalg.norm(query - rounded)
        return estimate, estimate + epsilon * np.linalg.norm(query) * self.spread + off * self.scale + 1e-9 * self.length


def scores(q: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of q with rows of x; each is summed in the same order, wherever it stands."""
    out = np.empty(len(at))
    for k in range(0, len(at), PAIRS):
        out[k : k + PAIRS] = (x[at[k : k + PAIRS]] * q).sum(axis=1)
    return out


class Place:
    """Vectors in one place, each with its ids, searched query by query."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray]):
        self.x, self.codes = x, Codes(x)
        self.sizes = np.array([len(i) for i in ids])
        self.ids = np.concatenate(ids)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.alone = {int(self.ids[self.first[n]]): n for n in np.flatnonzero(self.sizes == 1)}

    def search(self, q: np.ndarray, asked: int, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of up to k candidates of the query with this id."""
        estimate, high = self.codes.estimates(q @ rotation(len(q)), epsilon)
        if asked in self.alone:
            estimate[self.alone[asked]] = high[self.alone[asked]] = -np.inf
        if len(self.x) > k:
            m = min(len(self.x), AHEAD * k)
            best = np.argpartition(estimate, -m)[-m:]
            score = scores(q, self.x, best)
            score[np.isinf(estimate[best])] = -np.inf
            least = np.partition(score, -k)[-k]
            high[best] = -np.inf
            more = np.flatnonzero((high >= least) & (high > -np.inf))
            at, score = np.concatenate([best, more]), np.concatenate([score, scores(q, self.x, more)])
        else:
            at = np.flatnonzero(high > -np.inf)
            score, least = scores(q, self.x, at), -np.inf
        fine = (score >= least) & (score > -np.inf)
        at, score = at[fine], score[fine]
        n = self.sizes[at]
        found = self.ids[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        score = np.repeat(score, n)
        found, score = found[found != asked], score[found != asked]
        order = np.lexsort((found, -score))[:k]
        return found[order], score[order]


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector the number of the centre that its direction is nearest to."""
    own = directions(centres).T
    return np.concatenate([np.argmax(x[n : n + 4096] @ own, axis=1) for n in range(0, len(x), 4096)]) if len(x) else np.array([], int)


def fitted(x: np.ndarray, cells: int, k: int = K, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centres for a sample, and how many cells a query has to go to."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS if cells > 1 else 0):
        cell = nearest_centre(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, cell, directions(x))
        n = np.bincount(cell, minlength=cells)
        lost = np.flatnonzero((n == 0) | (np.abs(total).sum(axis=1) == 0))
        total[lost] = x[rng.choice(len(x), len(lost), replace=False)]  # an empty cell begins again elsewhere
        centres = directions(total)
    cell = nearest_centre(x, centres)
    n = np.maximum(1, np.bincount(cell, minlength=cells))
    mean = np.zeros_like(centres)
    np.add.at(mean, cell, x)
    mean = np.where((np.bincount(cell, minlength=cells) > 0)[:, None], mean / n[:, None], centres)
    tried = rng.choice(len(x), min(TRIED, len(x)), replace=False)
    inner = x[tried] @ x.T
    inner[np.arange(len(tried)), tried] = -np.inf
    near = np.argpartition(inner, -min(k, len(x)), axis=1)[:, -min(k, len(x)) :]
    place = np.argsort(np.argsort(-(x[tried] @ mean.T), axis=1), axis=1)  # of each cell in the query's order
    needed = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return mean, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _matrix(rows: pa.Table, name: str = "v") -> np.ndarray:
    column = rows.column(name).combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(column), -1)


def _fit(k: int):
    def run(rows: pa.Table) -> pa.Table:
        x = _matrix(rows)
        cells = max(1, min(CELLS, len(x) // 8, -(-rows.column("n")[0].as_py() // CELL)))
        centres, probes = fitted(x, cells, k)
        return pa.table({"d": pa.array([x.shape[1]], pa.int32()), "cells": pa.array([cells], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary()), "probes": pa.array([probes], pa.int32())})

    return run


def _assign(index: dict[int, np.ndarray]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = batch.column(batch.schema.get_field_index("d")).to_numpy()
        cell = np.zeros(len(d), np.int32)
        table = pa.Table.from_batches([batch])
        for own in np.unique(d):
            at = np.flatnonzero(d == own)
            cell[at] = nearest_centre(_matrix(table.take(pa.array(at))), index[int(own)])
        return batch.append_column("cell", pa.array(cell))

    return run


def _route(index: dict[int, np.ndarray], probes: dict[int, int], held: dict[int, np.ndarray], k: int):
    """Each query's cells: the first of its order, until they are as many as the sample needs and hold k others."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = batch.column(batch.schema.get_field_index("d")).to_numpy()
        table = pa.Table.from_batches([batch])
        rows, cells = [], []
        for own in np.unique(d):
            at = np.flatnonzero(d == own)
            centres, n = index[int(own)], held[int(own)]
            order = np.argsort(-(_matrix(table.take(pa.array(at))) @ centres.T), axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            use = ((np.arange(order.shape[1]) < probes[int(own)]) | (before <= k)) & (n[order] > 0)
            row, place = np.nonzero(use)
            rows.append(at[row])
            cells.append(order[row, place])
        out = table.take(pa.array(np.concatenate(rows))).append_column("cell", pa.array(np.concatenate(cells).astype(np.int32)))
        return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema=out.schema)

    return run


def _compare(k: int, epsilon: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.array([], np.int64)
        out = [(empty, empty, np.array([]))]
        if left.num_rows and right.num_rows:
            here = Place(_matrix(left), [np.array(i, "<i8") for i in left.column("ids").to_pylist()])
            for q, asked in zip(_matrix(right), right.column("id").to_pylist(), strict=True):
                found, score = here.search(q, asked, k, epsilon)
                out.append((np.full(len(found), asked), found, score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest other rows of each row of df for which queries holds."""
    spark = df.sparkSession
    bounded_batches(spark)
    good = df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    one = good.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = cut(one.withColumns({"d": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")}))
    # The k + 1 least ids of each vector; of a common vector Spark drops what is beyond them before the shuffle.
    least = rows.withColumn("n", F.row_number().over(W.partitionBy("d", "h1", "h2").orderBy("id"))).filter(F.col("n") <= k + 1)
    distinct = cut(least.groupBy("d", "h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("d", "ids", "v", F.get("ids", F.lit(0)).alias("first")))

    # Centres for each dimension, from at most FIT vectors by a hash of the id
    total = distinct.groupBy("d").agg(F.count("*").alias("n"))
    sample = distinct.withColumn("order", F.row_number().over(W.partitionBy("d").orderBy(F.xxhash64("first"), "first"))).filter(F.col("order") <= FIT).join(total, "d")
    fits = sample.select("d", "n", "v").groupBy("d").applyInArrow(_fit(k), "d int, cells int, centres binary, probes int").collect()  # a row a dimension, CELLS centres at most
    index = {r["d"]: np.frombuffer(r["centres"]).reshape(-1, r["d"]) for r in fits}
    probes = {r["d"]: r["probes"] for r in fits}
    kind = "d int, ids array<long>, v array<double>, first long, cell int"
    placed = cut(map_arrow(distinct, _assign(index), kind))
    sizes = {(r["d"], r["cell"]): r["n"] for r in placed.groupBy("d", "cell").agg(F.count("*").alias("n")).collect()}  # CELLS a dimension at most
    held = {d: np.array([sizes.get((d, c), 0) for c in range(len(centres))]) for d, centres in index.items()}
    asked = rows.filter("asks").select("d", "id", "v")
    routed = cut(map_arrow(asked, _route(index, probes, held, k), "d int, id long, v array<double>, cell int"))
    came = {(r["d"], r["cell"]): r["n"] for r in routed.groupBy("d", "cell").agg(F.count("*").alias("n")).collect()}

    # Cells with their numbers of blocks and of parts of their queries; nearly all have one of each.
    layout = spark.createDataFrame([(d, c, -(-n // BLOCK), -(-came[d, c] // QUERIES)) for (d, c), n in sizes.items() if (d, c) in came], "d int, cell int, blocks int, parts int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(F.broadcast(layout), ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")).withColumn("part", every("parts")).select("d", "cell", "block", "part", "ids", "v")
    right = routed.join(F.broadcast(layout), ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", every("blocks")).select("d", "cell", "block", "part", "id", "v")
    place = ("d", "cell", "block", "part")
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_compare(k, epsilon), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
