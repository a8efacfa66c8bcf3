"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into three segments. Of two fingerprints with three or fewer differing bits, two
segments differ in one bit at most (pigeonhole). A segment, padded to 23 bits, is decoded with the perfect binary Golay
code: one codeword lies within three bits of it, and five more lie four bits away if the nearest is three away. A segment
of even weight has its nearest codeword's index as its only key, one of odd weight has all of them within four bits. Two
segments that are equal, or differ in one bit (and then in parity), always share a key: the even one's codeword is within
four bits of the other. A fingerprint has a key for each choice of a key in two of its segments; those that share one are
verified bit by bit.

Distinct fingerprints only are compared, so that copies cost nothing. Inside a key, links are put out as a spanning
forest, never as all pairs: small groups by shifted comparison, larger ones by a breadth-first walk in which each
fingerprint leaves the array of those not reached yet. Groups beyond WALK are first split by 16-bit blocks, one of which
any linked pair has in common. Components come from alternating large-star and small-star steps on the links.

A text without words, null included, has fingerprint zero and links like any other; very long texts are hashed whole, in
pieces of bounded size. Null ids take part, but name a component only if it has no other id. Repeated rows each get the same
result. An empty table gives no rows. Other columns play no part in near_duplicates; keep_first keeps them all, whatever they
are called. A fingerprint that very many rows share is one key of the last join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, map_arrow, texts_of

SHINGLE, SEED, BITS = 3, 42, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
#: Groups up to SHIFT are compared by shifts, those beyond WALK are split by blocks of bits.
SHIFT, WALK = 8, 20_000
#: Places that a component's members meet its name in: SALTS, and as many more for every MEMBERS fingerprints there are.
SALTS, MEMBERS = 8, 1_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    if n <= shingle:
        cuts = [(0, len(joined))]
    else:
        cuts = zip([0, *(ends[: n - shingle] + 1).tolist()], ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id, the extra columns and fp, the fingerprint as a signed long."""
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.fromiter(map(fingerprint, texts_of(batch)), np.uint64, batch.num_rows)
        own = [batch.column(k) for k in range(len(extra) + 1)]
        return pa.RecordBatch.from_arrays([*own, pa.array(made.view(np.int64))], ["doc_id", *extra, "fp"])

    return map_arrow(df.select("doc_id", *extra, "text"), run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *extra)) + ", fp long")


# The polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of least weight, its weight, and the indices of the codewords that lead from the nearest
    codeword to those four bits from the word (where the error has weight 3). And each 12-bit index's check bits."""

    def check(data: int) -> int:
        r = data << 11
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        return r

    checks = np.array([check(d) for d in range(4096)], np.int64)
    syndrome = lambda v: int(checks[v >> 11] ^ (v & 2047))
    error, weight, more = np.zeros(2048, np.int64), np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    for w in (1, 2, 3):
        for at in combinations(range(23), w):
            e = sum(1 << k for k in at)
            error[syndrome(e)], weight[syndrome(e)] = e, w
    filled = np.zeros(2048, np.int64)
    for d in range(4096):
        word = int(d << 11 | checks[d])
        if word.bit_count() == 7:
            for at in combinations([k for k in range(23) if word >> k & 1], 3):
                s = syndrome(sum(1 << k for k in at))
                more[s, filled[s]] = d
                filled[s] += 1
    return error, weight, more, checks


def segment_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six key columns, and whether the last five hold."""
    error, weight, more, checks = _golay()
    s = checks[v >> 11] ^ (v & 2047)
    home = (v ^ error[s]) >> 11
    several = (weight[s] == 3) & (np.bitwise_count(v) % 2 == 1)
    return np.hstack([home[:, None], home[:, None] ^ more[s]]), several


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints, keys as ints of 26 bits."""
    own = [segment_keys((fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)) for first, bits in SEGMENTS]
    rows, out = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        for a in range(6):
            for b in range(6):
                has = np.ones(len(fps), bool)
                if a:
                    has &= own[i][1]
                if b:
                    has &= own[j][1]
                at = np.flatnonzero(has)
                rows.append(at)
                out.append(n << 24 | own[i][0][at, a] << 12 | own[j][0][at, b])
    return np.concatenate(rows), np.concatenate(out)


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected among distinct fingerprints, at most one for each of them and block."""
    if len(fps) > WALK:
        out = []
        for shift in range(0, 64, 16):
            block = fps >> np.uint64(shift) & np.uint64(0xFFFF)
            order = np.argsort(block, kind="stable")
            for run in np.split(fps[order], np.flatnonzero(np.diff(block[order])) + 1):
                out += _walk(run, bits) if len(run) > 1 else []
        return out
    return _walk(fps, bits)


def _walk(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(rest ^ u) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append((np.full(len(found), u), found))
                queue.extend(found)
    return out


def _links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each key; key is sorted."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(size, size)
    a, b = [], []
    small = np.flatnonzero((group > 1) & (group <= SHIFT))
    k, f = key[small], fps[small]
    for shift in range(1, SHIFT):
        at = np.flatnonzero((k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= BITS)) if len(k) > shift else []
        if len(at):
            a.append(f[at])
            b.append(f[at + shift])
    for s, n in zip(start[size > SHIFT], size[size > SHIFT], strict=True):
        for u, v in forest(fps[s : s + n]):
            a.append(u)
            b.append(v)
    none = np.array([], np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a > b: links of up to three differing bits that connect all that is connected; distinct has fp."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = keys(fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fps[row])], ["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def put(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in _links(key, fps.view(np.uint64)))
            both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held and held[-1][0][-1] == key[-1]:
                held.append((key, fps))  # all of one key so far, or its end
                continue
            last = int(np.searchsorted(key, key[-1]))
            held.append((key[:last], fps[:last]))
            yield put(*(np.concatenate([x[i] for x in held]) for i in (0, 1))) if sum(len(x[0]) for x in held) else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            held = [(key[last:], fps[last:])]
        if held:
            yield put(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))

    spark = distinct.sparkSession
    rows = map_arrow(distinct.select("fp"), spread, "key int, fp long").repartition("key").sortWithinPartitions("key")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    return rows.mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge (a, b), by large-star and small-star steps."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(down.join(small, "a").select(F.col("b").alias("x"), F.col("a"), "m").select(F.explode(F.array(F.col("x"), F.col("a"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        state = now


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id of those that links lead to; a row a row of df."""
    fps = cut(fingerprints(df))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(first))
    bounded_batches(df.sparkSession)
    joined = joined.withColumnRenamed("node", "fp")
    # A large component's members meet its name in several places, by a hash of the member.
    salts = SALTS * (1 + joined.count() // MEMBERS)
    members = first.join(joined, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)))
    names = members.groupBy("root").agg(F.min("first").alias("component_id"))
    # a component of a few members has them in a few places only; which ones, their hashes say
    names = names.join(members.select("root", "salt").distinct(), "root").select("root", "salt", "component_id")
    alone = first.join(joined, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    named = members.join(names.hint("merge"), ["root", "salt"]).select("fp", "component_id").unionByName(alone)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(df: DataFrame) -> DataFrame:
    """Of each component of near-duplicates one row, with all columns of df: the one with the least doc_id, null last, then
    the least fingerprint and hash of the text. A row is known by doc_id and two hashes of its text, so that others with its
    doc_id stay or go by their own component; of rows that are alike in both, one stays."""
    names = [f"c{k}" for k in range(len(df.columns))]  # whatever df's columns are called
    doc_id, text = (names[df.columns.index(c)] for c in ("doc_id", "text"))
    hashed = df.toDF(*names).withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit("second"), text)})
    fps = cut(fingerprints(hashed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "_h1", "_h2"), "_h1", "_h2"))
    copies = fps.groupBy("fp", "doc_id", "_h1", "_h2").agg(F.count("*").alias("_copies"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "fp", "_h1", "_h2", "_copies")).alias("_best")
    first = copies.groupBy("fp").agg(best)
    joined = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    bounded_batches(df.sparkSession)
    # a component's key is its least fingerprint: names may be null, or shared by components
    named = first.join(joined, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("_best").alias("_best"))
    kept = cut(named.select(F.col("_best.doc_id").alias("_kept"), F.col("_best._h1").alias("_k1"), F.col("_best._h2").alias("_k2"), F.col("_best._copies").alias("_copies")))
    own = hashed[doc_id].eqNullSafe(kept["_kept"]) & (hashed["_h1"] == kept["_k1"]) & (hashed["_h2"] == kept["_k2"])
    stay = hashed.join(kept.hint("shuffle_hash"), own, "left_semi")
    one = stay.dropDuplicates([doc_id, "_h1", "_h2"]) if kept.filter("_copies > 1").limit(1).count() else stay
    return one.drop("_h1", "_h2").toDF(*df.columns)
