"""Compression of vectors to product codes: a vector is cut into equal parts, each part is coded by the index of the nearest
entry of its position's codebook, and codebooks come from rounds of Lloyd's algorithm over integers.

Rounds are delta-maintained. A table in the shared folder holds every vector with the code it has; a second, of one row an
entry, holds running integer sums and counts of the parts that each entry has. A round assigns all parts (a narrow step)
and then shuffles only what changed: a part that moves is minus its components for the entry it leaves and plus for the one
it joins. A task adds these up before it sends them, so that no entry, however many parts it has, is more than a row a task.
Sums are integers, so that the order of additions cannot change them. Once a round changes nothing, none after it would.

What the driver holds is the codebooks, parts times ENTRIES entries of the vectors' length in all, whatever the input.

Rows: vectors that are null or hold null or non-finite components are left out, and so are vectors whose length is not that
of most rows (of lengths as frequent, the greater). No rows give no rows. An id may be null or repeat: each row is coded in
its own right; where the first codebook is taken, null ids come last and rows that share an id are in order of their
integers' bytes. With fewer rows than ENTRIES codebooks are that much smaller. Vectors without components have error 0. A
length that parts don't divide, and components whose integers reach LIMIT, are errors that say so. Columns besides id, vector
and label are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import Stored, bounded_batches, map_arrow, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are below this; squared distances of up to 2,048 components a part then fit in 63 bits.
LIMIT = 2**25


def quantised(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """df's other columns, the length `size` of each sound vector and its integers `q`, floor(scale * x), as bytes: 2 a
    component where a batch's integers fit, else 4."""
    rest = [f for f in df.schema.fields if f.name != vector]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pc.is_valid(batch.column(vector)))
        column = batch.column(vector)
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
        of = np.repeat(np.arange(len(lengths)), lengths)
        sound = np.bincount(of[~np.isfinite(values)], minlength=len(lengths)) == 0
        whole = np.floor(values[sound[of]] * scale)
        most = np.abs(whole).max(initial=0)
        if most >= LIMIT:
            raise OverflowError(f"a component of {most / scale:g} is beyond {LIMIT} / {scale}")
        ints = whole.astype("<i2" if most < 2**15 else "<i4")
        lengths = lengths[sound]
        at = np.concatenate([[0], np.cumsum(lengths * ints.itemsize)]).astype(np.int32)
        q = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ints.tobytes())])
        kept = batch.filter(pa.array(sound))
        return pa.RecordBatch.from_arrays([*(kept.column(f.name) for f in rest), pa.array(lengths, pa.int32()), q], names=[*(f.name for f in rest), "size", "q"])

    return map_arrow(df, each, StructType([*rest, StructField("size", IntegerType()), StructField("q", BinaryType())]))


def integers(raw: list[bytes], size: int) -> np.ndarray:
    """Rows of integers out of their bytes."""
    out = np.zeros((len(raw), size), np.int64)
    for width, kind in ((2, "<i2"), (4, "<i4")):
        at = [k for k, x in enumerate(raw) if len(x) == width * size]
        if at:
            out[at] = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), size)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of book, squared distance) of each row of x, in whole numbers; of ties the lowest index."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    exact = np.float64 if 4 * max(1, x.shape[1]) * int(most) ** 2 < 2**53 else np.int64  # doubles are whole numbers up to there
    a, b = x.astype(exact), book.astype(exact)
    apart = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    at = apart.argmin(axis=1)
    return at, (apart[np.arange(len(at)), at] + (a * a).sum(axis=1)).astype(np.int64)


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """state with each row's new code, a byte a part, and the code `was` that it had; state: id columns, q, and code unless
    it's the first round."""
    parts, _, width = books.shape
    first = "code" not in state.columns
    rest = [f for f in state.schema.fields if f.name not in ("code", "was")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = integers(batch.column("q").to_pylist(), parts * width)
        code = np.stack([nearest(x[:, k * width : (k + 1) * width], books[k])[0] for k in range(parts)], axis=1).astype(np.uint8)
        new = pa.array([c.tobytes() for c in code], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), new, pa.nulls(len(code), pa.binary()) if first else batch.column("code")], names=[*(f.name for f in rest), "code", "was"])

    return map_arrow(state, each, StructType([*rest, StructField("code", BinaryType()), StructField("was", BinaryType())]))


def moved(state: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): what the last assignment added to and took from each entry, a row an entry that
    changed. Tasks send what they have added up themselves."""
    names = ["n", *(f"s{k}" for k in range(width))]
    changed = state.filter(F.col("was").isNull() | (F.col("was") != F.col("code"))).select("q", "code", "was")
    bounded_batches(state.sparkSession)

    def add(total: np.ndarray, k: int, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
        total[k, :, 0] += sign * np.bincount(entry, minlength=entries)
        for j in range(width):  # sums of a batch are far below 2**53
            total[k, :, 1 + j] += sign * np.bincount(entry, x[:, k * width + j], entries).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            x = integers(batch.column("q").to_pylist(), parts * width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            was = batch.column("was").to_pylist()
            had = np.array([w is not None for w in was], bool)
            old = np.frombuffer(b"".join(w for w in was if w is not None), np.uint8).reshape(-1, parts)
            for k in range(parts):
                other = np.ones(len(code), bool)
                other[had] = code[had, k] != old[:, k]
                add(total, k, code[other, k], x[other], 1)
                gone = old[:, k][other[had]]
                add(total, k, gone, x[had & other], -1)
        part, entry = np.nonzero(total.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), *(pa.array(total[part, entry, j]) for j in range(1 + width))], names=["part", "entry", *names])

    schema = StructType([StructField(c, LongType()) for c in ("part", "entry", *names)])
    return changed.mapInArrow(each, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names])


def trained(state: Stored, books: np.ndarray, rounds: int) -> tuple[Stored, np.ndarray]:
    """(the vectors' table, codebooks) after so many rounds from the codebooks given; a round's tables go once the next has
    written its own."""
    parts, entries, width = books.shape
    sums = None
    for _ in range(rounds):
        past, state = state, stored(assigned(state.rows, books))
        past.forget()
        change = moved(state.rows, parts, entries, width)
        if sums is not None:
            change = sums.rows.unionByName(change).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in change.columns[2:]])
        past, sums = sums, stored(change)
        if past is not None:
            past.forget()
        new = books.copy()  # entries without parts stay
        for part, entry, n, *s in sums.rows.filter("n > 0").collect():  # at most a row an entry
            new[part, entry] = [x // n for x in s]
        if (new == books).all():
            break
        books = new
    if sums is not None:
        sums.forget()
    return state, books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((key, label, code, error), codebooks by part, entry and component): code has two hex digits a part, error is the
    squared distance of a vector's integers from its code's entries."""
    if not 0 < entries <= 256:
        raise ValueError(f"a code's index is a byte, so there can't be {entries} entries")
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    state = stored(quantised(rows, "vector", scale))
    lengths = state.rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    width, state = size // parts, state._replace(rows=state.rows.filter(F.col("size") == size))
    first = state.rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    books = integers([bytes(r["q"]) for r in first], size).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if first:
        state, books = trained(state, books, rounds)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = integers(batch.column("q").to_pylist(), parts * width)
        found = [nearest(x[:, k * width : (k + 1) * width], books[k]) for k in range(parts)]
        code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(f[1] for f in found))], names=coded.names)

    coded = StructType([StructField(key, df.schema[key].dataType), StructField(label, df.schema[label].dataType), StructField("code", StringType()), StructField("error", LongType())])
    done = stored(map_arrow(state.rows, each, coded))
    state.forget()
    return done.rows, books


def restored(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with the vector that each code stands for: its entries' centres, half a step above their floors."""
    parts, entries, width = books.shape

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, parts)
        x = np.concatenate([books[k][code[:, k]] for k in range(parts)], axis=1)
        flat = pa.array(((x + 0.5) / scale).ravel())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (parts * width), pa.int32()), flat)
        return pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, "vector"])

    return map_arrow(codes, each, StructType([*codes.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error, the sum of error over the rows of the same label; rows without a label are one group."""
    total = codes.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("label_error"))
    return codes.join(total, codes[label].eqNullSafe(total["_of"]), "left").drop("_of")
