"""Substring dedup by fixed-block anchors.

Of each run of `window` words that occurs more than once all occurrences but the first (least doc_id, then least start)
have their words removed. Every window holds a whole block of `block` words that starts at a multiple of `block`, as
2 * block - 1 <= window. So the hashes of these non-overlapping blocks are the index, every rolling block-wide hash of
every text is a probe, and a probe that the index knows from another place is an anchor. Around anchors, and only there,
anchors are extended word by word: all windows that hold one are keyed by 96 bits, the first place of each key is found,
and the windows elsewhere, which lie in runs, add up to the maximal exact repeats.

Texts are dealt into chunks of about CHUNK characters by a hash of the row and of the partition that it lies in, once: all
three passes read the same exchange. A chunk sends its distinct probes to buckets of the hash range as packed sorted
differences, a few bytes each, not a row each, so that a common passage costs a chunk one probe; a bucket answers each chunk
with the chunk's own anchors. Windows travel in the same way: a chunk sends each distinct window once, with its least place,
however often it has it, and hears of those that another chunk has earlier; which of its own places are later it knows
itself. So a group is one entry a chunk at most, whatever the number of copies, and chunks and buckets grow with the square
root of the input beyond LAYOUT, so that what they send each other stays worth a row.

Words are `[^\\x20\\x09-\\x0D]+`; null text has none. Rows that repeat a doc_id count as the same document: a window is
removed only if an earlier (doc_id, start) has it, so equal rows leave each other alone. A null doc_id counts as the least.
Very long texts are one row of a chunk each, whole. An empty table gives no rows. Columns of the table may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW, BLOCK = 20, 10
#: Characters of text in a chunk and characters of text whose probes a bucket holds, about.
CHUNK, BUCKET = 4 << 20, 12 << 20
#: Characters of input from which chunks and buckets grow, and how many times at most.
LAYOUT, GROWN = 1 << 36, 16
#: Bits of a probe's hash at least, and over the logarithm of the number of characters.
BITS, OVER = 40, 10
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of width words, by doubling."""
    out, done, step, span, factor = None, 0, hashes, 1, int(base)
    n = len(hashes) - width + 1
    while width:
        if width & 1:
            out = step[done : done + n].copy() if out is None else out * np.uint64(factor) + step[done : done + n]
            done += span
        width >>= 1
        if width:
            step, span, factor = step[:-span] * np.uint64(factor) + step[span:], 2 * span, factor * factor & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def packed(values: np.ndarray, *planes: np.ndarray) -> bytes:
    """Sorted values as differences in as few bytes as suit them, then each plane as it is."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    sizes = [(n * w + 12 * int((gaps >= np.uint64((1 << 8 * w) - 1)).sum()), w) for w in (1, 2, 3, 4, 5, 6)]
    _, w = min(sizes)
    most = np.uint64((1 << 8 * w) - 1)
    large = np.flatnonzero(gaps >= most)
    head = np.array([n, w, len(large)], "<u4").tobytes()
    low = np.ascontiguousarray(np.minimum(gaps, most)).view(np.uint8).reshape(-1, 8)[:, :w].tobytes()
    return head + low + large.astype("<u4").tobytes() + gaps[large].tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in planes)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, w, k = np.frombuffer(blob, "<u4", 3).tolist()
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :w] = np.frombuffer(blob, np.uint8, n * w, 12).reshape(n, w)
    gaps = gaps.view("<u8").reshape(n)
    at = 12 + n * w
    if k:
        gaps[np.frombuffer(blob, "<u4", k, at)] = np.frombuffer(blob, "<u8", k, at + 4 * k)
        at += 12 * k
    out = [np.cumsum(gaps, dtype=np.uint64)]
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * out[-1].itemsize
    return out


def _rows(chunk: pa.Table) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, place in the chunk) in an order that is the same in each pass."""
    ids, texts = chunk.column("_id").to_pylist(), chunk.column("_text").to_pylist()
    return sorted((-(1 << 63) if i is None else i, t or b"", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True)))


def _spread(hashes: np.ndarray, bits: int, shift: int, planes: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Bucket and blob of each stretch of sorted hashes with the same top bits."""
    bucket = (hashes >> np.uint64(bits - shift)).astype(np.int64) if shift else np.zeros(len(hashes), np.int64)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    cuts = list(zip([0, *edge.tolist()], [*edge.tolist(), len(hashes)], strict=True))
    return [int(bucket[a]) for a, _ in cuts], [packed(hashes[a:b], *(p[a:b] for p in planes)) for a, b in cuts]


def _table(names: list[str], kinds: list[pa.DataType], columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_BUCKETED = ["_bucket", "_chunk", "_docs", "_blob"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_REPLY = ["_chunk", "_blob"], [pa.int64(), pa.binary()]


def _probe(bits: int, shift: int, window: int, block: int) -> Callable[[pa.Table], pa.Table]:
    def run(chunk: pa.Table) -> pa.Table:
        own, aligned = [], []
        for _, text, _ in _rows(chunk):
            words = text.split()
            if len(words) >= window:
                h = rolling(word_hashes(words), block, _A) >> np.uint64(64 - bits)
                own.append(h)
                aligned.append(np.arange(len(h)) % block == 0)
        if not own:
            return _table(*_BUCKETED, [[], [], [], []])
        h, a = np.concatenate(own), np.concatenate(aligned)
        order = np.argsort(h)
        h, a = h[order], a[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        flags = (np.diff(np.append(first, len(h))) > 1) + 2 * (np.add.reduceat(a, first) > 0)
        buckets, blobs = _spread(h[first], bits, shift, [flags.astype(np.uint8)])
        key = chunk.column("_chunk")[0].as_py()
        return _table(*_BUCKETED, [buckets, [key] * len(buckets), [None] * len(buckets), blobs])

    return run


def _anchors(bucket: pa.Table) -> pa.Table:
    """To each chunk those of its probes that are in the index and stand in another place too."""
    keys = bucket.column("_chunk").to_pylist()
    own = [unpacked(x, "u1") for x in bucket.column("_blob").to_pylist()]
    h, flags = (np.concatenate([x[i] for x in own]) for i in (0, 1))
    chunk = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
    order = np.argsort(h, kind="stable")
    h, flags, chunk = h[order], flags[order], chunk[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    union = np.bitwise_or.reduceat(flags, first)
    hit = np.repeat((union >= 2) & ((size > 1) | (union % 2 == 1)), size)
    h, chunk = h[hit], chunk[hit]
    order = np.argsort(chunk, kind="stable")
    h, chunk = h[order], chunk[order]
    edge = np.searchsorted(chunk, np.arange(len(own) + 1))
    some = [k for k in range(len(own)) if edge[k] < edge[k + 1]]
    return _table(*_REPLY, [[keys[k] for k in some], [packed(h[edge[k] : edge[k + 1]]) for k in some]])


def _groups(a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows by their hash, then place; and where in it each window's places begin."""
    order = np.lexsort((start, doc, b, a))
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _second(words: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """32 more bits of the hash of the windows at these places."""
    return (rolling(words ^ words >> np.uint64(17), window, _B)[at] >> np.uint64(32)).astype("<u4")


def _extend(bits: int, shift: int, window: int, block: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows or not replies.num_rows:
            return _table(*_BUCKETED, [[], [], [], []])
        known = np.sort(np.concatenate([unpacked(x)[0] for x in replies.column("_blob").to_pylist()]))
        docs, a, b, place, base = [], [], [], [], 0
        for doc_id, text, _ in _rows(chunk):
            words = text.split()
            docs.append((doc_id, base))
            if len(words) >= window:
                w = word_hashes(words)
                h = rolling(w, block, _A) >> np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hits = np.concatenate([[0], np.cumsum(known[at] == h)])
                starts = np.flatnonzero(hits[window - block + 1 :] > hits[: len(words) - window + 1])
                if len(starts):
                    a.append(rolling(w, window, _A)[starts])
                    b.append(_second(w, window, starts))
                    place.append(starts + base)
            base += len(words)
        if not a:
            return _table(*_BUCKETED, [[], [], [], []])
        a, b, place, every = np.concatenate(a), np.concatenate(b), np.concatenate(place), np.array(docs, "<i8")
        at = np.searchsorted(every[:, 1], place, "right") - 1
        order, first = _groups(a, b, every[at, 0], place - every[at, 1])
        own = order[first]  # each window once, at its least place
        buckets, blobs = _spread(a[own], 64, shift, [b[own], place[own].astype("<u4")])
        key = chunk.column("_chunk")[0].as_py()
        # each blob with the documents that it needs, no others
        helds = [every[np.unique(np.searchsorted(every[:, 1], unpacked(x, "<u4", "<u4")[2], "right") - 1)].tobytes() for x in blobs]
        return _table(*_BUCKETED, [buckets, [key] * len(buckets), helds, blobs])

    return run


def _first(bucket: pa.Table) -> pa.Table:
    """To each chunk its windows that another chunk has at an earlier place."""
    keys = bucket.column("_chunk").to_pylist()
    a, b, chunk, doc, start = [], [], [], [], []
    for k, (held, blob) in enumerate(zip(bucket.column("_docs").to_pylist(), bucket.column("_blob").to_pylist(), strict=True)):
        x, y, z = unpacked(blob, "<u4", "<u4")
        docs = np.frombuffer(held, "<i8").reshape(-1, 2)
        at = np.searchsorted(docs[:, 1], z, "right") - 1
        a.append(x)
        b.append(y)
        chunk.append(np.full(len(x), k))
        doc.append(docs[at, 0])
        start.append(z - docs[at, 1])
    a, b, chunk, doc, start = map(np.concatenate, (a, b, chunk, doc, start))
    order, first = _groups(a, b, doc, start)
    a, b, chunk, doc, start = (x[order] for x in (a, b, chunk, doc, start))
    lead = np.repeat(first, np.diff(np.append(first, len(a))))
    later = (doc != doc[lead]) | (start != start[lead])
    a, b, chunk = a[later], b[later], chunk[later]
    order = np.argsort(chunk, kind="stable")  # within a chunk by hash, as before
    a, b, chunk = a[order], b[order], chunk[order]
    edge = np.searchsorted(chunk, np.arange(len(keys) + 1))
    some = [k for k in range(len(keys)) if edge[k] < edge[k + 1]]
    return _table(*_REPLY, [[keys[k] for k in some], [packed(a[edge[k] : edge[k + 1]], b[edge[k] : edge[k + 1]]) for k in some]])


def _later(rows: list[tuple[int, list[bytes], int]], replies: list[bytes], window: int) -> np.ndarray:
    """Places in the chunk, sorted, of windows that an earlier place has too, there or here. rows: (doc_id, words, place)."""
    none = np.array([], np.int64)
    own = [(doc_id, base, word_hashes(words)) for doc_id, words, base in rows if len(words) >= window]
    if not own:
        return none
    hashed = [rolling(w, window, _A) for *_, w in own]
    size = np.array([len(x) for x in hashed])
    a = np.concatenate(hashed)
    ranked = np.sort(a)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    told = [unpacked(x, "<u4") for x in replies]
    there = np.concatenate([x for x, _ in told]) if told else np.array([], np.uint64)
    wanted = np.union1d(twice, there)
    if not len(wanted):
        return none
    at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, a), len(wanted) - 1)] == a)
    edge = np.cumsum(size) - size
    of = np.searchsorted(edge, at, "right") - 1
    start = at - edge[of]
    cuts = np.searchsorted(of, np.arange(len(own) + 1))
    b = np.concatenate([_second(own[k][2], window, start[x:y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y])
    doc, base = (np.array([x[k] for x in own], np.int64)[of] for k in (0, 1))
    order, first = _groups(a[at], b, doc, start)
    length = np.diff(np.append(first, len(order)))
    lead = order[np.repeat(first, length)]
    gone = (doc[order] != doc[lead]) | (start[order] != start[lead])
    if told:
        known = set(zip(there.tolist(), np.concatenate([y for _, y in told]).tolist(), strict=True))
        heads = order[first]
        gone |= np.repeat([x in known for x in zip(a[at][heads].tolist(), b[heads].tolist(), strict=True)], length)
    return np.sort((start + base)[order[gone]])


OUTPUTS = {"n_words": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "kept_sha256": ("string", pa.string()), "kept": ("string", pa.string()), "text": ("string", pa.string()), "removed": ("array<struct<start:int,end:int>>", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}


def _remove(outputs: tuple[str, ...], names: list[str], window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        rows, texts, base = [], [], 0
        texts_in = chunk.column("_text")
        for doc_id, text, k in _rows(chunk):
            rows.append((doc_id, words := text.split(), base))
            texts.append((text if texts_in[k].is_valid else None, k))
            base += len(words)
        gone = _later(rows, replies.column("_blob").to_pylist() if replies.num_rows else [], window)
        made: dict[str, list] = {k: [] for k in outputs}
        for (_, words, base), (text, _) in zip(rows, texts, strict=True):
            n = len(words)
            starts = gone[np.searchsorted(gone, base) : np.searchsorted(gone, base + n)] - base
            edges: list[tuple[int, int]] = []
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > window)
                edges = list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + window).tolist(), strict=True))
                kept, at = [], 0
                for x, y in edges:
                    kept += words[at:x]
                    at = y
                words = kept + words[at:]
            joined = b" ".join(words)
            values = {"n_words": n, "n_removed": n - len(words), "removed": [{"start": x, "end": y} for x, y in edges]}
            for name in outputs:
                if name == "text":
                    value = joined.decode() if edges else None if text is None else text.decode()
                else:
                    value = values[name] if name in values else sha256(joined).hexdigest() if name == "kept_sha256" else joined.decode()
                made[name].append(value)
        order = pa.array([k for _, k in texts], pa.int64())
        return pa.table([*(chunk.column(x).take(order) for x in names), *(pa.array(made[k], OUTPUTS[k][1]) for k in outputs)], [*names, *outputs])

    return run


def dedup(df: DataFrame, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept", "removed"), carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row a row of df: the columns named in carry, and the outputs asked for, of n_words, n_removed, kept (the kept words
    joined by one space), kept_sha256, text (the same as kept where words were removed, else the text as it was) and removed
    (the removed stretches as word positions, end exclusive)."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole aligned block")
    spark = df.sparkSession
    bounded_batches(spark)
    size = df.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(BITS, math.ceil(math.log2(size + 2)) + OVER)
    grown = min(GROWN, max(1.0, math.sqrt(size / LAYOUT)))
    chunk, bucket = round(CHUNK * grown), round(BUCKET * grown)
    chunks, shift = max(1, size // chunk), max(0, math.ceil(math.log2(size / bucket))) if size > bucket else 0
    # Columns of df keep names of their own inside, whatever df calls them.
    names = [f"c{k}" for k in range(len(carry))]
    dealt = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"), F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).alias("_chunk"))
    bucketed, reply = "_bucket int, _chunk long, _docs binary, _blob binary", "_chunk long, _blob binary"
    by_chunk = dealt.groupBy("_chunk")
    anchors = by_chunk.applyInArrow(_probe(bits, shift, window, block), bucketed).groupBy("_bucket").applyInArrow(_anchors, reply)
    windows = by_chunk.cogroup(anchors.groupBy("_chunk")).applyInArrow(_extend(bits, shift, window, block), bucketed)
    later = windows.groupBy("_bucket").applyInArrow(_first, reply)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(carry, names, strict=True)), *(f"{k} {OUTPUTS[k][0]}" for k in outputs)])
    out = by_chunk.cogroup(later.groupBy("_chunk")).applyInArrow(_remove(outputs, names, window), schema)
    return out.toDF(*carry, *outputs)


def without_repeats(df: DataFrame) -> DataFrame:
    """df with the repeats taken out of text: a text that loses words becomes its kept words joined by one space, and its
    n_chars, if df has that column, their length; other texts, null too, stay as they are."""
    columns = df.columns
    carry = [c for c in columns if c != "text"]
    places = [f"c{k}" for k in range(len(carry))]
    out = dedup(df, ("n_removed", "text"), tuple(carry)).toDF(*places, "gone", "text")
    own = dict(zip(carry, places, strict=True)) | {"text": "text"}
    new = {c: F.col(own[c]) for c in columns}
    if "n_chars" in own:
        new["n_chars"] = F.when(F.col("gone") > 0, F.length("text")).otherwise(F.col(own["n_chars"])).cast(dict(df.dtypes)["n_chars"])
    return out.select(*(new[c].alias(c) for c in columns))
