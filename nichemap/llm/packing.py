"""Best-fit packing of tokenised documents into sequences, after dominance reduction.

A document's ids, then one end id, are cut into pieces of at most `capacity` ids; every piece goes whole into one sequence.
Which pieces share a sequence depends on their lengths only, so the plan is made from the histogram of lengths: at most
`capacity` rows however many documents there are. The reduction (Martello and Toth) fixes a longest piece with one or two
others wherever that set provably dominates every other set with that piece, as often as the counts allow, and so shrinks
the instance; best fit in decreasing order packs what is left, again many sequences at a time. The plan is a list of
runs: `n` pieces of one length, from one rank on, `per` to a sequence, in consecutive sequences at one offset. A sequence
holds fewer than 2 * sqrt(capacity) different lengths, so the number of runs too has a bound set by the capacity alone.

Pieces learn their rank among those of their length from counts by (length, bucket), summed over the buckets, plus a row
number inside the bucket; buckets have a bounded expected size, so that a length held by a third of all pieces is spread.

Null and empty texts are one piece: the end id alone. Very long texts are many pieces, in order. Repeated rows, and rows
with a null or shared doc_id, are packed each in its own right; an empty table gives no rows. Other columns of the documents
play no part; those of pieces handed to `pack` are kept as they are.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Memory, cut, map_arrow, texts_of

CAPACITY, END = 4096, 1
#: Pieces that one bucket of one length holds, about; tokens that a worker remembers in each generation.
BUCKET, REMEMBERED = 5_000, 250_000
#: The vocabulary's own rule for words, on lower-cased text, as this module's classes say it for the characters that are
#: usual: ASCII and Latin letters, marks and signs. Texts with any other character go to the library whole, and so do those
#: that may hold one of its special tokens.
WORDS = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+").findall
_OTHER = re.compile("[^\\t\\n\\x20-\\x7e\\xa1-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u012f\\u0132-\\u017e]").search


def unusual(text: str) -> bool:
    return "<|" in text or _OTHER(text) is not None


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words:
    """The vocabulary's merges for words that are lower-cased and cut already, many in one call: its last tokens of words say
    where each ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        model = Tokenizer.from_file(path).model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # words come once each; the library's own memory only costs time here
        self.own = Tokenizer(model)
        self.own.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        book = self.own.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(book.values()) + 1, bool)
        self.last[[i for token, i in book.items() if token.endswith(model.end_of_word_suffix)]] = True

    def __call__(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        ids = np.array(self.own.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        held, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        return [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(2)
def _words(path: str) -> Words:
    _tokenizer(path)
    return Words(path)


_memory: dict[str, Memory] = {}


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers. Usual texts are cut at white space, which no word of the
    vocabulary's rule spans; each distinct token is worked out once and the rest is arithmetic on arrays."""
    own, encode = _tokenizer(path), _words(path)
    whole = {k: np.array(own.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for k, x in enumerate(texts) if unusual(x)}
    tokens = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(["" if k in whole else x for k, x in enumerate(texts)], pa.string())))
    named = tokens.flatten().dictionary_encode()
    distinct, place = named.dictionary.to_pylist(), named.indices.to_numpy()

    def work_out(new: list[str]) -> list[bytes]:
        cut_up = [WORDS(x) for x in new]
        made = iter(encode(list(chain.from_iterable(cut_up))))
        return [b"".join(next(made) for _ in own) for own in cut_up]

    seen = _memory.setdefault(path, Memory(REMEMBERED)).fill(distinct, work_out)
    parts = [seen[x] for x in distinct]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ids, start, n = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, size[place]
    ends = np.cumsum(n)
    every = ids[np.repeat(start[place] - (ends - n), n) + np.arange(n.sum())]
    edges = np.append(0, ends)[tokens.offsets.to_numpy()].tolist()
    return [whole[k] if k in whole else every[edges[k] : edges[k + 1]].tobytes() for k in range(len(texts))]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with its ids if asked for."""
    kind = dict(df.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for k, ids in enumerate(token_bytes(texts_of(batch), path)):
            ids += end.to_bytes(4, "little")
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                rows.append((k, i, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None))
        row, piece, start, length, crc, held = zip(*rows, strict=True)
        cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols, names = [*cols, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Plan:
    """Runs for a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < k <= capacity for k in counts):
            raise ValueError("a length is not between 1 and the capacity")
        self.capacity, self.sequences = capacity, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for k, n in counts.items():
            self.left[k] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def put(self, length: int, n: int, per: int, sequence: int, offset: int) -> None:
        """n pieces of the length, per to a sequence, from this sequence on."""
        self.runs.append((length, int(self.rank[length]), n, per, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n

    def fix(self, lengths: list[int], times: int) -> None:
        offset = 0
        for length in lengths:
            self.put(length, times, 1, self.sequences, offset)
            offset += length
        self.sequences += times

    def reduce(self) -> None:
        left = self.left
        for j in range(self.capacity, 0, -1):
            while left[j]:
                left[j] -= 1  # the piece itself, while the others are looked at
                there = np.flatnonzero(left[1 : self.capacity - j + 1]) + 1
                few = [int(s) for s in there[:3] for _ in range(min(3, int(left[s])))][:3]
                room, largest = self.capacity - j, int(there[-1]) if len(there) else 0
                chosen: list[int] | None = None
                if not few:
                    chosen = []
                elif largest == room or len(few) == 1 or few[0] + few[1] > room:
                    chosen = [largest]
                elif len(few) == 2 or sum(few) > room:  # at most two more fit
                    at = np.searchsorted(there, room - there, "right") - 1
                    mate = np.where(at >= 0, there[np.maximum(at, 0)], 0)
                    alone = (mate == there) & (left[there] < 2)
                    mate = np.where(alone, np.where(at >= 1, there[np.maximum(at - 1, 0)], 0), mate)
                    k = int(np.argmax(np.where(mate > 0, there + mate, 0)))
                    a, b = sorted((int(there[k]), int(mate[k])), reverse=True)
                    if largest >= a + b:
                        chosen = [largest]
                    elif a == largest and len({j, a, b}) == 3:
                        above = [int(s) for s in there[(there > b) & (there <= a)] for _ in range(min(2, int(left[s]) - (s == a)))][:2]
                        if len(above) < 2 or sum(above) > room:
                            chosen = [a, b]
                left[j] += 1
                if chosen is None:
                    break
                own = [j, *chosen]
                self.fix(own, min(int(left[s]) // own.count(s) for s in own) if chosen else int(left[j]))

    def best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = {}  # free ids -> (first sequence, sequences)
        have = np.zeros(self.capacity + 1, bool)

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                rooms.setdefault(room, []).append((first, n))
                have[room] = True

        for s in np.flatnonzero(self.left)[::-1].tolist():
            while n := int(self.left[s]):
                fits = np.flatnonzero(have[s:])
                if len(fits):
                    room = s + int(fits[0])
                    first, held = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        have[room] = False
                else:
                    room, first = self.capacity, self.sequences
                    held = math.ceil(n / (room // s))
                    self.sequences += held
                per = room // s
                full = min(held, n // per)
                if full:
                    self.put(s, full * per, per, first, self.capacity - room)
                    keep(room - per * s, first, full)
                if full < held and (rest := min(n - full * per, per)):
                    self.put(s, rest, rest, first + full, self.capacity - room)
                    keep(room - rest * s, first + full, 1)
                    full += 1
                keep(room, first + full, held - full)


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """df (pieces, with doc_id, piece and length) with sequence_id and offset added. The pieces, a few numbers each, are
    written to the shared checkpoint folder with a number of their row, from where both passes read them: a row keeps its
    bucket, and rows that are alike, or have no id, are spread like any others."""
    spark, names = df.sparkSession, [f"c{k}" for k in range(len(df.columns))]  # whatever df's columns are called
    size = names[df.columns.index("length")]
    rows = cut(df.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in rows.groupBy(size).count().collect()}  # as many rows as there are lengths
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    key, width = runs[:, 0] * (1 << 48) + runs[:, 1], 1 << 48
    sent = spark.sparkContext.broadcast((runs, key))
    # so many buckets that each has about BUCKET rows of its length
    buckets = F.element_at(F.create_map(*[F.lit(x) for n, many in counts.items() for x in (n, max(1, many // BUCKET))] or [F.lit(0), F.lit(1)]), F.col(size))
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), buckets))
    before = spread.groupBy(size, "_bucket").count().withColumn("_before", F.sum("count").over(W.partitionBy(size).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).select(size, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = spread.withColumn("_rank", F.row_number().over(W.partitionBy(size, "_bucket").orderBy("_row"))).join(before, [size, "_bucket"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, keys = sent.value
        get = lambda k: batch.column(batch.schema.get_field_index(k))
        length, rank = get(size).to_numpy(zero_copy_only=False), get("_rank").to_numpy(zero_copy_only=False)
        own = held[np.searchsorted(keys, length * width + rank, "right") - 1]
        q = rank - own[:, 1]
        cols = [*(get(k) for k in names), pa.array(own[:, 4] + q // own[:, 3]), pa.array(own[:, 5] + q % own[:, 3] * length)]
        return pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    made = StructType([*(StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return map_arrow(ranked.select(*names, "_rank"), run, made).toDF(*df.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """df's documents cut into pieces and packed: a row a piece, with its sequence and place. Texts are tokenised once."""
    return pack(pieces(df, path, capacity, end), capacity)
