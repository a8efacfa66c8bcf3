"""Byte-level BPE encoding and decoding.

A text is split by a pattern into pieces; the bytes of each piece are merged by rank. A segment tree over the byte
positions of a piece holds at its root the least rank of all neighbouring live pairs, the leftmost of equals: the key of
a leaf is rank * width + position, so that plain minimum also settles ties. A merge changes three leaves (the merged
pair, the pair before it, and the position that is gone), each with one walk to the root.

Pieces are merged many at a time: pieces of one width class form a matrix with one tree a row, and each step makes one
merge in every row that still has one. Pieces beyond the widest class, and single calls, use the same tree on lists.

Null text counts as empty; an empty text has no ids. Repeated rows and extra columns are kept apart by row: each input
row gives one output row in its own right, and an empty table gives none. Very long texts are encoded whole; very long
pieces cost n log n, and workers forget them with the batch they came in.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memory, map_arrow, texts_of

WIDTHS = (8, 16, 32, 64)
#: Cells of one matrix of trees, and pieces that a worker remembers in each generation.
CELLS, REMEMBERED = 1 << 20, 400_000
NONE = np.iinfo(np.int64).max


class Ranks:
    """The ranks of one vocabulary file, with every pair of tokens that concatenates to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = {v: k for k, v in self.rank.items()}
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.pair: dict[int, int] = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = r
        # ranks of pairs of bytes by both, and a hash table of all pairs that is probed in steps of one place
        self.bytes = np.full(1 << 16, NONE)
        for a in range(256):
            for b in range(256):
                if (r := self.rank.get(bytes([a, b]))) is not None:
                    self.bytes[a << 8 | b] = r
        bits = max(8, (4 * len(self.pair)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full((1 << bits) + 1, -1), np.full((1 << bits) + 1, NONE)
        left, place = np.array(list(self.pair), np.int64), None
        ranks_left = np.array(list(self.pair.values()), np.int64)
        place = self.slot(left)
        while len(left):
            free = self.keys[place] < 0
            _, first = np.unique(place, return_index=True)
            own = np.zeros(len(left), bool)
            own[first] = True
            own &= free
            self.keys[place[own]], self.values[place[own]] = left[own], ranks_left[own]
            left, ranks_left, place = left[~own], ranks_left[~own], (place[~own] + 1) & ((1 << bits) - 1)
        self.last = (1 << bits) - 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it has none; ids under 0 stand for no token."""
        want = np.where((a < 0) | (b < 0), -2, a << 32 | b)
        at = self.slot(want)
        found = self.keys[at]
        out = np.where(found == want, self.values[at], NONE)
        rest = np.flatnonzero((found != want) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.last
            found = self.keys[at[rest]]
            hit = found == want[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        n = len(piece)
        ids = [int(self.single[x]) for x in piece]
        width = 1 << max(1, (n - 1).bit_length())
        none, tree = 1 << 62, [1 << 62] * (2 * width)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            r = self.pair.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            return none if r is None else r * width + i

        def put(i: int, key: int) -> None:
            tree[node := width + i] = key
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n - 1):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            r, i = divmod(tree[1], width)
            gone = after[i]
            ids[i], after[i] = r, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """The ids of pieces of 2 to width bytes."""
        rows, n = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        held = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(rows, width)
        place = np.arange(width)
        ids = np.where(place < n[:, None], self.single[held], -1)
        after = np.tile(np.append(place[1:], width), (rows, 1))
        before = np.tile(place - 1, (rows, 1))
        ids = np.hstack([ids, np.full((rows, 1), -1)])
        tree = np.full((rows, 2 * width), NONE)
        r = self.bytes[held[:, :-1].astype(np.int64) << 8 | held[:, 1:]]
        r[place[1:] >= n[:, None]] = NONE
        tree[:, width:-1] = np.where(r < NONE, r * width + place[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(rows, level // 2, 2).min(axis=2)
            level //= 2
        row = np.arange(rows)
        while len(row := row[tree[row, 1] < NONE]):
            r, i = np.divmod(tree[row, 1], width)
            gone = after[row, i]
            follows = after[row, gone]
            ids[row, i], ids[row, gone], after[row, i] = r, -1, follows
            inside = follows < width
            before[row[inside], follows[inside]] = i[inside]
            precedes = before[row, i]
            r1 = self.look_up(r, ids[row, follows])
            has = precedes >= 0
            r0 = self.look_up(np.where(has, ids[row, precedes], -1), r)
            leaves = ((row, gone, NONE), (row, i, np.where(r1 < NONE, r1 * width + i, NONE)), (row[has], precedes[has], np.where(r0 < NONE, r0 * width + precedes, NONE)[has]))
            for who, where, key in leaves:
                node = where + width
                tree[who, node] = key
                while width > 1 and len(node) and node[0] > 1:
                    node = node >> 1
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
        live = ids[:, :-1] >= 0
        flat, ends = ids[:, :-1][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for k, piece in enumerate(pieces):
            if (r := self.rank.get(piece)) is not None:
                out[k] = [r]
            elif (w := next((w for w in WIDTHS if len(piece) <= w), None)) is not None:
                classes[w].append(k)
            else:
                out[k] = self.merge_one(piece)
        for w, own in classes.items():
            for at in range(0, len(own), step := CELLS // w):
                some = own[at : at + step]
                for k, ids in zip(some, self.merge_many([pieces[k] for k in some], w), strict=True):
                    out[k] = ids
        return out


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(1)
def _reclassed() -> dict[int, str]:
    """Code points whose class of letter, number or space differs between this module's Unicode tables and those of the
    tiktoken library, each with a usual character of the library's class."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    theirs, ours = {}, {}
    for cls, stand_in in ((r"\p{L}", "\xe9"), (r"\p{N}", "1"), (r"\s", "\u2003")):
        own = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs |= dict.fromkeys(bytes(own.encode_ordinary(every)).decode(), stand_in)
        ours |= dict.fromkeys(regex.findall(cls, every), stand_in)
    return {ord(c): theirs.get(c, "!") for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


#: For texts of usual characters only (ASCII, Latin letters, marks and signs) the standard regular expressions say the same.
_CLASSES = ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"))
_UNUSUAL = re.compile("[^\\t\\n\\x20-\\x7e\\xa1-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u012f\\u0132-\\u017e]").search


_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")


def usual_form(pattern: str):
    """The pattern for the standard regular expressions, compiled; None if it has properties in a class of characters of
    another form than _CLASSES has, or properties, or anything, that they don't know."""
    whole, *single = _CLASSES
    if any("\\p" in c.lower() and c != whole[0] for c in _CLASS.findall(pattern)):
        return None
    for theirs, ours in (whole, *single):
        pattern = pattern.replace(theirs, ours)
    try:
        return None if "\\p" in pattern.lower() else re.compile(pattern)
    except re.error:
        return None


@lru_cache(4)
def splitter(pattern: str):
    """text -> the pieces that the pattern finds, as the tiktoken library finds them."""
    find, table = regex.compile(pattern).finditer, _reclassed()
    plain = regex.compile(pattern).findall
    beyond = re.compile(f"[{chr(min(table, default=0x10FFFF))}-\U0010ffff]").search
    simple = usual_form(pattern)
    usual = simple and simple.findall

    def split(text: str) -> list[str]:
        if usual is not None and not _UNUSUAL(text):
            return usual(text)
        if text.isascii() or not beyond(text) or table.keys().isdisjoint(map(ord, text)):
            return plain(text)
        return [text[slice(*m.span())] for m in find(text.translate(table))]

    return split


def encode(text: str, path: str, pattern: str) -> list[int]:
    return [i for ids in ranks(path).encode_pieces([x.encode() for x in splitter(pattern)(text)]) for i in ids]


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(ranks(path).token.__getitem__, ids))


_memory: dict[str, Memory] = {}


def _known(lists: list[list[str]], path: str) -> dict[str, tuple[str, bytes]]:
    """For every piece its ids, written out, and what these decode to."""
    book = ranks(path)

    def work_out(new: list[str]) -> list[tuple[str, bytes]]:
        return [(",".join(map(str, ids)), b"".join(map(book.token.__getitem__, ids))) for ids in book.encode_pieces([x.encode() for x in new])]

    return _memory.setdefault(path, Memory(REMEMBERED)).fill(set().union(*lists), work_out)


def roundtrip(df: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode each row's text, decode the ids again: doc_id and the outputs asked for, of ids (array of int), decoded
    (binary), n_tokens (long), ids_sha256 (of the decimal ids joined by commas) and decoded_sha256. One row a row of df."""
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    names = {"ids": "array<int>", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = splitter(pattern)
        lists = [find(x) for x in texts_of(batch)]
        known = _known(lists, path)
        made: dict[str, list] = {k: [] for k in outputs}
        for pieces in lists:
            pairs = [known[x] for x in pieces]
            written, back = ",".join([x[0] for x in pairs]), b"".join([x[1] for x in pairs])
            for k in outputs:
                made[k].append(
                    [int(x) for x in written.split(",") if x] if k == "ids" else back if k == "decoded" else written.count(",") + bool(written) if k == "n_tokens" else sha256(written.encode() if k == "ids_sha256" else back).hexdigest()
                )
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[k], kinds[k]) for k in outputs)], ["doc_id", *outputs])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {dict(df.dtypes)['doc_id']}, " + ", ".join(f"{k} {names[k]}" for k in outputs))
