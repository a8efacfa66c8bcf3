"""Spans of a text, (kind, start, end) in code points with the end exclusive: written down, hashed and put into columns.

Null and empty texts have no spans. Repeated rows each get their own result, an empty table gives no rows, and columns of the
table with the names of results don't clash with them, as only doc_id and the text are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

Span = tuple[str, int, int]


class Cover:
    """What a set of spans covers, asked in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for a, b in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def touches(self, a: int, b: int) -> bool:
        """Whether any of a to b is covered."""
        k = bisect_right(self.end, a)
        return k < len(self.start) and self.start[k] < b

    def holds(self, a: int, b: int) -> bool:
        """Whether all of a to b is covered, by spans that follow each other without a gap."""
        k = bisect_right(self.start, a) - 1
        return k >= 0 and b <= self.end[k]

    def edges(self, a: int, b: int) -> bool:
        """Whether a covered stretch is cut by an end of a to b."""
        i, j = bisect_right(self.end, a), bisect_left(self.start, b) - 1
        return i < len(self.start) and self.start[i] < a or j >= 0 and self.end[j] > b


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def digest(df: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...], base: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256, and spans: those of the base and those that the method adds."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(x) for x in texts_of(batch)]
        counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in base]
        shas = pa.array([sha256(written(own, kinds).encode()).hexdigest() for own, _ in found], pa.string())
        both = pa.array([written(own + more, kinds) for own, more in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, both], ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {dict(df.dtypes)['doc_id']}, {', '.join(f'n_{k} long' for k in base)}, base_sha256 string, spans string")


def rows(df: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]]) -> DataFrame:
    """A row a span: doc_id, kind, start, end, added (by the method) and surface, the text of the span."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(k, *s, more, text[s[1] : s[2]]) for k, text in enumerate(texts_of(batch)) for more, own in enumerate(find(text)) for s in own]
        at, kind, start, end, added, surface = zip(*out, strict=True) if out else ((),) * 6
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(map(bool, added), pa.bool_()), pa.array(surface, pa.string())], ["doc_id", "kind", "start", "end", "added", "surface"])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {dict(df.dtypes)['doc_id']}, kind string, start long, end long, added boolean, surface string")


def masked(text: str, spans: list[Span]) -> str:
    """text with each stretch of overlapping spans replaced by the kind of its first."""
    out, at, done = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = done = max(done, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], column: str = "text") -> DataFrame:
    """df with the spans in the column masked; null stays null, and every other column stays as it is."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index(column)
        new = pa.array([None if x is None else masked(x, sum(find(x), [])) for x in batch.column(k).to_pylist()], batch.schema.field(k).type)
        return batch.set_column(k, batch.schema.field(k), new)

    return map_arrow(df, run, df.schema)
