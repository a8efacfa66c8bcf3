"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its words, the beginnings of its words, and the
logarithm of the number of sentences around it; a document's score is the noisy-or of its sentences' scores, one minus the
product of their complements. Only documents have labels; weights are fitted by gradient steps through the noisy-or, so
that the sentences that explain a label get its weight, and `sentences` then points to them.

Fitting takes a bounded sample of labelled rows: at most `SAMPLE` ids of either label, chosen by a hash of doc_id, one text
an id, of at most `LONGEST` characters. Executors count the sample's features and turn its texts into features; the driver
gets the `FEATURES` that tell the labels apart best, and for each text of the sample the numbers of those it has. Everything
else covers all rows. Without labels of both kinds every score is 0. Null and empty texts score what a text without
sentences scores, 0; very long ones are scored whole. A doc_id that has several labels counts as toxic if one of them says
so; of the rows that share an id the one with the least text is learned from, and each is scored. Rows without an id are
scored and not learned from. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, texts_of

#: Labelled ids of either kind that are fitted at most, and the longest text of them in characters.
SAMPLE, LONGEST = 4_000, 100_000
#: Features kept (of 100, 300, 1,000 and 3,000, measured on held-out labels, 300 has the best recall without losing precision;
#: beyond, rare words are learned by heart), the documents that a feature must be in, and the lengths of beginnings of words.
FEATURES, LEAST, HEADS = 300, 4, (4, 5, 6, 7)
STEPS, RATE, DECAY = 400, 0.05, 3e-4
CUT = 0.7
#: Words that a worker remembers, and the most characters of one.
REMEMBERED, LONG_WORD = 500_000, 256

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]").findall
_STOP = frozenset(".!?\n")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in HEADS if len(word) > n)]


def sentences_of(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for x in _TOKEN(text.lower()):
        if x in _STOP:
            if out[-1]:
                out.append([])
        else:
            out[-1].append(x)
    return [x for x in out if x]


@dataclass
class Model:
    """A sentence's log-odds: bias + per_log * log(sentences) + the weights of its features."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = float("-inf")
    per_log: float = 0.0

    def of_word(self, word: str) -> float:
        get = self.weight.get
        return sum(get(x, 0.0) for x in features_of(word))

    def sentence_scores(self, text: str) -> np.ndarray:
        own = [sum(map(self.of_word, s)) for s in sentences_of(text)]
        return self._scores(np.array(own))

    def _scores(self, z: np.ndarray) -> np.ndarray:
        if np.isneginf(self.bias):
            return np.zeros(len(z))
        return 1 / (1 + np.exp(-np.clip(z + self.bias + self.per_log * np.log(max(1, len(z))), -700, 700)))

    def score(self, text: str) -> float:
        p = self.sentence_scores(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(names: list[str], bags: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Model:
    """A model over the named features. A bag is a text: its label, its number of sentences, and for each time that a named
    feature is in it the feature's number and the sentence's."""
    labels = np.array([y for y, *_ in bags], float)
    if not bags or labels.min() == labels.max():
        return Model()
    sizes = np.array([n for _, n, _, _ in bags])
    first = np.cumsum(sizes) - sizes
    feature = np.concatenate([f for _, _, f, _ in bags])
    place = np.concatenate([at + k for (_, _, _, at), k in zip(bags, first, strict=True)])
    s = int(sizes.sum())
    doc = np.repeat(np.arange(len(bags)), sizes)
    logs = np.log(np.maximum(sizes, 1))[doc]
    share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(bags) - labels.sum())) * 2
    share = 0.5 * share + 0.5 / len(bags)  # between even classes and even documents
    # Adam on the negative log-likelihood of the noisy-or
    theta = np.zeros(len(names) + 2)
    theta[-2], theta[-1] = -3.0, -0.5
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        z = np.bincount(place, theta[feature], s) + theta[-2] + theta[-1] * logs
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))  # log of the chance that no sentence is toxic
        whole = -np.expm1(none)
        slope = np.where(labels > 0, -np.exp(none) / np.maximum(whole, 1e-9), 1.0) * share  # by the sum of p, as d(-none)/dz = p
        g_z = slope[doc] * p
        g = np.append(np.bincount(feature, g_z[place], len(names)) + DECAY * theta[:-2], [g_z.sum(), (g_z * logs).sum()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(theta[k]) for k, f in enumerate(names) if abs(theta[k]) > 1e-3}, float(theta[-2]), float(theta[-1]))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sample_of(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the rows that are learned from, texts that occur twice once."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("_order", F.xxhash64("doc_id"))
    chosen = own.filter("toxic = 1").orderBy("_order", "doc_id").limit(sample).union(own.filter("toxic = 0").orderBy("_order", "doc_id").limit(sample))
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= LONGEST)
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most 2 * sample ids
    return one.select("text", F.col("toxic").cast("int").alias("toxic")).distinct()


def best_features(rows: DataFrame, most: int = FEATURES, least: int = LEAST) -> list[str]:
    """The features whose shares of texts differ most between the labels, in units of their spread."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[tuple[str, int]] = Counter()
        for text, y in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
            seen.update({(f, y) for w in set(_TOKEN(text.lower())) - _STOP for f in features_of(w)})
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["feature", "toxic", "n"])

    n1, n0 = rows.agg(F.count_if(F.col("toxic") == 1) + 1, F.count_if(F.col("toxic") == 0) + 1).first()
    counts = map_arrow(rows.select("text", "toxic"), count, "feature string, toxic int, n long").groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)).alias(k) for y, k in ((1, "a"), (0, "b"))))
    share = F.least((F.col("a") + F.col("b")) / F.lit(n1 + n0), F.lit(0.999))
    worth = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return [r[0] for r in counts.filter(F.col("a") + F.col("b") >= least).orderBy(worth.desc(), "feature").limit(most).collect()]


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """A model from labels (doc_id, toxic) of rows of df (doc_id, text) that aren't held out."""
    rows = cut(sample_of(df, labels, sample))
    names = best_features(rows, most)
    number = {f: k for k, f in enumerate(names)}

    def bag(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, y in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
            sentences = sentences_of(text)
            own = [(number[f], k) for k, s in enumerate(sentences) for w in s for f in features_of(w) if f in number]
            feature, place = (np.array([x[i] for x in own], "<i4").tobytes() for i in (0, 1))
            out.append((zlib.crc32(text.encode()), y, len(sentences), feature, place))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["key", "toxic", "sentences", "feature", "place"])

    bags = sorted(tuple(r) for r in map_arrow(rows.select("text", "toxic"), bag, "key long, toxic int, sentences int, feature binary, place binary").collect())
    return fit(names, [(y, n, np.frombuffer(f, "<i4"), np.frombuffer(p, "<i4")) for _, y, n, f, p in bags])


_memory: dict[int, dict[str, float]] = {}


class Scorer:
    """Scores texts with a model, word weights remembered by each worker."""

    def __init__(self, model: Model):
        self.model = model
        self.key = zlib.crc32(repr(sorted(model.weight.items())).encode())

    def __call__(self, texts: list[str]) -> list[float]:
        if self.key not in _memory or len(_memory[self.key]) > REMEMBERED:
            _memory.clear()  # of an earlier model, or too much
        known = _memory.setdefault(self.key, {})
        out = []
        stop = float("inf")
        of = self.model.of_word
        for text in texts:
            tokens = _TOKEN(text.lower())
            seldom = {}
            for x in set(tokens):
                if x not in known:
                    (known if len(x) <= LONG_WORD else seldom)[x] = stop if x in _STOP else of(x)
            get = known.__getitem__ if not seldom else lambda x, own=seldom: own[x] if x in own else known[x]
            w = np.fromiter(map(get, tokens), float, len(tokens))
            ends = np.isinf(w)
            first = np.flatnonzero(~ends & np.concatenate([[True], ends[:-1]]))
            if not len(first):
                out.append(0.0)
                continue
            w[ends] = 0.0
            p = self.model._scores(np.add.reduceat(w, first))
            out.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
        return out


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    scorer = Scorer(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(texts_of(batch)), pa.float64())], ["doc_id", "score"])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {dict(df.dtypes)['doc_id']}, score double")


def sentences(df: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, sentence (from 0), score and its words, for sentences that score `least` or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, text in enumerate(texts_of(batch)):
            own = sentences_of(text)
            out += [(k, i, float(p), " ".join(own[i])) for i, p in enumerate(model.sentence_scores(text)) if p >= least]
        row, at, p, words = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(p, pa.float64()), pa.array(words, pa.string())], ["doc_id", "sentence", "score", "words"])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {dict(df.dtypes)['doc_id']}, sentence int, score double, words string")
