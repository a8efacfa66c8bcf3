"""Secrets: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order chains over characters, one of random strings and one of ordinary identifiers, are fitted to labelled
samples with add-one smoothing. A token of the text is scored by the difference of its log-likelihoods under the two; the
threshold is the least at which no ordinary sample string held out of the fit is taken for random, plus a margin. Tokens
over it that overlap no base span are added as kind "random".

Samples come from two places. `default_samples` draws random strings by a seeded rule and builds ordinary identifiers from
a list of words by rules for identifiers, paths, dates, numbers and plain prose words; the threshold is found on these.
`labelled` takes strings from the texts themselves, at most SAMPLE of either label from about SAMPLE texts by a hash of doc_id:
what the base patterns hold counts as random, other long words as ordinary. These are added to the fit only, as some of the
unknown words may be secrets; so the chains know the corpus's own languages and names. `train` takes any labelled strings.

Null and empty texts have no spans. Time is in proportion to the text, but for a sorted look-up of each find among the base
spans. Repeated rows, empty tables and clashing names are as said in `spans`.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, texts_of
from .spans import Cover, Span

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings of each class in the default sample, and what a score must be over the threshold's sample by.
SAMPLE, MARGIN, SEED = 4_000, 2.0, 7
# Ordinary words that identifiers are built from.
WORDS = """account action address admin after agent alert alias amount archive array article asset author backup balance
batch before billing block border branch browser bucket buffer build button cache callback cancel category center change
channel check client cluster code collection column command comment commit common company component config connection
content context control convert count country create current customer data database default delete delivery deploy
description design detail device digest directory display document domain download driver element email enable encoding
engine entity entry environment error event example execute export extension factory feature field file filter final
first folder format forward frame function general global group handler header height history hosting identifier image
import index initial input insert instance integer interface internal invoice item java kernel label language last layout
length level library limit line link list loader local location logger login main manager mapping market master matrix
memory menu message method model module monitor name network node notification number object offset operation option
order output owner package page parameter parent parser partition path payment pending permission phone picture platform
plugin pointer policy position prefix previous print priority private process product profile program project property
protocol provider public query queue random range reader record reference region register remote render report request
resource response result retry return role root route rule sample schedule schema scope screen script search section
select sender sequence server service session setting shared signal simple single snapshot source stack standard start
state status storage stream string structure style submit success summary support switch symbol system table target task
template temporary test text thread time title total trace transaction transfer translation tree trigger type unique
update upload user utility value variable vector version view volume warning widget width window worker wrapper write
the and of to in is that for with on as from this are be or by at was der die und das für von mit sich auf ein nicht les
des est une dans pour que qui par sur pas con los las una por para como más ción mente ado ando ieron heit keit ung lich
isch tion ment able ness ship thing ther ever ould ight ough ation ering ested inger esse elle eau oire ique"""


def default_samples(n: int = SAMPLE, seed: int = SEED) -> list[tuple[str, int]]:
    """(string, 1 if random) for fitting, the same at every call."""
    draw = random.Random(seed)
    words = [x for x in WORDS.split() if x.isascii()]
    kinds = (ALPHABET, ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + "0123456789", "0123456789abcdef")
    out = [("".join(draw.choices(draw.choice(kinds), k=draw.randint(16, 48))), 1) for _ in range(n)]
    for _ in range(n):
        own = draw.choices(words, k=draw.randint(3, 7))
        form = draw.randrange(10)
        if form < 2:
            text = "".join(own)
        elif form == 2:
            text = own[0] + "".join(x.title() for x in own[1:])
        elif form == 3:
            text = "".join(x.title() for x in own)
        elif form < 8:
            text = (joint := "__-/"[form - 4]).join(own) + draw.choice(("", "", joint + str(draw.randint(1, 2030))))
        elif form == 8:
            text = draw.choice("_-").join(own).upper()
        else:
            text = draw.choice(("=" * 30, "-" * 40, "_" * 20, "0" * 18, "1" * 20, f"{draw.randint(1990, 2035)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}/{own[0]}/{own[1]}", own[0].upper() * 6))
        out.append((text, 0))
    return out


class Chain:
    """Log-probabilities of each character after each."""

    def __init__(self, strings: Iterable[str]):
        counts: dict[str, dict[str, int]] = {c: {} for c in "^" + ALPHABET}
        for s in strings:
            for a, b in zip("^" + s, s, strict=False):
                counts.setdefault(a, {})[b] = counts.get(a, {}).get(b, 0) + 1
        self.log = {}
        for a, own in counts.items():
            total = sum(own.values()) + len(ALPHABET)
            self.log |= {(a, b): log((own.get(b, 0) + 1) / total) for b in ALPHABET}


class Model:
    def __init__(self, samples: Iterable[tuple[str, int]], more: Iterable[tuple[str, int]] = ()):
        samples = list(samples)
        fit, held = [x for k, x in enumerate(samples) if k % 4] + list(more), samples[::4]
        rand, plain = (Chain(s for s, label in fit if label == y) for y in (1, 0))
        self.ratio = {k: rand.log[k] - plain.log[k] for k in rand.log}
        self.threshold = max([0.0, *(self.score(s) for s, label in held if not label)]) + MARGIN

    def score(self, token: str) -> float:
        """Log-likelihood ratio of random to ordinary; positive for random."""
        get = self.ratio.get
        return sum(get(x, 0.0) for x in zip("^" + token, token, strict=False))


def train(samples: Iterable[tuple[str, int]] | None = None, more: Iterable[tuple[str, int]] = ()) -> Model:
    """A model of labelled strings; of those in more only the chains learn, not the threshold."""
    return Model(default_samples() if samples is None else samples, more)


def labelled(df: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """Strings of df's texts, labelled by the base patterns: (string, 1 if random)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = set()
        for text in texts_of(batch):
            base = [("assign", *m.span(1)) for m in _ASSIGN.finditer(text) if len(m[1]) >= 16] + [x for x in detect(text) if x[0] != "assign"]
            known = Cover((a, b) for _, a, b in detect(text))
            out |= {(text[a:b], 1) for _, a, b in base} | {(m[0], 0) for m in _WORD.finditer(text) if not known.touches(*m.span())}
        own = sorted(x for x in out if len(x[0]) <= 256)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([y for _, y in own], pa.int32())], ["string", "random"])

    share = max(1, df.count() // sample)
    few = df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text").limit(2 * sample)
    found = map_arrow(few, run, "string string, random int").distinct()
    place = F.row_number().over(W.partitionBy("random").orderBy(F.xxhash64("string"), "string"))  # Spark drops the rest before the shuffle
    return sorted((r[0], r[1]) for r in found.withColumn("place", place).filter(F.col("place") <= sample).collect())


@lru_cache(1)
def default_model() -> Model:
    return train()


def detect(text: str) -> list[Span]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def find(text: str, model: Model | None = None) -> tuple[list[Span], list[Span]]:
    """The base spans, and those that the model adds."""
    model = model or default_model()
    base = detect(text)
    known = Cover((a, b) for _, a, b in base)
    more = [("random", *m.span()) for m in _TOKEN.finditer(text) if model.score(m[0]) > model.threshold and not known.touches(*m.span())]
    return base, more
