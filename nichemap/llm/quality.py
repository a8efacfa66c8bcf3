"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a text by a predicate on its statistics. On a sample of rows, by a hash of doc_id and text, one job finds
all rules' verdicts and times each rule on each row: the engine's clock is read before and after it, REPEATS times a row, of
which the least counts, so that neither the start of jobs nor what else the machine does is in the figure. What is at hand
anyway, the words and the statistics that `judge` reports, is no rule's cost. The first rule of the cascade is the one with
most rejections per cost, the next the one with most among the rows that are left, and so on; rules within a factor of TIE
of the best are as good, and the one that is named first goes first. A statistic is worked out only where the cascade comes
to a rule that needs it: a text that one rule rejects costs the others nothing, but for the statistics that `judge` is asked
to report. The order changes the time only: a text is kept if no rule rejects it, whatever their order.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words, and are rejected for that; very long ones are judged
whole. Repeated rows, and rows with a null or shared doc_id, are judged each in its own right; an empty table gives no rows;
`keep` keeps every column, whatever its name, `judge` reads doc_id and text only. Nothing is exploded or shuffled; the
three-word windows of a text are compared inside its row, by 64-bit hash, in n log n steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that cost and selectivity are estimated on, about, and twice as many at most; times that a row is judged, and what
#: a rule costs at least, in nanoseconds a row, as less can't be told from none; and gains that are no different.
SAMPLE_ROWS, REPEATS, LEAST_COST, TIE = 500, 5, 500, 1.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dropped(text: Column, pattern: str) -> Column:
    """How many characters of text match the pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(own: Column) -> Column:
    """Words in three-word windows that the text has twice or more."""

    def by_window(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, marked)

    def marked(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(s: Column) -> Column:
        same = lambda x, at: F.coalesce(x["h"] == F.get(s, at)["h"], F.lit(False))
        twice = F.transform(F.filter(s, lambda x, i: same(x, i + 1) | ((i > 0) & same(x, i - 1))), lambda x: x["i"])
        return let(twice, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

    return let(own, by_window)


def statistics(text: Column, own: Column | None = None) -> dict[str, Column]:
    """The statistics of a text; own: its words, where they are at hand."""
    t = F.coalesce(text, F.lit(""))
    w = words(t) if own is None else own
    long = lambda c: c.cast("long")
    return {
        "n_words": long(F.size(w)),
        "word_chars": long(F.length(F.array_join(w, ""))),
        "n_symbols": long(dropped(t, r"[#*$%&|<>]")),
        "n_dup_lines": long(let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": long(repeat_words(w)),
        "n_lines": long(F.size(lines(t))),
        "n_upper": long(dropped(t, r"\p{Lu}")),
        "n_bangs": long(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))),
        "n_text": long(F.length(t)),
    }


@dataclass(frozen=True)
class Rule:
    """rejects: from the statistics to whether the text goes."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    base: bool = False


RULES = (
    Rule("few words", lambda s: s["n_words"] < 50, base=True),
    Rule("repeated windows", lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"], base=True),
    Rule("symbols", lambda s: 100 * s["n_symbols"] > 10 * s["n_words"]),
    Rule("repeated lines", lambda s: (100 * s["n_dup_lines"] > 40 * s["n_lines"]) & (s["n_dup_lines"] >= 2)),
    Rule("shouting", lambda s: (100 * s["n_upper"] > 40 * s["n_text"]) | (100 * s["n_bangs"] > 30 * s["n_words"])),
    Rule("word length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"])),
)


def sampled(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many rows of df (doc_id, text and others), chosen by a hash, in one partition; of rows that are all alike, as
    many as there are up to that."""
    by = F.xxhash64("doc_id", "text")
    share = max(1, df.count() // rows)
    chosen = df.filter(F.pmod(by, F.lit(share)) == 0).orderBy(by).limit(2 * rows).coalesce(1)
    return chosen if share == 1 or chosen.limit(1).count() else df.limit(rows).coalesce(1)


def measured(sample: DataFrame, rules: tuple[Rule, ...], at_hand: tuple[str, ...] = (), repeats: int = REPEATS) -> tuple[dict[tuple[bool, ...], int], list[float]]:
    """(how many rows have which verdicts, nanoseconds a row of each rule); sample: text, and the statistics at hand."""
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")

    def timed(w: Column) -> Column:
        """The rules one after another, with the clock between them; fields of a struct are worked out in their order."""
        stats = statistics(F.col("text"), w) | {k: F.col(k) for k in at_hand}
        fields = [clock().alias("t")]
        for k, rule in enumerate(rules):
            fields += [F.coalesce(rule.rejects(stats), F.lit(False)).alias(f"v{k}"), clock().alias(f"t{k}")]
        return F.struct(*fields)

    rows = sample.withColumn("_row", F.monotonically_increasing_id()).withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = rows.select("_row", let(words(F.coalesce(F.col("text"), F.lit(""))), timed).alias("_m"))
    before = lambda k: F.col(f"_m.t{k - 1}" if k else "_m.t")
    every = range(len(rules))
    each = rows.groupBy("_row").agg(F.array(*[F.first(f"_m.v{k}") for k in every]).alias("v"), *[F.min(F.col(f"_m.t{k}") - before(k)).alias(f"c{k}") for k in every])
    found = each.groupBy("v").agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in every]).collect()  # a row for each combination there is
    n = max(1, sum(r["n"] for r in found))
    return {tuple(r["v"]): r["n"] for r in found}, [max(LEAST_COST, sum(r[f"c{k}"] for r in found) / n) for k in every]


def best_order(left: dict[tuple[bool, ...], int], cost: list[float]) -> list[int]:
    """The numbers of the rules, each next one that with most rejections per cost among the rows that those before it leave."""
    order: list[int] = []
    while len(order) < len(cost):
        gain = {k: (sum(n for v, n in left.items() if v[k]) + 0.5) / cost[k] for k in range(len(cost)) if k not in order}
        order.append(next(k for k in gain if gain[k] * TIE >= max(gain.values())))
        left = {v: n for v, n in left.items() if not v[order[-1]]}
    return order


def ordered(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, at_hand: tuple[str, ...] = (), given: Rule | None = None) -> list[Rule]:
    """The rules in the order of the cascade; at_hand: statistics that are worked out in any case; given: what has rejected
    rows before the cascade comes to them."""
    sample = sampled(df.select("doc_id", "text"), sample_rows)
    stats = statistics(F.col("text"))
    sample = sample.select("text", *(stats[k].alias(k) for k in at_hand), *([given.rejects(stats).alias("_gone")] if given else [])).persist()
    try:
        rest = sample.filter(~F.coalesce("_gone", F.lit(False))) if given else sample
        return [rules[k] for k in best_order(*measured(rest, rules, at_hand))]
    finally:
        sample.unpersist()


def cascade(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """False as soon as a rule rejects, else true."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.rejects(stats), F.lit(False)).otherwise(kept)
    return kept


#: The statistics that `judge` reports by default: those that its contract names.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, reported: tuple[str, ...] = REPORTED) -> DataFrame:
    """doc_id, the statistics to be reported, base_failed (by a rule marked base) and kept. Other statistics are worked out
    where the cascade comes to them."""
    own = df.select("doc_id", "text")
    made = statistics(F.col("text"))
    rows = own.select("doc_id", "text", *(made[k].alias(k) for k in reported))
    stats = made | {k: F.col(k) for k in reported}
    base = Rule("base", lambda s: reduce(lambda a, b: a | b, (r.rejects(s) for r in rules if r.base), F.lit(False)))
    rows = rows.withColumn("base_failed", base.rejects(stats))
    order = ordered(own, tuple(r for r in rules if not r.base), at_hand=reported, given=base)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, stats))
    return rows.withColumn("kept", kept).drop("text")


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df, with all their columns, that no rule rejects."""
    order = ordered(df, rules)
    return df.filter(let(words(F.coalesce(F.col("text"), F.lit(""))), lambda w: cascade(order, statistics(F.col("text"), w))))
