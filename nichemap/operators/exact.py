"""The exact law of a cell's count when traits are shuffled within strata, and p values from it without draws.

In a stratum of n rows the count of a cell follows a chain: the rows with its level of the first trait are given; each further
trait deals its level's rows over the stratum, so that a hypergeometric draw says how many of those so far have it as well.
The count over all strata is the sum of independent counts, so its law is the convolution of theirs. Strata are convolved in
two steps, by (cell, bucket) and then by cell, so that no task meets all of them. A law holds the counts whose chance a double
can hold: they lie within some forty standard deviations, so that a step of a chain, which pairs the counts before it with
those after it, takes work and a law takes space that grow with the rows, not with their square. The chance of an empty cell
is often less than any double; it is worked out by itself, as a logarithm, in a pass over the counts for up to three traits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import occupancy

#: Strata of a cell that one task convolves, about.
TOGETHER = 64
#: The least chance that a law holds, as a logarithm, and the numbers of a table of chances at most.
LEAST, NUMBERS = 690.0, 1 << 20


def log_factorials(n: int) -> np.ndarray:
    """Of 0 to n, in more digits than a double has: differences of large ones are wanted."""
    return np.concatenate([np.zeros(1, np.longdouble), np.cumsum(np.log(np.arange(1, n + 1, dtype=np.longdouble)))])


def trimmed(first: int, law: np.ndarray) -> tuple[int, np.ndarray]:
    """Without the counts at both ends that have less than the least chance."""
    held = np.flatnonzero(law >= math.exp(-LEAST))
    return first + int(held[0]), law[held[0] : held[-1] + 1]


def dealt(n: int, own: int, first: int, law: np.ndarray) -> tuple[int, np.ndarray]:
    """The law after one more trait, of whose level the n rows have `own`: of k rows so far, drawn with chance law[k - first],
    a hypergeometric number has it. Chances come from those next to them, from the mode outwards, up to where the bounds
    of Hoeffding and Bernstein leave less than the least chance."""
    every = np.arange(first, first + len(law), dtype=np.int64)
    modes = (every + 1) * (own + 1) // (n + 2)
    share = own / n
    tries = np.minimum(np.minimum(every, n - every), min(own, n - own)).astype(float)
    spread = np.minimum(every * share * (1 - share), own * (every / n) * (1 - every / n))
    wide = np.ceil(np.minimum(np.sqrt(LEAST * tries / 2), np.sqrt(2 * LEAST * spread) + LEAST * 2 / 3)).astype(np.int64) + 2
    low, high = max(0, int((modes - wide).min())), min(own, int(every[-1]), int((modes + wide).max()))
    out, together = np.zeros(high - low + 1), max(1, NUMBERS // (2 * int(wide.max()) + 1))
    for at in range(0, len(every), together):
        k, mode, width = every[at : at + together, None].astype(float), modes[at : at + together, None], int(wide[at : at + together].max())
        steps = np.arange(1, width + 1)[None, :]
        j = (mode + steps - 1).astype(float)
        up = np.cumprod(np.maximum(own - j, 0) * np.maximum(k - j, 0) / ((j + 1) * (n - own - k + j + 1)), axis=1)
        j = (mode - steps + 1).astype(float)
        down = np.cumprod(np.maximum(j, 0) * np.maximum(n - own - k + j, 0) / ((own - j + 1) * (k - j + 1)), axis=1)
        chance = np.concatenate([down[:, ::-1], np.ones_like(k), up], axis=1)
        chance *= (law[at : at + together] / chance.sum(axis=1))[:, None]
        count = mode + np.arange(-width, width + 1)[None, :]
        inside = (count >= low) & (count <= high)
        out += np.bincount(count[inside] - low, weights=chance[inside], minlength=len(out))
    return trimmed(low, out)


def chain(n: int, counts: list[int]) -> tuple[int, np.ndarray]:
    """(first count, chances from it on) of the rows that have all of the levels, of which the traits have so many among n."""
    first, law = int(counts[0]), np.ones(1)
    for own in counts[1:]:
        first, law = dealt(n, int(own), first, law)
    return first, law


def chain_law(n: int, counts: list[int]) -> np.ndarray:
    """The same from 0 on."""
    first, law = chain(n, counts)
    return np.concatenate([np.zeros(first), law])


def log_empty(n: int, counts: list[int], logs: np.ndarray) -> float:
    """The logarithm of the chance that no row has all of the levels, from the last trait backwards: of it a count so far leaves
    none with a chance that is one quotient; each trait before sums over the counts that it may leave."""
    *first, last = counts
    if not first:
        return 0.0 if last == 0 else -math.inf
    at = lambda x: np.maximum(x, 0)
    j = np.arange(min(first) + 1)
    none = np.where(j <= n - last, logs[at(n - j)] - logs[at(n - j - last)] - logs[n] + logs[n - last], -np.inf)
    for place in range(len(first) - 1, 0, -1):
        own, out = first[place], []
        for k in range(min(first[:place]) + 1) if place > 1 else [first[0]]:
            j = np.arange(max(0, k + own - n), min(k, own) + 1)
            chance = logs[k] - logs[j] - logs[k - j] + logs[n - k] - logs[own - j] - logs[n - k - own + j] - (logs[n] - logs[own] - logs[n - own]) + none[j]
            top = chance.max()
            out.append(top if np.isneginf(top) else top + np.log(np.exp(chance - top).sum()))
        none = np.array(out)
    return float(none[-1])


def convolved(laws: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The law of the sum; pairs at a time, so that long laws meet late."""
    laws = laws or [(0, np.ones(1))]
    while len(laws) > 1:
        pairs = [laws[k : k + 2] for k in range(0, len(laws), 2)]
        laws = [trimmed(sum(f for f, _ in p), np.convolve(*[x for _, x in p])) if len(p) > 1 else p[0] for p in pairs]
    return laws[0]


def _summed(statistics: DataFrame, panel: occupancy.Panel) -> DataFrame:
    """(cell_id, first, law, log_empty): for every cell the chances of its counts from `first` on."""
    sizes, strides = occupancy.sizes(panel), occupancy.strides(panel)
    spark, cells = statistics.sparkSession, occupancy.n_cells(panel)
    counted = occupancy.level_counts(statistics, panel)
    buckets = counted.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / TOGETHER)).alias("_buckets"))
    spread = counted.join(F.broadcast(buckets)).withColumn("bucket", F.pmod(F.xxhash64("stratum"), F.col("_buckets")))  # with one row
    spread = spread.withColumn("cell_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    level = lambda k, n, s: F.element_at(f"_{k}", ((F.floor(F.col("cell_id") / s) % n) + 1).cast("int")).cast("long")
    counts = F.sort_array(F.array(*[level(k, n, s) for k, (n, s) in enumerate(zip(sizes, strides, strict=True))]))  # the law has no order of traits
    rows = spread.select("cell_id", "bucket", F.col("_n").cast("long").alias("n"), counts.alias("counts")).filter(F.get("counts", F.lit(0)) > 0)  # never any elsewhere
    # groups are few bytes and much work: see occupancy.drawn
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells, 4 * spark.sparkContext.defaultParallelism))

    def of_bucket(group: pd.DataFrame) -> pd.DataFrame:
        logs = log_factorials(int(group["n"].max()))
        made: dict[tuple, tuple] = {}
        own, empty = [], 0.0
        for n, counts in sorted((int(n), tuple(int(x) for x in c)) for n, c in zip(group["n"], group["counts"], strict=True)):
            if (n, *counts) not in made:
                made[n, *counts] = chain(n, list(counts)), log_empty(n, list(counts), logs)
            law, none = made[n, *counts]
            own.append(law)
            empty += none
        first, law = convolved(own)
        return pd.DataFrame({"cell_id": group["cell_id"].iloc[:1], "first": [first], "law": [law], "log_empty": [empty]})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        first, law = convolved([(int(f), np.asarray(x)) for f, x in zip(group["first"], group["law"], strict=True)])
        return pd.DataFrame({"cell_id": group["cell_id"].iloc[:1], "first": [first], "law": [law], "log_empty": [group["log_empty"].sum()]})

    schema = "cell_id long, first long, law array<double>, log_empty double"
    some = rows.repartition(parts, "cell_id", "bucket").groupBy("cell_id", "bucket").applyInPandas(of_bucket, schema)
    none = spark.range(cells).select(F.col("id").alias("cell_id"), F.lit(0).cast("long").alias("first"), F.array(F.lit(1.0)).alias("law"), F.lit(0.0).alias("log_empty"))
    return some.unionByName(none).groupBy("cell_id").applyInPandas(together, schema)


def _from_zero() -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), F.col("first").cast("int")), F.col("law"))


def laws(statistics: DataFrame, panel: occupancy.Panel) -> DataFrame:
    """(cell_id, law): for every cell the chances of its counts from 0; statistics: stratum, cell_id, weight."""
    return _summed(statistics, panel).select("cell_id", _from_zero().alias("law"))


def p_values(df: DataFrame, panel: occupancy.Panel, taxon: str | None = None, min_size: int = 5) -> DataFrame:
    """Every cell with its count in the strata that are large enough, its expectation, and the chances of an empty cell, of so
    few rows or fewer, and of so many or more: what permutations estimate. The chance of an empty cell comes as a logarithm
    too, as it may be less than a double can hold."""
    kept = occupancy.kept_of(occupancy.cell_statistics(df, panel, taxon), taxon, min_size)
    seen = kept.groupBy("cell_id").agg(F.sum("weight").alias("observed"))
    own = _summed(kept, panel).join(seen, "cell_id", "left").join(occupancy.expected_of(kept, panel), "cell_id", "left").fillna(0, ["observed"]).fillna(0.0, ["expected"])
    added = lambda x: F.least(F.lit(1.0), F.aggregate(x, F.lit(0.0), lambda a, p: a + p))
    before = F.least(F.size("law"), F.greatest(F.lit(0), (F.col("observed") - F.col("first")).cast("int")))  # counts of the law under the observed
    upto = F.when(F.col("observed") < F.col("first"), 0).otherwise(before + 1)
    return own.select("cell_id", *occupancy.level_columns(panel), "observed", "expected", F.exp("log_empty").alias("p_empty"), F.col("log_empty").alias("log_p_empty"), added(F.slice("law", F.lit(1), upto)).alias("p_low"), added(F.slice("law", before + 1, F.size("law"))).alias("p_high"))


def fit(law: DataFrame, null: DataFrame, n_perm: int, least: float = 5.0) -> DataFrame:
    """(cell_id, classes, chi2, excess): how far the drawn frequencies of each cell's counts are from its law. Counts are put
    together from 0 upwards until a class expects `least` draws; excess is chi2 in standard deviations over its mean."""
    drawn = null.groupBy("cell_id", "n").agg(F.count("*").alias("times"))
    held = law.join(drawn.groupBy("cell_id").agg(F.collect_list(F.struct("n", "times")).alias("seen")), "cell_id", "left")  # a row a count

    def each(batches):
        for batch in batches:
            out = []
            for cell, own, seen in batch[["cell_id", "law", "seen"]].itertuples(index=False):
                drawn = seen if seen is not None else []
                own = np.concatenate([own, np.zeros(max([0, *(x["n"] + 1 - len(own) for x in drawn)]))])  # draws of no chance count
                times = np.zeros(len(own))
                for x in drawn:
                    times[x["n"]] = x["times"]
                times[0] = n_perm - times[1:].sum()  # draws that leave the cell empty have no row
                ends = np.cumsum(np.asarray(own) * n_perm)
                at = np.floor((ends - np.asarray(own) * n_perm / 2) / max(least, n_perm / 50)).astype(int)
                groups = pd.DataFrame({"at": at, "e": np.asarray(own) * n_perm, "t": times}).groupby("at").sum()
                groups = groups[groups["e"] >= least] if (groups["e"] >= least).any() else groups
                chi2, df = float(((groups["t"] - groups["e"]) ** 2 / groups["e"].clip(lower=1e-300)).sum()), max(1, len(groups) - 1)
                out.append((cell, len(groups), chi2, (chi2 - df) / (2 * df) ** 0.5))
            yield pd.DataFrame(out, columns=["cell_id", "classes", "chi2", "excess"])

    return held.mapInPandas(each, "cell_id long, classes int, chi2 double, excess double")
