"""Occupancy of the cells of a trait panel: counts, expectations, permutation nulls, and what they say.

A panel is a dict of column name -> levels, in order; its cells are numbered in that order, the last trait fastest. Grids
come from the panel alone, so their size is fixed however many rows there are.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

Panel = dict[str, list[str]]
UNASSIGNED = "__unassigned__"
#: Permutations that are drawn together at most, and numbers of their tables of cells.
TOGETHER, NUMBERS = 250, 1 << 21
#: Strata of a block that are drawn in one task, about.
STRATA = 256
#: Populations from which numpy draws no further; beyond, sums of ratios do it.
POPULATION = 10**9


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the settings' size, broadcast where it is joined; a literal, so that no job makes it."""

    def plain(value, kind):
        if isinstance(kind, StructType):
            return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
        return [plain(v, kind.elementType) for v in value] if isinstance(kind, ArrayType) else value

    kind = ArrayType(StructType.fromDDL(schema))
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(plain(rows, kind))), kind)).alias("r")).select("r.*"))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many partitions as there can be tasks, which adaptive execution leaves alone: a small file is one
    partition, however much work its rows are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def sizes(panel: Panel) -> list[int]:
    return [len(v) for v in panel.values()]


def n_cells(panel: Panel) -> int:
    return math.prod(sizes(panel))


def strides(panel: Panel) -> list[int]:
    own = sizes(panel)
    return [math.prod(own[k + 1 :]) for k in range(len(own))]


def level_columns(panel: Panel) -> list[Column]:
    """The level of each trait, from cell_id."""
    level = lambda v, s: F.element_at(F.array(*map(F.lit, v)), ((F.floor(F.col("cell_id") / s) % len(v)) + 1).cast("int"))
    return [level(v, s).alias(t) for (t, v), s in zip(panel.items(), strides(panel), strict=True)]


def grid(spark: SparkSession, panel: Panel) -> DataFrame:
    """cell_id and the level of each trait, a row a cell."""
    return spark.range(n_cells(panel)).select(F.col("id").alias("cell_id")).select("cell_id", *level_columns(panel))


def level_code(trait: str, levels: list[str]) -> Column:
    """Index of the trait's value among the levels; null for null; a value outside the levels is an error."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(trait))
    outside = F.raise_error(F.concat(F.lit(f"{trait}: value outside the configured levels: "), F.col(trait)))
    return F.when(F.col(trait).isNull(), F.lit(None).cast("long")).when(at > 0, at - 1).otherwise(outside.cast("long"))


def cell_id(panel: Panel) -> Column:
    return reduce(lambda a, b: a + b, [level_code(t, v) * s for (t, v), s in zip(panel.items(), strides(panel), strict=True)])


def complete(df: DataFrame, panel: Panel) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in panel]))


def counts(df: DataFrame, panel: Panel, name: str = "observed") -> DataFrame:
    """Every cell with its number of rows, 0 included."""
    own = complete(df, panel).groupBy(cell_id(panel).alias("cell_id")).agg(F.count("*").alias(name))
    return grid(df.sparkSession, panel).join(own, "cell_id", "left").fillna(0, [name])


def strata(df: DataFrame, taxon: str | None, min_size: int) -> DataFrame:
    """df with stratum and stratum_size, rows of strata under min_size left out. Rows without a taxon are one stratum; no
    taxon column means one stratum for all."""
    own = df.withColumn("stratum", F.lit("all") if taxon is None else F.coalesce(F.col(taxon), F.lit(UNASSIGNED)))
    size = own.groupBy("stratum").agg(F.count("*").alias("stratum_size"))
    return own.join(size if taxon is None else size.filter(F.col("stratum_size") >= min_size), "stratum")


def strata_summary(df: DataFrame, taxon: str | None, min_size: int) -> DataFrame:
    """One row: strata used and excluded, rows used and excluded."""
    least = 0 if taxon is None else min_size
    size = df.groupBy((F.lit("all") if taxon is None else F.coalesce(F.col(taxon), F.lit(UNASSIGNED))).alias("stratum")).count()
    kept = F.col("count") >= least
    return size.agg(F.count_if(kept).alias("strata_used"), F.count_if(~kept).alias("strata_excluded"), F.coalesce(F.sum(F.when(kept, F.col("count"))), F.lit(0)).alias("N_used"), F.coalesce(F.sum(F.when(~kept, F.col("count"))), F.lit(0)).alias("species_excluded"))


def cell_statistics(df: DataFrame, panel: Panel, taxon: str | None) -> DataFrame:
    """stratum, cell_id and weight, the number of rows: all that counts, strata and expectations need, out of one pass over
    the rows; as many rows as strata have cells."""
    stratum = F.lit("all") if taxon is None else F.coalesce(F.col(taxon), F.lit(UNASSIGNED))
    return complete(df, panel).groupBy(stratum.alias("stratum"), cell_id(panel).alias("cell_id")).agg(F.count("*").alias("weight"))


def expected(df: DataFrame, panel: Panel, name: str = "expected") -> DataFrame:
    """cell_id and the sum over strata of n times the product of the stratum's level shares. df has stratum."""
    own = complete(df, panel).groupBy("stratum", cell_id(panel).alias("cell_id")).agg(F.count("*").alias("weight"))
    return expected_of(own, panel, name)


def level_counts(statistics: DataFrame, panel: Panel) -> DataFrame:
    """stratum, its rows _n, and for each trait an array _k of the rows of each level; statistics: stratum, cell_id, weight."""
    return statistics.groupBy("stratum").agg(F.sum("weight").cast("double").alias("_n"), *_levels(panel))


def _levels(panel: Panel) -> list[Column]:
    level = lambda n, s: F.floor(F.col("cell_id") / s) % n
    return [F.array(*[F.coalesce(F.sum(F.when(level(n, s) == v, F.col("weight"))), F.lit(0)) for v in range(n)]).alias(f"_{k}") for k, (n, s) in enumerate(zip(sizes(panel), strides(panel), strict=True))]


def expected_of(statistics: DataFrame, panel: Panel, name: str = "expected") -> DataFrame:
    """The same from stratum, cell_id and weight: level counts of all traits by stratum, then the cells spread over them."""
    spread = level_counts(statistics, panel).withColumn("cell_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cells(panel) - 1).cast("long"))))
    share = lambda k, n, s: F.element_at(f"_{k}", ((F.floor(F.col("cell_id") / s) % n) + 1).cast("int")) / F.col("_n")
    product = reduce(lambda a, b: a * b, [share(k, n, s) for k, (n, s) in enumerate(zip(sizes(panel), strides(panel), strict=True))], F.col("_n"))
    return spread.groupBy("cell_id").agg(F.sum(product).alias(name))


def permuted(df: DataFrame, panel: Panel, n_perm: int, id_column: str, seed: str = "0") -> DataFrame:
    """The same by an md5 order of the rows, for small sets and few permutations, as rows times traits times permutations are
    sorted: the same draws under any partitioning and in any engine, to hold what is made of them against SQL. For each trait the row of rank r in its order gives its level to place r; a place's
    cell is the sum of its traits' shares of the cell number, so that one window and two aggregations do it all."""
    return _placed(df, panel, n_perm, id_column, seed).groupBy("perm", "cell_id").agg(F.count("*").alias("n"))


def _placed(df: DataFrame, panel: Panel, n_perm: int, id_column: str, seed: str) -> DataFrame:
    """stratum, perm, place and cell_id of every place in every permutation."""
    parts = F.array(*[F.struct(F.lit(k).alias("k"), (level_code(t, v) * s).alias("part")) for k, ((t, v), s) in enumerate(zip(panel.items(), strides(panel), strict=True))])
    long = spread(complete(df, panel).select("stratum", F.col(id_column).alias("_id"), *panel)).select("stratum", "_id", F.explode(parts).alias("_p")).select("stratum", "_id", "_p.*")
    drawn = long.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    order = F.unhex(F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col("k").cast("string"), F.col("_id").cast("string")).cast("binary")))
    placed = drawn.withColumn("place", F.row_number().over(W.partitionBy("stratum", "perm", "k").orderBy(order, "_id")))
    return placed.groupBy("stratum", "perm", "place").agg(F.sum("part").alias("cell_id"))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of n rows drawn without replacement are good, element by element, for populations of any size."""
    small = good + bad < POPULATION
    if small.all():
        return rng.hypergeometric(good, bad, n)
    out = np.empty(len(n), np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], n[small])
    for i in np.flatnonzero(~small):
        out[i] = _large(rng.random(), int(good[i]), int(bad[i]), int(n[i]))
    return out


def _large(u: float, good: int, bad: int, n: int) -> int:
    """The count at which the distribution's sum reaches u: ratios of neighbouring chances, summed as logarithms over all
    counts within 12 standard deviations of the mode, outside of which lie less than 1e-30."""
    whole = good + bad
    lo, hi = max(0, n - bad), min(good, n)
    mode = (n + 1) * (good + 1) // (whole + 2)
    wide = 12 * math.sqrt(n / whole * good * (bad / whole) * ((whole - n) / max(1, whole - 1))) + 12
    lo, hi = max(lo, int(mode - wide)), min(hi, int(mode + wide))
    x = np.arange(lo, hi, dtype=float)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    chance = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(chance - chance.max()))
    return lo + int(np.searchsorted(total, u * total[-1]))


def shuffled(rng: np.random.Generator, counts: list[np.ndarray], perms: int) -> tuple[np.ndarray, np.ndarray]:
    """(combination of levels, rows by permutation and combination) after each trait of one stratum is shuffled perms times,
    drawn from the traits' level counts: the combinations made so far draw their rows' levels of the next trait from what
    is left of them, without replacement. Combinations that no permutation has are left out; they are numbered as cells are."""
    levels = np.flatnonzero(counts[0])
    cells, rows = levels, np.tile(counts[0][levels], (perms, 1))
    for own in counts[1:]:
        levels = np.flatnonzero(own)
        left = np.tile(own[levels], (perms, 1))
        made = np.zeros((perms, len(cells), len(levels)), np.int64)
        for i in range(len(cells)):
            need = rows[:, i].copy()
            rest = left.sum(axis=1)
            for k in range(len(levels) - 1):
                rest -= left[:, k]
                made[:, i, k] = hypergeometric(rng, left[:, k], rest, need)
                need -= made[:, i, k]
            made[:, i, -1] = need
            left -= made[:, i]
        cells = (cells[:, None] * len(own) + levels[None, :]).ravel()
        rows = made.reshape(perms, -1)
        some = rows.any(axis=0)
        cells, rows = cells[some], rows[:, some]
    return cells, rows


def shuffled_rows(rng: np.random.Generator, counts: list[np.ndarray], perms: int) -> np.ndarray:
    """The same for a stratum of few rows, as the cell of each row in each permutation: its rows are written out and every trait
    but the first is shuffled."""
    cell = np.tile(np.repeat(np.arange(len(counts[0])), counts[0]), (perms, 1))
    for own in counts[1:]:
        level = np.tile(np.repeat(np.arange(len(own)), own), (perms, 1))
        cell = cell * len(own) + rng.permuted(level, axis=1)
    return cell


def few_rows(counts: list[np.ndarray]) -> bool:
    """Whether a stratum's rows are shuffled sooner than its combinations are drawn; a shuffled level costs about a fourteenth
    of a draw. Told by the level counts alone, so that it is the same wherever the stratum is drawn."""
    n, combinations, drawn = int(counts[0].sum()), 1, 0
    for k, own in enumerate(counts):
        levels = np.count_nonzero(own)
        drawn += min(combinations, n) * (levels - 1) if k else 0
        combinations *= levels
    return n * (len(counts) - 1) < 14 * drawn


def permuted_counts(df: DataFrame, panel: Panel, n_perm: int, seed: int = 0, occupied_by_stratum: bool = False) -> DataFrame:
    """(perm, cell_id, n) of cells that hold rows, each trait shuffled within strata. What a shuffle does to the counts depends
    on the level counts of each stratum only, so these are all that leaves the rows, and the work is strata times cells
    times permutations however many rows there are. With occupied_by_stratum, (perm, stratum, n): how many cells each
    stratum occupies."""
    own = complete(df, panel).groupBy("stratum", cell_id(panel).alias("cell_id")).agg(F.count("*").alias("weight"))
    return permuted_of(own, panel, n_perm, seed, occupied_by_stratum)


def permuted_of(statistics: DataFrame, panel: Panel, n_perm: int, seed: int = 0, occupied_by_stratum: bool = False, strata_together: int | None = None) -> DataFrame:
    """The same from stratum, cell_id and weight."""
    levels = level_counts(statistics, panel)
    counts = F.array(*[F.col(f"_{k}") for k in range(len(panel))])
    rows = levels.select(F.lit(0).alias("map"), "stratum", counts.alias("counts"))
    made = drawn(rows, [(sizes(panel), n_perm, seed)], lambda _, c: [np.asarray(x, np.int64) for x in c], strata_together or STRATA, occupied_by_stratum)
    return made.drop("map")


def drawn(levels: DataFrame, shapes: list[tuple[list[int], int, int]], counts_of: Callable, together: int, occupied_by_stratum: bool = False) -> DataFrame:
    """(map, perm, cell_id, n) for rows (map, stratum, counts); shapes has the sizes of each map's traits, its permutations and
    seed. Draws are dealt twice: a run of permutations is a block, and a block's strata are dealt to buckets of about so many
    by their hash; buckets send their tables of cells, which are added up. The draws of a stratum in a block have a
    generator of their own seed, so that no dealing changes a figure."""
    spark = levels.sparkSession
    runs = [max(1, min(TOGETHER, NUMBERS // math.prod(own))) for own, _, _ in shapes]
    blocks = [(m, b) for m, (_, n_perm, _) in enumerate(shapes) for b in range(math.ceil(n_perm / runs[m]))]
    least = levels.groupBy("map").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / together)).alias("buckets"))
    dealt = levels.join(F.broadcast(least), "map").join(fixed(spark, blocks, "map int, block int"), "map")  # a row a map, a row a block
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("stratum"), F.col("buckets"))).select("map", "block", "bucket", "stratum", "counts")
    # groups are few bytes and much work: as many partitions as there can be tasks, which adaptive execution leaves alone
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(blocks), 4 * spark.sparkContext.defaultParallelism))
    dealt = dealt.repartition(parts, "map", "block", "bucket")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        m, block = int(group["map"].iloc[0]), int(group["block"].iloc[0])
        own, n_perm, seed = shapes[m]
        cells = math.prod(own)
        perms = np.arange(block * runs[m], min(n_perm, (block + 1) * runs[m]))
        total, rows, waiting, occupied = np.zeros(len(perms) * cells, np.int64), [], 0, []
        first = (np.arange(len(perms)) * cells)[:, None]
        for name, given in zip(group["stratum"], group["counts"], strict=True):
            counts, rng = counts_of(m, given), np.random.default_rng([seed, block, zlib.crc32(name.encode())])
            if few_rows(counts):
                at = (shuffled_rows(rng, counts, len(perms)) + first).ravel()
                if occupied_by_stratum:
                    occupied.append((name, np.bincount(np.unique(at) // cells, minlength=len(perms))))
                    continue
                rows.append(at)
                waiting += len(at)
                if waiting > NUMBERS:
                    total += np.bincount(np.concatenate(rows), minlength=len(total))
                    rows, waiting = [], 0
                continue
            at, n = shuffled(rng, counts, len(perms))
            if occupied_by_stratum:
                occupied.append((name, np.count_nonzero(n, axis=1)))
            else:
                total.reshape(len(perms), cells)[:, at] += n
        if occupied_by_stratum:
            return pd.concat([pd.DataFrame({"map": m, "perm": perms, "stratum": name, "n": n}) for name, n in occupied])
        if rows:
            total += np.bincount(np.concatenate(rows), minlength=len(total))
        at = np.flatnonzero(total)
        return pd.DataFrame({"map": m, "perm": perms[at // cells], "cell_id": at % cells, "n": total[at]})

    if occupied_by_stratum:
        return dealt.groupBy("map", "block", "bucket").applyInPandas(draw, "map int, perm long, stratum string, n long")
    made = dealt.groupBy("map", "block", "bucket").applyInPandas(draw, "map int, perm long, cell_id long, n long")
    return made.groupBy("map", "perm", "cell_id").agg(F.sum("n").alias("n"))


def p_bucket(p: Column) -> Column:
    """A number that never falls as p rises: 64 to each factor of two, so that of p values spread over 0 to 1 less than a
    hundredth has the same; at most 69,000 different ones."""
    return F.when(p <= 0, -(1 << 20)).otherwise(F.floor(F.log2(p) * 64)).cast("int")


def bh_qvalues(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), name: str = "q", few: bool = False) -> DataFrame:
    """df with Benjamini-Hochberg q values of p, apart for each group of `by`; null p stay null. Equal p are counted first:
    permutation p values are few, however many tests there are. No task meets all the p of a group: they are scanned by
    bucket, with what the buckets below hold and the least that the buckets above need carried over from a table of the
    buckets; where they are few in any case, as those of a grid's cells are, one window a group does it."""
    if few:
        distinct = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_k"))
        up = W.partitionBy(*by).orderBy(p)
        raw = distinct.withColumn("_raw", F.col(p) * F.sum("_k").over(W.partitionBy(*by)) / F.sum("_k").over(up.rowsBetween(W.unboundedPreceding, 0)))
        q = raw.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(up.rowsBetween(0, W.unboundedFollowing)))).select(*by, p, name)
        return df.join(q, [*by, p], "left").select(*df.columns, name)
    distinct = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_k")).withColumn("_b", p_bucket(F.col(p)))
    up = W.partitionBy(*by, "_b").orderBy(p)
    groups = W.partitionBy(*by).orderBy("_b")  # as many rows as there are buckets
    held = distinct.groupBy(*by, "_b").agg(F.sum("_k").alias("_own"))
    held = held.select(*by, "_b", F.coalesce(F.sum("_own").over(groups.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"), F.sum("_own").over(W.partitionBy(*by)).alias("_total"))
    rank = F.col("_below") + F.sum("_k").over(up.rowsBetween(W.unboundedPreceding, 0))
    raw = distinct.join(held, [*by, "_b"]).withColumn("_raw", F.col(p) * F.col("_total") / rank)
    least = raw.groupBy(*by, "_b").agg(F.min("_raw").alias("_least"))
    above = least.select(*by, "_b", F.min("_least").over(groups.rowsBetween(1, W.unboundedFollowing)).alias("_above"))
    q = F.least(F.lit(1.0), F.min("_raw").over(up.rowsBetween(0, W.unboundedFollowing)), F.col("_above"))
    keys = [*by, p]
    made = raw.join(above, [*by, "_b"]).select(*keys, q.alias(name))
    return df.join(made, keys, "left").select(*df.columns, name)


def kept_of(statistics: DataFrame, taxon: str | None, min_size: int) -> DataFrame:
    """The statistics of strata with min_size rows or more; of all, where there is no taxon."""
    if taxon is None:
        return statistics
    size = statistics.groupBy("stratum").agg(F.sum("weight").alias("_size")).filter(F.col("_size") >= min_size)
    return statistics.join(size, "stratum").drop("_size")


def cell_table(df: DataFrame, panel: Panel, null: DataFrame, n_perm: int, taxon: str | None = None, min_size: int = 5, min_expected: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """Every cell: observed (kept strata and all rows), expected, the null's mean and p values, q over testable cells, flags.
    Cells that a permutation leaves empty have no row in `null`; the counts below allow for that."""
    every = cell_statistics(df, panel, taxon)
    return cell_table_of(every, kept_of(every, taxon, min_size), panel, null, n_perm, min_expected, alpha)


def cell_table_of(every: DataFrame, kept: DataFrame, panel: Panel, null: DataFrame, n_perm: int, min_expected: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """The same from the statistics of all strata and of those kept."""
    # counts of both sets and expectations meet in one aggregation, with a row of zeros for every cell
    zero = {"observed": F.lit(0).cast("long"), "observed_all_species": F.lit(0).cast("long"), "expected": F.lit(0.0)}
    parts = [every.sparkSession.range(n_cells(panel)).select(F.col("id").alias("cell_id"))]
    parts += [rows.select("cell_id", F.col(value).alias(name)) for rows, value, name in ((kept, "weight", "observed"), (every, "weight", "observed_all_species"), (expected_of(kept, panel), "expected", "expected"))]
    stacked = reduce(lambda a, b: a.unionByName(b), [p.select("cell_id", *[F.col(n) if n in p.columns else z.alias(n) for n, z in zero.items()]) for p in parts])
    base = stacked.groupBy("cell_id").agg(*[F.sum(n).alias(n) for n in zero]).select("cell_id", *level_columns(panel), *zero)
    seen = null.join(F.broadcast(base.select("cell_id", "observed")), "cell_id").groupBy("cell_id").agg(F.sum("n").alias("_sum"), F.count("*").alias("_present"), F.count_if(F.col("n") > F.col("observed")).alias("_more"), F.count_if(F.col("n") >= F.col("observed")).alias("_reach"))
    own = base.join(seen, "cell_id", "left").fillna(0, ["_sum", "_present", "_more", "_reach"])
    reach = F.when(F.col("observed") == 0, F.lit(n_perm)).otherwise(F.col("_reach"))
    own = own.withColumns({
        "emptied_by_exclusion": (F.col("observed") == 0) & (F.col("observed_all_species") > 0),
        "null_mean": F.col("_sum") / n_perm,
        "p_empty_under_null": (n_perm - F.col("_present")) / F.lit(n_perm),
        "p_low": (1 + n_perm - F.col("_more")) / F.lit(n_perm + 1),
        "p_high": (1 + reach) / F.lit(n_perm + 1),
        "testable": F.col("expected") >= min_expected,
    })
    own = bh_qvalues(own.withColumn("_p", F.when(F.col("testable"), F.col("p_low"))), "_p", name="q_low", few=True)
    flagged = F.col("testable") & (F.col("q_low") < alpha) & (F.col("observed") < F.col("expected"))
    own = own.withColumn("emptier_than_chance", F.coalesce(flagged, F.lit(False)))
    own = own.withColumn("empty_beyond_chance", F.col("emptier_than_chance") & (F.col("observed_all_species") == 0))
    return own.select("cell_id", *panel, "observed", "observed_all_species", "emptied_by_exclusion", "expected", "null_mean", "p_empty_under_null", "p_low", "q_low", "p_high", "testable", "emptier_than_chance", "empty_beyond_chance")


def null_occupied(null: DataFrame, n_perm: int) -> DataFrame:
    """perm and its number of occupied cells, 0 included."""
    return null.sparkSession.range(n_perm).select(F.col("id").alias("perm")).join(null.groupBy(F.col("perm").cast("long").alias("perm")).agg(F.count("*").alias("occupied")), "perm", "left").fillna(0, ["occupied"])


def summary(cells: DataFrame, null: DataFrame, n_perm: int, n: Column | int | None = None) -> DataFrame:
    """One row of the map's figures."""
    own = cells.agg(
        F.sum("observed").alias("N"), F.count("*").alias("cells"), F.count_if(F.col("observed") > 0).alias("occupied"), F.count_if(F.col("observed") == 0).alias("empty_cells"),
        F.count_if("testable").alias("testable_cells"), F.count_if(F.col("testable") & (F.col("observed") == 0)).alias("empty_testable_cells"), F.count_if("emptier_than_chance").alias("flagged_cells"),
        F.count_if("empty_beyond_chance").alias("empty_beyond_chance_cells"), F.count_if(F.col("emptier_than_chance") & (F.col("observed_all_species") > 0)).alias("depleted_occupied_cells"), F.count_if("emptied_by_exclusion").alias("cells_emptied_by_exclusion"),
    )
    occ = null_occupied(null, n_perm).join(own.select("occupied").withColumnRenamed("occupied", "_own"), how="cross")
    drawn = occ.agg(
        F.avg("occupied").alias("null_occupied_mean"), F.expr("percentile(occupied, 0.025)").alias("null_occupied_lo"), F.expr("percentile(occupied, 0.975)").alias("null_occupied_hi"),
        ((1 + F.count_if(F.col("occupied") <= F.col("_own"))) / F.lit(n_perm + 1)).alias("p_fewer_occupied_than_null"),
    )
    out = own.join(drawn, how="cross")  # one row and one row
    return out.withColumns({"occupied_frac": F.col("occupied") / F.col("cells"), "mean_per_cell": F.col("N") / F.col("cells"), "null_occupied_frac": F.col("null_occupied_mean") / F.col("cells"), "n_perm": F.lit(n_perm), "min_p_possible": F.lit(1 / (n_perm + 1))})


_held: list[DataFrame] = []


def release() -> None:
    """Lets go of what the maps made so far are worked out from; a map that is read again draws the same once more."""
    while _held:
        _held.pop().unpersist()


def occupancy(df: DataFrame, panel: Panel, id_column: str, n_perm: int, taxon: str | None = None, min_size: int = 5, min_expected: float = 3.0, alpha: float = 0.05, seed: int = 0, exact_draws: bool = False, settle: Callable[[DataFrame], DataFrame] = lambda table: table) -> tuple[DataFrame, DataFrame]:
    """(cell table, summary) of one map. An empty set gives a grid of zeros and a summary of zeros. The rows are read once,
    for their statistics by stratum and cell; these, and the draws made from them, are cached until `release`. settle may work
    a table out before the next is made from it."""
    every = cell_statistics(df, panel, taxon).persist()
    kept = kept_of(every, taxon, min_size)
    if exact_draws:
        null = permuted(strata(complete(df, panel), taxon, min_size), panel, n_perm, id_column, str(seed))
    else:
        null = permuted_of(kept, panel, n_perm, seed)
    null = null.persist()
    _held.extend((every, null))
    cells = settle(cell_table_of(every, kept, panel, null, n_perm, min_expected, alpha))
    return cells, settle(summary(cells, null, n_perm))


def detectable(cells: DataFrame, n_perm: int, alpha: float = 0.05, floor: float = 3.0) -> DataFrame:
    """The least expected count at which a true zero would be found: the larger of the floor, the Poisson bound
    ln(m / alpha) and the empirical bound, from which on every cell would be flagged if empty."""
    m = F.count_if("testable").over(W.partitionBy())
    own = cells.select("expected", "p_empty_under_null", "testable").withColumn("m", m)
    own = own.withColumn("p0", (1 + n_perm * F.col("p_empty_under_null")) / F.lit(n_perm + 1))
    own = own.withColumn("ok", F.coalesce((F.col("p0") <= alpha / F.nullif(F.col("m"), F.lit(0))) & (F.col("expected") >= floor), F.lit(False)))
    # whether all cells from here upwards are found; equal expectations stand or fall together
    own = own.withColumn("all_above", F.min("ok").over(W.orderBy("expected").rangeBetween(W.currentRow, W.unboundedFollowing)))
    own = own.withColumns({"poisson": F.when(F.col("m") > 0, F.log(F.col("m") / alpha)), "empirical": F.min(F.when(F.col("all_above"), F.col("expected"))).over(W.partitionBy())})
    own = own.withColumn("mde", F.greatest(F.lit(floor), F.col("poisson"), F.col("empirical")))
    return own.agg(
        F.max("m").alias("testable_cells"), F.max("poisson").alias("guaranteed_poisson"), F.lit(math.log(1 / alpha)).alias("best_case_poisson"), F.max("empirical").alias("guaranteed_empirical"), F.lit(floor).alias("floor"), F.max("mde").alias("minimum_detectable"),
        F.count_if(F.col("expected") >= F.col("mde")).alias("cells_above"), F.try_divide(F.sum(F.when(F.col("expected") >= F.col("mde"), F.col("expected")).otherwise(0.0)), F.sum("expected")).alias("expected_share_above"),
        F.count_if("ok").alias("cells_detected_alone"), F.count_if((F.col("expected") >= floor) & (F.col("p0") <= alpha)).alias("cells_detected_at_best"),
    )


def contributions(df: DataFrame, cell: dict[str, str], taxon: str, min_size: int = 5, parent: str | None = None) -> DataFrame:
    """Which strata the stratified null expects to fill the cell, largest first, with the share of each of its levels."""
    own = strata(df, taxon, min_size)
    shares = [F.avg(F.coalesce(F.col(t) == v, F.lit(False)).cast("double")).alias(f"share_{t}") for t, v in cell.items()]
    extra = [F.first(parent, ignorenulls=True).alias(parent)] if parent else []
    out = own.groupBy("stratum").agg(F.count("*").alias("N"), *extra, *shares)
    product = reduce(lambda a, b: a * b, [F.col(f"share_{t}") for t in cell], F.col("N").cast("double"))
    return out.withColumn("expected_in_cell", product).filter("expected_in_cell > 0").orderBy(F.col("expected_in_cell").desc(), "stratum")


def group_occupancy(df: DataFrame, panel: Panel, group: str) -> DataFrame:
    """For each group, larger ones first: rows, cells, cells of its own, and cells of it and all larger ones together. However
    many groups there are, they are not ordered against each other: a cell counts from the largest group that has it, and the
    cells' largest groups, as many as the panel has cells, are all that a group is compared with."""
    rows = complete(df, panel).select(F.coalesce(F.col(group), F.lit(UNASSIGNED)).alias("grp"), cell_id(panel).alias("cell_id"))
    pairs = rows.groupBy("grp", "cell_id").agg(F.count("*").alias("n"))
    size = pairs.groupBy("grp").agg(F.sum("n").alias("N"), F.count("*").alias("cells_occupied"))
    place = F.struct((-F.col("N")).alias("size"), F.col("grp").alias("grp"))
    first = pairs.join(size.select("grp", place.alias("place")), "grp").groupBy("cell_id").agg(F.min("place").alias("place"), F.count("*").alias("owners"))
    alone = first.filter("owners = 1").groupBy(F.col("place.grp").alias("grp")).agg(F.count("*").alias("cells_only_here"))
    every = first.agg(F.collect_list("place").alias("places"))  # one row, of an entry a cell
    out = size.join(F.broadcast(alone), "grp", "left").fillna(0, ["cells_only_here"]).join(F.broadcast(every))
    out = out.withColumn("cumulative_occupied", F.size(F.filter("places", lambda x: x <= place)).cast("long"))
    return out.withColumn("cumulative_share", F.col("cumulative_occupied") / F.size("places")).select("grp", "N", "cells_occupied", "cells_only_here", "cumulative_occupied", "cumulative_share")


def group_null(df: DataFrame, panel: Panel, group: str, n_perm: int, id_column: str, min_size: int = 5, seed: str = "0") -> DataFrame:
    """grp and the mean number of cells it occupies when permuted alone; groups under min_size have none."""
    kept = strata(complete(df, panel), group, min_size)
    drawn = permuted_counts(kept, panel, n_perm, int(seed), occupied_by_stratum=True)
    return drawn.groupBy(F.col("stratum").alias("grp")).agg(F.avg("n").alias("null_occupied_mean"))


def carriers(df: DataFrame, cell: dict[str, str], taxon: str, child: str) -> DataFrame:
    """For each stratum of the taxon, which children carry each level of the cell, which carry all, and the level that the
    fewest rows have."""
    own = F.coalesce(F.col(child), F.lit(UNASSIGNED))
    has = {t: F.coalesce(F.col(t) == v, F.lit(False)) for t, v in cell.items()}
    sets = [F.sort_array(F.collect_set(F.when(h, own))).alias(f"with_{t}") for t, h in has.items()]
    least = F.array_min(F.array(*[F.struct(F.avg(h.cast("double")).alias("share"), F.lit(f"{t}={cell[t]}").alias("level")) for t, h in has.items()])).alias("_least")
    out = df.groupBy(F.coalesce(F.col(taxon), F.lit(UNASSIGNED)).alias("stratum")).agg(F.count("*").alias("N"), *sets, least)
    every = reduce(F.array_intersect, [F.col(f"with_{t}") for t in cell])
    return out.select("stratum", "N", *[f"with_{t}" for t in cell], every.alias("with_all"), F.col("_least.level").alias("rarest_level"), F.col("_least.share").alias("rarest_share"))


def capacity(subsets: dict[str, tuple[DataFrame, Panel]], min_expected: float = 3.0) -> DataFrame:
    """For each named subset its rows, cells and the spread of its expected counts; no permutations. One pass over a subset's
    rows gives the level counts of all its traits, from which the cells are spread."""
    rows = []
    for name, (df, panel) in subsets.items():
        own = complete(df, panel).groupBy(cell_id(panel).alias("cell_id")).agg(F.count("*").alias("weight"))
        counts = own.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("_n"), *_levels(panel))
        spread = counts.withColumn("cell_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cells(panel) - 1).cast("long"))))
        share = lambda i, n, s: F.element_at(f"_{i}", ((F.floor(F.col("cell_id") / s) % n) + 1).cast("int")) / F.col("_n")
        product = reduce(lambda a, b: a * b, [share(i, n, s) for i, (n, s) in enumerate(zip(sizes(panel), strides(panel), strict=True))], F.col("_n"))
        full = spread.select(F.col("_n"), F.when(F.col("_n") > 0, product).otherwise(0.0).alias("expected"))
        rows.append(full.agg(
            F.lit(len(panel)).alias("size"), F.lit(name).alias("traits"), F.max("_n").cast("long").alias("N"), F.count("*").alias("cells"), F.min("expected").alias("expected_min"), F.expr("percentile(expected, 0.5)").alias("expected_median"), F.max("expected").alias("expected_max"),
            F.avg((F.col("expected") >= min_expected).cast("double")).alias("testable_cell_frac"),
        ))
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("N_per_cell", F.col("N") / F.col("cells"))


def capacity_summary(table: DataFrame) -> DataFrame:
    median = lambda c: F.expr(f"percentile({c}, 0.5)").alias(f"{c}_median")
    return table.groupBy("size").agg(F.count("*").alias("maps"), F.min("cells").alias("cells_min"), F.max("cells").alias("cells_max"), F.min("N").alias("N_min"), F.max("N").alias("N_max"), median("N_per_cell"), median("expected_median"), F.min("expected_min").alias("expected_min"), median("testable_cell_frac")).orderBy("size")


def merge_nulls(tables: dict[str, DataFrame], panel: Panel, finest: str, again: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row a cell with its figures under every null (global first), and the category that they add up to. `again` holds
    the runs with another seed, by null."""
    names = list(tables)
    base = tables[names[0]].select("cell_id", *panel, F.col("observed").alias("observed_all"))
    for n, t in tables.items():
        base = base.join(t.select("cell_id", F.col("observed").alias(f"{n}_observed"), F.col("emptied_by_exclusion").alias(f"{n}_emptied"), F.col("expected").alias(f"{n}_expected"), F.col("q_low").alias(f"{n}_q"), F.col("testable").alias(f"{n}_testable"), F.col("empty_beyond_chance").alias(f"{n}_empty")), "cell_id")
    for n, t in (again or {}).items():
        base = base.join(t.select("cell_id", F.col("q_low").alias(f"{n}_q_again"), F.col("empty_beyond_chance").alias(f"{n}_empty_again")), "cell_id")
    return base.withColumn("category", category(names, finest, finest in (again or {})))


def category(names: list[str], finest: str, has_again: bool) -> Column:
    c = F.col
    fired = F.array_join(F.filter(F.array(*[F.when(c(f"{n}_empty"), n) for n in names if n != finest]), lambda x: x.isNotNull()), "/")
    stable = F.when(c(f"{finest}_empty_again"), " (both seeds)").otherwise(" (seed 1 only: borderline)") if has_again else F.lit("")
    how = F.when(c(f"{finest}_emptied"), f"occupants only in excluded small {finest}s").when(~c(f"{finest}_testable"), f"untestable at {finest} level").otherwise(f"tested at {finest} level, not significant")
    testable = reduce(lambda a, b: a | b, [c(f"{n}_testable") for n in names])
    return (
        F.when(c(f"{finest}_empty"), F.concat(F.lit(f"SURVIVES {finest}-level shuffle"), stable))
        .when(fired != "", F.concat(F.lit("phylogenetic structure — fires under "), fired, F.lit(" only; "), how))
        .when((c("observed_all") == 0) & testable, "empty, testable, not significant under any null")
        .when(c("observed_all") == 0, "empty, untestable under every null")
        .otherwise("")
    )


def crosstab(cells: DataFrame, rows: list[str], columns: list[str], panel: Panel, mark: Column) -> DataFrame:
    """A row for each combination of `rows` in level order, a column for each of `columns`, holding the cells' marks."""
    spark = cells.sparkSession
    sub = lambda names: {t: panel[t] for t in names}
    label = lambda names: F.concat_ws(" / ", *names)
    wanted = [" / ".join(r[1:]) for r in sorted(grid(spark, sub(columns)).collect())]  # as many as the panel has levels
    wide = cells.select(label(rows).alias("row"), label(columns).alias("col"), mark.alias("mark")).groupBy("row").pivot("col", wanted).agg(F.first("mark"))
    ordered = grid(spark, sub(rows)).select(F.col("cell_id").alias("_order"), label(rows).alias("row"))
    return ordered.join(wide, "row", "left").orderBy("_order").drop("_order")


def trend(values: Column) -> tuple[Column, Column]:
    """Whether an array of numbers never rises, and whether it falls at every step."""
    step = lambda x, k: x - F.get(values, k + 1)
    steps = F.slice(F.transform(values, step), F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.forall(steps, lambda x: x >= -1e-9), F.forall(steps, lambda x: x > 1e-9)
