"""Attrition, co-coverage, independence and availability: counts over boolean columns, each table in one pass."""

from __future__ import annotations

from math import exp, lgamma

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def funnel(df: DataFrame, stages: dict[str, Column], matched: Column, distinct: str) -> DataFrame:
    """Each stage's rows, share of all, rows with a match and their share, and distinct values among these; nulls not counted.
    Counted by value first, so that distinct values of many stages cost no more rows than those of one."""
    masks = [F.coalesce(m, F.lit(False)) for m in stages.values()]
    aggs = [F.count("*").alias("_all")]
    for k, m in enumerate(masks):
        aggs += [F.count_if(m).alias(f"n_{k}"), F.count_if(m & matched).alias(f"m_{k}")]
    by_value = df.groupBy(F.col(distinct).alias("_value")).agg(*aggs)
    total = [F.sum("_all").alias("_all")]
    for k in range(len(masks)):
        total += [F.sum(f"n_{k}").alias(f"n_{k}"), F.sum(f"m_{k}").alias(f"m_{k}"), F.count_if((F.col(f"m_{k}") > 0) & F.col("_value").isNotNull()).alias(f"d_{k}")]
    row = by_value.agg(*total)
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    structs = [F.struct(F.lit(n).alias("stage"), number(f"n_{k}").alias("n_rows"), (100 * F.try_divide(F.col(f"n_{k}"), F.col("_all"))).alias("pct_of_all"), number(f"m_{k}").alias("n_matched"), (100 * F.try_divide(F.col(f"m_{k}"), F.col(f"n_{k}"))).alias("pct_matched"), F.col(f"d_{k}").alias("n_distinct")) for k, n in enumerate(stages)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def mask_counts(df: DataFrame, steps: dict[str, Column], subsets: dict[str, Column]) -> DataFrame:
    """step, subset, n of the subset, k of it that the step holds, and pct."""
    pairs = [(s, u, F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))) for s, a in steps.items() for u, b in subsets.items()]
    row = df.agg(*[F.count_if(b).alias(f"n_{i}") for i, (_, _, _, b) in enumerate(pairs)], *[F.count_if(a & b).alias(f"k_{i}") for i, (_, _, a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(s).alias("step"), F.lit(u).alias("subset"), F.col(f"n_{i}").alias("n"), F.col(f"k_{i}").alias("k"), (100 * F.try_divide(F.col(f"k_{i}"), F.col(f"n_{i}"))).alias("pct")) for i, (s, u, _, _) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def co_coverage(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """For each pair of flags: both (count), conditional = both / first, lift = n both / (first second), null on the diagonal."""
    names = list(flags)
    aggs = [F.count("*").alias("_n")] + [F.count_if(F.coalesce(flags[a] & flags[b], F.lit(False))).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    c = lambda i, j: F.col(f"c_{i}_{j}")
    structs = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), c(i, j).alias("both"), F.try_divide(c(i, j), c(i, i)).alias("conditional"), F.when(F.lit(i != j), F.try_divide(F.col("_n") * c(i, j).cast("double"), c(i, i) * c(j, j))).alias("lift"))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def independence(df: DataFrame, panels: dict[str, list[Column]]) -> DataFrame:
    """Observed complete share of each panel against the product of its marginal shares."""
    aggs = [F.count("*").alias("_n")]
    for k, flags in enumerate(panels.values()):
        whole = flags[0]
        for f in flags[1:]:
            whole = whole & f
        aggs += [F.count_if(F.coalesce(whole, F.lit(False))).alias(f"o_{k}")] + [F.count_if(F.coalesce(f, F.lit(False))).alias(f"m_{k}_{i}") for i, f in enumerate(flags)]
    structs = []
    for k, (name, flags) in enumerate(panels.items()):
        product = F.lit(1.0)
        for i in range(len(flags)):
            product = product * F.try_divide(F.col(f"m_{k}_{i}"), F.col("_n"))
        observed = F.try_divide(F.col(f"o_{k}"), F.col("_n"))
        structs.append(F.struct(F.lit(name).alias("panel"), F.lit(len(flags)).alias("traits"), F.col(f"o_{k}").alias("observed_complete"), observed.alias("observed_frac"), product.alias("product_of_marginals"), (product * F.col("_n")).alias("expected_complete"), F.try_divide(observed, product).alias("ratio")))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def rate_by_number(df: DataFrame, number: Column, most: int, outcome: Column) -> DataFrame:
    """k from 0 to most, its rows and the share of them with the outcome; numbers without rows too."""
    own = df.groupBy(number.cast("long").alias("k")).agg(F.count("*").alias("N"), F.avg(F.coalesce(outcome, F.lit(False)).cast("double")).alias("share"))
    return df.sparkSession.range(most + 1).select(F.col("id").alias("k")).join(own, "k", "left").fillna(0, ["N"])


def with_without(df: DataFrame, flags: dict[str, Column], outcome: Column) -> DataFrame:
    """For each flag its rows, and the outcome's share with and without it."""
    y = F.coalesce(outcome, F.lit(False)).cast("double")
    row = df.agg(*[x for k, f in enumerate(flags.values()) for x in (F.count_if(f).alias(f"n_{k}"), F.avg(F.when(f, y)).alias(f"w_{k}"), F.avg(F.when(~f, y)).alias(f"o_{k}"))])
    structs = [F.struct(F.lit(n).alias("flag"), F.col(f"n_{k}").alias("N"), F.col(f"w_{k}").alias("share_with"), F.col(f"o_{k}").alias("share_without")) for k, n in enumerate(flags)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Sample odds ratio and two-sided p of the table [[a, b], [c, d]]. Chances are summed outward, by the ratio of neighbours,
    from the mode, from a, and from the first count beyond the mode that is no likelier than a, until they add nothing: a
    few standard deviations' worth of steps, and no list."""
    r, s, col = a + b, c + d, a + c
    lo, hi = max(0, col - s), min(r, col)
    mode = min(hi, max(lo, (r + 1) * (col + 1) // (r + s + 2)))

    def log(x: int) -> float:
        return sum(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for n, k in ((r, x), (s, col - x)))

    def outward(x: int, way: int) -> float:
        """The sum from x on, in units of the mode's chance."""
        total, own = 0.0, exp(log(x) - log(mode)) if lo <= x <= hi else 0.0
        while own > total * 1e-18:
            total += own
            up = x if way > 0 else x - 1
            ratio = (r - up) * (col - up) / ((up + 1) * (s - col + up + 1)) if lo <= up < hi else 0.0
            own *= ratio if way > 0 else 1 / ratio if ratio else 0.0
            x += way
        return total

    whole = outward(mode, 1) + outward(mode - 1, -1)
    way = 1 if a >= mode else -1
    near, far = mode, hi + 1 if way < 0 else lo - 1  # the other side: chances fall from near to far
    least = log(a) + 1e-7
    while abs(far - near) > 1:
        middle = (near + far) // 2
        near, far = (near, middle) if log(middle) <= least else (middle, far)
    tails = outward(a, way) + outward(far, -way)
    odds = a * d / (b * c) if b * c else float("inf") if a * d else float("nan")
    return odds, 1.0 if log(mode) <= least else min(1.0, tails / whole)


@F.pandas_udf(T.StructType([T.StructField("odds_ratio", T.DoubleType()), T.StructField("p_value", T.DoubleType())]))
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)], columns=["odds_ratio", "p_value"])


def fisher_of(df: DataFrame, member: Column, outcome: Column) -> DataFrame:
    """One row: the 2x2 table of two flags, odds ratio and p; both null if a side is empty."""
    m, y = F.coalesce(member, F.lit(False)), F.coalesce(outcome, F.lit(False))
    table = df.agg(F.count_if(m & y).alias("a"), F.count_if(m & ~y).alias("b"), F.count_if(~m & y).alias("c"), F.count_if(~m & ~y).alias("d"))
    fit = (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0)
    return table.withColumn("_f", _fisher("a", "b", "c", "d")).select("a", "b", "c", "d", F.when(fit, F.col("_f.odds_ratio")).alias("odds_ratio"), F.when(fit, F.col("_f.p_value")).alias("p_value"))
