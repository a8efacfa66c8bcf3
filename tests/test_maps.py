"""Many maps at once against one at a time, the dealing of draws, the exact law, and scans by bucket."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichemap import queries_maps as Q
from nichemap.operators import exact, maps, occupancy
from nichemap.operators.selection import analysis_set
from nichemap.plans import reports


def rounded(rows):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def test_maps_are_those_made_one_at_a_time(spark, sf):
    """Cells and summaries of maps of several views, nulls and sizes are the same, draws included, as from the set of each."""
    df, a = Q.strains(spark, sf).cache(), Q.CFG["analysis"]
    own = [reports.one_map(Q.CFG, f"{len(t)}_{view}_{null}", t, view, null, 60, k) for k, (t, view, null) in enumerate([(["segment", "balance"], "primary", "order"), (["parity", "temperature", "segment"], "optimum-only", None), (["temperature"], "primary", "phylum"), (["segment", "parity"], "strain-level", "class"), ([*Q.LEVELS], "genus-level", "family"), ([*Q.LEVELS], "fine_bins", None)])]
    with maps.occupy(df, Q.CFG, own) as made:
        for m in own:
            sub = analysis_set(df, list(m.traits), m.binning, m.level, m.temp_source)
            cells, summary = occupancy.occupancy(sub, Q.CFG.panel_levels(list(m.traits), m.binning), "bacdive_id", m.n_perm, f"gtdb_{m.null}" if m.null else None, a["min_stratum_size"], a["min_expected_for_test"], a["fdr_alpha"], m.seed)
            got = made.cells_of(m.name)
            assert rounded(got.select(cells.columns).collect()) == rounded(cells.collect()), m
            one = made.summaries_of([m.name])
            assert rounded(one.select(summary.columns).collect()) == rounded(summary.collect()), m
        occupancy.release()
    df.unpersist()


def test_jobs_do_not_grow_with_maps(spark, sf):
    """As many jobs for thirty maps as for two."""
    df = Q.strains(spark, sf).cache()
    df.count()
    tracker, n = spark.sparkContext.statusTracker(), []
    for many in (2, 30):
        own = reports.grid_maps(Q.CFG, n_perm=10, sizes=(1, 2, 3))[:many]
        spark.sparkContext.setJobGroup(f"maps{many}", "")
        with maps.occupy(df, Q.CFG, own) as made:
            assert made.summaries.count() == many
        n.append(len(tracker.getJobIdsForGroup(f"maps{many}")))
    spark.sparkContext.setJobGroup("", "")
    df.unpersist()
    assert n[0] > 0 and n[1] <= n[0] + 2


def test_awkward_maps(spark, sf):
    """No rows, no permutations, and maps that share a name."""
    df = Q.strains(spark, sf).limit(0)
    own = [reports.one_map(Q.CFG, "a", ["segment", "parity"], "primary", "order", 5), maps.Map("b", ("parity",))]
    with maps.occupy(df, Q.CFG, own) as made:
        assert sorted((r["name"], r["N"], r["cells"], r["occupied"], r["n_perm"]) for r in made.summaries_of(["a", "b"]).collect()) == [("a", 0, 10, 0, 5), ("b", 0, 2, 0, 0)]
    with pytest.raises(ValueError, match="share"):
        maps.Lattice(Q.CFG, [own[0], own[0]])
    with pytest.raises(ValueError, match="level"):
        maps.Lattice(Q.CFG, [maps.Map("a", ("parity",), level="phylum")])


def test_dealing_changes_no_figure(spark):
    """The draws of strata, small and large, in one bucket, in some, and in one each."""
    panel = {"a": ["x", "y", "z"], "b": ["u", "v"], "c": ["p", "q"]}
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(40)}", rng.randrange(12), rng.choice([1, 2, 400])) for _ in range(300)]
    own = spark.createDataFrame(rows, "stratum string, cell_id long, weight long").groupBy("stratum", "cell_id").agg(F.sum("weight").alias("weight")).cache()
    out = [Counter(map(tuple, occupancy.permuted_of(own, panel, 300, 5, strata_together=n).collect())) for n in (10**9, 7, 1)]
    assert out[0] == out[1] == out[2]
    totals = Counter()
    for perm, _, n in out[0].elements():
        totals[perm] += n
    assert len(totals) == 300 and set(totals.values()) == {sum(w for _, _, w in rows)}


def test_a_million_strata_are_dealt(spark):
    """Strata of a row or two: dealt to thousands of buckets, of which none has many more than it should."""
    n = 1_000_000
    levels = spark.range(n).select(F.lit(0).alias("map"), F.concat(F.lit("s"), "id").alias("stratum"), F.array(F.array(F.lit(1), F.lit(1)), F.array(F.lit(2), F.lit(0))).alias("counts"))
    of = levels.withColumn("bucket", F.pmod(F.xxhash64("stratum"), F.lit(-(-n // occupancy.STRATA)))).groupBy("bucket").count()
    top, buckets = of.agg(F.max("count"), F.count("*")).first()
    assert buckets > 3900 and top < 1.5 * occupancy.STRATA
    made = occupancy.drawn(levels.limit(20_000), [([2, 2], 2, 1)], lambda _, c: [np.asarray(x, np.int64) for x in c], occupancy.STRATA)
    assert sorted(tuple(r) for r in made.collect()) == [(0, p, c, 20_000) for p in (0, 1) for c in (0, 2)]


def test_rows_and_draws_have_one_law():
    """A stratum's cells, by shuffled rows and by draws of counts, against the exact law."""
    counts, perms = [np.array([3, 4]), np.array([2, 5]), np.array([4, 3])], 40_000
    law = exact.chain_law(7, [3, 2, 4])
    rows = (occupancy.shuffled_rows(np.random.default_rng(1), counts, perms) == 0).sum(axis=1)
    at, n = occupancy.shuffled(np.random.default_rng(1), counts, perms)
    for seen in (rows, n[:, list(at).index(0)]):
        times = np.bincount(seen, minlength=len(law))[: len(law)]
        assert times.sum() == perms and np.abs(times / perms - law).max() < 0.01


@pytest.mark.parametrize("counts", [(3, 2), (3, 2, 4), (1, 1), (5, 5), (0, 3), (2, 4, 3, 1)])
def test_chain_law_against_all_permutations(counts):
    n = 5 if max(counts) <= 5 else 6
    every = Counter()
    first = set(range(counts[0]))
    for picks in itertools.product(*[list(itertools.combinations(range(n), c)) for c in counts[1:]]):
        every[len(first.intersection(*map(set, picks)))] += 1
    total = sum(every.values())
    assert exact.chain_law(n, list(counts)) == pytest.approx([every[k] / total for k in range(counts[0] + 1)][: len(exact.chain_law(n, list(counts)))])


def test_exact_p_values_are_what_draws_estimate(spark, sf):
    df = Q.strains(spark, sf).filter("segment is not null and balance is not null").cache()
    panel = {t: Q.LEVELS[t] for t in ("segment", "balance", "parity")}
    cells, _ = occupancy.occupancy(df, panel, "bacdive_id", 4000, "gtdb_order", 5)
    drawn = {r["cell_id"]: r for r in cells.collect()}
    for r in exact.p_values(df, panel, "gtdb_order", 5).collect():
        d = drawn[r["cell_id"]]
        assert r["observed"] == d["observed"] and r["expected"] == pytest.approx(d["expected"], abs=1e-9)
        assert r["p_empty"] == pytest.approx(d["p_empty_under_null"], abs=0.03) and r["p_low"] == pytest.approx(d["p_low"], abs=0.03) and r["p_high"] == pytest.approx(d["p_high"], abs=0.03)
    occupancy.release()


@pytest.mark.parametrize("kind", ["different", "few", "tiny", "ends"])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_bh_by_bucket(spark, kind, by):
    rng = random.Random(kind)
    draw = {"different": rng.random, "few": lambda: rng.randrange(1, 12) / 11, "tiny": lambda: 10 ** -rng.uniform(0, 300), "ends": lambda: rng.choice([0.0, 1.0, 5e-324, 0.5, rng.random()])}[kind]
    rows = [(k, k % 3, None if k % 50 == 7 else draw()) for k in range(3000)]
    got = {r["k"]: r["q"] for r in occupancy.bh_qvalues(spark.createDataFrame(rows, "k long, g long, p double"), by=by).collect()}
    for g in range(3) if by else [None]:
        own = sorted((p, k) for k, h, p in rows if p is not None and g in (None, h))
        q = 1.0
        for i in range(len(own) - 1, -1, -1):
            rank = i + 1
            q = min(q, own[i][0] * len(own) / rank)
            assert math.isclose(got[own[i][1]], min(1.0, q), rel_tol=1e-12) or own[i][0] in {own[j][0] for j in (i - 1, i + 1) if 0 <= j < len(own)}
    assert all(got[k] is None for k, _, p in rows if p is None)


def test_groups_are_counted_without_an_order_of_all(spark):
    panel = {"a": ["x", "y", "z"], "b": ["u", "v"]}
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", "z"]), rng.choice(["u", "v"]), rng.choice([None, *(f"g{k}" for k in range(40))])) for _ in range(150)]
    rows = [r for r in rows if r != ("z", "v", "g1")]
    got = {r["grp"]: r for r in occupancy.group_occupancy(spark.createDataFrame(rows, "a string, b string, g string"), panel, "g").collect()}
    size = Counter(g or occupancy.UNASSIGNED for *_, g in rows)
    seen, own = set(), {g: {r[:2] for r in rows if (r[2] or occupancy.UNASSIGNED) == g} for g in size}
    every = set().union(*own.values())
    for g in sorted(size, key=lambda g: (-size[g], g)):
        seen |= own[g]
        alone = sum(all(c not in own[o] for o in own if o != g) for c in own[g])
        assert tuple(got[g]) == (g, size[g], len(own[g]), alone, len(seen), len(seen) / len(every))


def test_laws_of_many_rows():
    """A chain over a hundred thousand rows: the closed form of its mean, an empty cell beyond a double, no square of the rows."""
    n, counts = 100_000, [20_000, 25_000, 50_000]
    first, law = exact.chain(n, counts)
    assert first > 1000 and len(law) < 5000 and law.sum() == pytest.approx(1, abs=1e-12)
    assert (np.arange(first, first + len(law)) * law).sum() == pytest.approx(2500, abs=1e-8)
    assert exact.log_empty(n, counts, exact.log_factorials(n)) < -2500
    assert exact.log_empty(9, [3, 2, 4], exact.log_factorials(9)) == pytest.approx(math.log(exact.chain_law(9, [3, 2, 4])[0]))
    assert exact.log_empty(9, [3, 6, 5, 4], exact.log_factorials(9)) == pytest.approx(math.log(exact.chain_law(9, [3, 6, 5, 4])[0]))
    assert exact.log_empty(5, [5, 5], exact.log_factorials(5)) == -math.inf


def test_empty_cells_beyond_doubles(spark):
    """Strata of thousands of rows: p_empty is 0 as a double, its logarithm isn't."""
    panel = {"a": ["x", "y"], "b": ["u", "v"]}
    rows = spark.range(8000).selectExpr("if(id % 2 = 0, 'x', 'y') as a", "if(floor(id / 2) % 2 = 0, 'u', 'v') as b", "concat('o', id % 4) as t")
    for r in exact.p_values(rows, panel, "t", 5).collect():
        assert r["p_empty"] == 0 and r["log_p_empty"] < -1000 and r["expected"] == pytest.approx(2000) and 0 <= r["p_low"] <= 1
