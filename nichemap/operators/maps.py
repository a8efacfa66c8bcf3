"""Many maps in one plan: subsets of traits, views and nulls as rows of a table of maps, so that the number of Spark jobs does
not depend on how many there are.

A row's complete traits are a bit mask. One aggregation by (view, taxon, mask) finds the preferred row of each mask; each
mask then counts for all wanted subsets that it holds, and a second aggregation finds each subset's row of each taxon. One
grouping by (map, stratum, cell) gives the statistics of every map, from which level counts, expectations, draws, q values and
summaries come, each in one plan keyed by the map. Each step's table is written in the shared folder and read from there by those after it: no plan holds
that of another, a lost executor costs no step again, and the tables go when the results are closed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, column
from ..sinks import Kept, kept
from . import occupancy
from .occupancy import fixed

RANKS = ("phylum", "class", "order", "family")


@dataclass(frozen=True)
class Map:
    """One map: traits in order, the view that its rows are seen in, and its null (a rank, or None for the global one)."""

    name: str
    traits: tuple[str, ...]
    binning: str = "coarse"
    level: str = "species"
    temp_source: str = "all"
    null: str | None = None
    n_perm: int = 0
    seed: int = 0

    @property
    def view(self) -> tuple[str, str, str]:
        return self.binning, self.level, self.temp_source if "temperature" in self.traits else "all"


class Lattice:
    """The maps with what is the same for all rows: traits by bit, analysis sets, sizes and strides."""

    def __init__(self, cfg: Config, maps: list[Map]):
        if len({m.name for m in maps}) < len(maps):
            raise ValueError("maps share a name")
        for m in maps:
            if m.level not in ("strain", "species", "genus") or m.temp_source not in ("all", "optimum"):
                raise ValueError(f"level {m.level}, temp_source {m.temp_source}")
        self.cfg, self.maps = cfg, maps
        self.traits = sorted({t for m in maps for t in m.traits})
        self.views = sorted({m.view for m in maps})
        self.sets = sorted({(self.views.index(m.view), self.mask(m.traits)) for m in maps})

    def mask(self, traits: tuple[str, ...]) -> int:
        return sum(1 << self.traits.index(t) for t in traits)

    def panel(self, m: Map) -> occupancy.Panel:
        return self.cfg.panel_levels(list(m.traits), m.binning)

    def strides(self, m: Map) -> list[int]:
        """Of each trait of the lattice in the map's cell numbers; 0 for traits that it hasn't."""
        own = dict(zip(m.traits, occupancy.strides(self.panel(m)), strict=True))
        return [own.get(t, 0) for t in self.traits]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, self.sets.index((self.views.index(m.view), self.mask(m.traits))), -1 if m.null is None else RANKS.index(m.null), self.strides(m)) for k, m in enumerate(self.maps)]
        return fixed(spark, rows, "map int, set int, rank int, strides array<int>")

    def grid(self, spark: SparkSession) -> DataFrame:
        """A row a map and cell."""
        rows = [(k, occupancy.n_cells(self.panel(m))) for k, m in enumerate(self.maps)]
        return fixed(spark, rows, "map int, cells long").select("map", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell_id"))


def _codes(lattice: Lattice, view: tuple[str, str, str]) -> list[Column]:
    """The level number of each trait in the view; null where the row can't be placed."""
    binning, _, temp = view
    out = []
    for t in lattice.traits:
        levels = lattice.cfg["traits"][t][binning + "_levels"]
        code = occupancy.level_code(column(t, binning), levels).cast("int")
        if temp == "optimum" and t == "temperature":
            code = F.when(F.col("temperature_bin_source") == "optimum", code)
        out.append(code)
    return out


def chosen(df: DataFrame, lattice: Lattice) -> DataFrame:
    """(set, codes, taxa): the rows of every analysis set; of a taxon the type strain before others, then the preferred
    assembly, then the least id. Rows without the taxon stand for themselves, by accession."""
    is_type = F.coalesce(F.col("type_strain_bacdive"), F.lit(False)) | F.coalesce(F.col("gtdb_is_type_strain_of_species"), F.lit(False))
    order = F.struct((~is_type).alias("a"), F.col("pref_order").isNull().alias("b"), F.col("pref_order").alias("c"), F.col("bacdive_id").alias("d"))
    taxa = F.array(*[F.coalesce(F.col(f"gtdb_{r}"), F.lit(occupancy.UNASSIGNED)) for r in RANKS])
    seen = []
    for k, view in enumerate(lattice.views):
        codes = _codes(lattice, view)
        mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c.isNotNull(), 1 << j).otherwise(0) for j, c in enumerate(codes)])
        key = F.lit(None).cast("string") if view[1] == "strain" else F.coalesce(F.col(f"gtdb_{view[1]}"), F.concat(F.lit("acc:"), F.col("gtdb_accession")))
        seen.append(F.struct(F.lit(k).alias("view"), key.alias("key"), mask.alias("mask"), F.array(*codes).alias("codes")))
    rows = occupancy.spread(df.filter("genome_matched")).select(F.explode(F.array(*seen)).alias("v"), order.alias("order"), taxa.alias("taxa")).select("v.*", F.struct("order", "taxa").alias("own"))
    rows = rows.select("view", "key", "mask", F.struct("own.order", "codes", "own.taxa").alias("best"))
    wanted = fixed(df.sparkSession, [(v, [(k, m) for k, (w, m) in enumerate(lattice.sets) if w == v]) for v in range(len(lattice.views))], "view int, sets array<struct<set:int,mask:int>>")

    def held(some: DataFrame) -> DataFrame:
        """A row for each set whose traits the row's mask has."""
        own = F.filter("sets", lambda s: s["mask"].bitwiseAND(F.col("mask")) == s["mask"])
        return some.join(wanted, "view").withColumn("set", F.explode(F.transform(own, lambda s: s["set"])))

    strains = [k for k, v in enumerate(lattice.views) if v[1] == "strain"]
    each = F.col("view").isin(strains)
    by_mask = rows.filter(~each).groupBy("view", "key", "mask").agg(F.min("best").alias("best"))
    taxon = held(by_mask).groupBy("set", "key").agg(F.min("best").alias("best"))
    out = taxon.select("set", "best.codes", "best.taxa")
    return out.unionByName(held(rows.filter(each)).select("set", "best.codes", "best.taxa")) if strains else out


def statistics(df: DataFrame, lattice: Lattice) -> DataFrame:
    """(map, stratum, cell_id, weight) of every map, all strata."""
    cell = F.aggregate(F.zip_with("codes", "strides", lambda c, s: F.coalesce(c, F.lit(0)).cast("long") * s), F.lit(0).cast("long"), lambda a, x: a + x)
    stratum = F.when(F.col("rank") < 0, "all").otherwise(F.get("taxa", F.col("rank")))
    rows = chosen(df, lattice).join(lattice.table(df.sparkSession), "set")
    return rows.groupBy("map", stratum.alias("stratum"), cell.alias("cell_id")).agg(F.count("*").alias("weight"))


def kept_strata(every: DataFrame, lattice: Lattice) -> DataFrame:
    """The statistics of strata that are large enough; of all where the null is the global one."""
    ranked = [k for k, m in enumerate(lattice.maps) if m.null is not None]
    least = F.when(F.col("map").isin(ranked), F.lit(lattice.cfg["analysis"]["min_stratum_size"])).otherwise(0)
    size = every.groupBy("map", "stratum").agg(F.sum("weight").alias("_size")).filter(F.col("_size") >= least)
    return every.join(size.drop("_size"), ["map", "stratum"])


def level_counts(kept: DataFrame, lattice: Lattice) -> DataFrame:
    """(map, stratum, counts): for each trait of the map, in its order, the rows of each level."""
    shapes = [(k, [list(x) for x in zip(occupancy.sizes(p), occupancy.strides(p), strict=True)]) for k, m in enumerate(lattice.maps) for p in [lattice.panel(m)]]
    own = kept.join(fixed(kept.sparkSession, shapes, "map int, shape array<array<int>>"), "map")
    long = own.select("map", "stratum", "weight", F.posexplode(F.transform("shape", lambda s: F.floor(F.col("cell_id") / s[1]) % s[0])).alias("trait", "level"))
    counted = long.groupBy("map", "stratum", "trait", "level").agg(F.sum("weight").alias("n"))
    return counted.groupBy("map", "stratum").agg(F.collect_list(F.struct("trait", "level", "n")).alias("counts"))  # a row a level


def _arrays(counts, sizes: list[int]) -> list[np.ndarray]:
    out = [np.zeros(n, np.int64) for n in sizes]
    for x in counts:
        out[x["trait"]][x["level"]] = x["n"]
    return out


def expected(levels: DataFrame, lattice: Lattice) -> DataFrame:
    """(map, cell_id, expected), summed over strata; each batch of strata adds up its own cells first."""
    sizes = [occupancy.sizes(lattice.panel(m)) for m in lattice.maps]

    def each(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, counts in zip(batch["map"], batch["counts"], strict=True):
                own = _arrays(counts, sizes[m])
                n = own[0].sum()
                product = reduce(np.multiply.outer, [a / n for a in own]).ravel() * n
                total[m] = total[m] + product if m in total else product
        for m, cells in total.items():
            yield pd.DataFrame({"map": m, "cell_id": np.arange(len(cells)), "expected": cells})

    return levels.mapInPandas(each, "map int, cell_id long, expected double").groupBy("map", "cell_id").agg(F.sum("expected").alias("expected"))


def draws(levels: DataFrame, lattice: Lattice, together: int | None = None) -> DataFrame:
    """(map, perm, cell_id, n) of cells that hold rows, in all permutations of all maps; see occupancy.drawn."""
    shapes = [(occupancy.sizes(lattice.panel(m)), m.n_perm, m.seed) for m in lattice.maps]
    rows = levels.select("map", "stratum", "counts")
    return occupancy.drawn(rows, shapes, lambda m, counts: _arrays(counts, shapes[m][0]), together or occupancy.STRATA)


@dataclass
class Results:
    """The cells and summaries of all maps, keyed by `map`, and the tables that they are held in until close()."""

    lattice: Lattice
    levels: DataFrame
    cells: DataFrame
    summaries: DataFrame
    held: list[Kept]

    def close(self) -> None:
        for table in self.held:
            table.remove()
        self.held = []

    def __enter__(self) -> Results:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def number(self, name: str) -> int:
        return [m.name for m in self.lattice.maps].index(name)

    def cells_of(self, name: str) -> DataFrame:
        """One map's cells, with its traits' levels as columns."""
        k = self.number(name)
        panel = self.lattice.panel(self.lattice.maps[k])
        return self.cells.filter(F.col("map") == k).select("cell_id", *occupancy.level_columns(panel), *[c for c in self.cells.columns if c not in ("map", "cell_id")])

    def summaries_of(self, names: list[str]) -> DataFrame:
        """The summaries of these maps, with the map's name, view, null and traits."""
        own = [(k, m.name, m.binning, m.level, m.temp_source, m.null or "global", len(m.traits), " + ".join(m.traits)) for k, m in enumerate(self.lattice.maps) if m.name in set(names)]
        return self.summaries.join(fixed(self.summaries.sparkSession, own, "map int, name string, binning string, level string, temp_source string, null string, size int, traits string"), "map").drop("map")


def cell_tables(every: DataFrame, kept: DataFrame, levels: DataFrame, null: DataFrame, lattice: Lattice) -> DataFrame:
    """Every cell of every map: occupancy.cell_table with the map as a key, before q values."""
    a, spark = lattice.cfg["analysis"], every.sparkSession
    zero = {"observed": F.lit(0).cast("long"), "observed_all_species": F.lit(0).cast("long"), "expected": F.lit(0.0)}
    parts = [lattice.grid(spark), kept.select("map", "cell_id", F.col("weight").alias("observed")), every.select("map", "cell_id", F.col("weight").alias("observed_all_species")), expected(levels, lattice)]
    stacked = reduce(lambda x, y: x.unionByName(y), [p.select("map", "cell_id", *[F.col(n) if n in p.columns else z.alias(n) for n, z in zero.items()]) for p in parts])
    base = stacked.groupBy("map", "cell_id").agg(*[F.sum(n).alias(n) for n in zero])
    seen = null.join(F.broadcast(base.select("map", "cell_id", "observed")), ["map", "cell_id"]).groupBy("map", "cell_id").agg(  # as many rows as the grids have cells
        F.sum("n").alias("_sum"), F.count("*").alias("_present"), F.count_if(F.col("n") > F.col("observed")).alias("_more"), F.count_if(F.col("n") >= F.col("observed")).alias("_reach"),
    )
    perms = fixed(spark, [(k, m.n_perm) for k, m in enumerate(lattice.maps)], "map int, _perms long")
    own = base.join(seen, ["map", "cell_id"], "left").fillna(0, ["_sum", "_present", "_more", "_reach"]).join(perms, "map")
    n = F.col("_perms")
    own = own.withColumns({
        "emptied_by_exclusion": (F.col("observed") == 0) & (F.col("observed_all_species") > 0),
        "null_mean": F.try_divide(F.col("_sum"), n),
        "p_empty_under_null": F.try_divide(n - F.col("_present"), n),
        "p_low": (1 + n - F.col("_more")) / (n + 1),
        "p_high": (1 + F.when(F.col("observed") == 0, n).otherwise(F.col("_reach"))) / (n + 1),
        "testable": F.col("expected") >= a["min_expected_for_test"],
    })
    return own


def flagged(own: DataFrame, lattice: Lattice) -> DataFrame:
    """Cells with q values over the testable ones of their map, and flags."""
    a, zero = lattice.cfg["analysis"], ("observed", "observed_all_species", "expected")
    own = occupancy.bh_qvalues(own.withColumn("_p", F.when(F.col("testable"), F.col("p_low"))), "_p", ("map",), "q_low", few=True)
    low = F.col("testable") & (F.col("q_low") < a["fdr_alpha"]) & (F.col("observed") < F.col("expected"))
    own = own.withColumn("emptier_than_chance", F.coalesce(low, F.lit(False)))
    own = own.withColumn("empty_beyond_chance", F.col("emptier_than_chance") & (F.col("observed_all_species") == 0))
    return own.select("map", "cell_id", *zero, "emptied_by_exclusion", "null_mean", "p_empty_under_null", "p_low", "q_low", "p_high", "testable", "emptier_than_chance", "empty_beyond_chance")


def summaries(cells: DataFrame, null: DataFrame, lattice: Lattice) -> DataFrame:
    """A row a map: occupancy.summary with the map as a key. Permutations that leave a map empty count as occupying 0."""
    hit = lambda c: F.count_if(c)
    empty = F.col("observed") == 0
    own = cells.groupBy("map").agg(
        F.sum("observed").alias("N"), F.count("*").alias("cells"), hit(~empty).alias("occupied"), hit(empty).alias("empty_cells"), hit(F.col("testable")).alias("testable_cells"), hit(F.col("testable") & empty).alias("empty_testable_cells"),
        hit(F.col("emptier_than_chance")).alias("flagged_cells"), hit(F.col("empty_beyond_chance")).alias("empty_beyond_chance_cells"), hit(F.col("emptier_than_chance") & (F.col("observed_all_species") > 0)).alias("depleted_occupied_cells"), hit(F.col("emptied_by_exclusion")).alias("cells_emptied_by_exclusion"),
    )
    perms = fixed(cells.sparkSession, [(k, m.n_perm) for k, m in enumerate(lattice.maps)], "map int, n_perm int")
    every = perms.filter("n_perm > 0").select("map", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_perm").cast("long") - 1)).alias("perm")).withColumn("n", F.lit(0).cast("long"))
    occupied = every.unionByName(null.groupBy("map", "perm").agg(F.count("*").alias("n"))).groupBy("map", "perm").agg(F.sum("n").alias("n")).join(F.broadcast(own.select("map", "occupied")), "map")
    drawn = occupied.groupBy("map").agg(F.avg("n").alias("null_occupied_mean"), F.expr("percentile(n, 0.025)").alias("null_occupied_lo"), F.expr("percentile(n, 0.975)").alias("null_occupied_hi"), F.count_if(F.col("n") <= F.col("occupied")).alias("_fewer"))
    out = own.join(drawn, "map", "left").join(perms, "map")
    return out.withColumns({"p_fewer_occupied_than_null": (1 + F.coalesce("_fewer", F.lit(0))) / (F.col("n_perm") + 1), "occupied_frac": F.col("occupied") / F.col("cells"), "mean_per_cell": F.col("N") / F.col("cells"), "null_occupied_frac": F.col("null_occupied_mean") / F.col("cells"), "min_p_possible": 1 / (F.col("n_perm") + 1)}).drop("_fewer")


def occupy(df: DataFrame, cfg: Config, maps: list[Map]) -> Results:
    """All maps at once, worked out. The rows are read once, for the statistics; the tables are held until close()."""
    lattice, held = Lattice(cfg, maps), []

    def hold(table: DataFrame) -> DataFrame:
        held.append(kept(table))
        return held[-1].rows

    every = hold(statistics(df, lattice))
    used = hold(kept_strata(every, lattice))
    levels = hold(level_counts(used, lattice))
    null = hold(draws(levels, lattice))
    cells = hold(flagged(hold(cell_tables(every, used, levels, null, lattice)), lattice))
    return Results(lattice, levels, cells, hold(summaries(cells, null, lattice)), held)


def survivors(results: Results, name: str) -> list[int]:
    """The numbers of a map's cells that are empty beyond chance; at most as many as its grid has."""
    return [r["cell_id"] for r in results.cells.filter((F.col("map") == results.number(name)) & F.col("empty_beyond_chance")).select("cell_id").orderBy("cell_id").collect()]


def _level_of(lattice: Lattice, m: Map) -> dict[str, Column]:
    """The level number of each of the map's traits, from cell_id."""
    panel = lattice.panel(m)
    return {t: (F.floor(F.col("cell_id") / s) % n).cast("int") for t, n, s in zip(panel, occupancy.sizes(panel), occupancy.strides(panel), strict=True)}


def contributions(results: Results, name: str, cells: list[int], df: DataFrame | None = None) -> DataFrame:
    """For each of the cells, which strata the map's null expects to fill it, with the share of each of its levels. From
    the level counts that the null is drawn from: no row is read again, but for the parents of strata, if df is given."""
    k = results.number(name)
    m = results.lattice.maps[k]
    own = results.levels.filter(F.col("map") == k).withColumn("N", F.aggregate(F.filter("counts", lambda x: x["trait"] == 0), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    own = own.withColumn("cell_id", F.explode(F.lit(cells).cast("array<long>")))
    count = lambda j, level: F.aggregate(F.filter("counts", lambda x: (x["trait"] == j) & (x["level"] == level)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    levels = _level_of(results.lattice, m)
    own = own.withColumns({f"share_{t}": count(j, level) / F.col("N") for j, (t, level) in enumerate(levels.items())})
    own = own.withColumn("expected_in_cell", reduce(lambda a, b: a * b, [F.col(f"share_{t}") for t in levels], F.col("N").cast("double")))
    out = own.filter("expected_in_cell > 0").select("cell_id", "stratum", "N", *[f"share_{t}" for t in levels], "expected_in_cell")
    rank = RANKS.index(m.null) if m.null else 0
    if df is None or rank == 0:
        return out
    taxa = chosen(df, Lattice(results.lattice.cfg, [m])).groupBy(F.get("taxa", F.lit(rank)).alias("stratum")).agg(F.min(F.get("taxa", F.lit(0))).alias(f"gtdb_{RANKS[0]}"))
    return out.join(taxa, "stratum", "left").select("cell_id", "stratum", "N", f"gtdb_{RANKS[0]}", *[f"share_{t}" for t in levels], "expected_in_cell")


def carriers(df: DataFrame, results: Results, name: str, cells: list[int], child: str = "family") -> DataFrame:
    """For each of the cells and each stratum of the map, which children carry each of its levels, which carry all, and the
    level that the fewest rows have. Rows are counted by stratum, child and levels before they meet the cells."""
    m = results.lattice.maps[results.number(name)]
    own = Lattice(results.lattice.cfg, [m])
    taxon = lambda rank: F.get("taxa", F.lit(RANKS.index(rank)))
    levels = _level_of(own, m)
    place = {t: own.traits.index(t) for t in m.traits}
    rows = chosen(df, own).groupBy(taxon(m.null).alias("stratum"), taxon(child).alias("child"), "codes").agg(F.count("*").alias("n"))
    rows = rows.withColumn("cell_id", F.explode(F.lit(cells).cast("array<long>")))
    has = {c: F.sum(F.when(F.get("codes", F.lit(place[t])) == level, F.col("n")).otherwise(0)).alias(f"n_{c}") for t, (c, level) in zip(m.traits, levels.items(), strict=True)}
    each = rows.groupBy("cell_id", "stratum", "child").agg(F.sum("n").alias("n"), *has.values())
    sets = [F.sort_array(F.collect_set(F.when(F.col(f"n_{c}") > 0, F.col("child")))).alias(f"with_{c}") for c in has]  # children of one stratum
    label = occupancy.level_columns(own.panel(m))
    shares = [F.struct((F.sum(f"n_{c}") / F.sum("n")).alias("share"), F.lit(c).alias("trait")) for c in has]
    out = each.groupBy("cell_id", "stratum").agg(F.sum("n").alias("N"), *sets, F.array_min(F.array(*shares)).alias("_least")).select("*", *label)
    every = reduce(F.array_intersect, [F.col(f"with_{c}") for c in has])
    named = F.concat_ws("=", "_least.trait", F.element_at(F.create_map(*[x for c in has for x in (F.lit(c), F.col(c))]), F.col("_least.trait")))
    return out.select("cell_id", "stratum", "N", *[f"with_{c}" for c in has], every.alias("with_all"), named.alias("rarest_level"), F.col("_least.share").alias("rarest_share"))


def capacity(df: DataFrame, cfg: Config, subsets: list[list[str]]) -> DataFrame:
    """For each subset its rows, cells and the spread of its expected counts; no permutations."""
    lattice = Lattice(cfg, [Map(" + ".join(t), tuple(t)) for t in subsets])
    spark = df.sparkSession
    every = statistics(df, lattice)
    full = lattice.grid(spark).join(expected(level_counts(every, lattice), lattice), ["map", "cell_id"], "left").fillna(0.0, ["expected"])
    least = cfg["analysis"]["min_expected_for_test"]
    own = full.groupBy("map").agg(F.count("*").alias("cells"), F.min("expected").alias("expected_min"), F.expr("percentile(expected, 0.5)").alias("expected_median"), F.max("expected").alias("expected_max"), F.avg((F.col("expected") >= least).cast("double")).alias("testable_cell_frac"), F.sum("expected").alias("_n"))
    names = fixed(spark, [(k, len(m.traits), m.name) for k, m in enumerate(lattice.maps)], "map int, size int, traits string")
    n = F.round("_n").cast("long")
    return own.join(names, "map").select("size", "traits", n.alias("N"), "cells", "expected_min", "expected_median", "expected_max", "testable_cell_frac", (n / F.col("cells")).alias("N_per_cell"))
