"""The tables of a report, by name, each a lazy frame over the joined table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import coverage, maps, occupancy
from ..operators.maps import Map
from ..operators.selection import ALL_TRAITS, analysis_set
from . import findings

LABELS = {"gram": "gram stain", "shape": "cell shape", "motility": "motility", "spore": "spore formation", "oxygen": "oxygen tolerance", "temperature": "temperature", "ph": "pH", "halophily_level": "halophily (curated level)"}
NULLS = (None, "phylum", "class", "order")
VIEWS = {"primary": ("coarse", "species", "all"), "strain-level": ("coarse", "strain", "all"), "optimum-only": ("coarse", "species", "optimum"), "genus-level": ("coarse", "genus", "all"), "fine_bins": ("fine", "species", "all")}
OUTCOMES = {"lists_assembly": "bacdive_lists_assembly", "genome_matched": "genome_matched"}


def name_of(null: str | None) -> str:
    return null or "global"


def subsets(cfg: Config, sizes: tuple[int, ...] = (4, 5)) -> list[list[str]]:
    """Every subset of the core panel of these sizes, then the panel."""
    return [list(c) for k in sizes for c in combinations(cfg.panel("core"), k)] + [cfg.panel("core")]


def attrition(df: DataFrame, cfg: Config) -> DataFrame:
    stages: dict[str, Column] = {"1. strains retrieved": F.lit(True), "2. at least one trait populated (raw)": F.col("any_trait_populated")}
    stages |= {f"3. {LABELS[t]} — usable value": F.col(f"{t}_usable") for t in ALL_TRAITS} | {"3. (NaCl growth tests present, raw only)": F.col("nacl_tests_populated")}
    stages |= {"4. morphology panel complete": F.col("morph4_complete"), "5. core panel complete": F.col("core6_complete"), "5a. core panel, temperature from optimum": F.col("core6_complete_optimum_temp"), "5b. no-spore panel complete": F.col("nospore5_complete"), "5c. eight traits complete": F.col("all8_reference_complete")}
    return coverage.funnel(df, stages, F.col("genome_matched"), "gtdb_species")


def per_trait(df: DataFrame) -> DataFrame:
    """What each trait loses between raw observations and usable values."""
    c = F.count_if
    row = df.agg(*[x for t in ALL_TRAITS for x in (c(f"{t}_populated").alias(f"p_{t}"), c(f"{t}_usable").alias(f"u_{t}"), c(f"{t}_conflict").alias(f"c_{t}"), c(F.col(f"{t}_usable") & F.col("genome_matched")).alias(f"g_{t}"))])
    structs = [F.struct(F.lit(LABELS[t]).alias("trait"), F.col(f"p_{t}").alias("any_raw"), F.col(f"u_{t}").alias("usable"), F.col(f"c_{t}").alias("lost_to_conflict"), (F.col(f"p_{t}") - F.col(f"u_{t}") - F.col(f"c_{t}")).alias("no_binnable_value"), F.col(f"g_{t}").alias("usable_with_genome")) for t in ALL_TRAITS]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def genome_attrition(df: DataFrame, mask: Column) -> DataFrame:
    named = F.col("match_method") == "designation"
    steps = {"in the set": F.lit(True), "lists an assembly": F.col("bacdive_lists_assembly"), "listed assembly in the catalogue": F.col("bacdive_assembly_in_gtdb"), "listed assembly not in the catalogue": F.col("bacdive_lists_assembly") & ~F.col("bacdive_assembly_in_gtdb"), "matched by accession": F.col("match_method") == "accession", "matched by a collection's number": named & (F.col("match_token_kind") == "collection"), "matched by a bare designation": named & (F.col("match_token_kind") == "bare"), "matched": F.col("genome_matched"), "unmatched": ~F.col("genome_matched")}
    return coverage.mask_counts(df, steps, {"set": mask})


def type_strains(df: DataFrame) -> DataFrame:
    a, b = F.coalesce(F.col("type_strain_bacdive"), F.lit(False)), F.col("gtdb_is_type_strain_of_species")
    return coverage.mask_counts(df, {"type strain by the record": a, "type strain by the catalogue": b, "either": a | b, "both": a & b, "by the record only": a & ~b}, {"set": F.lit(True)})


def availability(df: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    sets = {"all": F.lit(True), "morphology": F.col("morph4_complete"), "core": F.col("core6_complete"), "core, optimum temperature": F.col("core6_complete_optimum_temp")}
    usable = {LABELS[t]: F.col(f"{t}_usable") for t in [*cfg.panel("core"), "ph", "halophily_level"]}
    out: dict[str, DataFrame] = {}
    for name, column in OUTCOMES.items():
        y = F.col(column)
        rows = None
        for label, mask in sets.items():
            one = coverage.fisher_of(df, mask, y).withColumn("set", F.lit(label))
            rows = one if rows is None else rows.unionByName(one)
        out |= {f"genome_availability_sets_{name}": rows, f"genome_availability_by_n_traits_{name}": coverage.rate_by_number(df, F.col("n_core_usable"), len(cfg.panel("core")), y), f"genome_availability_per_trait_{name}": coverage.with_without(df, usable, y)}
    return out


def settled(table: DataFrame) -> DataFrame:
    """A report's table as a table of its own, with no plan behind it: such tables have as many rows as a grid has cells, or
    as there are strata."""
    return table.sparkSession.createDataFrame(table.toArrow(), table.schema)


def one_map(cfg: Config, name: str, traits: list[str], view: str = "primary", null: str | None = None, n_perm: int | None = None, offset: int = 0) -> Map:
    """A map in a view under a null; offset tells its seed from others of the same settings."""
    binning, level, temp = VIEWS[view]
    return Map(name, tuple(traits), binning, level, temp, null, n_perm or cfg["analysis"]["n_perm_full"], cfg["analysis"]["seed"] + offset)


def occupancy_of(df: DataFrame, cfg: Config, traits: list[str], view: str = "primary", null: str | None = None, n_perm: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells, summary) of one map in one view under one null, worked out."""
    with maps.occupy(df, cfg, [one_map(cfg, "own", traits, view, null, n_perm, offset)]) as made:
        return settled(made.cells_of("own")), settled(made.summaries.drop("map"))


def grid_maps(cfg: Config, nulls: tuple[str | None, ...] = NULLS, n_perm: int | None = None, view: str = "primary", sizes: tuple[int, ...] = (4, 5)) -> list[Map]:
    """Every subset of the core panel under every null."""
    most = n_perm or cfg["analysis"]["n_perm_subset"]
    return [one_map(cfg, f"grid_{j}_{name_of(null)}", traits, view, null, most, 100 * i + j) for j, traits in enumerate(subsets(cfg, sizes)) for i, null in enumerate(nulls)]


def grid_tables(made: maps.Results, cfg: Config, own: list[Map]) -> tuple[DataFrame, DataFrame]:
    """(a row for each subset and null, with the q value of its deficit among the maps of the null; the cells of any map that
    survive the order-level shuffle, with their q values there and under the global null)."""
    rows = made.summaries_of([m.name for m in own]).withColumn("morphology_map", F.col("traits") == " + ".join(cfg.panel("morphology")))
    # the deficits of one null over its maps are tests of one family
    rows = occupancy.bh_qvalues(rows.drop("name", "binning", "level", "temp_source"), "p_fewer_occupied_than_null", ("null",), "q_deficit")
    spark, pairs, labels = made.cells.sparkSession, [], []
    for m in own:
        if m.null == "order" and (other := m.name.removesuffix("order") + "global") in {x.name for x in own}:
            pairs.append((made.number(m.name), made.number(other), " + ".join(m.traits)))
            panel = made.lattice.panel(m)
            label = F.concat_ws(", ", *(F.concat(F.lit(f"{t}="), c) for t, c in zip(m.traits, occupancy.level_columns(panel), strict=True)))
            labels.append(F.when(F.col("map") == pairs[-1][0], label))
    if not pairs:
        return rows, spark.createDataFrame([], "traits string, cell string, expected double, q_order double, q_global double")
    found = made.cells.filter("empty_beyond_chance").join(maps.fixed(spark, pairs, "map int, _other int, traits string"), "map")
    other = made.cells.select(F.col("map").alias("_other"), "cell_id", F.col("q_low").alias("q_global"))
    found = found.join(other, ["_other", "cell_id"])
    return rows, found.select("traits", F.coalesce(*labels).alias("cell"), "expected", F.col("q_low").alias("q_order"), "q_global")


def occupancy_grid(df: DataFrame, cfg: Config, nulls: tuple[str | None, ...] = NULLS, n_perm: int | None = None, view: str = "primary", sizes: tuple[int, ...] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """The tables of `grid_tables`, of all subsets of the core panel in one plan."""
    own = grid_maps(cfg, nulls, n_perm, view, sizes)
    with maps.occupy(df, cfg, own) as made:
        rows, found = grid_tables(made, cfg, own)
        return settled(rows), settled(found)


def reasons(log: DataFrame) -> DataFrame:
    return log.groupBy("reason").count().orderBy(F.col("count").desc(), "reason")


def marked(merged: DataFrame, cfg: Config, traits: list[str]) -> DataFrame:
    """The cells of a panel as a grid: counts, and a mark for what the nulls say of the empty ones."""
    testable = F.col("global_testable") | F.col("phylum_testable") | F.col("class_testable") | F.col("order_testable")
    mark = F.when(F.col("observed_all") > 0, F.col("observed_all").cast("string")).when(F.col("order_empty"), "**0✗**").when(F.col("category").startswith("phylogenetic"), "0†").when(testable, "0").otherwise("·")
    across = [t for t in traits if t in ("oxygen", "temperature")] or traits[-1:]
    return occupancy.crosstab(merged, [t for t in traits if t not in across], across, cfg.panel_levels(traits), mark)


def side_by_side(maps: dict[str, DataFrame]) -> DataFrame:
    """The figures of each panel's maps, a row a figure and null, a column a panel."""
    figures = ["N", "cells", "occupied", "null_occupied_mean", "testable_cells", "empty_testable_cells", "empty_beyond_chance_cells"]
    out = None
    for key, m in maps.items():
        long = m.select("null", F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias(key)) for f in figures])).alias("r")).select("null", "r.*")
        out = long if out is None else out.join(long, ["null", "figure"], "full_outer")
    return out


def capacity(df: DataFrame, cfg: Config, panel: list[str] | None = None) -> DataFrame:
    """Expected counts of every non-empty subset of the panel; each subset has an analysis set of its own."""
    panel = panel or cfg.panel("core")
    return maps.capacity(df, cfg, [list(c) for k in range(1, len(panel) + 1) for c in combinations(panel, k)])


def strata_bookkeeping(df: DataFrame, cfg: Config, traits: list[str], sizes: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    sub, out = analysis_set(df, traits), None
    for rank in NULLS[1:]:
        for least in sizes:
            row = occupancy.strata_summary(sub, f"gtdb_{rank}", least).select(F.lit(rank).alias("rank"), F.lit(least).alias("min_size"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def doi_dates(df: DataFrame) -> DataFrame:
    """How many records carry each release date, most first."""
    return df.filter(F.col("doi_date").isNotNull()).groupBy("doi_date").count().orderBy(F.col("count").desc(), "doi_date")


def small_strata(sub: DataFrame, cells: DataFrame, traits: list[str], alpha: float, rank: str = "gtdb_order") -> DataFrame:
    """Testable cells that only strata left out as too small fill: the q that they have as empty ones, whether that would have
    flagged them, and the sizes of the strata of their species."""
    hit = cells.filter("emptied_by_exclusion and testable")
    stratum = F.coalesce(F.col(rank), F.lit(occupancy.UNASSIGNED))
    size = sub.groupBy(stratum.alias("_stratum")).agg(F.count("*").alias("_size"))
    held = sub.withColumn("_stratum", stratum).join(F.broadcast(hit.select(*traits, "cell_id")), traits).join(size, "_stratum")  # a panel's cells
    sizes = held.groupBy("cell_id").agg(F.array_join(F.sort_array(F.collect_list("_size")), ", ").alias("stratum_sizes"))  # fewer a cell than a stratum needs to count
    flagged = F.coalesce(F.col("q_low") < alpha, F.lit(False)).alias("would_be_flagged")
    return hit.join(sizes, "cell_id").select("cell_id", *traits, "observed_all_species", "observed", "expected", "q_low", flagged, "stratum_sizes")


def deficit_trend(maps: DataFrame, key: str) -> DataFrame:
    """One row: the deficits of a panel's maps from the global null to the finest, whether they never rise, and whether they
    fall at every step."""
    rank = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(NULLS) for x in (name_of(n), k)]), F.col("null"))
    own = maps.agg(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "deficit"))), lambda x: x["deficit"]).alias("deficits"))
    falls, strictly = occupancy.trend(F.col("deficits"))
    return own.select(F.lit(key).alias("panel"), "deficits", falls.alias("nonincreasing"), strictly.alias("strict"))


def positive_control(cells: dict[str, DataFrame], control: dict) -> DataFrame:
    """One row: what a known gap does under the global null and within orders; it passes if it fires under the first only."""
    here = " and ".join(f"{k} = '{v}'" for k, v in control["cell"].items())
    fires = [cells[n].filter(here).select(F.col("empty_beyond_chance").alias(f"fires_{n}")) for n in ("global", "order")]
    both = fires[0].join(fires[1], how="cross")  # one cell and one cell
    return both.select(F.lit(control["name"]).alias("control"), "*", (F.col("fires_global") & ~F.col("fires_order")).alias("passes"))


def panel_maps(cfg: Config, key: str, n_perm: int | None = None) -> list[Map]:
    """The maps of a panel: under each null, twice under the global and the finest, in every view, and within families."""
    traits, own = cfg.panel(key), []
    for i, null in enumerate(NULLS):
        own.append(one_map(cfg, f"cells_{key}_primary_{name_of(null)}", traits, "primary", null, n_perm, i))
        if null in (None, "order"):
            own.append(one_map(cfg, f"again_{key}_{name_of(null)}", traits, "primary", null, n_perm, 777_777 + i))
    own += [one_map(cfg, f"cells_{key}_{view}_{name_of(null)}", traits, view, null, n_perm) for view in VIEWS if view != "primary" for null in (None, "order")]
    return [*own, one_map(cfg, f"cells_{key}_primary_family", traits, "primary", "family", n_perm, 424_242)]


def panel_tables(df: DataFrame, cfg: Config, key: str, made: maps.Results, n_perm: int | None = None) -> dict[str, DataFrame]:
    """The tables of one panel: cells under each null, all nulls together, power, phyla, small strata and controls."""
    a, traits = cfg["analysis"], cfg.panel(key)
    panel, sub = cfg.panel_levels(traits), analysis_set(df, traits)
    cells = {name_of(null): made.cells_of(f"cells_{key}_primary_{name_of(null)}") for null in NULLS}
    again = {name: made.cells_of(f"again_{key}_{name}") for name in ("global", "order")}
    own = made.summaries_of([f"cells_{key}_primary_{name}" for name in cells]).withColumn("deficit", F.col("null_occupied_mean") - F.col("occupied"))
    power = [occupancy.detectable(table, n_perm or a["n_perm_full"], a["fdr_alpha"], a["min_expected_for_test"]).withColumn("null", F.lit(name)) for name, table in cells.items()]
    phyla = occupancy.group_null(sub, panel, "gtdb_phylum", n_perm or a["n_perm_phylum_occupancy"], "bacdive_id", a["min_stratum_size"])
    out = {f"cells_{key}_primary_{name}": table for name, table in cells.items()}
    out |= {
        f"cells_{key}_all_nulls": occupancy.merge_nulls(cells, panel, "order", again),
        f"occupied_vs_expected_{key}": own.drop("name", "binning", "level", "temp_source", "size", "traits"),
        f"minimum_detectable_constraint_{key}": stacked(power),
        f"power_expected_per_cell_{key}": capacity(df, cfg, traits),
        f"strata_{key}": strata_bookkeeping(df, cfg, traits),
        f"phylum_occupancy_{key}": occupancy.group_occupancy(sub, panel, "gtdb_phylum").join(phyla, "grp", "left"),
        f"small_strata_false_positives_{key}": small_strata(sub, cells["order"], traits, a["fdr_alpha"]),
    }
    for n, control in enumerate(c for c in a.get("positive_controls", []) if c["panel"] == key):
        out[f"positive_control_{key}" + f"_{n + 1}" * bool(n)] = positive_control(cells, control)
    return out


def view_summaries(cfg: Config, made: maps.Results, keys: tuple[str, ...]) -> DataFrame:
    """The figures of every panel's map in every view and null, with the view's name."""
    own = [(m.name, view, key) for key in keys for view in VIEWS for m in made.lattice.maps if m.name.startswith(f"cells_{key}_{view}_") and not m.name.endswith("_family")]
    names = maps.fixed(made.cells.sparkSession, own, "name string, view string, panel string")
    return made.summaries_of([n for n, _, _ in own]).join(names, "name").drop("name", "binning", "level", "temp_source", "size", "traits")


def stacked(rows: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rows)


def survivors(df: DataFrame, cfg: Config, key: str, made: maps.Results) -> dict[str, DataFrame]:
    """For the cells of a panel that survive the finest shuffle, all together: the orders that are expected to fill them,
    which of their families carry which levels, and the cells in each of the views; and the map under families. A part of
    each table by itself for each cell."""
    traits, order = cfg.panel(key), f"cells_{key}_primary_order"
    found = maps.survivors(made, order)
    if not found:
        return {}
    panel = cfg.panel_levels(traits)
    out = {f"cells_{key}_primary_family": made.cells_of(f"cells_{key}_primary_family")}
    seen = [(made.number(m.name), view, name_of(m.null)) for view in VIEWS if not view.startswith("fine") for m in made.lattice.maps if m.name.startswith(f"cells_{key}_{view}_") and (m.null in (None, "order") or view == "primary" and m.null == "family")]
    views = made.cells.join(maps.fixed(made.cells.sparkSession, seen, "map int, view string, null string"), "map").filter(F.col("cell_id").isin(found))
    every = {
        "order_contributions": maps.contributions(made, order, found, df),
        "family_carriers": maps.carriers(df, made, order, found),
        "views": views.select("cell_id", "view", "null", "observed_all_species", "expected", "testable", "q_low", "empty_beyond_chance"),
    }
    for what, table in every.items():
        out[f"survivors_{key}_{what}"] = table.select("cell_id", *occupancy.level_columns(panel), *[c for c in table.columns if c != "cell_id"])
    for cell in found:
        levels = [v[cell // s % len(v)] for v, s in zip(panel.values(), occupancy.strides(panel), strict=True)]
        for what, table in every.items():
            own = table.filter(F.col("cell_id") == cell).drop("cell_id")
            out["_".join(["survivor", key, *levels, what])] = own.orderBy(F.desc("expected_in_cell"), "stratum") if what == "order_contributions" else own
    return out


def tables(df: DataFrame, cfg: Config, n_perm: int | None = None, grid: bool = True) -> tuple[dict[str, DataFrame], maps.Results]:
    """(every table of the report, the maps' results). All maps are worked out in one plan and held until the results are
    closed; tables read them."""
    from ..operators.linkage import stage_table

    usable = {LABELS[t]: F.col(f"{t}_usable") for t in ALL_TRAITS}
    panels = {k: cfg.panel(k) for k in ("core", "no_spore", "morphology")}
    wider = panels | {"core_ph": [*cfg.panel("core"), "ph"], "original_8": [*cfg.panel("core"), "ph", "halophily_level"]}
    out = {
        "attrition": attrition(df, cfg),
        "per_trait_detail": per_trait(df),
        "match_rate_by_normalisation_step": stage_table(df, {"all": F.lit(True), "core": F.col("core6_complete"), "no_spore": F.col("nospore5_complete")}),
        "coverage": coverage.co_coverage(df, usable),
        "coverage_vs_independence": coverage.independence(df, {k: [F.col(f"{t}_usable") for t in v] for k, v in wider.items()}),
        "genome_attrition_core": genome_attrition(df, F.col("core6_complete")),
        "type_strains_core": type_strains(analysis_set(df, cfg.panel("core"))),
        "doi_dates": doi_dates(df),
    } | availability(df, cfg)
    keys = ("core", "no_spore")
    subsets_of = grid_maps(cfg, n_perm=n_perm) if grid else []
    made = maps.occupy(df, cfg, [m for k in keys for m in panel_maps(cfg, k, n_perm)] + subsets_of)
    trends = []
    for key in keys:
        out |= panel_tables(df, cfg, key, made, n_perm)
        trends.append(deficit_trend(out[f"occupied_vs_expected_{key}"], key))
        out |= {m.name: made.cells_of(m.name) for m in panel_maps(cfg, key) if m.name.startswith("cells_") and "_primary_" not in m.name}
        out |= survivors(df, cfg, key, made)
        out[f"crosstab_{key}"] = marked(out[f"cells_{key}_all_nulls"], cfg, panels[key])
    out["views_summary"], out["deficit_trend"] = view_summaries(cfg, made, keys), stacked(trends)
    out["panels_side_by_side"] = side_by_side({k: out[f"occupied_vs_expected_{k}"] for k in keys})
    if grid:
        out["occupancy_subsets_all_nulls"], out["order_level_survivors_all_maps"] = grid_tables(made, cfg, subsets_of)
        order = out["occupancy_subsets_all_nulls"].filter(F.col("null") == "order")
        out["order_level_deficit_across_maps"] = order.select("traits", "occupied", "null_occupied_mean", "p_fewer_occupied_than_null", "q_deficit")
    out["findings"] = findings.table_of(df, out, cfg, keys)
    return out, made
