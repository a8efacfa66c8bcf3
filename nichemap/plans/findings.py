"""What the report's tables say: rules, each a condition and a sentence, over a table of figures.

Figures are a row a subject (a panel, or a surviving cell of one) and a column a figure, joined from the report's tables. A
rule is two SQL expressions over these columns; all rules are evaluated in one pass over the figures, and a rule speaks of
every subject whose figures meet its condition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config


@dataclass(frozen=True)
class Rule:
    """subject: panel or cell; when and says: SQL expressions over the subject's figures."""

    name: str
    subject: str
    when: str
    says: str


def said(text: str, *figures: str) -> str:
    """A sentence with figures in it, as an expression; %s of a text, %.1f and the like of a number."""
    quoted = text.replace("'", "''")
    return f"format_string('{quoted}', {', '.join(figures)})" if figures else f"'{quoted}'"


RULES = (
    Rule("deficit_strict", "panel", "strict", said("The deficit falls with every finer shuffle: %s cells.", "deficits")),
    Rule("deficit_nonincreasing", "panel", "nonincreasing and not strict", said("The deficit never rises with finer shuffles, but some steps leave it as it is: %s cells.", "deficits")),
    Rule("deficit_uneven", "panel", "not nonincreasing", said("Finer shuffles do not lower the deficit steadily: %s cells.", "deficits")),
    Rule("order_deficit", "panel", "p_order < alpha", said("Within orders species still fill fewer cells than shuffles do (P = %.2g).", "p_order")),
    Rule("order_no_deficit", "panel", "p_order >= alpha", said("Within orders species fill about as many cells as shuffles do (P = %.2g).", "p_order")),
    Rule("no_survivor", "panel", "survivors = 0", said("No cell stays empty beyond chance within orders.")),
    Rule("survivors_absorbed", "panel", "survivors > 0 and family_survivors = 0", said("%s stay empty beyond chance within orders, none of them within families: lineages account for what is missing.", "cells_text(survivors)")),
    Rule("survivors_left", "panel", "family_survivors > 0", said("%s stay empty beyond chance within orders, and %s within families too: lineages do not account for these.", "cells_text(survivors)", "cast(family_survivors AS string)")),
    Rule("subsets_deficit", "panel", "least_q_subsets < alpha", said("Of the maps of fewer traits some keep a deficit within orders (least q %.2g over maps).", "least_q_subsets")),
    Rule("subsets_none", "panel", "least_q_subsets >= alpha", said("No map of fewer traits keeps a deficit within orders (least q %.2g over maps).", "least_q_subsets")),
    Rule("largest_groups", "panel", "groups >= 3", said("The three largest phyla have %.0f %% of the species and %.0f %% of the occupied cells.", "100 * top_share", "100 * top_cells_share")),
    Rule("largest_deficit", "panel", "group_deficit > 0", said("Of all phyla %s lacks most against its own shuffles: %.1f cells.", "group_name", "group_deficit")),
    Rule("power", "panel", "minimum_detectable is not null", said("Emptiness is sure to be found only where at least %.1f species are expected within orders: %s of %s cells, with %.0f %% of the expected species.", "minimum_detectable", "cast(cells_above AS string)", "cast(cells AS string)", "100 * share_above")),
    Rule("no_power", "panel", "testable_cells = 0", said("No cell can be tested within orders; what is empty there says nothing.")),
    Rule("small_flagged", "panel", "small_flagged > 0", said("Without counting the species of small orders, %s would have been taken for gaps.", "cells_text(small_flagged)")),
    Rule("small_close", "panel", "small_cells > 0 and small_flagged = 0 and small_least_q < 2 * alpha", said("%s are held by small orders alone; counted as empty the nearest would just have missed significance (q = %.2g).", "cells_text(small_cells)", "small_least_q")),
    Rule("small_harmless", "panel", "small_cells > 0 and small_flagged = 0 and not coalesce(small_least_q < 2 * alpha, false)", said("%s are held by small orders alone; counted as empty none would have been significant.", "cells_text(small_cells)")),
    Rule("small_stronger", "panel", "small_flagged > 0 and small_least_q < survivor_least_q", said("One of these would have looked stronger than any true survivor (q %.2g against %.2g).", "small_least_q", "survivor_least_q")),
    Rule("control_passes", "panel", "control_passes", said("The known gap (%s) is found globally and laid to lineages, as it should be.", "control")),
    Rule("control_fails", "panel", "not control_passes", said("The known gap (%s) is not found globally, or is found within orders: inspect before any other cell is trusted.", "control")),
    Rule("cell_order", "cell", "true", said("Within orders %.1f species are expected of %s (q = %.2g).", "expected", "cell", "q_low")),
    Rule("cell_both_seeds", "cell", "again", said("Draws of another seed find it too.")),
    Rule("cell_one_seed", "cell", "not again", said("Draws of another seed do not find it: it is on the border.")),
    Rule("cell_family_untestable", "cell", "not family_testable", said("Within families %.2f are expected, too few for a test.", "family_expected")),
    Rule("cell_family_gone", "cell", "family_testable and not family_empty", said("Within families %.2f are expected, and it is no longer significant.", "family_expected")),
    Rule("cell_family_left", "cell", "family_empty", said("Within families %.2f are expected, and it is significant still.", "family_expected")),
    Rule("cell_source", "cell", "top_stratum is not null", said("%.0f %% of the expectation comes from %s (%s species).", "100 * top_stratum_share", "top_stratum", "cast(top_stratum_n AS string)")),
    Rule("cell_split", "cell", "split_share > 0", said("%.0f %% comes from orders of which no family carries every level.", "100 * split_share")),
    Rule("cell_optimum", "cell", "optimum_state is not null", said("With temperatures of optima alone it %s.", "optimum_state")),
    Rule("cell_genus", "cell", "genus_state is not null", said("With one strain a genus it %s.", "genus_state")),
    Rule("cell_nowhere", "cell", "carriers = 0", said("No strain has the combination, with a genome or without.")),
    Rule("cell_somewhere", "cell", "carriers > 0", said("Of all strains %s have the combination, with a genome or without: %s%s.", "cast(carriers AS string)", "carrier_names", "if(carriers > 5, ' and others', '')")),
)


def findings(figures: DataFrame, subject: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(panel, cell, place, rule, sentence) of the rules for subjects of this kind whose conditions their figures meet. A figure
    that is null meets no condition."""
    cells_text = lambda text: reduce(lambda t, n: t.replace(f"cells_text({n})", f"if({n} = 1, '1 cell', concat(cast({n} AS string), ' cells'))"), ("survivors", "small_flagged", "small_cells"), text)
    own = [(k, r) for k, r in enumerate(rules) if r.subject == subject]
    every = [F.when(F.expr(r.when), F.struct(F.lit(k).alias("place"), F.lit(r.name).alias("rule"), F.expr(cells_text(r.says)).alias("sentence"))) for k, r in own]
    cell = F.col("cell") if "cell" in figures.columns else F.lit(None).cast("string")
    return figures.select("panel", cell.alias("cell"), F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("f")).select("panel", "cell", "f.*")


def side(table: DataFrame, key: str, **figures: Column) -> DataFrame:
    """One row of figures of a panel."""
    return table.agg(*[v.alias(k) for k, v in figures.items()]).withColumn("panel", F.lit(key))


def panel_figures(made: dict[str, DataFrame], cfg: Config, keys: tuple[str, ...]) -> DataFrame:
    """A row a panel; figures of tables that a report hasn't made are null."""
    c, alpha = F.col, cfg["analysis"]["fdr_alpha"]
    at = lambda null, x: F.max(F.when(c("null") == null, c(x)))
    rows = []
    for key in keys:
        parts = [
            side(made[f"occupied_vs_expected_{key}"], key, cells=at("global", "cells"), N=at("global", "N"), p_order=at("order", "p_fewer_occupied_than_null"), survivors=at("order", "empty_beyond_chance_cells"), testable_cells=at("order", "testable_cells")),
            made["deficit_trend"].filter(c("panel") == key).select("panel", F.array_join(F.transform("deficits", lambda x: F.format_string("%.1f", x)), " > ").alias("deficits"), "nonincreasing", "strict"),
            side(made[f"minimum_detectable_constraint_{key}"].filter("null = 'order'"), key, minimum_detectable=F.max("minimum_detectable"), cells_above=F.max("cells_above"), share_above=F.max("expected_share_above")),
            side(made[f"small_strata_false_positives_{key}"], key, small_cells=F.count("*"), small_flagged=F.count_if("would_be_flagged"), small_least_q=F.min("q_low")),
            side(made[f"cells_{key}_primary_order"].filter("empty_beyond_chance"), key, survivor_least_q=F.min("q_low")),
            _groups(made[f"phylum_occupancy_{key}"], key),
        ]
        family = made.get(f"survivors_{key}_views")
        parts.append(side(family.filter("view = 'primary' and null = 'family'"), key, family_survivors=F.count_if("empty_beyond_chance")) if family is not None else None)
        grid = made.get("order_level_deficit_across_maps") if key == keys[0] else None
        parts.append(side(grid, key, least_q_subsets=F.min("q_deficit")) if grid is not None else None)
        control = made.get(f"positive_control_{key}")
        parts.append(side(control, key, control=F.first("control"), control_passes=F.first("passes")) if control is not None else None)
        rows.append(reduce(lambda a, b: a.join(b, "panel", "left"), [p for p in parts if p is not None]))
    every = {f.name: f.dataType for r in rows for f in r.schema.fields} | {"family_survivors": "long", "least_q_subsets": "double", "control": "string", "control_passes": "boolean"}
    full = [r.select(*[F.col(n) if n in r.columns else F.lit(None).cast(t).alias(n) for n, t in every.items()]) for r in rows]
    return reduce(lambda a, b: a.unionByName(b), full).withColumn("alpha", F.lit(alpha)).fillna(0, ["family_survivors"])


def _groups(table: DataFrame, key: str) -> DataFrame:
    """Of a panel's phyla: the share of the three largest, and the one that lacks most against its own shuffles."""
    row = F.struct((-F.col("N")).alias("size"), F.col("grp").alias("grp"), F.col("N").alias("N"), F.col("cumulative_share").alias("cells"))
    own = table.agg(F.count("*").alias("groups"), F.sum("N").alias("_all"), F.slice(F.sort_array(F.collect_list(row)), 1, 3).alias("_top"), F.max(F.struct((F.col("null_occupied_mean") - F.col("cells_occupied")).alias("d"), F.col("grp").alias("grp"))).alias("_lacks"))  # phyla
    top = F.aggregate("_top", F.lit(0).cast("long"), lambda a, x: a + x["N"])
    return own.select(F.lit(key).alias("panel"), "groups", (top / F.col("_all")).alias("top_share"), F.array_max(F.transform("_top", lambda x: x["cells"])).alias("top_cells_share"), F.col("_lacks.grp").alias("group_name"), F.col("_lacks.d").alias("group_deficit"))


def cell_figures(df: DataFrame, made: dict[str, DataFrame], cfg: Config, keys: tuple[str, ...]) -> DataFrame | None:
    """A row a surviving cell of any panel, from the survivors' tables; None if there is none."""
    rows = []
    for key in keys:
        if f"survivors_{key}_views" not in made:
            continue
        panel, c = cfg.panel_levels(cfg.panel(key)), F.col
        label = F.concat_ws(", ", *(F.concat(F.lit(f"{t}="), t) for t in panel))
        own = made[f"cells_{key}_all_nulls"].filter("order_empty").select("cell_id", *panel, label.alias("cell"), c("order_expected").alias("expected"), c("order_q").alias("q_low"), c("order_empty_again").alias("again"))
        state = F.when(c("empty_beyond_chance"), "stays").when(~c("testable"), "can't be tested").otherwise(F.format_string("is not significant (q = %.2g)", "q_low"))
        view = lambda name, null, x: F.max(F.when((c("view") == name) & (c("null") == null), x))
        views = made[f"survivors_{key}_views"].groupBy("cell_id").agg(view("primary", "family", c("expected")).alias("family_expected"), view("primary", "family", c("testable")).alias("family_testable"), view("primary", "family", c("empty_beyond_chance")).alias("family_empty"), view("optimum-only", "order", state).alias("optimum_state"), view("genus-level", "order", state).alias("genus_state"))
        carried = made[f"survivors_{key}_family_carriers"].select("cell_id", "stratum", (F.size("with_all") == 0).alias("_split"))
        given = made[f"survivors_{key}_order_contributions"].join(carried, ["cell_id", "stratum"], "left")
        best = F.max(F.struct(c("expected_in_cell").alias("e"), c("stratum").alias("stratum"), c("N").alias("N")))
        source = given.groupBy("cell_id").agg(best.alias("_best"), F.sum("expected_in_cell").alias("_sum"), F.sum(F.when(c("_split"), c("expected_in_cell")).otherwise(0.0)).alias("_apart"))
        source = source.select("cell_id", c("_best.stratum").alias("top_stratum"), (c("_best.e") / c("_sum")).alias("top_stratum_share"), c("_best.N").alias("top_stratum_n"), (c("_apart") / c("_sum")).alias("split_share"))
        having = df.join(F.broadcast(own.select("cell_id", *panel)), [*panel]).select("cell_id", "bacdive_id")
        few = having.withColumn("_n", F.row_number().over(W.partitionBy("cell_id").orderBy("bacdive_id"))).filter("_n <= 5").groupBy("cell_id").agg(F.sort_array(F.collect_list("bacdive_id")).alias("_who"))
        who = having.groupBy("cell_id").agg(F.count("*").alias("carriers")).join(few, "cell_id")
        rows.append(own.join(views, "cell_id", "left").join(source, "cell_id", "left").join(who, "cell_id", "left").select(F.lit(key).alias("panel"), "cell", "expected", "q_low", "again", "family_expected", "family_testable", "family_empty", "optimum_state", "genus_state", "top_stratum", "top_stratum_share", "top_stratum_n", "split_share", F.coalesce("carriers", F.lit(0)).alias("carriers"), F.concat_ws(", ", c("_who").cast("array<string>")).alias("carrier_names")))
    return reduce(lambda a, b: a.unionByName(b), rows) if rows else None


def table_of(df: DataFrame, made: dict[str, DataFrame], cfg: Config, keys: tuple[str, ...] = ("core", "no_spore")) -> DataFrame:
    """Every finding of a report, in the order of panels, cells and rules."""
    out = findings(panel_figures(made, cfg, keys), "panel")
    cells = cell_figures(df, made, cfg, keys)
    return out if cells is None else out.unionByName(findings(cells, "cell"))
