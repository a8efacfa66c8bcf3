"""Queries of the report's maps, all of them worked out in one plan, and of the law of their draws: customers are strains of species, nations are orders, and
one combination of levels is left out, so that what the nulls say of it can be told beforehand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import Config
from .functions import designations as D
from .functions.book import Book
from .operators import exact, maps, occupancy
from .plans import findings, reports
from .queries import BALANCES, CUSTOMERS, MIN_STRATUM, SEGMENTS, SQL_CUSTOMERS, SQL_EXPECTED, SQL_PARSED, SQL_STRATA, SQL_TOKENS, customers, query, sql_grid, table, tokens
from .streaming import merging

LEVELS = {"segment": SEGMENTS, "balance": BALANCES, "parity": ["even", "odd"], "temperature": ["high", "low"]}
GAP = {"segment": "BUILDING", "balance": "b1"}
N_PERM = 1000

CFG = Config(
    "".join(f"[traits.{t}]\ncoarse_levels = {v}\nfine_levels = {v}\n" for t, v in LEVELS.items())
    + f"""
[panels]
core = {[*LEVELS]}
no_spore = {[*GAP]}
morphology = {[*GAP]}
[analysis]
seed = 7
n_perm_full = {N_PERM}
n_perm_subset = {N_PERM}
n_perm_phylum_occupancy = 100
min_expected_for_test = 3.0
fdr_alpha = 0.05
min_stratum_size = 5
"""
)


def strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers a species, of which one counts where both are complete; some have no genome, taxon or trait."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    own = customers(spark, sf_dir).withColumns({
        "segment": F.when(k % 6 > 0, F.col("segment")), "balance": F.when(k % 7 > 0, F.col("balance")), "temperature": F.when(k % 8 > 0, F.when(F.floor(k / 2) % 3 == 0, "high").otherwise("low")),
    })
    gap = " and ".join(f"{t} = '{v}'" for t, v in GAP.items())
    own = own.filter(F.expr(f"not coalesce({gap}, false)"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return own.select(
        k.alias("bacdive_id"), *LEVELS, *[F.col(t).alias(f"{t}_fine") for t in LEVELS], F.when(k % 3 > 0, "optimum").otherwise("growth_range").alias("temperature_bin_source"), (k % 10 > 0).alias("genome_matched"), (k % 5 == 0).alias("type_strain_bacdive"), (k % 11 == 0).alias("gtdb_is_type_strain_of_species"),
        F.when(k % 4 > 0, k * 7 % 1009).alias("pref_order"), text("acc", k).alias("gtdb_accession"), F.when(k % 13 > 0, text("s", F.floor(k / 2))).alias("gtdb_species"), text("g", F.floor(k / 6)).alias("gtdb_genus"), text("f", k % 4).alias("gtdb_family"), F.when(k % 17 > 0, text("o", n)).alias("gtdb_order"), text("c", n % 7).alias("gtdb_class"), text("p", n % 3).alias("gtdb_phylum"),
    )


SQL_STRAINS = f"""w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 > 0 THEN segment END AS segment, CASE WHEN c_custkey % 7 > 0 THEN balance END AS balance, parity, CASE WHEN c_custkey % 8 > 0 THEN CASE WHEN c_custkey // 2 % 3 = 0 THEN 'high' ELSE 'low' END END AS temperature, c_custkey % 3 > 0 AS optimum,
 c_custkey % 5 = 0 OR c_custkey % 11 = 0 AS is_type, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 7 % 1009 END AS pref, CASE WHEN c_custkey % 13 > 0 THEN 's' || (c_custkey // 2) END AS species, 'g' || (c_custkey // 6) AS genus, 'f' || c_custkey % 4 AS fam, CASE WHEN c_custkey % 17 > 0 THEN 'o' || c_nationkey ELSE '{occupancy.UNASSIGNED}' END AS ord, 'c' || c_nationkey % 7 AS cls, 'p' || c_nationkey % 3 AS phy
 FROM ({SQL_CUSTOMERS}) WHERE c_custkey % 10 > 0), m AS (SELECT * FROM w WHERE NOT coalesce({' AND '.join(f"{t} = '{v}'" for t, v in GAP.items())}, false))"""
SQL_RANK = {None: "'all'", "phylum": "phy", "class": "cls", "order": "ord", "family": "fam"}


def sql_rows(traits: list[str], view: str = "primary") -> str:
    """The rows of an analysis set."""
    _, level, temp = reports.VIEWS[view]
    where = " AND ".join([f"{t} IS NOT NULL" for t in traits] + ["optimum"] * (temp == "optimum" and "temperature" in traits))
    if level == "strain":
        return f"SELECT * FROM m WHERE {where}"
    return f"SELECT * FROM m WHERE {where} QUALIFY row_number() OVER (PARTITION BY coalesce({level}, 'acc:' || k) ORDER BY is_type DESC, pref NULLS LAST, k) = 1"


def sql_map(traits: list[str], null: str | None, view: str = "primary") -> str:
    """CTEs z (strata that count), u (their rows), e (expected by levels) and o (observed by levels) of one map."""
    parts = " ".join(f"JOIN (SELECT st, {t}, count(*) AS c{i} FROM u GROUP BY ALL) t{i} USING (st)" for i, t in enumerate(traits))
    product = " * ".join(["n::DOUBLE"] + [f"(c{i} / n::DOUBLE)" for i in range(len(traits))])
    own = ", ".join(traits)
    return f"""a AS (SELECT *, {SQL_RANK[null]} AS st FROM ({sql_rows(traits, view)})), z AS (SELECT st, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= {5 if null else 0}), u AS (SELECT * FROM a SEMI JOIN z USING (st)),
e AS (SELECT {own}, sum({product}) AS e FROM z {parts} GROUP BY {own}), o AS (SELECT {own}, count(*) AS c FROM u GROUP BY ALL), oa AS (SELECT {own}, count(*) AS c FROM a GROUP BY ALL)"""


def sql_figures(traits: list[str], null: str | None, view: str = "primary") -> str:
    cells = 1
    for t in traits:
        cells *= len(LEVELS[t])
    return f"""(WITH {sql_map(traits, null, view)} SELECT {len(traits)} AS size, '{' + '.join(traits)}' AS traits, '{view}' AS "view", '{null or 'global'}' AS "null", (SELECT count(*) FROM u) AS N, {cells} AS cells, (SELECT count(*) FROM o) AS occupied, (SELECT count(*) FROM e WHERE e >= 3) AS testable_cells,
(SELECT count(*) FROM (SELECT * FROM oa ANTI JOIN o USING ({', '.join(traits)}))) AS cells_emptied_by_exclusion)"""


PAIRS = reports.subsets(CFG, (2,))[:-1]
OWN = ("size", "traits", "view", "null", "N", "cells", "occupied", "testable_cells", "cells_emptied_by_exclusion")


@query(f"""WITH {SQL_STRAINS}, f AS ({" UNION ALL ".join(sql_figures(t, n) for t in PAIRS for n in reports.NULLS)})
SELECT * EXCLUDE view, CASE WHEN traits = '{' + '.join(GAP)}' THEN 1 / {N_PERM + 1} ELSE 1 END AS p_fewer, CASE WHEN traits = '{' + '.join(GAP)}' THEN {len(PAIRS)} / {N_PERM + 1} ELSE 1 END AS q_deficit FROM f""")
def maps_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of traits under every null, in one plan, with the q values of the maps' deficits: no draw leaves a cell of a
    pair empty, so that the pair with the gap has the least p there is and the others have p 1."""
    rows = maps_of_pairs(spark, sf_dir)[0]
    return rows.select(*[c for c in OWN if c != "view"], F.col("p_fewer_occupied_than_null").alias("p_fewer"), "q_deficit")


def maps_of_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = [m for m in reports.grid_maps(CFG, sizes=(2,)) if len(m.traits) == 2]
    with maps.occupy(strains(spark, sf_dir), CFG, own) as made:
        rows, found = reports.grid_tables(made, CFG, own)
        return reports.settled(rows), reports.settled(found)


@query(f"""WITH {SQL_STRAINS}, {sql_map([*GAP], "order")}, t AS (SELECT count(*) AS n FROM e WHERE e >= 3)
SELECT '{' + '.join(GAP)}' AS traits, '{", ".join(f"{t}={v}" for t, v in GAP.items())}' AS cell, round(e, 6) AS expected, round(t.n / {N_PERM + 1}, 9) AS q_order, round({len(SEGMENTS) * len(BALANCES)} / {N_PERM + 1}, 9) AS q_global FROM e, t WHERE {" AND ".join(f"{t} = '{v}'" for t, v in GAP.items())}""")
def maps_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of any pair of traits that stay empty beyond chance within orders: the gap, and no other; it has the least p of its
    map's testable cells, and q is that p times their number."""
    return maps_of_pairs(spark, sf_dir)[1].select("traits", "cell", F.round("expected", 6).alias("expected"), F.round("q_order", 9).alias("q_order"), F.round("q_global", 9).alias("q_global"))


SHOWN = [(key, view, null) for key in ("core", "no_spore") for view in reports.VIEWS for null in (reports.NULLS if view == "primary" else (None, "order"))]


@query(f"WITH {SQL_STRAINS} " + " UNION ALL ".join(f"SELECT '{key}' AS panel, * EXCLUDE (size, traits) FROM {sql_figures(CFG.panel(key), null, view)}" for key, view, null in SHOWN))
def maps_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of both panels in every view, temperatures from optima among them, in one plan."""
    keys = ("core", "no_spore")
    with maps.occupy(strains(spark, sf_dir), CFG, [m for k in keys for m in reports.panel_maps(CFG, k, 20)]) as made:
        return reports.settled(reports.view_summaries(CFG, made, keys).select("panel", *OWN[2:]))


def survivor_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    df = strains(spark, sf_dir)
    with maps.occupy(df, CFG, reports.panel_maps(CFG, "no_spore")) as made:
        out = reports.survivors(df, CFG, "no_spore", made)
        return {k: reports.settled(t) for k, t in out.items() if k.startswith("survivors_")}


SQL_HAS = {t: f"({t} = '{v}')::INT" for t, v in GAP.items()}


@query(f"""WITH {SQL_STRAINS}, {sql_map([*GAP], "order")}, s AS (SELECT st AS stratum, count(*) AS N, min(phy) AS gtdb_phylum, {", ".join(f"avg({x}) AS share_{t}" for t, x in SQL_HAS.items())} FROM u GROUP BY 1)
SELECT {", ".join(f"'{v}' AS {t}" for t, v in GAP.items())}, stratum, N, CASE WHEN stratum = '{occupancy.UNASSIGNED}' THEN 'p0' ELSE gtdb_phylum END AS gtdb_phylum, {", ".join(f"round(share_{t}, 9) AS share_{t}" for t in GAP)}, round({" * ".join(["N", *(f"share_{t}" for t in GAP)])}, 9) AS expected_in_cell FROM s WHERE {" * ".join(f"share_{t}" for t in GAP)} > 0""")
def survivor_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that are expected to fill the survivors, from the level counts that the null was drawn from."""
    out = survivor_tables(spark, sf_dir)["survivors_no_spore_order_contributions"]
    return out.select(*GAP, "stratum", "N", "gtdb_phylum", *[F.round(f"share_{t}", 9).alias(f"share_{t}") for t in GAP], F.round("expected_in_cell", 9).alias("expected_in_cell"))


@query(f"""WITH {SQL_STRAINS}, a AS ({sql_rows([*GAP])}), s AS (SELECT ord AS stratum, count(*) AS N, {", ".join(f"coalesce(list_sort(list(DISTINCT fam) FILTER ({t} = '{v}')), []) AS with_{t}, avg({SQL_HAS[t]}) AS share_{t}" for t, v in GAP.items())} FROM a GROUP BY 1)
SELECT {", ".join(f"'{v}' AS {t}" for t, v in GAP.items())}, stratum, N, {", ".join(f"array_to_string(with_{t}, ',') AS with_{t}" for t in GAP)}, array_to_string(list_sort(list_intersect({", ".join(f"with_{t}" for t in GAP)})), ',') AS with_all, CASE WHEN share_balance <= share_segment THEN 'balance=b1' ELSE 'segment=BUILDING' END AS rarest_level, round(least({", ".join(f"share_{t}" for t in GAP)}), 9) AS rarest_share FROM s""")
def survivor_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which families of each order carry the levels of the survivors."""
    out = survivor_tables(spark, sf_dir)["survivors_no_spore_family_carriers"]
    return out.select(*GAP, "stratum", "N", *[F.array_join(f"with_{t}", ",").alias(f"with_{t}") for t in GAP], F.array_join(F.sort_array("with_all"), ",").alias("with_all"), "rarest_level", F.round("rarest_share", 9).alias("rarest_share"))


SEEN = [("primary", None), ("primary", "order"), ("primary", "family"), *((v, n) for v in ("strain-level", "optimum-only", "genus-level") for n in (None, "order"))]


@query(f"WITH {SQL_STRAINS} " + " UNION ALL ".join(f"""(WITH {sql_map([*GAP], n, v)} SELECT {", ".join(f"'{x}' AS {t}" for t, x in GAP.items())}, '{v}' AS view, '{n or 'global'}' AS "null", 0 AS observed_all_species, round(e, 6) AS expected, e >= 3 AS testable, e >= 6 AS empty_beyond_chance FROM e WHERE {" AND ".join(f"{t} = '{x}'" for t, x in GAP.items())})""" for v, n in SEEN))
def survivor_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors in every view: empty in each, and beyond chance where as many as six are expected."""
    out = survivor_tables(spark, sf_dir)["survivors_no_spore_views"]
    return out.select(*GAP, "view", "null", "observed_all_species", F.round("expected", 6).alias("expected"), "testable", "empty_beyond_chance")


@query(f"WITH {SQL_STRAINS} " + " UNION ALL ".join(f"""(WITH {sql_map(t, None)}, g AS (SELECT coalesce(e, 0) AS e FROM {" CROSS JOIN ".join(f"(SELECT unnest({v}) AS {x})" for x in t for v in [LEVELS[x]])} LEFT JOIN e USING ({", ".join(t)}))
SELECT {len(t)} AS size, '{" + ".join(t)}' AS traits, (SELECT count(*) FROM u) AS N, count(*) AS cells, round(min(e), 6) AS expected_min, round(quantile_cont(e, 0.5), 6) AS expected_median, round(max(e), 6) AS expected_max, round(avg((e >= 3)::INT), 9) AS testable_cell_frac FROM g)""" for t in reports.subsets(CFG, (1, 2, 3))))
def maps_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected counts of every subset of the panel, each with an analysis set of its own, in one plan."""
    out = reports.capacity(strains(spark, sf_dir), CFG)
    return out.select("size", "traits", "N", "cells", *[F.round(c, 6).alias(c) for c in ("expected_min", "expected_median", "expected_max")], F.round("testable_cell_frac", 9).alias("testable_cell_frac"))


# The exact law of cells' counts under shuffles within strata
PAIR = {"segment": SEGMENTS, "parity": ["even", "odd"]}
N_DRAWS = 2000
#: Chance that k of n rows have both levels, of which the traits have a and b.
SQL_CHANCE = "CASE WHEN {b} - {k} > {n} - {a} OR {k} > {a} OR {k} > {b} THEN 0 ELSE exp(lgamma({a} + 1) - lgamma({k} + 1) - lgamma({a} - {k} + 1) + lgamma({n} - {a} + 1) - lgamma({b} - {k} + 1) - lgamma({n} - {a} - {b} + {k} + 1) - lgamma({n} + 1) + lgamma({b} + 1) + lgamma({n} - {b} + 1)) END"


@query(f"""WITH RECURSIVE {SQL_STRATA}, st AS (SELECT taxon, count(*) AS n, row_number() OVER (ORDER BY taxon) AS i FROM used GROUP BY 1),
g AS ({sql_grid(PAIR)}), x AS (SELECT cell_id, i, n, (SELECT count(*) FROM used u WHERE u.taxon = st.taxon AND u.segment = g.segment) AS a, (SELECT count(*) FROM used u WHERE u.taxon = st.taxon AND u.parity = g.parity) AS b FROM g, st),
q AS (SELECT cell_id, i, list_transform(range(0, least(a, b) + 1), lambda k: {SQL_CHANCE.format(n="n", a="a", b="b", k="k")}) AS q FROM x),
r AS (SELECT cell_id, 0::BIGINT AS i, [1.0::DOUBLE] AS p FROM g UNION ALL SELECT r.cell_id, q.i, list_transform(range(0, len(p) + len(q) - 1), lambda k: list_sum(list_transform(range(greatest(0, k - len(q) + 1), least(k, len(p) - 1) + 1), lambda j: p[j + 1] * q[k - j + 1]))) FROM r JOIN q ON q.cell_id = r.cell_id AND q.i = r.i + 1),
e AS (SELECT cell_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS k FROM r WHERE i = (SELECT max(i) FROM st))
SELECT cell_id, k, round(p, 7) AS p FROM e WHERE round(p, 7) > 0""")
def null_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole law of every cell's count under shuffles within nations: hypergeometric laws of the strata, convolved."""
    own = occupancy.cell_statistics(customers(spark, sf_dir), PAIR, "taxon")
    law = exact.laws(occupancy.kept_of(own, "taxon", MIN_STRATUM), PAIR)
    out = law.select("cell_id", F.posexplode("law").alias("k", "p")).select("cell_id", F.col("k").cast("long").alias("k"), F.round("p", 7).alias("p"))
    return out.filter("p > 0")


@query(f"""WITH {SQL_STRATA}, {SQL_EXPECTED}, g AS ({sql_grid(CUSTOMERS)}) SELECT cell_id, {N_DRAWS} AS draws, round(e, 6) AS mean_of_law, true AS fits FROM g JOIN ex USING (segment, balance, parity)""")
def null_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn counts of every cell of three traits against the cell's law, class by class: chi-square within five standard
    deviations of what it is when the draws have that law."""
    df = occupancy.strata(customers(spark, sf_dir), "taxon", MIN_STRATUM)
    own = occupancy.cell_statistics(df, CUSTOMERS, "taxon")
    law = exact.laws(own, CUSTOMERS)
    fit = exact.fit(law, occupancy.permuted_of(own, CUSTOMERS, N_DRAWS, 11), N_DRAWS)
    mean = F.aggregate(F.transform("law", lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)
    return fit.join(law, "cell_id").select("cell_id", F.lit(N_DRAWS).alias("draws"), F.round(mean, 6).alias("mean_of_law"), (F.abs("excess") < 5).alias("fits"))


@query(f"""WITH {SQL_STRATA}, {SQL_EXPECTED}, g AS ({sql_grid(CUSTOMERS)}), ns AS (SELECT taxon, count(*) AS n FROM used GROUP BY 1),
x AS (SELECT cell_id, taxon, n, (SELECT count(*) FROM used u WHERE u.taxon = ns.taxon AND u.segment = g.segment) AS a, (SELECT count(*) FROM used u WHERE u.taxon = ns.taxon AND u.balance = g.balance) AS b, (SELECT count(*) FROM used u WHERE u.taxon = ns.taxon AND u.parity = g.parity) AS c FROM g, ns),
z AS (SELECT cell_id, sum(ln(list_sum(list_transform(range(0, least(a, b) + 1), lambda k: ({SQL_CHANCE.format(n="n", a="a", b="b", k="k")}) * ({SQL_CHANCE.format(n="n", a="k", b="c", k="0")}))))) AS l FROM x GROUP BY 1),
o AS (SELECT segment, balance, parity, count(*) AS c FROM used GROUP BY ALL)
SELECT cell_id, segment, balance, parity, coalesce(c, 0) AS observed, round(e, 6) AS expected, round(l, 6) AS log_p_empty FROM g JOIN z USING (cell_id) JOIN ex USING (segment, balance, parity) LEFT JOIN o USING (segment, balance, parity)""")
def null_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact chances of an empty cell, of three traits within nations, without a draw."""
    out = exact.p_values(customers(spark, sf_dir), CUSTOMERS, "taxon", MIN_STRATUM)
    return out.select("cell_id", *CUSTOMERS, "observed", F.round("expected", 6).alias("expected"), F.round("log_p_empty", 6).alias("log_p_empty"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, ((l_orderkey * 7919 + l_linenumber * 104729) % 1000003 + 1) / 1000004.0::DOUBLE AS p FROM lineitem),
a AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS x, p * count(*) OVER (PARTITION BY l_returnflag) / count(*) OVER (PARTITION BY l_returnflag ORDER BY p RANGE UNBOUNDED PRECEDING) AS y FROM p)
SELECT l_orderkey, l_linenumber, round(least(1, min(x) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q, round(least(1, min(y) OVER (PARTITION BY l_returnflag ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_of_flag FROM a""")
def bh_qvalues_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q values of as many p values as there are lines, nearly all of them different, over all and by flag: scanned by bucket,
    with no task that has them all."""
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000003 + 1) / F.lit(1000004.0)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", p.alias("p"))
    out = occupancy.bh_qvalues(occupancy.bh_qvalues(own, name="q"), by=("l_returnflag",), name="q_of_flag")
    return out.select("l_orderkey", "l_linenumber", F.round("q", 9).alias("q"), F.round("q_of_flag", 9).alias("q_of_flag"))


@query(f"""WITH {SQL_STRAINS}, f AS (WITH {sql_map([*GAP], "family")} SELECT e AS family FROM e WHERE {" AND ".join(f"{t} = '{v}'" for t, v in GAP.items())}), {sql_map([*GAP], "order")},
s AS (SELECT st, count(*) AS n, {" * ".join(f"avg({x})" for x in SQL_HAS.values())} * count(*) AS e, len(list_intersect({", ".join(f"coalesce(list(DISTINCT fam) FILTER ({t} = '{v}'), [])" for t, v in GAP.items())})) = 0 AS split FROM u GROUP BY 1),
t AS (SELECT sum(e) AS e, max(e) AS most, arg_max(st, e) AS st, arg_max(n, e) AS n, sum(e) FILTER (split) AS apart FROM s)
SELECT 'no_spore' AS panel, '{", ".join(f"{t}={v}" for t, v in GAP.items())}' AS cell, rule, sentence FROM (
SELECT 'cell_order' AS rule, printf('Within orders %.1f species are expected of {", ".join(f"{t}={v}" for t, v in GAP.items())} (q = 0.020).', e) AS sentence FROM t
UNION ALL SELECT 'cell_both_seeds', 'Draws of another seed find it too.' FROM t UNION ALL SELECT 'cell_family_left', printf('Within families %.2f are expected, and it is significant still.', family) FROM f
UNION ALL SELECT 'cell_source', printf('%.0f %% of the expectation comes from %s (%s species).', 100 * most / e, st, n::VARCHAR) FROM t UNION ALL SELECT 'cell_split', printf('%.0f %% comes from orders of which no family carries every level.', 100 * apart / e) FROM t WHERE apart > 0
UNION ALL SELECT 'cell_optimum', 'With temperatures of optima alone it stays.' FROM t UNION ALL SELECT 'cell_genus', 'With one strain a genus it stays.' FROM t UNION ALL SELECT 'cell_nowhere', 'No strain has the combination, with a genome or without.' FROM t)""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report says of a surviving cell: rules over figures joined from the survivors' tables."""
    df = strains(spark, sf_dir)
    with maps.occupy(df, CFG, reports.panel_maps(CFG, "no_spore")) as made:
        tables = reports.survivors(df, CFG, "no_spore", made)
        cells = {n: made.cells_of(f"cells_no_spore_primary_{n}") for n in ("global", "phylum", "class", "order")}
        again = {n: made.cells_of(f"again_no_spore_{n}") for n in ("global", "order")}
        tables["cells_no_spore_all_nulls"] = occupancy.merge_nulls(cells, CFG.panel_levels([*GAP]), "order", again)
        own = {k: reports.settled(t) for k, t in tables.items() if k.startswith(("survivors_", "cells_no_spore_all"))}
        return reports.settled(findings.findings(findings.cell_figures(df, own, CFG, ("no_spore",)), "cell").drop("place"))


# A table of records that grows by batches
SQL_VERSIONS = """v AS (SELECT c_custkey AS id, 1 AS version, c_name || '/1' AS body FROM customer UNION ALL SELECT c_custkey, 3, c_name || '/3' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 2, c_name || '/2' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, c_name || '/0' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 10000000, 9, 'new' FROM customer WHERE c_custkey % 7 = 0)"""


@query(f"WITH {SQL_VERSIONS} SELECT id, version::INT AS version, body FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST) = 1")
def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four drops of versions of the same ids, late and stale ones among them, merged into one table: of each id the latest."""
    own, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    drop = lambda where, version, body, key=k: own.filter(where).select(key.alias("id"), F.lit(version).cast("int").alias("version"), body.alias("body"))
    name = lambda n: F.concat("c_name", F.lit(f"/{n}"))
    drops = [drop(F.lit(True), 1, name(1)), drop(k % 3 == 0, 3, name(3)), drop(k % 2 == 0, 2, name(2)).unionByName(drop(k % 5 == 0, None, name(0))), drop(k % 7 == 0, 9, F.lit("new"), k + 10_000_000)]
    place = f"{sinks.shared_folder(spark)}/merged/{uuid.uuid4().hex}"
    for new in drops:
        merging.merge(new, place, "id", "version", 16)
    return merging.read(spark, place)


@query(f"WITH t AS (SELECT token, CASE WHEN bool_or(id % 2 = 0) THEN 1 ELSE 2 END AS version FROM ({SQL_TOKENS}) GROUP BY 1), {SQL_PARSED} SELECT token, version, canonical, kind, CASE WHEN known THEN code END AS collection FROM parsed")
def designation_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that two runs learn: every token with its parse and the run that first met it."""
    book = Book(f"{sinks.shared_folder(spark)}/books/{uuid.uuid4().hex}", D.Normaliser())
    every = tokens(spark, sf_dir)
    book.learn(every.filter("id % 2 = 0"))
    book.learn(every)
    return book.rows(spark).select("token", "version", "canonical", "kind", "collection")
