"""Rules of the report's findings: each speaks where its condition holds and is silent elsewhere."""

import pytest

from nichemap.plans import findings

PANEL = "panel string, alpha double, cells long, N long, p_order double, survivors long, testable_cells long, deficits string, nonincreasing boolean, strict boolean, minimum_detectable double, cells_above long, share_above double, small_cells long, small_flagged long, small_least_q double, survivor_least_q double, groups long, top_share double, top_cells_share double, group_name string, group_deficit double, family_survivors long, least_q_subsets double, control string, control_passes boolean"
PANELS = [
    ("a", 0.05, 40, 900, 0.2, 0, 12, "9 > 5 > 1", True, True, 6.1, 7, 0.5, 0, 0, None, None, 9, 0.8, 0.9, "P1", 3.5, 0, 0.01, "gap", True),
    ("b", 0.05, 40, 900, 0.01, 1, 0, "9 > 5 > 5", True, False, None, None, None, 2, 0, 0.07, 0.01, 2, 0.8, 0.9, "P1", -1.0, 0, 0.6, "gap", False),
    ("c", 0.05, 40, 900, 0.05, 3, 12, "9 > 5 > 6", False, False, 6.1, 7, 0.5, 1, 1, 0.001, 0.01, 9, 0.8, 0.9, "P1", 0.0, 2, None, None, None),
    ("d", 0.05, 40, 900, None, 0, 12, "", None, None, 6.1, 7, 0.5, 2, 0, None, None, 9, 0.8, 0.9, None, None, 0, None, None, None),
]
CELL = "panel string, cell string, expected double, q_low double, again boolean, family_expected double, family_testable boolean, family_empty boolean, optimum_state string, genus_state string, top_stratum string, top_stratum_share double, top_stratum_n long, split_share double, carriers long, carrier_names string"
CELLS = [
    ("a", "x", 4.2, 0.01, True, 0.5, False, False, "stays", None, "O1", 0.4, 30, 0.2, 0, ""),
    ("a", "y", 4.2, 0.01, False, 5.5, True, False, None, "can't be tested", None, None, None, 0.0, 2, "1, 2"),
    ("b", "z", 4.2, 0.01, None, 5.5, True, True, None, None, "O1", 0.4, 30, None, 7, "1, 2, 3, 4, 5"),
]
FIRES = {
    "deficit_strict": "a", "deficit_nonincreasing": "b", "deficit_uneven": "c", "order_deficit": "b", "order_no_deficit": "ac", "no_survivor": "ad", "survivors_absorbed": "b", "survivors_left": "c", "subsets_deficit": "a", "subsets_none": "b", "largest_groups": "acd", "largest_deficit": "a", "power": "acd", "no_power": "b", "small_flagged": "c", "small_close": "b", "small_harmless": "d", "small_stronger": "c", "control_passes": "a", "control_fails": "b",
    "cell_order": "xyz", "cell_both_seeds": "x", "cell_one_seed": "y", "cell_family_untestable": "x", "cell_family_gone": "y", "cell_family_left": "z", "cell_source": "xz", "cell_split": "x", "cell_optimum": "x", "cell_genus": "y", "cell_nowhere": "x", "cell_somewhere": "yz",
}


@pytest.fixture(scope="module")
def found(spark):
    out = findings.findings(spark.createDataFrame(PANELS, PANEL), "panel").unionByName(findings.findings(spark.createDataFrame(CELLS, CELL), "cell"))
    return out.collect()


@pytest.mark.parametrize("rule", [r.name for r in findings.RULES])
def test_rule_speaks_where_it_should(found, rule):
    assert "".join(sorted(r["cell"] or r["panel"] for r in found if r["rule"] == rule)) == FIRES[rule]


def test_sentences(found):
    said = {(r["cell"] or r["panel"], r["rule"]): r["sentence"] for r in found}
    assert said["b", "survivors_absorbed"].startswith("1 cell stay") and said["c", "survivors_left"].startswith("3 cells stay") and ", and 2 within families too" in said["c", "survivors_left"]
    assert said["a", "power"].endswith("at least 6.1 species are expected within orders: 7 of 40 cells, with 50 % of the expected species.")
    assert said["z", "cell_somewhere"] == "Of all strains 7 have the combination, with a genome or without: 1, 2, 3, 4, 5 and others."
    assert said["y", "cell_genus"] == "With one strain a genus it can't be tested." and said["x", "cell_source"] == "40 % of the expectation comes from O1 (30 species)."
    assert len({r["rule"] for r in found}) == len(findings.RULES) and all(r["sentence"] for r in found)
