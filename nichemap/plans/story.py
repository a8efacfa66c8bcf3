"""The report's page: what the tables say, in sentences that depend on them, and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import sinks
from ..config import Config

#: Rows of a table that the page shows; of longer ones it names the file.
SHOWN = 60


def shown(name: str, table: DataFrame) -> str:
    rows = table.limit(SHOWN + 1).collect()
    text = sinks.markdown(rows[:SHOWN], table.columns)
    if len(rows) > SHOWN:
        text += f"\n\nThe first {SHOWN} of {sinks.fmt(table.count())} rows; all are in `tables/{name}.tsv`."
    return text


def _funnel(made: dict[str, DataFrame], cfg: Config, held: dict) -> list[str]:
    c = held["counts"]
    lines = [f"Of {sinks.fmt(c['strains'])} strains {sinks.fmt(c['matched'])} ({sinks.pct(c['matched'], c['strains'])}) have a genome in the catalogue" + (f", release {held['catalogue']['release']}." if held["catalogue"].get("release") else ".")]
    if not held["records"].get("complete", True):
        lines.append(f"The sweep is not complete: {sinks.fmt(held['records']['missing'])} batches are missing, and all figures below are of what is there.")
    if held["records"].get("near_the_end"):
        lines.append("Records come close to the end of the range of ids; raise `max_id` and fetch again.")
    dates = held["records"]["doi_dates"]
    if len(dates) > 1:
        lines.append(f"The records carry {len(dates)} release dates; most have {held['records']['release']}.")
    return lines


def _panel(made: dict[str, DataFrame], cfg: Config, key: str) -> list[str]:
    maps = {r["null"]: r for r in made[f"occupied_vs_expected_{key}"].collect()}  # a row a null
    whole, finest = maps["global"], maps["order"]
    lines = [f"The panel {' x '.join(cfg.panel(key))} has {sinks.fmt(whole['cells'])} cells; {sinks.fmt(whole['occupied'])} are occupied by {sinks.fmt(whole['N'])} species, where independence over all species would fill {sinks.fmt(float(whole['null_occupied_mean']), 1)} and shuffles within orders {sinks.fmt(float(finest['null_occupied_mean']), 1)}."]
    fired, left = whole["empty_beyond_chance_cells"], finest["empty_beyond_chance_cells"]
    if left:
        lines.append(f"{sinks.fmt(left)} of the {sinks.fmt(fired)} cells that are emptier than chance under the global shuffle stay so within orders; their orders and families are in the survivors' tables.")
    elif fired:
        lines.append(f"{sinks.fmt(fired)} cells are emptier than chance under the global shuffle, and none within orders: what looks like a gap is where lineages are.")
    else:
        lines.append("No cell is emptier than chance under any shuffle.")
    for name in (n for n in made if n.startswith(f"positive_control_{key}")):
        r = made[name].first()
        lines.append(f"Control {r['control']}: " + ("it fires globally and not within orders, as it should." if r["passes"] else "IT FAILS. A known gap is not found globally, or is found within orders; the figures of this panel can't be trusted."))
    found = sorted((r for r in made["findings"].collect() if r["panel"] == key), key=lambda r: (r["cell"] or "", r["place"]))  # rules times subjects
    lines += [r["sentence"] for r in found if r["cell"] is None and not r["rule"].startswith("control")]
    for cell in dict.fromkeys(r["cell"] for r in found if r["cell"] is not None):
        lines += [f"### Cell {cell}", " ".join(r["sentence"] for r in found if r["cell"] == cell)]
    return lines


def told(made: dict[str, DataFrame], cfg: Config, held: dict) -> str:
    """The page as Markdown."""
    text = ["# Occupancy of trait space", f"Settings {cfg.sha256[:12]}, made {held['made_at']}" + (f", commit {held['commit']}." if held["commit"] else "."), "## Data", *_funnel(made, cfg, held)]
    for key in ("core", "no_spore"):
        text += [f"## Panel {key}", *_panel(made, cfg, key)]
    text.append("## Tables")
    for name, table in made.items():
        if not name.startswith(("cells_", "power_", "genome_availability")):
            text += [f"### {name.replace('_', ' ')}", shown(name, table)]
    return "\n\n".join(text) + "\n"
