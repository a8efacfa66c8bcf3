"""Every query against its SQL in DuckDB, on the small tables."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from nichemap import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() and abs(v) < 1e15 else float(f"{v:.9g}")
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    cur = duck.execute(queries.SQL[name])
    wanted = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == wanted[0]
    extra, lacking = got[1] - wanted[1], wanted[1] - got[1]
    assert not extra and not lacking, (list(extra)[:3], list(lacking)[:3], sum(extra.values()), sum(lacking.values()))
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_categories_draw_again(spark, sf, monkeypatch):
    """A survivor of the first seed alone is borderline: the second run has draws of its own."""
    from pyspark.sql import functions as F

    real, seen = queries.null_cells, []

    def cells(spark, sf_dir, taxon="taxon", **seed):
        table, null = real(spark, sf_dir, taxon, **seed)
        if taxon:
            seen.append({r["cell_id"]: r["null_mean"] for r in table.collect()})
        return table.withColumn("empty_beyond_chance", F.lit(taxon is not None and not seed)), null

    monkeypatch.setattr(queries, "null_cells", cells)
    assert {r["category"] for r in queries.null_categories(spark, sf).collect()} == {"SURVIVES nation-level shuffle (seed 1 only: borderline)"}
    assert len(seen) == 2 and seen[0] != seen[1]


def test_full_nulls_tell_gaps_from_noise(spark, sf, monkeypatch):
    """A cell emptied by hand is found at alpha 0.05, and cells left alone are not; 20 permutations find nothing there."""
    from pyspark.sql import functions as F

    from nichemap.operators import occupancy as O

    real = queries.customers
    monkeypatch.setattr(queries, "customers", lambda spark, d: real(spark, d).filter("not (segment = 'BUILDING' and balance = 'b1' and parity = 'even')"))
    few = O.occupancy(queries.customers(spark, sf), queries.CUSTOMERS, "c_custkey", queries.N_PERM, "taxon", queries.MIN_STRATUM)[0]
    assert few.filter("emptier_than_chance").count() == 0
    cells = queries.QUERIES["permutation_null_full"](spark, sf)
    assert [tuple(r) for r in cells.filter("empty_beyond_chance").select("segment", "balance", "parity").collect()] == [("BUILDING", "b1", "even")]
    assert cells.agg(F.min("p_low")).first()[0] == pytest.approx(1 / 10_001)
    s = queries.QUERIES["null_interval_full"](spark, sf).first()
    assert s["n_perm"] == 10_000 and s["empty_beyond_chance_cells"] == 1
    got = {r["category"] for r in queries.QUERIES["null_categories_full"](spark, sf).collect()}
    assert "SURVIVES nation-level shuffle (both seeds)" in got
