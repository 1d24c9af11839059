"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from tickline.operators import tickets
from tickline.plans import catalog, catalog2, catalog3, catalog4, catalog5  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else 0.0 if x == 0 and isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(str([cell(r[c]) for c in cols]) for r in df.collect())
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(str([cell(r[names.index(c)]) for c in cols]) for r in got.fetchall())
    assert ours == theirs


def test_fair_values_cover_every_market_with_a_reference(spark):
    rows = catalog.QUERIES["m9_fair_value_all"](spark, SF).collect()
    refs = {r.market_id for r in catalog.QUERIES["m2_resolve_reference"](spark, SF).collect() if r.reference_book_id is not None}
    assert len(rows) == 2 * len(refs) and {r.fallback for r in rows} == {True, False} and all(r.fallback == (r.overround < -1e-9) for r in rows)


def test_audit_covers_open_tickets(spark):
    own = spark.createDataFrame([(1, 100), (2, 100)], "wager_id long, stake_minor long")
    decided = spark.createDataFrame([(1, "lost", 5, 100)], "wager_id long, status string, returned_minor long, stake_minor long")
    legs = spark.createDataFrame([(1, 2), (2, 26)], "wager_id long, n_legs long")
    found = {r.rule: r.violations for r in tickets.ticket_audit(decided, own, legs).collect()}
    assert found == {"lost_returns_nothing": 1, "push_returns_stake": 0, "won_at_least_stake": 0, "legs_within_25": 1}
