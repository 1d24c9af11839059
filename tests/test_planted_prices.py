"""Small planted tables held against the queries' own SQL: prices at a gate, amounts at a whole unit, markets quoted on one side."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickline.functions import odds as O
from tickline.operators import tickets
from tickline.plans import catalog, catalog2, catalog3, catalog4, catalog5  # noqa: F401


class Planted:
    """Lines are (market, side, book, odds, day, stake in minor units, rounding); each is a quote, and the one leg of an order of its own by customer 1."""

    def __init__(self, spark, path, lines):
        self.spark, self.path, key, rows, orders = spark, str(path), 0, [], []
        for market, side, book, odds, day, stake, rounding in lines:
            key = next(k for k in range(key + 1, key + 400) if (k * 7 + (100 + book) * 3) % 60 == round(odds * 100) - 170 and (rounding is None or k % 3 == rounding))
            rows.append((key, market, 100 + book, 2 - side, 1.0, 1.0, pd.Timestamp("1996-01-01") + pd.Timedelta(days=day)))
            orders.append((key, 1, stake / 100, pd.Timestamp("1995-12-01")))
        frames = {
            "lineitem": pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]),
            "part": pd.DataFrame([(m, "red thing", "Brand#1", "T", 3, 1.0) for m in sorted({x[0] for x in lines})], columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
            "orders": pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]),
        }
        self.duck = duckdb.connect()
        for name, frame in frames.items():
            self.duck.register("frame", frame)
            types = ", ".join(f"{c}::{'TIMESTAMP' if 'date' in c else 'INTEGER' if c in ('l_linenumber', 'p_size') else 'BIGINT' if c.endswith('key') else 'DOUBLE' if frame[c].dtype == float else 'VARCHAR'} AS {c}" for c in frame)
            self.duck.execute(f"COPY (SELECT {types} FROM frame) TO '{self.path}/{name}.parquet' (FORMAT PARQUET)")
            self.duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{self.path}/{name}.parquet'")

    def both(self, name):
        """Our rows of a query and those of its SQL."""
        df = catalog.QUERIES[name](self.spark, self.path)
        got = self.duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str), sorted(got.fetchall(), key=str)


def test_sums_of_one_but_for_last_digits_are_left_alone(spark):
    raw = [(1 / d) / (1 / 2.04 + 1 / 2.02) for d in (2.04, 2.02)]
    p = F.array(F.lit(1 / 2.04), F.lit(1 / 2.02))
    one = F.array(F.lit(1.0))
    row = spark.range(1).select(O.finish(O.devig_multiplicative(p)).alias("q"), O.finish(one).alias("one")).first()
    assert sum(raw) != 1 and row.q == raw and row.one is None


@pytest.fixture(scope="module")
def gate(spark, tmp_path_factory):
    # of 60^3 prices (reference's two, challenger's one) only this and one more lie a last digit below the gate of one per cent
    lines = [(3, 0, 0, 2.04, 1, 1000, None), (3, 1, 0, 2.02, 2, 1000, None), (3, 0, 2, 2.03, 3, 1000, None), (3, 1, 2, 1.80, 4, 1000, None)]
    return Planted(spark, tmp_path_factory.mktemp("gate"), lines)


@pytest.mark.parametrize("name", ["a12_reason_counters_all", "m11_ev_signals_all", "m11_ev_signals_gated"])
def test_a_price_at_the_gate(gate, name):
    ours, theirs = gate.both(name)
    assert ours == theirs


def test_a_cash_out_at_a_whole_unit(spark, tmp_path):
    # pays 3026; a fair chance of 0.5132... makes it 1552.9999999999998, which truncates to 1552
    ours, theirs = Planted(spark, tmp_path, [(3, 0, 0, 1.70, 1, 1000, None), (3, 1, 0, 1.78, 2, 1000, None), (3, 0, 2, 1.78, 3, 1700, 2)]).both("k13_cash_out_value_all")
    assert ours == theirs and any(r[2:4] == (3026, 1552) for r in map(tuple, theirs))


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    # market 11 is quoted on one side only, its neighbour of the same finished event on both
    lines = [(11, 0, 0, 1.70 + day / 100, day, 1000 + day, None) for day in range(1, 6)]
    lines += [(12, side, 0, 1.80 + day / 100, day, 2000 + day, None) for day in range(10, 16) for side in (0, 1)]
    return Planted(spark, tmp_path_factory.mktemp("sides"), lines)


ONE_SIDED = ["a5_user_clv_aggregate", "a6_user_clv_by_league", "a7_clv_aggregate_compensated", "c3_clv_complete_coherent", "c4_clv_devig_both", "c5_clv_measure", "c5_clv_measure_all", "c6_clv_reasons", "c6_clv_reasons_all", "c7_clv_pass", "j14_leaderboard_join"]


@pytest.mark.parametrize("name", ONE_SIDED)
def test_a_market_of_one_side_has_no_closing_line_value(sides, name):
    ours, theirs = sides.both(name)
    assert ours == theirs and theirs


def test_removed_legs_divide_out_at_once(spark):
    """100 at 1.77, 2.01 and 2.25 without the last two pays 177, in whatever order prices are multiplied; one division after the other gave 176."""
    own = spark.createDataFrame([(1, 1, 100, "toward_zero", "1996-01-01")], "wager_id long, user_id long, stake_minor long, rounding string, placed_at string")
    legs = [(1, 1, 1.77, "won"), (1, 2, 2.01, "push"), (1, 3, 2.25, "push")]
    graded = spark.createDataFrame(legs, "wager_id long, selection_id long, odds double, result string")
    row = tickets.decide(own, graded, spark.createDataFrame([(1, 3)], "wager_id long, n_legs long")).first()
    assert (row.status, row.returned_minor) == ("won", 177)


@pytest.mark.parametrize("name", ["c5_clv_measure", "c5_clv_measure_all", "c6_clv_reasons_all"])
def test_quotes_and_legs_are_dealt_three_times(spark, sides, name):
    """Lines are dealt by market as quotes, by ticket as legs, and by market as legs; small tables besides (30 exchanges before)."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, sides.path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 9
