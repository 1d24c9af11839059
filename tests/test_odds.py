"""Odds arithmetic against worked numbers and properties on seeded random markets."""

import random

from pyspark.sql import functions as F

from tickline.functions import odds as O
from tickline.operators import clv, pricing, steam, tickets


def test_conversions(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (3.5,), (1.909090909090909,)], "d double")
    rows = df.select(O.decimal_to_american(F.col("d")).alias("a"), O.render_american(F.col("d")).alias("s"), O.fraction(F.col("d")).alias("f")).collect()
    assert [r.a for r in rows] == [-200, 100, 250, -110]
    assert [r.s for r in rows] == ["-200", "+100", "+250", "-110"]
    assert [(r.f.num, r.f.den) for r in rows] == [(1, 2), (1, 1), (5, 2), (10, 11)]


def test_devig_sums_to_one_and_keeps_fair_markets(spark):
    rng = random.Random(5)
    rows = [([rng.uniform(0.2, 0.9) for _ in range(rng.choice([2, 3]))],) for _ in range(60)]
    rows = [([x / sum(p) * rng.uniform(1.0, 1.12) for x in p],) for (p,) in rows] + [([0.25, 0.75],)]
    rows = [(p,) for (p,) in rows if max(p) < 0.99]
    df = spark.createDataFrame(rows, "p array<double>")
    for method in ("multiplicative", "power", "shin"):
        for r in df.select("p", O.finish(O.METHODS[method](F.col("p"))).alias("q")).collect():
            assert r.q is not None and abs(sum(r.q) - 1) < 1e-9, (method, r)
            if r.p == [0.25, 0.75]:
                assert max(abs(a - b) for a, b in zip(r.p, r.q, strict=True)) < 1e-12


def test_kelly_is_zero_at_break_even_and_nan_is_no_fair_book(spark):
    r = spark.sql("SELECT 0.5D AS q, 2.0D AS d").select(O.kelly(F.col("q"), F.col("d")).alias("k"), O.ev(F.col("q"), F.col("d")).alias("e")).first()
    assert r.k == 0 and r.e == 0


def test_money_rounding(spark):
    df = spark.createDataFrame([(2.5, "half_even"), (2.5, "half_away"), (-2.5, "half_away"), (2.9, "toward_zero"), (-2.9, "toward_zero")], "x double, m string")
    assert [r.v for r in df.select(O.rounded_money(F.col("x"), F.col("m")).alias("v")).collect()] == [2, 3, -3, 2, -2]


def test_months_back_run_over(spark):
    df = spark.sql("SELECT timestamp'1996-03-31' AS t UNION ALL SELECT timestamp'1997-03-31' UNION ALL SELECT timestamp'1996-05-15'")
    assert [str(r.m) for r in df.select(tickets.go_months_back(F.col("t")).alias("m")).collect()] == ["1996-03-02", "1997-03-03", "1996-04-15"]


def test_cooldown_depends_on_the_last_emitted(spark):
    rows = [(s, "up", f"2024-01-01 00:{m:02d}:00") for s in ("a",) for m in (1, 4, 6, 9, 11)]
    df = spark.createDataFrame(rows, "selection_id string, direction string, t string").select("selection_id", "direction", F.col("t").cast("timestamp").alias("window_end"))
    kept = sorted(r.window_end.minute for r in steam.with_cooldown(df, 300.0).collect())
    assert kept == [1, 6, 11]


def test_findings_do_not_depend_on_partitions(spark):
    from tickline.plans.model import Views

    v = Views(spark, "/root/testdata/sf0.001")
    a = {tuple(r) for r in pricing.arbitrages(v.latest, 1e12, 1e12).select("market_id", "fingerprint").collect()}
    b = {tuple(r) for r in pricing.arbitrages(v.latest.repartition(7, "odds"), 1e12, 1e12).select("market_id", "fingerprint").collect()}
    assert a == b and a


def test_no_history_user_has_null_means(spark):
    empty = spark.createDataFrame([], "user_id long, voided boolean, line_moved boolean, beat_close boolean, probability_clv double, percent_clv double")
    users = spark.createDataFrame([(1,)], "user_id long")
    r = users.join(clv.aggregates(empty, "user_id"), "user_id", "left").first()
    assert r.samples is None and r.mean_percent_clv is None
