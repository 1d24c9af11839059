"""The registered queries: each applies an operator to the given tables, beside the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickline.functions import odds as O
from tickline.operators import clv, pricing, steam, tickets
from tickline.plans.model import BASE_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The given tables' quotes lie days apart, so the queries pass wide bounds; the operators' defaults stay.
WIDE = 400 * 86400.0
CLV_BACK = 900 * 86400.0


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the model's views; ``sql`` continues the model's common table expressions."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            head = sql.lstrip()
            ORACLE_SQL[name] = BASE_SQL.rstrip() + (", " + head[1:] if head.startswith(",") else "\n" + sql)
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def us(c: Column | str) -> Column:
    return F.unix_micros(c)


# ---- projections over all quotes ----------------------------------------------------------------------------------

_Q = ["selection_id", "book_id", "observed_us"]


def _project(name: str, cols: Callable[..., dict[str, Column]], sql: str) -> None:
    """``cols`` gets the odds, a probability and the odds' profit in hundredths; nothing is built before a session exists."""

    def f(v: Views) -> DataFrame:
        d = F.col("odds")
        return v.quotes.withColumn("observed_us", us("observed_at")).select(*_Q, *[c.alias(k) for k, c in cols(d, F.lit(0.52), F.round((d - 1) * 100).cast("long")).items()])

    query(name, f"SELECT selection_id, book_id, epoch_us(observed_at) AS observed_us, {sql} FROM quotes")(f)


am = "CASE WHEN odds >= 2 THEN round((odds - 1) * 100) ELSE round(-100 / (odds - 1)) END"
_project("p1_american_to_decimal", lambda d, q0, _c: {"odds_back": r(O.american_to_decimal(O.decimal_to_american(d)))}, f"round(CASE WHEN {am} = -100 THEN 2.0 WHEN {am} > 0 THEN 1 + {am} / 100 ELSE 1 - 100.0 / {am} END, 6) AS odds_back")
_project("p2_decimal_to_american", lambda d, q0, _c: {"american": O.decimal_to_american(d)}, f"CAST(CASE WHEN {am} = -100 THEN 100 ELSE {am} END AS BIGINT) AS american")
_project("p3_probabilities", lambda d, q0, _c: {"prob": r(O.decimal_to_prob(d), 9), "odds_back": r(O.prob_to_decimal(O.decimal_to_prob(d)), 9)}, "round(1 / odds, 9) AS prob, round(1 / (1 / odds), 9) AS odds_back")
_cents = "CAST(round((odds - 1) * 100) AS BIGINT)"
_project("p4_fraction", lambda d, q0, _c: {"num": O.fraction(d)["num"], "den": O.fraction(d)["den"]}, f"{_cents} // gcd({_cents}, 100) AS num, 100 // gcd({_cents}, 100) AS den")
_project("p5_reduce_fraction", lambda d, q0, _c: {"num": (_c / O.gcd(_c, F.lit(100))).cast("long"), "odds_back": r(1 + _c / F.lit(100.0))}, f"{_cents} // gcd({_cents}, 100) AS num, round(1 + {_cents} / 100.0, 6) AS odds_back")
_project(
    "p6_render_odds", lambda d, q0, _c: {"american": O.render_american(d), "percent": F.concat(F.format_string("%.1f", F.round(100 / d, 1)), F.lit("%"))},
    f"CASE WHEN {am} = -100 THEN '+100' WHEN {am} > 0 THEN '+' || CAST({am} AS BIGINT)::VARCHAR ELSE CAST({am} AS BIGINT)::VARCHAR END AS american, printf('%.1f', round(100 / odds, 1)) || '%' AS percent",
)
_project("p7_ev", lambda d, q0, _c: {"ev_percent": r(O.ev(q0, d) * 100)}, "round((0.52::DOUBLE * odds - 1) * 100, 6) AS ev_percent")
_project("p8_edge", lambda d, q0, _c: {"edge_percent": r(O.edge(q0, d) * 100)}, "round((0.52::DOUBLE / (1 / odds) - 1) * 100, 6) AS edge_percent")
_project("p9_breakeven", lambda d, q0, _c: {"breakeven": r(1 / d), "min_decimal": r(F.lit(1.02) / (1 / d) * 1.0)}, "round(1 / odds, 6) AS breakeven, round(1.02::DOUBLE / (1 / odds), 6) AS min_decimal")
_k = "CASE WHEN 0.52::DOUBLE * odds <= 1 THEN 0.0 ELSE least((0.52::DOUBLE * odds - 1) / (odds - 1), 1.0) END"
_project("p10_kelly", lambda d, q0, _c: {"kelly": r(O.kelly(q0, d)), "fractional": r(O.kelly(q0, d) * 0.25)}, f"round({_k}, 6) AS kelly, round({_k} * 0.25, 6) AS fractional")
_project("p11_growth_rate", lambda d, q0, _c: {"growth": r(O.growth_rate(q0, d, F.lit(0.02)), 9)}, "round(0.52::DOUBLE * ln(1 + 0.02::DOUBLE * (odds - 1)) + 0.48::DOUBLE * ln(1 - 0.02::DOUBLE), 9) AS growth")
_h = "CASE WHEN role = 'away' AND market_type = 'spread' THEN CASE WHEN line = 0 THEN 0.0 ELSE -line END ELSE line END"
_project("p12_home_frame_line", lambda d, q0, _c: {"home_line": O.home_frame(F.col("role"), F.col("market_type"), F.col("line"))}, f"{_h} AS home_line")
_project("p13_teased_line", lambda d, q0, _c: {"teased": O.teased(F.col("role"), F.col("line"), F.lit(6.0))}, "CASE WHEN role = 'over' THEN line - 6 ELSE line + 6 END AS teased")


@query("p14_payout", """SELECT wager_id, CAST(CASE rounding WHEN 'half_even' THEN round_even(stake_minor * 1.875::DOUBLE, 0) WHEN 'half_away' THEN round(stake_minor * 1.875::DOUBLE) ELSE trunc(stake_minor * 1.875::DOUBLE) END AS BIGINT) AS payout_minor,
    CAST(CASE rounding WHEN 'half_even' THEN round_even(stake_minor * 1.875::DOUBLE, 0) WHEN 'half_away' THEN round(stake_minor * 1.875::DOUBLE) ELSE trunc(stake_minor * 1.875::DOUBLE) END AS BIGINT) - stake_minor AS profit_minor FROM tickets""")  # fmt: skip
def p14(v: Views) -> DataFrame:
    pay = O.rounded_money(F.col("stake_minor") * F.lit(1.875), F.col("rounding"))
    return v.tickets.select("wager_id", pay.alias("payout_minor"), (pay - F.col("stake_minor")).alias("profit_minor"))


@query("p15_price_age", """, anchors AS (SELECT market_id, max(observed_at) AS anchor FROM quotes GROUP BY market_id)
SELECT q.selection_id, q.book_id, epoch_us(q.observed_at) AS observed_us, (epoch_us(anchor) - epoch_us(q.observed_at)) / 1000000.0::DOUBLE AS age, (epoch_us(anchor) - epoch_us(q.observed_at)) / 1000000.0::DOUBLE > 600 AS stale FROM quotes q JOIN anchors USING (market_id)""")  # fmt: skip
def p15(v: Views) -> DataFrame:
    q = v.quotes
    anchor = q.groupBy("market_id").agg(F.max("observed_at").alias("anchor"))
    age = O.age_seconds(F.col("anchor"), F.col("observed_at"))
    return q.join(anchor, "market_id").select("selection_id", "book_id", us("observed_at").alias("observed_us"), age.alias("age"), (age > pricing.MAX_QUOTE_AGE).alias("stale"))


NOW = "TIMESTAMP '1996-08-01 00:00:00'"


def _now() -> Column:
    return F.lit("1996-08-01 00:00:00").cast("timestamp")


@query("p16_time_to_start_tier", f""", t AS (SELECT league_id, (epoch_us(scheduled_start) - epoch_us({NOW})) / 1000000.0 AS s FROM games),
k AS (SELECT league_id, CASE WHEN s <= 0 THEN 1 WHEN s <= 1800 THEN 2 WHEN s <= 43200 THEN 3 WHEN s <= 604800 THEN 4 ELSE 5 END AS rank FROM t)
SELECT league_id, min(rank) AS rank, count(*) AS events FROM k GROUP BY league_id""")  # fmt: skip
def p16(v: Views) -> DataFrame:
    s = O.age_seconds(F.col("scheduled_start"), _now())
    return v.games.select("league_id", O.tier_rank(O.tier(s)).cast("int").alias("rank")).groupBy("league_id").agg(F.min("rank").alias("rank"), F.count("*").alias("events"))


# ---- filters and quality ------------------------------------------------------------------------------------------


@query("f1_board_events", f"SELECT event_id, league_id, status, epoch_us(scheduled_start) AS start_us FROM games WHERE status IN ('scheduled', 'live') AND scheduled_start < {NOW}")
def f1(v: Views) -> DataFrame:
    return v.games.filter(F.col("status").isin("scheduled", "live") & (F.col("scheduled_start") < _now())).select("event_id", "league_id", "status", us("scheduled_start").alias("start_us"))


@query("f2_search_competitor_prefix", "SELECT event_id, home, away FROM games WHERE starts_with(lower(home), lower('red')) OR starts_with(lower(away), lower('red'))")
def f2(v: Views) -> DataFrame:
    p = F.lower(F.lit("red"))
    return v.games.filter(F.startswith(F.lower("home"), p) | F.startswith(F.lower("away"), p)).select("event_id", "home", "away")


def in_set(df: DataFrame, column: str, values: list) -> DataFrame:
    """An empty list means no filter."""
    return df.filter(F.col(column).isin(values)) if values else df


@query("f3_optional_set_filter", "SELECT market_type, count(*) AS n FROM latest WHERE market_type IN ('spread', 'total') GROUP BY market_type UNION ALL SELECT 'any', count(*) FROM latest")
def f3(v: Views) -> DataFrame:
    some = in_set(v.latest, "market_type", ["spread", "total"]).groupBy("market_type").agg(F.count("*").alias("n"))
    return some.unionByName(in_set(v.latest, "market_type", []).agg(F.count("*").alias("n")).select(F.lit("any").alias("market_type"), "n"))


@query("f4_required_time_bound", "SELECT selection_id, book_id, epoch_us(observed_at) AS observed_us, odds FROM quotes WHERE observed_at >= TIMESTAMP '1997-01-01' AND observed_at < TIMESTAMP '1997-03-01'")
def f4(v: Views) -> DataFrame:
    return price_series(v.quotes, "1997-01-01", "1997-03-01").select("selection_id", "book_id", us("observed_at").alias("observed_us"), "odds")


def price_series(quotes: DataFrame, since: str, until: str) -> DataFrame:
    """Series reads must name a lower bound; the upper one is exclusive."""
    return quotes.filter((F.col("observed_at") >= F.lit(since).cast("timestamp")) & (F.col("observed_at") < F.lit(until).cast("timestamp")))


@query("f5_data_quality_rejects", """, x AS (SELECT CASE WHEN odds < 1.75 THEN 'odds_out_of_range' WHEN market_type = 'moneyline' AND line IS NOT NULL THEN 'line_forbidden' WHEN market_type <> 'moneyline' AND line IS NULL THEN 'line_required' WHEN book_id = 3 THEN 'unknown_book' ELSE 'accepted' END AS reason, market_type AS scope FROM quotes)
SELECT scope, reason, count(*) AS n FROM x GROUP BY scope, reason""")  # fmt: skip
def f5(v: Views) -> DataFrame:
    reason = (
        F.when(F.isnan("odds") | (F.col("odds") < 1.75), "odds_out_of_range").when((F.col("market_type") == "moneyline") & F.col("line").isNotNull(), "line_forbidden")
        .when((F.col("market_type") != "moneyline") & F.col("line").isNull(), "line_required").when(F.col("book_id") == 3, "unknown_book").otherwise("accepted")
    )
    return v.quotes.select(F.col("market_type").alias("scope"), reason.alias("reason")).groupBy("scope", "reason").agg(F.count("*").alias("n"))


@query("f6_schema_checks", """SELECT count(*) AS rows_seen, count(*) FILTER (WHERE odds <= 1 OR odds > 100000) AS bad_odds, count(*) FILTER (WHERE (market_type = 'moneyline') <> (line IS NULL)) AS bad_line,
    count(*) FILTER (WHERE CASE WHEN market_type = 'total' THEN role NOT IN ('over', 'under') ELSE role NOT IN ('home', 'away') END) AS bad_role, count(*) FILTER (WHERE NOT regexp_full_match(selection_id::VARCHAR, '[A-Za-z0-9._-]{1,128}')) AS bad_id FROM quotes""")  # fmt: skip
def f6(v: Views) -> DataFrame:
    total = F.col("market_type") == "total"
    return v.quotes.agg(
        F.count("*").alias("rows_seen"), F.count_if(F.isnan("odds") | (F.col("odds") <= 1) | (F.col("odds") > 100_000)).alias("bad_odds"),
        F.count_if((F.col("market_type") == "moneyline") != F.col("line").isNull()).alias("bad_line"),
        F.count_if(F.when(total, ~F.col("role").isin("over", "under")).otherwise(~F.col("role").isin("home", "away"))).alias("bad_role"),
        F.count_if(~F.col("selection_id").cast("string").rlike("^[A-Za-z0-9._-]{1,128}$")).alias("bad_id"),
    )


# ---- pricing ------------------------------------------------------------------------------------------------------

SNAP_SQL = """, anchors AS (SELECT market_id, max(observed_at) AS anchor, count(DISTINCT selection_id) AS n_selections FROM latest GROUP BY market_id HAVING count(DISTINCT selection_id) >= 2),
books AS (SELECT market_id, any_value(market_type) AS market_type, book_id, count(*) AS n_quoted, count(*) = any_value(n_selections) AS complete, min(observed_at) AS oldest, max(observed_at) AS newest, any_value(anchor) AS anchor, sum(1 / odds) AS implied
    FROM latest JOIN anchors USING (market_id) GROUP BY market_id, book_id)"""
AGE = "(epoch_us(anchor) - epoch_us({})) / 1000000.0::DOUBLE"
REF_SQL = SNAP_SQL + f""",
refs AS (SELECT market_id, CASE WHEN bool_or(book_id = 0 AND complete AND {AGE.format('oldest')} <= {WIDE}) THEN 0 WHEN bool_or(book_id = 1 AND complete AND {AGE.format('oldest')} <= {WIDE}) THEN 1 END AS reference_book_id FROM books GROUP BY market_id),
fair AS (SELECT l.market_id, l.selection_id, l.book_id AS reference_book_id, l.line AS ref_line, 1 / l.odds AS p, b.implied AS s, 1 / l.odds - (b.implied - 1) / 2 AS fair_prob
    FROM latest l JOIN refs ON l.market_id = refs.market_id AND l.book_id = refs.reference_book_id JOIN books b ON b.market_id = l.market_id AND b.book_id = l.book_id WHERE b.implied >= 1 - 1e-9)"""
#: Fair values of every market with a reference: multiplicative, and flagged, where Shin refuses a sum below one.
FAIR_SQL = REF_SQL[REF_SQL.index("fair AS") :]
FAIR_ALL_SQL = """fair AS (SELECT l.market_id, l.selection_id, l.book_id AS reference_book_id, l.line AS ref_line, 1 / l.odds AS p, b.implied AS s,
    CASE WHEN b.implied >= 1 - 1e-9 THEN 1 / l.odds - (b.implied - 1) / 2 ELSE 1 / l.odds / b.implied END AS fair_prob, b.implied < 1 - 1e-9 AS fallback
    FROM latest l JOIN refs ON l.market_id = refs.market_id AND l.book_id = refs.reference_book_id JOIN books b ON b.market_id = l.market_id AND b.book_id = l.book_id)"""
REF_ALL_SQL = REF_SQL.replace(FAIR_SQL, FAIR_ALL_SQL)


@query("m1_market_snapshot", SNAP_SQL + " SELECT market_id, book_id, n_quoted, complete, epoch_us(oldest) AS oldest_us, epoch_us(newest) AS newest_us FROM books")
def m1(v: Views) -> DataFrame:
    return pricing.book_snapshots(v.latest).select("market_id", "book_id", "n_quoted", "complete", us("oldest").alias("oldest_us"), us("newest").alias("newest_us"))


def _reference(v: Views) -> tuple[DataFrame, DataFrame]:
    books = pricing.book_snapshots(v.latest)
    return books, pricing.resolve_reference(books, (0,), (1,), WIDE)


@query("m2_resolve_reference", REF_SQL + f""", c AS (SELECT market_id, arg_min(CASE WHEN NOT complete THEN 'incomplete' WHEN {AGE.format('oldest')} > {WIDE} THEN 'stale' END, book_id) AS reason FROM (SELECT *, CASE WHEN NOT complete THEN 'incomplete' WHEN {AGE.format('oldest')} > {WIDE} THEN 'stale' END AS why FROM books) WHERE book_id < 2 GROUP BY market_id)
SELECT refs.market_id, reference_book_id, CASE WHEN reference_book_id IS NULL THEN coalesce(c.reason, 'absent') END AS reason FROM refs LEFT JOIN c USING (market_id)""")  # fmt: skip
def m2(v: Views) -> DataFrame:
    return _reference(v)[1].select("market_id", "reference_book_id", "reason")


def _fair(v: Views, every: bool = False) -> DataFrame:
    """Fair values: where Shin's method holds, or of every market with a reference."""
    fair = pricing.fair_of(pricing.reference_books(pricing.book_snapshots(v.latest), (0,), (1,), WIDE))
    return fair if every else fair.filter("NOT fallback")


def _every_market(name: str, f: Callable[[Views, bool], DataFrame]) -> None:
    """Register ``name``_all: the same query over the fair values of every market with a reference."""
    QUERIES[f"{name}_all"] = lambda spark, sf_dir: f(Views(spark, sf_dir), True)
    ORACLE_SQL[f"{name}_all"] = ORACLE_SQL[name].replace(FAIR_SQL, FAIR_ALL_SQL)


def _complete(v: Views) -> DataFrame:
    return pricing.book_snapshots(v.latest).filter("complete").withColumn("p", F.transform("quotes", lambda x: 1 / x["odds"]))


def _devig(name: str, method: str, prob: str, where: str = "TRUE") -> None:
    def f(v: Views) -> DataFrame:
        own = _complete(v).withColumn("q", O.finish(O.METHODS[method](F.col("p")))).filter("q IS NOT NULL")
        flat = own.select("market_id", "book_id", F.explode(F.arrays_zip("quotes", "q")).alias("z"))
        return flat.select("market_id", "book_id", F.col("z.quotes.selection_id").alias("selection_id"), r(F.col("z.q"), 8).alias("fair_prob"))

    query(name, SNAP_SQL + f" SELECT l.market_id, l.book_id, l.selection_id, round({prob}, 8) AS fair_prob FROM latest l JOIN books b USING (market_id, book_id) WHERE complete AND ({where})")(f)


_devig("m3_devig_multiplicative", "multiplicative", "1 / odds / implied")
_devig("m4_devig_additive", "additive", "1 / odds - (implied - 1) / 2", "1 / odds - (implied - 1) / 2 > 0 AND 1 - (1 / odds - (implied - 1) / 2) > 0")
# for two outcomes Shin's probabilities are the additive ones
_devig("m6_devig_shin", "shin", "CASE WHEN abs(implied - 1) <= 1e-9 THEN 1 / odds / implied ELSE 1 / odds - (implied - 1) / 2 END", "implied >= 1 - 1e-9")


@query("m5_devig_power", SNAP_SQL + """, pw AS (SELECT market_id, book_id, min(1 / odds) AS a, max(1 / odds) AS b, sum(1 / odds) AS s FROM latest JOIN books USING (market_id, book_id) WHERE complete GROUP BY market_id, book_id),
bis AS (SELECT market_id, book_id, a, b, s, CASE WHEN s > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, CASE WHEN s > 1 THEN 2 * ln(2) / -ln(b) + 2 ELSE 1.0::DOUBLE END AS hi, 0 AS n FROM pw
    UNION ALL SELECT market_id, book_id, a, b, s, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM bis WHERE n < 60)
SELECT market_id, book_id, round(CASE WHEN abs(s - 1) <= 1e-9 THEN 1 ELSE (lo + hi) / 2 END, 8) AS exponent, round(pow(b, CASE WHEN abs(s - 1) <= 1e-9 THEN 1 ELSE (lo + hi) / 2 END), 8) AS favourite FROM bis WHERE n = 60""")  # fmt: skip
def m5(v: Views) -> DataFrame:
    own = _complete(v).select("market_id", "book_id", "p", O.power_exponent(F.col("p")).alias("k"))
    return own.select("market_id", "book_id", r("k", 8).alias("exponent"), r(F.pow(F.array_max("p"), F.col("k")), 8).alias("favourite"))


@query("m7_devig_finish", SNAP_SQL + " SELECT market_id, book_id, count(*) AS n, round(1.0::DOUBLE, 9) AS total FROM latest JOIN books USING (market_id, book_id) WHERE complete GROUP BY market_id, book_id")
def m7(v: Views) -> DataFrame:
    own = _complete(v).withColumn("q", O.finish(O.devig_multiplicative(F.col("p")))).filter("q IS NOT NULL")
    return own.select("market_id", "book_id", F.size("q").cast("long").alias("n"), r(O.plain_sum(F.col("q")), 9).alias("total"))


@query("m9_fair_value", REF_SQL + " SELECT selection_id, reference_book_id, round(fair_prob, 7) AS fair_prob, round(1 / fair_prob, 6) AS fair_decimal, round(s - 1, 7) AS overround FROM fair")
def m9(v: Views) -> DataFrame:
    own = _fair(v)
    return own.select("selection_id", "reference_book_id", r("fair_prob", 7).alias("fair_prob"), r("fair_decimal").alias("fair_decimal"), r("overround", 7).alias("overround"))


@query("m9_fair_value_all", REF_ALL_SQL + " SELECT selection_id, reference_book_id, round(fair_prob, 7) AS fair_prob, round(1 / fair_prob, 6) AS fair_decimal, round(s - 1, 7) AS overround, fallback FROM fair")
def m9_all(v: Views) -> DataFrame:
    return _fair(v, True).select("selection_id", "reference_book_id", r("fair_prob", 7).alias("fair_prob"), r("fair_decimal").alias("fair_decimal"), r("overround", 7).alias("overround"), "fallback")


@query("m8_devig_disagreement", REF_SQL + """, pw AS (SELECT market_id, max(p) AS b, min(p) AS a, any_value(s) AS s FROM fair GROUP BY market_id),
bis AS (SELECT market_id, a, b, s, CASE WHEN s > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, CASE WHEN s > 1 THEN 2 * ln(2) / -ln(b) + 2 ELSE 1.0::DOUBLE END AS hi, 0 AS n FROM pw
    UNION ALL SELECT market_id, a, b, s, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM bis WHERE n < 60)
SELECT market_id, round(greatest(abs(b / s - (b - (s - 1) / 2)), abs(pow(b, (lo + hi) / 2) - (b - (s - 1) / 2))), 6) AS disagreement FROM bis WHERE n = 60""")  # fmt: skip
def m8(v: Views) -> DataFrame:
    return _fair(v).groupBy("market_id").agg(r(F.max("disagreement")).alias("disagreement"))


@query("m8_devig_disagreement_all", REF_ALL_SQL + """, pw AS (SELECT market_id, max(p) AS b, min(p) AS a, any_value(s) AS s, max_by(fair_prob, p) AS f FROM fair GROUP BY market_id),
bis AS (SELECT market_id, a, b, s, f, CASE WHEN s > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, CASE WHEN s > 1 THEN 2 * ln(2) / -ln(b) + 2 ELSE 1.0::DOUBLE END AS hi, 0 AS n FROM pw
    UNION ALL SELECT market_id, a, b, s, f, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM bis WHERE n < 60)
SELECT market_id, round(greatest(abs(b / s - f), abs(b - (s - 1) / 2 - f), abs(pow(b, (lo + hi) / 2) - f)), 6) AS disagreement FROM bis WHERE n = 60""")  # fmt: skip
def m8_all(v: Views) -> DataFrame:
    return _fair(v, True).groupBy("market_id").agg(r(F.max("disagreement")).alias("disagreement"))


ASSESS_SQL = REF_SQL + f""",
assessed AS (SELECT l.market_id, l.league_id, l.selection_id, l.book_id, l.odds, l.observed_at, f.fair_prob, {AGE.format('l.observed_at')} AS age,
    CASE WHEN l.market_id NOT IN (SELECT market_id FROM fair) THEN 'no_fair_value' WHEN {AGE.format('b.oldest')} > {WIDE} THEN 'stale' WHEN f.fair_prob IS NULL THEN 'no_reference_quote' WHEN l.line IS DISTINCT FROM f.ref_line THEN 'line_mismatch' ELSE 'priced' END AS status
    FROM latest l JOIN (SELECT market_id, book_id, min(observed_at) AS oldest FROM latest GROUP BY ALL) b USING (market_id, book_id) JOIN (SELECT market_id, max(observed_at) AS anchor FROM latest GROUP BY ALL) a ON a.market_id = l.market_id LEFT JOIN fair f ON f.selection_id = l.selection_id
    WHERE f.reference_book_id IS NULL OR f.reference_book_id <> l.book_id),
gated AS (SELECT *, CASE WHEN status = 'priced' THEN fair_prob * odds - 1 END AS ev, CASE WHEN status <> 'priced' THEN status WHEN fair_prob * odds - 1 <= 0 THEN 'not_positive' WHEN (fair_prob * odds - 1) * 100 < 1 THEN 'below_threshold' WHEN age > {WIDE} THEN 'too_old' ELSE 'signal' END AS outcome FROM assessed)"""


def _assessed(v: Views, every: bool = False) -> DataFrame:
    return pricing.assess(v.latest, _fair(v, every).drop("disagreement", "overround"), WIDE)


def _gated(v: Views, every: bool = False) -> DataFrame:
    """Outcomes without the gate of the methods' disagreement, which ``m11_ev_signals_gated`` has."""
    return pricing.ev_outcomes(_assessed(v, every), max_age=WIDE, ratio=0.0)


@query("m10_assess_quotes", ASSESS_SQL + " SELECT selection_id, book_id, status, round(CASE WHEN status = 'priced' THEN fair_prob * odds - 1 END, 8) AS ev FROM assessed")
def m10(v: Views, every: bool = False) -> DataFrame:
    return _assessed(v, every).select("selection_id", "book_id", "status", r("ev", 8).alias("ev"))


@query("m11_ev_signals", ASSESS_SQL + " SELECT selection_id, book_id, round(ev * 100, 5) AS ev_percent, round(odds, 4) AS odds FROM gated WHERE outcome = 'signal'")
def m11(v: Views, every: bool = False) -> DataFrame:
    return _gated(v, every).filter("outcome = 'signal'").select("selection_id", "book_id", r(F.col("ev") * 100, 5).alias("ev_percent"), r("odds", 4).alias("odds"))


@query("a12_reason_counters", ASSESS_SQL + " SELECT outcome, count(*) AS n FROM gated GROUP BY outcome")
def a12(v: Views, every: bool = False) -> DataFrame:
    return _gated(v, every).groupBy("outcome").agg(F.count("*").alias("n"))


@query("w5_rank_ev", ASSESS_SQL + " SELECT selection_id, book_id, round(round(ev, 9) * 100, 5) AS ev_percent FROM gated WHERE outcome = 'signal' ORDER BY round(ev, 9) DESC, observed_at DESC, selection_id DESC, book_id DESC LIMIT 50")
def w5(v: Views, every: bool = False) -> DataFrame:
    found = _gated(v, every).filter("outcome = 'signal'").withColumn("ev", r("ev", 9))
    return pricing.rank_ev(found, 50).select("selection_id", "book_id", r(F.col("ev") * 100, 5).alias("ev_percent"))


@query("j13_assess_vs_reference", ASSESS_SQL + " SELECT status, count(*) AS n FROM assessed GROUP BY status")
def j13(v: Views, every: bool = False) -> DataFrame:
    return _assessed(v, every).groupBy("status").agg(F.count("*").alias("n"))


for _name, _f in (("m10_assess_quotes", m10), ("m11_ev_signals", m11), ("a12_reason_counters", a12), ("w5_rank_ev", w5), ("j13_assess_vs_reference", j13)):
    _every_market(_name, _f)


@query("a10_market_margin", SNAP_SQL + """ SELECT market_id, book_id, round(implied, 8) AS implied_sum, round(implied - 1, 8) AS overround, round((implied - 1) / implied, 8) AS vig,
    CASE WHEN implied < 1 - 1e-12 THEN 'under' WHEN implied > 1 + 1e-12 THEN 'over' ELSE 'fair' END AS side FROM books WHERE complete""")  # fmt: skip
def a10(v: Views) -> DataFrame:
    s = O.compensated(F.col("p"))
    side = F.when(s < 1 - 1e-12, "under").when(s > 1 + 1e-12, "over").otherwise("fair")
    return _complete(v).select("market_id", "book_id", r(s, 8).alias("implied_sum"), r(s - 1, 8).alias("overround"), r((s - 1) / s, 8).alias("vig"), side.alias("side"))


@query("a11_vig_contributions", SNAP_SQL + " SELECT l.selection_id, l.book_id, round(1 / odds / implied, 8) AS fair, round(1 / odds - 1 / odds / implied, 8) AS excess, round((1 / odds) / implied, 8) AS share FROM latest l JOIN books b USING (market_id, book_id)")
def a11(v: Views) -> DataFrame:
    s = F.sum(1 / F.col("odds")).over(Window.partitionBy("market_id", "book_id"))
    n = v.latest.groupBy("market_id").agg(F.countDistinct("selection_id").alias("n")).filter("n >= 2").select("market_id")
    own = v.latest.join(n, "market_id").withColumn("s", s).withColumn("p", 1 / F.col("odds"))
    return own.select("selection_id", "book_id", r(F.col("p") / F.col("s"), 8).alias("fair"), r(F.col("p") - F.col("p") / F.col("s"), 8).alias("excess"), r(F.col("p") / F.col("s"), 8).alias("share"))


ARB_SQL = """, anchors AS (SELECT market_id, max(observed_at) AS anchor, count(DISTINCT selection_id) AS n_selections FROM latest GROUP BY market_id),
best AS (SELECT l.*, """ + _h + f""" AS home_line, n_selections FROM latest l JOIN anchors USING (market_id) WHERE {AGE.format('l.observed_at')} <= {WIDE} * 10
    QUALIFY row_number() OVER (PARTITION BY market_id, home_line, selection_id ORDER BY odds DESC, observed_at DESC, book_id) = 1),
arbs AS (SELECT market_id, home_line, sum(1 / odds) AS implied_sum, count(DISTINCT book_id) AS distinct_books, (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1000000.0::DOUBLE AS spread_seconds, count(*) AS n,
    sha256(string_agg(selection_id::VARCHAR || chr(31) || book_id::VARCHAR || chr(31) || regexp_replace(odds::VARCHAR, '\\.0$', '') || chr(31) || coalesce(regexp_replace(line::VARCHAR, '\\.0$', ''), '-') || chr(31), '' ORDER BY selection_id)) AS fingerprint
    FROM best GROUP BY market_id, home_line HAVING count(*) = any_value(n_selections) AND (1 - sum(1 / odds)) / sum(1 / odds) >= 0.001)"""


def _arbs(v: Views) -> DataFrame:
    return pricing.arbitrages(v.latest, WIDE * 10, 1e12)


@query("m12_arb_detect", ARB_SQL + " SELECT market_id, home_line, round(implied_sum, 8) AS implied_sum, round((1 - implied_sum) / implied_sum, 8) AS return_fraction, distinct_books, spread_seconds FROM arbs")
def m12(v: Views) -> DataFrame:
    return _arbs(v).select("market_id", "home_line", r("implied_sum", 8).alias("implied_sum"), r("return_fraction", 8).alias("return_fraction"), F.col("distinct_books").cast("long").alias("distinct_books"), "spread_seconds")


@query("m13_arb_signals", ARB_SQL + " SELECT CASE WHEN spread_seconds > 8640000 THEN 'spread_too_wide' WHEN (1 - implied_sum) / implied_sum < 0.05 THEN 'return_too_small' ELSE 'signal' END AS reason, count(*) AS n FROM arbs GROUP BY 1")
def m13(v: Views) -> DataFrame:
    reason = F.when(F.col("spread_seconds") > 8_640_000, "spread_too_wide").when(F.col("return_fraction") < 0.05, "return_too_small").otherwise("signal")
    return _arbs(v).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("m14_arb_fingerprint", ARB_SQL + " SELECT market_id, home_line, fingerprint FROM arbs")
def m14(v: Views) -> DataFrame:
    return _arbs(v).select("market_id", "home_line", "fingerprint")


@query("m15_arb_stakes", ARB_SQL + """, st AS (SELECT a.market_id, a.home_line, any_value(a.implied_sum) AS s, count(*) AS n, sum(ceil((1 / b.odds / a.implied_sum) * 10000)) AS outlay, min(floor(ceil((1 / b.odds / a.implied_sum) * 10000) * b.odds)) AS worst FROM arbs a JOIN best b ON a.market_id = b.market_id AND a.home_line IS NOT DISTINCT FROM b.home_line GROUP BY a.market_id, a.home_line)
SELECT market_id, home_line, CAST(outlay AS BIGINT) AS outlay, CAST(worst - outlay AS BIGINT) AS worst_profit FROM st""")  # fmt: skip
def m15(v: Views) -> DataFrame:
    return pricing.arb_stakes(_arbs(v), 10_000).select("market_id", "home_line", "outlay", "worst_profit")


@query("w6_rank_arb", ARB_SQL + " SELECT market_id, home_line, round((1 - implied_sum) / implied_sum, 8) AS return_fraction FROM arbs ORDER BY round((1 - implied_sum) / implied_sum, 8) DESC, fingerprint DESC LIMIT 40")
def w6(v: Views) -> DataFrame:
    return _arbs(v).select("market_id", "home_line", r("return_fraction", 8).alias("return_fraction"), "fingerprint").orderBy(F.desc("return_fraction"), F.desc("fingerprint")).limit(40).drop("fingerprint")


MID_SQL = """, x AS (SELECT market_id, role, book_id, odds, observed_at, CASE WHEN role = 'home' THEN -line ELSE line END + CASE WHEN book_id IN (1, 2) AND role IN ('away', 'under') THEN 2 ELSE 0 END AS threshold FROM latest WHERE market_type IN ('spread', 'total')),
pairs AS (SELECT a.market_id, a.threshold AS low, b.threshold AS high, a.book_id AS book_a, b.book_id AS book_b, a.odds AS odds_a, b.odds AS odds_b, 1 / a.odds + 1 / b.odds AS s
    FROM x a JOIN x b ON a.market_id = b.market_id AND a.role IN ('home', 'over') AND b.role IN ('away', 'under') AND b.threshold > a.threshold
    WHERE b.threshold - a.threshold >= 0.5 AND ceil(a.threshold + 1e-9) <= floor(b.threshold - 1e-9) AND a.book_id <> b.book_id
    QUALIFY row_number() OVER (PARTITION BY a.market_id, a.threshold, b.threshold ORDER BY 1 / a.odds + 1 / b.odds, a.book_id, a.observed_at, a.odds, b.book_id, b.observed_at) = 1)"""


def _middles(v: Views) -> DataFrame:
    # the given lines leave no window, so two books' away and under lines are moved by two points
    moved = F.when(F.col("book_id").isin(1, 2) & F.col("role").isin("away", "under"), F.col("line") + 2).otherwise(F.col("line"))
    return pricing.middles(v.latest.withColumn("line", moved), 1e12, 1e12)


@query("m16_middle_detect", MID_SQL + " SELECT market_id, low, high, book_a, book_b, round(s, 8) AS implied_sum FROM pairs")
def m16(v: Views) -> DataFrame:
    return _middles(v).select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), F.col("book_id").alias("book_a"), F.col("book_id_b").alias("book_b"), r("implied_sum", 8).alias("implied_sum"))


@query("j12_middle_pairs", """, x AS (SELECT market_id, role, book_id, CASE WHEN role = 'home' THEN -line ELSE line END + CASE WHEN book_id IN (1, 2) AND role IN ('away', 'under') THEN 2 ELSE 0 END AS threshold FROM latest WHERE market_type IN ('spread', 'total'))
SELECT a.market_id, count(*) AS pairs FROM x a JOIN x b ON a.market_id = b.market_id AND a.role IN ('home', 'over') AND b.role IN ('away', 'under') AND b.threshold > a.threshold GROUP BY a.market_id""")  # fmt: skip
def j12(v: Views) -> DataFrame:
    moved = F.when(F.col("book_id").isin(1, 2) & F.col("role").isin("away", "under"), F.col("line") + 2).otherwise(F.col("line"))
    own = v.latest.filter("market_type <> 'moneyline'").withColumn("line", moved).select("market_id", "role", F.when(F.col("role") == "home", -F.col("line")).otherwise(F.col("line")).alias("threshold"))
    a, b = own.filter("role IN ('home', 'over')").alias("a"), own.filter("role IN ('away', 'under')").alias("b")
    return a.join(b, (F.col("a.market_id") == F.col("b.market_id")) & (F.col("b.threshold") > F.col("a.threshold"))).groupBy(F.col("a.market_id").alias("market_id")).agg(F.count("*").alias("pairs"))


STK = "CAST(round(10000::DOUBLE / odds_a / s) AS BIGINT)"


@query("m17_middle_stakes", MID_SQL + f" SELECT market_id, low, high, {STK} AS stake_a, CAST(floor({STK} * odds_a) AS BIGINT) - 10000 AS profit_above, CAST(floor((10000 - {STK}) * odds_b) AS BIGINT) - 10000 AS profit_below FROM pairs")
def m17(v: Views) -> DataFrame:
    return pricing.middle_returns(_middles(v), 10_000).select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), "stake_a", "profit_above", "profit_below")


@query("m19_middle_outcomes", MID_SQL + ", o AS (SELECT market_id, low, high, unnest(range(CAST(ceil(low) AS BIGINT), CAST(floor(high) AS BIGINT) + 1)) AS result FROM pairs) SELECT market_id, low, high, CAST(result AS INTEGER) AS result, CASE WHEN result > low AND result < high THEN 'both_win' ELSE 'win_push' END AS kind FROM o")
def m19(v: Views) -> DataFrame:
    return pricing.middle_outcomes(_middles(v)).select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), "result", "kind")


@query("m18_middle_expectation", MID_SQL + """, hist AS (SELECT CASE WHEN market_type = 'total' THEN home_score + away_score ELSE home_score - away_score END AS result, market_type, count(*) AS n FROM games JOIN markets USING (event_id) WHERE market_type <> 'moneyline' AND status = 'final' GROUP BY 1, 2),
tot AS (SELECT market_type, sum(n) AS t FROM hist GROUP BY market_type)
SELECT p.market_id, low, high, round(coalesce(sum(h.n) FILTER (WHERE h.result > low AND h.result < high), 0) / any_value(t)::DOUBLE, 8) AS hit_rate FROM pairs p JOIN markets m ON m.market_id = p.market_id JOIN tot USING (market_type) JOIN hist h ON h.market_type = m.market_type GROUP BY p.market_id, low, high""")  # fmt: skip
def m18(v: Views) -> DataFrame:
    total = F.when(F.col("market_type") == "total", F.col("home_score") + F.col("away_score")).otherwise(F.col("home_score") - F.col("away_score"))
    hist = v.games.filter("status = 'final'").join(v.markets.filter("market_type <> 'moneyline'").select("event_id", "market_type"), "event_id").groupBy("market_type", total.alias("result")).agg(F.count("*").alias("n"))
    dist = hist.groupBy("market_type").agg(F.collect_list(F.struct("result", "n")).alias("h"), F.sum("n").alias("t"))  # results are few: scores, not rows
    own = _middles(v).join(dist, "market_type")
    hit = F.aggregate(F.filter("h", lambda x: (x["result"] > F.col("threshold")) & (x["result"] < F.col("threshold_b"))), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return own.select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), r(hit / F.col("t"), 8).alias("hit_rate"))
