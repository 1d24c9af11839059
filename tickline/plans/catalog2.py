"""Registered queries, second part: sources, reads, joins, tickets, ledger, CLV and steam."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickline.functions import odds as O
from tickline.operators import clv, pricing, reads, steam, tickets
from tickline.plans.catalog import REF_ALL_SQL, REF_SQL, _fair, _reference, query, r, us
from tickline.plans.model import Views
from tickline.sources import raw

HALF = "TIMESTAMP '1996-01-01'"


def _half() -> Column:
    return F.lit("1996-01-01").cast("timestamp")


# ---- sources and table upkeep -------------------------------------------------------------------------------------


def _payloads(v: Views) -> DataFrame:
    """Provider payloads of the newest quotes, one JSON text a market."""
    q = v.latest
    name = F.when(F.col("role") == "home", "Home").when(F.col("role") == "away", "Away").otherwise(F.initcap("role"))
    key = F.when(F.col("market_type") == "moneyline", "h2h").when(F.col("market_type") == "spread", "spreads").otherwise("totals")
    out = q.groupBy("market_id", "book_id").agg(F.first(key).alias("key"), F.max("observed_at").alias("at"), F.array_sort(F.collect_list(F.struct(name.alias("name"), F.col("odds").alias("price"), F.col("line").alias("point")))).alias("outcomes"))
    book = F.struct(F.col("book_id").cast("string").alias("key"), F.col("at").alias("last_update"), F.array(F.struct("key", F.col("at").alias("last_update"), "outcomes")).alias("markets"))
    own = out.groupBy("market_id").agg(F.array_sort(F.collect_list(book)).alias("bookmakers"))
    body = F.struct(F.col("market_id").cast("string").alias("id"), F.lit("x").alias("sport_key"), F.lit("l").alias("league"), F.lit("home").alias("home_team"), F.lit("AWAY ").alias("away_team"), "bookmakers")
    return own.select(F.when(F.col("market_id") % 50 == 7, F.lit("{broken")).otherwise(F.to_json(body)).alias("payload"))


@query("s1_read_raw_odds", "SELECT CASE WHEN market_id % 50 = 7 THEN 'malformed' END AS reason, count(*) AS n FROM (SELECT DISTINCT market_id FROM latest) GROUP BY 1")
def s1(v: Views) -> DataFrame:
    return raw.read_payloads(_payloads(v)).groupBy("reason").agg(F.count("*").alias("n"))


@query("s2_normalize_quotes", "SELECT market_id::VARCHAR AS id, book_id::VARCHAR AS book, market_type, role, odds, line FROM latest WHERE market_id % 50 <> 7")
def s2(v: Views) -> DataFrame:
    return raw.normalize(raw.read_payloads(_payloads(v))).filter("reason IS NULL").select("id", "book", "market_type", "role", "odds", "line")


@query("s3_derive_ids", """SELECT DISTINCT selection_id, 'tx.l.' || trim(regexp_replace(lower(league_id), '[^a-z0-9]+', '-', 'g'), '-') AS league_key, 'tx.e.' || event_id::VARCHAR || '.' || market_type || '.' || role AS selection_key FROM latest""")
def s3(v: Views) -> DataFrame:
    own = v.latest.select("selection_id", "league_id", "event_id", "market_type", "role").distinct()
    return raw.derive_ids(own, "tx").select("selection_id", "league_key", "selection_key")


@query("s4_market_line_consensus", """, h AS (SELECT market_id, CASE WHEN role = 'away' AND market_type = 'spread' THEN CASE WHEN line = 0 THEN 0.0 ELSE -line END ELSE line END AS line FROM quotes WHERE line IS NOT NULL), c AS (SELECT market_id, line, count(*) AS votes FROM h GROUP BY ALL)
SELECT market_id, line, votes FROM c QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY votes DESC, line) = 1""")  # fmt: skip
def s4(v: Views) -> DataFrame:
    return reads.consensus_line(v.quotes.withColumn("home_line", O.home_frame(F.col("role"), F.col("market_type"), F.col("line"))))


@query("s6_append_prices", f"SELECT count(*) AS appended, count(DISTINCT selection_id) AS selections FROM quotes WHERE observed_at >= {HALF}")
def s6(v: Views) -> DataFrame:
    q = v.quotes
    batch = q.filter(F.col("observed_at") >= F.lit("1995-06-01").cast("timestamp"))
    new = reads.append_new(q.filter(F.col("observed_at") < _half()), batch.unionByName(batch), ["selection_id", "book_id", "observed_at"])
    return new.agg(F.count("*").alias("appended"), F.countDistinct("selection_id").alias("selections"))


@query("s7_upsert_catalogue", "SELECT selection_id, book_id, odds, epoch_us(observed_at) AS observed_us FROM latest")
def s7(v: Views) -> DataFrame:
    q = v.quotes.select("selection_id", "book_id", "odds", "observed_at")
    return reads.upsert_newest(q.filter(F.col("observed_at") < _half()), q.filter(F.col("observed_at") >= _half()), ["selection_id", "book_id"], "observed_at").select("selection_id", "book_id", "odds", us("observed_at").alias("observed_us"))


@query("s8_apply_results", "SELECT event_id, CASE WHEN status = 'live' THEN 'final' ELSE status END AS status, CASE WHEN status = 'live' THEN home_score + 1 ELSE home_score END AS home_score FROM games")
def s8(v: Views) -> DataFrame:
    got = v.games.filter("status IN ('live', 'final')").select("event_id", F.lit("final").alias("status"), (F.col("home_score") + 1).alias("home_score"), "away_score")
    return reads.apply_results(v.games, got).select("event_id", "status", "home_score")


@query("s9_results_worklist", "SELECT event_id, epoch_us(scheduled_start) AS start_us FROM games WHERE status IN ('scheduled', 'live') AND scheduled_start < TIMESTAMP '1996-12-01' - INTERVAL 2 HOUR ORDER BY scheduled_start, event_id LIMIT 200")
def s9(v: Views) -> DataFrame:
    due = F.lit("1996-11-30 22:00:00").cast("timestamp")
    return v.games.filter(F.col("status").isin("scheduled", "live") & (F.col("scheduled_start") < due)).orderBy("scheduled_start", "event_id").limit(200).select("event_id", us("scheduled_start").alias("start_us"))


@query("s15_supersede_limit", "SELECT wager_id, user_id, epoch_us(lead(placed_at) OVER (PARTITION BY user_id ORDER BY placed_at, wager_id)) AS superseded_us FROM tickets")
def s15(v: Views) -> DataFrame:
    nxt = F.lead("placed_at").over(Window.partitionBy("user_id").orderBy("placed_at", "wager_id"))
    return v.tickets.select("wager_id", "user_id", us(nxt).alias("superseded_us"))


# ---- joins and reads ----------------------------------------------------------------------------------------------


@query("j1_event_breadcrumb", "SELECT g.event_id, g.league_id, min(m.sport_id) AS sport_id FROM games g JOIN markets m ON m.league_id = g.league_id GROUP BY g.event_id, g.league_id")
def j1(v: Views) -> DataFrame:
    league = v.markets.groupBy("league_id").agg(F.min("sport_id").alias("sport_id"))
    return v.games.select("event_id", "league_id").join(league, "league_id").select("event_id", "league_id", "sport_id")


@query("j2_market_with_event", "SELECT market_id, market_type, g.event_id, g.home, g.away, g.status FROM markets JOIN games g USING (event_id)")
def j2(v: Views) -> DataFrame:
    return v.markets.select("market_id", "market_type", "event_id").join(v.games.select("event_id", "home", "away", "status"), "event_id").select("market_id", "market_type", "event_id", "home", "away", "status")


@query("j3_market_closing_instant", "SELECT market_id, epoch_us(CASE WHEN status NOT IN ('scheduled', 'postponed') THEN scheduled_start END) AS close_us FROM markets JOIN games USING (event_id)")
def j3(v: Views) -> DataFrame:
    close = F.when(~F.col("status").isin("scheduled", "postponed"), F.col("scheduled_start"))
    return v.markets.select("market_id", "event_id").join(v.games, "event_id").select("market_id", us(close).alias("close_us"))


BACK = 900 * 86400.0
SNAP = f""", asks AS (SELECT leg_id, side, market_id, book_id, CASE side WHEN 'taken' THEN taken_at ELSE close_at END AS as_of FROM (SELECT l.*, CASE WHEN status NOT IN ('scheduled', 'postponed') THEN scheduled_start END AS close_at FROM legs l JOIN games USING (event_id)), (VALUES ('taken'), ('closing')) s(side)),
snaps AS (SELECT leg_id, side, a.market_id, q.selection_id, q.odds, q.line, q.role, q.market_type, q.observed_at FROM asks a JOIN quotes q ON a.market_id = q.market_id AND a.book_id = q.book_id
    WHERE q.observed_at <= as_of AND epoch_us(as_of) - epoch_us(q.observed_at) < {BACK:.0f}::BIGINT * 1000000 AND NOT EXISTS (SELECT 1 FROM suspensions s WHERE s.market_id = a.market_id AND q.observed_at >= suspended_at AND q.observed_at < lifted_at)
    QUALIFY row_number() OVER (PARTITION BY leg_id, side, q.selection_id ORDER BY q.observed_at DESC) = 1)"""


def _legs(v: Views) -> DataFrame:
    return clv.closable(v.legs, v.markets.select("market_id", "event_id").join(v.games, "event_id"))


@query("j4_snapshot_as_of", SNAP + " SELECT leg_id, side, selection_id, odds, epoch_us(observed_at) AS observed_us FROM snaps")
def j4(v: Views) -> DataFrame:
    own = _legs(v)
    side = F.explode(F.array(F.struct(F.lit("taken").alias("side"), F.col("taken_at").alias("as_of")), F.struct(F.lit("closing").alias("side"), F.col("close_at").alias("as_of"))))
    asks = own.select("leg_id", "market_id", "book_id", side.alias("s")).select("leg_id", "market_id", "book_id", "s.*").filter("as_of IS NOT NULL")
    return clv.snapshot_as_of(asks, v.quotes, v.suspensions, BACK).select("leg_id", "side", "selection_id", "odds", us("observed_at").alias("observed_us"))


CLV_SQL = SNAP + """, ns AS (SELECT market_id, count(DISTINCT selection_id) AS n FROM quotes GROUP BY market_id),
sides AS (SELECT leg_id, side, count(*) AS n, sum(1 / odds) AS s, count(DISTINCT coalesce((CASE WHEN role = 'away' AND market_type = 'spread' THEN CASE WHEN line = 0 THEN 0.0 ELSE -line END ELSE line END)::VARCHAR, '-')) AS lines FROM snaps GROUP BY leg_id, side),
m AS (SELECT l.leg_id, l.user_id, l.league_id, CASE WHEN status IN ('scheduled', 'postponed') THEN 'no_close' WHEN coalesce(t.n, 0) < ns.n THEN 'taken_incomplete' WHEN coalesce(c.n, 0) < ns.n THEN 'closing_incomplete' WHEN t.lines > 1 OR c.lines > 1 THEN 'incoherent_lines'
    WHEN ts.observed_at <> l.taken_at OR ts.odds <> l.odds THEN 'taken_quote_mismatch' WHEN ns.n <> 2 THEN 'not_priceable' END AS reason,
    CASE WHEN t.s >= 1 - 1e-9 AND c.s >= 1 - 1e-9 THEN 1 / ts.odds - (t.s - 1) / 2 ELSE 1 / ts.odds / t.s END AS qt, CASE WHEN t.s >= 1 - 1e-9 AND c.s >= 1 - 1e-9 THEN 1 / cs.odds - (c.s - 1) / 2 ELSE 1 / cs.odds / c.s END AS qc, ts.line IS DISTINCT FROM cs.line AS line_moved
    FROM (SELECT legs.*, user_id FROM legs JOIN tickets USING (wager_id)) l JOIN games USING (event_id) JOIN ns ON ns.market_id = l.market_id LEFT JOIN sides t ON t.leg_id = l.leg_id AND t.side = 'taken' LEFT JOIN sides c ON c.leg_id = l.leg_id AND c.side = 'closing'
    LEFT JOIN snaps ts ON ts.leg_id = l.leg_id AND ts.side = 'taken' AND ts.selection_id = l.selection_id LEFT JOIN snaps cs ON cs.leg_id = l.leg_id AND cs.side = 'closing' AND cs.selection_id = l.selection_id)"""


def _measured(v: Views, *more: str) -> DataFrame:
    return clv.measure(_legs(v), v.quotes, v.suspensions, None, BACK, more=more)


@query("c5_clv_measure", CLV_SQL + " SELECT leg_id, round(qt, 7) AS taken_fair, round(qc, 7) AS closing_fair, round(qc - qt, 7) AS probability_clv, line_moved FROM m WHERE reason IS NULL")
def c5(v: Views) -> DataFrame:
    return _measured(v).filter("reason IS NULL").select("leg_id", r("taken_fair", 7).alias("taken_fair"), r("closing_fair", 7).alias("closing_fair"), r("probability_clv", 7).alias("probability_clv"), "line_moved")


@query("c6_clv_reasons", CLV_SQL + " SELECT coalesce(reason, 'measured') AS reason, count(*) AS n FROM m GROUP BY 1")
def c6(v: Views) -> DataFrame:
    return _measured(v).groupBy(F.coalesce("reason", F.lit("measured")).alias("reason")).agg(F.count("*").alias("n"))


@query("c1_clv_closable", "SELECT leg_id, epoch_us(CASE WHEN status NOT IN ('scheduled', 'postponed') THEN scheduled_start END) AS close_us FROM legs JOIN games USING (event_id)")
def c1(v: Views) -> DataFrame:
    return _legs(v).select("leg_id", us("close_at").alias("close_us"))


def _samples(v: Views) -> DataFrame:
    own = _measured(v, "wager_id", "league_id").filter("reason IS NULL").join(v.tickets.select("wager_id", "user_id"), "wager_id")
    return own.withColumn("voided", F.lit(False))


@query("a6_user_clv_by_league", CLV_SQL + " SELECT league_id, count(*) FILTER (WHERE NOT line_moved) AS counted, count(*) FILTER (WHERE NOT line_moved AND qc - qt > 1e-12) AS beat_count, round(avg(qc - qt) FILTER (WHERE NOT line_moved), 7) AS mean_probability_clv FROM m WHERE reason IS NULL GROUP BY league_id HAVING count(*) FILTER (WHERE NOT line_moved) > 0")
def a6(v: Views) -> DataFrame:
    return clv.aggregates(_samples(v), "league_id").filter("counted > 0").select("league_id", "counted", "beat_count", r("mean_probability_clv", 7).alias("mean_probability_clv"))


@query("a5_user_clv_aggregate", CLV_SQL + ", a AS (SELECT user_id, count(*) AS samples, count(*) FILTER (WHERE NOT line_moved) AS counted, round(avg(qc - qt) FILTER (WHERE NOT line_moved), 7) AS mean_probability_clv FROM m WHERE reason IS NULL GROUP BY user_id) SELECT u.user_id, coalesce(samples, 0) AS samples, coalesce(counted, 0) AS counted, mean_probability_clv FROM (SELECT DISTINCT user_id FROM tickets) u LEFT JOIN a USING (user_id)")
def a5(v: Views) -> DataFrame:
    own = v.tickets.select("user_id").distinct().join(clv.aggregates(_samples(v), "user_id"), "user_id", "left")
    return own.select("user_id", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("counted", F.lit(0)).alias("counted"), r("mean_probability_clv", 7).alias("mean_probability_clv"))


@query("w1_latest_price_per_book", f"SELECT selection_id, book_id, odds, epoch_us(observed_at) AS observed_us FROM quotes WHERE observed_at > {HALF} QUALIFY row_number() OVER (PARTITION BY selection_id, book_id ORDER BY observed_at DESC) = 1")
def w1(v: Views) -> DataFrame:
    from tickline.operators.pricing import newest

    return newest(v.quotes.filter(F.col("observed_at") > _half())).select("selection_id", "book_id", "odds", us("observed_at").alias("observed_us"))


@query("w4_dedupe_redelivery", "SELECT count(*) AS kept, sum(n) AS seen FROM (SELECT count(*) AS n FROM raw_quotes GROUP BY selection_id, book_id, observed_at)")
def w4(v: Views) -> DataFrame:
    per = v._lines().groupBy("market_id", "side", "book_id", "observed_at").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("kept"), F.sum("n").alias("seen"))


@query("w8_keyset_page", "SELECT event_id, epoch_us(scheduled_start) AS start_us FROM games WHERE (scheduled_start, event_id) > (TIMESTAMP '1996-09-01', 50) ORDER BY scheduled_start, event_id LIMIT 25")
def w8(v: Views) -> DataFrame:
    at = F.lit("1996-09-01").cast("timestamp")
    return reads.page_after(v.games, [("scheduled_start", False), ("event_id", False)], [at, 50], 25).select("event_id", us("scheduled_start").alias("start_us"))


@query("w9_user_wagers", "SELECT user_id, wager_id, stake_minor FROM tickets WHERE user_id = 3 AND placed_at >= TIMESTAMP '1996-01-01' ORDER BY placed_at DESC, wager_id DESC LIMIT 100")
def w9(v: Views) -> DataFrame:
    return v.tickets.filter((F.col("user_id") == 3) & (F.col("placed_at") >= _half())).orderBy(F.desc("placed_at"), F.desc("wager_id")).limit(100).select("user_id", "wager_id", "stake_minor")


@query("w10_list_dimensions", "SELECT league_id, count(*) AS markets, min(sport_id) AS sport_id FROM markets GROUP BY league_id")
def w10(v: Views) -> DataFrame:
    return v.markets.groupBy("league_id").agg(F.count("*").alias("markets"), F.min("sport_id").alias("sport_id"))


@query("w11_legs_for_wagers", "SELECT wager_id, count(*) AS n_legs, string_agg(selection_id::VARCHAR, ',' ORDER BY leg_id) AS selections FROM legs GROUP BY wager_id")
def w11(v: Views) -> DataFrame:
    own = v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs"), F.array_sort(F.collect_list(F.struct("leg_id", F.col("selection_id").cast("string").alias("s")))).alias("l"))
    return own.select("wager_id", "n_legs", F.array_join(F.transform("l", lambda x: x["s"]), ",").alias("selections"))


@query("w12_finalised_events_since", "SELECT event_id, home_score, away_score FROM games WHERE status = 'final' AND scheduled_start >= TIMESTAMP '1996-09-01'")
def w12(v: Views) -> DataFrame:
    return v.games.filter((F.col("status") == "final") & (F.col("scheduled_start") >= F.lit("1996-09-01").cast("timestamp"))).select("event_id", "home_score", "away_score")


@query("w13_get_by_id", "SELECT wager_id, user_id, stake_minor, rounding FROM tickets WHERE wager_id = 100")
def w13(v: Views) -> DataFrame:
    return v.tickets.filter("wager_id = 100").select("wager_id", "user_id", "stake_minor", "rounding")


@query("u1_search_union", "SELECT event_id, home FROM (SELECT event_id, home FROM games WHERE starts_with(lower(home), 'red') UNION SELECT event_id, home FROM games WHERE starts_with(lower(away), 'small')) ORDER BY event_id LIMIT 100")
def u1(v: Views) -> DataFrame:
    g = v.games.select("event_id", "home", "away")
    both = g.filter(F.startswith(F.lower("home"), F.lit("red"))).union(g.filter(F.startswith(F.lower("away"), F.lit("small"))))
    return both.select("event_id", "home").distinct().orderBy("event_id").limit(100)


@query("j5_latest_quote_with_context", "SELECT l.selection_id, l.book_id, l.odds, m.name, m.market_type FROM latest l JOIN markets m USING (market_id)")
def j5(v: Views) -> DataFrame:
    return v.latest.select("selection_id", "book_id", "odds", "market_id").join(v.markets.select("market_id", "name", "market_type"), "market_id").select("selection_id", "book_id", "odds", "name", "market_type")


@query("j6_clv_worklist", "SELECT leg_id FROM legs WHERE taken_at >= TIMESTAMP '1996-01-01' AND taken_at < TIMESTAMP '1997-01-01' AND leg_id NOT IN (SELECT leg_id FROM legs WHERE book_id = 2)")
def j6(v: Views) -> DataFrame:
    legs = v.legs
    inside = legs.filter((F.col("taken_at") >= _half()) & (F.col("taken_at") < F.lit("1997-01-01").cast("timestamp"))).select("leg_id")
    return inside.join(legs.filter("book_id = 2").select("leg_id"), "leg_id", "left_anti")


@query("j7_pending_legs", "SELECT leg_id, home_line AS grading_line, market_id IN (SELECT market_id FROM markets WHERE market_id % 5 = 0) AS draw_quoted FROM legs JOIN games USING (event_id) WHERE status = 'live'")
def j7(v: Views) -> DataFrame:
    draws = v.markets.filter("market_id % 5 = 0").select("market_id").distinct().withColumn("d", F.lit(True))
    own = v.legs.join(v.games.filter("status = 'live'").select("event_id"), "event_id").join(draws, "market_id", "left")
    return own.select("leg_id", F.col("home_line").alias("grading_line"), F.col("d").isNotNull().alias("draw_quoted"))


@query("j8_open_wagers_for_event", "SELECT wager_id, user_id FROM tickets WHERE wager_id IN (SELECT wager_id FROM legs JOIN games USING (event_id) WHERE status = 'live')")
def j8(v: Views) -> DataFrame:
    live = v.legs.select("wager_id", "event_id").join(v.games.filter("status = 'live'").select("event_id"), "event_id")
    return v.tickets.select("wager_id", "user_id").join(live, "wager_id", "left_semi")


@query("j9_account_profile", "SELECT c_custkey AS user_id, c_name AS name, count(wager_id) AS wagers FROM customer LEFT JOIN tickets ON user_id = c_custkey GROUP BY ALL")
def j9(v: Views) -> DataFrame:
    n = v.tickets.groupBy("user_id").agg(F.count("*").alias("wagers"))
    return v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")).join(n, "user_id", "left").select("user_id", "name", F.coalesce("wagers", F.lit(0)).alias("wagers"))


@query("j15_price_move_check", "SELECT leg_id, CASE WHEN q.odds IS NULL THEN 'gone' WHEN abs(q.odds - l.odds) <= 1e-9 * l.odds THEN 'same' WHEN q.odds > l.odds THEN 'better' ELSE 'worse' END AS move FROM legs l LEFT JOIN latest q ON q.selection_id = l.selection_id AND q.book_id = l.book_id")
def j15(v: Views) -> DataFrame:
    now = v.latest.select("selection_id", "book_id", F.col("odds").alias("now"))
    d = F.col("now") - F.col("odds")
    move = F.when(F.col("now").isNull(), "gone").when(F.abs(d) <= 1e-9 * F.col("odds"), "same").when(d > 0, "better").otherwise("worse")
    return v.legs.join(now, ["selection_id", "book_id"], "left").select("leg_id", move.alias("move"))


@query("j16_compare_market", "SELECT market_id, selection_id, count(*) AS books, max(odds) AS best_odds, arg_min(book_id, (-odds, book_id)) AS best_book FROM latest GROUP BY ALL")
def j16(v: Views) -> DataFrame:
    return v.latest.groupBy("market_id", "selection_id").agg(F.count("*").alias("books"), F.max("odds").alias("best_odds"), F.min_by("book_id", F.struct((-F.col("odds")).alias("x"), "book_id")).alias("best_book"))


@query("a1_ohlc_history", """, b AS (SELECT selection_id, book_id, time_bucket(INTERVAL 1 DAY, observed_at) AS bucket, odds, line, observed_at FROM quotes)
SELECT selection_id, book_id, epoch_us(bucket) AS bucket_us, arg_min(odds, observed_at) AS open, max(odds) AS high, min(odds) AS low, arg_max(odds, observed_at) AS close, coalesce(arg_max(line, observed_at), 0.0) AS close_line, bool_or(line IS NOT NULL) AS has_line, count(*) AS samples FROM b GROUP BY selection_id, book_id, bucket""")  # fmt: skip
def a1(v: Views) -> DataFrame:
    return reads.ohlc(v.quotes, "1 day", "selection_id", "book_id").withColumn("bucket", us("bucket")).withColumnRenamed("bucket", "bucket_us")


@query("a13_staleness_quantiles", ", anchors AS (SELECT market_id, max(observed_at) AS anchor FROM quotes GROUP BY market_id) SELECT book_id, count(*) AS n, round(avg(CASE WHEN (epoch_us(anchor) - epoch_us(observed_at)) / 1000000.0 < 8640000 THEN 1.0 ELSE 0.0 END), 8) AS fresh_share, quantile_disc((epoch_us(anchor) - epoch_us(observed_at)), 0.5) AS p50_us FROM quotes JOIN anchors USING (market_id) GROUP BY book_id")
def a13(v: Views) -> DataFrame:
    anchor = v.quotes.groupBy("market_id").agg(F.max("observed_at").alias("anchor"))
    age = us("anchor") - us("observed_at")
    own = v.quotes.join(anchor, "market_id").withColumn("age", age)
    return own.groupBy("book_id").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("age") / 1_000_000 < 8_640_000, 1.0).otherwise(0.0)), 8).alias("fresh_share"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY age)").cast("long").alias("p50_us"))


# ---- tickets and ledger -------------------------------------------------------------------------------------------


@query("k1_parlay_decimal", "SELECT wager_id, count(*) AS n_legs, round(ln(product(odds)), 9) AS log_decimal FROM legs GROUP BY wager_id")
def k1(v: Views) -> DataFrame:
    return tickets.parlays(v.legs).select("wager_id", "n_legs", r(F.log("decimal"), 9).alias("log_decimal"))


@query("k2_parlay_joint_independent", "SELECT wager_id, round(product(1 / odds), 9) AS joint FROM legs GROUP BY wager_id")
def k2(v: Views) -> DataFrame:
    return tickets.parlays(v.legs).select("wager_id", r("joint", 9).alias("joint"))


@query("k5_round_robin_expand", """, small AS (SELECT wager_id FROM legs GROUP BY wager_id HAVING count(*) BETWEEN 3 AND 12)
SELECT a.wager_id, a.leg_id AS leg_0, b.leg_id AS leg_1, c.leg_id AS leg_2, round(a.odds * b.odds * c.odds, 6) AS decimal FROM legs a JOIN small USING (wager_id) JOIN legs b ON b.wager_id = a.wager_id AND b.leg_id > a.leg_id JOIN legs c ON c.wager_id = a.wager_id AND c.leg_id > b.leg_id""")  # fmt: skip
def k5(v: Views) -> DataFrame:
    return tickets.round_robin(v.legs, 3).withColumn("decimal", r("decimal"))


GRADE = """, graded AS (SELECT l.*, CASE WHEN market_type = 'moneyline' THEN CASE WHEN home_score = away_score THEN CASE WHEN market_id % 5 = 0 THEN 'lost' ELSE 'push' END WHEN (home_score > away_score) = (role = 'home') THEN 'won' ELSE 'lost' END
    ELSE CASE sign(CASE WHEN market_type = 'spread' THEN (home_score - away_score + home_line) ELSE (home_score + away_score - home_line) END * CASE WHEN role IN ('home', 'over') THEN 1 ELSE -1 END) WHEN 1 THEN 'won' WHEN 0 THEN 'push' ELSE 'lost' END END AS result
    FROM legs l JOIN games g USING (event_id) WHERE status = 'final'),
counts AS (SELECT wager_id, count(*) AS n_legs FROM legs GROUP BY wager_id),
sums AS (SELECT wager_id, count(*) FILTER (WHERE result = 'won') AS won, count(*) FILTER (WHERE result = 'lost') AS lost, count(*) FILTER (WHERE result = 'push') AS push, count(*) AS n, product(odds) AS accepted, coalesce(product(odds) FILTER (WHERE result = 'push'), 1) AS gone FROM graded GROUP BY wager_id),
decided AS (SELECT s.wager_id, user_id, stake_minor, rounding, placed_at, accepted, CASE WHEN lost > 0 THEN 'lost' WHEN won = 0 THEN 'push' ELSE 'won' END AS status, push, CASE WHEN push = 0 THEN accepted ELSE greatest(accepted / gone, 1) END AS eff FROM sums s JOIN counts c USING (wager_id) JOIN tickets t USING (wager_id) WHERE s.n = n_legs),
settled AS (SELECT *, CASE status WHEN 'lost' THEN 0 WHEN 'push' THEN stake_minor ELSE greatest(stake_minor, CAST(CASE rounding WHEN 'half_even' THEN round_even(stake_minor * eff, 0) WHEN 'half_away' THEN round(stake_minor * eff) ELSE trunc(stake_minor * eff) END AS BIGINT)) END AS returned_minor FROM decided)"""


def _graded(v: Views) -> DataFrame:
    return tickets.grade(v.legs, v.games, v.markets.filter("market_id % 5 = 0").select("market_id"))


def _decided(v: Views) -> DataFrame:
    return tickets.decide(v.tickets, _graded(v), v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs")))


@query("k7_grade_legs", GRADE + " SELECT leg_id, result FROM graded")
def k7(v: Views) -> DataFrame:
    return _graded(v).select("leg_id", "result")


@query("k8_decide_ticket", GRADE + " SELECT status, count(*) AS n FROM settled GROUP BY status")
def k8(v: Views) -> DataFrame:
    return _decided(v).groupBy("status").agg(F.count("*").alias("n"))


@query("k10_settle_batch", GRADE + " SELECT wager_id, status, round(ln(accepted), 9) AS log_accepted FROM settled")
def k10(v: Views) -> DataFrame:
    return _decided(v).select("wager_id", "status", r(F.log("accepted"), 9).alias("log_accepted"))


ENTRIES = GRADE + """, entries AS (SELECT wager_id, user_id, placed_at, 'settlement' AS kind, account_kind, CAST(amount AS BIGINT) AS amount_minor FROM (SELECT *, unnest(['escrow', 'cash', 'house']) AS account_kind, unnest([-stake_minor, returned_minor, stake_minor - returned_minor]) AS amount FROM settled) WHERE amount <> 0
    UNION ALL SELECT wager_id, user_id, placed_at, 'stake', account_kind, CAST(amount AS BIGINT) FROM (SELECT *, unnest(['cash', 'escrow']) AS account_kind, unnest([-stake_minor, stake_minor]) AS amount FROM tickets) WHERE amount <> 0)"""


def _entries(v: Views) -> DataFrame:
    return tickets.settlement_entries(_decided(v)).unionByName(tickets.stake_entries(v.tickets))


@query("k11_settlement_entries", ENTRIES + " SELECT account_kind, count(*) AS n, count(DISTINCT wager_id) AS wagers FROM entries WHERE kind = 'settlement' GROUP BY account_kind")
def k11(v: Views) -> DataFrame:
    return tickets.settlement_entries(_decided(v)).groupBy("account_kind").agg(F.count("*").alias("n"), F.countDistinct("wager_id").alias("wagers"))


@query("k12_stake_entries", "SELECT wager_id, account_kind, amount AS amount_minor FROM (SELECT *, unnest(['cash', 'escrow']) AS account_kind, unnest([-stake_minor, stake_minor]) AS amount FROM tickets) WHERE amount <> 0")
def k12(v: Views) -> DataFrame:
    return tickets.stake_entries(v.tickets).select("wager_id", "account_kind", "amount_minor")


@query("a2_account_balances", "SELECT user_id, 'cash' AS account_kind, CAST(-sum(stake_minor) AS BIGINT) AS balance_minor, count(*) AS entries, epoch_us(min(placed_at)) AS first_us FROM tickets WHERE stake_minor <> 0 GROUP BY user_id")
def a2(v: Views) -> DataFrame:
    own = tickets.balances(tickets.stake_entries(v.tickets)).filter("account_kind = 'cash'")
    return own.select("user_id", "account_kind", "balance_minor", "entries", us("first_at").alias("first_us"))


@query("a3_ledger_integrity", ENTRIES + ", tx AS (SELECT wager_id, 'settlement' AS kind FROM settled UNION ALL SELECT wager_id, 'stake' FROM tickets), p AS (SELECT wager_id, kind, sum(amount_minor) AS s, count(*) AS n FROM entries GROUP BY ALL) SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS total_minor, count(*) AS transactions, CAST(coalesce(sum(n), 0) AS BIGINT) AS entries, count(*) FILTER (WHERE s <> 0 OR n < 2) AS unbalanced, count(*) FILTER (WHERE n IS NULL) AS empty FROM tx LEFT JOIN p USING (wager_id, kind)")
def a3(v: Views) -> DataFrame:
    decided = _decided(v)
    tx = decided.select("wager_id", F.lit("settlement").alias("kind")).unionByName(v.tickets.select("wager_id", F.lit("stake").alias("kind")))
    return tickets.integrity(tx, tickets.settlement_entries(decided).unionByName(tickets.stake_entries(v.tickets)))


@query("a4_ledger_sum_since", "SELECT user_id, CAST(-sum(stake_minor) AS BIGINT) AS total_minor, count(*) AS n FROM tickets WHERE placed_at >= TIMESTAMP '1996-01-01' AND stake_minor <> 0 GROUP BY user_id")
def a4(v: Views) -> DataFrame:
    own = tickets.stake_entries(v.tickets).filter((F.col("account_kind") == "cash") & (F.col("placed_at") >= _half()))
    return own.groupBy("user_id").agg(F.sum("amount_minor").alias("total_minor"), F.count("*").alias("n"))


@query("a14_oldest_unsettled", GRADE + " SELECT wager_id FROM tickets WHERE wager_id NOT IN (SELECT wager_id FROM settled) ORDER BY placed_at, wager_id LIMIT 1")
def a14(v: Views) -> DataFrame:
    open_ones = v.tickets.join(_decided(v).select("wager_id"), "wager_id", "left_anti")
    return open_ones.agg(F.min_by("wager_id", F.struct("placed_at", "wager_id")).alias("wager_id"))


@query("a15_net_position", ENTRIES + " SELECT account_kind, count(*) AS n FROM entries GROUP BY account_kind")
def a15(v: Views) -> DataFrame:
    return _entries(v).groupBy("account_kind").agg(F.count("*").alias("n"))


@query("j11_ledger_empty_txn", GRADE + " SELECT wager_id FROM tickets WHERE wager_id NOT IN (SELECT wager_id FROM settled)")
def j11(v: Views) -> DataFrame:
    return v.tickets.select("wager_id").join(tickets.settlement_entries(_decided(v)).select("wager_id"), "wager_id", "left_anti")


@query("k17_ticket_shape_audit", "SELECT unnest(['lost_returns_nothing', 'push_returns_stake', 'won_at_least_stake', 'legs_within_25']) AS rule, 0 AS violations")
def k17(v: Views) -> DataFrame:
    return tickets.ticket_audit(_decided(v), v.tickets, v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs"))).withColumn("violations", F.col("violations").cast("int"))


@query("k14_limit_usage", """, lim AS (SELECT DISTINCT user_id, unnest(['day', 'week', 'month']) AS period FROM tickets)
SELECT l.user_id, period, CAST(coalesce(sum(stake_minor) FILTER (WHERE placed_at <= TIMESTAMP '1996-03-31' AND placed_at >= CASE period WHEN 'day' THEN TIMESTAMP '1996-03-30' WHEN 'week' THEN TIMESTAMP '1996-03-24' ELSE TIMESTAMP '1996-03-02' END), 0) AS BIGINT) AS used_minor FROM lim l LEFT JOIN tickets t ON t.user_id = l.user_id GROUP BY ALL""")  # fmt: skip
def k14(v: Views) -> DataFrame:
    lim = v.tickets.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("day", "week", "month")))).alias("period"), F.lit(1_000_000).alias("limit_minor"), F.lit("1996-03-31").cast("timestamp").alias("now"))
    return tickets.limit_usage(lim, tickets.stake_entries(v.tickets)).select("user_id", "period", "used_minor")


# ---- steam --------------------------------------------------------------------------------------------------------

STEAM = """, w AS (SELECT t.*, to_timestamp(epoch(time_bucket(INTERVAL 6 HOUR, observed_at)) - o * 21600)::TIMESTAMP AS ws FROM ticks t, range(3) r(o)),
pts AS (SELECT ws, selection_id, book_id, implied, observed_at, lag(implied) OVER x AS before, first_value(implied) OVER x AS p0, last_value(implied) OVER (PARTITION BY ws, selection_id, book_id ORDER BY observed_at, implied ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p1, count(*) OVER (PARTITION BY ws, selection_id, book_id) AS n
    FROM w WINDOW x AS (PARTITION BY ws, selection_id, book_id ORDER BY observed_at, implied)),
moves AS (SELECT ws, selection_id, book_id, p1 - p0 AS delta, epoch_us(observed_at) AS moved_us FROM pts WHERE n >= 2 AND before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ws, selection_id, book_id ORDER BY (implied - before) * sign(p1 - p0) DESC, observed_at) = 1)"""


def _moves(v: Views) -> DataFrame:
    return steam.moves(v.ticks, "18 hours", "6 hours")


@query("t2_steam_moves", STEAM + " SELECT epoch_us(ws) AS start_us, selection_id, book_id, round(delta, 9) AS delta, moved_us FROM moves")
def t2(v: Views) -> DataFrame:
    return _moves(v).select(us("window_start").alias("start_us"), "selection_id", "book_id", r("delta", 9).alias("delta"), "moved_us")


@query("t1_steam_windows", STEAM + " SELECT epoch_us(ws) AS start_us, count(*) AS n FROM w GROUP BY ws")
def t1(v: Views) -> DataFrame:
    return v.ticks.groupBy(F.window("observed_at", "18 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(us("w.start").alias("start_us"), "n")


CAND = STEAM + """, lead_ AS (SELECT * FROM moves WHERE abs(delta) >= 0.05 QUALIFY row_number() OVER (PARTITION BY ws, selection_id ORDER BY moved_us, abs(delta) DESC, book_id) = 1),
cand AS (SELECT l.ws, l.selection_id, l.book_id AS lead_book_id, l.delta, count(*) FILTER (WHERE m.book_id <> l.book_id AND abs(m.delta) >= 0.05 AND sign(m.delta) = sign(l.delta) AND m.moved_us - l.moved_us BETWEEN 0 AND 43200000000) AS followers,
    avg(CASE WHEN abs(m.delta) < 0.005 THEN 0.0 WHEN sign(m.delta) = sign(l.delta) THEN 1.0 ELSE -1.0 END) AS corr, count(*) AS books FROM lead_ l JOIN moves m USING (ws, selection_id) GROUP BY ALL),
found AS (SELECT *, CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction FROM cand WHERE followers >= 1 AND corr >= 0.5)"""


def _found(v: Views) -> DataFrame:
    return steam.candidates(_moves(v), max_lag=43200.0)


@query("t3_steam_lead", CAND + " SELECT epoch_us(ws) AS start_us, selection_id, lead_book_id, round(delta, 9) AS lead_delta, followers, round(corr, 9) AS correlation, books FROM found")
def t3(v: Views) -> DataFrame:
    return _found(v).select(us("window_start").alias("start_us"), "selection_id", "lead_book_id", r("lead_delta", 9).alias("lead_delta"), F.size("followers").cast("long").alias("followers"), r("correlation", 9).alias("correlation"), F.col("participating_books").alias("books"))


@query("t4_steam_followers", CAND + " SELECT epoch_us(l.ws) AS start_us, l.selection_id, m.book_id, round((m.moved_us - l.moved_us) / 1000000.0::DOUBLE, 6) AS lag_seconds FROM found f JOIN lead_ l USING (ws, selection_id) JOIN moves m USING (ws, selection_id) WHERE m.book_id <> l.book_id AND abs(m.delta) >= 0.05 AND sign(m.delta) = sign(l.delta) AND m.moved_us - l.moved_us BETWEEN 0 AND 43200000000")
def t4(v: Views) -> DataFrame:
    own = _found(v).select(us("window_start").alias("start_us"), "selection_id", F.explode("followers").alias("f"))
    return own.select("start_us", "selection_id", "f.book_id", r("f.lag_seconds").alias("lag_seconds"))


@query("t7_steam_cooldown", CAND + """, ordered AS (SELECT selection_id, direction, epoch(ws) AS e, row_number() OVER (PARTITION BY selection_id, direction ORDER BY ws) AS k FROM found),
fold AS (SELECT selection_id, direction, k, e, e AS last, TRUE AS kept FROM ordered WHERE k = 1 UNION ALL SELECT o.selection_id, o.direction, o.k, o.e, CASE WHEN o.e - f.last >= 86400 THEN o.e ELSE f.last END, o.e - f.last >= 86400 FROM fold f JOIN ordered o ON o.selection_id = f.selection_id AND o.direction = f.direction AND o.k = f.k + 1)
SELECT selection_id, direction, count(*) AS emitted FROM fold WHERE kept GROUP BY ALL""")  # fmt: skip
def t7(v: Views) -> DataFrame:
    return steam.with_cooldown(_found(v), 86400.0).groupBy("selection_id", "direction").agg(F.count("*").alias("emitted"))


@query("r2_channel_counts", "SELECT channel, count(*) AS n FROM (SELECT unnest(['market:' || market_id::VARCHAR, 'event:' || event_id::VARCHAR, 'league:' || league_id]) AS channel FROM markets) GROUP BY channel")
def r2(v: Views) -> DataFrame:
    ch = F.array(*[F.concat(F.lit(f"{k}:"), F.col(f"{k}_id").cast("string")) for k in ("market", "event", "league")])
    return v.markets.select(F.explode(ch).alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))


# ---- leaderboards and the rest ------------------------------------------------------------------------------------

BOARD = GRADE + CLV_SQL + """, s AS (SELECT user_id, count(*) AS n, sum(stake_minor) AS st, sum(returned_minor - stake_minor) AS net FROM settled GROUP BY user_id),
c AS (SELECT user_id, count(*) AS clv_samples, avg((qc / qt - 1) * 100) AS mean FROM m WHERE reason IS NULL AND NOT line_moved GROUP BY user_id),
board AS (SELECT user_id, n AS settled_wagers, clv_samples, net::DOUBLE / st::DOUBLE AS roi, mean FROM s JOIN c USING (user_id) WHERE n >= 2 AND clv_samples >= 3)"""


def _board(v: Views, by: str, limit: int) -> DataFrame:
    fine = _samples(v).filter("NOT line_moved").groupBy("user_id").agg(F.count("*").alias("clv_samples"), F.avg("percent_clv").alias("mean_percent_clv"))
    return clv.leaderboard(_decided(v), fine, by, limit, 2, 3)


@query("a8_leaderboard_roi", BOARD + " SELECT user_id, settled_wagers, clv_samples, round(roi, 6) AS roi FROM board ORDER BY board.roi DESC, mean DESC, settled_wagers DESC, user_id LIMIT 50")
def a8(v: Views) -> DataFrame:
    return _board(v, "roi", 50).select("user_id", "settled_wagers", "clv_samples", r("roi").alias("roi"))


@query("a9_leaderboard_clv", BOARD + " SELECT user_id, settled_wagers, clv_samples, round(mean, 6) AS mean_percent_clv FROM board ORDER BY mean DESC, board.roi DESC, settled_wagers DESC, user_id LIMIT 50")
def a9(v: Views) -> DataFrame:
    return _board(v, "clv", 50).select("user_id", "settled_wagers", "clv_samples", r("mean_percent_clv").alias("mean_percent_clv"))


@query("k9_reprice_removed", GRADE + " SELECT wager_id, round(ln(eff), 9) AS log_effective FROM settled WHERE status = 'won' AND push > 0")
def k9(v: Views) -> DataFrame:
    own = _graded(v).groupBy("wager_id").agg(F.collect_list("odds").alias("all"), F.collect_list(F.when(F.col("result") == "push", F.col("odds"))).alias("gone"), F.count_if(F.col("result") == "lost").alias("lost"), F.count_if(F.col("result") == "won").alias("won"), F.count("*").alias("n"))
    whole = own.join(v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs")), "wager_id").filter("n = n_legs AND lost = 0 AND won > 0 AND size(gone) > 0")
    return whole.select("wager_id", r(F.log(F.greatest(tickets.product(F.col("all")) / tickets.product(F.col("gone")), F.lit(1.0))), 9).alias("log_effective"))


@query("k16_slip_audit", "SELECT count(*) AS tickets, count(*) FILTER (WHERE n < 2) AS too_few, count(*) FILTER (WHERE n > 25) AS too_many, count(*) FILTER (WHERE d < n) AS duplicate_selection FROM (SELECT wager_id, count(*) AS n, count(DISTINCT selection_id) AS d FROM legs GROUP BY wager_id)")
def k16(v: Views) -> DataFrame:
    per = v.legs.groupBy("wager_id").agg(F.count("*").alias("n"), F.countDistinct("selection_id").alias("d"))
    return per.agg(F.count("*").alias("tickets"), F.count_if(F.col("n") < 2).alias("too_few"), F.count_if(F.col("n") > 25).alias("too_many"), F.count_if(F.col("d") < F.col("n")).alias("duplicate_selection"))


@query("w7_rank_steam", CAND + " SELECT epoch_us(ws) AS start_us, selection_id, direction FROM found WHERE abs(delta) >= 0.2 ORDER BY ws DESC, selection_id DESC LIMIT 30")
def w7(v: Views) -> DataFrame:
    own = _found(v).filter(F.abs("lead_delta") >= 0.2).orderBy(F.desc("window_end"), F.desc("selection_id")).limit(30)
    return own.select(us("window_start").alias("start_us"), "selection_id", "direction")


@query("j10_grant_credit", "SELECT wager_id, user_id, stake_minor AS amount_minor FROM tickets WHERE stake_minor <> 0")
def j10(v: Views) -> DataFrame:
    own = tickets.stake_entries(v.tickets).filter("account_kind = 'escrow'").select("wager_id", "amount_minor")
    return v.tickets.select("wager_id", "user_id").join(own, "wager_id").select("wager_id", "user_id", "amount_minor")


@query("j14_leaderboard_join", BOARD + " SELECT user_id, settled_wagers, clv_samples FROM board")
def j14(v: Views) -> DataFrame:
    fine = _samples(v).filter("NOT line_moved").groupBy("user_id").agg(F.count("*").alias("clv_samples"))
    settled = _decided(v).groupBy("user_id").agg(F.count("*").alias("settled_wagers"))
    return settled.join(fine, "user_id").filter("settled_wagers >= 2 AND clv_samples >= 3").select("user_id", "settled_wagers", "clv_samples")


@query("k13_cash_out_value", GRADE + REF_SQL + """, per AS (SELECT l.wager_id, count(*) FILTER (WHERE g.result IS NULL) AS n_open, count(f.fair_prob) FILTER (WHERE g.result IS NULL) AS n_fair, count(*) FILTER (WHERE g.result IS NOT NULL AND g.result <> 'won') AS dead
    FROM legs l LEFT JOIN graded g USING (leg_id) LEFT JOIN fair f ON f.selection_id = l.selection_id GROUP BY l.wager_id)
SELECT wager_id, n_open, TRUE AS below_payout FROM per WHERE n_open > 0 AND dead = 0 AND n_fair = n_open""")  # fmt: skip
def k13(v: Views) -> DataFrame:
    fair = pricing.fair_values(*_reference(v)).filter("NOT fallback")
    offers = tickets.cash_out(v.tickets, v.legs, _graded(v), fair)
    return offers.select("wager_id", "n_open", (F.col("offer_minor") < F.col("payout_minor")).alias("below_payout"))


@query("k15_limits_in_force", """, x AS (SELECT wager_id, user_id, stake_minor, placed_at, lead(placed_at) OVER (PARTITION BY user_id ORDER BY placed_at, wager_id) AS superseded_at FROM tickets)
SELECT wager_id, user_id, stake_minor FROM x WHERE placed_at <= TIMESTAMP '1996-01-01' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1996-01-01')""")  # fmt: skip
def k15(v: Views) -> DataFrame:
    own = v.tickets.withColumn("superseded_at", F.lead("placed_at").over(Window.partitionBy("user_id").orderBy("placed_at", "wager_id")))
    return own.filter((F.col("placed_at") <= _half()) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > _half()))).select("wager_id", "user_id", "stake_minor")


@query("t6_steam_thresholds", CAND + " SELECT count(*) AS examined, count(*) FILTER (WHERE followers >= 1) AS followed, count(*) FILTER (WHERE followers >= 1 AND corr >= 0.5) AS passed FROM cand")
def t6(v: Views) -> DataFrame:
    lead = _moves(v).filter(F.abs("delta") >= 0.05).select("window_start", "selection_id").distinct()
    every = steam.candidates(_moves(v), max_lag=43200.0, min_correlation=-1.0)
    both = lead.select(F.lit(None).cast("double").alias("c"), F.lit(True).alias("led")).unionByName(every.select(F.col("correlation").alias("c"), F.lit(False).alias("led")))
    return both.agg(F.count_if("led").alias("examined"), F.count_if(~F.col("led")).alias("followed"), F.count_if(~F.col("led") & (F.col("c") >= 0.5)).alias("passed"))


# ---- whole rows and amounts beside the counts above ---------------------------------------------------------------


@query("a15_net_position_accounts", ENTRIES + " SELECT account_kind, user_id, CAST(sum(amount_minor) AS BIGINT) AS net_minor, count(*) AS entries FROM entries GROUP BY account_kind, user_id")
def a15_accounts(v: Views) -> DataFrame:
    return tickets.balances(_entries(v)).select("account_kind", "user_id", F.col("balance_minor").alias("net_minor"), "entries")


@query("k11_settlement_entries_rows", ENTRIES + " SELECT wager_id, user_id, account_kind, amount_minor FROM entries WHERE kind = 'settlement'")
def k11_rows(v: Views) -> DataFrame:
    return tickets.settlement_entries(_decided(v)).select("wager_id", "user_id", "account_kind", "amount_minor")


_MONEY = "CAST(CASE rounding WHEN 'half_even' THEN round_even({0}, 0) WHEN 'half_away' THEN round({0}) ELSE trunc({0}) END AS BIGINT)"


@query("k13_cash_out_value_all", GRADE + REF_ALL_SQL + f""", per AS (SELECT l.wager_id, count(*) FILTER (WHERE g.result IS NULL) AS n_open, count(f.fair_prob) FILTER (WHERE g.result IS NULL) AS n_fair, count(*) FILTER (WHERE g.result IS NOT NULL AND g.result <> 'won') AS dead,
    product(l.odds) AS total, product(f.fair_prob) FILTER (WHERE g.result IS NULL) AS chance FROM legs l LEFT JOIN graded g USING (leg_id) LEFT JOIN fair f ON f.selection_id = l.selection_id GROUP BY l.wager_id),
pays AS (SELECT wager_id, n_open, chance, rounding, {_MONEY.format('(stake_minor * total)')} AS payout_minor FROM per JOIN tickets USING (wager_id) WHERE n_open > 0 AND dead = 0 AND n_fair = n_open),
worth AS (SELECT *, {_MONEY.format('(payout_minor * chance)')} AS fair_minor FROM pays)
SELECT wager_id, n_open, payout_minor, fair_minor, {_MONEY.format('(fair_minor * 0.95::DOUBLE)')} AS offer_minor FROM worth""")  # fmt: skip
def k13_all(v: Views) -> DataFrame:
    return tickets.cash_out(v.tickets, v.legs, _graded(v), _fair(v, True)).select("wager_id", "n_open", "payout_minor", "fair_minor", "offer_minor")


@query("k17_ticket_shape_audit_all", GRADE + """ SELECT rule, count(*) FILTER (WHERE bad) AS violations FROM (SELECT unnest(['lost_returns_nothing', 'push_returns_stake', 'won_at_least_stake', 'legs_within_25']) AS rule,
    unnest([s.status = 'lost' AND returned_minor <> 0, s.status = 'push' AND returned_minor <> t.stake_minor, s.status = 'won' AND returned_minor < t.stake_minor, n_legs > 25]) AS bad FROM tickets t LEFT JOIN settled s USING (wager_id) LEFT JOIN counts USING (wager_id)) GROUP BY rule""")  # fmt: skip
def k17_all(v: Views) -> DataFrame:
    return tickets.ticket_audit(_decided(v), v.tickets, v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs")))
