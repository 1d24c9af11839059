"""Registered queries, third part: change detection, sinks, keyed streams, copula prices, and whole rows beside earlier counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.functions import odds as O
from tickline.operators import changes, clv, copula, pricing, reads, steam, tickets
from tickline.plans.catalog import ASSESS_SQL, FAIR_ALL_SQL, FAIR_SQL, WIDE, _fair, _gated, query, r, us
from tickline.plans.catalog2 import BACK, CAND, GRADE, HALF, SNAP, STEAM, _decided, _found, _graded, _half, _legs, _moves
from tickline.plans.model import Views
from tickline.sources import raw, sinks
from tickline.streaming import histories, state

# ---- change detection ---------------------------------------------------------------------------------------------

REFRESH_DAYS = 300
RECORDS = f""", newest AS (SELECT market_id, time_bucket(INTERVAL 720 HOUR, observed_at, TIMESTAMP '1970-01-01') AS w, selection_id, book_id, arg_max(round(odds)::DOUBLE, observed_at) AS odds, arg_max(coalesce(line, -999), observed_at) AS line, max(observed_at) AS newest_at FROM quotes GROUP BY ALL),
records AS (SELECT market_id, max(newest_at) AS observed_at, count(*) AS n_quotes, sha256(string_agg(selection_id::VARCHAR || '|' || book_id::VARCHAR || '|' || odds::VARCHAR || '|' || CASE WHEN line = -999 THEN '-' ELSE (line + 0.0)::VARCHAR END, ';' ORDER BY selection_id, book_id)) AS fingerprint FROM newest GROUP BY market_id, w),
marked AS (SELECT *, fingerprint IS DISTINCT FROM lag(fingerprint) OVER (PARTITION BY market_id ORDER BY observed_at) AS changed FROM records),
runs AS (SELECT *, sum(changed::INT) OVER (PARTITION BY market_id ORDER BY observed_at) AS run FROM marked),
numbered AS (SELECT *, row_number() OVER (PARTITION BY market_id, run ORDER BY observed_at) AS k FROM runs),
fold AS (SELECT market_id, run, k, observed_at, observed_at AS last, TRUE AS kept FROM numbered WHERE k = 1
    UNION ALL SELECT n.market_id, n.run, n.k, n.observed_at, CASE WHEN n.observed_at - f.last >= INTERVAL {REFRESH_DAYS} DAY THEN n.observed_at ELSE f.last END, n.observed_at - f.last >= INTERVAL {REFRESH_DAYS} DAY FROM fold f JOIN numbered n ON n.market_id = f.market_id AND n.run = f.run AND n.k = f.k + 1),
outcomes AS (SELECT market_id, epoch_us(observed_at) AS at_us, CASE WHEN k = 1 THEN 'changed' WHEN kept THEN 'refreshed' ELSE 'suppressed' END AS outcome FROM fold)"""


def _records(v: Views) -> DataFrame:
    return changes.market_records(v.quotes.withColumn("odds", F.round("odds")), "720 hours")


@query("s5_change_detect", RECORDS + " SELECT market_id, at_us, n_quotes, fingerprint, outcome FROM outcomes JOIN (SELECT market_id, epoch_us(observed_at) AS at_us, n_quotes, fingerprint FROM records) USING (market_id, at_us)")
def s5(v: Views) -> DataFrame:
    return changes.change_detect(_records(v), REFRESH_DAYS * 86400.0).select("market_id", us("observed_at").alias("at_us"), "n_quotes", "fingerprint", "outcome")


@query("r3_change_stream", RECORDS + " SELECT market_id, at_us, outcome FROM outcomes")
def r3(v: Views) -> DataFrame:
    own = sinks.stored(_records(v), "records")
    early = F.col("observed_at") < _half()
    return state.replay([own.filter(early), own.filter(~early)], lambda s: state.change_stream(s, REFRESH_DAYS * 86400.0), "changes")


# ---- sinks --------------------------------------------------------------------------------------------------------

BEST = """, best AS (SELECT market_id, selection_id, max(odds) AS odds, epoch_us(max(observed_at)) AS at_us FROM latest GROUP BY ALL)"""


def _best(v: Views, offset: float = 0.0) -> DataFrame:
    return v.latest.groupBy("market_id", "selection_id").agg((F.max("odds") + offset).alias("odds"), us(F.max("observed_at")).alias("at_us"))


@query("s10_upsert_signals", BEST + " SELECT market_id, selection_id, odds, at_us FROM best")
def s10(v: Views) -> DataFrame:
    """A table whose rows of every third market are wrong, and a replay (each row twice) that corrects them."""
    held = _best(v).withColumn("odds", F.when(F.col("market_id") % 3 == 0, F.col("odds") + 1).otherwise(F.col("odds")))
    again = _best(v).withColumn("seq", F.lit(2)).unionByName(_best(v, 5.0).withColumn("seq", F.lit(1))).filter("market_id % 3 <> 1")
    return sinks.upsert(held, again, ["market_id", "selection_id"], "seq")


@query("s11_replace_arb_legs", "SELECT market_id, CASE WHEN market_id % 2 = 0 THEN 2 ELSE 1 END AS version, string_agg(selection_id::VARCHAR || ':' || book_id::VARCHAR, ',' ORDER BY selection_id, book_id) AS legs FROM latest WHERE market_id % 2 = 1 OR book_id < 3 GROUP BY market_id")
def s11(v: Views) -> DataFrame:
    entry = lambda n: F.array_sort(F.collect_list(F.struct("selection_id", "book_id", F.lit(n).alias("version"))))
    old = v.latest.groupBy("market_id").agg(entry(1).alias("legs")).join(v.latest.filter("market_id % 2 = 1 OR book_id < 3").select("market_id"), "market_id", "left_semi")
    new = v.latest.filter("market_id % 2 = 0 AND book_id < 3").groupBy("market_id").agg(entry(2).alias("legs"))
    text = F.array_join(F.transform("legs", lambda x: F.concat(x["selection_id"].cast("string"), F.lit(":"), x["book_id"].cast("string"))), ",")
    return sinks.replace_legs(old, new, "market_id").select("market_id", F.element_at("legs", 1)["version"].alias("version"), text.alias("legs"))


@query("s12_price_layout", "SELECT strftime(time_bucket(INTERVAL 720 HOUR, observed_at, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H') AS chunk, count(*) AS rows, count(DISTINCT selection_id) AS selections, epoch_us(min(observed_at)) AS first_us, epoch_us(max(observed_at)) AS last_us FROM quotes GROUP BY 1")
def s12(v: Views) -> DataFrame:
    """Chunks of 30 days instead of 12 hours, since the given quotes lie days apart."""
    path = sinks.shared_path(v.spark, "prices")
    sinks.write_prices(v.quotes.select("selection_id", "book_id", "odds", "line", "observed_at"), path, "720 hours")
    back = v.spark.read.schema("selection_id long, book_id int, odds double, line double, observed_at timestamp, chunk string").parquet(path)
    return back.groupBy("chunk").agg(F.count("*").alias("rows"), F.countDistinct("selection_id").alias("selections"), us(F.min("observed_at")).alias("first_us"), us(F.max("observed_at")).alias("last_us"))


@query("s13_publish_findings", "SELECT 'best_price' AS kind, market_id::VARCHAR AS key, count(*) AS messages, round(sum(odds), 6) AS total FROM (SELECT market_id, selection_id, max(odds) AS odds FROM latest GROUP BY ALL) GROUP BY market_id UNION ALL SELECT 'spread_line', market_id::VARCHAR, 1, round(line, 6) FROM markets WHERE line IS NOT NULL")
def s13(v: Views) -> DataFrame:
    path = sinks.shared_path(v.spark, "topics")
    sinks.publish(sinks.stored(_best(v).select("market_id", "selection_id", "odds"), "persisted"), path, "best_price", "market_id")
    sinks.publish(sinks.stored(v.markets.filter("line IS NOT NULL").select("market_id", F.col("line").alias("odds")), "persisted"), path, "spread_line", "market_id")
    back = v.spark.read.schema("key string, value string, kind string").parquet(path)
    return back.groupBy("kind", "key").agg(F.count("*").alias("messages"), r(F.sum(F.get_json_object("value", "$.odds").cast("double"))).alias("total"))


@query("s14_append_tickets_ledger", """, own AS (SELECT * FROM tickets WHERE wager_id IN (SELECT wager_id FROM legs)), stakes AS (SELECT wager_id, stake_minor FROM own WHERE stake_minor <> 0)
SELECT 'tickets' AS name, count(*) AS n, CAST(sum(stake_minor) AS BIGINT) AS total FROM own UNION ALL SELECT 'legs', count(*), CAST(sum(selection_id) AS BIGINT) FROM legs UNION ALL SELECT 'entries', 2 * count(*), 0::BIGINT FROM stakes""")  # fmt: skip
def s14(v: Views) -> DataFrame:
    path = sinks.shared_path(v.spark, "betting")
    for odd in (0, 1):
        legs = v.legs.filter(f"wager_id % 2 = {odd}")
        own = v.tickets.join(legs.select("wager_id"), "wager_id", "left_semi")  # a ticket without legs would refuse its batch
        sinks.append_tickets(own, legs, tickets.stake_entries(own), path)
    total = lambda name, c: v.spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n"), F.sum(c).alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return total("tickets", "stake_minor").unionByName(total("legs", "selection_id")).unionByName(total("entries", "amount_minor"))


@query("s15_set_user_status", "SELECT c_custkey AS user_id, CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'suspended' ELSE c_mktsegment END AS status FROM customer")
def s15_status(v: Views) -> DataFrame:
    """Customers' segments stand for statuses, two of them terminal; a third of the accounts, and unknown ones, are to be suspended."""
    own = v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("status"))
    ask = own.filter("user_id % 3 = 0").select("user_id", F.lit("suspended").alias("status"))
    return reads.set_status(own, ask.unionByName(ask.select((-1 - F.col("user_id")).alias("user_id"), "status")), "user_id", ("MACHINERY", "HOUSEHOLD"))


# ---- sources ------------------------------------------------------------------------------------------------------


@query("s2_normalize_props", "SELECT event_id::VARCHAR AS id, book_id::VARCHAR AS book, CASE WHEN role IN ('home', 'over') THEN 'over' ELSE 'under' END AS role, 'player ' || market_id::VARCHAR AS subject, odds, CASE WHEN market_id % 50 = 7 THEN 'missing_subject' END AS reason FROM latest")
def s2_props(v: Views) -> DataFrame:
    """Every market as one player of its event's prop market; players of every fiftieth lack their name."""
    name = F.when(F.col("role").isin("home", "over"), "Over").otherwise("Under")
    who = F.concat(F.when(F.col("market_id") % 50 == 7, " ").otherwise("player "), F.when(F.col("market_id") % 50 == 7, "").otherwise(F.col("market_id").cast("string")))
    entry = F.struct(name.alias("name"), who.alias("description"), F.col("odds").alias("price"), F.col("market_id").cast("double").alias("point"))
    own = v.latest.groupBy("event_id", "book_id").agg(F.array_sort(F.collect_list(entry)).alias("outcomes"), F.max("observed_at").alias("at"))
    book = F.struct(F.col("book_id").cast("string").alias("key"), F.col("at").alias("last_update"), F.array(F.struct(F.lit("player_points").alias("key"), "outcomes")).alias("markets"))
    own = own.groupBy("event_id").agg(F.array_sort(F.collect_list(book)).alias("bookmakers"))
    payload = own.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("h").alias("home_team"), F.lit("a").alias("away_team"), "bookmakers")).alias("payload"))
    out = raw.normalize(raw.read_payloads(payload))
    subject = F.coalesce("subject", F.concat(F.lit("player "), F.col("line").cast("long").cast("string")))
    return out.select("id", "book", "role", subject.alias("subject"), "odds", "reason")


# ---- projections --------------------------------------------------------------------------------------------------


@query("p9_fair_decimal", "SELECT selection_id, book_id, epoch_us(observed_at) AS observed_us, round(odds / 0.98::DOUBLE, 6) AS fair_decimal, round(1 / odds, 6) AS breakeven, round(1.02::DOUBLE * odds / 0.98::DOUBLE, 6) AS min_decimal FROM quotes")
def p9_fair(v: Views) -> DataFrame:
    """The price of a fair probability (two per cent below what the odds imply), the odds' own break-even, and the price for an edge of two per cent."""
    q = 0.98 / F.col("odds")
    return v.quotes.select("selection_id", "book_id", us("observed_at").alias("observed_us"), r(O.prob_to_decimal(q)).alias("fair_decimal"), r(O.decimal_to_prob(F.col("odds"))).alias("breakeven"), r(F.lit(1.02) / q).alias("min_decimal"))


# ---- value against the reference ------------------------------------------------------------------------------------

ASSESS_ALL_SQL = ASSESS_SQL.replace(FAIR_SQL, FAIR_ALL_SQL)


@query("m11_ev_signals_gated", ASSESS_ALL_SQL + """, pw AS (SELECT market_id, max(p) AS b, min(p) AS a, any_value(s) AS s, max_by(fair_prob, p) AS f FROM fair GROUP BY market_id),
bis AS (SELECT market_id, a, b, s, f, CASE WHEN s > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, CASE WHEN s > 1 THEN 2 * ln(2) / -ln(b) + 2 ELSE 1.0::DOUBLE END AS hi, 0 AS n FROM pw
    UNION ALL SELECT market_id, a, b, s, f, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM bis WHERE n < 60),
gaps AS (SELECT market_id, greatest(abs(b / s - f), CASE WHEN least(a, b) - (s - 1) / 2 > 0 THEN abs(b - (s - 1) / 2 - f) ELSE 0 END, abs(pow(b, (lo + hi) / 2) - f)) AS gap FROM bis WHERE n = 60)
SELECT selection_id, book_id, CASE WHEN outcome = 'signal' AND ev < gap * odds THEN 'within_disagreement' ELSE outcome END AS outcome FROM gated LEFT JOIN gaps USING (market_id)""")  # fmt: skip
def m11_gated(v: Views) -> DataFrame:
    """Every quote's outcome with the gate of the methods' disagreement in force."""
    return pricing.ev_outcomes(pricing.assess(v.latest, _fair(v, True), WIDE), max_age=WIDE, ratio=1.0).select("selection_id", "book_id", "outcome")


# ---- closing line value -------------------------------------------------------------------------------------------

FULL = SNAP + """, ns AS (SELECT market_id, count(DISTINCT selection_id) AS n FROM quotes GROUP BY market_id),
sides AS (SELECT leg_id, side, count(*) AS n, sum(1 / odds) AS s, count(DISTINCT coalesce((CASE WHEN role = 'away' AND market_type = 'spread' THEN CASE WHEN line = 0 THEN 0.0 ELSE -line END ELSE line END)::VARCHAR, '-')) AS lines, max(observed_at) AS newest, string_agg(selection_id::VARCHAR, ',' ORDER BY selection_id) AS ids FROM snaps GROUP BY leg_id, side),
m AS (SELECT l.leg_id, l.user_id, l.taken_at, CASE WHEN status IN ('scheduled', 'postponed') THEN 'no_close' WHEN coalesce(t.n, 0) < ns.n THEN 'taken_incomplete' WHEN t.lines > 1 THEN 'taken_incoherent' WHEN ts.odds IS NULL OR ts.observed_at <> l.taken_at OR ts.odds <> l.odds THEN 'taken_quote_mismatch'
    WHEN coalesce(c.n, 0) < ns.n THEN 'closing_incomplete' WHEN c.lines > 1 THEN 'closing_incoherent' WHEN t.ids <> c.ids THEN 'outcome_set_changed' WHEN c.newest < t.newest THEN 'close_before_take' WHEN ns.n <> 2 THEN 'not_devigable' END AS reason,
    CASE WHEN t.s >= 1 - 1e-9 AND c.s >= 1 - 1e-9 THEN 1 / ts.odds - (t.s - 1) / 2 ELSE 1 / ts.odds / t.s END AS qt, CASE WHEN t.s >= 1 - 1e-9 AND c.s >= 1 - 1e-9 THEN 1 / cs.odds - (c.s - 1) / 2 ELSE 1 / cs.odds / c.s END AS qc, ts.line IS DISTINCT FROM cs.line AS line_moved,
    CASE WHEN t.s >= 1 - 1e-9 AND c.s >= 1 - 1e-9 THEN 'shin' ELSE 'multiplicative' END AS method
    FROM (SELECT legs.*, user_id FROM legs JOIN tickets USING (wager_id)) l JOIN games USING (event_id) JOIN ns ON ns.market_id = l.market_id LEFT JOIN sides t ON t.leg_id = l.leg_id AND t.side = 'taken' LEFT JOIN sides c ON c.leg_id = l.leg_id AND c.side = 'closing'
    LEFT JOIN snaps ts ON ts.leg_id = l.leg_id AND ts.side = 'taken' AND ts.selection_id = l.selection_id LEFT JOIN snaps cs ON cs.leg_id = l.leg_id AND cs.side = 'closing' AND cs.selection_id = l.selection_id)"""
CLV_COLUMNS = "round(qt, 7) AS taken_fair, round(qc, 7) AS closing_fair, round(qc - qt, 7) AS probability_clv, round(abs(qc - qt), 7) AS magnitude, line_moved"


def _measured(v: Views, legs: DataFrame | None = None, *more: str) -> DataFrame:
    return clv.measure(_legs(v) if legs is None else legs, v.quotes, v.suspensions, None, BACK, full=True, more=more)


def _clv_row(df: DataFrame) -> DataFrame:
    return df.select("leg_id", *[r(c, 7).alias(c) for c in ("taken_fair", "closing_fair", "probability_clv")], r(F.abs("probability_clv"), 7).alias("magnitude"), "line_moved")


def _snapshots(v: Views) -> DataFrame:
    side = F.explode(F.array(F.struct(F.lit("taken").alias("side"), F.col("taken_at").alias("as_of")), F.struct(F.lit("closing").alias("side"), F.col("close_at").alias("as_of"))))
    asks = _legs(v).select("leg_id", "market_id", "book_id", side.alias("s")).select("leg_id", "market_id", "book_id", "s.*").filter("as_of IS NOT NULL")
    return clv.snapshot_as_of(asks, v.quotes, v.suspensions, BACK)


@query("c2_clv_snapshots", FULL + " SELECT leg_id, side, n, ids, epoch_us(newest) AS newest_us FROM sides")
def c2(v: Views) -> DataFrame:
    own = _snapshots(v).groupBy("leg_id", "side").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("selection_id")).alias("i"), us(F.max("observed_at")).alias("newest_us"))
    return own.select("leg_id", "side", "n", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("ids"), "newest_us")


@query("c3_clv_complete_coherent", FULL + " SELECT coalesce(reason, 'measured') AS reason, count(*) AS n, count(*) FILTER (WHERE coalesce(reason, '') NOT LIKE 'taken%' AND coalesce(reason, '') <> 'no_close') AS taken_fine FROM m GROUP BY ALL")
def c3(v: Views) -> DataFrame:
    reason = F.coalesce("reason", F.lit("measured"))
    fine = ~F.startswith(reason, F.lit("taken")) & (reason != "no_close")
    return _measured(v).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_if(fine).alias("taken_fine"))


@query("c4_clv_devig_both", FULL + " SELECT leg_id, method, round(qt, 7) AS taken_fair, round(qc, 7) AS closing_fair FROM m WHERE reason IS NULL")
def c4(v: Views) -> DataFrame:
    return _measured(v).filter("reason IS NULL").select("leg_id", "method", r("taken_fair", 7).alias("taken_fair"), r("closing_fair", 7).alias("closing_fair"))


@query("c5_clv_measure_all", FULL + f" SELECT leg_id, {CLV_COLUMNS} FROM m WHERE reason IS NULL")
def c5_all(v: Views) -> DataFrame:
    return _clv_row(_measured(v).filter("reason IS NULL"))


@query("c6_clv_reasons_all", FULL + " SELECT leg_id, coalesce(reason, 'measured') AS reason FROM m")
def c6_all(v: Views) -> DataFrame:
    return _measured(v).select("leg_id", F.coalesce("reason", F.lit("measured")).alias("reason"))


@query("c7_clv_pass", FULL + f" SELECT leg_id, {CLV_COLUMNS} FROM m WHERE reason IS NULL")
def c7(v: Views) -> DataFrame:
    """Two passes: legs taken in the first half are measured and kept, a later pass takes up what has no row yet."""
    held = sinks.stored(_clv_row(_measured(v, _legs(v).filter(F.col("taken_at") < _half())).filter("reason IS NULL")), "clv")
    left = _legs(v).join(held.select("leg_id"), "leg_id", "left_anti")
    new = _clv_row(_measured(v, left).filter("reason IS NULL")).withColumn("seq", F.lit(1))
    return sinks.upsert(held, new, ["leg_id"], "seq")


@query("a7_clv_aggregate_compensated", FULL + " SELECT user_id, count(*) AS counted, round(avg(qc - qt), 9) AS mean_probability_clv, round(avg((qc / qt - 1) * 100), 7) AS mean_percent_clv FROM m WHERE reason IS NULL AND NOT line_moved GROUP BY user_id")
def a7(v: Views) -> DataFrame:
    own = _measured(v, None, "wager_id").filter("reason IS NULL").join(v.tickets.select("wager_id", "user_id"), "wager_id")
    return clv.compensated_means(own, "user_id").select("user_id", "counted", r("mean_probability_clv", 9).alias("mean_probability_clv"), r("mean_percent_clv", 7).alias("mean_percent_clv"))


@query("a13_staleness_quantiles_all", """, anchors AS (SELECT market_id, max(observed_at) AS anchor FROM quotes GROUP BY market_id), ages AS (SELECT book_id, (epoch_us(anchor) - epoch_us(observed_at)) // 86400000000 AS days FROM quotes JOIN anchors USING (market_id))
SELECT book_id, count(*) AS n, quantile_disc(days, 0.5) AS p50_days, quantile_disc(days, 0.99) AS p99_days, round(avg(CASE WHEN days < 120 THEN 1.0 ELSE 0.0 END), 8) AS fresh_share, count(*) FILTER (WHERE days < 0) AS negative FROM ages GROUP BY book_id""")  # fmt: skip
def a13_all(v: Views) -> DataFrame:
    """Quantiles from a histogram of whole days: a row for each book and day, however many quotes there are."""
    anchor = v.quotes.groupBy("market_id").agg(F.max("observed_at").alias("anchor"))
    days = F.floor((us("anchor") - us("observed_at")) / 86_400_000_000)
    per = v.quotes.join(anchor, "market_id").groupBy("book_id", days.alias("days")).agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("book_id").orderBy("days"))
    per = per.withColumns({"c": up_to, "t": F.sum("n").over(Window.partitionBy("book_id"))})
    at = lambda q: F.min(F.when(F.col("c") >= F.ceil(F.col("t") * q), F.col("days")))
    share = F.sum(F.when(F.col("days") < 120, F.col("n")).otherwise(0)) / F.sum("n")
    return per.groupBy("book_id").agg(F.sum("n").alias("n"), at(0.5).alias("p50_days"), at(0.99).alias("p99_days"), r(share, 8).alias("fresh_share"), F.sum(F.when(F.col("days") < 0, F.col("n")).otherwise(0)).alias("negative"))


# ---- steam --------------------------------------------------------------------------------------------------------


@query("w2_first_last_delta", STEAM + " SELECT DISTINCT epoch_us(ws) AS start_us, selection_id, book_id, round(p1 - p0, 9) AS delta, n FROM pts")
def w2(v: Views) -> DataFrame:
    return steam.first_last(steam.window_points(v.ticks, "18 hours", "6 hours")).select(us("w.start").alias("start_us"), "selection_id", "book_id", r("delta", 9).alias("delta"), "n")


@query("w3_argmax_step", STEAM + """, steps AS (SELECT * FROM pts WHERE before IS NOT NULL)
SELECT epoch_us(ws) AS start_us, selection_id, book_id, arg_min(epoch_us(observed_at), (before - implied, observed_at)) AS up_us, arg_min(epoch_us(observed_at), (implied - before, observed_at)) AS down_us FROM steps GROUP BY ALL""")  # fmt: skip
def w3(v: Views) -> DataFrame:
    return steam.largest_steps(steam.window_points(v.ticks, "18 hours", "6 hours")).select(us("w.start").alias("start_us"), "selection_id", "book_id", "up_us", "down_us")


@query("t5_steam_correlation", CAND + " SELECT epoch_us(ws) AS start_us, selection_id, lead_book_id, round(corr, 9) AS correlation, books FROM cand")
def t5(v: Views) -> DataFrame:
    return steam.votes(_moves(v)).select(us("window_start").alias("start_us"), "selection_id", "lead_book_id", r("correlation", 9).alias("correlation"), F.col("participating_books").alias("books"))


@query("t7_steam_cooldown_rows", CAND + """, ordered AS (SELECT selection_id, direction, epoch(ws) AS e, row_number() OVER (PARTITION BY selection_id, direction ORDER BY ws) AS k FROM found),
fold AS (SELECT selection_id, direction, k, e, e AS last, TRUE AS kept FROM ordered WHERE k = 1 UNION ALL SELECT o.selection_id, o.direction, o.k, o.e, CASE WHEN o.e - f.last >= 86400 THEN o.e ELSE f.last END, o.e - f.last >= 86400 FROM fold f JOIN ordered o ON o.selection_id = f.selection_id AND o.direction = f.direction AND o.k = f.k + 1)
SELECT selection_id, direction, CAST(e AS BIGINT) AS start_s FROM fold WHERE kept""")  # fmt: skip
def t7_rows(v: Views) -> DataFrame:
    return steam.with_cooldown(_found(v), 86400.0).select("selection_id", "direction", F.unix_seconds("window_start").alias("start_s"))


HOUR = 3600
#: Ticks in three parts by id, which arrive one after the other, so that many come late.
PARTS_SQL = f""", parts AS (SELECT *, epoch_us(observed_at) AS t, tick_id % 3 AS part FROM ticks WHERE implied > 0 AND implied < 1),
tops AS (SELECT selection_id, part, max(max(t)) OVER (PARTITION BY selection_id ORDER BY part) - {6 * HOUR}::BIGINT * 1000000 AS mark FROM parts GROUP BY selection_id, part),
lasts AS (SELECT *, ((mark - {18 * HOUR}::BIGINT * 1000000) // {6 * HOUR * 1_000_000}) * {6 * HOUR * 1_000_000} + {18 * HOUR}::BIGINT * 1000000 AS last FROM tops),
late AS (SELECT p.*, p.t < x.mark AS is_late FROM parts p LEFT JOIN tops x ON x.selection_id = p.selection_id AND x.part = p.part - 1)"""


def _steam_stream(v: Views, in_order: bool = False) -> DataFrame:
    own = v.ticks.select("selection_id", "book_id", "implied", "observed_at", "tick_id")
    if in_order:
        span = own.agg(us(F.min("observed_at")).alias("lo"), us(F.max("observed_at")).alias("hi")).first()
        own = own.withColumn("tick_id", F.least(F.floor((us("observed_at") - span.lo) * 3 / max(1, span.hi - span.lo)), F.lit(2)))
    build = lambda s: state.steam_stream(s, 18.0 * HOUR, 6.0 * HOUR, 6.0 * HOUR, 86400.0, 12.0 * HOUR, 32, 1_000_000)
    return state.replay([own.filter(f"tick_id % 3 = {k}") for k in range(3)], build, "steam")


def _counted(v: Views, kind: str, how=F.sum) -> DataFrame:
    return _steam_stream(v).filter(F.col("kind") == kind).groupBy("selection_id").agg(how("n").alias("n"))


@query("r4_steam_stream")
def r4(v: Views) -> DataFrame:
    """Ticks as they came, in three parts."""
    return _steam_stream(v, True).filter("kind = 'finding'").select("selection_id", "window_start_us", "window_end_us", "lead_book_id", r("lead_delta", 9).alias("lead_delta"), "followers", r("correlation", 9).alias("correlation"), "books")


@query("r8_late_data_counter", PARTS_SQL + " SELECT selection_id, CAST(count(*) FILTER (WHERE is_late) AS BIGINT) AS n FROM late GROUP BY selection_id")
def r8(v: Views) -> DataFrame:
    return _counted(v, "late")


@query("t8_per_market_watermark", PARTS_SQL + " SELECT selection_id, max(mark) AS n FROM tops GROUP BY selection_id")
def t8(v: Views) -> DataFrame:
    return _counted(v, "watermark", F.max)


@query("t9_bounded_advance", PARTS_SQL + f""", due AS (SELECT selection_id, (last - lag(last, 1, last - {6 * HOUR * 1_000_000}) OVER (PARTITION BY selection_id ORDER BY part)) // {6 * HOUR * 1_000_000} AS due FROM lasts)
SELECT selection_id, CAST(sum(greatest(due - 32, 0)) AS BIGINT) AS n FROM due GROUP BY selection_id""")  # fmt: skip
def t9(v: Views) -> DataFrame:
    return _counted(v, "skipped")


@query("t10_state_prune", PARTS_SQL + f""", ends AS (SELECT selection_id, max(last) - {12 * HOUR}::BIGINT * 1000000 AS oldest FROM lasts GROUP BY selection_id)
SELECT selection_id, count(DISTINCT (book_id, t)) AS n FROM late JOIN ends USING (selection_id) WHERE NOT coalesce(is_late, FALSE) AND t >= oldest GROUP BY selection_id""")  # fmt: skip
def t10(v: Views) -> DataFrame:
    return _steam_stream(v).filter("kind = 'held'").groupBy("selection_id").agg(F.max_by("n", "window_start_us").alias("n"))


# ---- other streams ------------------------------------------------------------------------------------------------


@query("r1_current_slate", ", e AS (SELECT market_id, arg_max(odds, (observed_at, odds)) AS odds, max(observed_at) AS newest_at FROM quotes WHERE book_id <> 3 GROUP BY market_id) SELECT market_id, odds, epoch_us(newest_at) AS at_us FROM e WHERE market_id % 10 <> 0")
def r1(v: Views) -> DataFrame:
    """Records by market, tombstones behind every tenth market's last one, records of book 3 under a false key."""
    own = v.quotes.select("market_id", F.when(F.col("book_id") == 3, -F.col("market_id")).otherwise(F.col("market_id")).alias("record_key"), "observed_at", F.col("odds").alias("payload"))
    gone = v.markets.filter("market_id % 10 = 0").select("market_id", F.col("market_id").alias("record_key"), F.lit("2030-01-01").cast("timestamp").alias("observed_at"), F.lit(None).cast("double").alias("payload"))
    late = F.col("observed_at") >= _half()
    slate = state.current_slate([own.filter(late).unionByName(gone), own.filter(~late)], "market_id", "observed_at")
    return slate.select("market_id", F.col("payload").alias("odds"), us("observed_at").alias("at_us"))


@query("r5_signals_stream")
def r5(v: Views) -> DataFrame:
    own = v.quotes
    detect = lambda q: pricing.best_quotes(q, WIDE).select("market_id", "selection_id", "book_id", "odds", us("observed_at").alias("at_us"))
    table, topic = state.signals_stream([own.filter(F.col("observed_at") < _half()), own.filter(F.col("observed_at") >= _half())], detect, ["market_id", "selection_id", "at_us"], pricing.newest)
    sent = topic.groupBy(F.col("key").cast("long").alias("market_id")).agg(F.count("*").alias("messages"))
    return table.groupBy("market_id").agg(F.count("*").alias("signals"), F.max("odds").alias("best_odds")).join(sent, "market_id")


@query("r6_settlement_stream", GRADE + " SELECT wager_id, status, returned_minor FROM settled")
def r6(v: Views) -> DataFrame:
    """Results in two parts, the second with the first's last ones again."""
    own = v.games.filter("status = 'final'")
    first, second = own.filter("event_id % 2 = 0"), own.filter("event_id % 2 = 1 OR event_id % 10 = 0")
    count = v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs"))
    draws = v.markets.filter("market_id % 5 = 0").select("market_id")
    return state.settlement_stream([first, second], lambda games: tickets.decide(v.tickets, tickets.grade(v.legs, games, draws), count)).select("wager_id", "status", "returned_minor")


@query("r7_ohlc_stream", """, b AS (SELECT selection_id, book_id, time_bucket(INTERVAL 1 DAY, observed_at) AS bucket, implied, observed_at FROM ticks),
top AS (SELECT max(observed_at) - INTERVAL 1 HOUR AS mark FROM ticks)
SELECT selection_id, book_id, epoch_us(bucket) AS bucket_us, arg_min(implied, (observed_at, implied)) AS open, max(implied) AS high, min(implied) AS low, arg_max(implied, (observed_at, implied)) AS close, count(*) AS samples FROM b, top WHERE bucket + INTERVAL 1 DAY <= mark GROUP BY ALL""")  # fmt: skip
def r7(v: Views) -> DataFrame:
    own = v.ticks.select("selection_id", "book_id", F.col("implied").alias("odds"), "observed_at")
    return state.replay([own], lambda s: histories.ohlc_stream(s, "1 day", "1 hour", "selection_id", "book_id"), "ohlc").withColumn("bucket_us", us("bucket")).drop("bucket")


# ---- parlays ------------------------------------------------------------------------------------------------------

#: Selections of one league and kind of market are taken to move together; the strength is a plain rule of both ids.
PAIRS_SQL = """, twos AS (SELECT a.wager_id, a.leg_id AS leg_a, b.leg_id AS leg_b, a.odds AS odds_a, b.odds AS odds_b,
    CASE WHEN a.selection_id <> b.selection_id AND a.league_id = b.league_id AND (a.selection_id + b.selection_id) % 2 = 0 THEN 0.15::DOUBLE + ((a.selection_id + b.selection_id) % 7)::DOUBLE * 0.05::DOUBLE ELSE 0.0::DOUBLE END AS rho
    FROM legs a JOIN legs b ON a.wager_id = b.wager_id AND a.leg_id < b.leg_id)"""


def _pairs(v: Views) -> DataFrame:
    """The pair table of the selections that tickets hold together."""
    a = v.legs.select("wager_id", "league_id", F.col("selection_id").alias("sa"))
    b = v.legs.select("wager_id", "league_id", F.col("selection_id").alias("sb"))
    own = a.join(b, ["wager_id", "league_id"]).filter("sa < sb AND (sa + sb) % 2 = 0").select(F.col("sa").alias("selection_a"), F.col("sb").alias("selection_b")).distinct()
    return own.withColumn("rho", F.lit(0.15) + ((F.col("selection_a") + F.col("selection_b")) % 7).cast("double") * F.lit(0.05))


@query("k4_correlation_from_pairs", PAIRS_SQL + " SELECT wager_id, leg_a, leg_b, rho FROM twos")
def k4(v: Views) -> DataFrame:
    return copula.correlation_pairs(v.legs, _pairs(v))


#: The normal quantile near its middle (fixed values of the usual rational form), and the distribution by Simpson's rule.
QUANTILE = """(({0} - 0.5) * (((((-3.969683028665376e+01 * ({0} - 0.5) ** 2 + 2.209460984245205e+02) * ({0} - 0.5) ** 2 - 2.759285104469687e+02) * ({0} - 0.5) ** 2 + 1.383577518672690e+02) * ({0} - 0.5) ** 2 - 3.066479806614716e+01) * ({0} - 0.5) ** 2 + 2.506628277459239e+00)
    / (((((-5.447609879822406e+01 * ({0} - 0.5) ** 2 + 1.615858368580409e+02) * ({0} - 0.5) ** 2 - 1.556989798598866e+02) * ({0} - 0.5) ** 2 + 6.680131188771972e+01) * ({0} - 0.5) ** 2 - 1.328068155288572e+01) * ({0} - 0.5) ** 2 + 1))"""
K3_SQL = PAIRS_SQL + f""", flat AS (SELECT wager_id, count(*) AS n_legs, product(1 / odds) AS independent FROM legs GROUP BY wager_id),
tied AS (SELECT wager_id, count(*) FILTER (WHERE rho <> 0) AS n FROM twos GROUP BY wager_id),
two AS (SELECT wager_id, 1 / odds_a AS pa, 1 / odds_b AS pb, asin(rho) AS top, {QUANTILE.format('(1 / odds_a)')} AS h, {QUANTILE.format('(1 / odds_b)')} AS k FROM twos JOIN flat USING (wager_id) WHERE n_legs = 2 AND rho <> 0),
nodes AS (SELECT i, i / 200.0::DOUBLE AS u, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(201) x(i)),
bi AS (SELECT wager_id, any_value(pa * pb) + sum(weight * exp(-(h * h + k * k - 2 * h * k * sin(top * u)) / (2 * cos(top * u) ** 2))) * any_value(top) / 600 / (2 * pi()) AS joint FROM two, nodes GROUP BY wager_id),
priced AS (SELECT f.wager_id, n_legs, independent, coalesce(bi.joint, independent) AS joint FROM flat f LEFT JOIN tied USING (wager_id) LEFT JOIN bi USING (wager_id) WHERE coalesce(tied.n, 0) = 0 OR n_legs = 2)"""


@query("k3_correlated_parlay", K3_SQL + " SELECT wager_id, n_legs, round(independent, 9) AS independent, round(joint, 7) AS joint, round(1 - independent / joint, 6) AS haircut FROM priced")
def k3(v: Views) -> DataFrame:
    """The tickets whose price has a closed form: at most two legs, or none that are correlated."""
    pairs = _pairs(v)
    tied = copula.correlation_pairs(v.legs, pairs).filter("rho <> 0").select("wager_id")
    big = v.legs.groupBy("wager_id").agg(F.count("*").alias("n")).filter("n > 2").select("wager_id").join(tied, "wager_id", "left_semi")
    own = copula.correlated_parlays(v.legs.join(big, "wager_id", "left_anti"), pairs)
    return own.select("wager_id", F.col("n_legs").cast("long").alias("n_legs"), r("independent", 9).alias("independent"), r("joint", 7).alias("joint"), r("haircut").alias("haircut"))


@query("k3_correlated_parlay_all")
def k3_all(v: Views) -> DataFrame:
    return copula.correlated_parlays(v.legs, _pairs(v)).select("wager_id", "n_legs", r("independent", 9).alias("independent"), r("joint", 5).alias("joint"), "exact", "reason")


@query("k6_teaser_price", """, t AS (SELECT wager_id, leg_id, 6.0 + market_id % 5 * 7 AS points, odds, CASE WHEN market_id % 11 = 0 THEN odds + 0.1 ELSE 1 + (odds - 1) * 0.6::DOUBLE END AS teased FROM legs WHERE market_type <> 'moneyline'),
b AS (SELECT wager_id, leg_id, teased, CASE WHEN points > 30 THEN 'teaser_points' WHEN teased > odds THEN 'teaser_not_favourable' END AS bad FROM t)
SELECT wager_id, arg_min(bad, leg_id) FILTER (WHERE bad IS NOT NULL) AS reason, CASE WHEN count(bad) = 0 THEN count(*) END AS n_legs, CASE WHEN count(bad) = 0 THEN round(product(1 / teased), 9) END AS joint FROM b GROUP BY wager_id""")  # fmt: skip
def k6(v: Views) -> DataFrame:
    legs = v.legs.filter("market_type <> 'moneyline'").withColumns({"points": 6.0 + F.col("market_id") % 5 * 7, "teased_odds": F.when(F.col("market_id") % 11 == 0, F.col("odds") + 0.1).otherwise(1 + (F.col("odds") - 1) * F.lit(0.6))})
    none = _pairs(v).filter("false")
    return copula.teasers(legs, none).select("wager_id", "reason", F.col("n_legs").cast("long").alias("n_legs"), r("joint", 9).alias("joint"))


@query("k5_round_robin_sizes", """, n AS (SELECT wager_id, count(*) AS n FROM legs GROUP BY wager_id), own AS (SELECT l.wager_id, leg_id, odds FROM legs l JOIN n USING (wager_id) WHERE n BETWEEN 3 AND 5)
SELECT a.wager_id, 2 AS size, a.leg_id::VARCHAR || ',' || b.leg_id::VARCHAR AS legs, round(a.odds * b.odds, 6) AS decimal, NULL::VARCHAR AS reason FROM own a JOIN own b ON b.wager_id = a.wager_id AND b.leg_id > a.leg_id
UNION ALL SELECT a.wager_id, 3, a.leg_id::VARCHAR || ',' || b.leg_id::VARCHAR || ',' || c.leg_id::VARCHAR, round(a.odds * b.odds * c.odds, 6), NULL FROM own a JOIN own b ON b.wager_id = a.wager_id AND b.leg_id > a.leg_id JOIN own c ON c.wager_id = a.wager_id AND c.leg_id > b.leg_id
UNION ALL SELECT wager_id, NULL, NULL, NULL, CASE WHEN n > 5 THEN 'too_many_legs' ELSE 'too_few_legs' END FROM n WHERE n NOT BETWEEN 3 AND 5""")  # fmt: skip
def k5_sizes(v: Views) -> DataFrame:
    return tickets.round_robin_sizes(v.legs, [2, 3], most_legs=5).withColumn("decimal", r("decimal"))


@query("k8_decide_ticket_rows", GRADE + " SELECT wager_id, status, returned_minor, returned_minor - stake_minor AS net_return_minor FROM settled")
def k8_rows(v: Views) -> DataFrame:
    return _decided(v).select("wager_id", "status", "returned_minor", "net_return_minor")


@query("k8_decide_teasers", GRADE + " SELECT wager_id, CASE WHEN wager_id % 2 = 0 AND status = 'won' AND push > 0 THEN 'void' ELSE status END AS status, CASE WHEN wager_id % 2 = 0 AND status = 'won' AND push > 0 THEN stake_minor ELSE returned_minor END AS returned_minor FROM settled")
def k8_teasers(v: Views) -> DataFrame:
    """Every second ticket as a teaser."""
    own = v.tickets.withColumn("kind", F.when(F.col("wager_id") % 2 == 0, "teaser").otherwise("parlay"))
    return tickets.decide(own, _graded(v), v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs"))).select("wager_id", "status", "returned_minor")


@query("k10_settle_batch_rows", GRADE + " SELECT wager_id, status, returned_minor FROM settled WHERE wager_id % 4 <> 1")
def k10_rows(v: Views) -> DataFrame:
    """Tickets settled before (every fourth) stay out, as an anti-join on settled ids; repeated ones count once."""
    done = v.tickets.filter("wager_id % 4 = 1").select("wager_id")
    return _decided(v).join(done.union(done), "wager_id", "left_anti").select("wager_id", "status", "returned_minor")


# ---- reads --------------------------------------------------------------------------------------------------------


@query("w9_price_history", f"SELECT selection_id, book_id, odds, epoch_us(observed_at) AS observed_us FROM quotes WHERE selection_id IN (20, 21, 22, 23) AND observed_at >= {HALF} ORDER BY observed_at DESC, selection_id, book_id LIMIT 500")
def w9_prices(v: Views) -> DataFrame:
    own = v.quotes.filter(F.col("selection_id").isin(20, 21, 22, 23) & (F.col("observed_at") >= _half()))
    return own.orderBy(F.desc("observed_at"), "selection_id", "book_id").limit(500).select("selection_id", "book_id", "odds", us("observed_at").alias("observed_us"))


@query("w9_ev_history", ASSESS_ALL_SQL + " SELECT selection_id, book_id, round(ev, 7) AS ev FROM gated WHERE outcome = 'signal' AND ev > 0.01 ORDER BY observed_at DESC, selection_id DESC, book_id DESC LIMIT 200")
def w9_ev(v: Views) -> DataFrame:
    own = _gated(v, True).filter("outcome = 'signal' AND ev > 0.01")
    return own.orderBy(F.desc("observed_at"), F.desc("selection_id"), F.desc("book_id")).limit(200).select("selection_id", "book_id", r("ev", 7).alias("ev"))


@query("w9_user_clv_page", FULL + " SELECT leg_id, round(qc - qt, 7) AS probability_clv FROM m WHERE reason IS NULL AND user_id % 10 = 3 AND leg_id < 20000000 ORDER BY taken_at DESC, leg_id DESC LIMIT 100")
def w9_clv(v: Views) -> DataFrame:
    mine = v.tickets.filter("user_id % 10 = 3").select("wager_id")
    legs = _legs(v).filter("leg_id < 20000000").join(mine, "wager_id", "left_semi")
    own = _measured(v, legs).filter("reason IS NULL").join(legs.select("leg_id", "taken_at"), "leg_id")
    return reads.page_after(own, [("taken_at", True), ("leg_id", True)], [F.lit("9999-01-01").cast("timestamp"), 0], 100).select("leg_id", r("probability_clv", 7).alias("probability_clv"))


@query("w11_tickets_in_round_robin", "SELECT user_id, count(*) AS tickets, string_agg(wager_id::VARCHAR, ',' ORDER BY placed_at, wager_id) AS wagers FROM tickets GROUP BY user_id")
def w11_robins(v: Views) -> DataFrame:
    """A user's tickets stand for those of one round robin, listed as they were placed."""
    own = v.tickets.groupBy("user_id").agg(F.count("*").alias("tickets"), F.array_sort(F.collect_list(F.struct("placed_at", "wager_id"))).alias("w"))
    return own.select("user_id", "tickets", F.array_join(F.transform("w", lambda x: x["wager_id"].cast("string")), ",").alias("wagers"))


