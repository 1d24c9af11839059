"""Registered queries, fifth part: rules in full where earlier queries had a part of them, with cases planted so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.operators import changes, pricing, reads, tickets
from tickline.plans.catalog import ARB_SQL, ASSESS_SQL, SNAP_SQL, _arbs, _gated, query, r, us
from tickline.plans.model import Views
from tickline.sources import raw

# ---- identities, table upkeep, pages ------------------------------------------------------------------------------

_H = "'h' || substr(sha256({0}), 1, 12)"
_TOKEN = "CASE WHEN regexp_full_match({0}, '[A-Za-z0-9_-]{{1,{1}}}') THEN {0} ELSE " + _H + " END"


@query("s3_identities", f""", own AS (SELECT market_id, role, CASE WHEN market_id % 3 = 0 THEN replace(lower(league_id), '#', '_') ELSE league_id END AS league_key, CASE market_id % 5 WHEN 0 THEN name ELSE 'e' || event_id END AS event_key,
    CASE market_id % 4 WHEN 0 THEN 'player_points' WHEN 1 THEN 'outrights' WHEN 2 THEN market_type || '_with_a_key_of_far_too_many_bytes' ELSE market_type END AS market_key, CASE WHEN market_id % 4 = 0 THEN split_part(name, ' ', 1) END AS subject, CASE WHEN market_id % 4 = 1 THEN split_part(name, ' ', 2) END AS runner
    FROM (SELECT DISTINCT l.market_id, l.role, l.league_id, l.event_id, l.market_type, m.name FROM latest l JOIN markets m USING (market_id))),
ids AS (SELECT *, CASE WHEN market_id % 4 = 1 THEN 'outright' ELSE role END AS kind, 'tx.e.' || {_TOKEN.format('event_key', 35)} AS event_id FROM own),
m AS (SELECT *, event_id || '.m.' || {_TOKEN.format('market_key', 28)} || coalesce('.' || {_H.format('subject')}, '') AS market FROM ids)
SELECT DISTINCT market_id, 'tx.s.' || regexp_extract(league_key, '^([^_]+)', 1) AS sport_raw, 'tx.l.' || {_TOKEN.format('league_key', 40)} AS league_id, market AS market_key, market || '.x.' || kind || CASE WHEN kind = 'outright' THEN '.' || {_H.format('runner')} ELSE '' END AS selection_key,
    trim(regexp_replace(lower(league_key), '[^a-z0-9_]+', '-', 'g'), '-_') AS slug FROM m""")  # fmt: skip
def s3_identities(v: Views) -> DataFrame:
    """A quarter of the markets become props of a player, a quarter outrights; names, long keys and leagues with an underscore are among the keys."""
    own = v.latest.select("market_id", "role", "league_id", "event_id", "market_type").distinct().join(v.markets.select("market_id", "name"), "market_id")
    k = F.col("market_id")
    word = lambda i: F.split("name", " ")[i]
    own = own.select(
        "market_id", F.lit(None).cast("string").alias("sport_key"), F.when(k % 3 == 0, F.replace(F.lower("league_id"), F.lit("#"), F.lit("_"))).otherwise(F.col("league_id")).alias("league_key"), F.lit("b").alias("book_key"),
        F.when(k % 5 == 0, F.col("name")).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("event_key"),
        F.when(k % 4 == 0, "player_points").when(k % 4 == 1, "outrights").when(k % 4 == 2, F.concat("market_type", F.lit("_with_a_key_of_far_too_many_bytes"))).otherwise(F.col("market_type")).alias("market_key"),
        F.when(k % 4 == 1, "outright").otherwise(F.col("role")).alias("role"), F.when(k % 4 == 0, word(0)).alias("subject"), F.when(k % 4 == 1, word(1)).alias("name"),
    )
    own = own.withColumnRenamed("market_id", "number")
    got = raw.identities(own, "tx")
    return got.select(F.col("number").alias("market_id"), F.concat(F.lit("tx.s."), "sport_key").alias("sport_raw"), "league_id", F.col("market_id").alias("market_key"), F.col("selection_id").alias("selection_key"), F.col("league_slug").alias("slug")).distinct()


@query("s8_results_guarded", """, old AS (SELECT *, TIMESTAMP '1997-01-01' AS observed_at, CASE WHEN status = 'live' THEN 3 END AS clock_period FROM games),
new AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'live' WHEN event_id % 6 = 0 THEN 'cancelled' ELSE 'final' END AS status, home_score + 1 AS home_score, away_score, CASE WHEN event_id % 3 = 1 THEN TIMESTAMP '1996-01-01' ELSE TIMESTAMP '1998-01-01' END AS observed_at FROM games WHERE event_id % 9 <> 8),
taken AS (SELECT o.event_id, n.status IN ('final', 'cancelled') AND o.status NOT IN ('final', 'cancelled') AND o.observed_at <= n.observed_at AS take FROM old o JOIN new n USING (event_id))
SELECT o.event_id, CASE WHEN take THEN n.status ELSE o.status END AS status, CASE WHEN take THEN n.home_score ELSE o.home_score END AS home_score, epoch_us(CASE WHEN take THEN n.observed_at ELSE o.observed_at END) AS observed_us, CASE WHEN coalesce(take, FALSE) THEN NULL ELSE clock_period END AS clock_period
FROM old o LEFT JOIN new n USING (event_id) LEFT JOIN taken USING (event_id)""")  # fmt: skip
def s8_guarded(v: Views) -> DataFrame:
    """Results that are older than the event's row, not terminal, of events already over, of unknown events, and given twice."""
    day = lambda d: F.lit(d).cast("timestamp")
    e = F.col("event_id")
    old = v.games.withColumns({"observed_at": day("1997-01-01"), "clock_period": F.when(F.col("status") == "live", 3)})
    status = F.when(e % 4 == 3, "live").when(e % 6 == 0, "cancelled").otherwise("final")
    new = v.games.filter(e % 9 != 8).select("event_id", status.alias("status"), (F.col("home_score") + 1).alias("home_score"), "away_score", F.when(e % 3 == 1, day("1996-01-01")).otherwise(day("1998-01-01")).alias("observed_at"))
    again = new.withColumn("observed_at", F.col("observed_at") - F.expr("INTERVAL 1 DAY")).withColumn("home_score", F.lit(0))
    unknown = new.withColumn("event_id", -1 - e)
    return reads.apply_results_guarded(old, new.unionByName(again).unionByName(unknown)).select("event_id", "status", "home_score", us("observed_at").alias("observed_us"), "clock_period")


@query("s7_upsert_distinct", """, old AS (SELECT * FROM latest WHERE book_id <> 4), new AS (SELECT selection_id, book_id, CASE WHEN selection_id % 3 = 0 THEN odds + 1 ELSE odds END AS odds, line, CASE WHEN selection_id % 5 = 0 THEN observed_at - INTERVAL 1 DAY ELSE observed_at + INTERVAL 1 DAY END AS observed_at FROM latest WHERE book_id >= 2)
SELECT selection_id, book_id, CASE WHEN o.odds IS NULL OR (n.observed_at >= o.observed_at AND n.odds <> o.odds) THEN n.odds ELSE o.odds END AS odds, epoch_us(CASE WHEN o.odds IS NULL OR (n.observed_at >= o.observed_at AND n.odds <> o.odds) THEN n.observed_at ELSE o.observed_at END) AS observed_us,
    CASE WHEN o.odds IS NULL THEN 'inserted' WHEN n.observed_at >= o.observed_at AND n.odds <> o.odds THEN 'updated' END AS change FROM old o FULL JOIN new n USING (selection_id, book_id)""")  # fmt: skip
def s7_distinct(v: Views) -> DataFrame:
    cols = ["selection_id", "book_id", "odds", "line", "observed_at"]
    old = v.latest.filter("book_id <> 4").select(cols)
    day = F.expr("INTERVAL 1 DAY")
    new = v.latest.filter("book_id >= 2").select(cols).withColumns({"odds": F.when(F.col("selection_id") % 3 == 0, F.col("odds") + 1).otherwise(F.col("odds")), "observed_at": F.when(F.col("selection_id") % 5 == 0, F.col("observed_at") - day).otherwise(F.col("observed_at") + day)})
    return reads.upsert_distinct(old, new, ["selection_id", "book_id"], "observed_at").select("selection_id", "book_id", "odds", us("observed_at").alias("observed_us"), "change")


@query("w8_bound_pages", "SELECT event_id, epoch_us(scheduled_start) AS start_us, CAST((row_number() OVER (ORDER BY scheduled_start DESC, event_id) - 1) // 12 AS INTEGER) AS page FROM games WHERE status IN ('final', 'live') QUALIFY page < 3")
def w8_pages(v: Views) -> DataFrame:
    """Three pages, each from the cursor of the one before."""
    filters, order = {"status": ["final", "live"]}, [("scheduled_start", True), ("event_id", False)]
    cursor, out = None, None
    for i in range(3):
        page = reads.bound_page(v.games, filters, order, cursor, 12)
        last = page.orderBy("scheduled_start", F.desc("event_id")).first()
        cursor = cursor if last is None else reads.cursor_of(last, filters, order)
        page = page.select("event_id", us("scheduled_start").alias("start_us"), F.lit(i).alias("page"))
        out = page if out is None else out.unionByName(page)
    return out


# ---- pricing ------------------------------------------------------------------------------------------------------


@query("w5_capped", ASSESS_SQL + " SELECT market_id, selection_id, book_id, round(round(ev, 9), 8) AS ev FROM gated WHERE outcome = 'signal' QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY round(ev, 9) DESC, observed_at DESC, selection_id DESC, book_id DESC) <= 2")
def w5_capped(v: Views) -> DataFrame:
    """The two strongest signals of each market."""
    found = _gated(v).filter("outcome = 'signal'").withColumn("ev", r("ev", 9))
    return pricing.capped(found, 2).select("market_id", "selection_id", "book_id", r("ev", 8).alias("ev"))


@query("w5_rank_league", ASSESS_SQL + " SELECT league_id, selection_id, book_id, round(round(ev, 9), 8) AS ev, CAST(row_number() OVER (PARTITION BY league_id ORDER BY round(ev, 9) DESC, observed_at DESC, selection_id DESC, book_id DESC) AS INTEGER) AS rank FROM gated WHERE outcome = 'signal' QUALIFY rank <= 5")
def w5_league(v: Views) -> DataFrame:
    """The five strongest signals of each league."""
    order = Window.partitionBy("league_id").orderBy(F.desc("ev"), F.desc("observed_at"), F.desc("selection_id"), F.desc("book_id"))
    found = _gated(v).filter("outcome = 'signal'").withColumn("ev", r("ev", 9)).withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    return found.select("league_id", "selection_id", "book_id", r("ev", 8).alias("ev"), "rank")


@query("a11_vig_uniform", SNAP_SQL + """, per AS (SELECT l.market_id, l.book_id, l.selection_id, 1 / odds AS q, implied AS s, n_quoted AS n FROM latest l JOIN books b USING (market_id, book_id)),
bad AS (SELECT market_id, book_id FROM per GROUP BY ALL HAVING min(q - (s - 1) / n) <= 0)
SELECT p.market_id, p.book_id, p.selection_id, CASE WHEN b.book_id IS NULL THEN round(q - (s - 1) / n, 8) END AS fair, CASE WHEN b.book_id IS NULL THEN round((s - 1) / n, 8) + 0.0 END AS excess, CASE WHEN b.book_id IS NULL THEN CASE WHEN abs(s - 1) <= 1e-12 THEN 0 ELSE round(1 / n::DOUBLE, 6) END END AS share,
    CASE WHEN b.book_id IS NULL THEN round((s - 1) / n / (q - (s - 1) / n), 8) + 0.0 END AS relative_margin, CASE WHEN b.book_id IS NOT NULL THEN 'undefined' END AS reason FROM per p LEFT JOIN bad b USING (market_id, book_id)""")  # fmt: skip
def a11_uniform(v: Views) -> DataFrame:
    own = pricing.vig_contributions(pricing.book_snapshots(v.latest), "uniform")
    return own.select("market_id", "book_id", "selection_id", r("fair", 8).alias("fair"), (r("excess", 8) + 0.0).alias("excess"), r("share").alias("share"), (r("relative_margin", 8) + 0.0).alias("relative_margin"), "reason")


@query("m15_least_total", ARB_SQL + " SELECT market_id, home_line, CAST(floor(n / ((1 - implied_sum) / implied_sum)) AS BIGINT) + 1 AS least_total FROM arbs")
def m15_least(v: Views) -> DataFrame:
    return pricing.arb_stakes(_arbs(v), 10_000).select("market_id", "home_line", "least_total")


# ---- slips and ledger ---------------------------------------------------------------------------------------------


@query("j15_price_moves", """, slips AS (SELECT leg_id, l.selection_id, l.book_id, CASE l.leg_id % 4 WHEN 0 THEN q.odds ELSE l.odds END AS seen_odds, CASE WHEN l.leg_id % 7 = 0 THEN NULL ELSE q.line END AS seen_line, l.leg_id % 2 = 0 AS accept_better, CASE l.leg_id % 6 WHEN 1 THEN q.odds WHEN 5 THEN q.odds + 0.5 END AS accept_odds, CASE WHEN l.leg_id % 6 = 1 THEN q.line END AS accept_line
    FROM legs l LEFT JOIN latest q USING (selection_id, book_id)),
moved AS (SELECT s.*, n.odds AS now, n.line AS line, CASE WHEN n.odds IS NULL THEN 'gone' WHEN seen_line IS DISTINCT FROM n.line THEN 'line_moved' WHEN abs(seen_odds - n.odds) / greatest(seen_odds, n.odds) <= 1e-9 THEN 'same' WHEN n.odds > seen_odds THEN 'improved' ELSE 'worse' END AS move
    FROM slips s LEFT JOIN (SELECT * FROM latest WHERE selection_id % 11 <> 0) n USING (selection_id, book_id))
SELECT leg_id, move, CASE WHEN move = 'gone' THEN FALSE WHEN move = 'same' THEN TRUE WHEN accept_odds IS NOT NULL THEN abs(accept_odds - now) / greatest(accept_odds, now) <= 1e-9 AND accept_line IS NOT DISTINCT FROM line ELSE accept_better AND move = 'improved' END AS passes FROM moved""")  # fmt: skip
def j15_moves(v: Views) -> DataFrame:
    """Legs as slips: some saw the price of now, some no line; some accept better prices, some confirm a move, not always the one there is. Quotes of every eleventh selection are gone."""
    q = v.latest.select("selection_id", "book_id", F.col("odds").alias("q"), F.col("line").alias("q_line"))
    k = F.col("leg_id")
    slips = v.legs.join(q, ["selection_id", "book_id"], "left").select(
        "leg_id", "selection_id", "book_id", F.when(k % 4 == 0, F.col("q")).otherwise(F.col("odds")).alias("seen_odds"), F.when(k % 7 != 0, F.col("q_line")).alias("seen_line"), (k % 2 == 0).alias("accept_better"),
        F.when(k % 6 == 1, F.col("q")).when(k % 6 == 5, F.col("q") + 0.5).alias("accept_odds"), F.when(k % 6 == 1, F.col("q_line")).alias("accept_line"),
    )
    return reads.price_moves(slips, v.latest.filter("selection_id % 11 <> 0")).select("leg_id", "move", "passes")


@query("k12_grants_and_adjustments", """, grants AS (SELECT wager_id, user_id, CASE WHEN wager_id % 9 = 0 THEN 0 ELSE stake_minor // 100 END AS amount FROM tickets),
adj AS (SELECT wager_id, user_id, CASE wager_id % 5 WHEN 0 THEN 'house' WHEN 1 THEN 'bank' ELSE 'cash' END AS source, CASE WHEN wager_id % 5 = 2 THEN 'cash' ELSE 'escrow' END AS target, CASE WHEN wager_id % 7 = 3 THEN -1 ELSE 250 END AS amount FROM tickets WHERE wager_id % 3 = 0),
why AS (SELECT *, CASE WHEN source = 'bank' THEN 'unknown_account' WHEN source = target THEN 'same_account' WHEN amount <= 0 THEN 'amount_not_positive' END AS reason FROM adj)
SELECT wager_id, 'grant' AS kind, account_kind, CAST(amount AS BIGINT) AS amount_minor, NULL AS reason FROM (SELECT wager_id, unnest(['issuance', 'cash']) AS account_kind, unnest([-amount, amount]) AS amount FROM grants WHERE amount > 0)
UNION ALL SELECT wager_id, 'grant', NULL, NULL, 'amount_not_positive' FROM grants WHERE amount <= 0
UNION ALL SELECT wager_id, 'adjustment', account_kind, CAST(amount AS BIGINT), NULL FROM (SELECT wager_id, unnest([source, target]) AS account_kind, unnest([-amount, amount]) AS amount FROM why WHERE reason IS NULL)
UNION ALL SELECT wager_id, 'adjustment', NULL, NULL, reason FROM why WHERE reason IS NOT NULL""")  # fmt: skip
def k12_more(v: Views) -> DataFrame:
    k = F.col("wager_id")
    grants = v.tickets.select("wager_id", "user_id", "placed_at", F.when(k % 9 == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("stake_minor") / 100).cast("long")).alias("amount_minor"))
    adj = v.tickets.filter(k % 3 == 0).select("wager_id", "user_id", "placed_at", F.when(k % 5 == 0, "house").when(k % 5 == 1, "bank").otherwise("cash").alias("source"), F.when(k % 5 == 2, "cash").otherwise("escrow").alias("target"), F.when(k % 7 == 3, -1).otherwise(250).cast("long").alias("amount_minor"))
    out = None
    for kind, (entries, refused) in (("grant", tickets.grant_entries(grants)), ("adjustment", tickets.adjustment_entries(adj))):
        none = lambda t: F.lit(None).cast(t)
        both = entries.select("wager_id", "kind", "account_kind", "amount_minor", none("string").alias("reason")).unionByName(refused.select("wager_id", F.lit(kind).alias("kind"), none("string").alias("account_kind"), none("long").alias("amount_minor"), "reason"))
        out = both if out is None else out.unionByName(both)
    return out


@query("k5_round_robin_rule", """, l AS (SELECT wager_id, list(leg_id ORDER BY leg_id) AS ids, list(odds ORDER BY leg_id) AS d, count(*) AS n FROM legs GROUP BY wager_id),
bits AS (SELECT wager_id, ids, d, n, unnest(range(1, CAST(1 << n AS BIGINT))) AS m FROM l WHERE n BETWEEN 3 AND 10)
SELECT wager_id, bit_count(m)::INTEGER AS size, array_to_string(list_transform(list_filter(range(n), lambda i: (m >> i) & 1 = 1), lambda i: ids[i + 1]::VARCHAR), ',') AS legs, NULL AS reason FROM bits WHERE bit_count(m) IN (2, 3)
UNION ALL SELECT wager_id, NULL, NULL, CASE WHEN n > 10 THEN 'too_many_legs' ELSE 'too_few_legs' END FROM l WHERE n NOT BETWEEN 3 AND 10""")  # fmt: skip
def k5_rule(v: Views) -> DataFrame:
    """Doubles and trebles of every ticket, within the rule's own ten legs."""
    return tickets.round_robin_sizes(v.legs, [2, 3]).select("wager_id", "size", "legs", "reason")


@query("t7_cooldown_hot_key", """, o AS (SELECT tick_id, epoch_us(observed_at) AS t, row_number() OVER (ORDER BY observed_at, tick_id) AS k FROM ticks),
fold AS (SELECT k, t, t AS last, TRUE AS kept FROM o WHERE k = 1 UNION ALL SELECT o.k, o.t, CASE WHEN o.t - f.last >= 7200000000 THEN o.t ELSE f.last END, o.t - f.last >= 7200000000 FROM fold f JOIN o ON o.k = f.k + 1)
SELECT t AS at_us FROM fold WHERE kept""")  # fmt: skip
def t7_hot(v: Views) -> DataFrame:
    """All ticks under one key that rests for two hours; the key is folded in segments of a quarter of 4,000 rows."""
    own = v.ticks.select(F.lit("all").alias("key"), us("observed_at").alias("at_us"))
    return changes.rested(own, ["key"], "at_us", 7200.0, most=4_000).filter("kept").select("at_us")
