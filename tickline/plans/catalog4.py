"""Registered queries, fourth part: streams with keyed state, exactly-once signals and settlement, atomic appends, scan gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickline.operators import pricing, tickets
from tickline.plans.catalog import AGE, ASSESS_SQL, FAIR_ALL_SQL, FAIR_SQL, MID_SQL, SNAP_SQL, WIDE, query, r, us
from tickline.plans.catalog2 import GRADE, HALF, _half
from tickline.plans.model import Views
from tickline.sources import sinks
from tickline.streaming import markets, settlement, signals

HOUR, DAY = 3600, 86_400


def _fed(v: Views, label: str, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Feed parts to a stream one after the other, as a source would; each run goes on from the checkpoint. Returns the stream's folder."""
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")
    before = {n: v.spark.conf.get(n, None) for n in names}
    root = sinks.shared_path(v.spark, label)
    markets.keyed_state(v.spark)
    try:
        for i, part in enumerate(parts):
            part.write.parquet(f"{root}/in/part={i}")
            stream = build(v.spark.readStream.schema(part.schema).parquet(f"{root}/in/part=*"))
            write(stream, root).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for n, value in before.items():
            v.spark.conf.set(n, value) if value is not None else v.spark.conf.unset(n)
    return root


def _append(stream: DataFrame, root: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append")


# ---- steam by market ----------------------------------------------------------------------------------------------

W, H, LATE, MOST = 5 * DAY, DAY, 12 * HOUR, 3
GAP, GONE = "2024-01-10", "2024-01-20 00:30:00"


def _market_records(v: Views) -> DataFrame:
    """Events as market records: twelve markets of five selections; every seventh event arrives 36 hours late, a third of the markets pauses for ten
    days, and one market is tombstoned. A record holds what arrives for a market within an hour."""
    value = F.col("value")
    own = v.table("events").select((F.col("user_id") % 12).alias("market_id"), "event_type", (F.floor(F.col("user_id") / 12) % 5).cast("int").alias("book_id"), (0.05 + 0.9 * (value - 100 * F.floor(value / 100)) / 100).alias("implied"), us(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    t = F.col("t") + F.when((F.col("market_id") % 3 == 0) & (F.col("t") >= us(F.lit(GAP).cast("timestamp"))), 10 * DAY * 1_000_000).otherwise(0)
    own = own.withColumn("t", t).withColumn("arrival", F.col("t") + F.when(F.col("event_id") % 7 == 0, 36 * HOUR * 1_000_000).otherwise(0))
    hour = F.timestamp_micros((F.floor(F.col("arrival") / (HOUR * 1_000_000)) + 1) * (HOUR * 1_000_000))
    own = own.select("market_id", hour.alias("anchor"), F.concat_ws(":", "market_id", "event_type").alias("selection_id"), "book_id", "implied", F.timestamp_micros("t").alias("observed_at"), F.lit(False).alias("gone"))
    nothing = [F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in ("selection_id", "book_id", "implied", "observed_at")]
    gone = own.filter("market_id = 5").select("market_id", F.lit(GONE).cast("timestamp").alias("anchor"), *nothing, F.lit(True).alias("gone")).distinct()
    return own.unionByName(gone)


def _market_windows(v: Views, samples: int, write: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    own = sinks.stored(_market_records(v), "market-records")
    day = lambda d: F.lit(d).cast("timestamp")
    parts = [own.filter(F.col("anchor") < day("2024-01-12")), own.filter((F.col("anchor") >= day("2024-01-12")) & (F.col("anchor") < day("2024-01-22"))), own.filter(F.col("anchor") >= day("2024-01-22"))]
    return _fed(v, "market-steam", parts, lambda s: markets.closed_windows(s, W, H, LATE, 30 * DAY, MOST, samples), write)


M = 1_000_000
RECORDS_SQL = f""", rec0 AS (SELECT user_id % 12 AS market_id, (user_id % 12)::VARCHAR || ':' || event_type AS selection_id, CAST(user_id // 12 % 5 AS INTEGER) AS book_id, 0.05 + 0.9 * (value - 100 * floor(value / 100)) / 100 AS implied, epoch_us(ts) + CASE WHEN user_id % 12 % 3 = 0 AND ts >= TIMESTAMP '{GAP}' THEN {10 * DAY * M} ELSE 0 END AS t, event_id FROM events),
rec1 AS (SELECT *, ((t + CASE WHEN event_id % 7 = 0 THEN {36 * HOUR * M} ELSE 0 END) // {HOUR * M} + 1) * {HOUR * M} AS anchor FROM rec0),
rec AS (SELECT *, CASE WHEN market_id = 5 AND anchor > epoch_us(TIMESTAMP '{GONE}') THEN 1 ELSE 0 END AS gen FROM rec1),
marks AS (SELECT market_id, gen, anchor, max(anchor) OVER x - {LATE * M} AS mark FROM (SELECT DISTINCT market_id, gen, anchor FROM rec) WINDOW x AS (PARTITION BY market_id, gen ORDER BY anchor)),
lasts AS (SELECT *, (mark - {W * M}) // {H * M} * {H * M} + {W * M} AS last FROM marks),
steps AS (SELECT *, lag(mark) OVER x AS before, coalesce((last - lag(last) OVER x) // {H * M}, 1) AS due FROM lasts WINDOW x AS (PARTITION BY market_id, gen ORDER BY anchor)),
seen AS (SELECT rec.*, before IS NOT NULL AND t < before AS is_late FROM rec JOIN steps USING (market_id, gen, anchor) WHERE implied > 0 AND implied < 1)"""


def _market_counts(v: Views, samples: int, *kinds: str) -> DataFrame:
    root = _market_windows(v, samples, _append)
    own = v.spark.read.schema(markets.CLOSED).parquet(f"{root}/out")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("n")), F.when(F.col("kind") == k, F.col("window_end_us")))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return own.groupBy("market_id").agg(*[(last(k) if k in ("held", "watermark") else total(k)).alias(k) for k in kinds])


@query("t8_market_watermark", RECORDS_SQL + """ SELECT market_id, max_by(mark, (gen, anchor)) AS watermark, any_value(late) AS late FROM steps JOIN (SELECT market_id, count(*) FILTER (WHERE is_late) AS late FROM seen GROUP BY market_id) USING (market_id) GROUP BY market_id""")
def t8_market(v: Views) -> DataFrame:
    return _market_counts(v, 1_000_000, "watermark", "late")


@query("t9_market_advance", RECORDS_SQL + f""" SELECT market_id, CAST(sum(least(due, {MOST})) AS BIGINT) AS windows, CAST(sum(greatest(due - {MOST}, 0)) AS BIGINT) AS skipped FROM steps GROUP BY market_id""")
def t9_market(v: Views) -> DataFrame:
    return _market_counts(v, 1_000_000, "windows", "skipped")


@query("t10_market_state", RECORDS_SQL + f""", ends AS (SELECT market_id, max(gen) AS gen, max_by(last, (gen, anchor)) AS last FROM lasts GROUP BY market_id),
kept AS (SELECT market_id, selection_id, book_id, least(count(DISTINCT t), 8) AS n FROM seen JOIN ends USING (market_id, gen) WHERE NOT is_late AND t >= last - {W * M} GROUP BY ALL)
SELECT market_id, CAST(sum(n) AS BIGINT) AS held, CAST(market_id = 5 AS BIGINT) AS forgotten FROM kept GROUP BY market_id""")  # fmt: skip
def t10_market(v: Views) -> DataFrame:
    """With a cap of eight points a selection and book, which the given points reach."""
    return _market_counts(v, 8, "held", "forgotten")


@query("r4_market_steam", RECORDS_SQL + f""", closed AS (SELECT market_id, gen, unnest(range(last - (least(due, {MOST}) - 1) * {H * M}, last + 1, {H * M})) AS e FROM steps WHERE due > 0),
once AS (SELECT market_id, gen, selection_id, book_id, t, arg_max(implied, (anchor, implied)) AS implied FROM seen WHERE NOT is_late GROUP BY ALL),
pts AS (SELECT e, once.*, lag(implied) OVER x AS prior, first_value(implied) OVER x AS p0, last_value(implied) OVER (PARTITION BY e, selection_id, book_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p1
    FROM closed JOIN once ON once.market_id = closed.market_id AND once.gen = closed.gen AND t >= e - {W * M} AND t < e WINDOW x AS (PARTITION BY e, selection_id, book_id ORDER BY t)),
moves AS (SELECT market_id, e, selection_id, book_id, p1 - p0 AS delta, t AS moved_us FROM pts WHERE prior IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e, selection_id, book_id ORDER BY (implied - prior) * sign(p1 - p0) DESC, t) = 1),
lead_ AS (SELECT * FROM moves WHERE abs(delta) >= 0.05 QUALIFY row_number() OVER (PARTITION BY e, selection_id ORDER BY moved_us, abs(delta) DESC, book_id) = 1),
cand AS (SELECT l.market_id, l.e, l.selection_id, l.book_id AS lead_book_id, l.delta, count(*) FILTER (WHERE m.book_id <> l.book_id AND abs(m.delta) >= 0.05 AND sign(m.delta) = sign(l.delta) AND m.moved_us - l.moved_us BETWEEN 0 AND {12 * HOUR * M}) AS followers,
    avg(CASE WHEN abs(m.delta) < 0.005 THEN 0.0 WHEN sign(m.delta) = sign(l.delta) THEN 1.0 ELSE -1.0 END) AS corr, count(*) AS books FROM lead_ l JOIN moves m USING (e, selection_id) GROUP BY ALL),
ordered AS (SELECT *, CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction, row_number() OVER (PARTITION BY selection_id, delta > 0 ORDER BY e) AS k FROM cand WHERE followers >= 1 AND corr >= 0.5),
fold AS (SELECT selection_id, direction, k, e AS last, TRUE AS kept FROM ordered WHERE k = 1 UNION ALL SELECT o.selection_id, o.direction, o.k, CASE WHEN o.e - f.last >= {2 * DAY * M} THEN o.e ELSE f.last END, o.e - f.last >= {2 * DAY * M} FROM fold f JOIN ordered o ON o.selection_id = f.selection_id AND o.direction = f.direction AND o.k = f.k + 1)
SELECT market_id, selection_id, o.direction, e AS window_end_us, lead_book_id, round(o.delta, 9) AS lead_delta, followers, round(corr, 9) AS correlation, books FROM fold JOIN ordered o USING (selection_id, direction, k) WHERE kept""")  # fmt: skip
def r4_market(v: Views) -> DataFrame:
    """Each batch is applied twice, as Spark may."""
    log = markets.steam_log(v.spark, sinks.shared_path(v.spark, "steam-log"))
    apply = markets.detect_steam(log, 12.0 * HOUR, W / 60, 2.0 * DAY)
    _market_windows(v, 1_000_000, lambda s, _: s.writeStream.foreachBatch(lambda df, n: (apply(df, n), apply(df, n))))
    return log.read("findings").select("market_id", "selection_id", "direction", us("window_end").alias("window_end_us"), "lead_book_id", r("lead_delta", 9).alias("lead_delta"), "followers", r("correlation", 9).alias("correlation"), F.col("participating_books").alias("books"))


# ---- slate, signals, settlement -----------------------------------------------------------------------------------


@query("r1_slate_state", f""", own AS (SELECT * FROM quotes WHERE book_id <> 3 AND (market_id % 10 <> 0 OR observed_at < {HALF}))
SELECT market_id, arg_max(odds, (observed_at, odds::VARCHAR)) AS odds, epoch_us(max(observed_at)) AS at_us FROM own GROUP BY market_id""")  # fmt: skip
def r1_state(v: Views) -> DataFrame:
    """Newer quotes come first, then tombstones for every tenth market, then the older quotes; those of book 3 name a false key. Read from the stream's state."""
    payload = F.col("odds").cast("string")
    own = v.quotes.select("market_id", F.when(F.col("book_id") == 3, -1 - F.col("market_id")).otherwise(F.col("market_id")).alias("record_key"), "observed_at", F.when(F.col("observed_at") >= _half(), F.col("observed_at")).otherwise(F.col("observed_at") + F.expr("INTERVAL 40 YEARS")).alias("arrived_at"), payload.alias("payload"))
    end = F.lit("2020-01-01").cast("timestamp")
    gone = v.markets.filter("market_id % 10 = 0").select("market_id", F.col("market_id").alias("record_key"), end.alias("observed_at"), end.alias("arrived_at"), F.lit(None).cast("string").alias("payload"))
    newer = F.col("observed_at") >= _half()
    root = _fed(v, "slate", [own.filter(newer), gone, own.filter(~newer)], markets.slate_changes, _append)
    return markets.slate(v.spark, f"{root}/state").select("market_id", F.col("payload").cast("double").alias("odds"), "at_us")


#: Two batches' snapshots at once: quotes before the cut, and all quotes of the markets that have later ones; ids carry the batch in their last bit.
_ARB_AGE, _ARB_SPREAD = 600 * DAY, 100 * DAY
TWO_SQL = f""", snap AS (
    SELECT market_id * 2 + b AS market_id, event_id, league_id, market_type, selection_id * 2 + b AS selection_id, role, book_id, odds, line, observed_at FROM
        (SELECT *, 0 AS b FROM quotes WHERE observed_at < {HALF} UNION ALL SELECT *, 1 FROM quotes WHERE market_id IN (SELECT market_id FROM quotes WHERE observed_at >= {HALF}))
    QUALIFY row_number() OVER (PARTITION BY selection_id, book_id, b ORDER BY observed_at DESC) = 1)""" + ASSESS_SQL.replace(FAIR_SQL, FAIR_ALL_SQL).replace("latest", "snap") + f""",
best AS (SELECT l.*, anchor, n_selections, CASE WHEN market_type = 'spread' AND role = 'away' THEN CASE WHEN line = 0 THEN 0.0 ELSE -line END ELSE line END AS home_line FROM snap l JOIN (SELECT market_id, max(observed_at) AS anchor, count(DISTINCT selection_id) AS n_selections FROM snap GROUP BY market_id) USING (market_id) WHERE {AGE.format('l.observed_at')} <= {WIDE} * 10
    QUALIFY row_number() OVER (PARTITION BY market_id, home_line, selection_id ORDER BY odds DESC, observed_at DESC, book_id) = 1),
arbs AS (SELECT market_id, home_line, sum(1 / odds) AS s, count(DISTINCT book_id) AS distinct_books, (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1000000.0::DOUBLE AS spread, (epoch_us(any_value(anchor)) - epoch_us(min(observed_at))) / 1000000.0::DOUBLE AS age, epoch_us(min(observed_at)) AS oldest_us
    FROM best GROUP BY market_id, home_line HAVING count(*) = any_value(n_selections) AND (1 - sum(1 / odds)) / sum(1 / odds) >= 0.001),
arb_gated AS (SELECT *, CASE WHEN market_id // 2 % 20 = 0 THEN 'market_closed' WHEN age > {_ARB_AGE} THEN 'stale_leg' WHEN spread > {_ARB_SPREAD} THEN 'wide_spread' WHEN (1 - s) / s < 0.05 THEN 'thin_return' WHEN distinct_books < 2 THEN 'too_few_books' ELSE 'signal' END AS outcome FROM arbs)"""  # fmt: skip


def _signals(v: Views):
    """Quotes in two batches, each applied twice; the second time the first one had broken off before its commit."""
    log = signals.signal_log(v.spark, sinks.shared_path(v.spark, "signals-log"))
    gates = {"max_age": _ARB_AGE, "max_spread": _ARB_SPREAD, "min_return": 0.05, "min_books": 2, "open_markets": v.markets.filter("market_id % 20 <> 0")}
    apply = signals.detect_signals(log, (0,), (1,), "shin", WIDE, WIDE, WIDE, 1.0, 0.0, {"max_age": WIDE * 10, "max_spread": 1e12}, gates)
    own = sinks.stored(v.quotes, "signals-quotes")

    def broken(df: DataFrame, n: int) -> None:
        commit, log.commit = log.commit, lambda _: None
        try:
            apply(df, n)
        finally:
            log.commit = commit
        apply(df, n)
        apply(df, n)

    _fed(v, "signals", [own.filter(F.col("observed_at") < _half()), own.filter(F.col("observed_at") >= _half())], signals.market_snapshots, lambda s, _: s.writeStream.foreachBatch(broken))
    return log


@query("r5_signals_exactly_once", TWO_SQL + """, ev AS (SELECT market_id // 2 AS market_id, 'ev' AS kind, selection_id // 2 AS selection_id, book_id, epoch_us(observed_at) AS at_us, round(ev, 8) AS value, market_id % 2 AS b FROM gated WHERE outcome = 'signal' QUALIFY row_number() OVER (PARTITION BY selection_id // 2, book_id, observed_at ORDER BY market_id % 2 DESC) = 1),
keys AS (SELECT a.*, sha256(string_agg((b.selection_id // 2)::VARCHAR || chr(31) || b.book_id::VARCHAR || chr(31) || regexp_replace(b.odds::VARCHAR, '\\.0$', '') || chr(31) || coalesce(regexp_replace(b.line::VARCHAR, '\\.0$', ''), '-') || chr(31), '' ORDER BY b.selection_id)) AS fingerprint FROM arb_gated a JOIN best b ON a.market_id = b.market_id AND a.home_line IS NOT DISTINCT FROM b.home_line WHERE outcome = 'signal' GROUP BY ALL),
arb AS (SELECT DISTINCT market_id // 2 AS market_id, 'arb' AS kind, fingerprint, oldest_us AS at_us, round((1 - s) / s, 8) AS value FROM keys)
SELECT market_id, kind, selection_id::VARCHAR AS id, book_id, at_us, value FROM ev UNION ALL SELECT market_id, kind, fingerprint, NULL, at_us, value FROM arb""")  # fmt: skip
def r5_once(v: Views) -> DataFrame:
    log = _signals(v)
    ev = signals.ev_table(log).select("market_id", F.lit("ev").alias("kind"), F.col("selection_id").cast("string").alias("id"), "book_id", "at_us", r("ev", 8).alias("value"))
    arb = signals.arb_table(log).select("market_id", F.lit("arb").alias("kind"), F.col("fingerprint").alias("id"), F.lit(None).cast("int").alias("book_id"), F.col("oldest_us").alias("at_us"), r("return_fraction", 8).alias("value"))
    return ev.unionByName(arb)


@query("s13_topics_exactly_once", TWO_SQL + " SELECT 'ev' AS kind, market_id // 2 AS market_id, count(*) AS messages FROM gated WHERE outcome = 'signal' GROUP BY ALL UNION ALL SELECT 'arb', market_id // 2, count(*) FROM arb_gated WHERE outcome = 'signal' GROUP BY ALL")
def s13_once(v: Views) -> DataFrame:
    """A message for each batch in which a signal was found, and no more, though every batch ran three times."""
    return _signals(v).read("topics").groupBy("kind", F.col("key").cast("long").alias("market_id")).agg(F.count("*").alias("messages"))


@query("a12_scan_counters", TWO_SQL + " SELECT 'ev' AS kind, outcome, count(*) AS n FROM gated GROUP BY outcome UNION ALL SELECT 'arb', outcome, count(*) FROM arb_gated GROUP BY outcome")
def a12_scans(v: Views) -> DataFrame:
    return _signals(v).read("counts").groupBy("kind", "outcome").agg(F.sum("n").alias("n"))


VOID = GRADE.replace("SELECT l.*, CASE WHEN market_type", "SELECT l.*, epoch_us(scheduled_start) + 10800000000 AS fin, CASE WHEN l.event_id % 11 = 3 THEN 'void' WHEN market_type").replace("WHERE status = 'final')", "WHERE status = 'final' AND wager_id % 13 <> 0)")
VOID = VOID.replace("count(*) FILTER (WHERE result = 'push') AS push", "count(*) FILTER (WHERE result IN ('push', 'void')) AS push, count(*) FILTER (WHERE result = 'void') AS void, max(fin) AS fin").replace("FILTER (WHERE result = 'push'), 1)", "FILTER (WHERE result IN ('push', 'void')), 1)")
VOID = VOID.replace("WHEN won = 0 THEN 'push'", "WHEN won = 0 THEN CASE WHEN void > 0 THEN 'void' ELSE 'push' END").replace("WHEN 'push' THEN stake_minor", "WHEN 'push' THEN stake_minor WHEN 'void' THEN stake_minor").replace("placed_at, accepted, CASE", "placed_at, fin, accepted, CASE")


def _settled(v: Views):
    """Results in three batches: even events, odd ones with some of the even ones again, and all again. Some events are cancelled, some tickets cashed out."""
    g = v.games.filter("status = 'final'").select("event_id", F.when(F.col("event_id") % 11 == 3, "cancelled").otherwise("final").alias("status"), "home_score", "away_score", (F.col("scheduled_start") + F.expr("INTERVAL 3 HOURS")).alias("finalised_at"))
    own = v.tickets.withColumn("status", F.when(F.col("wager_id") % 13 == 0, "cashed_out").otherwise("placed"))
    log = settlement.settlement_log(v.spark, sinks.shared_path(v.spark, "settlement-log"))
    apply = settlement.settle(log, v.tickets)
    build = lambda s: settlement.graded_tickets(s, own, v.legs, v.markets.filter("market_id % 5 = 0").select("market_id"))
    parts = [g.filter("event_id % 2 = 0"), g.filter("event_id % 2 = 1 OR event_id % 10 = 0"), g]
    _fed(v, "results", parts, build, lambda s, _: s.writeStream.outputMode("update").foreachBatch(lambda df, n: (apply(df, n), apply(df, n))))
    return log


@query("r6_settlement_cursor", VOID + " SELECT wager_id, status, CAST(returned_minor AS BIGINT) AS returned_minor, greatest(epoch_us(placed_at), fin) AS settled_us FROM settled")
def r6_cursor(v: Views) -> DataFrame:
    return _settled(v).read("settled").select("wager_id", "status", "returned_minor", us("settled_at").alias("settled_us"))


@query("k10_part_graded", VOID + " SELECT s.wager_id, s.n AS n_graded, n_legs FROM sums s JOIN counts USING (wager_id) WHERE s.n < n_legs")
def k10_waiting(v: Views) -> DataFrame:
    return settlement.waiting(_settled(v))


# ---- atomic appends, reference order ------------------------------------------------------------------------------


@query("s14_append_once", """, own AS (SELECT * FROM tickets WHERE wager_id IN (SELECT wager_id FROM legs)), stakes AS (SELECT wager_id, stake_minor FROM own WHERE stake_minor <> 0)
SELECT 'tickets' AS name, count(*) AS n, CAST(sum(stake_minor) AS BIGINT) AS total FROM own UNION ALL SELECT 'legs', count(*), CAST(sum(selection_id) AS BIGINT) FROM legs UNION ALL SELECT 'entries', 2 * count(*), CAST(sum(stake_minor) AS BIGINT) FROM stakes""")  # fmt: skip
def s14_once(v: Views) -> DataFrame:
    """Two halves; the first is refused once for a missing movement, breaks off once before its commit, and both come twice."""
    path = sinks.shared_path(v.spark, "betting")
    legs = sinks.stored(v.legs, "betting-legs")
    own = sinks.stored(v.tickets.join(legs.select("wager_id"), "wager_id", "left_semi"), "betting-tickets")
    entries = tickets.stake_entries(own)
    log = sinks.ticket_log(own, legs, entries, path)
    first = F.col("wager_id") % 2 == 0
    try:
        sinks.append_tickets(own.filter(first), legs.filter(first), entries.filter(first & (F.col("wager_id") % 64 != 0)), path)
    except ValueError:
        log.stage("broken", tickets=own.filter(first), legs=legs.filter(first))
    for half in (first, ~first, first, ~first):
        sinks.append_tickets(own.filter(half), legs.filter(half), entries.filter(half), path)
    total = lambda name, c: log.read(name).agg(F.count("*").alias("n"), F.sum(c).alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return total("tickets", F.col("stake_minor")).unionByName(total("legs", F.col("selection_id"))).unionByName(total("entries", F.greatest("amount_minor", F.lit(0))))


_fresh = f"complete AND {AGE.format('oldest')} <= {WIDE}"


@query("m2_reference_order", SNAP_SQL + f" SELECT market_id, arg_min(book_id, rank) AS reference_book_id FROM (SELECT *, CASE book_id WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 END AS rank FROM books WHERE {_fresh}) WHERE rank IS NOT NULL GROUP BY market_id")
def m2_order(v: Views) -> DataFrame:
    """Books 1, 2 and 4 are flagged; the preferences are 2, then 3: so 2, 1, 4, 3."""
    books = pricing.book_snapshots(v.latest)
    return pricing.resolve_reference(books, (1, 2, 4), (2, 3), WIDE).filter("reference_book_id IS NOT NULL").select("market_id", "reference_book_id")


# ---- middles and limits in full -----------------------------------------------------------------------------------

#: Lines of books 1 and 2 move by two points, those of book 3 by two and a half, so that some windows end on whole results.
WINDOWS_SQL = MID_SQL.replace("THEN 2 ELSE 0 END AS threshold", "THEN 2 WHEN book_id = 3 AND role IN ('away', 'under') THEN 2.5 ELSE 0 END AS threshold").replace("a.odds AS odds_a", "a.market_type, a.odds AS odds_a").replace("market_id, role, book_id", "market_id, market_type, role, book_id") + """,
staked AS (SELECT *, CAST(ceil(10000 * (1 / odds_a / s)) AS BIGINT) AS sa, CAST(ceil(10000 * (1 / odds_b / s)) AS BIGINT) AS sb FROM pairs),
paid AS (SELECT *, sa + sb AS outlay, CAST(trunc(sa * odds_a) AS BIGINT) AS ra, CAST(trunc(sb * odds_b) AS BIGINT) AS rb FROM staked),
profits AS (SELECT *, ra + rb - outlay AS hit_profit, least(ra, rb) - outlay AS worst_profit, rb + sa - outlay AS low_push_profit, ra + sb - outlay AS high_push_profit FROM paid),
results AS (SELECT m.market_id, m.market_type, CASE WHEN m.market_type = 'total' THEN home_score + away_score ELSE home_score - away_score END AS result FROM markets m JOIN games USING (event_id) WHERE m.market_type <> 'moneyline' AND status = 'final')"""


def _windows(v: Views) -> DataFrame:
    moved = F.when(F.col("role").isin("away", "under"), F.when(F.col("book_id").isin(1, 2), F.col("line") + 2).when(F.col("book_id") == 3, F.col("line") + 2.5).otherwise(F.col("line"))).otherwise(F.col("line"))
    return pricing.middles(v.latest.withColumn("line", moved), 1e12, 1e12)


def _results(v: Views) -> DataFrame:
    score = F.when(F.col("market_type") == "total", F.col("home_score") + F.col("away_score")).otherwise(F.col("home_score") - F.col("away_score"))
    return v.markets.filter("market_type <> 'moneyline'").select("market_id", "event_id", "market_type").join(v.games.filter("status = 'final'"), "event_id").select("market_id", "market_type", score.alias("result"))


@query("m17_middle_returns", WINDOWS_SQL + " SELECT market_id, low, high, sa AS stake_above, sb AS stake_below, outlay, hit_profit, ra - outlay AS above_profit, rb - outlay AS below_profit, low_push_profit, high_push_profit, worst_profit, round(CASE WHEN worst_profit >= 0 THEN 0 WHEN hit_profit > 0 THEN -worst_profit / (hit_profit - worst_profit)::DOUBLE ELSE 1 END, 9) AS breakeven_hit FROM profits")
def m17_returns(v: Views) -> DataFrame:
    cols = ["stake_above", "stake_below", "outlay", "hit_profit", "above_profit", "below_profit", "low_push_profit", "high_push_profit", "worst_profit"]
    return pricing.middle_stakes(_windows(v), 10_000).select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), *cols, r("breakeven_hit", 9).alias("breakeven_hit"))


@query("m18_expected_profit", WINDOWS_SQL + """, totals AS (SELECT market_type, count(*)::DOUBLE AS t FROM results GROUP BY market_type),
rates AS (SELECT p.market_id, low, high, any_value(hit_profit) AS hp, any_value(worst_profit) AS wp, any_value(low_push_profit) AS lp, any_value(high_push_profit) AS pp, count(*) FILTER (WHERE result > low AND result < high) / any_value(t) AS hit, count(*) FILTER (WHERE result = low) / any_value(t) AS lo, count(*) FILTER (WHERE result = high) / any_value(t) AS hi
    FROM profits p JOIN results r ON r.market_type = p.market_type JOIN totals ON totals.market_type = p.market_type GROUP BY p.market_id, low, high)
SELECT market_id, low, high, round(hit, 9) AS hit, round(lo + hi, 9) AS push, round(hit * hp + lo * lp + hi * pp + (1 - hit - lo - hi) * wp, 5) AS expected_profit, round(hit - CASE WHEN wp >= 0 THEN 0 WHEN hp > 0 THEN -wp / (hp - wp)::DOUBLE ELSE 1 END, 9) AS edge FROM rates""")  # fmt: skip
def m18_profit(v: Views) -> DataFrame:
    own = pricing.middle_expectation(pricing.middle_stakes(_windows(v), 10_000), pricing.settlement_distribution(_results(v)))
    return own.select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), r("hit", 9).alias("hit"), r(F.col("low_push") + F.col("high_push"), 9).alias("push"), r("expected_profit", 5).alias("expected_profit"), r("edge", 9).alias("edge"))


@query("m19_middle_settlements", WINDOWS_SQL + " SELECT market_id, low, high, CASE WHEN result > low AND result < high THEN 'both_win' WHEN result = low OR result = high THEN 'win_push' ELSE 'win_lose' END AS kind FROM pairs JOIN results USING (market_id)")
def m19_settled(v: Views) -> DataFrame:
    return pricing.middle_settlements(_windows(v), _results(v)).select("market_id", F.col("threshold").alias("low"), F.col("threshold_b").alias("high"), "kind")


@query("k14_limit_usage_at", VOID + """, moves AS (SELECT user_id, 'stake' AS kind, epoch_us(placed_at) AS t, -stake_minor AS amount FROM tickets UNION ALL SELECT user_id, 'settlement', fin, returned_minor FROM settled UNION ALL SELECT user_id, 'grant', epoch_us(placed_at) + 3600000000, 500 FROM tickets WHERE wager_id % 4 = 0),
asks AS (SELECT wager_id, user_id, stake_minor, epoch_us(placed_at) AS t, unnest(['day', 'week', 'month']) AS period, placed_at FROM tickets),
since AS (SELECT *, CASE period WHEN 'day' THEN t - 86400000000 WHEN 'week' THEN t - 604800000000 ELSE epoch_us(date_trunc('month', placed_at) - INTERVAL 1 MONTH) + (day(placed_at) - 1) * 86400000000 + (t - epoch_us(date_trunc('day', placed_at))) END AS since FROM asks),
used AS (SELECT s.wager_id, s.period, any_value(s.stake_minor) AS stake, coalesce(-sum(amount) FILTER (WHERE kind = 'stake'), 0) AS staked, coalesce(-sum(amount) FILTER (WHERE kind <> 'grant'), 0) AS lost, coalesce(sum(amount) FILTER (WHERE kind = 'grant'), 0) AS granted FROM since s LEFT JOIN moves m ON m.user_id = s.user_id AND m.t BETWEEN s.since AND s.t GROUP BY ALL)
SELECT wager_id, period, k.kind, CAST(CASE k.kind WHEN 'stake' THEN staked WHEN 'loss' THEN lost ELSE granted END AS BIGINT) AS used_minor, CASE k.kind WHEN 'stake' THEN staked + stake WHEN 'loss' THEN lost + stake ELSE granted END > CASE k.kind WHEN 'grant' THEN 400 ELSE 30000000 END AS breached FROM used, (SELECT unnest(['stake', 'loss', 'grant']) AS kind) k""")  # fmt: skip
def k14_at(v: Views) -> DataFrame:
    """Every ticket asks at its own instant for each kind and period; settlements count as losses, and every fourth ticket is granted credit an hour later."""
    own = v.tickets
    cancelled = v.games.filter("status = 'final'").withColumn("status", F.when(F.col("event_id") % 11 == 3, "cancelled").otherwise("final")).withColumn("fin", F.col("scheduled_start") + F.expr("INTERVAL 3 HOURS"))
    graded = tickets.grade(v.legs.filter("wager_id % 13 <> 0"), cancelled, v.markets.filter("market_id % 5 = 0").select("market_id"), ("fin",))
    done = graded.groupBy("wager_id").agg(F.max("fin").alias("fin"))
    decided = tickets.decide(own, graded, v.legs.groupBy("wager_id").agg(F.count("*").alias("n_legs"))).join(done, "wager_id")
    entry = lambda df, kind, at, amount: df.select("user_id", F.lit(kind).alias("kind"), F.lit("cash").alias("account_kind"), at.alias("placed_at"), amount.cast("long").alias("amount_minor"))
    entries = entry(own, "stake", F.col("placed_at"), -F.col("stake_minor")).unionByName(entry(decided, "settlement", F.col("fin"), F.col("returned_minor")))
    entries = entries.unionByName(entry(own.filter("wager_id % 4 = 0"), "grant", F.col("placed_at") + F.expr("INTERVAL 1 HOUR"), F.lit(500)))
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    asks = own.select("wager_id", "user_id", "stake_minor", "placed_at", each(tickets.PERIODS).alias("period")).select("*", each(tuple(tickets.LIMIT_KINDS)).alias("kind"))
    asks = asks.select(F.concat_ws("/", "wager_id", "period", "kind").alias("ask_id"), "wager_id", "user_id", "kind", "period", F.col("placed_at").alias("at"), F.col("stake_minor").alias("requested_minor"), F.when(F.col("kind") == "grant", 400).otherwise(30_000_000).cast("long").alias("limit_minor"))
    return tickets.limit_usage_at(asks, entries).select("wager_id", "period", "kind", "used_minor", "breached")
