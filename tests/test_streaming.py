"""The stream's closed buckets are the batch's."""

from pyspark.sql import functions as F

from tickline.streaming import histories

SF = "/root/testdata/sf0.001"


def ticks(df):
    return df.select(F.col("event_type").alias("selection_id"), F.col("value").alias("odds"), F.col("ts").cast("timestamp").alias("observed_at"))


def test_ohlc_stream_equals_batch(spark, tmp_path):
    stream = histories.ohlc_stream(ticks(histories.files(spark, SF, "events")), "1 day", "1 hour", "selection_id")
    got = {tuple(r) for r in histories.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    batch = ticks(spark.read.parquet(f"{SF}/events.parquet"))
    own = batch.groupBy("selection_id", F.window("observed_at", "1 day").alias("w")).agg(
        F.min_by("odds", "observed_at"), F.max("odds"), F.min("odds"), F.max_by("odds", "observed_at"), F.count("*")
    )
    want = {(r[0], r[1]["start"], *r[2:]) for r in own.collect()}
    assert got and got <= want and len(want) - len(got) <= 2 * len({r[0] for r in want})


def test_steam_stream_equals_batch(spark):
    from tickline.operators import steam
    from tickline.streaming import state

    own = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_type").alias("selection_id"), (F.col("user_id") % 5).cast("int").alias("book_id"), (0.05 + 0.9 * (F.col("value") % 100) / 100).alias("implied"), F.col("ts").cast("timestamp").alias("observed_at")
    )
    own = own.dropDuplicates(["selection_id", "book_id", "observed_at"]).withColumn("t", F.unix_micros("observed_at"))
    lo, hi = own.agg(F.min("t"), F.max("t")).first()
    parts = [own.filter((F.col("t") > lo + (hi - lo) * k // 3 - (k == 0)) & (F.col("t") <= lo + (hi - lo) * (k + 1) // 3)) for k in range(3)]
    h, w = 6 * 3600 * 1_000_000, 18 * 3600 * 1_000_000
    rows = state.replay(parts, lambda s: state.steam_stream(s, 18 * 3600, 6 * 3600, 6 * 3600, 0.0, 43200.0, 100_000, 1_000_000), "test-steam").collect()
    last = lambda t: (t - h - w) // h * h + w
    first = {r[0]: last(r[1]) for r in parts[0].groupBy("selection_id").agg(F.max("t")).collect()}
    final = {r[0]: last(r[1]) for r in own.groupBy("selection_id").agg(F.max("t")).collect()}
    batch = steam.candidates(steam.moves(own, "18 hours", "6 hours"), max_lag=43200.0).select("selection_id", F.unix_micros("window_end").alias("e"), "lead_book_id", F.round("lead_delta", 9), F.size("followers"), F.round("correlation", 9), "participating_books")
    want = {tuple(r) for r in batch.collect() if first[r.selection_id] <= r.e <= final[r.selection_id]}
    got = {(r.selection_id, r.window_end_us, r.lead_book_id, round(r.lead_delta, 9), r.followers, round(r.correlation, 9), r.books) for r in rows if r.kind == "finding"}
    assert got == want and want
    assert all(r.n == 0 for r in rows if r.kind in ("late", "skipped"))


def test_signals_stream_keeps_what_each_batch_found(spark):
    from tickline.operators import pricing
    from tickline.plans import catalog, catalog3  # noqa: F401
    from tickline.plans.model import Views

    v = Views(spark, SF)
    half = F.lit("1996-01-01").cast("timestamp")
    found = set()
    for q in (v.quotes.filter(F.col("observed_at") < half), v.quotes):
        found |= {(r.market_id, r.selection_id, r.observed_at) for r in pricing.best_quotes(pricing.newest(q), catalog.WIDE).collect()}
    got = {r.market_id: r for r in catalog.QUERIES["r5_signals_stream"](spark, SF).collect()}
    want = {}
    for m, _, _ in found:
        want[m] = want.get(m, 0) + 1
    assert {m: r.signals for m, r in got.items()} == want and all(r.messages >= r.signals for r in got.values())


def fed(spark, root, parts, build, start):
    """Parts arrive one after the other; ``start`` starts the stream that ``build`` makes of them."""
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/in/part={i}")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{root}/in/part=*"))
        start(stream).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def collected(spark, root, parts, build):
    fed(spark, root, parts, build, lambda s: s.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append"))
    return spark.read.parquet(f"{root}/out").collect()


RECORD = "market_id long, anchor_s long, selection_id string, book_id int, implied double, at_s long, gone boolean"


def records(spark, rows):
    own = spark.createDataFrame(rows, RECORD)
    return own.select("market_id", F.timestamp_seconds("anchor_s").alias("anchor"), "selection_id", "book_id", "implied", F.timestamp_seconds("at_s").alias("observed_at"), "gone")


def counts(rows, kind):
    out = {}
    for row in rows:
        if row.kind == kind:
            out[row.market_id] = out.get(row.market_id, 0) + row.n
    return out


def test_steam_state_counts_late_points_and_skipped_windows(spark, tmp_path):
    from tickline.streaming import markets

    markets.keyed_state(spark)
    one = [(1, 1000, "a", 1, 0.5, 1000, None), (1, 1000, "a", 2, 0.5, 990, None), (2, 1000, "b", 1, 0.5, 1000, None)]
    two = [(1, 1100, "a", 1, 0.6, 1100, None), (1, 1100, "a", 1, 0.6, 700, None), (1, 1100, "a", 1, 1.5, 1100, None), (1, 9000, "a", 1, 0.4, 9000, None)]
    three = [(1, 9000, None, None, None, None, True), (1, 9001, "a", 1, 0.4, 8800, None)]  # a tombstone, then an old point that is not late any more
    rows = collected(spark, str(tmp_path), [records(spark, p) for p in (one, two, three)], lambda s: markets.closed_windows(s, most_windows=32, most_samples=3))
    assert counts(rows, "late") == {1: 1, 2: 0}, "700 s lies before 1000 - 180 s"
    # market 1: mark 820 closes the window that ends at 780; mark 920 two more windows; mark 8820 132 windows, of which 100 are skipped
    assert counts(rows, "windows") == {1: 1 + 2 + 32 + 1, 2: 1} and counts(rows, "skipped") == {1: (8820 - 900) // 60 - 32, 2: 0}
    assert counts(rows, "forgotten") == {1: 1}
    state = spark.read.format("statestore").option("stateVarName", "points").option("flattenCollectionTypes", "true").load(f"{tmp_path}/state").collect()
    assert sorted((r.key.market_id, list(r.user_map_value.at)) for r in state) == [(1, [8_800_000_000]), (2, [1_000_000_000])]


def test_steam_state_keeps_few_samples_and_forgets_silent_markets(spark, tmp_path):
    from tickline.streaming import markets

    markets.keyed_state(spark)
    one = [(1, 1000 + i, "a", 1, 0.5, 1000 + i, None) for i in range(100)] + [(2, 1000, "b", 1, 0.5, 1000, None)]
    two = [(1, 6000, "a", 1, 0.5, 6000, None)]
    three = [(1, 6010, "a", 1, 0.5, 6010, None)]
    rows = collected(spark, str(tmp_path), [records(spark, p) for p in (one, two, three)], lambda s: markets.closed_windows(s, forget_after=3600))
    assert max(r.n for r in rows if r.kind == "held") == 64
    assert counts(rows, "forgotten") == {2: 1}, "market 2 was silent for an hour of event time"
    state = spark.read.format("statestore").option("stateVarName", "clock").load(f"{tmp_path}/state").collect()
    assert [r.key.market_id for r in state] == [1]


def test_steam_stream_by_market_equals_batch_and_survives_a_repeat(spark, tmp_path):
    """A coordinated move in a quiet series is found, whatever the batches; a batch that runs again changes nothing."""
    import random

    from tickline.operators import steam
    from tickline.streaming import markets

    markets.keyed_state(spark)
    rnd = random.Random(3)
    rows = [(m, t + 5, f"{m}:{s}", b, 0.4 + 0.001 * rnd.random() + (0.1 if m == 2 and t >= 3000 + 10 * b else 0.0), t, None) for m in (1, 2) for t in range(0, 6000, 20) for s in "xy" for b in range(4)]
    rows += [(m, t + 5, f"{m}:x", 0, 0.4, t, None) for m in (1, 2) for t in (6300, 6600)]  # closes what is open
    own = records(spark, rows)
    batch = steam.candidates(steam.moves(own.select("selection_id", "book_id", "implied", "observed_at")))
    want = {tuple(r) for r in steam.with_cooldown(batch).select("selection_id", "window_end", "lead_book_id", F.size("followers").alias("f")).collect()}
    got = {}
    for name, cuts in (("few", [3005, 99999]), ("many", [500, 2990, 3045, 3105, 3500, 99999])):
        root = f"{tmp_path}/{name}"
        log = markets.steam_log(spark, f"{root}/log")
        apply = markets.detect_steam(log)
        twice = lambda df, n, apply=apply: (apply(df, n), apply(df, n))
        parts = [own.filter((F.unix_seconds("anchor") > lo) & (F.unix_seconds("anchor") <= hi)) for lo, hi in zip([-1, *cuts], cuts, strict=False)]
        fed(spark, root, parts, markets.closed_windows, lambda s, f=twice: s.writeStream.foreachBatch(f))
        got[name] = {(r.selection_id, r.window_end, r.lead_book_id, r.followers) for r in log.read("findings").collect()}
        assert log.read("findings").count() == len(got[name])
    assert got["few"] == got["many"] == want and {r[0] for r in want} == {"2:x", "2:y"}


def test_slate(spark, tmp_path):
    from tickline.streaming import markets

    markets.keyed_state(spark)
    schema = "market_id long, record_key long, observed_s long, arrived_s long, payload string"
    make = lambda rows: spark.createDataFrame(rows, schema).select("market_id", "record_key", F.timestamp_seconds("observed_s").alias("observed_at"), F.timestamp_seconds("arrived_s").alias("arrived_at"), "payload")
    one = make([(1, 1, 10, 1, "a"), (1, 1, 5, 2, "old"), (2, 9, 10, 3, "x"), (3, 3, 10, 4, "c"), (4, 4, 10, 5, "d")])
    two = make([(1, 1, 10, 6, "again"), (3, None, 9, 7, None), (4, None, 11, 8, None), (5, None, 1, 9, None)])
    three = make([(4, 4, 2, 10, "back"), (3, 3, 12, 11, "new"), (3, 3, 11, 12, "late")])
    rows = collected(spark, str(tmp_path), [one, two, three], markets.slate_changes)
    assert sorted((r.market_id, r.outcome) for r in rows) == sorted([(1, "stored"), (1, "stale"), (2, "rejected"), (3, "stored"), (4, "stored"), (1, "stored"), (3, "stale"), (4, "removed"), (5, "removed"), (4, "stored"), (3, "stored"), (3, "stale")])
    held = {r.market_id: (r.at_us, r.payload) for r in markets.slate(spark, f"{tmp_path}/state").collect()}
    assert held == {1: (10_000_000, "again"), 3: (12_000_000, "new"), 4: (2_000_000, "back")}


def test_tickets_settle_once_whatever_comes_again(spark, tmp_path):
    """Results come again, some of them changed; a ticket waits for its last leg, is complete in one batch, and no Python runs in tasks."""
    from tickline.streaming import markets, settlement

    markets.keyed_state(spark)
    own = spark.createDataFrame([(w, 1, 100, "half_even", 5) for w in (1, 2, 3)], "wager_id long, user_id long, stake_minor long, rounding string, s long").withColumn("placed_at", F.timestamp_seconds("s"))
    legs = spark.createDataFrame([(w * 10 + e, w, e, e, e * 2, "moneyline", "home", 2.0, None) for w, es in ((1, (1, 2)), (2, (1, 3)), (3, (2,))) for e in es], "leg_id long, wager_id long, event_id long, market_id long, selection_id long, market_type string, role string, odds double, home_line double")
    make = lambda rows: spark.createDataFrame(rows, "event_id long, home_score int, away_score int, s long").select("event_id", F.lit("final").alias("status"), "home_score", "away_score", F.timestamp_seconds("s").alias("finalised_at"))
    # event 1 comes twice in the first batch (the earlier counts), and again with an earlier instant and another score
    parts = [make([(1, 2, 0, 10), (1, 0, 2, 11)]), make([(1, 0, 2, 1), (2, 3, 0, 20)]), make([(2, 0, 3, 30), (3, 1, 0, 40), (1, 0, 2, 41)]), make([(3, 1, 0, 40)])]
    log = settlement.settlement_log(spark, f"{tmp_path}/log")
    apply, plans = settlement.settle(log, own), []

    def build(s):
        plans.append(out := settlement.graded_tickets(s, own, legs))
        return out

    fed(spark, str(tmp_path), parts, build, lambda s: s.writeStream.outputMode("update").foreachBatch(lambda df, n: (apply(df, n), apply(df, n))))
    assert not any("Pandas" in p._jdf.queryExecution().analyzed().toString() or "Python" in p._jdf.queryExecution().analyzed().toString() for p in plans)
    states = sorted((r.batch, r.wager_id, r.state, r.n_graded) for r in log.read("graded").select("batch", "wager_id", "state", "n_graded").distinct().collect())
    assert states == [("0", 1, "deferred", 1), ("0", 2, "deferred", 1), ("1", 1, "complete", 2), ("1", 2, "deferred", 1), ("1", 3, "complete", 1), ("2", 1, "already_settled", 2), ("2", 2, "complete", 2), ("2", 3, "already_settled", 1), ("3", 2, "already_settled", 2)]
    settled = sorted((r.wager_id, r.status, r.returned_minor, r.s) for r in log.read("settled").withColumn("s", F.unix_seconds("settled_at")).collect())
    assert settled == [(1, "won", 400, 20), (2, "won", 400, 40), (3, "won", 200, 20)]
    assert settlement.waiting(log).isEmpty()
