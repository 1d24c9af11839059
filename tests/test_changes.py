"""The fold behind change detection and cooldown, fingerprints, and the sinks' refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickline.operators import changes, tickets
from tickline.sources import raw, sinks
from tickline.streaming import state


def test_rested_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), "xyz"[int(k) % 3], int(t)) for k, t in zip(rng.integers(0, 5, 3000), rng.integers(0, 400, 3000) * 1_000_000, strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = changes.rested(spark.createDataFrame(rows, "a long, b string, t long"), ["a", "b"], "t", 7.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for a, b, t in sorted(rows):
        kept = (a, b) not in last or t - last[a, b] >= 7_000_000
        if kept:
            last[a, b] = t
        want.append((a, b, t, kept))
    assert sorted(map(tuple, got)) == sorted(want)
    assert changes.rested(spark.createDataFrame([], "a long, t long"), ["a"], "t", 1.0).count() == 0


def test_a_hot_key_is_folded_in_segments(spark):
    """Equal to the fold in one task, for gaps shorter and longer than a segment, ties and a gap of zero; one key uses all tasks."""
    rng = np.random.default_rng(2)
    hot = [(1, "x", int(t)) for t in np.concatenate([rng.integers(0, 40_000, 3000), [7] * 500]) * 1_000_000]
    rows = hot + [(2, "y", int(t) * 1_000_000) for t in rng.integers(0, 4000, 700)] + [(3, "x", 5), (3, "y", 5)]
    df = spark.createDataFrame(rows, "a long, b string, t long")
    for gap in (3.0, 40.0, 900.0, 30_000.0, 0.0):
        count = lambda d: sorted((tuple(r), n) for r, n in d.filter("kept").rdd.map(lambda r: (tuple(r), 1)).reduceByKey(lambda x, y: x + y).collect())
        want = count(changes.rested(df, ["a", "b"], "t", gap))
        assert count(changes.rested(df, ["a", "b"], "t", gap, most=600)) == want, gap
        assert count(changes.rested_in_segments(df, ["a", "b"], "t", int(gap * 1e6), 200)) == want, gap
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task else
    try:
        out = changes.rested_in_segments(df.filter("a = 1"), ["a", "b"], "t", 1_000_000, 1000)
        assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).collect()}) >= 3 and out.count() == len(hot)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fingerprint(spark, quotes):
    df = spark.createDataFrame([(1, *q) for q in quotes], "market_id long, selection_id long, book_id int, odds double, line double").withColumn("observed_at", F.lit("2020-01-01").cast("timestamp"))
    return changes.market_records(df, "1 day").first().fingerprint


def test_fingerprints(spark):
    one = [(1, 0, 1.9, -1.5), (2, 0, 2.0, 1.5), (1, 3, 1.8, None)]
    assert fingerprint(spark, one) == fingerprint(spark, one[::-1]), "order is no part of it"
    assert fingerprint(spark, [(1, 0, 1.9, 0.0)]) == fingerprint(spark, [(1, 0, 1.9, -0.0)]) != fingerprint(spark, [(1, 0, 1.9, None)])
    assert fingerprint(spark, one) != fingerprint(spark, [*one[:2], (1, 3, 1.81, None)])


def test_change_detect_refreshes_behind_the_last_published(spark):
    rows = [(1, t, f) for t, f in ((0, "a"), (200, "a"), (350, "a"), (500, "a"), (600, "b"), (650, "a"), (960, "a"))]
    df = spark.createDataFrame(rows, "market_id long, t long, fingerprint string").withColumn("observed_at", F.timestamp_seconds("t"))
    got = [r.outcome for r in changes.change_detect(df, 300.0).orderBy("t").collect()]
    assert got == ["changed", "suppressed", "refreshed", "suppressed", "changed", "changed", "refreshed"]
    parts = [df.filter("t <= 350"), df.filter("t > 350").union(df.filter("t = 200"))]
    streamed = state.replay(parts, lambda s: state.change_stream(s, 300.0), "test-changes").orderBy("at_us", F.col("outcome") == "stale").collect()
    assert [r.outcome for r in streamed if r.outcome != "stale"] == got and [r.at_us for r in streamed if r.outcome == "stale"] == [200_000_000]


def test_props_of_two_players_are_no_duplicates(spark):
    body = '{"id": "e", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "b", "last_update": "2020-01-01T00:00:00Z", "markets": [{"key": "player_points", "outcomes": [%s]}, {"key": "outrights", "outcomes": [{"name": "Red", "price": 5.0}, {"name": "Blue", "price": 3.0}, {"name": "Red", "price": 4.0}]}]}]}'
    outcomes = ", ".join(f'{{"name": "Over", "description": "{who}", "price": 1.9, "point": 9.5}}' for who in ("Ann", "Bob", "Ann", ""))
    got = raw.normalize(raw.read_payloads(spark.createDataFrame([(body % outcomes,)], "payload string"))).collect()
    props = [(r.subject or "", r.reason or "") for r in got if r.market_type == "prop"]
    assert sorted(props) == [("", "missing_subject"), ("Ann", ""), ("Ann", "duplicate_quote"), ("Bob", "")]
    assert sorted((r.subject, r.reason or "") for r in got if r.market_type == "outright") == [("Blue", ""), ("Red", ""), ("Red", "duplicate_quote")]


def test_ledger_refuses_unbalanced_batches(spark, tmp_path):
    own = spark.createDataFrame([(1, 7, 100, "half_even")], "wager_id long, user_id long, stake_minor long, rounding string").withColumn("placed_at", F.lit("2020-01-01").cast("timestamp"))
    legs = spark.createDataFrame([(1, 5)], "wager_id long, selection_id long")
    entries = tickets.stake_entries(own)
    path = f"file://{tmp_path}/betting"
    for bad in (entries.filter("account_kind = 'cash'"), entries.withColumn("amount_minor", F.abs("amount_minor"))):
        with pytest.raises(ValueError):
            sinks.append_tickets(own, legs, bad, path)
    with pytest.raises(ValueError):
        sinks.append_tickets(own, legs.filter("false"), entries, path)
    sinks.append_tickets(own, legs, entries, path)
    assert spark.read.parquet(f"{path}/entries").count() == 2


def test_tickets_are_appended_once_and_whole(spark, tmp_path, monkeypatch):
    own = spark.createDataFrame([(1, 7, 100, "half_even"), (2, 7, 0, "half_even")], "wager_id long, user_id long, stake_minor long, rounding string").withColumn("placed_at", F.lit("2020-01-01").cast("timestamp"))
    legs = spark.createDataFrame([(1, 5), (2, 6)], "wager_id long, selection_id long")
    entries = tickets.stake_entries(own)
    path = f"file://{tmp_path}/betting"
    log = sinks.ticket_log(own, legs, entries, path)
    seen = lambda: tuple(log.read(n).count() for n in ("tickets", "legs", "entries"))
    for why, bad in {
        "empty": (own, legs, entries.filter("false")), "doubled": (own.unionByName(own.withColumn("user_id", F.lit(8).cast("long"))), legs, entries),
        "other": (own, legs.unionByName(spark.createDataFrame([(9, 9)], legs.schema)), entries), "25": (own, legs.crossJoin(spark.range(26).select()), entries),
    }.items():
        with pytest.raises(ValueError, match=why):
            sinks.append_tickets(*bad, path)
    assert seen() == (0, 0, 0)
    with monkeypatch.context() as m:  # fails between the tables and the marker
        m.setattr(sinks.CommitLog, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.append_tickets(own, legs, entries, path, "a")
    assert seen() == (0, 0, 0)
    for batch in ("a", "a", "b", None):  # repeated, and again under other names
        sinks.append_tickets(own, legs, entries, path, batch)
        assert seen() == (2, 2, 2)
    more = own.withColumn("wager_id", F.col("wager_id") + 1)  # one ticket is there, one is new
    sinks.append_tickets(more, legs.withColumn("wager_id", F.col("wager_id") + 1), tickets.stake_entries(more), path)
    assert seen() == (3, 3, 2 + 0)
    with pytest.raises(ValueError, match="name"):
        log.stage("a/b", tickets=own)


def test_a_batch_is_published_once(spark, tmp_path):
    found = spark.createDataFrame([(1, 2.0), (2, 3.0)], "market_id long, odds double")
    path = f"file://{tmp_path}/topics"
    for _ in range(2):
        sinks.publish(found, path, "ev", "market_id", "7")
    sinks.publish(found, path, "ev", "market_id", "8")
    sinks.publish(found.limit(1), path, "ev", "market_id")
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 5 and {r.kind for r in rows} == {"ev"}


def test_identities(spark):
    cols = "sport_key string, league_key string, book_key string, event_key string, market_key string, role string, subject string, name string"
    base = ("basketball", "basketball_nba", "pinnacle", "e1", "h2h", "home", None, None)
    alter = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(cols.split(", "), base, strict=True))
    rows = [base, alter(market_key="player_points", role="over", subject="Ann"), alter(market_key="player_points", role="over", subject="Bob"), alter(market_key="outrights", role="outright", name="Red"), alter(event_key="x" * 36), alter(event_key="a b"), alter(event_key=" "), alter(market_key=""), alter(sport_key="", league_key="america_nfl"), alter(market_key="m" * 28), alter(market_key="m" * 29), alter(role="outright"), alter(league_key="--Ünï  League_")]
    got = raw.identities(spark.createDataFrame(rows, cols), "tx").collect()
    h = lambda s: "h" + __import__("hashlib").sha256(s.encode()).hexdigest()[:12]
    assert (got[0].sport_id, got[0].league_id, got[0].book_id, got[0].selection_id) == ("tx.s.basketball", "tx.l.basketball_nba", "tx.b.pinnacle", "tx.e.e1.m.h2h.x.home") and got[0].league_slug == "basketball_nba"
    assert got[1].market_id == "tx.e.e1.m.player_points." + h("Ann") != got[2].market_id and got[1].selection_id == got[1].market_id + ".x.over"
    assert got[3].selection_id == "tx.e.e1.m.outrights.x.outright." + h("Red")
    assert (got[4].event_id, got[5].event_id, got[6].event_id, got[6].selection_id, got[7].market_id) == ("tx.e." + h("x" * 36), "tx.e." + h("a b"), None, None, None)
    assert (got[8].sport_id, got[9].market_id, got[10].market_id, got[11].selection_id) == ("tx.s.america", "tx.e.e1.m." + "m" * 28, "tx.e.e1.m." + h("m" * 29), None)
    assert got[12].league_slug == "n-league" and got[12].league_id == "tx.l." + h("--Ünï  League_")
    two = spark.createDataFrame([("l", "e", "prop", "over", "Ann"), ("l", "e", "prop", "over", "Bob")], "league_id string, event_id string, market_type string, role string, subject string")
    assert len({r.selection_key for r in raw.derive_ids(two, "tx").collect()}) == 2
    assert spark.range(1).select(raw.slug(F.lit("america_nfl")).alias("s")).first().s == "america_nfl"
