"""Reads and table upkeep: histories, pages, upserts, slowly changing rows and deduplicated appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlc(quotes: DataFrame, width: str, *keys: str) -> DataFrame:
    """Epoch-aligned buckets: open, high, low, close, close line (0 with has_line false where absent), samples."""
    own = quotes.groupBy(*keys, F.window("observed_at", width).alias("w")).agg(
        F.min_by("odds", "observed_at").alias("open"), F.max("odds").alias("high"), F.min("odds").alias("low"), F.max_by("odds", "observed_at").alias("close"),
        F.max_by(F.struct("line"), "observed_at").alias("last"), F.bool_or(F.col("line").isNotNull()).alias("has_line"), F.count("*").alias("samples"),
    )
    return own.select(*keys, F.col("w.start").alias("bucket"), "open", "high", "low", "close", F.coalesce("last.line", F.lit(0.0)).alias("close_line"), "has_line", "samples")


def append_new(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch to append: duplicates within it and of existing keys are ignored."""
    return batch.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti")


def upsert_newest(current: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key; on equal instants the incoming one wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "_new")).alias("r"))
    return best.select(*keys, "r.*").select(current.columns)


def apply_results(events: DataFrame, results: DataFrame, terminal: tuple[str, ...] = ("final", "cancelled")) -> DataFrame:
    """Terminal status and score onto open events; never inserts, never reopens."""
    new = results.select("event_id", *[F.col(c).alias(f"_{c}") for c in ("status", "home_score", "away_score")])
    take = ~F.col("status").isin(*terminal) & F.col("_status").isin(*terminal)
    own = events.join(new, "event_id", "left")
    return own.select(*[F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("status", "home_score", "away_score") else F.col(c) for c in events.columns])


def set_status(accounts: DataFrame, requests: DataFrame, key: str, terminal: tuple[str, ...]) -> DataFrame:
    """Requested statuses (one a key) onto accounts: unknown keys add nothing, a terminal status stays as it is."""
    own = accounts.join(requests.select(key, F.col("status").alias("_new")), key, "left")
    take = F.col("_new").isNotNull() & ~F.coalesce(F.col("status").isin(*terminal), F.lit(False))
    return own.withColumn("status", F.when(take, F.col("_new")).otherwise(F.col("status"))).drop("_new")


def superseded(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each row with the instant at which the next one of its key replaces it."""
    return rows.withColumn("superseded_at", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def page_after(rows: DataFrame, order: list[tuple[str, bool]], cursor: list, limit: int) -> DataFrame:
    """The page behind a cursor: order columns with descending flags; compared column by column, cut by a top-k."""
    cond: Column = F.lit(False)
    for i, ((c, desc), v) in enumerate(zip(order, cursor, strict=True)):
        same = F.lit(True)
        for (b, _), w in zip(order[:i], cursor[:i], strict=True):
            same = same & (F.col(b) == w)
        cond = cond | (same & (F.col(c) < v if desc else F.col(c) > v))
    return rows.filter(cond).orderBy(*[F.desc(c) if desc else F.asc(c) for c, desc in order]).limit(limit)


def consensus_line(quotes: DataFrame) -> DataFrame:
    """A market's line: the mode of its quotes' home lines, the smallest on ties."""
    counts = quotes.filter("home_line IS NOT NULL").groupBy("market_id", "home_line").agg(F.count("*").alias("n"))
    return counts.groupBy("market_id").agg(F.max_by("home_line", F.struct("n", (-F.col("home_line")).alias("x"))).alias("line"), F.max("n").alias("votes"))


def apply_results_guarded(events: DataFrame, results: DataFrame, terminal: tuple[str, ...] = ("final", "cancelled")) -> DataFrame:
    """Terminal status and score onto open events, as ``apply_results``, and with the guards of a row that has its own clock.

    Events and results have ``observed_at``. A result older than the event's row changes nothing; one that is taken sets observed_at and
    clears the game clock (columns ``clock_*``, where events have them). Of results of one event the newest terminal one counts.
    """
    value = ("status", "home_score", "away_score", "observed_at")
    best = results.filter(F.col("status").isin(*terminal)).groupBy("event_id").agg(F.max_by(F.struct(*value), F.struct("observed_at", "status", "home_score", "away_score")).alias("_r"))
    own = events.join(best, "event_id", "left")
    take = F.col("_r").isNotNull() & ~F.col("status").isin(*terminal) & (F.col("observed_at") <= F.col("_r.observed_at"))
    new = lambda c: F.col(f"_r.{c}") if c in value else F.lit(None)
    return own.select(*[F.when(take, new(c)).otherwise(F.col(c)).alias(c) if c in value or c.startswith("clock_") else F.col(c) for c in events.columns])


def upsert_distinct(current: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table after an upsert, with ``change``: inserted, updated, or null where the incoming row is older or says the same.

    Rows are compared in all columns but ``at``; an equal row keeps the one that is there, instant and all, so nothing is rewritten for it.
    """
    rest = [c for c in current.columns if c not in keys]
    said = [c for c in rest if c != at]
    new = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *said)).alias("_n"))
    old = current.select(*keys, F.struct(*rest).alias("_o"))
    both = old.join(new, keys, "full")
    differs = F.lit(False)
    for c in said:
        differs = differs | ~F.col(f"_n.{c}").eqNullSafe(F.col(f"_o.{c}"))
    change = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNotNull() & (F.col(f"_n.{at}") >= F.col(f"_o.{at}")) & differs, "updated")
    both = both.withColumn("change", change)
    return both.select(*keys, F.when(F.col("change").isNotNull(), F.col("_n")).otherwise(F.col("_o")).alias("r"), "change").select(*keys, "r.*", "change").select(*current.columns, "change")


def filter_mark(filters: dict[str, object]) -> str:
    """A page's filters as a short text that is part of its cursor."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def bound_page(rows: DataFrame, filters: dict[str, object], order: list[tuple[str, bool]], cursor: dict | None, limit: int) -> DataFrame:
    """A page of filtered rows behind a cursor that was given out for the same filters; with other ones it is refused.

    ``filters`` are column: value (a list: any of them). A cursor is {"filters": filter_mark(...), "after": [values of the order's columns]};
    ``cursor_of`` makes one of a page's last row. The order must end in a unique column.
    """
    for c, v in filters.items():
        rows = rows.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    if cursor is None:
        return rows.orderBy(*[F.desc(c) if desc else F.asc(c) for c, desc in order]).limit(limit)
    if cursor["filters"] != filter_mark(filters):
        raise ValueError("the cursor belongs to other filters")
    return page_after(rows, order, cursor["after"], limit)


def cursor_of(last, filters: dict[str, object], order: list[tuple[str, bool]]) -> dict:
    return {"filters": filter_mark(filters), "after": [last[c] for c, _ in order]}


PRICE_MATCH = 1e-9


def price_moves(slips: DataFrame, current: DataFrame) -> DataFrame:
    """What became of the price and line that a slip's leg has seen: ``move`` and whether the leg goes through (``passes``).

    Slips: leg_id, selection_id, book_id, seen_odds, seen_line, accept_better, and accept_odds and accept_line (a move that the user has confirmed, or null). Current: selection_id,
    book_id, odds, line. Prices match within a relative 1e-9; an absent line differs from zero. Moves: gone (no quote), same, line_moved,
    improved (the line stands and the price is longer) or worse. A confirmed move passes only if it is what the price is now; without one
    a better price passes where the slip accepts better prices; a moved line never passes unconfirmed.
    """
    now = current.select("selection_id", "book_id", F.col("odds").alias("now_odds"), F.col("line").alias("now_line"))
    own = slips.join(now, ["selection_id", "book_id"], "left")
    match = lambda a, b: (a == b) | ((F.greatest(F.abs(a), F.abs(b)) > 0) & (F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))) <= PRICE_MATCH))
    odds, line = F.col("now_odds"), F.col("now_line")
    same_line = F.col("seen_line").eqNullSafe(line)
    move = F.when(odds.isNull(), "gone").when(~same_line, "line_moved").when(match(F.col("seen_odds"), odds), "same").when(odds > F.col("seen_odds"), "improved").otherwise("worse")
    own = own.withColumn("move", move)
    confirmed = F.col("accept_odds").isNotNull()
    passes = F.when(F.col("move") == "gone", False).when(F.col("move") == "same", True).when(confirmed, match(F.col("accept_odds"), odds) & F.col("accept_line").eqNullSafe(line)).otherwise(F.col("accept_better") & (F.col("move") == "improved"))
    return own.withColumn("passes", F.coalesce(passes, F.lit(False)))
