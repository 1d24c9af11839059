"""Steam: coordinated moves of several books inside hopping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.operators.changes import rested

#: Defaults of the rules.
WINDOW, HOP, COOLDOWN = "180 seconds", "60 seconds", 300.0
MIN_DELTA, MAX_LAG, NOISE, MIN_FOLLOWERS, MIN_CORRELATION = 0.05, 120.0, 0.005, 1, 0.5


def window_points(ticks: DataFrame, window: str = WINDOW, hop: str = HOP) -> DataFrame:
    """The points of every window, selection and book: w, implied and observed_at."""
    return ticks.select(F.window("observed_at", window, hop).alias("w"), "selection_id", "book_id", "implied", "observed_at")


def first_last(points: DataFrame) -> DataFrame:
    """Last less first value, and the points, of every window, selection and book: an aggregate of bounded size."""
    order = F.struct("observed_at", "implied")
    per = points.groupBy("w", "selection_id", "book_id").agg(F.min_by("implied", order).alias("first"), F.max_by("implied", order).alias("last"), F.count("*").alias("n"))
    return per.select("w", "selection_id", "book_id", (F.col("last") - F.col("first")).alias("delta"), "n")


def largest_steps(points: DataFrame) -> DataFrame:
    """The end of the largest step up and of the largest step down of every window, selection and book; the earliest of equals."""
    order = Window.partitionBy("w", "selection_id", "book_id").orderBy("observed_at", "implied")
    own = points.withColumn("step", F.col("implied") - F.lag("implied").over(order)).filter("step IS NOT NULL")
    end = F.unix_micros("observed_at")
    return own.groupBy("w", "selection_id", "book_id").agg(*[F.min_by(end, F.struct((F.col("step") * s).alias("s"), end.alias("t"))).alias(k) for s, k in ((-1.0, "up_us"), (1.0, "down_us"))])


def moves(ticks: DataFrame, window: str = WINDOW, hop: str = HOP) -> DataFrame:
    """Per window, selection and book with two or more points: last less first, and when the largest step in its direction ended."""
    return moves_of(window_points(ticks, window, hop))


def moves_of(points: DataFrame) -> DataFrame:
    """``moves`` of the points of windows. No array of points is built: one sort by key and time, and aggregates."""
    order = Window.partitionBy("w", "selection_id", "book_id").orderBy("observed_at", "implied")
    own = points.withColumn("step", F.col("implied") - F.lag("implied").over(order))
    end, at = F.unix_micros("observed_at"), F.struct("observed_at", "implied")
    rank = lambda s: F.struct((F.col("step") * s).alias("s"), end.alias("t"))
    per = own.groupBy("w", "selection_id", "book_id").agg(
        (F.max_by("implied", at) - F.min_by("implied", at)).alias("delta"), F.count("*").alias("n"),
        *[F.min_by(F.when(F.col("step").isNotNull(), end), F.when(F.col("step").isNotNull(), rank(s))).alias(k) for s, k in ((-1.0, "up_us"), (1.0, "down_us"), (0.0, "flat_us"))],
    )
    moved = F.when(F.col("delta") > 0, F.col("up_us")).when(F.col("delta") < 0, F.col("down_us")).otherwise(F.col("flat_us"))
    return per.filter("n >= 2").select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "selection_id", "book_id", "delta", moved.alias("moved_us"))


def candidates(moved: DataFrame, min_delta: float = MIN_DELTA, max_lag: float = MAX_LAG, minutes: float = 3.0, min_correlation: float = MIN_CORRELATION, min_followers: int = MIN_FOLLOWERS) -> DataFrame:
    """The lead book of every window and selection, its followers, and the thresholds."""
    key = ["window_start", "window_end", "selection_id"]
    order = Window.partitionBy(*key).orderBy("moved_us", F.desc(F.abs("delta")), "book_id")
    lead = moved.filter(F.abs("delta") >= min_delta).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    lead = lead.select(*key, F.col("book_id").alias("lead_book_id"), F.col("delta").alias("lead_delta"), F.col("moved_us").alias("lead_us"))
    both = moved.join(lead, key)
    lag = (F.col("moved_us") - F.col("lead_us")) / 1_000_000
    follows = (F.col("book_id") != F.col("lead_book_id")) & (F.abs("delta") >= min_delta) & (F.signum("delta") == F.signum("lead_delta")) & (lag >= 0) & (lag <= max_lag)
    vote = F.when(F.abs("delta") < NOISE, 0.0).when(F.signum("delta") == F.signum("lead_delta"), 1.0).otherwise(-1.0)
    out = both.groupBy(*key, "lead_book_id", "lead_delta", "lead_us").agg(
        F.array_sort(F.collect_list(F.when(follows, F.struct(lag.alias("lag_seconds"), "book_id", "delta")))).alias("followers"), F.avg(vote).alias("correlation"), F.count("*").alias("participating_books"),
    )
    fine = (F.size("followers") >= min_followers) & (F.abs("lead_delta") / minutes >= min_delta / minutes) & (F.col("correlation") >= min_correlation)
    return out.filter(fine).withColumn("direction", F.when(F.col("lead_delta") > 0, "up").otherwise("down"))


def with_cooldown(found: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    """Findings left after each (selection, direction) rests for ``cooldown`` seconds behind the last one emitted."""
    own = rested(found.withColumn("end_us", F.unix_micros("window_end")), ["selection_id", "direction"], "end_us", cooldown)
    return own.filter("kept").drop("kept", "end_us")


def votes(moved: DataFrame, min_delta: float = MIN_DELTA) -> DataFrame:
    """Correlation of every window and selection with a lead: the mean vote (with, against, or none below the noise floor)."""
    return candidates(moved, min_delta, max_lag=float("inf"), min_correlation=-1.0, min_followers=0).select("window_start", "selection_id", "lead_book_id", "correlation", "participating_books")
