"""The model's tables as views over the given ones, and the same derivation as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_SQL = """
WITH RECURSIVE
markets AS (
    SELECT p_partkey AS market_id, (p_partkey - 1) // 3 AS event_id, p_brand AS league_id, p_type AS sport_id,
           CASE p_size % 3 WHEN 0 THEN 'moneyline' WHEN 1 THEN 'spread' ELSE 'total' END AS market_type,
           CAST(CASE p_size % 3 WHEN 1 THEN (p_size % 7) - 3 + 0.5 WHEN 2 THEN 40.5 + p_size % 10 END AS DOUBLE) AS line,
           p_name AS name
    FROM part),
raw_quotes AS (
    SELECT m.market_id, m.event_id, m.league_id, m.market_type, m.market_id * 2 + l_linenumber % 2 AS selection_id,
           CASE WHEN m.market_type = 'total' THEN CASE l_linenumber % 2 WHEN 0 THEN 'over' ELSE 'under' END
                ELSE CASE l_linenumber % 2 WHEN 0 THEN 'home' ELSE 'away' END END AS role,
           CAST(l_suppkey % 5 AS INTEGER) AS book_id,
           1.70::DOUBLE + ((l_orderkey * 7 + l_suppkey * 3) % 60)::DOUBLE / 100.0::DOUBLE AS odds,
           m.line + CASE WHEN l_suppkey % 5 = 4 THEN 0.5 ELSE 0 END AS home_line,
           l_shipdate + to_seconds(l_orderkey % 86400) AS observed_at, l_orderkey
    FROM lineitem JOIN markets m ON m.market_id = l_partkey),
quotes AS (
    SELECT market_id, event_id, league_id, market_type, selection_id, role, book_id, odds,
           CASE WHEN role = 'away' AND market_type = 'spread' THEN CASE WHEN home_line = 0 THEN 0.0 ELSE -home_line END ELSE home_line END AS line,
           observed_at
    FROM raw_quotes
    QUALIFY row_number() OVER (PARTITION BY selection_id, book_id, observed_at ORDER BY l_orderkey, odds) = 1),
latest AS (
    SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY selection_id, book_id ORDER BY observed_at DESC) = 1),
games AS (
    SELECT event_id, min(league_id) AS league_id, min(name) AS home, max(name) AS away,
           CASE event_id % 7 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'live' WHEN 2 THEN 'postponed' ELSE 'final' END AS status,
           TIMESTAMP '1996-06-01' + to_hours(CAST(event_id * 37 % 8760 AS INTEGER)) AS scheduled_start,
           CAST(80 + event_id * 7 % 40 AS INTEGER) AS home_score, CAST(80 + event_id * 11 % 40 AS INTEGER) AS away_score
    FROM markets GROUP BY event_id),
suspensions AS (
    SELECT market_id, TIMESTAMP '1996-01-01' + to_days(CAST(market_id % 300 AS INTEGER)) AS suspended_at,
           TIMESTAMP '1996-01-01' + to_days(CAST(market_id % 300 + 20 AS INTEGER)) AS lifted_at
    FROM markets WHERE market_id % 10 = 0),
tickets AS (
    SELECT o_orderkey AS wager_id, o_custkey AS user_id, CAST(round(o_totalprice * 100) AS BIGINT) AS stake_minor,
           CASE o_orderkey % 3 WHEN 0 THEN 'half_even' WHEN 1 THEN 'half_away' ELSE 'toward_zero' END AS rounding,
           o_orderdate AS placed_at
    FROM orders),
legs AS (
    SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS leg_id,
           l_orderkey AS wager_id, m.event_id, m.market_id, m.market_type, m.league_id, m.market_id * 2 + l_linenumber % 2 AS selection_id,
           CASE WHEN m.market_type = 'total' THEN CASE l_linenumber % 2 WHEN 0 THEN 'over' ELSE 'under' END
                ELSE CASE l_linenumber % 2 WHEN 0 THEN 'home' ELSE 'away' END END AS role,
           CAST(l_suppkey % 5 AS INTEGER) AS book_id,
           1.70::DOUBLE + ((l_orderkey * 7 + l_suppkey * 3) % 60)::DOUBLE / 100.0::DOUBLE AS odds,
           m.line + CASE WHEN l_suppkey % 5 = 4 THEN 0.5 ELSE 0 END AS home_line,
           l_shipdate + to_seconds(l_orderkey % 86400) AS taken_at
    FROM lineitem JOIN markets m ON m.market_id = l_partkey),
ticks AS (
    SELECT event_type AS selection_id, CAST(user_id % 5 AS INTEGER) AS book_id, 0.05 + 0.9 * (value - 100 * floor(value / 100)) / 100 AS implied, ts AS observed_at, event_id AS tick_id
    FROM events)
"""


class Views:
    """The model's tables; each is derived lazily, and only the columns a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def markets(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("market_id"), ((F.col("p_partkey") - 1) / 3).cast("long").alias("event_id"), F.col("p_brand").alias("league_id"), F.col("p_type").alias("sport_id"),
            F.when(size % 3 == 0, "moneyline").when(size % 3 == 1, "spread").otherwise("total").alias("market_type"),
            F.when(size % 3 == 1, (size % 7) - 3 + F.lit(0.5)).when(size % 3 == 2, F.lit(40.5) + size % 10).cast("double").alias("line"), F.col("p_name").alias("name"),
        )

    def _with_markets(self, lines: DataFrame) -> DataFrame:
        """Join the markets; adds role, line (selection frame) and home_line."""
        role = F.when(F.col("market_type") == "total", F.when(F.col("side") == 0, "over").otherwise("under")).otherwise(F.when(F.col("side") == 0, "home").otherwise("away"))
        home = F.col("line") + F.when(F.col("book_id") == 4, 0.5).otherwise(0.0)
        away = (F.col("side") == 1) & (F.col("market_type") == "spread")
        markets = self.markets.select("market_id", "event_id", "league_id", "market_type", "line")
        return lines.join(markets, "market_id").withColumns({
            "selection_id": F.col("market_id") * 2 + F.col("side"), "role": role, "home_line": home,
            "line": F.when(away, F.when(home == 0, 0.0).otherwise(-home)).otherwise(home),
        })

    def _lines(self, *more: str) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("market_id"), (F.col("l_linenumber") % 2).alias("side"), (F.col("l_suppkey") % 5).cast("int").alias("book_id"),
            (F.lit(1.70) + ((F.col("l_orderkey") * 7 + F.col("l_suppkey") * 3) % 60).cast("double") / F.lit(100.0)).alias("odds"),
            F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 86400 * 1_000_000).alias("observed_at"), "l_orderkey", *more,
        )

    @cached_property
    def quotes(self) -> DataFrame:
        """One quote for each selection, book and instant: the one of the lowest order key (an aggregate, not a sort).

        Lines are dealt by market once; the aggregate and the join with the markets find them there.
        """
        keys = ["market_id", "side", "book_id", "observed_at"]
        best = self._lines().repartition("market_id").groupBy(*keys).agg(F.min(F.struct("l_orderkey", "odds")).alias("q"))
        own = self._with_markets(best.select(*keys, F.col("q.odds").alias("odds")))
        return own.select("market_id", "event_id", "league_id", "market_type", "selection_id", "role", "book_id", "odds", "line", "observed_at")

    @cached_property
    def latest(self) -> DataFrame:
        from tickline.operators.pricing import newest

        return newest(self.quotes)

    @cached_property
    def games(self) -> DataFrame:
        e = F.col("event_id")
        return self.markets.groupBy("event_id").agg(F.min("league_id").alias("league_id"), F.min("name").alias("home"), F.max("name").alias("away")).select(
            "event_id", "league_id", "home", "away", F.when(e % 7 == 0, "scheduled").when(e % 7 == 1, "live").when(e % 7 == 2, "postponed").otherwise("final").alias("status"),
            F.timestamp_micros(F.lit(833_587_200_000_000) + e * 37 % 8760 * 3_600_000_000).alias("scheduled_start"), (80 + e * 7 % 40).cast("int").alias("home_score"), (80 + e * 11 % 40).cast("int").alias("away_score"),
        )

    @cached_property
    def suspensions(self) -> DataFrame:
        day = lambda extra: F.timestamp_micros(F.lit(820_454_400_000_000) + (F.col("market_id") % 300 + extra) * 86_400_000_000)
        return self.markets.filter("market_id % 10 = 0").select("market_id", day(0).alias("suspended_at"), day(20).alias("lifted_at"))

    @cached_property
    def tickets(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("wager_id"), F.col("o_custkey").alias("user_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("stake_minor"),
            F.when(k % 3 == 0, "half_even").when(k % 3 == 1, "half_away").otherwise("toward_zero").alias("rounding"), F.col("o_orderdate").cast("timestamp").alias("placed_at"),
        )

    @cached_property
    def legs(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "market_id", "l_suppkey", "l_quantity", "l_extendedprice")
        numbered = self._lines("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").withColumn("leg_id", F.col("l_orderkey") * 1000 + F.row_number().over(order))
        return self._with_markets(numbered).select("leg_id", F.col("l_orderkey").alias("wager_id"), "event_id", "market_id", "market_type", "league_id", "selection_id", "role", "book_id", "odds", "home_line", F.col("observed_at").alias("taken_at"))

    @cached_property
    def ticks(self) -> DataFrame:
        v = F.col("value")
        return self.table("events").select(F.col("event_type").alias("selection_id"), (F.col("user_id") % 5).cast("int").alias("book_id"), (0.05 + 0.9 * (v - 100 * F.floor(v / 100)) / 100).alias("implied"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("tick_id"))
