"""Raw provider payloads: parsing, normalising to quotes with named rejects, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "id string, sport_key string, league string, home_team string, away_team string, bookmakers array<struct<key:string,last_update:timestamp,markets:array<struct<key:string,last_update:timestamp,outcomes:array<struct<name:string,description:string,price:double,point:double>>>>>>"


def read_payloads(raw: DataFrame) -> DataFrame:
    """Column payload parsed; malformed rows keep their text under reason ``malformed``."""
    own = raw.select("payload", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}).alias("e"))
    return own.withColumn("reason", F.when(F.col("e.id").isNull(), "malformed"))


def normalize(parsed: DataFrame) -> DataFrame:
    """Event, market, book and outcome rows with role, observation instant and reject reason (null: accepted).

    The market's instant counts, else the bookmaker's; without either the row is rejected, as are unknown market
    keys, names that match no side, props without a subject (the player, in the description), prices of one and below,
    and later quotes of a selection and book. Props of one key are told apart by their subject; an outright's runner is
    its subject.
    """
    books = parsed.filter("reason IS NULL").select("e.id", "e.home_team", "e.away_team", F.explode("e.bookmakers").alias("b"))
    marks = books.select("id", "home_team", "away_team", F.col("b.key").alias("book"), F.col("b.last_update").alias("book_at"), F.posexplode("b.markets").alias("mpos", "m"))
    rows = marks.select("id", "home_team", "away_team", "book", "mpos", F.col("m.key").alias("market_key"), F.coalesce("m.last_update", "book_at").alias("observed_at"), F.posexplode("m.outcomes").alias("pos", "o"))
    kind = F.when(F.col("market_key") == "h2h", "moneyline").when(F.col("market_key") == "spreads", "spread").when(F.col("market_key") == "totals", "total").when(F.startswith(F.col("market_key"), F.lit("player_")), "prop").when(F.col("market_key") == "outrights", "outright")
    name = F.lower(F.trim("o.name"))
    role = F.when(name == F.lower(F.trim("home_team")), "home").when(name == F.lower(F.trim("away_team")), "away").when(name.isin("over", "under", "draw"), name).when((F.col("market_key") == "outrights") & (name != ""), "runner")
    subject = F.when(kind == "prop", F.nullif(F.trim("o.description"), F.lit(""))).when(kind == "outright", F.trim("o.name"))
    key = F.when(kind.isin("prop", "outright"), F.col("market_key"))
    rows = rows.select("id", "book", "mpos", "pos", kind.alias("market_type"), key.alias("prop_key"), subject.alias("subject"), role.alias("role"), F.col("o.price").alias("odds"), F.col("o.point").alias("line"), "observed_at")
    first = F.min(F.struct("mpos", "pos"))
    lead = rows.groupBy("id", "book", "market_type", "prop_key", "subject", "role").agg(first.alias("f"))
    same = [rows["id"] == lead["id"], rows["book"] == lead["book"], *[rows[c].eqNullSafe(lead[c]) for c in ("market_type", "prop_key", "subject", "role")]]
    own = rows.join(lead, same).select(rows["*"], "f")
    reason = (
        F.when(F.col("market_type").isNull(), "unknown_market").when((F.col("market_type") == "prop") & F.col("subject").isNull(), "missing_subject").when(F.col("role").isNull(), "unknown_outcome").when(F.col("observed_at").isNull(), "no_observation_time")
        .when(F.isnan("odds") | (F.col("odds") <= 1), "odds_out_of_range").when(F.struct("mpos", "pos") != F.col("f"), "duplicate_quote")
    )
    return own.withColumn("reason", reason).drop("f", "mpos", "pos")


#: Budgets of the parts of an identifier, in bytes; a part beyond its budget, or with a character that is not safe, is hashed.
SHORT_KEY, EVENT_KEY, MARKET_KEY, SLUG = 40, 35, 28, 64


def slug(c: Column) -> Column:
    """Lower case; letters, digits and underscores stay, anything else between them becomes one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "-"), "^[-_]+|[-_]+$", "")


def hash_of(c: Column) -> Column:
    """Twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 12)


def token(c: Column, budget: int = 24) -> Column:
    """A safe token; what is unsafe or too long becomes twelve hex digits of its hash."""
    return F.when(c.rlike(f"^[A-Za-z0-9_-]{{1,{budget}}}$"), c).otherwise(hash_of(c))


def derive_ids(rows: DataFrame, provider: str) -> DataFrame:
    """league_key, event_key, market_key and selection_key from provider, tag and tokens, joined by dots.

    Where rows have a ``subject`` (a player of a prop, a runner), its hash ends the market's key, so props of two players are two markets.
    """
    league = F.concat_ws(".", F.lit(provider), F.lit("l"), token(slug(F.col("league_id"))))
    event = F.concat_ws(".", F.lit(provider), F.lit("e"), token(F.col("event_id").cast("string")))
    own = rows.withColumns({"league_key": league, "event_key": event})
    subject = [hash_of(F.nullif(F.col("subject"), F.lit("")))] if "subject" in rows.columns else []
    own = own.withColumn("market_key", F.concat_ws(".", "event_key", "market_type", *subject))
    return own.withColumn("selection_key", F.concat_ws(".", "market_key", "role"))


def identities(rows: DataFrame, provider: str) -> DataFrame:
    """Adds the identifiers of a provider's row: sport_id, league_id, book_id, event_id, market_id, selection_id, and league_slug.

    Rows have sport_key, league_key, book_key, event_key, market_key, role, and subject (of a prop) and name (of an outright) or null. An identifier is provider, tag and
    token, joined by dots; a market's begins with its event's and a selection's with its market's. A token outside its budget or with an
    unsafe character is an h and its hash. The hash of its subject ends a prop's market, that of its name an outright's selection. An empty sport key is
    the league key up to its first underscore. Identifiers without an event or market key are null.
    """
    def part(c: str, budget: int) -> Column:
        own = F.coalesce(F.col(c), F.lit(""))
        return F.when(own.rlike(f"^[A-Za-z0-9_-]{{1,{budget}}}$"), own).otherwise(F.concat(F.lit("h"), hash_of(own)))

    tagged = lambda tag, c, budget: F.concat_ws(".", F.lit(provider), F.lit(tag), part(c, budget))
    hashed = lambda c: F.concat(F.lit(".h"), hash_of(F.nullif(F.col(c), F.lit(""))))
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    own = rows.withColumn("sport_key", F.when(given("sport_key"), F.col("sport_key")).otherwise(F.regexp_extract("league_key", "^([^_]+)(?:_|$)", 1)))
    event = F.when(given("event_key"), tagged("e", "event_key", EVENT_KEY))
    own = own.withColumns({"sport_id": tagged("s", "sport_key", SHORT_KEY), "league_id": tagged("l", "league_key", SHORT_KEY), "book_id": tagged("b", "book_key", SHORT_KEY), "event_id": event})
    own = own.withColumn("market_id", F.when(given("market_key"), F.concat(F.concat_ws(".", F.col("event_id"), F.lit("m"), part("market_key", MARKET_KEY)), F.coalesce(hashed("subject"), F.lit("")))))
    own = own.withColumn("market_id", F.when(F.col("event_id").isNotNull(), F.col("market_id")))
    name = F.when(F.col("role") == "outright", hashed("name")).otherwise("")  # an outright needs a name
    own = own.withColumn("selection_id", F.when(F.col("market_id").isNotNull(), F.concat(F.concat_ws(".", F.col("market_id"), F.lit("x"), F.col("role")), name)))
    short = F.regexp_replace(F.substring(slug(F.col("league_key")), 1, SLUG), "[-_]+$", "")
    return own.withColumn("league_slug", F.when(short == "", F.concat(F.lit("h"), hash_of(F.col("league_key")))).otherwise(short))
