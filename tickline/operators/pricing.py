"""Market pricing: snapshots, the reference book, fair values, assessments, arbitrage and middles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickline.functions import odds as O

#: Defaults of the rules, in seconds or plain numbers.
MAX_REFERENCE_AGE, MAX_QUOTE_AGE, EV_MAX_AGE = 300.0, 600.0, 180.0
MIN_EV_PERCENT, MIN_ARB_RETURN, ARB_SPREAD, ARB_AGE = 1.0, 0.001, 30.0, 120.0
ARB_SIGNAL_AGE, ARB_SIGNAL_SPREAD, ARB_SIGNAL_RETURN = 60.0, 20.0, 0.005
MIN_MIDDLE_WIDTH = 0.5
KELLY_MULTIPLIER = 0.25


def newest(quotes: DataFrame) -> DataFrame:
    """The newest quote of every selection and book: a partial aggregate, no window sort."""
    rest = [c for c in quotes.columns if c not in ("selection_id", "book_id")]
    best = quotes.groupBy("selection_id", "book_id").agg(F.max_by(F.struct(*rest), "observed_at").alias("q"))
    return best.select("selection_id", "book_id", "q.*").select(quotes.columns)


def book_snapshots(latest: DataFrame) -> DataFrame:
    """A row for every market and book: prices by selection, oldest and newest instant, whether complete, and the market's anchor."""
    n = latest.groupBy("market_id").agg(F.countDistinct("selection_id").alias("n_selections"), F.max("observed_at").alias("anchor"))
    own = latest.groupBy("market_id", "league_id", "market_type", "book_id").agg(
        F.array_sort(F.collect_list(F.struct("selection_id", "role", "odds", "line", "observed_at"))).alias("quotes"),
        F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"), F.count("*").alias("n_quoted"),
    )
    return own.join(n.filter("n_selections >= 2"), "market_id").withColumn("complete", F.col("n_quoted") == F.col("n_selections"))


def reference_order(flagged: tuple[int, ...], preferred: tuple[int, ...]) -> list[int]:
    """The candidate books in order: flagged ones by their place in the preferences, then by id; then preferred ones that are not flagged."""
    place = {b: i for i, b in reversed([*enumerate(preferred)])}
    return [*sorted(set(flagged), key=lambda b: (place.get(b, len(preferred)), b)), *(b for b in dict.fromkeys(preferred) if b not in flagged)]


def resolve_reference(books: DataFrame, flagged: tuple[int, ...] = (0,), preferred: tuple[int, ...] = (), max_age: float = MAX_REFERENCE_AGE) -> DataFrame:
    """A market's reference book: the first by ``reference_order`` that is complete and fresh.

    Only flagged or preferred books are candidates. Without one, book is null and reason is the first candidate's.
    """
    candidates = reference_order(flagged, preferred)
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col("book_id"))
    age = O.age_seconds(F.col("anchor"), F.col("oldest"))
    reason = F.when(~F.col("complete"), "incomplete").when(age > max_age, "stale")
    own = books.withColumns({"rank": rank, "reason": reason}).filter(F.col("book_id").isin(candidates))
    best = own.groupBy("market_id").agg(F.min(F.when(F.col("reason").isNull(), F.col("rank"))).alias("rank"), F.min_by("reason", "rank").alias("reason"))
    every = books.groupBy("market_id").agg(F.first("market_type").alias("market_type"), F.first("anchor").alias("anchor"))
    found = every.join(best, "market_id", "left")
    ids = F.array(*map(F.lit, candidates))
    return found.select("market_id", "market_type", "anchor", F.when(F.col("rank").isNotNull(), F.element_at(ids, F.col("rank").cast("int"))).alias("reference_book_id"), F.when(F.col("rank").isNull(), F.coalesce("reason", F.lit("absent"))).alias("reason"))


def reference_books(books: DataFrame, flagged: tuple[int, ...] = (0,), preferred: tuple[int, ...] = (), max_age: float = MAX_REFERENCE_AGE) -> DataFrame:
    """The snapshot of each market's reference book, as ``resolve_reference`` finds it; no join, one pass by market."""
    candidates = reference_order(flagged, preferred)
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col("book_id"))
    fine = F.col("book_id").isin(candidates) & F.col("complete") & (O.age_seconds(F.col("anchor"), F.col("oldest")) <= max_age)
    own = books.filter(fine).withColumn("rank", rank)
    return own.withColumn("best", F.min("rank").over(Window.partitionBy("market_id"))).filter("rank = best").drop("rank", "best")


def fair_values(books: DataFrame, reference: DataFrame, method: str = "shin") -> DataFrame:
    """A row for every selection of a market with a reference: fair probability, fair decimal, disagreement, margin."""
    ref = books.join(reference.filter("reference_book_id IS NOT NULL").select("market_id", F.col("reference_book_id").alias("book_id")), ["market_id", "book_id"])
    return fair_of(ref, method)


def fair_of(ref: DataFrame, method: str = "shin") -> DataFrame:
    """Fair values from the snapshots of reference books."""
    p = F.transform("quotes", lambda q: 1 / q["odds"])
    ref = ref.withColumn("p", p)
    every = {m: O.finish(f(F.col("p"))) for m, f in O.METHODS.items()}
    ref = ref.withColumns({f"q_{m}": q for m, q in every.items()})
    used = F.coalesce(f"q_{method}", "q_multiplicative")
    # two outcomes are equally far off, so the favourite's distance is both's; told apart by last digits, equal ones would pass a gate or not
    favourite = F.array_position("p", F.array_max("p")).cast("int")
    far = lambda m: F.when(F.size("p") == 2, F.abs(F.element_at(used, favourite) - F.element_at(F.col(f"q_{m}"), favourite))).otherwise(F.array_max(F.zip_with(used, F.col(f"q_{m}"), lambda a, b: F.abs(a - b))))
    gap = F.array_max(F.array(*[F.coalesce(far(m), F.lit(-1.0)) for m in O.METHODS]))
    ref = ref.withColumns({"q": used, "fallback": F.col(f"q_{method}").isNull(), "disagreement": gap, "overround": O.compensated(F.col("p")) - 1}).filter("q IS NOT NULL")
    flat = ref.select("market_id", F.col("book_id").alias("reference_book_id"), "fallback", "disagreement", "overround", F.explode(F.arrays_zip("quotes", "q")).alias("z"))
    return flat.select(
        "market_id", F.col("z.quotes.selection_id").alias("selection_id"), "reference_book_id", F.col("z.quotes.line").alias("ref_line"), F.col("z.q").alias("fair_prob"),
        (1 / F.col("z.q")).alias("fair_decimal"), "fallback", "disagreement", "overround",
    )


def assess(latest: DataFrame, fair: DataFrame, max_quote_age: float = MAX_QUOTE_AGE) -> DataFrame:
    """Every challenger quote with its status and, where priced, its value against the fair probability.

    Status in order: no_fair_value, stale (the book's oldest quote), no_reference_quote, line_mismatch, priced.
    """
    book = latest.groupBy("market_id", "book_id").agg(F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"))
    book = book.withColumn("anchor", F.max("newest").over(Window.partitionBy("market_id"))).drop("newest")
    # one row a market: its selections' fair values, so that quotes meet them by the market they are dealt by
    rest = [c for c in fair.columns if c not in ("market_id", "selection_id")]
    priced = fair.groupBy("market_id").agg(F.collect_list(F.struct("selection_id", *rest)).alias("fair"))
    own = latest.join(book, ["market_id", "book_id"]).join(priced, "market_id", "left")
    own = own.withColumn("f", F.try_element_at(F.filter("fair", lambda x: x["selection_id"] == F.col("selection_id")), F.lit(1)))
    own = own.select(*[c for c in own.columns if c not in ("fair", "f")], F.col("fair").isNotNull().alias("has_fair"), *[F.col(f"f.{c}").alias(c) for c in rest])
    status = (
        F.when(~F.col("has_fair"), "no_fair_value").when(O.age_seconds(F.col("anchor"), F.col("oldest")) > max_quote_age, "stale")
        .when(F.col("fair_prob").isNull(), "no_reference_quote").when(~F.col("line").eqNullSafe(F.col("ref_line")), "line_mismatch").otherwise("priced")
    )
    q, d = F.col("fair_prob"), F.col("odds")
    only = lambda c: F.when(F.col("status") == "priced", c)
    own = own.withColumn("status", status).filter(F.col("reference_book_id").isNull() | (F.col("book_id") != F.col("reference_book_id")))
    return own.withColumns({"ev": only(O.ev(q, d)), "edge": only(O.edge(q, d)), "kelly": only(O.kelly(q, d)), "age": O.age_seconds(F.col("anchor"), F.col("observed_at"))})


def ev_outcomes(assessed: DataFrame, min_percent: float = MIN_EV_PERCENT, max_age: float = EV_MAX_AGE, ratio: float = 1.0) -> DataFrame:
    """Adds ``outcome``: the first gate that a quote fails, or signal."""
    # a ratio of zero is no gate, and then the methods need not be compared
    uncertain = (F.col("disagreement") >= 0) & (F.col("ev") < ratio * F.col("disagreement") * F.col("odds")) if ratio else F.lit(False)
    outcome = (
        F.when(F.col("status") != "priced", F.col("status")).when(F.col("ev") <= 0, "not_positive").when(F.col("ev") * 100 < min_percent, "below_threshold")
        .when(F.col("age") > max_age, "too_old").when(uncertain, "within_disagreement").otherwise("signal")
    )
    return assessed.withColumn("outcome", outcome)


def rank_ev(signals: DataFrame, limit: int) -> DataFrame:
    """The strongest findings, in a total order."""
    return signals.orderBy(F.desc("ev"), F.desc("observed_at"), F.desc("selection_id"), F.desc("book_id")).limit(limit)


def capped(signals: DataFrame, per_market: int) -> DataFrame:
    order = Window.partitionBy("market_id").orderBy(F.desc("ev"), F.desc("observed_at"), F.desc("selection_id"), F.desc("book_id"))
    return signals.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_market).drop("rn")


def best_quotes(latest: DataFrame, max_age: float = ARB_AGE) -> DataFrame:
    """The best fresh quote of each market, home line and selection: longest odds, fresher, lower book."""
    home = O.home_frame(F.col("role"), F.col("market_type"), F.col("line"))
    anchor = latest.groupBy("market_id").agg(F.max("observed_at").alias("anchor"), F.countDistinct("selection_id").alias("n_selections"))
    own = latest.join(anchor, "market_id").withColumn("home_line", home).withColumn("age", O.age_seconds(F.col("anchor"), F.col("observed_at"))).filter(F.col("age") <= max_age)
    key = F.struct(F.col("odds"), F.col("observed_at"), (-F.col("book_id")).alias("b"))
    return own.groupBy("market_id", "league_id", "market_type", "n_selections", "home_line", "selection_id").agg(F.max_by(F.struct("role", "book_id", "odds", "line", "observed_at", "age"), key).alias("b")).select("*", "b.*").drop("b")


def arbitrages(latest: DataFrame, max_age: float = ARB_AGE, max_spread: float = ARB_SPREAD, min_return: float = MIN_ARB_RETURN) -> DataFrame:
    """Markets and home lines whose best quotes cover every selection below one: stakes by leg, return, fingerprint."""
    best = best_quotes(latest, max_age)
    leg = F.struct("selection_id", "role", "book_id", "odds", "line", "observed_at", "age")
    own = best.groupBy("market_id", "league_id", "market_type", "n_selections", "home_line").agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    own = own.filter(F.size("legs") == F.col("n_selections"))
    s = O.compensated(F.transform("legs", lambda x: 1 / x["odds"]))
    times = F.transform("legs", lambda x: F.unix_micros(x["observed_at"]))
    own = own.withColumns({"implied_sum": s, "spread_seconds": (F.array_max(times) - F.array_min(times)) / 1_000_000, "oldest_us": F.array_min(times), "distinct_books": F.size(F.array_distinct(F.transform("legs", lambda x: x["book_id"])))})
    own = own.withColumn("return_fraction", (1 - F.col("implied_sum")) / F.col("implied_sum"))
    own = own.filter((1 - F.col("implied_sum") > 1e-12) & (F.col("return_fraction") >= min_return) & (F.col("spread_seconds") <= max_spread))
    own = own.withColumn("legs", F.transform("legs", lambda x: x.withField("stake", 1 / x["odds"] / F.col("implied_sum"))))
    return own.withColumn("fingerprint", fingerprint(F.col("legs")))


def arb_outcomes(arbs: DataFrame, max_age: float = ARB_SIGNAL_AGE, max_spread: float = ARB_SIGNAL_SPREAD, min_return: float = ARB_SIGNAL_RETURN, min_books: int = 1, open_markets: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome`` to arbitrages: the first gate that one fails, or signal. The ages are those of its oldest leg.

    Gates in order: market_closed (where ``open_markets`` lists the open ones), stale_leg, wide_spread, thin_return, too_few_books, out_of_range.
    """
    own = arbs.withColumn("oldest_leg_age", F.array_max(F.transform("legs", lambda x: x["age"])))
    closed = F.lit(False)
    if open_markets is not None:
        own = own.join(open_markets.select("market_id").distinct().withColumn("is_open", F.lit(True)), "market_id", "left")
        closed = F.col("is_open").isNull()
    odd = F.exists("legs", lambda x: F.isnan(x["odds"]) | (x["odds"] <= 1) | (x["odds"] > 100_000) | (x["age"] < 0)) | (F.col("implied_sum") <= 0)
    outcome = (
        F.when(closed, "market_closed").when(F.col("oldest_leg_age") > max_age, "stale_leg").when(F.col("spread_seconds") > max_spread, "wide_spread")
        .when(F.col("return_fraction") < min_return, "thin_return").when(F.col("distinct_books") < min_books, "too_few_books").when(odd, "out_of_range").otherwise("signal")
    )
    return own.withColumn("outcome", outcome).drop("is_open")


def scan_counters(**scans: DataFrame) -> DataFrame:
    """kind, outcome and n: how many rows of each scan (ev, arb, ...) left it by which gate, in one aggregate; they add up to the rows examined."""
    kinds = [df.select(F.lit(kind).alias("kind"), "outcome") for kind, df in scans.items()]
    own = kinds[0]
    for df in kinds[1:]:
        own = own.unionByName(df)
    return own.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def fingerprint(legs: Column) -> Column:
    """SHA-256 over the legs by selection: id, book, odds, line or a dash, each ended by the unit separator."""
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    part = lambda x: F.concat_ws("", F.concat(x["selection_id"].cast("string"), F.lit("\x1f")), F.concat(x["book_id"].cast("string"), F.lit("\x1f")), F.concat(short(x["odds"]), F.lit("\x1f")), F.concat(F.coalesce(short(x["line"]), F.lit("-")), F.lit("\x1f")))
    return F.sha2(F.array_join(F.transform(legs, part), ""), 256)


def arb_stakes(arbs: DataFrame, total_minor: int) -> DataFrame:
    """Whole-unit stakes (rounded up), truncated returns, the worst return less the outlay, the least viable total."""
    stakes = F.transform("legs", lambda x: F.ceil(x["stake"] * total_minor))
    own = arbs.withColumn("stakes", stakes).withColumn("outlay", F.aggregate("stakes", F.lit(0).cast("long"), lambda a, x: a + x))
    returns = F.zip_with("stakes", "legs", lambda s, x: F.floor(s * x["odds"]))
    own = own.withColumn("worst_profit", F.array_min(returns) - F.col("outlay"))
    return own.withColumn("least_total", F.floor(F.size("legs") / F.col("return_fraction")).cast("long") + 1)


def middles(latest: DataFrame, max_age: float = ARB_AGE, max_spread: float = ARB_SPREAD, min_width: float = MIN_MIDDLE_WIDTH) -> DataFrame:
    """Pairs of a quote that wins above one threshold and one that wins below a higher one, the best for each window."""
    anchor = latest.groupBy("market_id").agg(F.max("observed_at").alias("anchor"))
    own = latest.filter(F.col("market_type").isin("spread", "total")).join(anchor, "market_id").filter(O.age_seconds(F.col("anchor"), F.col("observed_at")) <= max_age)
    # home spread wins above -line, away spread below its line; over above, under below
    threshold = F.when(F.col("role") == "home", -F.col("line")).otherwise(F.col("line"))
    own = own.withColumn("threshold", threshold).select("market_id", "market_type", "role", "book_id", "odds", "observed_at", "threshold")
    above = own.filter(F.col("role").isin("home", "over")).drop("role")
    below = own.filter(F.col("role").isin("away", "under")).select("market_id", *[F.col(c).alias(f"{c}_b") for c in ("book_id", "odds", "observed_at", "threshold")])
    pairs = above.join(below, "market_id").filter(F.col("threshold_b") > F.col("threshold"))
    width = F.col("threshold_b") - F.col("threshold")
    spread = F.abs(O.age_seconds(F.col("observed_at"), F.col("observed_at_b")))
    whole = F.ceil(F.col("threshold") + 1e-9) <= F.floor(F.col("threshold_b") - 1e-9)
    pairs = pairs.filter((width >= min_width) & whole & (spread <= max_spread) & (F.col("book_id") != F.col("book_id_b")))
    s = 1 / F.col("odds") + 1 / F.col("odds_b")
    order = Window.partitionBy("market_id", "threshold", "threshold_b").orderBy("implied_sum", "book_id", "observed_at", "odds", "book_id_b", "observed_at_b")
    pairs = pairs.withColumns({"implied_sum": s, "width": width, "overround": s - 1})
    return pairs.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def middle_returns(found: DataFrame, stake_minor: int) -> DataFrame:
    """Returns of both, only the above and only the below side for stakes split by implied probability."""
    a = F.round(F.lit(stake_minor) / F.col("odds") / F.col("implied_sum")).cast("long")
    own = found.withColumns({"stake_a": a}).withColumn("stake_b", F.lit(stake_minor) - F.col("stake_a"))
    ra, rb = F.floor(F.col("stake_a") * F.col("odds")), F.floor(F.col("stake_b") * F.col("odds_b"))
    own = own.withColumns({"profit_above": ra - stake_minor, "profit_below": rb - stake_minor, "profit_both": ra + rb - stake_minor})
    own = own.withColumn("worst", F.least("profit_above", "profit_below"))
    return own.withColumn("breakeven_rate", F.when(F.col("worst") < 0, -F.col("worst") / (F.col("profit_both") - F.col("worst"))).otherwise(0.0))


def middle_outcomes(found: DataFrame) -> DataFrame:
    """The integer results inside each window (pushes at its edges included), one a row."""
    low, high = F.ceil(F.col("threshold")).cast("int"), F.floor(F.col("threshold_b")).cast("int")
    own = found.withColumn("result", F.explode(F.sequence(low, high)))
    r = F.col("result")
    kind = F.when((r > F.col("threshold")) & (r < F.col("threshold_b")), "both_win").otherwise("win_push")
    return own.withColumn("kind", kind)


def middle_stakes(found: DataFrame, total_minor: int) -> DataFrame:
    """Whole-unit stakes (rounded up), and the return and profit of every way a middle can end.

    ``hit`` wins both, ``above`` and ``below`` one side, ``low_push`` and ``high_push`` one side while the other's stake comes back (a result
    on a whole threshold). ``worst_profit`` is the lesser of above and below; ``breakeven_hit`` the share of hits that pays for the rest.
    """
    part = lambda d: F.ceil(F.lit(total_minor) * (1 / F.col(d) / F.col("implied_sum"))).cast("long")
    own = found.withColumns({"stake_above": part("odds"), "stake_below": part("odds_b")})
    paid = lambda stake, d: (F.col(stake) * F.col(d)).cast("long")
    own = own.withColumns({"outlay": F.col("stake_above") + F.col("stake_below"), "above_return": paid("stake_above", "odds"), "below_return": paid("stake_below", "odds_b")})
    above, below, outlay = F.col("above_return"), F.col("below_return"), F.col("outlay")
    own = own.withColumns({
        "hit_profit": above + below - outlay, "above_profit": above - outlay, "below_profit": below - outlay,
        "low_push_profit": below + F.col("stake_above") - outlay, "high_push_profit": above + F.col("stake_below") - outlay,
    })
    own = own.withColumn("worst_profit", F.least("above_profit", "below_profit"))
    worst, hit = F.col("worst_profit"), F.col("hit_profit")
    return own.withColumn("breakeven_hit", F.when(worst >= 0, 0.0).when(hit > 0, -worst / (hit - worst)).otherwise(1.0))


def settlement_distribution(results: DataFrame) -> DataFrame:
    """An empirical distribution by market type, as rows of ``upto`` (a result), ``n``, ``below`` (results under it) and ``total``.

    Interval counts are differences of two of its rows, so a window costs two look-ups, however wide it is. Results: market_type, result.
    """
    own = results.groupBy("market_type", "result").agg(F.count("*").alias("n"))
    order = Window.partitionBy("market_type").orderBy("result").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("market_type", F.col("result").alias("upto"), "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy("market_type")).alias("total"))


def middle_expectation(staked: DataFrame, distribution: DataFrame) -> DataFrame:
    """Hit, push and miss probabilities of staked middles, the expected profit in minor units, and the edge over the break-even share.

    A window is (threshold, threshold_b); a push needs a whole threshold. ``distribution`` is that of ``settlement_distribution``; market types without
    results give no rows. Distinct scores are few, so a type's distribution is one sorted array, searched by value.
    """
    steps = distribution.groupBy("market_type").agg(F.array_sort(F.collect_list(F.struct(F.col("upto").cast("double").alias("upto"), "n", "below"))).alias("steps"), F.max("total").alias("total"))
    own = staked.join(steps, "market_type")
    low, high = F.col("threshold"), F.col("threshold_b")
    # rows below a value, by the first step at or above it; at a value, by the step itself
    at_or_above = lambda v, strict: F.get(F.filter("steps", lambda x: (x["upto"] > v) if strict else (x["upto"] >= v)), F.lit(0))
    under = lambda v, strict: F.coalesce(at_or_above(v, strict)["below"], F.col("total"))
    at = lambda v: under(v, True) - under(v, False)
    whole = lambda v: F.floor(v) == v
    share = lambda n: n / F.col("total")
    own = own.withColumns({"hit": share(under(high, False) - under(low, True)), "low_push": F.when(whole(low), share(at(low))).otherwise(0.0), "high_push": F.when(whole(high), share(at(high))).otherwise(0.0)})
    own = own.withColumn("miss", F.greatest(1 - F.col("hit") - F.col("low_push") - F.col("high_push"), F.lit(0.0)))
    profit = F.col("hit") * F.col("hit_profit") + F.col("low_push") * F.col("low_push_profit") + F.col("high_push") * F.col("high_push_profit") + F.col("miss") * F.col("worst_profit")
    return own.withColumns({"expected_profit": profit, "edge": F.col("hit") - F.col("breakeven_hit")}).drop("steps", "total")


def middle_settlements(found: DataFrame, results: DataFrame) -> DataFrame:
    """Each middle with each result of its market: both_win, win_push (a result on an edge) or win_lose."""
    own = found.join(results.select("market_id", "result"), "market_id")
    r = F.col("result")
    kind = F.when((r > F.col("threshold")) & (r < F.col("threshold_b")), "both_win").when((r == F.col("threshold")) | (r == F.col("threshold_b")), "win_push").otherwise("win_lose")
    return own.withColumn("kind", kind)


def vig_contributions(books: DataFrame, attribution: str = "proportional") -> DataFrame:
    """What each selection carries of its book's margin: implied, fair, excess, share and relative margin.

    ``proportional`` scales all implied probabilities by their sum, ``uniform`` takes the same slice of the overround off each. A book of which
    some fair probability would not be positive gives rows with the reason ``undefined`` and no numbers. In a fair book (within 1e-12) shares are 0.
    """
    s = O.compensated(F.transform("quotes", lambda x: 1 / x["odds"]))
    own = books.select("market_id", "book_id", "quotes", s.alias("s"), F.size("quotes").alias("n"))
    over = F.col("s") - 1
    fair = (lambda q: q / F.col("s")) if attribution == "proportional" else (lambda q: q - over / F.col("n"))
    own = own.withColumn("undefined", F.exists("quotes", lambda x: fair(1 / x["odds"]) <= 0))
    own = own.select("market_id", "book_id", "s", "n", "undefined", F.explode("quotes").alias("x")).withColumn("implied", 1 / F.col("x.odds"))
    q = fair(F.col("implied"))
    own = own.withColumn("fair", F.when(~F.col("undefined"), q)).withColumn("excess", F.col("implied") - F.col("fair"))
    share = F.when(F.abs(over) <= 1e-12, F.when(~F.col("undefined"), 0.0)).otherwise(F.col("excess") / over)
    return own.select("market_id", "book_id", F.col("x.selection_id").alias("selection_id"), "implied", "fair", "excess", share.alias("share"), (F.col("excess") / F.col("fair")).alias("relative_margin"), F.when(F.col("undefined"), "undefined").alias("reason"))
