"""Tickets: parlays, round robins, grading, settlement, ledger rows, cash-out, limits and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickline.functions import odds as O

CASH_OUT_MARGIN = 0.05
MAX_ROUND_ROBIN = 10_000


def product(values: Column) -> Column:
    """Product of the factors in ascending order, so that the order of rows doesn't matter."""
    return F.aggregate(F.array_sort(values), F.lit(1.0), lambda a, x: a * x)


def parlays(legs: DataFrame) -> DataFrame:
    """Accepted decimal and independent joint probability of every ticket."""
    own = legs.groupBy("wager_id").agg(F.collect_list("odds").alias("odds"), F.count("*").alias("n_legs"))
    return own.select("wager_id", "n_legs", product(F.col("odds")).alias("decimal"), product(F.transform("odds", lambda d: 1 / d)).alias("joint"))


def round_robin(legs: DataFrame, size: int, most_legs: int = 12) -> DataFrame:
    """Every combination of ``size`` legs of each ticket, as self-joins on leg ordinals; larger tickets are refused."""
    n = legs.groupBy("wager_id").agg(F.count("*").alias("n")).filter((F.col("n") >= size) & (F.col("n") <= most_legs)).select("wager_id")
    own = legs.join(n, "wager_id").select("wager_id", "leg_id", "odds")
    step = lambda i: own.select("wager_id", F.col("leg_id").alias(f"leg_{i}"), F.col("odds").alias(f"odds_{i}"))
    out = step(0)
    for i in range(1, size):
        out = out.join(step(i), "wager_id").filter(F.col(f"leg_{i}") > F.col(f"leg_{i - 1}"))
    return out.select("wager_id", *[f"leg_{i}" for i in range(size)], product(F.array(*[f"odds_{i}" for i in range(size)])).alias("decimal"))


def round_robin_sizes(legs: DataFrame, sizes: list[int], most_legs: int = 10, most_tickets: int = MAX_ROUND_ROBIN) -> DataFrame:
    """Every combination of each size of a ticket's legs: wager_id, size, its legs (ascending ids), decimal, reason.

    A ticket of over ``most_legs`` legs, of fewer than a size, or of over ``most_tickets`` combinations is refused whole,
    in a row of its own with the reason. Combinations are the set bits of a number below 2 to the legs' count.
    """
    own = legs.groupBy("wager_id").agg(F.array_sort(F.collect_list(F.struct("leg_id", "odds"))).alias("l"), F.count("*").alias("n"))
    wanted = F.array(*map(F.lit, sizes))
    ways = lambda n, k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: F.when(k >= i, a * (n - k + i) / i).otherwise(a))
    total = F.aggregate(wanted, F.lit(0.0), lambda a, k: a + ways(F.col("n"), k))
    reason = F.when(F.col("n") > most_legs, "too_many_legs").when(F.col("n") < max(sizes), "too_few_legs").when(total > most_tickets, "too_many_tickets")
    own = own.withColumn("reason", reason)
    bits = own.filter("reason IS NULL").withColumn("m", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, cast(n as int)) - 1"))))
    bits = bits.withColumn("size", F.bit_count("m").cast("int")).filter(F.col("size").isin(sizes))
    chosen = F.expr("filter(l, (x, i) -> (shiftright(m, i) & 1) = 1)")
    out = bits.withColumn("c", chosen).select("wager_id", "size", F.array_join(F.transform("c", lambda x: x["leg_id"].cast("string")), ",").alias("legs"), product(F.transform("c", lambda x: x["odds"])).alias("decimal"), "reason")
    no = own.filter("reason IS NOT NULL").select("wager_id", F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("legs"), F.lit(None).cast("double").alias("decimal"), "reason")
    return out.unionByName(no)


def grade(legs: DataFrame, games: DataFrame, draws: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Legs on finished events with won, lost, push or void; draws lists markets that quote a draw; ``more`` columns of games come along."""
    own = legs.join(games.filter("status IN ('final', 'cancelled')").select("event_id", F.col("status").alias("event_status"), "home_score", "away_score", *more), "event_id")
    if draws is None:
        own = own.withColumn("draw_quoted", F.lit(False))
    else:
        own = own.join(draws.select("market_id").distinct().withColumn("d", F.lit(True)), "market_id", "left").withColumn("draw_quoted", F.coalesce("d", F.lit(False))).drop("d")
    sign = F.when(F.col("role").isin("home", "over"), 1).otherwise(-1)
    margin = F.col("home_score") - F.col("away_score")
    total = F.col("home_score") + F.col("away_score")
    money = F.when(margin == 0, F.when(F.col("draw_quoted"), "lost").otherwise("push")).when(margin * sign > 0, "won").otherwise("lost")
    gap = F.when(F.col("market_type") == "spread", (margin + F.col("home_line")) * sign).otherwise((total - F.col("home_line")) * sign)
    lined = F.when(gap > 0, "won").when(gap == 0, "push").otherwise("lost")
    result = F.when(F.col("event_status") == "cancelled", "void").when(F.col("market_type") == "moneyline", money).when(F.col("market_type").isin("spread", "total"), lined).otherwise("void")
    return own.withColumn("result", result)


def decide(tickets: DataFrame, graded: DataFrame, leg_counts: DataFrame) -> DataFrame:
    """Outcome and returned amount of tickets whose legs are all graded.

    Any lost leg loses; without a winner it is void if a leg is void, else push, and the stake goes back; all won
    pays in full; else removed legs divide out of the decimal, which never falls below one. A teaser (``kind``, where
    tickets have it) that would win with a removed leg is void instead: its price holds for its own legs alone.
    """
    own = graded.groupBy("wager_id").agg(
        *[F.count_if(F.col("result") == r).alias(r) for r in ("won", "lost", "push", "void")], F.count("*").alias("graded"),
        F.collect_list("odds").alias("all_odds"), F.array_sort(F.collect_list(F.when(F.col("result").isin("push", "void"), F.struct("selection_id", "odds")))).alias("removed"),
    )
    own = own.join(leg_counts, "wager_id").filter("graded = n_legs").join(tickets, "wager_id")
    own = own.withColumn("accepted", product(F.col("all_odds")))
    left = F.greatest(F.col("accepted") / product(F.transform("removed", lambda x: x["odds"])), F.lit(1.0))
    cut_teaser = (F.col("kind") == "teaser") & (F.size("removed") > 0) if "kind" in tickets.columns else F.lit(False)
    status = F.when(F.col("lost") > 0, "lost").when(F.col("won") == 0, F.when(F.col("void") > 0, "void").otherwise("push")).when(cut_teaser, "void").otherwise("won")
    paid = O.rounded_money(F.col("stake_minor") * F.when(F.size("removed") == 0, F.col("accepted")).otherwise(left), F.col("rounding"))
    returned = F.when(status == "lost", F.lit(0).cast("long")).when(status == "won", F.greatest(paid, F.col("stake_minor"))).otherwise(F.col("stake_minor"))
    return own.select("wager_id", "user_id", "stake_minor", "placed_at", "accepted", status.alias("status"), returned.alias("returned_minor"), (returned - F.col("stake_minor")).alias("net_return_minor"))


def settlement_entries(decided: DataFrame) -> DataFrame:
    """Double-entry rows of each settlement: escrow, cash, house; zero rows are left out."""
    row = lambda kind, amount: F.struct(F.lit(kind).alias("account_kind"), amount.alias("amount_minor"))
    rows = F.array(row("escrow", -F.col("stake_minor")), row("cash", F.col("returned_minor")), row("house", F.col("stake_minor") - F.col("returned_minor")))
    return decided.select("wager_id", "user_id", "placed_at", F.explode(rows).alias("e")).select("wager_id", "user_id", "placed_at", F.lit("settlement").alias("kind"), "e.*").filter("amount_minor <> 0")


def stake_entries(tickets: DataFrame) -> DataFrame:
    row = lambda kind, amount: F.struct(F.lit(kind).alias("account_kind"), amount.alias("amount_minor"))
    rows = F.array(row("cash", -F.col("stake_minor")), row("escrow", F.col("stake_minor")))
    return tickets.select("wager_id", "user_id", "placed_at", F.explode(rows).alias("e")).select("wager_id", "user_id", "placed_at", F.lit("stake").alias("kind"), "e.*").filter("amount_minor <> 0")


def balances(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account_kind", "user_id").agg(F.sum("amount_minor").alias("balance_minor"), F.count("*").alias("entries"), F.min("placed_at").alias("first_at"), F.max("placed_at").alias("last_at"))


def integrity(transactions: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: total, transactions, entries, unbalanced (sum not zero or fewer than two) and empty ones."""
    own = entries.groupBy("wager_id", "kind").agg(F.sum("amount_minor").alias("s"), F.count("*").alias("n"))
    both = transactions.join(own, ["wager_id", "kind"], "left")
    return both.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("total_minor"), F.count("*").alias("transactions"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.count_if((F.col("s") != 0) | (F.col("n") < 2)).alias("unbalanced"), F.count_if(F.col("n").isNull()).alias("empty"),
    )


def cash_out(tickets: DataFrame, legs: DataFrame, graded: DataFrame, fair: DataFrame) -> DataFrame:
    """Offers for tickets whose graded legs all won and whose open legs have a fair probability."""
    own = legs.join(graded.select("leg_id", "result"), "leg_id", "left").join(fair.select("selection_id", "fair_prob"), "selection_id", "left")
    per = own.groupBy("wager_id").agg(
        F.collect_list("odds").alias("odds"), F.collect_list(F.when(F.col("result").isNull(), F.col("fair_prob"))).alias("open"),
        F.count_if(F.col("result").isNull()).alias("n_open"), F.count_if(F.col("result").isNotNull() & (F.col("result") != "won")).alias("dead"),
    ).filter("n_open > 0 AND dead = 0 AND size(open) = n_open").join(tickets, "wager_id")
    payout = O.rounded_money(F.col("stake_minor") * product(F.col("odds")), F.col("rounding"))
    value = O.rounded_money(payout * product(F.col("open")), F.col("rounding"))
    offer = O.rounded_money(value * (1 - CASH_OUT_MARGIN), F.col("rounding"))
    return per.select("wager_id", "n_open", payout.alias("payout_minor"), value.alias("fair_minor"), offer.alias("offer_minor"))


def ticket_audit(decided: DataFrame, tickets: DataFrame, leg_counts: DataFrame) -> DataFrame:
    """Violations by rule over all tickets: return against outcome of the settled ones, and leg count."""
    own = tickets.select("wager_id", "stake_minor").join(leg_counts, "wager_id", "left").join(decided.select("wager_id", "status", "returned_minor"), "wager_id", "left")
    rules = {
        "lost_returns_nothing": (F.col("status") == "lost") & (F.col("returned_minor") != 0), "push_returns_stake": F.col("status").isin("push", "void") & (F.col("returned_minor") != F.col("stake_minor")),
        "won_at_least_stake": (F.col("status") == "won") & (F.col("returned_minor") < F.col("stake_minor")), "legs_within_25": F.col("n_legs") > 25,
    }
    counts = own.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return reduce(lambda a, b: a.unionByName(b), [counts.select(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])


def go_months_back(t: Column, months: int = 1) -> Column:
    """Calendar months back where a day that the month lacks runs over into the next one."""
    first = F.add_months(F.trunc(t.cast("date"), "month"), -months)
    return F.date_add(first, F.dayofmonth(t) - 1)


def limit_usage(limits: DataFrame, entries: DataFrame) -> DataFrame:
    """Use of every limit in its rolling window: negated sums of stakes."""
    start = F.when(F.col("period") == "day", F.col("now") - F.expr("INTERVAL 24 HOURS")).when(F.col("period") == "week", F.col("now") - F.expr("INTERVAL 7 DAYS")).otherwise(go_months_back(F.col("now")).cast("timestamp"))
    own = limits.withColumn("since", start)
    # stakes of the longest window, summed by user and instant, before they meet the limits
    reach = own.agg(F.min("since").alias("lo"), F.max("now").alias("hi")).first()
    staked = entries.filter("account_kind = 'cash' AND kind = 'stake'").filter((F.col("placed_at") >= F.lit(reach.lo)) & (F.col("placed_at") <= F.lit(reach.hi)))
    staked = staked.groupBy("user_id", "placed_at").agg(F.sum("amount_minor").alias("amount_minor"))
    own = own.join(staked, "user_id", "left")
    inside = (F.col("placed_at") >= F.col("since")) & (F.col("placed_at") <= F.col("now"))
    used = own.groupBy("user_id", "period", "limit_minor").agg(F.coalesce(-F.sum(F.when(inside, F.col("amount_minor"))), F.lit(0)).alias("used_minor"))
    return used.withColumn("breached", F.col("used_minor") > F.col("limit_minor"))


#: Entry kinds that count against each kind of limit, and whether their sum is negated.
LIMIT_KINDS = {"stake": (("stake",), True), "loss": (("stake", "payout", "refund", "cash_out", "settlement", "adjustment"), True), "grant": (("grant",), False)}
PERIODS = ("day", "week", "month")


def limit_usage_at(asks: DataFrame, entries: DataFrame) -> DataFrame:
    """Use of limits at any instants: adds used_minor, projected_minor and breached to asks.

    ``asks``: user_id, kind (stake, loss or grant), period (day, week or month), at, limit_minor, requested_minor, and an ``ask_id`` of their own. ``entries``: user_id, kind,
    account_kind, placed_at, amount_minor; cash entries from the window's start (inclusive) to the instant (inclusive) count.
    Day and week are 24 hours and seven days; a month is one of the calendar's, whose missing days run over into the next. Grants request nothing.

    No ask meets the entries of its window: entries are summed up by user, kind and instant once, and an ask's use is the difference of two
    look-ups in those sums, at its instant and before its window; sums and look-ups are one sorted pass by user and kind.
    """
    at = F.col("at")
    since = F.when(F.col("period") == "day", at - F.expr("INTERVAL 24 HOURS")).when(F.col("period") == "week", at - F.expr("INTERVAL 7 DAYS"))
    clock = F.unix_micros(at) - F.unix_micros(F.date_trunc("day", at))
    since = since.otherwise(F.timestamp_micros(F.unix_micros(go_months_back(at).cast("timestamp")) + clock))
    asks = asks.withColumn("since", since)
    sign = F.coalesce(*[F.when(F.col("limit_kind") == k, F.lit(-1 if negated else 1)) for k, (_, negated) in LIMIT_KINDS.items()])
    kinds = F.array(*[F.when(F.col("kind").isin(*of), F.lit(k)) for k, (of, _) in LIMIT_KINDS.items()])
    moves = entries.filter("account_kind = 'cash'").select("user_id", F.explode(F.array_compact(kinds)).alias("limit_kind"), F.unix_micros("placed_at").alias("t"), "amount_minor")
    moves = moves.groupBy("user_id", "limit_kind", "t").agg(F.sum("amount_minor").alias("amount_minor"))
    nothing = F.lit(0).cast("long")
    # at the same instant entries come before the end of a window (order 1) and behind the start of one (order 0)
    rows = moves.select("user_id", "limit_kind", "t", F.lit(1).alias("rank"), (F.col("amount_minor") * sign).alias("amount"), F.lit(None).cast("string").alias("ask_id"))
    for edge, rank in (("at", 2), ("since", 0)):
        rows = rows.unionByName(asks.select("user_id", F.col("kind").alias("limit_kind"), F.unix_micros(edge).alias("t"), F.lit(rank).alias("rank"), nothing.alias("amount"), F.col("ask_id").cast("string").alias("ask_id")))
    so_far = F.sum("amount").over(Window.partitionBy("user_id", "limit_kind").orderBy("t", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = rows.withColumn("so_far", so_far).filter("ask_id IS NOT NULL")
    used = edges.groupBy("ask_id").agg(F.sum(F.when(F.col("rank") == 2, F.col("so_far")).otherwise(-F.col("so_far"))).alias("used_minor"))
    requested = F.when(F.col("kind") == "grant", nothing).otherwise(F.coalesce("requested_minor", nothing))
    own = asks.withColumn("_ask", F.col("ask_id").cast("string")).join(used.withColumnRenamed("ask_id", "_ask"), "_ask").drop("_ask")
    own = own.withColumn("projected_minor", F.col("used_minor") + requested)
    return own.withColumn("breached", F.col("projected_minor") > F.col("limit_minor"))


def transfers(moves: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    """Two entries for each move (user_id, amount_minor, placed_at and other columns): out of the source account kind, into the target's."""
    row = lambda account, amount: F.struct(F.lit(account).alias("account_kind"), amount.alias("entry_minor"))
    rows = F.explode(F.array(row(source, -F.col("amount_minor")), row(target, F.col("amount_minor")))).alias("e")
    rest = [c for c in moves.columns if c != "amount_minor"]
    return moves.select(*rest, F.lit(kind).alias("kind"), rows).select(*rest, "kind", "e.account_kind", F.col("e.entry_minor").alias("amount_minor"))


def grant_entries(grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of granted credit (from issuance to cash), and the grants refused for an amount that is not positive."""
    fine = F.coalesce(F.col("amount_minor") > 0, F.lit(False))
    return transfers(grants.filter(fine), "grant", "issuance", "cash"), grants.filter(~fine).withColumn("reason", F.lit("amount_not_positive"))


def adjustment_entries(adjustments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of adjustments between two named accounts (``source``, ``target``), and the refused ones with a reason."""
    known = ["cash", "escrow", "house", "issuance"]
    ok = lambda c: F.coalesce(F.col(c).isin(known), F.lit(False))
    reason = F.when(~(ok("source") & ok("target")), "unknown_account").when(F.col("source") == F.col("target"), "same_account").when(~F.coalesce(F.col("amount_minor") > 0, F.lit(False)), "amount_not_positive")
    own = adjustments.withColumn("reason", reason)
    fine = own.filter("reason IS NULL").drop("reason")
    row = lambda account, amount: F.struct(F.col(account).alias("account_kind"), amount.alias("entry_minor"))
    rest = [c for c in fine.columns if c not in ("amount_minor", "source", "target")]
    rows = fine.select(*rest, F.explode(F.array(row("source", -F.col("amount_minor")), row("target", F.col("amount_minor")))).alias("e"))
    return rows.select(*rest, F.lit("adjustment").alias("kind"), "e.account_kind", F.col("e.entry_minor").alias("amount_minor")), own.filter("reason IS NOT NULL")
