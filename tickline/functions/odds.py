"""Odds arithmetic as column expressions: conversion, display, value, staking, money and margin removal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_AMERICAN = 1_000_000
MAX_DENOMINATOR = 1000
FAIR_BAND = 1e-9
SHIN_TOP = 1 - 1e-6
BISECTIONS = 60
#: What the last digits of a few doubles near one add up to.
LAST_DIGITS = 2.0**-50
NEWTON_STEPS = 20


def let(value: Column, body: callable) -> Column:
    """``body(value)`` with the value computed once, although a lambda inside the body uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def american_to_decimal(v: Column) -> Column:
    return F.when(v > 0, 1 + v / 100).when(v < 0, 1 - F.lit(100) / v)


def decimal_to_american(d: Column) -> Column:
    """Rounded half away from zero; -100 is written +100; null beyond the largest magnitude or at 1 and below."""
    raw = half_away(F.when(d >= 2, (d - 1) * 100).when(d > 1, -100 / (d - 1)))
    return F.when(raw == -100, 100).when(F.abs(raw) <= MAX_AMERICAN, raw).cast("long")


def decimal_to_prob(d: Column) -> Column:
    return F.when(d > 1, 1 / d)


def prob_to_decimal(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), 1 / p)


def fraction(d: Column) -> Column:
    """struct(num, den) of d - 1: the last continued-fraction convergent with a denominator up to 1000."""
    x = d - 1
    seed = F.struct(F.lit(0).cast("long").alias("p2"), F.lit(1).cast("long").alias("p1"), F.lit(1).cast("long").alias("q2"), F.lit(0).cast("long").alias("q1"), x.alias("r"), F.lit(False).alias("done"))

    def turn(a: Column, _: Column) -> Column:
        term = F.floor(a["r"])
        p, q = term * a["p1"] + a["p2"], term * a["q1"] + a["q2"]
        stop = a["done"] | (a["r"] > 1e9) | (q > MAX_DENOMINATOR) | (q <= 0)
        near = F.abs(p / F.when(q != 0, q) - x) <= 1e-12
        rest = a["r"] - term
        go = F.struct(a["p1"].alias("p2"), p.alias("p1"), a["q1"].alias("q2"), q.alias("q1"), F.when(rest > 0, 1 / F.when(rest > 0, rest)).otherwise(1e18).alias("r"), F.coalesce(near, F.lit(False)).alias("done"))
        held = F.struct(a["p2"].alias("p2"), a["p1"].alias("p1"), a["q2"].alias("q2"), a["q1"].alias("q1"), a["r"].alias("r"), F.lit(True).alias("done"))
        return F.when(stop, held).otherwise(go)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(16)), seed, turn)
    return F.struct(out["p1"].alias("num"), out["q1"].alias("den"))


def gcd(a: Column, b: Column) -> Column:
    seed = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(48)), seed, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))))
    return out["a"]


def render_american(d: Column) -> Column:
    a = decimal_to_american(d)
    return F.when(a > 0, F.concat(F.lit("+"), a.cast("string"))).otherwise(a.cast("string"))


def ev(q: Column, d: Column) -> Column:
    return F.when(q * d == 1, 0.0).otherwise(q * d - 1)


def edge(q: Column, d: Column) -> Column:
    p = 1 / d
    return F.when(q == p, 0.0).otherwise(q / p - 1)


def kelly(q: Column, d: Column) -> Column:
    return F.when(q * d <= 1, 0.0).otherwise(F.least((q * d - 1) / (d - 1), F.lit(1.0)))


def growth_rate(q: Column, d: Column, f: Column) -> Column:
    """Expected log growth; null where a loss would be certain ruin."""
    return F.when((f < 1) | (q == 1), q * F.log1p(f * (d - 1)) + F.when(q == 1, 0.0).otherwise((1 - q) * F.log1p(-F.when(f < 1, f))))


def home_frame(role: Column, market_type: Column, line: Column) -> Column:
    """Lines in the home frame: only the away side of a spread is inverted, and zero stays +0."""
    away = (role == "away") & (market_type == "spread")
    return F.when(away, F.when(line == 0, 0.0).otherwise(-line)).otherwise(line)


def teased(role: Column, line: Column, points: Column) -> Column:
    return F.when(role == "over", line - points).otherwise(line + points)


def rounded_money(x: Column, mode: Column) -> Column:
    """Minor units: half_even, half_away or toward_zero; null beyond 2^53 - 1."""
    out = F.when(mode == "half_even", F.rint(x)).when(mode == "half_away", half_away(x)).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    return F.when(F.abs(x) <= 9007199254740991, out).cast("long")


def age_seconds(now: Column, then: Column) -> Column:
    """May be negative and is never clamped."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 1_000_000


def tier(seconds: Column) -> Column:
    return F.when(seconds <= 0, "live").when(seconds <= 1800, "near").when(seconds <= 43_200, "today").when(seconds <= 604_800, "distant").otherwise("futures")


def tier_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ("live", "near", "today", "distant", "futures"))), name)


def compensated(values: Column) -> Column:
    """Neumaier sum of an array in its order."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        return F.struct(t.alias("s"), (a["c"] + F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])).alias("c"))

    return F.aggregate(values, zero, add, lambda a: a["s"] + a["c"])


def plain_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bisect(lo: Column, hi: Column, above: callable) -> Column:
    """Midpoint after 60 halvings; ``above(x)`` tells whether the root lies above x."""
    seed = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def half(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        upper, lower = F.struct(mid.alias("lo"), a["hi"].alias("hi")), F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(above(mid), upper).otherwise(lower)

    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), seed, half, lambda a: (a["lo"] + a["hi"]) / 2)


def devig_multiplicative(p: Column) -> Column:
    return let(compensated(p), lambda s: F.transform(p, lambda x: x / s))


def devig_additive(p: Column) -> Column:
    q = let((compensated(p) - 1) / F.size(p), lambda cut: F.transform(p, lambda x: x - cut))
    return let(q, lambda v: F.when(F.array_min(v) > 0, v))


def power_exponent(p: Column) -> Column:
    """The k where the powers sum to one, by Newton's steps: the sum falls and is convex, so they come from below."""

    def step(k: Column, _: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("d"))
        sums = F.aggregate(p, zero, lambda a, x: let(F.pow(x, k), lambda y: F.struct((a["f"] + y).alias("f"), (a["d"] + y * F.log(x)).alias("d"))))
        return let(sums, lambda v: k - F.try_divide(v["f"] - 1, v["d"]))

    def solve(s: Column) -> Column:
        k = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.when(s > 1, 1.0).otherwise(0.0), step)
        return F.when(F.abs(s - 1) <= FAIR_BAND, 1.0).otherwise(k)

    return let(compensated(p), solve)


def devig_power(p: Column) -> Column:
    return let(power_exponent(p), lambda k: F.transform(p, lambda x: F.pow(x, k)))


def devig_shin(p: Column) -> Column:
    """Null below a fair book; a fair book gives p / S."""
    n = F.size(p)

    def solve(s: Column) -> Column:
        root = lambda z: F.aggregate(p, F.lit(0.0), lambda a, x: a + F.sqrt(z * z + 4 * x * x * (1 - z) / s))
        z = _bisect(F.lit(0.0), F.lit(SHIN_TOP), lambda m: root(m) > 2 + (n - 2) * m)
        q = let(z, lambda v: F.transform(p, lambda x: 2 * x * x / (s * (v + F.sqrt(v * v + 4 * x * x * (1 - v) / s)))))
        two = F.transform(p, lambda x: x - (s - 1) / 2)  # what the root gives for two outcomes
        return F.when(F.abs(s - 1) <= FAIR_BAND, F.transform(p, lambda x: x / s)).when(s >= 1 - FAIR_BAND, F.when(n == 2, two).otherwise(q))

    return let(compensated(p), solve)


def finish(q: Column) -> Column:
    """Reject what is not a set of two or more positive probabilities that sum to one, then renormalise by the plain sum.

    A sum that is one but for its last digits is left alone: dividing by it would move every value off what the method gives, and so
    a value of exactly nothing, or an amount of exactly a half, to one side.
    """

    def checked(v: Column) -> Column:
        fine = (F.size(v) >= 2) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0)) & (F.abs(compensated(v) - 1) <= 1e-9)
        return F.when(fine, let(plain_sum(v), lambda s: F.when(F.abs(s - 1) <= LAST_DIGITS, v).otherwise(F.transform(v, lambda x: x / s))))

    return let(q, checked)


METHODS = {"multiplicative": devig_multiplicative, "additive": devig_additive, "power": devig_power, "shin": devig_shin}
