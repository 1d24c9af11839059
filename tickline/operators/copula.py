"""Correlated parlays: correlation matrices from pairs, Gaussian-copula joint probabilities, teasers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEGS, MAX_TEASER_POINTS, SLACK = 25, 30.0, 1e-5
LATTICE, SHIFTS, MOST_BATCHES, REL, ABS = 8192, 8, 32, 1e-3, 1e-6
_phi = np.frompyfunc(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), 1, 1)
_quantile = np.frompyfunc(NormalDist().inv_cdf, 1, 1)
#: Nodes of the normal distribution's curve for whole arrays; between them a cubic with the curve's own slopes, off by less than 1e-13.
_STEP, _END = 512, 9
_NODES = np.arange(-_END * _STEP, _END * _STEP + 1) / _STEP
_CURVE, _SLOPE = _phi(_NODES).astype(float), np.exp(-_NODES * _NODES / 2) / math.sqrt(2 * math.pi)
_X, _W = np.polynomial.legendre.leggauss(200)


def phi_array(x: np.ndarray) -> np.ndarray:
    """The normal distribution of an array."""
    x = np.clip(x, -_END, _END - 1e-9)
    i = np.floor((x + _END) * _STEP).astype(np.int64)
    t = (x - _NODES[i]) * _STEP
    u, a, b = 1 - t, _SLOPE[i] / _STEP, _SLOPE[i + 1] / _STEP
    return u * u * (1 + 2 * t) * _CURVE[i] + t * u * u * a + t * t * (3 - 2 * t) * _CURVE[i + 1] - t * t * u * b


def quantile_array(p: np.ndarray) -> np.ndarray:
    """The inverse of ``phi_array``: a look-up in its nodes, then two of Newton's steps."""
    p = np.clip(p, 1e-15, 1 - 1e-15)
    x = np.interp(p, _CURVE, _NODES)
    for _ in range(2):
        x -= np.clip((phi_array(x) - p) * math.sqrt(2 * math.pi) * np.exp(x * x / 2), -0.01, 0.01)
    return x


def bivariate(h: float, k: float, rho: float) -> float:
    """P(X <= h, Y <= k) of two standard normals with correlation rho, by the integral over the angle of rho."""
    ph, pk = float(_phi(h)), float(_phi(k))
    if rho >= 1:
        return min(ph, pk)
    if rho <= -1:
        return max(0.0, ph + pk - 1)
    top = math.asin(rho)
    angle = top / 2 * (_X + 1)
    inner = np.exp(-(h * h + k * k - 2 * h * k * np.sin(angle)) / (2 * np.cos(angle) ** 2))
    return ph * pk + top / 2 * float(_W @ inner) / (2 * math.pi)


def multivariate(t: np.ndarray, c: np.ndarray) -> float | None:
    """P(X <= t) by a lattice of square roots of primes on the conditional form; stops when doubled batches agree, and is None when they don't.

    Variables go in order of their thresholds and rows of correlations, so the order of legs doesn't matter.
    """
    by = sorted(range(len(t)), key=lambda i: (t[i], sorted(c[i].tolist())))
    t, c = t[by], c[np.ix_(by, by)]
    low = np.linalg.cholesky(c + 1e-12 * np.eye(len(t)))
    roots = np.sqrt([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89][: len(t) - 1])
    rng = np.random.default_rng(29)
    sums: list[float] = []
    while True:
        n = len(sums)
        for _ in range(SHIFTS if not n else n):
            x = np.abs(2 * ((np.arange(1, LATTICE + 1)[:, None] * roots + rng.random(len(roots))) % 1) - 1)
            d = np.full(LATTICE, float(_phi(t[0] / low[0, 0])))
            total, y = d.copy(), np.zeros((LATTICE, len(t)))
            for i in range(1, len(t)):
                y[:, i - 1] = quantile_array(x[:, i - 1] * d)
                d = phi_array((t[i] - y[:, :i] @ low[i, :i]) / low[i, i])
                total *= d
            sums.append(float(total.mean()))
        mean, error = float(np.mean(sums)), float(np.std(sums) / math.sqrt(len(sums)))
        if 3 * error <= max(ABS, REL * mean):
            return mean
        if len(sums) >= MOST_BATCHES * SHIFTS:
            return None


def joint(p: np.ndarray, c: np.ndarray) -> tuple[float | None, bool, str | None]:
    """Joint probability of legs, whether it is exact (no lattice), and why there is none.

    Legs that no chain of correlations links are independent, so each linked block is solved by itself.
    """
    if len(p) > MAX_LEGS:
        return None, False, "too_many_legs"
    if not np.all((p >= 0) & (p <= 1)):
        return None, False, "bad_marginal"
    if not (np.allclose(c, c.T) and np.all(np.abs(c) <= 1) and np.allclose(np.diag(c), 1)) or np.linalg.eigvalsh(c).min() < -1e-9:
        return None, False, "not_positive_semidefinite"
    if np.any(p == 0):
        return 0.0, True, None
    left, out, exact = [i for i in range(len(p)) if p[i] < 1], 1.0, True
    while left:
        block, todo = set(), [left[0]]
        while todo:
            i = todo.pop()
            if i not in block:
                block.add(i)
                todo += [j for j in left if c[i, j] != 0 and j not in block]
        own = sorted(block)
        left = [i for i in left if i not in block]
        if len(own) == 1:
            out *= float(p[own[0]])
        else:
            t = _quantile(p[own]).astype(float)
            exact &= len(own) == 2
            part = bivariate(t[0], t[1], float(c[own[0], own[1]])) if len(own) == 2 else multivariate(t, c[np.ix_(own, own)])
            if part is None:
                return None, False, "not_converged"
            out *= part
    upper, lower = float(p.min()), max(0.0, float(p.sum()) - (len(p) - 1))
    if not lower - SLACK <= out <= upper + SLACK:
        return None, exact, "not_priceable"
    return min(max(out, lower), upper), exact, None


def correlation_pairs(legs: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for every two legs of a ticket (leg_a < leg_b): rho of their selections, 0 where the table has none.

    ``pairs`` holds selection_a < selection_b and rho. A ticket has at most ``MAX_LEGS`` legs, so its pairs are few.
    """
    a = legs.select("wager_id", F.col("leg_id").alias("leg_a"), F.col("selection_id").alias("sa"))
    b = legs.select("wager_id", F.col("leg_id").alias("leg_b"), F.col("selection_id").alias("sb"))
    own = a.join(b, "wager_id").filter("leg_a < leg_b").withColumns({"selection_a": F.least("sa", "sb"), "selection_b": F.greatest("sa", "sb")})
    return own.join(pairs, ["selection_a", "selection_b"], "left").select("wager_id", "leg_a", "leg_b", F.coalesce("rho", F.lit(0.0)).alias("rho"))


def correlated_parlays(legs: DataFrame, pairs: DataFrame, price: str = "odds") -> DataFrame:
    """Every ticket's n_legs, independent and copula joint probability, both decimals, haircut, exact flag, reason.

    A leg's marginal is the inverse of ``price``. Tickets are independent rows: their legs and correlations come
    together by ticket, and Arrow batches of tickets are priced side by side.
    """
    rows = correlation_pairs(legs, pairs).filter("rho <> 0").groupBy("wager_id").agg(F.collect_list(F.struct("leg_a", "leg_b", "rho")).alias("rhos"))
    own = legs.groupBy("wager_id").agg(F.array_sort(F.collect_list(F.struct("leg_id", F.col(price).alias("d")))).alias("legs"))
    own = own.join(rows, "wager_id", "left").select("wager_id", F.transform("legs", lambda x: x["leg_id"]).alias("ids"), F.transform("legs", lambda x: x["d"]).alias("d"), "rhos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for wager, ids, d, rhos in zip(f["wager_id"], f["ids"], f["d"], f["rhos"], strict=True):
                at, c = {x: i for i, x in enumerate(ids)}, np.eye(len(ids))
                for r in () if rhos is None else rhos:
                    c[at[r["leg_a"]], at[r["leg_b"]]] = c[at[r["leg_b"]], at[r["leg_a"]]] = r["rho"]
                d = np.asarray(d, float)
                free = float(np.prod(np.sort(1 / d)))
                got, exact, reason = joint(1 / d, c) if rhos is not None else (free, True, None)
                out.append((wager, len(d), free, got, exact, reason))
            yield pd.DataFrame(out, columns=["wager_id", "n_legs", "independent", "joint", "exact", "reason"])

    out = own.mapInPandas(run, "wager_id long, n_legs int, independent double, joint double, exact boolean, reason string")
    decimals = {"independent_decimal": F.try_divide(F.lit(1.0), "independent"), "correlated_decimal": F.try_divide(F.lit(1.0), "joint")}
    return out.withColumns(decimals).withColumn("haircut", F.try_divide(F.col("independent_decimal") - F.col("correlated_decimal"), "independent_decimal"))


def teasers(legs: DataFrame, pairs: DataFrame, points: str = "points", original: str = "odds", teased: str = "teased_odds") -> DataFrame:
    """Tickets priced by their legs' teased prices; refused ones carry a reason and no price.

    Points must lie in (0, 30], and no teased price may be longer than the leg's own.
    """
    bad = F.when(F.col(points).isNull() | F.isnan(points) | (F.col(points) <= 0) | (F.col(points) > MAX_TEASER_POINTS), "teaser_points").when(F.col(teased) > F.col(original), "teaser_not_favourable").when(F.col(teased) <= 1, "odds_out_of_range")
    why = legs.groupBy("wager_id").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("leg_id"))).alias("refused"))
    fine = legs.join(why.filter("refused IS NULL").select("wager_id"), "wager_id", "left_semi")
    priced = correlated_parlays(fine, pairs, teased)
    return why.join(priced, "wager_id", "left").select("wager_id", "n_legs", "joint", "correlated_decimal", "exact", F.coalesce("refused", "reason").alias("reason"))
