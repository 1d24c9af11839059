"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings (word, first four bytes, last four bytes). Filters
of widths 1, 2 and 3 run over every word of the text, are max-pooled over the text and feed one logit. The
threshold is calibrated on the fitting rows for each language that the text itself shows (votes of typical
words, never the lang column), and scores are bent so that every language's threshold lies at 0.7.
Null and empty texts hold no words: zero vectors are pooled. Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickline.llm.common import Memo, fold, labelled_sample, slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 12, (1, 2, 3)
SAMPLE, STEPS, BATCH, LEAST_DOCS = 3600, 340, 32, 3
CUT = 0.7
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„…¿¡"


#: A bucket needs 17 bits, for the padding too; the 12 above three of them hold votes for 4,095 languages, more than there are fitting rows.
BITS = 17
PAD = sum(BUCKETS << BITS * k for k in range(3))


def _buckets(word: str, typical: dict[str, int] | None = None) -> int:
    """The word's three buckets, ``BITS`` each, above them its vote for a language number (0: none)."""
    w = word.lower().strip(STRIP).encode("utf-8", "surrogatepass")
    vote = typical.get(w.decode("utf-8", "surrogatepass"), -1) + 1 if typical else 0
    return vote << 3 * BITS | zlib.crc32(w) % BUCKETS << 2 * BITS | zlib.crc32(w[:4], 1) % BUCKETS << BITS | zlib.crc32(w[-4:], 2) % BUCKETS


def _packed(texts: list, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Packed words of all texts, padding after each text, and each text's start."""
    parts, starts, at = [], [], 0
    pad = np.full(max(WIDTHS), PAD, np.int64)
    for t in texts:
        words = (t or "").split()
        starts.append(at)
        parts += [np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), pad]
        at += len(words) + len(pad)
    return np.concatenate(parts), np.array(starts)


def _tokens(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> BITS * k & (1 << BITS) - 1 for k in (2, 1, 0)], 1)


class Net:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32), "v": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.full(1, -2.0, np.float32), "b": np.zeros(FILTERS * len(WIDTHS), np.float32)}
        self.p["e"][BUCKETS] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32)
        self.g2 = {k: np.full(x.shape, 1e-6, np.float32) for k, x in self.p.items()}

    def pooled(self, tokens: np.ndarray, starts: np.ndarray, where: bool = False):
        """Max-pooled filter outputs; ``where`` adds the positions of the maxima."""
        e = self.p["e"]
        x = e[tokens[:, 0]] + e[tokens[:, 1]] + e[tokens[:, 2]]
        n, outs, spots = len(x), [], []
        ends = np.append(starts[1:], n)
        for k, w in enumerate(WIDTHS):
            y = x @ self.p[f"w{w}"][0]
            for j in range(1, w):
                y[: n - j] += x[j:] @ self.p[f"w{w}"][j]
            for j in range(1, w):
                y[ends - j] = -np.inf  # padding whose windows reach into the next text
            top = np.maximum.reduceat(y, starts, axis=0)
            if where:
                spots.append(np.stack([s + y[s:t].argmax(0) for s, t in zip(starts, ends, strict=True)]))
            outs.append(top + self.p["b"][k * FILTERS : (k + 1) * FILTERS])
        h = np.maximum(np.concatenate(outs, 1), 0)
        return (h, x, np.concatenate(spots, 1)) if where else h

    def raw(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.pooled(tokens, starts) @ self.p["v"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))

    def step(self, tokens: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One Adagrad step on the weighted log loss; gradients flow through the pooled positions alone."""
        h, x, at = self.pooled(tokens, starts, True)
        z = h @ self.p["v"] + self.p["c"]
        d = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * weight / len(y)).astype(np.float32)
        grad = {"v": h.T @ d + 1e-5 * self.p["v"], "c": d.sum(keepdims=True)}
        dh = np.outer(d, self.p["v"]) * (h > 0)
        grad["b"] = dh.sum(0)
        rows, parts = [], []
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            kernel = self.p[f"w{w}"]
            grad[f"w{w}"] = np.zeros_like(kernel)
            for j in range(w):
                here = np.minimum(at[:, cols] + j, len(x) - 1)
                grad[f"w{w}"][j] = np.einsum("df,dfe->ef", dh[:, cols], x[here])
                rows.append(here.ravel())
                parts.append((dh[:, cols, None] * kernel[j].T[None]).reshape(-1, DIM))
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        live = np.abs(parts).sum(1) > 0
        buckets, parts = tokens[rows[live]].ravel(), np.repeat(parts[live], 3, axis=0)
        order = np.argsort(buckets, kind="stable")
        own, first = np.unique(buckets[order], return_index=True)
        ge = np.add.reduceat(parts[order], first, axis=0) if len(own) else np.zeros((0, DIM), np.float32)
        keep = own < BUCKETS
        own, ge = own[keep], ge[keep]
        self.g2["e"][own] += ge * ge
        self.p["e"][own] -= rate * ge / np.sqrt(self.g2["e"][own])
        for k, g in grad.items():
            self.g2[k] += g * g
            self.p[k] -= rate * g / np.sqrt(self.g2[k])


def _typical(texts: list[str], langs: list) -> dict[str, int]:
    """Word to language number: the words most typical of each language of the fitting rows."""
    count, docs = defaultdict(Counter), Counter()
    for t, lang in zip(texts, langs, strict=True):
        if lang is not None:
            count[lang].update({w.lower().strip(STRIP) for w in t.split()})
            docs[lang] += 1
    names, typical = sorted(docs), {}
    for k, lang in enumerate(names):
        others = [x for x in names if x != lang]
        over = {w: n / docs[lang] - max([count[o][w] / docs[o] for o in others], default=0) for w, n in count[lang].items() if n >= 3}
        for w in sorted(over, key=lambda w: (-over[w], w))[:100]:
            if over[w] > 0.05:
                typical[w] = k
    return typical


def shown_language(packed: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Language number with most votes of typical words, the lower on ties; ``n`` where no word votes."""
    votes = np.stack([np.add.reduceat((packed >> 3 * BITS == k + 1).astype(np.int32), starts) for k in range(n)] or [np.zeros(len(starts), np.int32)], 1)
    return np.where(votes.max(1) > 0, votes.argmax(1), n)


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1, midway to the next lower score; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.02, 0.98))


def fit_net(texts: list[str], labels: list[int], langs: list) -> dict:
    net, memo, rng = Net(), Memo(_buckets, 2_000_000), np.random.default_rng(11)
    y = np.array(labels, np.float32)
    weight = np.where(y > 0, 3.0, 1.0)
    sets = [_tokens(_packed([t], memo)[0]) for t in texts]
    # buckets of fewer than LEAST_DOCS documents say nothing general: their vectors stay zero
    seen = np.zeros(BUCKETS + 1, np.int32)
    for t in sets:
        seen[np.unique(t)] += 1
    rare = seen < LEAST_DOCS
    rare[BUCKETS] = True
    net.p["e"][rare] = 0
    sets = [np.where(rare[t], BUCKETS, t) for t in sets]
    order: list[int] = []
    for n in range(STEPS):  # as many steps for few rows as for many
        while len(order) < BATCH:
            order += rng.permutation(len(sets)).tolist()
        own, order = np.array(order[:BATCH]), order[BATCH:]
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])[:-1]])
        net.step(np.concatenate([sets[i] for i in own]), starts, y[own], weight[own], 0.06 / (1 + 1.5 * n / STEPS))
    p = np.concatenate([net.raw(s, np.zeros(1, int)) for s in sets])
    typical = _typical(texts, langs)
    n = max(typical.values(), default=-1) + 1
    shown = shown_language(*_packed(texts, Memo(partial(_buckets, typical=typical))), n)
    overall = _best_cut(p, y)
    cuts = [_best_cut(p[shown == k], y[shown == k]) if y[shown == k].sum() >= 10 else overall for k in range(n)] + [overall]
    return {"net": {k: x for k, x in net.p.items()}, "typical": typical, "cuts": np.array(cuts)}


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> dict | None:
    """Fit on at most ``limit`` labelled rows outside the held-out fold (crc32 mod 3 = 1)."""
    rows = labelled_sample(docs, labels, "toxic", 3, 1, limit, True)
    return fit_net([r.text for r in rows], [int(r.label > 0) for r in rows], [r.lang for r in rows]) if rows else None


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and calibrated score of every row; without fitting rows every score is 0."""

    def run(batches):
        memo = Memo(partial(_buckets, typical=model and model["typical"]))
        net = Net.__new__(Net)
        net.p = model["net"] if model else {}
        for batch in batches:
            for part in slices(batch, 256, 400_000):
                texts = part.column(1).to_pylist()
                if model:
                    packed, starts = _packed(texts, memo)
                    p = net.raw(_tokens(packed), starts)
                    cut = model["cuts"][shown_language(packed, starts, len(model["cuts"]) - 1)]
                    score = np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut))
                else:
                    score = np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
