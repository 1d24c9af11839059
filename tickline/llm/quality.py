"""Quality: logistic regression over hashed word n-grams, fitted with FTRL-proximal updates.

Rows: an n-gram is a word or a pair of neighbouring words; each word also has a shape (capitals at its
start, and its signs), whose n-grams are hashed into the same table, so that unseen words count.
A document's vector holds each n-gram's share of the document. Null and empty texts have the bias alone.
Repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickline.llm.common import Memo, fold, labelled_sample, slices

BITS = 18
SIZE = 1 << BITS
SAMPLE = 4000
EPOCHS = 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(word: str) -> int:
    """Hashes of the word and of its shape (capitals at the start, then its signs), packed into 64 bits."""
    head = "A" if word[1:2].isupper() else "a"
    signs = "" if word.isalpha() else "".join(c for c in word if not c.isalnum())[:8]
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32((head + signs).encode("utf-8", "surrogatepass"))


def _hashed(x: np.ndarray, kind: int) -> np.ndarray:
    return ((x + np.uint64(kind)) * MIX >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(text: str, memo: Memo) -> np.ndarray:
    """Table positions of all n-grams of a text, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    same = (word[1:] == word[:-1]).astype(np.uint64)
    pairs = word[:-1] * np.uint64(31) + word[1:]
    shapes = shape[:-1] * np.uint64(31) + shape[1:]
    return np.concatenate([_hashed(word, 1), _hashed(shape, 2), _hashed(pairs, 3), _hashed(shapes, 4), _hashed(same, 5)])


def fit_ftrl(texts: list[str], labels: list[int], alpha: float = 0.8, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, one document at a time in a fixed pseudorandom order."""
    memo = Memo(_codes)
    rows = []
    for t in texts:
        grams = ngrams(t, memo)
        at, n = np.unique(grams, return_counts=True)
        rows.append((at, (n * (5.0 / max(1, len(grams)))).astype(np.float64)))
    z, n, w = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - labels[i]) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:SIZE].astype(np.float32), float(w[SIZE])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``limit`` labelled rows outside the held-out fold (crc32 mod 3 = 1)."""
    rows = labelled_sample(docs, labels, "quality", 3, 1, limit)
    if not rows:
        return np.zeros(SIZE, np.float32), 0.0
    return fit_ftrl([r.text for r in rows], [int(r.label > 0) for r in rows])


def scorer(model: tuple[np.ndarray, float]):
    weights, bias = model

    def score(texts: list, memo: Memo) -> np.ndarray:
        grams = [ngrams(t or "", memo) for t in texts]
        n = np.array([len(g) for g in grams])
        sums = np.zeros(len(grams))
        if n.sum():
            full = n > 0
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
            sums[full] = np.add.reduceat(weights[np.concatenate(grams)].astype(np.float64), starts)
        return 1 / (1 + np.exp(-np.clip(bias + 5.0 * sums / np.maximum(n, 1), -35, 35)))

    return score


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row."""
    score = scorer(model)

    def run(batches):
        memo = Memo(_codes)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(part.column(1).to_pylist(), memo))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows, all columns, whose score is at least 0.5."""
    score, at = scorer(model), docs.columns.index("text")

    def run(batches):
        memo = Memo(_codes)
        for batch in batches:
            for part in slices(batch, text=at):
                yield part.filter(pa.array(score(part.column(at).to_pylist(), memo) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
