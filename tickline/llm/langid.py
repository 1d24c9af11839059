"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text is read as segments: its words as UTF-8 bytes, long ones in windows of ``WINDOW`` bytes. Two gated
recurrent layers run over a segment, forward and backward; a softmax labels every byte position; a document's
probabilities are the mean over all its positions. Weights come from backpropagation through time over sampled
segments of fitting documents. Equal segments are labelled once a task and reused.

Cases: null texts and texts without a letter are ``und`` with score 0; so is everything where nothing could be
learned. Repeated rows get equal results; an empty table gives an empty result; only text is read to predict.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import FIT_CHARS, fold, slices

UNKNOWN = "und"
HIDDEN, WINDOW = 12, 24
SAMPLE_DOCS, SAMPLE_WORDS, STEPS, BATCH = 400, 40, 260, 384
KEEP = 300_000


def segments(word: str) -> list[bytes]:
    data = word.encode("utf-8", "surrogatepass")
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def init(langs: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN
    p = {"out": rng.normal(0, 0.3, (2 * h, langs)), "bias": np.zeros(langs)}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))  # input rows by byte: update, reset and candidate
        p[f"u{d}"] = rng.normal(0, 0.3, (h, 2 * h))
        p[f"c{d}"] = rng.normal(0, 0.3, (h, h))
        p[f"v{d}"] = np.zeros(3 * h)
    return {k: x.astype(np.float32) for k, x in p.items()}


def _layer(p: dict, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) over bytes x (time, batch)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape, HIDDEN), np.float32)
    table = p[f"x{d}"] + p[f"v{d}"]
    for t in range(x.shape[0]):
        e = table[x[t]]
        g = _sigmoid(e[:, : 2 * HIDDEN] + h @ p[f"u{d}"])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = np.tanh(e[:, 2 * HIDDEN :] + (r * h) @ p[f"c{d}"])
        if keep is not None:
            keep.append((h, z, r, c))
        h = h + z * (c - h)
        out[t] = h
    return out


def _layer_back(p: dict, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
    """Backpropagation through time: adds to ``grad`` from the gradients of all hidden states."""
    dh = np.zeros_like(dout[0])
    gx = np.zeros((256, 3 * HIDDEN), np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, c = kept[t]
        dh = dh + dout[t]
        dc = dh * z * (1 - c * c)
        drh = dc @ p[f"c{d}"].T
        dz, dr = dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)
        dg = np.concatenate([dz, dr], 1)
        grad[f"c{d}"] += (r * h).T @ dc
        grad[f"u{d}"] += h.T @ dg
        de = np.concatenate([dg, dc], 1)
        onehot = np.argsort(x[t], kind="stable")
        own, first = np.unique(x[t][onehot], return_index=True)
        gx[own] += np.add.reduceat(de[onehot], first, axis=0)
        dh = dh * (1 - z) + drh * r + dg @ p[f"u{d}"].T
    grad[f"x{d}"] += gx
    grad[f"v{d}"] += gx.sum(0)


def positions(p: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities (time, batch, languages) of every byte position of equally long segments."""
    h = np.concatenate([_layer(p, "f", x), _layer(p, "b", x[::-1])[::-1]], 2)
    e = np.exp(h @ p["out"] + p["bias"])
    return e / e.sum(2, keepdims=True)


def step(p: dict, state: dict, x: np.ndarray, y: np.ndarray, rate: float, n: int) -> None:
    """One Adam step on the mean log loss over all positions of a batch of equally long segments."""
    kf: list = []
    kb: list = []
    h = np.concatenate([_layer(p, "f", x, kf), _layer(p, "b", x[::-1], kb)[::-1]], 2)
    e = np.exp(h @ p["out"] + p["bias"])
    d = e / e.sum(2, keepdims=True)
    d[:, np.arange(len(y)), y] -= 1
    d /= d.shape[0] * d.shape[1]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["out"], grad["bias"] = np.einsum("tbh,tbl->hl", h, d), d.sum((0, 1))
    dh = d @ p["out"].T
    _layer_back(p, "f", x, kf, dh[:, :, :HIDDEN], grad)
    _layer_back(p, "b", x[::-1], kb, dh[::-1, :, HIDDEN:], grad)
    norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grad.values()))))
    for k, g in grad.items():
        m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        g = g / norm
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p[k] -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)


def train(sample: list[tuple[bytes, int]], langs: int) -> dict[str, np.ndarray]:
    """Train on (segment, language) pairs: batches of one length, lengths drawn by their bytes."""
    p, state, rng = init(langs), {}, np.random.default_rng(9)
    by: dict[int, list] = {}
    for s, y in sample:
        by.setdefault(len(s), []).append((s, y))
    sizes = sorted(by)
    share = np.array([n * len(by[n]) for n in sizes], float)
    for n in range(1, STEPS + 1):
        own = by[sizes[rng.choice(len(sizes), p=share / share.sum())]]
        pick = [own[i] for i in rng.integers(0, len(own), min(BATCH, len(own)))]
        x = np.frombuffer(b"".join(s for s, _ in pick), np.uint8).reshape(len(pick), -1).T
        step(p, state, x, np.array([y for _, y in pick]), 0.02 if n < STEPS * 0.7 else 0.006, n)
    return p


def fit(docs: DataFrame) -> tuple[list[str], dict] | None:
    """Fit on at most ``SAMPLE_DOCS`` documents a language (crc32 mod 4 is not 2) and ``SAMPLE_WORDS`` words of each.

    Ids are chosen by their hash; words by a hash too, over the whole text. Languages are the non-null lang values
    of fitting documents; their number must stay small (a model output each). Of rows of one id the least text
    counts, and texts of over ``FIT_CHARS`` characters are not fitted on, which bounds what reaches the driver.
    """
    own = docs.select("doc_id", "lang").filter((fold("doc_id", 4) != 2) & F.col("lang").isNotNull())
    h = F.xxhash64("doc_id")
    # the smallest hashes of each language, first within salted groups, so that no task holds a language's rows
    some = own.withColumn("h", h).withColumn("n", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id"))).filter(F.col("n") <= SAMPLE_DOCS)
    pick = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= SAMPLE_DOCS).select("doc_id").distinct()
    rows = docs.select("doc_id", "text", "lang").filter((F.length("text") <= FIT_CHARS) & F.col("lang").isNotNull()).join(F.broadcast(pick), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "t.*").collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    sample = []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        words = sorted({w for w in r.text.split() if any(c.isalpha() for c in w)}, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))
        sample += [(s, langs.index(r.lang)) for w in words[:SAMPLE_WORDS] for s in segments(w)]
    return (langs, train(sample, len(langs))) if sample else None


class Labeller:
    """Sums of position probabilities of words, kept for words seen before."""

    def __init__(self, p: dict, langs: int):
        self.p, self.langs = p, langs
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((1 << 16, self.langs + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        first = len(self.row)
        while first + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[first : first + len(words)] = 0
        by: dict[int, list] = {}
        for i, w in enumerate(words):
            for s in segments(w):
                by.setdefault(len(s), []).append((first + i, s))
        for n, own in by.items():
            for k in range(0, len(own), 4096):
                at = np.array([i for i, _ in own[k : k + 4096]])
                x = np.frombuffer(b"".join(s for _, s in own[k : k + 4096]), np.uint8).reshape(len(at), n).T
                np.add.at(self.sums[:, :-1], at, positions(self.p, x).sum(0))
                np.add.at(self.sums[:, -1], at, n)
        self.row.update(zip(words, range(first, first + len(words)), strict=True))

    def pooled(self, texts: list) -> np.ndarray:
        """Mean probabilities of each text's positions; rows of zeros for texts without words."""
        if len(self.row) > KEEP:
            self.forget()
        cut = [(t or "").split() for t in texts]
        self._learn(list({w: 0 for words in cut for w in words if w not in self.row}))
        out = np.zeros((len(texts), self.langs))
        for i, words in enumerate(cut):
            if words:
                s = self.sums[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
                out[i] = s[:-1] / s[-1]
        return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: tuple[list[str], dict] | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches):
        labeller = Labeller(model[1], len(model[0])) if model else None
        for batch in batches:
            for part in slices(batch, 1024):
                texts = part.column(1).to_pylist()
                known = [labeller is not None and has_letter(t) for t in texts]
                pooled = labeller.pooled(texts) if labeller else np.zeros((len(texts), 1))
                best = pooled.argmax(1)
                name = [model[0][b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(pooled.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
