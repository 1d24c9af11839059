"""Near duplicates: universal hash minima, bands, verification on full sets, connected components.

Documents with equal shingle sets form a class with a number of its own, whatever ids its rows have. Class representatives have
``BANDS`` x rows minima of multiply-shift hashes; a band's minima name a bucket, and two sets of the threshold's
similarity share none with a chance below one in a million. Inside a bucket no pairs are listed: its members are
held against one pivot, then, where the bucket still holds more than one component, against pivots chosen anew.
Last, for members of buckets that are still open, shingles that no other such member has are counted: they bound
the similarity that two sets can reach, and only members of different components whose bound allows a link are
held against each other. Pairs whose signatures are far below the threshold go; every other pair is confirmed on
the full sets. Links become components by alternating
large-star and small-star steps on stored edge tables.

Cases: a document without words (or null) has an empty set, size 0, and is alone; with fewer words than a
shingle the whole sequence is its one shingle; a row is a document, so rows of equal id keep their own sets;
rows with null ids can't be linked and stay out of classes (component null); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import Memo, slices, stored

BANDS = 30
MISS = 1e-6
CELLS = 64
CHUNK = 1500
PIVOT_ROUNDS = 2
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def rows_for(threshold: float) -> int:
    """The most rows a band for which a pair at the threshold shares no band with a chance below ``MISS``."""
    r = 1
    while (1 - threshold ** (r + 1)) ** BANDS < MISS:
        r += 1
    return r


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * M1
    return x ^ x >> np.uint64(32)


def word_hashes(text: str | None, memo: Memo) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, cut at the space and bytes 9 to 13."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = _mix(h * M2 + words[j : n - size + 1 + j] * M3)
    return np.unique(h)


def _params(rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    k = BANDS * rows
    return rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


def minima(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """(sets, BANDS * rows) minima of (a x + b) >> 32; the sets must not be empty."""
    a, b = _params(rows)
    n = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
    out = np.empty((len(sets), len(a)), np.uint32)
    for lo, hi in _runs(n, 60_000):
        x = flat[starts[lo] : starts[hi - 1] + n[hi - 1]]
        y = np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            out[lo:hi, k] = np.minimum.reduceat(y, starts[lo:hi] - starts[lo]) >> np.uint64(32)
    return out


def _runs(n: np.ndarray, most: int):
    lo, total = 0, 0
    for i, size in enumerate(n):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if len(n):
        yield lo, len(n)


def _memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def signed(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two key words of the set, the band buckets and the signature of every row."""

    def run(batches):
        memo = _memo()
        for batch in batches:
            for part in slices(batch, 512, 1_500_000):
                sets = [shingles(word_hashes(t, memo), k) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), 2), np.int64)
                for i in full:
                    keys[i] = set_key(sets[i])
                buckets, sig = [None] * len(sets), [None] * len(sets)
                if full:
                    m = minima([sets[i] for i in full], rows)
                    h = np.arange(BANDS, dtype=np.uint64)[None, :] * M3
                    for r in range(rows):
                        h = _mix(h * M2 + m[:, r::rows].astype(np.uint64))
                    low = m.astype(np.uint16)
                    for j, i in enumerate(full):
                        buckets[i], sig[i] = h[j].astype(np.int64), low[j].tobytes()
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(buckets, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n", "k1", "k2", "buckets", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, buckets array<long>, sig binary")


def set_key(shingle_set: np.ndarray) -> np.ndarray:
    """The two key words of a set that is not empty."""
    return np.frombuffer(hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest(), np.int64)


class Texts:
    """One text of each class: that of the row whose id the class names (``text_id``).

    An id may have rows of several sets (``mixed``); of its texts the one counts whose set has the class's key.
    """

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int):
        self.docs = docs.select(F.col("doc_id").alias("text_id"), "text").filter("text IS NOT NULL AND text_id IS NOT NULL")
        self.classes, self.k = classes.select("rep", "text_id", "mixed", "k1", "k2"), k

    def of(self, ids: DataFrame, bound: int = 500_000) -> DataFrame:
        """rep and text of the classes in ``ids`` (distinct rep), a row each. Broadcasts only when a count proves at most ``bound``."""
        want = stored(self.classes.join(ids, "rep"), "near-wanted")
        n = want.count()
        own = self.docs.join(F.broadcast(want) if n <= bound else want, "text_id")
        texts = own.filter("NOT mixed").select("rep", "text")
        if not want.filter("mixed").isEmpty():
            texts = texts.union(own.filter("mixed").select("rep", "text", "k1", "k2").mapInArrow(self._same, "rep long, text string"))
        return texts.groupBy("rep").agg(F.min("text").alias("text"))

    def _same(self, batches):
        memo = _memo()
        for batch in batches:
            for part in slices(batch, 64, 1_000_000):
                sets = [shingles(word_hashes(t, memo), self.k) for t in part.column(1).to_pylist()]
                wanted = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                fits = [len(s) > 0 and tuple(set_key(s).tolist()) == w for s, w in zip(sets, wanted, strict=True)]
                yield part.filter(pa.array(fits)).select([0, 1])

    def __getstate__(self) -> dict:
        return {"k": self.k}  # tasks need no frames


def allowed(open_rows: DataFrame, texts: Texts, k: int, threshold: float) -> DataFrame:
    """The open rows (bucket, rep, component) with what bounds an overlap: n (set size), u (shingles of no other
    open member), cells (the others counted in ``CELLS`` cells by hash), and all open buckets of the member.

    Two sets share at most min(n - u, n' - u') shingles, and at most the sum of the cells' minima. Members that
    cannot reach the threshold with any set go.
    """
    per_mille = round(threshold * 1000)

    def run(batches):
        memo = _memo()
        for batch in batches:
            for part in slices(batch, 64, 300_000):
                sets = [shingles(word_hashes(t, memo), k) for t in part.column(1).to_pylist()]
                n = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "s"])

    ids = open_rows.select("rep").distinct()
    rows = texts.of(ids).mapInArrow(run, "rep long, s long").distinct()
    rare = rows.groupBy("s").agg(F.count("*").alias("f"), F.min("rep").alias("rep")).filter("f = 1")
    cell = F.pmod("s", F.lit(CELLS)).alias("cell")
    both = rows.select("rep", cell, F.lit(1).alias("n"), F.lit(0).alias("u")).union(rare.select("rep", cell, F.lit(0).alias("n"), F.lit(1).alias("u")))
    cells = both.groupBy("rep", "cell").agg(F.sum("n").alias("n"), F.sum("u").alias("u"))
    own = cells.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), F.map_from_entries(F.collect_list(F.struct("cell", (F.col("n") - F.col("u")).cast("int").alias("c")))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))
    own = stored(own.filter(1000 * (F.col("n") - F.col("u")) >= per_mille * F.col("n")).select("rep", "n", "u", counts.alias("cells")), "near-bounds")
    return open_rows.join(own, "rep")


def possible(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components whose bounds allow the threshold.

    A bucket's members are dealt to chunks of about ``CHUNK``; two chunks meet in one group, so that no group holds
    more than two chunks, whatever the bucket's size, and only pairs that pass leave it.
    """
    per_mille = round(threshold * 1000)
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"), F.min("component").alias("low"), F.max("component").alias("high"))
    own = rows.join(sizes.filter("low < high").drop("low", "high"), "bucket").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    own = own.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    groups = max(1, own.count() // 20_000)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), f in frame.groupby(["bucket", "lo", "hi"]):
            rep, comp, n, u, chunk = (f[c].to_numpy() for c in ("rep", "component", "n", "u", "chunk"))
            cells = np.stack(f["cells"].to_numpy()).astype(np.int32)
            left, right = (np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi))
            for i in left:
                js = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) | (lo != hi))]
                for bound in (lambda j, i=i: np.minimum(n[i] - u[i], n[j] - u[j]), lambda j, i=i: np.minimum(cells[i], cells[j]).sum(1)):
                    most = bound(js)
                    js = js[1000 * most >= per_mille * (n[i] + n[js] - most)]
                out.append(np.stack([np.full(len(js), rep[i]), rep[js]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    keyed = own.select("bucket", "lo", "hi", "chunk", "rep", "component", "n", "u", "cells", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(groups)).alias("g"))
    return keyed.groupBy("g").applyInPandas(meet, "a long, b long")


def confirmed(pairs: DataFrame, reps: DataFrame, texts: Texts, k: int, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) whose full sets reach the threshold; the signatures sort out hopeless ones first."""
    per_mille = round(threshold * 1000)

    def alike(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (2, 3))
                yield b.filter(pa.array((x == y).mean(1) >= threshold - 6 * (threshold * (1 - threshold) / x.shape[1]) ** 0.5)).select([0, 1])

    sigs = reps.select("rep", "sig")
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    near = stored(both.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long"), "near-pairs")

    def exact(batches):
        memo = _memo()
        last, own = None, None
        for batch in batches:
            for b in (row for part in slices(batch, 64, 1_000_000, 3) for row in part.to_pylist()):  # few texts at a time
                if b["a"] != last:
                    last, own = b["a"], shingles(word_hashes(b["ta"], memo), k)
                other = shingles(word_hashes(b["tb"], memo), k)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 1000 * both >= per_mille * (len(own) + len(other) - both):
                    yield pa.RecordBatch.from_pylist([{"a": b["a"], "b": b["b"]}], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    ids = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = texts.of(ids)
    with_a = near.join(own.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(own.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return stored(with_b.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for all nodes of edges (a, b); large-star and small-star in turn."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = stored(small, "stars")
        # a fixpoint has the edges it began with
        if new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty():
            break
        now = new
    roots = new.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def linked(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, n (set size) and component of every row."""
    rows = rows_for(threshold)
    all_rows = stored(signed(docs, k, rows), "near-signed")
    full = all_rows.filter("n > 0 AND doc_id IS NOT NULL")
    kinds = all_rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(((F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2"))).alias("mixed"))
    plain = full.groupBy("k1", "k2", "doc_id").agg(F.first("buckets").alias("buckets"), F.first("sig").alias("sig")).join(kinds, "doc_id")
    # a class is read by an id of one set, where it has such an id
    classes = plain.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.min(F.struct("mixed", F.col("doc_id").alias("text_id"))).alias("t"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "low", "t.*", "buckets", "sig"), "near-classes")
    reps, texts = classes.select("rep", "buckets", "sig"), Texts(docs, classes, k)
    members = stored(reps.select("rep", F.explode("buckets").alias("bucket")), "near-buckets")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = stored(members.join(shared, "bucket"), "near-shared")
    links = None
    label = reps.select("rep", F.col("rep").alias("component"))
    for turn in range(PIVOT_ROUNDS + 1):
        at = members.join(label, "rep") if turn else members.withColumn("component", F.col("rep"))
        order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
        pivot = at.groupBy("bucket").agg(F.min_by(F.struct("rep", "component"), order).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        if turn < PIVOT_ROUNDS:
            pairs = at.join(pivot.select("bucket", F.col("p.rep").alias("a"), F.col("p.component").alias("ca")), "bucket").filter("component <> ca").select("a", F.col("rep").alias("b"))
        else:
            open_rows = stored(at.join(pivot.select("bucket"), "bucket").select("bucket", "rep", "component"), "near-open")
            if open_rows.isEmpty():
                break
            open_rows = stored(allowed(open_rows, texts, k, threshold), "near-allowed")
            pairs = possible(open_rows, threshold)
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        if pairs.isEmpty():
            break
        found = confirmed(pairs, reps, texts, k, threshold)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            links = stored(links, "near-links")
            comp = stored(components(links), "near-components")
            label = reps.select("rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    named = classes.select("rep", "k1", "k2", "low").join(label, "rep")
    named = named.join(named.groupBy("component").agg(F.min("low").alias("least")), "component").select("k1", "k2", F.col("least").alias("component"))
    return all_rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component"))


def near_duplicates(docs: DataFrame, k: int = 3, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    out = linked(docs, k, threshold)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group, all columns; rows with null ids stay; of rows with a kept id one stays."""
    out = linked(docs, k, threshold).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("component")).alias("c"), F.count("*").alias("n"))
    keep = stored(out.filter("doc_id = c").select(F.col("doc_id").alias("_id"), F.col("n").alias("_n")), "near-kept")
    own = docs.join(keep, docs["doc_id"] == keep["_id"])
    once = own.filter("_n = 1").select(docs.columns)
    many = own.filter("_n > 1").withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("text"))).filter("_r = 1").select(docs.columns)
    return once.unionByName(many).unionByName(docs.filter("doc_id IS NULL"))
