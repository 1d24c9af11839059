"""Hard-negative mining over an STR-packed R-tree, exact.

The tree has three storeys. Rows are sorted and tiled over the whole table (length, label, slab of one coordinate, another coordinate) into
tiles of about ``TILE`` rows, each written as one row. Inside a tile, sort-tile-recursive packing makes leaves of ``LEAF``
entries and inner nodes of ``FAN`` children. Above the tiles is their directory: a bounding box and the range of
labels for each. For an anchor ``a`` a box [lo, hi] bounds the inner product by ``sum(max(a*lo, a*hi))`` and ``sum(min(a*lo, a*hi))``.

A search looks for the first ``k`` rows in each of an anchor's score windows. It visits the anchor's most promising
tile first; what it finds there bounds, for the second visit, which other tiles can hold anything. Inside a tile a queue takes
nodes by their upper bound within the windows, and a node is left out if it lies outside every window or strictly below
the k-th score of each window that it meets (an equal score may come with a smaller id). Positives are such a search with one
open window among equal labels; their scores set the windows of the second search, among other labels.

Anchors meet the directory and the tiles in blocks of at most ``ANCHORS`` and ``CHUNK`` rows; nothing is broadcast or
collected but a sample of ``SAMPLE`` vectors, from which the axes and slabs of the tiling are chosen (the tiling affects
speed, never results). Equal vectors of a label are one entry with its smallest ids, as many as a search can need, so a vector that a
third of the rows share is no burden.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of different lengths
never meet; equal rows count once; rows of an anchor's own id are none of its partners; rows of equal id and different vectors
are rows of their own (an anchor of each); an anchor without positives, or a positive without negatives, gives no rows; an empty table
gives no rows; other columns are not read. Numbers too large for exact doubles are multiplied as Python integers, and a score
that no long can hold is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import stored

TILE, LEAF, FAN = 8192, 64, 16
ANCHORS, CHUNK, SAMPLE = 1000, 2000, 4000
EXACT = float(1 << 53)


OPEN = (1 << 63) - 1


def mining_rows(vectors: DataFrame, scale: int = 256, relabel: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label (moved on by one where the id is divisible by ``relabel``) and ``v`` (doubles) of the rows that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    own = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    own = own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(fine)
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return own.select("vec_id", moved.cast("long").alias("label"), "v")


def entries(rows: DataFrame, ids: int) -> DataFrame:
    """label, v and the ``ids`` smallest ids of each distinct vector of a label; tasks keep no more of them before the shuffle either."""
    own = rows.select("label", "v", "vec_id").distinct()
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    own = own.withColumn("place", place).filter(F.col("place") <= ids)
    return own.groupBy("label", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def str_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of the rows: slabs of one axis after the other, the widest axes first."""
    pages = -(-len(x) // leaf)
    axes = np.argsort(-x.var(0), kind="stable")[: max(1, int(np.ceil(np.log2(max(2, pages)))))] if x.shape[1] else []

    def tiled(own: np.ndarray, rest: np.ndarray) -> np.ndarray:
        n = -(-len(own) // leaf)
        if n <= 1 or not len(rest):
            return own
        own = own[np.argsort(x[own, rest[0]], kind="stable")]
        size = -(-n // int(np.ceil(n ** (1 / len(rest)) - 1e-9))) * leaf
        return np.concatenate([tiled(own[i : i + size], rest[1:]) for i in range(0, len(own), size)])

    return tiled(np.arange(len(x)), axes)


def _tree(label: np.ndarray, q: np.ndarray) -> list[tuple]:
    """Boxes (lo, hi, least label, greatest label) of each level, leaves first, over rows in packed order."""
    levels, step = [], LEAF
    lo = hi = q
    a = b = label
    while True:
        at = np.arange(0, len(lo), step)
        lo, hi = np.minimum.reduceat(lo, at, 0), np.maximum.reduceat(hi, at, 0)
        a, b = np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)
        levels.append((lo, hi, a, b))
        if len(at) == 1:
            return levels
        step = FAN


TILE_SCHEMA = "tile string, dim int, n long, label_lo long, label_hi long, box_lo binary, box_hi binary, labels binary, q binary, ids binary, many binary"


def _pack(scale: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if not own:
            return
        own = pd.concat(own, ignore_index=True)
        for dim, part in own.groupby("dim"):
            for start in range(0, len(part), 2 * TILE):  # ranges come out uneven, and rows of equal keys too many
                f = part.iloc[start : start + 2 * TILE]
                q, label = np.floor(np.stack(f["v"].to_numpy()) * scale).reshape(len(f), dim), f["label"].to_numpy()
                order = np.concatenate([np.flatnonzero(label == x)[str_order(q[label == x])] for x in np.unique(label)])
                q, label, ids = q[order], label[order], [f["ids"].iloc[i] for i in order]
                boxes = (q.min(0), q.max(0))
                row = (f"{f['range'].iloc[0]}-{dim}-{start}", dim, len(f), label.min(), label.max(), *(x.tobytes() for x in boxes), label.astype(np.int64).tobytes(), q.tobytes())
                yield pd.DataFrame([(*row, np.concatenate(ids).astype(np.int64).tobytes(), np.array([len(x) for x in ids], np.int64).tobytes())], columns=[c.split()[0] for c in TILE_SCHEMA.split(", ")])

    return run


def build(rows: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """The tiles of the tree, stored: a row each, with its box, its range of labels and its packed entries."""
    own = stored(entries(rows, k + 1), "negatives-entries").withColumn("dim", F.size("v"))
    n = own.count()
    tiles = max(1, -(-n // TILE))
    sample = own.orderBy(F.xxhash64("label", "v")).limit(SAMPLE).select("label", "v", "dim").collect()
    common = int(pd.Series([r.dim for r in sample]).mode().max()) if sample else 0
    x = np.array([r.v for r in sample if r.dim == common], float)
    x = x.reshape(len(x), common)
    first, second = (*np.argsort(-x.var(0), kind="stable")[:2].tolist(), 0, 0)[:2] if len(x) else (0, 0)
    slabs = int(min(1000, np.ceil(np.sqrt(tiles / max(1, len({r.label for r in sample}))))))
    cuts = np.quantile(x[:, first], np.arange(1, slabs) / slabs).tolist() if x.size and slabs > 1 else []
    at = lambda axis: F.coalesce(F.get("v", F.lit(axis)), F.lit(0.0))
    slab = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at(first))) if cuts else F.lit(0)
    dealt = own.withColumns({"slab": slab, "y": at(second), "h": F.xxhash64("v")}).repartitionByRange(tiles, "dim", "label", "slab", "y", "h")
    packed = dealt.select("label", "v", "ids", "dim", F.spark_partition_id().alias("range")).mapInPandas(_pack(scale), TILE_SCHEMA)
    return stored(packed, "negatives-tiles")


class Tile:
    """A tile's packed entries, and the tree over them."""

    def __init__(self, row, reach: float):
        self.label, self.many = (np.frombuffer(row[c], np.int64) for c in ("labels", "many"))
        q = np.frombuffer(row["q"], np.float64).reshape(len(self.label), row["dim"])
        self.exact = q.shape[1] * float(np.abs(q).max(initial=0)) * reach < EXACT
        self.q = q if self.exact else np.array([[int(c) for c in r] for r in q], object).reshape(q.shape)
        self.ids, self.start = np.frombuffer(row["ids"], np.int64), np.concatenate([[0], np.cumsum(self.many)])
        self.levels = _tree(self.label, self.q)

    def search(self, own_id: int, label: int, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray, k: int, same: bool) -> list[list[tuple[int, int]]]:
        """For each window the best ``k`` (-score, id) of the tile that are not below ``kth``: nodes best first."""
        a = q if self.exact else np.array([int(c) for c in q], object)
        best: list[list[tuple[int, int]]] = [[] for _ in lo]
        floor = list(map(int, kth))
        queue = [(0, 0, len(self.levels), 0)]
        turn = 0
        while queue:
            bound, _, level, node = heapq.heappop(queue)
            if level < len(self.levels) and -bound < min(floor):
                break
            if level == 0:
                rows = slice(node * LEAF, node * LEAF + LEAF)
                score = self.q[rows] @ a
                fine = (self.label[rows] == label) == same
                for w in range(len(lo)):
                    for i in np.flatnonzero(fine & (score >= max(int(lo[w]), floor[w])) & (score <= int(hi[w]))):
                        e = node * LEAF + i
                        s = int(score[i])
                        found = [(-s, int(v)) for v in self.ids[self.start[e] : self.start[e + 1]] if v != own_id]
                        best[w] = sorted(best[w] + found)[:k]
                        if len(best[w]) == k:
                            floor[w] = max(floor[w], -best[w][-1][0])
                continue
            level -= 1
            lows, highs, least, greatest = self.levels[level]
            kids = slice(node * FAN, node * FAN + FAN) if level < len(self.levels) - 1 else slice(0, 1)
            for i, top in zip(*promising(a, label, lows[kids], highs[kids], least[kids], greatest[kids], lo, hi, floor, same), strict=True):
                turn += 1
                heapq.heappush(queue, (-top, turn, level, kids.start + i))
        return best


def promising(a, label, lows, highs, least, greatest, lo, hi, floor, same: bool) -> tuple[list[int], list[int]]:
    """Which boxes can hold a row of some window at or above its floor, and the best score each can have."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    most, fewest = highs @ up + lows @ down, lows @ up + highs @ down
    labelled = (least <= label) & (greatest >= label) if same else (least != label) | (greatest != label)
    out, tops = [], []
    for i in np.flatnonzero(labelled):
        m, f = int(most[i]), int(fewest[i])
        top = max((min(m, int(h)) for x, h, k in zip(lo, hi, floor, strict=True) if m >= x and f <= h and min(m, int(h)) >= k), default=None)
        if top is not None:
            out.append(int(i))
            tops.append(top)
    return out, tops


ASKS = ["akey", "vec_id", "label", "v", "lo", "hi", "kth"]


def _directed(tiles: DataFrame, asks: DataFrame, same: bool, scale: int, seeds: bool) -> DataFrame:
    """akey, tile (and bound) of the tiles that an ask's windows can be served by; with ``seeds`` each ask's best tile only."""
    n_tiles, n_asks = tiles.count(), asks.count()
    chunks, blocks = -(-n_tiles // CHUNK) or 1, -(-n_asks // ANCHORS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    boxes = tiles.select("tile", "dim", "label_lo", "label_hi", "box_lo", "box_hi", by("tile", chunks).alias("chunk"), every(blocks).alias("block"))
    left = asks.select(*ASKS, *(c for c in ("seen",) if c in asks.columns), F.size("v").alias("dim"), by("akey", blocks).alias("block"), every(chunks).alias("chunk"))

    def run(own: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(box):
            lows, highs = (np.stack([np.frombuffer(b, np.float64) for b in box[c]]) for c in ("box_lo", "box_hi"))
            least, greatest, tile = (box[c].to_numpy() for c in ("label_lo", "label_hi", "tile"))
            reach = float(np.abs(np.stack([lows, highs])).max(initial=0)) * lows.shape[1] * scale
            if reach * float(np.abs(np.stack(own["v"].to_numpy())).max(initial=0)) >= EXACT:
                lows, highs = (np.array([[int(c) for c in r] for r in m], object).reshape(m.shape) for m in (lows, highs))
            for r in own.itertuples():
                a = np.floor(np.asarray(r.v) * scale)
                a = np.array([int(c) for c in a], object) if lows.dtype == object else a
                found = list(zip(*promising(a, r.label, lows, highs, least, greatest, r.lo, r.hi, list(map(int, r.kth)), same), strict=True))
                if seeds:
                    out += [(r.akey, tile[i], max(-OPEN, min(OPEN, top))) for i, top in sorted(found, key=lambda x: (-x[1], x[0]))[:1]]
                else:
                    out += [(r.akey, tile[i], 0) for i, _ in found if tile[i] != r.seen]
        return pd.DataFrame(out, columns=["akey", "tile", "bound"])

    keys = ["dim", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(boxes.groupBy(*keys)).applyInPandas(run, "akey string, tile string, bound long")
    return found.groupBy("akey").agg(F.max_by("tile", F.struct("bound", "tile")).alias("tile")) if seeds else found.select("akey", "tile")


def _visited(tiles: DataFrame, asks: DataFrame, k: int, same: bool, scale: int) -> DataFrame:
    """akey, w, vec_id, score: what each ask finds in its tiles. ``asks`` has a row for each visit."""
    parts = -(-asks.count() // (50 * ANCHORS)) or 1
    part = F.pmod(F.xxhash64("akey", F.lit(1)), F.lit(parts)).cast("int")
    packed = tiles.select("tile", "dim", "labels", "q", "ids", "many", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            own = [np.floor(np.asarray(v) * scale) for v in right["v"]]
            tile = Tile(left.iloc[0], max(float(np.abs(v).max(initial=0)) for v in own))
            for r, a in zip(right.itertuples(), own, strict=True):
                for w, best in enumerate(tile.search(r.vec_id, r.label, a, r.lo, r.hi, r.kth, k, same)):
                    out += [(r.akey, w, v, -s) for s, v in best]
        return pd.DataFrame(out, columns=["akey", "w", "vec_id", "score"])

    found = packed.groupBy("tile", "part").cogroup(asks.select(*ASKS, "tile", part.alias("part")).groupBy("tile", "part"))
    return found.applyInPandas(run, "akey string, w int, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("akey", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(tiles: DataFrame, asks: DataFrame, k: int, same: bool, scale: int = 256) -> DataFrame:
    """akey, w, rank, vec_id, score: the first ``k`` rows of each window of each ask, exactly.

    Asks have akey, vec_id, label, v and the windows' bounds ``lo`` and ``hi`` (arrays of longs, ends included).
    """
    asks = asks.withColumn("kth", F.transform("lo", lambda _: F.lit(-OPEN)))
    seeds = stored(_directed(tiles, asks, same, scale, True), "negatives-seeds")
    first = stored(_visited(tiles, asks.join(seeds, "akey"), k, same, scale), "negatives-first")
    kth = best_of(first, k).filter(F.col("rank") == k).groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("found"))
    again = asks.drop("kth").join(seeds.withColumnRenamed("tile", "seen"), "akey").join(kth, "akey", "left")
    again = again.withColumn("kth", F.transform("lo", lambda _, w: F.coalesce(F.try_element_at("found", w), F.lit(-OPEN)))).drop("found")
    rest = stored(_directed(tiles, again, same, scale, False), "negatives-rest")
    return best_of(first.unionByName(_visited(tiles, again.join(rest, "akey"), k, same, scale)), k)


def hard_negatives(vectors: DataFrame, every: int = 100, k: int = 5, least: int = 80, relabel: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives of a positive score between ``least`` percent of its score and all of it.
    """
    rows = stored(mining_rows(vectors, scale, relabel, labels), "negatives-rows")
    tiles = build(rows, k, scale)
    key = F.concat_ws("/", "vec_id", F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "label", "v"))
    anchors = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("akey", key)
    whole = anchors.withColumns({"lo": F.array(F.lit(-OPEN)), "hi": F.array(F.lit(OPEN))})
    positives = stored(search(tiles, whole, k, True, scale).select("akey", (F.col("rank") - 1).cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    windows = positives.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    s = lambda x: x["positive_score"].cast("decimal(19,0)")
    lowest = F.transform("p", lambda x: F.ceil(s(x) * least / 100).cast("long"))
    asks = anchors.join(windows, "akey").select("akey", "vec_id", "label", "v", lowest.alias("lo"), F.transform("p", lambda x: x["positive_score"]).alias("hi"))
    found = search(tiles, asks, k, False, scale).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return found.join(positives, ["akey", "w"]).select(
        F.split("akey", "/")[0].cast("long").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
    )
