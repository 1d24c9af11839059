"""Mixing sources to target weights over fixed-length token blocks.

Every source's documents lie end to end in a pseudorandom but fixed order, cut into blocks of ``BLOCK`` words.
The output is shards of slots. Each shard draws multinomial source counts; draws above a source's quota go to
sources that drew too few, so that every source fills its quota exactly. A source's n-th slot belongs to
pass n // blocks, and a keyed permutation of that pass names the block. Blocks join documents by index.
A source's short last block comes at the end of each pass and its last slot may be cut, so the words taken equal
the rounded target, and since targets stop at ``MOST`` times a source's size, no document is taken more often.

Cases: null and empty texts have size 0 and are taken 0 times; the null source is a source, last in order;
repeated rows are documents of their own; an empty table gives an empty result; reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, SLOTS, SEED = 256, 16384, 20
#: Most tasks that place slots.
PLACERS = 4096


def targets(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """Source, size and target; ``sizes`` in any order."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    target, free, left = [0.0] * len(rows), set(range(len(rows))), float(sum(n for _, n in rows))
    while free:
        whole = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / whole > MOST * rows[i][1]}
        if not over:
            for i in free:
                target[i] = left * weight[i] / whole
            break
        for i in over:
            target[i] = float(MOST * rows[i][1])
        left -= sum(target[i] for i in over)
        free -= over
    return [(s, n, t) for (s, n), t in zip(rows, target, strict=True)]


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(n) at ``j``, elementwise: four Feistel rounds, walked until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.uint64) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        h, m, k, y = half[todo], mask[todo], key[todo].astype(np.uint64), x[todo]
        left, right = y >> h, y & m
        for r in range(4):
            f = (right + k + np.uint64(r * 77 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ f >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(40)) & m
        x[todo] = left << h | right
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def _slots(spark, plan: list[tuple[str | None, int, float]]) -> DataFrame:
    """src, pass, block and words of every slot of the output, with its shard."""
    size = np.array([n for _, n, _ in plan], np.int64)
    want = np.array([min(round(t), MOST * n) for _, n, t in plan], np.int64)
    full, blocks = size // BLOCK, -(-size // BLOCK)
    passes, rest = want // np.maximum(size, 1), want % np.maximum(size, 1)
    quota = passes * blocks + -(-rest // BLOCK)
    total = int(quota.sum())
    shards = max(1, -(-total // SLOTS))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                n = min(SLOTS, total - shard * SLOTS)
                counts = np.random.default_rng([SEED, shard]).multinomial(n, quota / total) if n > 0 else np.zeros(len(quota), int)
                own = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "src": own, "n": counts[own]})

    drawn = stored(spark.range(shards).mapInPandas(draw, "shard long, src long, n long"), "mix-draws")
    got = np.zeros(len(size), np.int64)
    for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect():
        got[r.src] = r.n
    surplus = np.maximum(got - quota, 0)
    before = np.cumsum(surplus) - surplus
    lacking = np.maximum(quota - got, 0)
    ends = np.cumsum(lacking)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, src, first, n in zip(f["shard"], f["src"], f["first"], f["n"], strict=True):
                at = np.arange(first, first + n)
                own, spare = at[at < quota[src]], at[at >= quota[src]] - quota[src] + before[src]
                to = np.searchsorted(ends, spare, side="right")
                who = np.concatenate([np.full(len(own), src), to]).astype(np.int64)
                nth = np.concatenate([own, got[to] + spare - (ends - lacking)[to]]).astype(np.int64)
                turn, j = nth // blocks[who], nth % blocks[who]
                block = full[who].copy()
                inner = j < full[who]
                block[inner] = permuted(j[inner], full[who][inner], who[inner] * 1_000_003 + turn[inner] + SEED)
                words = np.where(inner, BLOCK, size[who] - full[who] * BLOCK)
                last = turn == passes[who]
                words[last] = np.minimum(words[last], rest[who][last] - j[last] * BLOCK)
                yield pd.DataFrame({"shard": shard, "src": who, "turn": turn, "block": block, "words": words})

    before_row = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ordered = drawn.withColumn("first", F.coalesce(F.sum("n").over(before_row), F.lit(0)))
    # the window deals its few narrow rows by source; the slots come from tasks of a few shards each
    spread = ordered.repartition(min(shards, PLACERS), "shard")
    return spread.mapInPandas(place, "shard long, src long, turn long, block long, words long")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text of every row, stored."""
    text = F.col("text")
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    return stored(rows, "mix-sizes")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sized rows with source_size and target, and what the mix takes of them.

    The second result has a row for each stretch of words taken: doc_id, h, begin (with src and begin a row's
    own key), turn (pass), and the word range [lo, hi) within the document.
    """
    spark = docs.sparkSession
    rows = _sized(docs)
    plan = targets([(r.source, r.size) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()])
    named = spark.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(plan)], "src long, of string, source_size long, target double")
    assert len(plan) <= 1_000_000, "source totals are planned on the driver"
    rows = rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # a source's order is by bucket, then id: no group or window holds more than about sqrt(n) rows of evenly hashed ids
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    own = Window.partitionBy("src", "bucket").orderBy("doc_id", "h", "size")
    base = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    base = base.withColumn("base", F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    laid = rows.filter("size > 0").withColumn("within", within).join(base, ["src", "bucket"])
    laid = laid.select("doc_id", "h", "src", "size", (F.col("base") + F.col("within")).alias("begin"))

    def block_of(word: Column) -> Column:
        return F.floor(word / BLOCK).cast("long")

    pieces = laid.withColumn("block", F.explode(F.sequence(block_of(F.col("begin")), block_of(F.col("begin") + F.col("size") - 1))))
    slots = _slots(spark, plan) if any(n for _, n, _ in plan) else spark.createDataFrame([], "shard long, src long, turn long, block long, words long")
    at = F.col("block") * BLOCK
    lo = F.greatest(F.col("begin"), at) - F.col("begin")
    hi = F.least(F.col("begin") + F.col("size"), at + F.col("words")) - F.col("begin")
    # both sides grow with the words: the hint keeps either from being broadcast on an estimate
    taken = pieces.join(slots.hint("merge"), ["src", "block"]).select("doc_id", "h", "src", "begin", "size", "turn", lo.alias("lo"), hi.alias("hi"))
    return rows, taken.filter("hi > lo")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    rows, taken = mix(docs)
    sums = taken.groupBy("doc_id", "h", "src", "begin", "size").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    # rows of equal id and text share their words: the n-th of them gets the n-th sum, untaken ones get none
    nth = lambda order: F.row_number().over(Window.partitionBy("src", "doc_id", "h").orderBy(*order))
    rows = rows.withColumn("nth", nth(["size"]))
    sums = sums.withColumn("nth", nth([F.desc("taken"), "begin"])).withColumnRenamed("doc_id", "id").withColumnRenamed("size", "own")
    same = (rows["src"] == sums["src"]) & rows["doc_id"].eqNullSafe(sums["id"]) & (rows["h"] == sums["h"]) & (rows["nth"] == sums["nth"])
    return rows.join(sums.hint("merge"), same, "left").select("doc_id", rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for every pass that takes words of a document, a row with those words as its text.

    A pass that takes the whole document keeps the text as it is; otherwise the words are joined by one space.
    n_chars is the new text's length; other columns stay. Rows of equal id and text are one row here, which
    holds what is taken of all of them.
    """
    _, taken = mix(docs)
    span = F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_spans")
    row = {"_d": F.coalesce("doc_id", F.lit(0).cast("long")), "_z": F.col("doc_id").isNull()}
    key = ["_d", "_z", "_h"]
    spans = taken.withColumns(row).groupBy(*key[:2], F.col("h").alias("_h"), "turn", "begin", F.col("size").alias("_size")).agg(span).drop("turn", "begin")
    # texts move once: equal rows become one before they move, and the join finds its side dealt by the same key
    one = docs.withColumns(row | {"_h": F.xxhash64("text")}).dropDuplicates(key)
    joined = one.join(spans.hint("merge"), key)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " ")
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]) == F.col("_size")
    text = F.when(whole, F.col("text")).otherwise(part)
    joined = joined.withColumn("_text", text)  # a step of its own: beside an alias named text, lambdas would take that for the text
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
