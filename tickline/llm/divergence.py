"""Source divergence audit: how far the words of a source stray from other sources, and from their language as a whole.

Terms are counted by a sort of pointers. In each task the texts of an Arrow batch are one byte buffer; a pointer is set to
each byte where a term starts, and a multikey quicksort (three ways around a pivot, eight bytes a character of the key)
sorts the pointers of a slice by what they point to. A run of equal terms then gives, by group, its occurrences
and its documents. Slices hold whole documents, so document counts add up. A task adds its slices up before it deals
rows by language and term; what is left after the shuffle is one row for each group and term.

The sums over all terms for pairs of sources are taken in dense blocks of terms and sources, so no row is made
for a pair and a term. All arithmetic is in integers; shares are computed as decimals, whatever the counts.

Cases: null texts, languages and sources are read as ''; a text without terms still makes its group occur; repeated rows
are documents of their own; a language without kept terms has pairs of value 0 and no term rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import slices, stored

LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Bytes of text of a slice; pointers sorted at once without a pivot; rows of slices that a task adds to its sums at once, and rows of
#: sums that it holds before it deals them.
SLICE_BYTES, SMALL, NEW_ROWS, HELD_ROWS = 3_000_000, 4096, 300_000, 1_000_000
#: Terms of a block, sources of a block, terms of a dense step.
TERM_BLOCK, SOURCE_BLOCK, STEP = 8192, 128, 1024
#: Groups up to which their table is broadcast (counted first).
MOST_BROADCAST = 50_000

#: A byte's value in a term (A-Z lower-cased); 0 where a byte is no part of one.
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, np.where((_BYTES >= 128) | ((_BYTES >= 97) & (_BYTES <= 122)), _BYTES, 0)).astype(np.uint8)


def pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer in small letters, and the start and size of each term; ``bounds`` are the documents' offsets in it."""
    low = LOWER[data]
    inside = low > 0
    cut = np.zeros(len(low) + 1, bool)  # a term never spans two documents
    cut[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside
    end[:-1] &= ~(low[1:] > 0) | cut[1:-1]
    at = np.flatnonzero(start)
    return np.concatenate([low, np.zeros(8, np.uint8)]), at, np.flatnonzero(end) + 1 - at


def characters(low: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as one number, zeros behind the term's end (``left`` bytes away)."""
    view = np.lib.stride_tricks.as_strided(low, (len(low) - 7, 8), (1, 1))
    key = view[at].view(">u8").ravel().astype(np.uint64)
    drop = (8 * np.clip(8 - left, 0, 7)).astype(np.uint64)
    return key >> drop << drop


def multikey_sort(low: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their terms, and which of them, in that order, begin a run of equal terms."""
    order, begins = np.arange(len(at)), np.zeros(len(at), bool)
    key = characters(low, at, size)
    todo = [(0, len(at), 0)] if len(at) else []
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= SMALL:
            _sort_small(low, at, size, order, begins, lo, hi, depth)
            continue
        own, k = order[lo:hi], key[lo:hi]
        pivot = np.sort(k[:: max(1, len(k) // 31)])[15]
        parts = [k < pivot, k == pivot, k > pivot]
        order[lo:hi], key[lo:hi] = (np.concatenate([x[p] for p in parts]) for x in (own, k))
        a, b = lo + int(parts[0].sum()), hi - int(parts[2].sum())
        if a > lo:
            todo.append((lo, a, depth))
        if hi > b:
            todo.append((b, hi, depth))
        if pivot & np.uint64(255):  # the terms may go on
            more = order[a:b]
            key[a:b] = characters(low, np.minimum(at[more] + depth + 8, len(low) - 8), size[more] - depth - 8) * (size[more] > depth + 8)
            todo.append((a, b, depth + 8))
        else:
            begins[a] = True
    return order, begins


def _sort_small(low, at, size, order, begins, lo: int, hi: int, depth: int) -> None:
    """Sort a short range from ``depth`` on: all its runs take their next character at once, until each is one term."""
    own, run, active = order[lo:hi], np.zeros(hi - lo, np.int64), np.arange(hi - lo)
    begins[lo] = True
    while len(active):
        mine = own[active]
        left = size[mine] - depth
        k = characters(low, np.minimum(at[mine] + depth, len(low) - 8), left) * (left > 0)
        by = np.lexsort((k, run[active]))
        own[active], k, r = mine[by], k[by], run[active]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
        begins[lo + active[first]] = True
        length = np.diff(np.append(first, len(active)))
        run[active] = np.repeat(active[first], length)
        active = active[((k & np.uint64(255)) > 0) & np.repeat(length > 1, length)]
        depth += 8


def count_slice(text: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a slice of whole texts with group, occurrences and documents: a row for each term and group."""
    wide = text.cast(pa.large_string())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low, at, size = pointers(data, bounds)
    order, begins = multikey_sort(low, at, size)
    run = np.cumsum(begins) - 1
    doc = np.searchsorted(bounds, at[order], side="right") - 1
    seen, n = np.unique(run * len(text) + doc, return_counts=True)  # a run's documents
    of_run, of_doc = np.divmod(seen, max(1, len(text)))
    groups = int(group.max(initial=0)) + 1
    key, inverse = np.unique(of_run * groups + group[of_doc], return_inverse=True)
    head = order[begins]
    sizes = size[head]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    heads = low[np.repeat(at[head] - offsets[:-1], sizes) + np.arange(offsets[-1])]
    terms = pa.Array.from_buffers(pa.large_string(), len(head), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(heads)])
    return terms.take(pa.array(key // groups)), key % groups, np.bincount(inverse, n, len(key)).astype(np.int64), np.bincount(inverse, minlength=len(key)).astype(np.int64)


NAMES = ["lang", "source", "term", "n", "docs"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []  # the sums so far, and slices behind them
    new = 0
    schema = pa.schema([(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(NAMES)])

    def added(most: int) -> list[pa.RecordBatch]:
        own = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(NAMES).cast(schema)
        held.clear()
        if len(own) <= most:
            held.append(own)
            return []
        return own.to_batches(max_chunksize=50_000)

    for batch in batches:
        for part in slices(batch, 1_000_000, SLICE_BYTES, 2):
            lang, source = part.column(0).cast(pa.large_string()), part.column(1).cast(pa.large_string())
            pairs = pd.MultiIndex.from_arrays([lang.to_pandas(), source.to_pandas()])
            group, own = pairs.factorize()
            terms, g, n, docs = count_slice(part.column(2), group)
            name = [pa.array(own.get_level_values(i).to_numpy(object), pa.large_string()) for i in (0, 1)]
            every = np.arange(len(own))  # each group occurs, with the term '' that no text has
            g, zero = np.concatenate([every, g]), np.zeros(len(own), np.int64)
            terms = pa.concat_arrays([pa.array([""] * len(own), pa.large_string()), terms])
            held.append(pa.table([name[0].take(pa.array(g)), name[1].take(pa.array(g)), terms, np.concatenate([zero, n]), np.concatenate([zero, docs])], NAMES).cast(schema))
            new += len(g)
            if new > NEW_ROWS:
                new = 0
                yield from added(HELD_ROWS)
                pa.default_memory_pool().release_unused()
    if held:
        yield from added(-1)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences), head (one row of each language's term has it) for the terms in at least ``least_docs``
    documents of the language; and for every group a row of the term '' with n = 0. Stored."""
    empty = F.lit("")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    found = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # dealt by language and term: the sums by group and the language's totals need no further shuffle
    found = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    order = Window.partitionBy("lang", "term").orderBy("source")
    term = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same sort serves all three
    found = found.withColumns({"df": F.sum("docs").over(term), "total": F.sum("n").over(term), "head": F.row_number().over(order) == 1})
    return stored(found.filter((F.col("df") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "total", "head"), "divergence-terms")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exactly."""
    d = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (d(n) + 1), d(total) + d(kept))
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q) of whole numbers up to UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(left: pd.DataFrame, right: pd.DataFrame, size: int) -> pd.DataFrame:
    """Sums over a block of terms for all ordered pairs between two blocks of sources (or within one)."""
    if not len(left) or not len(right):
        return pd.DataFrame([], columns=["lang", "source", "item", "value"], dtype=object)
    right = right.sort_values("source_no")
    numbers, base = right["source_no"].to_numpy(), right["p0"].to_numpy()
    row = np.searchsorted(numbers, left["source_no"].to_numpy())
    column, terms = pd.factorize(left["term"])
    by = np.argsort(column, kind="stable")
    row, column, p = row[by], column[by], left["p"].to_numpy()[by]
    a, b = int(left["block_a"].iloc[0]), int(left["block_b"].iloc[0])
    block = numbers // size
    sums = np.zeros((len(numbers), len(numbers)), np.int64)
    for start in range(0, len(terms), STEP):
        lo, hi = np.searchsorted(column, [start, start + STEP])
        dense = np.repeat(base[:, None], min(STEP, len(terms) - start), 1)
        dense[row[lo:hi], column[lo:hi] - start] = p[lo:hi]
        for i in range(len(numbers)):
            others = np.flatnonzero((block == block[i]) if a == b else (block != block[i]))
            sums[i, others] += ((dense[i] - dense[others]) ** 2 // dense[others]).sum(1)
    i, j = np.nonzero(~np.eye(len(numbers), dtype=bool) & ((block[:, None] == block) if a == b else (block[:, None] != block)))
    names = right["source"].to_numpy(object)
    return pd.DataFrame({"lang": left["lang"].iloc[0], "source": names[i], "item": names[j], "value": sums[i, j]})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group's divergence from every other source of its language (part ``pair``),
    and the terms in which it exceeds its language most (part ``term``, the first ``top``)."""
    counts = term_counts(docs, least_docs)
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum((F.col("head") & (F.col("term") != "")).cast("long")).alias("kept"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_total")).join(langs, "lang")
    none = F.lit(0).cast("long")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    some = F.when(F.col("kept") > 0, share(none, F.col("group_total"), F.col("kept")))  # without kept terms there is nothing to share
    groups = stored(groups.withColumns({"source_no": number, "p0": some, "sources": F.count("*").over(Window.partitionBy("lang"))}), "divergence-groups")
    n_groups, n_terms = groups.count(), counts.filter("head AND term <> ''").count()
    beside = groups.select("lang", "source", "group_total", "lang_total", "kept", "source_no", "sources")
    own = counts.filter("term <> ''").join(F.broadcast(beside) if n_groups <= MOST_BROADCAST else beside, ["lang", "source"])
    own = own.withColumns({"p": share(F.col("n"), F.col("group_total"), F.col("kept")), "q": share(F.col("total"), F.col("lang_total"), F.col("kept"))})
    first = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    strong = own.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    strong = first(strong).filter(F.col("rank") <= top)

    blocks, size = n_terms // TERM_BLOCK + 1, SOURCE_BLOCK
    source_block = F.floor(F.col("source_no") / size).cast("int")
    both = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / size).cast("int")))).withColumns({"block_a": F.least(source_block, "other"), "block_b": F.greatest(source_block, "other")})
    cells = both(own.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))).select("lang", "block", "block_a", "block_b", "source_no", "term", "p")
    sides = both(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))).select("lang", "block", "block_a", "block_b", "source_no", "source", "p0")
    sides = sides.select(*[F.col(c).alias(c) for c in sides.columns])  # columns of its own beside those that came by the join
    keys = ["lang", "block", "block_a", "block_b"]
    sums = cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(lambda a, b: _pair_sums(a, b, size), "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", none).alias("value"))
    return first(pairs).unionByName(strong).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
