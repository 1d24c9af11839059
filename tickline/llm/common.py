"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
_OWN_DIR: list[str] = []
#: Longest text that a model is fitted on; all texts are scored whole.
FIT_CHARS = 65_536


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB instead of Spark's 64 (rows are texts, and JVM and worker each hold a batch or two); a size of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "4194304b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder URI under ``spark.checkpoint.dir``; only where that is unset on a local master (tests) one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tickline-"))
        base = _OWN_DIR[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; a null id counts as crc32 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, mod: int, left_out: int, limit: int, halves: bool = False) -> list:
    """At most ``limit`` rows (text, label[, lang]) for fitting, the same on every run.

    Rows of the left-out fold, of null labels and of null texts never come. The choice is by a hash of
    the id (with ``halves``, up to half of the rows for either label), so it does not depend on order or partitions; only ids are sorted, and texts are read for the
    chosen ids alone (a broadcast of at most ``limit`` rows). Of rows of one id the least text counts. Texts of over
    ``FIT_CHARS`` characters are not fitted on, so at most ``limit * FIT_CHARS`` characters reach the driver.
    """
    own = labels.filter((fold("doc_id", mod) != left_out) & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max(target).alias("label"))
    chosen = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    pick = chosen(own, limit) if not halves else chosen(own.filter("label > 0"), limit // 2).union(chosen(own.filter("label <= 0"), limit - limit // 2))
    text = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull())
    rows = text.join(F.broadcast(pick), "doc_id").filter(F.length("text") <= FIT_CHARS)
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "label", "t.*").collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.text))


class Memo(dict):
    """A dictionary that computes missing entries and forgets all of them beyond ``most``."""

    def __init__(self, make: Callable, most: int = 120_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def slices(batch, rows: int = 512, most_bytes: int = 4_000_000, text: int = 1, trim: bool = True):
    """Cut an Arrow record batch into pieces of few rows and few text bytes (a single longer row stays whole); then memory is given back, unless the caller does that."""
    sizes = [0 if n is None else n for n in _byte_sizes(batch.column(text))]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or total + n > most_bytes):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)
    if trim:
        give_back()


def give_back() -> None:
    """What Arrow and the C library keep of freed memory adds up in workers that live long."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _byte_sizes(column) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()
