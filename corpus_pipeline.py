"""A corpus pipeline of five text operators: quality, near duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return
the columns of documents. Between stages rows are written as Parquet and read again.

Cases, for every stage: an empty table gives an empty one; other columns pass through, whatever their names; null texts
and null ids are no obstacle. Rows with null or empty texts are scored like any text, are near copies of nothing, hold no
personal data, and end in the mixing, which takes words; repeated rows are one document to the near duplicates and the
mixing, and rows of their own to the other stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickline.llm import bpe, mixing, neardup, pii, quality
from tickline.llm.common import stored, table
from tickline.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score below 0.5)."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group (five-word shingles, similarity of 0.8 or more)."""
    return neardup.drop_near_duplicates(docs)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.surrogate_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the sources' words by their target weights; a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode the texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    # the stages before have filled the executors' heap, so workers get by with less memory than alone
    return bpe.token_digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, part=4)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("surrogates", with_surrogates),
    ("mixing", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the minima, the surrogates' key or the recursion over tokens.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
