"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickline.llm import ann, bpe, divergence, langid, media, mixing, neardup, negatives, pii, quality, sharding, tokenfiles, toxicity
from tickline.llm.common import table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file of the installed tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_texts(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=1_000_000)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_bpe": op4_bpe,
    "op5_media": op5_media,
    "op6_neighbours": op6_neighbours,
    "op7_language": op7_language,
    "op10_token_files": op10_token_files,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_shards": op12_shards,
    "op13_divergence": op13_divergence,
}

#: DuckDB SQL of the queries that SQL can express. The vectors' search is exact here; the forest finds the same rows
#: where it meets all of a small table. Squares are added in the order of components, as the operator adds them.
ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots ON node = doc_id""",
    "op6_neighbours": """
WITH fine AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_hard_negatives": """
WITH fine AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i])) AS BIGINT) AS score FROM fine a JOIN fine c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.q) = len(c.q)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    "op12_shards": r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
crc AS (SELECT doc_id, key, octet_length(encode(text)) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM docs, crc_table),
nodes AS (SELECT s AS shard, CAST(8 - grown AS BOOLEAN) AS old, CASE WHEN s = 8 THEN 'r+8' ELSE 'r' || s // 4 END AS region, CASE WHEN s = 8 THEN 'k0' ELSE 'k' || s // 2 % 2 END AS rack, grown FROM (SELECT unnest(range(9)) AS s), (SELECT unnest([8, 9]) AS grown) WHERE s < grown),
draws AS (SELECT key, node, (CAST('0x' || substr(md5(node || '|' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u FROM (SELECT DISTINCT key FROM docs), (SELECT DISTINCT unnest([region, region || '/' || rack, region || '/' || rack || '/' || shard]) AS node FROM nodes)),
regions AS (SELECT grown, key, arg_min(region, -ln(u) / w) AS region FROM draws JOIN (SELECT grown, region, count(*) AS w FROM nodes GROUP BY ALL) ON node = region GROUP BY ALL),
racks AS (SELECT grown, key, region, arg_min(rack, -ln(u) / w) AS rack FROM regions JOIN (SELECT grown, region, rack, count(*) AS w FROM nodes GROUP BY ALL) USING (grown, region) JOIN draws USING (key) WHERE node = region || '/' || rack GROUP BY ALL),
leaves AS (SELECT grown, key, CAST(arg_min(shard, -ln(u)) AS INTEGER) AS shard FROM racks JOIN nodes USING (grown, region, rack) JOIN draws USING (key) WHERE node = region || '/' || rack || '/' || shard GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, b.shard AS grown_shard
FROM crc JOIN leaves a ON a.key = crc.key AND a.grown = 8 JOIN leaves b ON b.key = crc.key AND b.grown = 9""",
    "op13_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM kept JOIN langs USING (lang)),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM groups JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (CAST(total AS HUGEINT) + v) AS p FROM (SELECT lang, source, term, n, total, v FROM every)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200""",
}
