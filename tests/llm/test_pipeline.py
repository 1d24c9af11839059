"""The pipeline's stages keep the columns of documents, and each works on what the one before kept."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from tickline.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs.count())
        assert docs.columns == cols or name == "tokens"
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and seen[3] == seen[2] and seen[5] == seen[4]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_rows(spark):
    text = "Mrs. Maria Smith wrote to joe@example.com about a plain report on the weather of the last few days"
    rows = [(i, t, "en", s, len(t or ""), 0.5, "z") for i, t, s in ((1, None, "a"), (2, "", None), (3, text, "a"), (3, text, "a"), (4, text + ".", None), (5, "word " * 5000, "b"))]
    rows += [(None, text, None, None, None, None, None), (None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, turn string").repartition(3)
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF), f"odd-{name}")
            got = out.collect()
            if name == "tokens":
                assert len(got) == n and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                continue
            assert out.columns == docs.columns and (n or not got)
            assert all(r.text is None or r.n_chars is None or name == "quality" or r.n_chars == len(r.text) for r in got)
            if n and name == "near_duplicates":
                assert sorted(r.doc_id for r in got if r.doc_id) == [1, 2, 3, 5] and sum(r.doc_id is None for r in got) == 2
            if n and name == "surrogates":
                assert len(got) == n and not any(r.text and ("joe@" in r.text or "Smith" in r.text) for r in got)
            if n and name == "mixing":
                assert all(r.text for r in got)


def test_one_text_through_all_stages(spark):
    """A clean document with a near copy: it passes, the copy goes, its personal data changes, and its tokens decode to what the mixing took."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF)
    x, y = good.filter("length(text) - length(replace(text, ' ', '')) BETWEEN 60 AND 400").orderBy("doc_id").limit(2).collect()
    halves = x.text.split()[: len(x.text.split()) // 2] + y.text.split()[len(y.text.split()) // 2 :]
    text = " ".join(halves) + " Mrs. Ada Lovelace wrote to ada@lovelace.org"
    first, copy = 10**9, 10**9 + 1
    own = docs.filter(F.col("doc_id") == x.doc_id)
    rows = [own.withColumn("doc_id", F.lit(i).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(t)) for i, t in ((first, text), (copy, text + " today"))]
    now, at = docs.unionByName(rows[0]).unionByName(rows[1]), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, SF), f"follow-{name}")
        at[name] = now.filter(F.col("doc_id").isin(first, copy)).collect()
    assert {r.doc_id for r in at["quality"]} == {first, copy}
    assert [(r.doc_id, r.text) for r in at["near_duplicates"]] == [(first, text)]
    (changed,) = at["surrogates"]
    assert changed.text.startswith(" ".join(halves)) and " Mrs. " in changed.text and "Lovelace" not in changed.text and "ada@" not in changed.text
    taken = [r.text for r in at["mixing"]]
    assert taken and all(changed.text.startswith(t) for t in taken)
    assert sorted(r.decoded_sha256 for r in at["tokens"]) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in taken)
