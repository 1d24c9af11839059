"""Hard negatives, sharding and source divergence against plain Python, and on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickline.llm import divergence, negatives, sharding

VECTORS = "vec_id long, embedding array<double>, label int, dim int, tile string"


def plain_negatives(rows, every=100, k=5):
    """The contract, row by row, in Python integers."""
    own = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, la, qa in own:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q, strict=True)), i, lab) for i, lab, q in own if i != a and len(q) == len(qa))
        for s, p, lab in [x for x in scored if x[2] == la][:k]:
            ps = -s
            fine = [(t, n) for t, n, lb in scored if lb != la and 80 * ps <= -100 * t <= 100 * ps][:k]
            out += [(a, p, r, n, ps, -t) for r, (t, n) in enumerate(fine, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    return sorted(map(tuple, negatives.hard_negatives(df).collect()))


def test_hard_negatives_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=6).tolist(), int(rng.integers(0, 4))) for i in range(260)]
    same = rng.normal(size=6).tolist()
    rows += [(i, same, 1) for i in range(300, 420)] + [(i, [0.0] * 6, 2) for i in range(420, 430)]  # one vector of many, ties throughout
    rows += [(500, rng.normal(size=6).tolist(), 3), (500, rng.normal(size=6).tolist(), 3), (400, same, 1), (600, [1.0, 2.0], 1), (601, [1.0, 3.0], 1), (602, [1.0, 2.5], 2), (700, [], 0)]
    rows += [(None, same, 1), (800, None, 1), (801, same, None), (900, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (901, [float("nan")] * 6, 1), (902, [float("inf")] * 6, 1), (1000, same, 9)]
    rows += [(1100, [3e30, 1.0, 2.0], 4), (1101, [0.0, 1.0, 1.0], 4), (1102, [0.0, 2.0, 0.4], 5), (1103, [0.0, 1.1, 1.0], 5), (1104, [0.0, 1.0, 0.9], 6)]  # too large for doubles
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_hard_negatives_prune_structured_vectors(spark, monkeypatch):
    """Clusters far apart: the answer is exact, and most tiles and leaves are never read."""
    monkeypatch.setattr(negatives, "TILE", 100)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 6
    rows = [(i, (centres[c := i % 12] + rng.normal(size=8) * 0.1).tolist(), (c // 2) % 5) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == plain_negatives(rows)
    own = negatives.mining_rows(df)
    tiles = negatives.build(own, 5)
    asks = own.filter("vec_id % 100 = 0").withColumns({"akey": F.col("vec_id").cast("string"), "lo": F.array(F.lit(-negatives.OPEN)), "hi": F.array(F.lit(negatives.OPEN))})
    asks = asks.withColumn("kth", F.array(F.lit(-negatives.OPEN)))
    seeds = negatives._directed(tiles, asks, True, 256, True)
    first = negatives.best_of(negatives._visited(tiles, asks.join(seeds, "akey"), 5, True, 256), 5).filter("rank = 5").select("akey", F.array("score").alias("kth"))
    rest = negatives._directed(tiles, asks.drop("kth").join(first, "akey").join(seeds.withColumnRenamed("tile", "seen"), "akey"), True, 256, False)
    assert tiles.count() >= 30 and rest.count() < 0.15 * asks.count() * tiles.count()


def test_packed_order_makes_small_boxes():
    x = np.random.default_rng(7).uniform(size=(4096, 2))
    order = negatives.str_order(x)
    assert sorted(order) == list(range(4096))
    sides = [np.ptp(x[order[i : i + negatives.LEAF]], axis=0) for i in range(0, 4096, negatives.LEAF)]
    assert np.mean([s.prod() for s in sides]) < 3 * negatives.LEAF / 4096


DOCS = [(0, None), (1, ""), (2, "a"), (2, "a"), (3, "né"), (None, "x"), (None, None), (-5, "long " * 5000)]


def test_shards(spark):
    docs = spark.createDataFrame([(i, t, 7, "s", 1) for i, t in DOCS] + [(i, f"text {i % 40}", 7, "s", 1) for i in range(100, 900)], "doc_id long, text string, shard int, slot string, at int")
    rows = sharding.sharded(docs).collect()
    assert sharding.sharded(docs.limit(0)).count() == 0
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows if (r.doc_id or 0) < 100) == want
    assert {r.law for r in rows} == {"key"}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 8
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sorted(map(str, rows)) == sorted(map(str, sharding.sharded(docs.repartition(7)).collect()))


def test_slots_of_one_id_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    docs = spark.range(2000).selectExpr("CASE WHEN id < 1200 THEN 4 ELSE id END AS doc_id", "'same' AS text")
    rows = sharding.sharded(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == 2000


def test_weights_confine_moves(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "1 AS shard")
    tree = sharding.even_tree(8)
    per = {r.shard: r["count"] for r in docs.select(sharding.shard_of("doc_id", tree).alias("shard")).groupBy("shard").count().collect()}
    assert all(abs(n - 2500) < 300 for n in per.values())
    # a lighter shard 5 (region 1, rack 0): its path loses weight, so nothing enters the path's region or rack, and region 0 loses nothing
    lighter = [x._replace(weight=0.25) if x.shard == 5 else x for x in tree]
    moved = sharding.moves(docs, tree, lighter).collect()
    region = lambda s: s // 4
    assert moved and all(region(m.from_shard) == 1 for m in moved) and not any(m.to_shard == 5 for m in moved)
    assert all(m.from_shard == 5 or region(m.to_shard) == 0 or m.to_shard // 2 != 2 for m in moved)
    shares = docs.select(sharding.shard_of("doc_id", lighter).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in shares}[5] - 20_000 * 0.25 / 7.25) < 150
    grown = sharding.moves(docs, tree, sharding.grown(tree, 2.0)).collect()
    assert {m.to_shard for m in grown} == {8} and abs(sum(m.documents for m in grown) - 4000) < 400
    gone = [x._replace(weight=0.0) if x.shard == 3 else x for x in tree]
    assert 3 not in {m.to_shard for m in sharding.moves(docs, tree, gone).collect()}
    for bad in ([], [sharding.Leaf("a", "b", 1), sharding.Leaf("a", "c", 1)], [sharding.Leaf("a", "b", 1, -1.0)], [sharding.Leaf("a", "b", 1, 0.0)]):
        with pytest.raises(ValueError, match="shard"):
            sharding.children(bad)
    name = sharding.write_shards(docs, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert name == "shard_0" and back.count() == 20_000 and back.filter(sharding.shard_of("doc_id", tree) != F.col(name)).count() == 0
    assert set(docs.columns) < set(back.columns)


PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL_LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_audit(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), PATTERN.findall((text or "").translate(SMALL_LETTERS))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        share = lambda c: (lambda n: {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            f = lambda a, b: (a - b) * (a - b) // b
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]))[:top]
            out += [(lang, s, part, item, -v, r) for part, own_rows in (("pair", pairs), ("term", terms)) for r, (v, _, item) in enumerate(own_rows, 1)]
    return sorted(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int")
    return sorted(map(tuple, divergence.audit(df, **more).collect()))


def test_divergence_on_odd_rows(spark, monkeypatch):
    rows = [("en", "a", "Apple apple PEAR fig"), ("en", "a", "apple-pear FIG"), ("en", "b", "apple pear pear"), ("en", "c", None), ("en", None, ""), (None, None, "übung Übung ÜBUNG"), (None, "z", "übung x"), (None, "z", "übung"), ("de", "a", "nur einmal"), ("de", "b", "12 34 @[`{"), (None, None, None)]
    rows += [("en", "a", "apple pear")] * 4 + [("fr", f"s{i}", " ".join(f"mot{j}" for j in range(i, i + 9)) + " long" + "e" * 30 + "é" * (i % 3) + " mot1") for i in range(12)]
    assert audited(spark, rows) == plain_audit(rows)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 3)  # several blocks of sources and of terms
    monkeypatch.setattr(divergence, "TERM_BLOCK", 4)
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, rows, top=2) == plain_audit(rows, top=2)
    assert audited(spark, []) == [] and audited(spark, [("en", "a", None)]) == []


def test_multikey_sort_equals_a_plain_sort(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 64)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abé"), rng.integers(1, 30))) for _ in range(700)] + ["same"] * 900 + ["prefix" * 5 + "x" * int(n) for n in rng.integers(0, 4, 300)] + ["y" * 20_000] * 2
    rng.shuffle(words)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    low, at, size = divergence.pointers(data, np.array([0, len(data)]))
    order, begins = divergence.multikey_sort(low, at, size)
    found = [bytes(low[a : a + n]).decode() for a, n in zip(at[order], size[order], strict=True)]
    assert found == sorted(words, key=str.encode)
    assert [w for w, b in zip(found, begins, strict=True) if b] == sorted(set(words), key=str.encode)


def test_terms_end_with_their_document():
    import pyarrow as pa

    text = pa.array(["skip me", "ab", "cd ab", None, "", "AB"])[1:]
    terms, group, n, docs = divergence.count_slice(text.fill_null(""), np.array([0, 0, 1, 1, 1]))
    assert sorted(zip(terms.to_pylist(), group.tolist(), n.tolist(), docs.tolist(), strict=True)) == [("ab", 0, 2, 2), ("ab", 1, 1, 1), ("cd", 0, 1, 1)]
