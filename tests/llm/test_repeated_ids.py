"""Near duplicates of rows whose ids repeat, whatever the order of rows; the pipeline's stage against brute force; surrogates of other scripts."""

import random
import re
from itertools import combinations

from tickline.llm import neardup, pii


def plain(rows, k, threshold):
    """doc_id and component of each row, by all pairs of rows."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], low[find(i)], len(sets[i])) for i in range(len(rows)))


def text(seed, n=120):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def test_repeated_ids_keep_their_own_sets(spark):
    a, b, c = text(1), text(2), text(3)
    join = " ".join
    rows = [(5, join(a)), (5, join(b)), (8, join([*a[:-1], "x"])), (7, join([*b[:-1], "y"])), (5, None), (5, ""), (9, join(c)), (9, join(c)), (8, join([*c[:-1], "z"])), (3, join([*b[:-2], "p", "q"])), (10, "one"), (10, "two"), (11, "ONE")]
    want = plain(rows, 3, 0.85)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)
        got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in neardup.near_duplicates(df).collect())
        assert got == want


def test_the_pipelines_stage_equals_brute_force(spark):
    rnd = random.Random(4)
    rows, i = [], 0
    for g in range(25):
        base = text(100 + g, rnd.randrange(30, 90))
        for _ in range(rnd.randrange(1, 6)):
            own = list(base)
            for _ in range(rnd.randrange(0, 6)):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(999)}"
            rows.append((i, " ".join(own)))
            i += 1
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in neardup.drop_near_duplicates(df).collect()}
    assert kept == {doc for doc, low, _ in plain(rows, 5, 0.8) if doc == low} and len(kept) < len(rows)


def test_surrogates_keep_the_script(spark):
    names = {"Արմեն": "[ա-և]", "Фёдорыч": "[а-яё]", "Ნინო": "[ა-ჿ]", "Łukasz": "[a-z]"}
    own = spark.createDataFrame([(i, f"Dr. {n} wrote") for i, n in enumerate(names)], "doc_id long, text string")
    for r in pii.surrogate_texts(own).collect():
        name, letters = list(names.items())[r.doc_id]
        new = re.fullmatch(r"Dr\. (\w+) wrote", r.text)[1]
        assert new != name and len(new) == len(name) and new[0].isupper() == name[0].isupper(), (name, new)
        assert re.fullmatch(f"{letters}+", new.lower()), (name, new)
