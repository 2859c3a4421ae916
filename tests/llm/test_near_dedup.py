import random
from collections import Counter

import numpy as np

from paperlane.llm import near_dedup as N

SCHEMA = "doc_id long, text string, node string"


def brute(rows):
    import re

    words = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t, *_ in rows]
    sets = [N.shingles(w) if w else None for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = words[i] == words[j] and (words[i] or (rows[i][1] or "") == (rows[j][1] or ""))
            if same or sets[i] and sets[j] and N.probability_jaccard(sets[i], sets[j]) >= N.SIMILARITY:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], low[find(i)]) for i, r in enumerate(rows))


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 80, 300])))) for i in range(40)]
    for i in range(40, 110):
        words = rng.choice(rows[:40])[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return [(*r, "x") for r in rows + [(200, None), (201, ""), (202, "!!"), (203, "!!"), (5, rows[5][1]), (300, "one two"), (301, "ONE, two."), (302, "long " * 20_000)]]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = N.classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_without_filters(spark, monkeypatch):
    """All that meet in a bucket are verified, in the last round alone: the same classes."""
    monkeypatch.setattr(N, "ROUNDS", 0)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [sorted((r.doc_id, r.class_id) for r in N.classes(docs, spread=on).collect()) for on in (True, False)]
    assert found == [brute(rows), brute(rows)]


def test_one_row_of_each_class_stays(spark):
    rows = corpus()
    got = N.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c in brute(rows)})


def test_empty(spark):
    assert N.classes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_share_of_equal_components_is_the_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 62, 100).astype(np.uint64), a[:40]])
    want = N.probability_jaccard(Counter(a.tolist()), Counter(b.tolist()))
    s = N.prob_min_hash([a, b], 4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_equal_components(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 62, (2, N.BANDS * N.ROWS)).astype(np.uint64)
    s[1, :150] = s[0, :150]
    p = N.packed(s)
    low = N.mix(s) & np.uint64(255)
    got = spark.createDataFrame([(p[0].tolist(), p[1].tolist())], "a array<long>, b array<long>").select(N.equal_components(F.col("a"), F.col("b"))).first()[0]
    assert got == int((low[0] == low[1]).sum())
