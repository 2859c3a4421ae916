"""Resampling against plain loops: weights, scores, ranks, ties, odd rows; the tournament tree and the ranges."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperlane.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, target):
    """{row number: (n_features, weight, score)} and the drawn rows' (score, id) in order."""
    own, theirs = [0] * 10_000, [0] * 10_000
    for texts, counts in (([t for _, t in rows], own), (target, theirs)):
        for t in texts:
            for b in plain_features(t)[1]:
                counts[b] += 1
    s_all, t_all = sum(own), sum(theirs)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(own, theirs)]
    out, eligible = [], []
    for i, text in rows:
        words, found = plain_features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(words) >= 20:
            eligible.append((-out[-1][-1], i is not None, i or 0))
    return out, sorted(eligible)[: 25 * len(eligible) // 100]


def test_against_loops(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(80)] + ["Äh", "ÉCOLE", "日本", "don't", "x-1"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " .,\n"), (None, rows[3][1]), (None, " ".join(["w1"] * 30)), (1003, "word " * 60_000)] + [(5, rows[5][1])] * 3 + [(7, "w1 " * 25)] * 120
    target = [" ".join(rng.choices(vocabulary[:20], k=40)) for _ in range(30)] + [None, ""]
    schema = "doc_id long, text string, __row string, row long, id long, n long"
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 3) for i, t in rows], schema).repartition(7)
    got = resampling.resample(docs, spark.createDataFrame([(t, 0) for t in target], "text string, rank int")).collect()
    want, drawn = brute(rows, target)
    order = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=order) == sorted(want, key=order)
    ranked = sorted(((r["rank"], r.score, r.doc_id) for r in got if r["rank"] is not None), key=lambda x: x[0])
    assert [r for r, _, _ in ranked] == list(range(1, len(drawn) + 1))
    assert [(-s, i is not None, i or 0) for _, s, i in ranked] == drawn and {r["__row"] for r in got} == {"r"}


def test_only_what_is_wanted_is_kept(spark):
    docs = spark.createDataFrame([(1, "w " * 20, 7, 8), (2, "few", 7, 8)], "doc_id long, text string, score long, x long")
    got = resampling.resample(docs, docs.select("text"), keep=["x", "doc_id"], percent=100)
    assert got.columns == ["x", "doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((r.doc_id, r.x, r["rank"]) for r in got.collect()) == [(1, 8, 1), (2, 8, None)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    few = resampling.resample(spark.createDataFrame([(1, "too few words"), (2, "w " * 20)], "doc_id long, text string"), none).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in few) == [(1, 5, None), (2, 39, None)]
    with pytest.raises(ValueError, match="rank"):
        resampling.resample(few and spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, rank int"), none)


def test_tournament():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(n)]
        assert list(resampling.Tournament(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_ranges_and_ties(spark, kind, monkeypatch):
    """Small blocks, so that equal scores and equal ids lie over several ranges; a third of the rows is one row over and over."""
    monkeypatch.setattr(resampling, "BLOCKS", 2)
    rng = random.Random(5)
    given = [(n, rng.randint(-3, 3), rng.choice([None, *range(40)])) for n in range(2000)] + [(2000 + n, 1, 17) for n in range(1000)]
    frame = spark.createDataFrame(given, "row long, score long, id long").withColumn("id", F.col("id").cast(kind)).repartition(9).cache()
    own = lambda i: "" if i is None else str(i) if kind == "string" else i
    want = sorted((-s, i is not None, own(i) if i is not None else 0, n) for n, s, i in given)
    for k in (0, 1, 1700, 3000, 5000):
        got = sorted((r["rank"], r.row) for r in resampling.best(frame, k, len(given), block=16).collect())
        assert got == [(n, key[-1]) for n, key in enumerate(want[:k], 1)]


def test_counts_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ADDENDS", 2)
    docs = spark.createDataFrame([("a b a",)] * 50, "text string").repartition(11)
    counts = resampling.bucket_counts(docs)
    assert counts.sum() == 250 and counts[zlib.crc32(b"a") % 10_000] == 100
