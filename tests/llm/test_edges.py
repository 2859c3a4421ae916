"""Odd rows for classifiers, language model and pipeline; their losses against plain loops and numerical derivatives."""

import math
import random
import zlib

import numpy as np
import pytest

from paperlane.llm import common, hmm, quality, toxicity

DOCS = "doc_id string, text string, lang string, source string, score double"


def test_risk_against_a_loop_and_its_gradient():
    rng = np.random.default_rng(0)
    p, u = rng.integers(0, 4, (30, 2)), rng.integers(0, 4, (50, 2))
    p[:, 1] += 4
    u[:, 1] += 4
    for prior, w in ((0.4, rng.normal(size=8)), (0.9, np.array([5.0, 4.0, -5.0, -4.0, 3.0, 1.0, -2.0, -1.0]))):
        b = 0.3
        loss = lambda z: math.log1p(math.exp(-z))
        f = lambda rows: [w[r].sum() + b for r in rows]
        mean = lambda x: sum(x) / len(x)
        gain, bracket = prior * mean([loss(z) for z in f(p)]), mean([loss(-z) for z in f(u)]) - prior * mean([loss(-z) for z in f(p)])
        risk, g = quality.nnpu_gradient(w, b, p, u, prior)
        assert abs(risk - (gain + max(0.0, bracket))) < 1e-9

        def part(x, of):
            z = lambda rows: [x[:-1][r].sum() + x[-1] for r in rows]
            negative = mean([loss(-t) for t in z(u)]) - prior * mean([loss(-t) for t in z(p)])
            return -negative if of < 0 else prior * mean([loss(t) for t in z(p)]) + negative

        x = np.append(w, b)
        for n in range(len(x)):
            up, down = x.copy(), x.copy()
            up[n] += 1e-6
            down[n] -= 1e-6
            assert abs((part(up, bracket) - part(down, bracket)) / 2e-6 - g[n]) < 1e-5


def test_the_reversed_gradient_is_met():
    """Rows that are all positive, and a prior too high: the bracket turns negative."""
    rows = np.array([[0, 2], [1, 3]] * 10)
    w = np.array([3.0, 3.0, 3.0, 3.0])
    risk, g = quality.nnpu_gradient(w, 0.0, rows, rows, 1.2)
    assert risk == pytest.approx(1.2 * math.log1p(math.exp(-6))) and g[-1] > 0


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(3)
    positive, mixed = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 1800), rng.normal(-2, 1, 4200)])
    assert abs(quality.best_bin(positive, mixed) - 0.3) < 0.05
    assert quality.best_bin(positive, rng.normal(2, 1, 4000)) > 0.9


def test_quality_edges(spark):
    rng = random.Random(0)
    rows = [(f"c{i}", " ".join(rng.choices([f"word{k}" for k in range(200)], k=60)) + ".") for i in range(120)] + [(f"j{i}", "SPAM!! $$ " * 40) for i in range(30)]
    rows += [(None, None), ("n", None), ("e", ""), ("long", "word " * 50_000)] + [("hot", "many rows of one id")] * 60
    docs = spark.createDataFrame([(i, t, "x", "y", 1.0) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(f"c{i}", 1) for i in range(80)] * 2 + [("j1", 0), ("j2", 7), (None, 1), ("absent", 1), ("n", None)], "doc_id string, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, out="out").collect()
    assert len(got) == len(rows) and all(0 <= r.out <= 1 for r in got)
    clean, junk = [r.out for r in got if r.doc_id and r.doc_id[0] == "c"], [r.out for r in got if r.doc_id and r.doc_id[0] == "j"]
    assert min(clean) > max(junk)
    assert quality.train(docs, labels, sample=10).prior <= 1
    assert quality.train(docs.limit(0), labels).prior == 0.5 and quality.score(docs.limit(0), model).collect() == []


def test_drawn_is_bounded_and_fixed(spark):
    ids = spark.range(5000).selectExpr("CASE WHEN id < 2500 THEN 1 ELSE id END AS i")
    got = sorted(r.i for r in common.drawn(ids, "i", 100, 5).collect())
    assert len(got) == len(set(got)) and 40 <= len(got) <= 100
    assert got == sorted(r.i for r in common.drawn(ids.repartition(7), "i", 100, 5).collect())


def test_toxicity_edges(spark):
    rows = [(f"b{i}", "an insultish thing to say") for i in range(20)] + [(f"g{i}", "a kind thing to say to women") for i in range(40)] + [(None, None), ("n", None), ("e", ""), ("long", "word " * 50_000)] + [("g1", "again the same id")] * 30
    docs = spark.createDataFrame([(i, t, "x", "y", 1.0) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(f"b{i}", 1) for i in range(20)] + [(f"g{i}", 0) for i in range(40)] + [("n", None), ("e", 2), (None, 1), ("g1", 0)], "doc_id string, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.out for r in toxicity.score(docs, model, out="out").collect()}
    assert got["b3"] >= 0.5 > got["g3"] and got["n"] == got["e"] == got[None] and model.pairs in (5 * 39, 5 * 40)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic IS NULL")):
        assert len({r.out for r in toxicity.score(docs, toxicity.train(docs, none), out="out").collect()}) == 1
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def test_penalty_and_its_gradient():
    names = list(toxicity.IDENTITY[0]) + ["other"]
    rows = [np.array([0, 6], np.int32), np.array([1, 2], np.int32), np.array([6], np.int32)]
    lost, gained = toxicity.swaps(rows, names)
    assert sorted(zip(lost.tolist(), gained.tolist())) == sorted([(0, k) for k in range(1, 6)] + [(1, -1 if k == 2 else k) for k in (0, 2, 3, 4, 5)] + [(2, -1 if k == 1 else k) for k in (0, 1, 3, 4, 5)])
    w = np.random.default_rng(1).normal(size=7)
    score = lambda row, w: sum(w[n] for n in row)

    def plain(w):
        found = []
        for row in (set(r.tolist()) for r in rows):
            found += [(score((row - {a}) | {b}, w) - score(row, w)) ** 2 for a in row if a < 6 for b in range(6) if b != a]
        return sum(found) / len(found)

    value, g = toxicity.penalty(w, lost, gained)
    assert value == pytest.approx(plain(w))
    for n in range(7):
        up, down = w.copy(), w.copy()
        up[n] += 1e-6
        down[n] -= 1e-6
        assert abs((plain(up) - plain(down)) / 2e-6 - g[n]) < 1e-6


def test_scores_of_the_language_model(spark):
    """Every row's score is its alphabet's likelihood times the share of each word in its group."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, "never seen before"), (102, "W1 w2\tw3\nw1"), (102, "w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id < 50")
    model = hmm.train(train, states=2, head=10)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    want = []
    for i, text in rows:
        letters, rest = model.alphabet.spell(hmm.tokens(text))
        inside = sum(math.log10((counts.get(w, 0) + 1) / (model.group_tokens[hmm.group_of(w)] + model.group_words[hmm.group_of(w)] + 1)) for w in rest)
        a, logs = model.parameters.start * model.parameters.emit[letters[0]], 0.0
        for x in letters[1:]:
            logs, a = logs + math.log10(a.sum()), (a / a.sum() @ model.parameters.move) * model.parameters.emit[x]
        want.append((i, round(logs + math.log10(a.sum()) + inside, 6)))
    assert sorted((r.doc_id, round(r.score, 6)) for r in hmm.score(docs, model).collect()) == sorted(want)


def test_head_words_are_the_most_frequent(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1 + (k * 7) % 23) for k in range(500)], "word binary, n long")
    got = [r.n for r in hmm.head_words(counts, 60)]
    assert got == sorted((1 + (k * 7) % 23 for k in range(500)), reverse=True)[:60]
    assert len(hmm.head_words(counts, 5000)) == 500 and hmm.head_words(counts.limit(0), 5) == []


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=60))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n "), (None, rows[0][1]), (None, None), (63, "word " * 40_000), (5, rows[5][1]), (5, rows[5][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("whole", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None if i == 3 else "h", 0) for i, t in some], schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([(i, 1) for i, _ in some if i is not None], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
        before = len(common.WRITTEN)
        got = corpus_pipeline.run(spark, at).collect()
        assert len(common.WRITTEN) == before + 1
        if not some:
            assert got == []
            continue
        kept = {r.doc_id for r in got}
        assert {i for i, _ in rows[1:60]} <= kept and (0 in kept or None in kept) and not {0, None} <= kept - {i for i, t in rows if not t}
        assert sum(r.doc_id == 5 for r in got) == 1 and zlib.crc32(b"") == 0


def test_pipeline_refuses_names_of_its_own(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a", "b", "c", 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, __kept int").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError, match="__kept"):
        corpus_pipeline.run(spark, str(tmp_path))
