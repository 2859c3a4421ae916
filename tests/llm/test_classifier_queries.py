"""The classifiers' queries against plain versions: who teaches them, what they read, and every row's score; neutral mentions with and without the penalty."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from paperlane.llm import common, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def crc(i):
    return zlib.crc32(str(i).encode())


def by_place(spark, ids, salt):
    """Ids in the order of the sample."""
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", common.hash_order(F.col("id"), salt).alias("place")).collect()
    return [r.id for r in sorted(rows, key=lambda r: r.place)]


def sigmoid(f):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, f))))


def test_quality_query(spark):
    docs, labels = tables(spark)
    taught = by_place(spark, [i for i in docs if crc(i) % 5], 1)
    stat = {i: quality.statistics(docs[i]) for i in docs}
    positive = [i for i in taught if i in labels and labels[i].quality == 1]
    model = quality.fit_nnpu(np.array([stat[i] for i in positive]), np.array([stat[i] for i in taught]))
    bins = model.edges.shape[1] + 1
    want = []
    for i in docs:
        f = model.bias + sum(model.weights[j * bins + sum(e <= x for e in model.edges[j])] for j, x in enumerate(stat[i]))
        want.append((i, crc(i) % 5 == 0, round(sigmoid(f), 7), int(sigmoid(f) >= 0.3)))
    got = queries.op1_quality(spark, SF).collect()
    assert sorted((r.doc_id, r.held_out, round(r.score, 7), r.predicted) for r in got) == sorted(want)
    assert {p for *_, p in want} == {0, 1} or len(positive) > 20


def features(text):
    """Number of each distinct feature: identity terms by their place, all else by its slot."""
    terms = [t for kind in toxicity.IDENTITY for t in kind]
    found = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        own = [w] if w in terms or len(w) < 5 else [w, "4" + w[:4]] + (["5" + w[:5]] if len(w) > 5 else [])
        found |= {terms.index(f) if f in terms else len(terms) + zlib.crc32(f.encode()) % (1 << 18) for f in own}
    return found


def test_toxicity_query(spark):
    docs, labels = tables(spark)
    taught = by_place(spark, [i for i in docs if crc(i) % 3 != 1 and i in labels and labels[i].toxic in (0, 1)], 2)
    own = {i: features(t) for i, t in docs.items()}
    model = toxicity.fit([np.array(sorted(own[i]), np.int32) for i in taught], np.array([float(labels[i].toxic) for i in taught]), list(toxicity.KIND), slots=toxicity.SLOTS)
    want = []
    for i in docs:
        score = sigmoid(model.bias + sum(model.weights[n] for n in sorted(own[i])))
        want.append((i, crc(i) % 3 == 1, round(score, 7), int(score >= 0.7)))
    got = queries.op8_toxicity(spark, SF).collect()
    assert sorted((r.doc_id, r.held_out, round(r.score, 7), r.predicted) for r in got) == sorted(want)


def test_neutral_mentions(spark):
    """Most toxic texts name a group that neutral ones seldom name: without the penalty the name alone makes neutral mentions toxic."""
    rng = random.Random(7)
    text = lambda *extra: " ".join([*rng.choices([f"w{chr(97 + k)}x" for k in range(26)], k=8), *extra])
    rows, at = [], 0
    for n, label, make in ((300, 1, lambda k: text("muslims", *(["vile"] if k % 3 else []))), (300, 0, lambda k: text(*(["christians"] if k % 4 == 0 else []))), (200, None, lambda k: text("muslims"))):
        rows += [(at + k, make(k), label) for k in range(n)]
        at += n
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    wrong = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL, 30.0):
        scored = toxicity.score(docs.where("doc_id >= 600"), toxicity.train(docs, labels, counterfactual=weight), out="out")
        wrong[weight] = scored.where(F.col("out") >= toxicity.THRESHOLD).count()
    print("neutral mentions called toxic, of 200:", wrong)
    assert wrong[0.0] > 150 and wrong[30.0] <= wrong[toxicity.COUNTERFACTUAL] <= wrong[0.0] and wrong[30.0] < 20
