"""The stored index: equal results to searches that read the texts, plans without texts, early ends that drop nothing, odd rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paperlane import queries
from paperlane.operators import lexical, text_index
from paperlane.plans import stored

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{n}" for n in range(60)] + ["The", "jets", "Jumping", "of"]
    weights = [1 / (n + 1) for n in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "w1 " * 400), (None, "w1 w2 w3"), (1003, "w59 w58 w57 w59"), (1004, "w59 w58 w57 w59")]
    docs = spark.createDataFrame(rows, "chunk_id int, search_document string")
    path = str(tmp_path_factory.mktemp("index"))
    index = text_index.build_index(docs, f"{path}/simple", analyser="simple", buckets=4, block_docs=16)
    return rows, docs, index, text_index.build_index(docs, f"{path}/english", buckets=4, block_docs=16)


def asked(spark, n=12):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["nowhere"]
    return spark.createDataFrame([(q, " ".join(rng.sample(words, rng.randint(1, 3)))) for q in range(n)] + [(50, ""), (51, "w59 w57"), (52, "w1")], "query_id int, query string")


def test_covers_equal_those_of_the_texts(spark, corpus):
    _, docs, index, _ = corpus
    want = lexical.lexical_search(asked(spark), docs.where("chunk_id IS NOT NULL"), 5).collect()
    plain = lexical.cover_search(asked(spark), index, 5).collect()
    early = text_index.cover_topk(asked(spark), index, 5)
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, r.covers, r.lexical_score)
    assert sorted(map(key, plain)) == sorted(map(key, want)) == sorted(map(key, early.collect())) and len(want) > 30
    matches = {q: n for q, n in lexical.cover_search(asked(spark), index, 10_000).groupBy("query_id").count().collect()}
    ranked = {r.query_id: r.ranked for r in early.collect()}
    assert all(ranked[q] <= n for q, n in matches.items()) and ranked[52] < matches[52]


def test_bm25_equals_loops_and_ends_early(spark, corpus):
    rows, _, index, _ = corpus
    texts = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows if i is not None}
    mean = sum(map(len, texts.values())) / len(texts)
    found = text_index.bm25_search(asked(spark), index, 7).collect()
    matches = {}
    for q in asked(spark).collect():
        want = []
        for i, words in texts.items():
            score = 0.0
            for term in set(re.findall("[a-z0-9]+", q["query"])):
                df = sum(term in w for w in texts.values())
                tf = words.count(term)
                score += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) if tf else 0
            if score:
                want.append((-round(score, 9), i))
        matches[q["query_id"]] = len(want)
        got = sorted((r["rank"], -round(r.lexical_score, 9), r.chunk_id) for r in found if r.query_id == q["query_id"])
        assert [g[1:] for g in got] == sorted(want)[:7]
    ranked = {r.query_id: r.ranked for r in found}
    other = text_index.bm25_search(asked(spark), index, 7, k1=1.2, b=0.75 + 1e-12).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in other) == sorted((r.query_id, r["rank"], r.chunk_id) for r in found)
    assert all(n <= matches[q] for q, n in ranked.items()) and ranked[51] < matches[51] and ranked[52] < matches[52]


def test_web_queries_read_no_text(spark, corpus):
    _, docs, _, index = corpus
    web = spark.createDataFrame(list(enumerate(["jet -w1", '"w1 w2" or w5', "-jumps", "the", "w3 w4 -w2", "-w1 -w2", "-nowhere", None])), "query_id int, query string")
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, r.covers, r.lexical_score)
    want = lexical.web_search(web, docs.where("chunk_id IS NOT NULL"), 9)
    got = lexical.web_query_search(web, index, 9)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 30
    for source in (index.held(spark.createDataFrame([("w1",)], "term string")), index.positions(spark.createDataFrame([("w1", 3)], "term string, chunk_id int"))):
        assert "search_document" not in plan_of(source) and "regexp_extract_all" not in plan_of(source)


def test_queries_on_tables(spark):
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, r.covers, r.lexical_score)
    for one, other in ((queries.web_search_indexed, queries.web_search_english), (queries.index_cover_topk, queries.lexical_cover_rank)):
        assert sorted(map(key, one(spark, SF).collect())) == sorted(map(key, other(spark, SF).collect()))


def test_stems_are_taken_once(spark, corpus):
    """One call of the stemmer, above the distinct; the filter on stems stays above it."""
    _, docs, _, _ = corpus
    found = lexical.tokens(docs, "chunk_id", "search_document")
    plan = plan_of(lexical.vocabulary(found).join(spark.createDataFrame([("jet",)], "stem string"), "stem", "left_semi"))
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate")
    assert "ArrowEvalPython" not in plan[plan.index("Aggregate") :]


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, search_document string")
    index = text_index.build_index(none, f"{tmp_path}/none")
    web = spark.createDataFrame([("a", "x"), ("b", "-x")], "query_id string, query string")
    assert lexical.web_query_search(web, index, 3).collect() == [] and text_index.bm25_search(web, index, 3).collect() == [] and text_index.cover_topk(web, index, 3).collect() == []
    again = text_index.open_index(spark, index.path)
    assert (again.n_docs, again.id_col, again.analyser) == (0, "chunk_id", "english")
    for search in (text_index.bm25_search, text_index.cover_topk):
        with pytest.raises(ValueError):
            search(web, index, 0)
    with pytest.raises(ValueError, match="chunk_id repeats"):
        text_index.build_index(spark.createDataFrame([("a", "x"), ("a", "y")], "chunk_id string, search_document string"), f"{tmp_path}/twice")
    index.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text_index.open_index(spark, index.path)


def test_runs_delete_their_own_folders(spark):
    df = spark.range(3)
    outside = stored.stored(df, "outside")
    with stored.run(spark) as own:
        inner = stored.stored(df, "inner")
        with stored.run(spark):
            nested = stored.stored(inner, "nested")
        kept = stored.result(inner.select((F.col("id") * 2).alias("id")), own)
    assert outside.count() == kept.count() == 3
    for gone in (inner, nested):
        with pytest.raises(Exception):
            gone.collect()
    stored.drop(kept)
    with pytest.raises(Exception):
        kept.collect()
