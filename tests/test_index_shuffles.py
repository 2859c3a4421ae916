"""What building and searching a stored index sends by shuffle: no tokens, no pairs of queries and documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlane.operators import lexical, text_index
from paperlane.plans import catalogue


def sent(spark, what="shuffleWriteBytes"):
    """Bytes (or what else stages tell) that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(n), what)() for n in range(stages.size()))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(3000)]
    weights = [1 / (n + 1) for n in range(len(words))]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=300))) for i in range(3000)], "chunk_id long, search_document string").cache()


@pytest.mark.parametrize("analyser", ["simple", "english"])
def test_an_index_is_built_where_the_texts_are(spark, docs, analyser, tmp_path):
    before = sent(spark)
    index = text_index.build_index(docs, f"{tmp_path}/index", analyser=analyser)
    assert sent(spark) - before < 200_000
    got = index.postings.select("chunk_id", "term", "positions").orderBy("chunk_id", "term").collect()
    assert got == lexical.postings(docs, "chunk_id", "search_document", analyser).select("chunk_id", "term", "positions").orderBy("chunk_id", "term").collect()
    blocks = index.postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length"))
    assert blocks.exceptAll(index.blocks.select("term", "block", "n", "tf", "length")).isEmpty() and index.blocks.count() == blocks.count()


def test_searches_send_postings_once_and_no_pairs(spark, docs, tmp_path):
    index = text_index.build_index(docs, f"{tmp_path}/index", analyser="simple")
    rng = random.Random(9)
    queries = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(40)}" for _ in range(8))) for q in range(60)], "query_id int, query string")
    before = sent(spark)
    found = text_index.bm25_search(queries, index, 5, digits=6).collect()
    # 60 queries of 8 words beside 3,000 documents are far more pairs than there are postings of 40 words.
    assert len(found) == 300 and sent(spark) - before < 3_000_000
    few, groups = text_index.bm25_search(queries, index, 5, digits=6), text_index.FEW
    text_index.FEW = 100  # several groups of queries, nothing of theirs broadcast whole
    try:
        assert sorted(few.collect()) == sorted(found) == sorted(text_index.bm25_search(queries, index, 5, digits=6).collect())
    finally:
        text_index.FEW = groups


def test_the_search_in_sql_sends_texts_once_and_no_pairs(spark, docs):
    catalogue.register(spark)
    rng = random.Random(9)
    queries = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(40)}" for _ in range(8))) for q in range(60)], "query_id int, query string")
    before = sent(spark)
    found = spark.sql(catalogue.BM25, documents=docs.select(F.col("chunk_id").alias("doc_id"), F.col("search_document").alias("text")), queries=queries, k=5)
    assert len(found.collect()) == 300 and found.schema["lexical_score"].dataType.simpleString() == "double"
    assert sent(spark) - before < 3_000_000


def test_index_and_scores_are_no_rows_of_postings_or_pairs(spark, docs, tmp_path):
    """An index has rows of arrays, and texts are read once; scores of a query are passed on by tasks only if they may be among the best."""
    before, read = sent(spark, "outputRecords"), sent(spark, "inputRecords")
    index = text_index.build_index(docs, f"{tmp_path}/index", analyser="simple")
    made = sent(spark, "outputRecords") - before
    assert made < 2_000 < index.postings.count() and sent(spark, "inputRecords") - read < 8_000
    queries = spark.createDataFrame([(q, " ".join(f"w{n}" for n in range(q, q + 8))) for q in range(20)], "query_id int, query string")
    before = sent(spark, "outputRecords")
    found = text_index.bm25_search(queries, index, 5, digits=6).collect()
    assert len(found) == 100 and sum({r.query_id: r.ranked for r in found}.values()) > 20_000
    assert sent(spark, "outputRecords") - before < 5_000


def test_equal_documents_go_by_id_whatever_tasks_and_slabs_hold(spark, tmp_path, monkeypatch):
    rows = [(n, "a b c") for n in range(200)] + [(n, "a x y") for n in range(200, 230)] + [(n, "b z") for n in range(230, 260)]
    index = text_index.build_index(spark.createDataFrame(rows, "chunk_id int, search_document string").repartition(5), f"{tmp_path}/index", analyser="simple", block_docs=8)
    queries = spark.createDataFrame([(q, t) for q, t in enumerate(["a b c", "a", "x a", "nowhere", "b", "z b"])], "query_id int, query string")
    found = text_index.bm25_search(queries, index, 20, digits=6).collect()
    for small in ("SLAB", "PAIRS"):
        monkeypatch.setattr(text_index, small, 2)
    key = lambda r: (r.query_id, r["rank"])
    again = text_index.bm25_search(queries, index, 20, digits=6).collect()
    assert sorted(found, key=key) == sorted(again, key=key)
    ids = {q: [r.chunk_id for r in sorted(found, key=key) if r.query_id == q] for q in range(6)}
    assert ids[0] == list(range(20)) and ids[2] == list(range(200, 220)) and ids[3] == [] and ids[5] == list(range(230, 250))


@pytest.mark.parametrize("text", ["", "ab", " ab ", "ab|cd", "ñab1 x--2|||q|", "é|é", "0z"])
def test_words_end_with_their_text(text):
    import pyarrow as pa

    texts = ["left out", *text.split("|")]
    words, many = text_index.words_of(pa.array(texts).slice(1))
    want = [re.findall(lexical.TOKEN, t) for t in texts[1:]]
    assert words.to_pylist() == sum(want, []) and many.tolist() == [len(w) for w in want]
