"""Search by the pipelines' own settings takes web-style queries in English."""

from pyspark.sql import functions as F

from paperlane.plans import config, pipelines


def test_search_takes_web_queries(spark):
    docs = spark.createDataFrame([(1, "The jet was jumping"), (2, "a cat in the hat"), (3, "hat of a cat"), (4, "blue fox")], "chunk_id int, search_document string")
    index = docs.select("*", *(F.lit(None).cast("string").alias(c) for c in pipelines.PAYLOAD if c != "chunk_id"))
    asked = ["What are jets?", "jumps", "hats or foxes", "cat -fox", '"cat in the hat"', "hat -cat", "-cat", "the", 'fox "fox"', None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in pipelines.search(queries, index, config.RetrievalConfig(mode="lexical")).collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert {q: sorted(c) for q, c in got.items()} == {0: [1], 1: [1], 2: [2, 3, 4], 3: [2, 3], 4: [2], 6: [1, 4], 8: [4]}
