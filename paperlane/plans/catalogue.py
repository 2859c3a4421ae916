"""The engine's functions by names, for SQL: text and vector functions, the stemmer, the TeX parser as a table function, and the data sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperlane.functions.porter import stem
from paperlane.operators.lexical import TOKEN
from paperlane.operators.ranking import RRF_K
from paperlane.operators.text_index import K1, B
from paperlane.sources import connectors
from paperlane.sources.tex import ParseTex

#: Functions that are SQL themselves, so Catalyst sees through them.
FUNCTIONS = (
    f"lexical_tokens(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(coalesce(t, '')), '{TOKEN}', 0)",
    f"token_positions(t STRING) RETURNS TABLE (p INT, term STRING) RETURN SELECT pos + 1, col FROM posexplode(regexp_extract_all(lower(coalesce(t, '')), '{TOKEN}', 0))",
    "inner_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "unit_vector(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(a, x -> x / greatest(sqrt(aggregate(a, 0D, (s, y) -> s + y * y)), 1e-12D))",
    f"rrf(rank INT) RETURNS DOUBLE RETURN coalesce(1D / ({RRF_K} + rank), 0D)",
    f"bm25(tf DOUBLE, length DOUBLE, mean_length DOUBLE) RETURNS DOUBLE RETURN tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * length / mean_length))",
)

#: A whole search as one text: the k best documents (doc_id, text) of every query (query_id, query) by BM25. Texts are dealt by document once; words are counted, and queries met, where a document then lies,
#: so no pair of a word and a document, or of a query and a document, is sent. What is broadcast is bounded by the words of the queries. Scores are sums of integers, whose order does not matter.
BM25 = """
WITH q AS (SELECT query_id, lexical_tokens(query) AS words FROM {queries}),
asked AS (SELECT DISTINCT query_id, term FROM q LATERAL VIEW explode(words) AS term),
totals AS (SELECT count(*) AS n, avg(size(lexical_tokens(text))) AS mean_length FROM {documents}),
dealt AS (SELECT /*+ REPARTITION(doc_id) */ doc_id, text FROM {documents}),
d AS (SELECT doc_id, lexical_tokens(text) AS words FROM dealt),
found AS (SELECT doc_id, size(words) AS length, term FROM d LATERAL VIEW explode(words) AS term),
known AS (SELECT /*+ BROADCAST(a) */ doc_id, length, f.term, count(*) AS tf FROM found f LEFT SEMI JOIN (SELECT DISTINCT term FROM asked) a ON f.term = a.term GROUP BY doc_id, length, f.term),
held AS (SELECT term, count(*) AS df FROM known GROUP BY term),
weights AS (SELECT /*+ BROADCAST(h), BROADCAST(t) */ query_id, term, ln(1 + (n - df + 0.5D) / (df + 0.5D)) AS idf, mean_length FROM asked JOIN held h USING (term) CROSS JOIN totals t),
scored AS (
  SELECT /*+ BROADCAST(w) */ query_id, doc_id, round(sum(CAST(round(idf * bm25(tf, length, mean_length) * 281474976710656D) AS BIGINT)) / 281474976710656D, 6) AS score
  FROM known JOIN weights w USING (term) GROUP BY query_id, doc_id
)
SELECT query_id, doc_id AS chunk_id, score AS lexical_score, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}
"""


def register(spark: SparkSession) -> None:
    """Puts all functions and sources into the session; calling it again changes nothing."""
    for function in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")

    @F.pandas_udf("string")
    def english_stem(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    spark.udf.register("english_stem", english_stem)
    spark.udtf.register("parse_tex", F.udtf(ParseTex))
    connectors.register(spark)
