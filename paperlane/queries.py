"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows.

documents stand for papers (paper_id: the id as text; section_path: language and source; paragraphs: lines), embeddings for
vectors of papers, benchmark for queries. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.functions import text as T
from paperlane.operators import chunking, evidence, graph, lexical, metrics, prompts, ranking, text_index, vector
from paperlane.plans import catalogue, stored
from paperlane.sources import bibtex, categories, files, tex

CHUNK_TOKENS, POOL, FINAL, CAP, BUDGET = 100, 30, 6, 2, 1500

#: Inexact search: cells, bytes of a code, rows by code for each row wanted; tables of signed projections, with the buckets looked into beyond a query's own.
CELLS, PARTS, CODED, PROJECTIONS, FLIPS = 16, 16, 5, vector.Projections(64, tables=16, bits=6), 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Frames that several queries start from.


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lines = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.array("lang", "source").alias("section_path"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.trim("text") != "").withColumns({"kind": F.lit("paragraph"), "paragraph_id": F.format_string("%s:p%05d", "paper_id", "pos")})


def lines_as_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lines = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), F.array("lang", "source").alias("section_path"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return lines.withColumns({"chunk_id": F.format_string("%s:%05d", "paper_id", "chunk_index"), "chunk_type": F.when(F.col("chunk_index") == 0, "abstract").otherwise("paragraph")})


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, index): every vector against all vectors."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("paper_id"))


def hits(spark: SparkSession, sf: str, k: int = POOL) -> DataFrame:
    q, index = vectors(spark, sf)
    return vector.vector_search(q, index, k).join(index.select("chunk_id", "paper_id"), "chunk_id")


def paper_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The FINAL best papers of every vector, each with a hit on its third line."""
    q, index = vectors(spark, sf)
    h = vector.vector_search(q, index, FINAL)
    return h.select("query_id", F.col("chunk_id").cast("string").alias("paper_id"), F.lit(2).alias("chunk_index"), "rank", F.format_string("%d:%05d", "chunk_id", F.lit(2)).alias("chunk_id"))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_hits(spark: SparkSession, sf: str, k: int = POOL) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("search_document"))
    return lexical.lexical_search(benchmark_queries(spark, sf), docs, k, digits=6)


def with_index(spark: SparkSession, sf: str, analyser: str, search: Callable[[text_index.TextIndex], DataFrame]) -> DataFrame:
    """What `search` finds in a stored index of the documents; index and intermediate tables are deleted afterwards."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("search_document"))
    with stored.run(spark) as own:
        return stored.result(search(text_index.build_index(docs, stored.new_folder(spark, "index"), analyser=analyser)), own)


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, candidates, targets): a paper is relevant to a vector if it bears the same label and its document is labelled quality 0, as the SQL has it. Queries of one label share their targets."""
    e = table(spark, sf, "embeddings")
    good = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    targets = e.join(good, "vec_id").select(F.col("label").alias("target_group"), F.col("vec_id").cast("string").alias("paper_id")).distinct()
    qs, index = vectors(spark, sf)
    found = vector.vector_search(qs, index, 40).select("query_id", F.col("chunk_id").cast("string").alias("paper_id"), F.col("rank").alias("paper_rank"))
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("target_group")), found, targets


def r6(c: str):
    return F.round(c, 6).alias(c)


# Shared SQL.

S_PAIRS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::VARCHAR AS label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label AS paper_id, list_inner_product(q.e, c.e) AS score FROM v q, v c),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {k})
"""
S_LINES = """
lines AS (SELECT doc_id::VARCHAR AS paper_id, source AS title, [lang, source] AS section_path, pos - 1 AS chunk_index, text, printf('%d:%05d', doc_id, pos - 1) AS chunk_id, CASE WHEN pos = 1 THEN 'abstract' ELSE 'paragraph' END AS chunk_type
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
seed AS (SELECT query_id, chunk_id::VARCHAR AS paper_id, 2 AS chunk_index, rank, printf('%d:%05d', chunk_id, 2) AS chunk_id FROM hit)
"""
S_TERMS = r"""
WITH tok AS (SELECT doc_id, unnest(w) AS tk, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
qt AS (SELECT DISTINCT item_id AS q, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tk FROM benchmark),
qn AS (SELECT q, count(*) AS n FROM qt GROUP BY q),
raw AS (SELECT qt.q, tok.doc_id AS d, tok.p, tok.tk FROM tok JOIN qt USING (tk)),
held AS (SELECT q, d FROM raw JOIN qn USING (q) GROUP BY q, d, n HAVING count(DISTINCT tk) = n)
"""
S_COVERS = """,
h AS (SELECT raw.*, row_number() OVER (PARTITION BY q, d ORDER BY p) AS ix FROM raw JOIN held USING (q, d)),
l AS (SELECT h.q, h.d, h.p, h.ix, t.tk AS t, max(CASE WHEN h.tk = t.tk THEN h.p END) OVER w AS lp, max(CASE WHEN h.tk = t.tk THEN h.ix END) OVER w AS lx
  FROM h JOIN qt t ON h.q = t.q WINDOW w AS (PARTITION BY h.q, h.d, t.tk ORDER BY h.p ROWS UNBOUNDED PRECEDING)),
e AS (SELECT q, d, p, ix, min(lp) AS a, min(lx) AS ax FROM l GROUP BY q, d, p, ix HAVING count(*) = count(lp)),
c AS (SELECT q, d, a, ax, min(p) AS b, min(ix) AS bx FROM e GROUP BY q, d, a, ax),
sc AS (SELECT q, d, count(*) AS covers, sum(0.1::DOUBLE / (1 + (b - a) - (bx - ax))) AS score FROM c GROUP BY q, d),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, d) AS rank FROM sc) WHERE rank <= 30)
"""
S_SENTENCES = rf"""
WITH RECURSIVE para AS (SELECT doc_id::VARCHAR AS paper_id, [lang, source] AS section_path, pos - 1 AS pos, text
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(text) <> ''),
sized AS (SELECT *, greatest(1, len(regexp_extract_all(text, '\S+'))) > {CHUNK_TOKENS} AND NOT regexp_matches(text, '\\begin\{{(equation|align|gather|multline|eqnarray|displaymath)\*?\}}|\\\[|\$\$') AS long FROM para),
sent AS (SELECT paper_id, pos, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM sized WHERE long),
fold AS (
  SELECT paper_id, pos, s, 0 AS i, []::VARCHAR[] AS done, '' AS open, 0 AS n FROM sent
  UNION ALL
  SELECT paper_id, pos, s, i + 1, CASE WHEN n > 0 AND n + k > {CHUNK_TOKENS} THEN list_append(done, open) ELSE done END,
    CASE WHEN n > 0 AND n + k <= {CHUNK_TOKENS} THEN open || ' ' || x ELSE x END, CASE WHEN n > 0 AND n + k <= {CHUNK_TOKENS} THEN n + k ELSE k END
  FROM (SELECT *, s[i + 1] AS x, greatest(1, len(regexp_extract_all(s[i + 1], '\S+'))) AS k FROM fold WHERE i < len(s))
),
piece AS (SELECT paper_id, pos, list_append(done, open) AS parts FROM fold WHERE i = len(s)),
parts AS (SELECT z.paper_id, z.section_path, z.pos, CASE WHEN z.long THEN piece.parts ELSE [z.text] END AS parts FROM sized z LEFT JOIN piece USING (paper_id, pos)),
chunk AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pos, k) - 1 AS chunk_index FROM (SELECT paper_id, section_path, pos, unnest(parts) AS text, generate_subscripts(parts, 1) AS k FROM parts))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(S_PAIRS.format(k=10) + "SELECT query_id, chunk_id, paper_id, round(score, 6) AS vector_score, rank::INTEGER AS rank FROM hit")
def vector_topk_batch(spark, sf):
    return hits(spark, sf, 10).select("query_id", "chunk_id", "paper_id", r6("vector_score"), F.col("rank").cast("int").alias("rank"))


@query("""WITH m AS (SELECT list(a ORDER BY i) AS q FROM (SELECT i, round(avg(x), 6) AS a FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)),
s AS (SELECT vec_id AS chunk_id, list_inner_product(embedding::DOUBLE[], q) AS score FROM embeddings, m)
SELECT chunk_id, round(score, 6) AS vector_score, (row_number() OVER (ORDER BY score DESC, chunk_id))::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def vector_topk(spark, sf):
    """One query, the mean vector: the 20 nearest."""
    e = table(spark, sf, "embeddings")
    mean = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("a")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("query_embedding"))
    found = vector.vector_search(mean.withColumn("query_id", F.lit(0)), e.withColumnRenamed("vec_id", "chunk_id"), 20)
    return found.select("chunk_id", r6("vector_score"), F.col("rank").cast("int").alias("rank"))


@query()
def vector_topk_compressed(spark, sf):
    """vector_topk_batch by codes of 16 bytes in all cells, the best 50 by code ranked by their vectors; a test measures the recall."""
    q, index = vectors(spark, sf)
    with stored.run(spark) as own:
        book = vector.fit_codebooks(index, CELLS, PARTS)
        codes = stored.stored(vector.compress(index, book), "codes")
        found = vector.compressed_search(q, codes, index, book, 10, pool=CODED)
        return stored.result(found.select("query_id", "chunk_id", r6("vector_score"), F.col("rank").cast("int").alias("rank")), own)


@query()
def vector_topk_hashed(spark, sf):
    """vector_topk_batch by signed projections; a test measures the recall."""
    q, index = vectors(spark, sf)
    with stored.run(spark) as own:
        found = vector.hashed_search(q, vector.hashed_index(index, PROJECTIONS), PROJECTIONS, 10, FLIPS)
        return stored.result(found.select("query_id", "chunk_id", r6("vector_score"), F.col("rank").cast("int").alias("rank")), own)


@query("SELECT vec_id, (i - 1)::INTEGER AS i, round(e[i] / greatest(sqrt(list_inner_product(e, e)), 1e-12), 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def vector_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform(T.normalize_vector(F.col("embedding")), lambda x: F.round(x, 6))).alias("i", "x"))


@query(r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '\S+')))::INTEGER AS words, greatest(1, ceil(length(text) / 3.5::DOUBLE))::INTEGER AS answer_tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_words(F.col("text")).alias("words"), T.estimate_answer_tokens(F.col("text")).alias("answer_tokens"))


@query(r"SELECT doc_id, regexp_matches(text, '\\begin\{(equation|align|gather|multline|eqnarray|displaymath)\*?\}|\\\[|\$\$') AS has_math FROM documents")
def display_math_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.has_display_math(F.col("text")).alias("has_math"))


@query(S_SENTENCES + "SELECT paper_id, pos::INTEGER AS pos, array_to_string(parts, chr(10)) AS pieces FROM piece")
def sentence_pack(spark, sf):
    p = paragraphs(spark, sf)
    long = (T.count_words(F.col("text")) > CHUNK_TOKENS) & ~T.has_display_math(F.col("text"))
    return p.where(long).select("paper_id", "pos", F.array_join(T.pack_sentences(F.col("text"), CHUNK_TOKENS), "\n").alias("pieces"))


@query(S_SENTENCES + r"""SELECT paper_id, chunk_index::INTEGER AS chunk_index, text, greatest(1, len(regexp_extract_all(text, '\S+')))::INTEGER AS token_count,
printf('%s:chunk:%05d:%s', paper_id, chunk_index, sha1(paper_id || chr(10) || array_to_string(section_path, '/') || chr(10) || chunk_index || chr(10) || text[1:500])[1:12]) AS chunk_id FROM chunk""")
def chunks(spark, sf):
    return chunking.chunk_paragraphs(paragraphs(spark, sf), CHUNK_TOKENS).select("paper_id", "chunk_index", "text", "token_count", "chunk_id")


@query("SELECT doc_id, 'Title: ' || source || chr(10) || 'Section: ' || lang || ' > ' || source || chr(10) || 'Living Review categories: ' || lang || ' > ' || source || '; ' || source || chr(10) || chr(10) || text AS dense FROM documents")
def doc_render_dense(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.render_dense(F.col("source"), F.array("lang", "source"), F.array(F.array("lang", "source"), F.array("source")), F.col("text")).alias("dense"))


@query("SELECT doc_id, concat_ws(chr(10), source, lang || ' > ' || source, lang || ' > ' || source, source, nullif(text, '')) AS lexical FROM documents")
def doc_render_lexical(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.render_lexical(F.col("source"), F.array("lang", "source"), F.array(F.array("lang", "source"), F.array("source")), F.col("text")).alias("lexical"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def source_status_summary(spark, sf):
    return files.status_summary(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'downloaded_and_extracted' ELSE 'already_extracted' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def manifest_filter(spark, sf):
    o = table(spark, sf, "orders")
    manifest = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "downloaded_and_extracted").when(F.col("o_orderstatus") == "O", "already_extracted").otherwise("failed").alias("status"), F.col("o_custkey").cast("string").alias("extracted_path"))
    there = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("extracted_path"))
    return files.parseable(manifest, there).select("o_orderkey", "status")


@query("""WITH new AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier)
SELECT k AS chunk_id, name, bal FROM new UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM new)""")
def upsert_merge(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return files.upsert(old, new)


@query(S_TERMS + "SELECT doc_id, tk AS term, string_agg(p::VARCHAR, ',' ORDER BY p) AS positions FROM tok GROUP BY doc_id, tk")
def postings(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), "doc_id", "text").withColumn("positions", F.array_join("positions", ","))


@query(S_TERMS + "SELECT q AS query_id, d AS doc_id FROM held")
def lexical_match(spark, sf):
    terms = lexical.query_terms(benchmark_queries(spark, sf))
    held = lexical.Texts(table(spark, sf, "documents"), "doc_id", "text").held(terms.select("term").distinct())
    return lexical.match_all(held, terms, "doc_id")


@query(S_TERMS + S_COVERS + "SELECT q AS query_id, d AS chunk_id, covers, round(score, 6) AS lexical_score, rank::INTEGER AS rank FROM lex")
def lexical_cover_rank(spark, sf):
    return lexical_hits(spark, sf).select("query_id", "chunk_id", "covers", r6("lexical_score"), F.col("rank").cast("int").alias("rank"))


@query(S_TERMS + S_COVERS + "SELECT q AS query_id, d AS chunk_id, covers, round(score, 6) AS lexical_score, rank::INTEGER AS rank FROM lex")
def index_cover_topk(spark, sf):
    """lexical_cover_rank from a stored index, with an early end."""
    found = with_index(spark, sf, "simple", lambda index: text_index.cover_topk(benchmark_queries(spark, sf), index, POOL, digits=6))
    return found.select("query_id", "chunk_id", "covers", r6("lexical_score"), F.col("rank").cast("int").alias("rank"))


@query(S_TERMS + f""",
d AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS length FROM documents),
m AS (SELECT avg(length) AS mean, count(*) AS n FROM d),
tf AS (SELECT doc_id, tk, count(*) AS tf FROM tok GROUP BY doc_id, tk),
df AS (SELECT tk, count(*) AS df FROM tf GROUP BY tk),
sc AS (SELECT q, doc_id AS d, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {text_index.K1 + 1} / (tf + {text_index.K1} * ({1 - text_index.B} + {text_index.B} * length / mean))) AS score
  FROM qt JOIN tf USING (tk) JOIN df USING (tk) JOIN d USING (doc_id), m GROUP BY q, doc_id)
SELECT q AS query_id, d AS chunk_id, round(score, 6) AS lexical_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, d) AS rank FROM sc) WHERE rank <= 20""")
def bm25_topk(spark, sf):
    """The 20 best documents of every benchmark item by BM25, from a stored index, with an early end."""
    found = with_index(spark, sf, "simple", lambda index: text_index.bm25_search(benchmark_queries(spark, sf), index, 20, digits=6))
    return found.select("query_id", "chunk_id", r6("lexical_score"), F.col("rank").cast("int").alias("rank"))


@query(ORACLES["bm25_topk"])
def bm25_sql(spark, sf):
    """bm25_topk as one SQL text over the catalogue's functions, without an index."""
    catalogue.register(spark)
    return spark.sql(catalogue.BM25, documents=table(spark, sf, "documents"), queries=table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k=20)


def web_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Web-style queries from words of the benchmark items: by turns a phrase, alternatives, a forbidden word, and plain words."""
    w = F.split(F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " ")
    word = lambda n: F.coalesce(F.get(w, F.lit(n)), F.lit("the"))
    texts = [F.concat(F.lit('"'), word(0), F.lit(" "), word(1), F.lit('"')), F.concat(word(0), F.lit(" or "), word(3), F.lit(" "), word(1)), F.concat(word(0), F.lit(" -"), word(2)), F.concat(F.lit("the "), word(0), F.lit(" "), word(1), F.lit(" "), word(2))]
    kind = F.col("item_id") % 4
    text = F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).when(kind == 2, texts[2]).otherwise(texts[3])
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


@query()
def web_search_english(spark, sf):
    """Web-style queries in English (stems, stop words, phrases, `or`, `-`), ranked; a test holds it against a brute-force version."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("search_document"))
    found = lexical.web_search(web_queries(spark, sf), docs, POOL, digits=9)
    return found.select("query_id", "chunk_id", "covers", r6("lexical_score"), F.col("rank").cast("int").alias("rank"))


@query()
def web_search_indexed(spark, sf):
    """web_search_english from a stored index; a test holds it against that query."""
    found = with_index(spark, sf, "english", lambda index: lexical.web_query_search(web_queries(spark, sf), index, POOL, digits=9))
    return found.select("query_id", "chunk_id", "covers", r6("lexical_score"), F.col("rank").cast("int").alias("rank"))


@query(S_TERMS + S_COVERS + """,
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS q, c.vec_id AS d, list_inner_product(q.e, c.e) AS score FROM v q JOIN benchmark b ON q.vec_id = b.item_id, v c),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s) WHERE rank <= 30),
f AS (SELECT coalesce(vec.q, lex.q) AS q, coalesce(vec.d, lex.d) AS d, vec.score AS vs, lex.score AS ls, coalesce(1::DOUBLE / (60 + vec.rank), 0) + coalesce(1::DOUBLE / (60 + lex.rank), 0) AS rrf FROM vec FULL JOIN lex ON vec.q = lex.q AND vec.d = lex.d)
SELECT q AS query_id, d AS chunk_id, round(vs, 6) AS vector_score, round(ls, 6) AS lexical_score, round(rrf, 6) AS rrf_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, d) AS rank FROM f) WHERE rank <= 30""")
def hybrid_rrf(spark, sf):
    """Vectors with a benchmark item's number stand for its embedding."""
    q, index = vectors(spark, sf)
    own = q.join(benchmark_queries(spark, sf).select("query_id"), "query_id", "left_semi")
    fused = ranking.fuse(vector.vector_search(own, index, POOL), lexical_hits(spark, sf), POOL, digits=12)
    return fused.select("query_id", "chunk_id", r6("vector_score"), r6("lexical_score"), r6("rrf_score"), F.col("rank").cast("int").alias("rank"))


@query(S_TERMS + S_COVERS + r""",
w AS (SELECT lex.q, lex.d, lex.rank, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(t.text), '\s+'), lambda x: x <> '')) AS dw FROM lex JOIN benchmark b ON lex.q = b.item_id JOIN documents t ON lex.d = t.doc_id),
sc2 AS (SELECT q, d, rank, len(list_intersect(qw, dw)) / greatest(1, len(qw))::DOUBLE AS s FROM w)
SELECT q AS query_id, d AS chunk_id, round(s, 6) AS rerank_score, (row_number() OVER (PARTITION BY q ORDER BY s DESC, rank))::INTEGER AS rank FROM sc2""")
def rerank_stub(spark, sf):
    h = lexical_hits(spark, sf).join(benchmark_queries(spark, sf), "query_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    out = ranking.rerank(h.withColumn("final_score", F.col("lexical_score")), ranking.OverlapScorer())
    return out.select("query_id", "chunk_id", r6("rerank_score"), F.col("rank").cast("int").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, round(exp(-l_discount) / (exp(-l_discount) + exp(-l_tax)), 6) AS p FROM lineitem")
def rerank_probability(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.yes_probability(-F.col("l_discount"), -F.col("l_tax")), 6).alias("p"))


@query(S_PAIRS.format(k=POOL) + f"""SELECT query_id, chunk_id, paper_id, rank::INTEGER AS rank FROM (
SELECT query_id, chunk_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n FROM hit) WHERE n <= {CAP}) WHERE rank <= {FINAL}""")
def diversify(spark, sf):
    return ranking.diversify(hits(spark, sf), FINAL, CAP).select("query_id", "chunk_id", "paper_id", F.col("rank").cast("int").alias("rank"))


@query(S_PAIRS.format(k=POOL) + "SELECT query_id, chunk_id, paper_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n FROM hit) WHERE n = 1) WHERE n2 <= 5")
def unique_papers(spark, sf):
    return ranking.unique_papers(hits(spark, sf), 5).select("query_id", "chunk_id", "paper_id", F.col("rank").cast("int").alias("rank"))


@query(S_PAIRS.format(k=POOL) + "SELECT query_id, chunk_id, paper_id, n2::INTEGER AS paper_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n FROM hit) WHERE n = 1) WHERE n2 <= 5")
def collapse_papers(spark, sf):
    return ranking.collapse_papers(hits(spark, sf), 5).select("query_id", "chunk_id", "paper_id", F.col("paper_rank").cast("int").alias("paper_rank"))


@query(S_PAIRS.format(k=FINAL) + "," + S_LINES + """SELECT DISTINCT p.query_id, l.chunk_id, l.chunk_index::INTEGER AS chunk_index FROM lines l JOIN (SELECT DISTINCT query_id, paper_id FROM seed) p USING (paper_id)
WHERE l.chunk_type = 'abstract' OR list_contains(l.section_path, 'Abstract') OR EXISTS (SELECT 1 FROM seed s WHERE s.query_id = p.query_id AND s.paper_id = l.paper_id AND l.chunk_index BETWEEN s.chunk_index - 1 AND s.chunk_index + 1)""")
def evidence_select(spark, sf):
    return evidence.select_evidence(paper_hits(spark, sf), lines_as_chunks(spark, sf), 1).select("query_id", "chunk_id", "chunk_index")


@query(S_PAIRS.format(k=FINAL) + "," + S_LINES + """, paper AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), paper_id) AS source_number FROM seed GROUP BY query_id, paper_id),
ev AS (SELECT p.query_id, p.source_number, l.*, s.rank AS hit_rank, l.chunk_type = 'abstract' AS is_abstract FROM lines l JOIN paper p USING (paper_id) LEFT JOIN seed s ON s.query_id = p.query_id AND s.chunk_id = l.chunk_id WHERE l.chunk_index <= 3)
SELECT query_id, source_number::INTEGER AS source_number, chunk_id, is_abstract, CASE WHEN NOT is_abstract THEN row_number() OVER (PARTITION BY query_id, paper_id ORDER BY is_abstract, coalesce(hit_rank, 10000), chunk_index, chunk_id) END::INTEGER AS "position" FROM ev""")
def evidence_rank(spark, sf):
    h = paper_hits(spark, sf)
    return evidence.rank_evidence(h, evidence.select_evidence(h, lines_as_chunks(spark, sf), 1)).select("query_id", F.col("source_number").cast("int").alias("source_number"), "chunk_id", "is_abstract", F.col("position").cast("int").alias("position"))


def _plain_evidence(spark, sf) -> DataFrame:
    """Evidence of papers without abstracts: the lines around the hit."""
    h = paper_hits(spark, sf)
    plain = lines_as_chunks(spark, sf).withColumn("chunk_type", F.lit("paragraph"))
    return evidence.rank_evidence(h, evidence.select_evidence(h, plain, 2))


S_PLAIN = S_PAIRS.format(k=FINAL) + "," + S_LINES + """, paper AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), paper_id) AS source_number FROM seed GROUP BY query_id, paper_id),
ev AS (SELECT p.query_id, p.source_number, l.*, row_number() OVER (PARTITION BY p.query_id, p.paper_id ORDER BY coalesce(s.rank, 10000), l.chunk_index) AS pos FROM lines l JOIN paper p USING (paper_id) LEFT JOIN seed s ON s.query_id = p.query_id AND s.chunk_id = l.chunk_id WHERE l.chunk_index <= 4)
"""


@query(S_PLAIN.replace("WITH v", "WITH RECURSIVE v", 1) + f""",
must AS (SELECT query_id, source_number, '[SOURCE ' || source_number || ']' || chr(10) || 'Paper: ' || min(title) || chr(10) || 'arXiv: ' || min(paper_id) || chr(10) || 'Abstract:' || chr(10) || '(Abstract unavailable in corpus.)' || chr(10) AS t FROM ev GROUP BY query_id, source_number),
blk AS (SELECT query_id, chunk_id, greatest(1, ceil(length('Passage, section ' || array_to_string(section_path, ' > ') || ':' || chr(10) || text || chr(10)) / 3.5::DOUBLE))::INTEGER AS cost, row_number() OVER (PARTITION BY query_id ORDER BY source_number, pos) AS i FROM ev),
fold AS (
  SELECT query_id, 0::BIGINT AS i, sum(greatest(1, ceil(length(t) / 3.5::DOUBLE)))::INTEGER AS used, []::VARCHAR[] AS kept FROM must GROUP BY query_id
  UNION ALL
  SELECT f.query_id, b.i, CASE WHEN used + cost <= {BUDGET} THEN used + cost ELSE used END, CASE WHEN used + cost <= {BUDGET} THEN list_append(kept, b.chunk_id) ELSE kept END FROM fold f JOIN blk b ON b.query_id = f.query_id AND b.i = f.i + 1
)
SELECT query_id, max_by(used, i)::INTEGER AS used, array_to_string(max_by(kept, i), ',') AS kept FROM fold GROUP BY query_id""")
def context_pack(spark, sf):
    return evidence.pack_context(_plain_evidence(spark, sf), BUDGET).select("query_id", "used", F.array_join("kept", ",").alias("kept"))


@query(S_PLAIN.replace("WITH v", "WITH RECURSIVE v", 1) + f""",
must AS (
  SELECT query_id, source_number, '[SOURCE ' || source_number || ']' || chr(10) || 'Paper: ' || min(title) || chr(10) || 'arXiv: ' || min(paper_id) || chr(10) || 'Abstract:' || chr(10)
    || coalesce(nullif(max(CASE WHEN chunk_index = 0 THEN text[1:400] END), ''), '(Abstract unavailable in corpus.)') || chr(10) AS t
  FROM ev GROUP BY query_id, source_number
),
cost AS (
  SELECT query_id, source_number, pos, chunk_id, greatest(1, ceil(length('Passage, section ' || array_to_string(section_path, ' > ') || ':' || chr(10) || text || chr(10)) / 3.5::DOUBLE))::INTEGER AS cost
  FROM ev WHERE chunk_index > 0
),
blk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_number, pos) AS i FROM cost),
fold AS (
  SELECT query_id, 0::BIGINT AS i, sum(greatest(1, ceil(length(t) / 3.5::DOUBLE)))::INTEGER AS used, []::VARCHAR[] AS kept FROM must GROUP BY query_id
  UNION ALL
  SELECT f.query_id, b.i, CASE WHEN used + cost <= {BUDGET} THEN used + cost ELSE used END, CASE WHEN used + cost <= {BUDGET} THEN list_append(kept, b.chunk_id) ELSE kept END
  FROM fold f JOIN blk b ON b.query_id = f.query_id AND b.i = f.i + 1
)
SELECT query_id, max_by(used, i)::INTEGER AS used, array_to_string(max_by(kept, i), ',') AS kept FROM fold GROUP BY query_id""")
def context_pack_abstracts(spark, sf):
    """Abstracts (the first 400 characters of a paper's first line) must all go in; passages share what is left of the budget."""
    lines = lines_as_chunks(spark, sf).withColumn("text", F.when(F.col("chunk_type") == "abstract", F.substring("text", 1, 400)).otherwise(F.col("text")))
    h = paper_hits(spark, sf)
    packed = evidence.pack_context(evidence.rank_evidence(h, evidence.select_evidence(h, lines, 2)), BUDGET)
    return packed.select("query_id", "used", F.array_join("kept", ",").alias("kept"))


@query(S_PLAIN + """SELECT query_id, source_number::INTEGER AS source_number, '[' || source_number || '] ' || min(title) || ' (arXiv:' || min(paper_id) || ') — ' || string_agg(DISTINCT array_to_string(section_path, ' > '), '; ') || chr(10) || '    https://arxiv.org/abs/' || min(paper_id) AS line FROM ev GROUP BY query_id, source_number""")
def format_sources(spark, sf):
    return evidence.format_sources(_plain_evidence(spark, sf)).select("query_id", F.col("source_number").cast("int").alias("source_number"), "line")


@query(r"""WITH a AS (SELECT conv_id, turn, text || ' [' || turn % 4 || ']' || CASE WHEN conv_id % 2 = 0 THEN ' [01]' ELSE '' END AS t FROM conversations),
c AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: x::INTEGER)) AS cited FROM a)
SELECT conv_id, turn, len(cited) AS n_cited, len(cited) > 0 AND len(list_filter(cited, lambda x: x NOT IN (1, 2))) = 0 AS valid FROM c""")
def citation_check(spark, sf):
    answer = F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("]"), F.when(F.col("conv_id") % 2 == 0, " [01]").otherwise(""))
    c = table(spark, sf, "conversations").withColumn("t", answer)
    return c.select("conv_id", "turn", F.size(T.cited_numbers(F.col("t"))).cast("long").alias("n_cited"), T.has_valid_citations(F.col("t"), F.array(F.lit(1), F.lit(2))).alias("valid"))


S_EVAL = S_PAIRS.format(k=40) + """, good AS (SELECT label::VARCHAR AS label, list(DISTINCT vec_id) AS ids FROM embeddings JOIN labels ON vec_id = doc_id WHERE quality = 0 GROUP BY label),
t AS (SELECT v.vec_id AS query_id, coalesce(g.ids, []) AS ids FROM v LEFT JOIN good g USING (label)),
cand AS (SELECT h.query_id, h.chunk_id, h.rank, list_contains(t.ids, h.chunk_id) AS tgt, len(t.ids) AS n FROM hit h JOIN t USING (query_id)),
ks AS (SELECT unnest([1, 3, 5, 10, 20, 40]) AS k),
m AS (SELECT t.query_id, k, len(t.ids) AS n, count(*) FILTER (WHERE rank <= k AND tgt) AS f, count(*) FILTER (WHERE rank <= k AND NOT tgt) AS o FROM t CROSS JOIN ks LEFT JOIN cand c ON c.query_id = t.query_id GROUP BY t.query_id, k, t.ids),
pq AS (SELECT query_id, k, n AS n_targets, CASE WHEN n = 0 THEN 0 ELSE f / n::DOUBLE END AS recall, CASE WHEN n = 0 THEN 0 ELSE f / k::DOUBLE END AS "precision", CASE WHEN n > 0 AND f > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, o AS non_target FROM m)
"""


@query(S_EVAL + 'SELECT query_id, k, n_targets::INTEGER AS n_targets, round(recall, 6) AS recall, round("precision", 6) AS "precision", hit, non_target FROM pq')
def retrieval_metrics_query(spark, sf):
    q, c, targets = labelled(spark, sf)
    return metrics.query_metrics(q, c, targets=targets).select("query_id", "k", "n_targets", r6("recall"), r6("precision"), "hit", "non_target")


@query(S_EVAL + """SELECT k, count(*) AS n_queries, count(*) FILTER (WHERE n_targets = 0) AS n_without_targets, round(coalesce(avg(recall) FILTER (WHERE n_targets > 0), 0), 6) AS mean_recall, round(coalesce(avg("precision") FILTER (WHERE n_targets > 0), 0), 6) AS mean_precision,
round(coalesce(avg(hit) FILTER (WHERE n_targets > 0), 0), 6) AS mean_hit, round(coalesce(avg(non_target) FILTER (WHERE n_targets = 0), 0), 6) AS mean_non_target FROM pq GROUP BY k""")
def retrieval_metrics_agg(spark, sf):
    q, c, targets = labelled(spark, sf)
    a = metrics.aggregate_metrics(metrics.query_metrics(q, c, targets=targets))
    return a.select("k", "n_queries", "n_without_targets", r6("mean_recall"), r6("mean_precision"), r6("mean_hit"), r6("mean_non_target"))


@query(S_EVAL + """SELECT t.query_id, round(coalesce(1 / min(c.rank)::DOUBLE, 0), 6) AS mrr, min(c.rank)::INTEGER AS first_rank, round(coalesce(sum(i / c.rank::DOUBLE) / len(t.ids), 0), 6) AS average_precision
FROM t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM cand WHERE tgt) c USING (query_id) GROUP BY t.query_id, t.ids""")
def average_precision(spark, sf):
    q, c, targets = labelled(spark, sf)
    return metrics.rank_metrics(q, c, targets).select("query_id", r6("mrr"), F.col("first_rank").cast("int").alias("first_rank"), r6("average_precision"))


@query(r"""SELECT page_id, (100 * (contains(html, '\documentclass'))::INT + 100 * contains(html, '\begin{document}')::INT + 20 * contains(html, '\title')::INT + 20 * (contains(html, '\begin{abstract}') OR contains(html, '\abstract{'))::INT + 5 * len(regexp_extract_all(html, '\\(?:section|subsection|subsubsection|paragraph)\*?\{'))
+ CASE WHEN n IN ('main.tex', 'paper.tex', 'ms.tex', 'article.tex') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(n, 'author|package|definition|macro') THEN 30 ELSE 0 END)::INTEGER AS score
FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '\documentclass{a} \titlepage \section{y}\subsection*{z}\paragraph{p}\section[s]{t}' ELSE '' END AS html, CASE WHEN page_id % 2 = 0 THEN 'main.tex' ELSE 'macros.tex' END AS n FROM pages)""")
def main_tex_score(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat("html", F.when(F.col("page_id") % 3 == 0, r"\documentclass{a} \titlepage \section{y}\subsection*{z}\paragraph{p}\section[s]{t}").otherwise("")).alias("content"), F.when(F.col("page_id") % 2 == 0, "src/main.tex").otherwise("src/macros.tex").alias("path"))
    return p.select("page_id", tex.main_score(F.col("path"), F.col("content")).alias("score"))


@query(r"""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '.' || lpad(p_size::VARCHAR, 5, '0') WHEN p_size % 3 = 1 THEN 'hep-ph/' || lpad((p_partkey % 10000000)::VARCHAR, 7, '0') || 'v2' ELSE p_name END AS eprint, CASE WHEN p_size % 5 = 0 THEN 'other' WHEN p_size % 5 = 1 THEN 'arXiv' END AS prefix FROM part)
SELECT p_partkey, eprint AS arxiv_id, replace(eprint, '/', '_') AS safe FROM e WHERE (prefix IS NULL OR lower(prefix) = 'arxiv') AND regexp_matches(eprint, '^(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?$')""")
def arxiv_id_filter(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    eprint = F.when(s % 3 == 0, F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(s.cast("string"), 5, "0"))).when(s % 3 == 1, F.concat(F.lit("hep-ph/"), F.lpad((k % 10000000).cast("string"), 7, "0"), F.lit("v2"))).otherwise(F.col("p_name"))
    prefix = F.when(s % 5 == 0, "other").when(s % 5 == 1, "arXiv")
    rows = table(spark, sf, "part").select("p_partkey", T.arxiv_id(eprint, prefix).alias("arxiv_id"))
    return rows.where("arxiv_id IS NOT NULL").withColumn("safe", T.safe_id(F.col("arxiv_id")))


@query(r"""SELECT doc_id, pos::INTEGER AS pos, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, source FROM documents) WHERE len(regexp_extract_all(text, '\S+')) >= 8 AND NOT regexp_full_match(lower(source), 'acknowledge?ments?|the .+ collaboration')""")
def useful_paragraphs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.where(T.is_useful_paragraph(F.col("text")) & T.is_retrieval_section(F.array("source"))).select("doc_id", "pos", "text")


@query("""SELECT o_orderkey, o_totalprice AS a, (o_custkey / 7.0)::DOUBLE AS b FROM orders""")
def rerank_scores_parsed(spark, sf):
    o = table(spark, sf, "orders").withColumn("b", F.col("o_custkey") / F.lit(7.0))
    body = F.concat(F.lit('{"data": [{"index": 1, "score": '), F.col("b").cast("string"), F.lit('}, {"corpus_id": 0, "relevance_score": '), F.col("o_totalprice").cast("string"), F.lit("}]}"))
    s = ranking.parse_scores(body, F.lit(2))
    return o.select("o_orderkey", F.get(s, F.lit(0)).alias("a"), F.get(s, F.lit(1)).alias("b"))


@query("SELECT 'article' AS entry_type, 'k' || doc_id AS key, trim(regexp_replace(replace(replace(replace(replace(source, '{', ''), '}', ''), '\"', ''), '\\', ''), '\\s+', ' ', 'g')) AS title, n_chars::VARCHAR AS year FROM documents")
def bibtex_entries(spark, sf):
    """Every document as an entry, written out and parsed again."""
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("@comment{x}\n@Article{k"), F.col("doc_id").cast("string"), F.lit(", Title = {"), F.regexp_replace("source", r'[{}"\\]', ""), F.lit('},\n year="'), F.col("n_chars").cast("string"), F.lit('"}'))
    e = bibtex.read_bibliography(d.select(text.alias("value")))
    return e.select("entry_type", "key", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"))


@query("SELECT 'k' || c_custkey AS bib_key, 'Top > ' || c_mktsegment AS paths FROM customer")
def category_paths(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("\\begin{itemize}\n\\item \\textbf{Top}.\n\\begin{itemize}\n\\item "), F.col("c_mktsegment"), F.lit("~\\cite{k"), F.col("c_custkey").cast("string"), F.lit("}\n\\textit{about}\n\\end{itemize}\n\\end{itemize}")).alias("value"))
    return categories.paths_by_key(categories.read_categories(c)).select("bib_key", F.array_join(F.transform("living_review_categories", T.join_path), "; ").alias("paths"))


def document_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a source of one file."""
    d = table(spark, sf, "documents")
    source = F.concat(F.lit("\\documentclass{a}\n\\title{T "), F.col("source"), F.lit("}\n\\begin{document}\n\\section{"), F.col("lang"), F.lit("}\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\\end{document}"))
    return d.select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("main.tex").alias("path"), source.alias("content"))


@query()
def tex_papers(spark, sf):
    """Every document as a one-file source, parsed."""
    return tex.parse_papers(document_sources(spark, sf)).withColumn("section_path", T.join_path(F.col("section_path")))


@query()
def tex_papers_sql(spark, sf):
    """tex_papers by the table function, called from SQL; a test holds it against that query."""
    catalogue.register(spark)
    return spark.sql("SELECT * EXCEPT (section_path), array_join(section_path, ' > ') AS section_path FROM parse_tex(TABLE({files}))", files=tex.with_main(document_sources(spark, sf)))


def citing_papers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(texts, keys): parts and suppliers as papers; a part's text cites the suppliers that deliver it, the texts of suppliers below 1,000 cite a part each, the others have none."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    cites = lambda keys: F.concat(F.lit("as in \\cite{"), F.array_join(F.array_sort(F.collect_set(keys)), ", "), F.lit("} and \\citep[p. 3]{nowhere}"))
    parts = lines.groupBy(F.concat(F.lit("p"), "l_partkey").alias("paper_id")).agg(cites(F.concat(F.lit("key:s"), "l_suppkey")).alias("text"))
    suppliers = table(spark, sf, "supplier").groupBy(F.concat(F.lit("s"), "s_suppkey").alias("paper_id")).agg(cites(F.concat(F.lit("key:p"), F.col("s_suppkey") % 97 + 1)).alias("text"))
    texts = parts.unionByName(suppliers.where(F.length("paper_id") < 5))
    every = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("paper_id")).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("paper_id")))
    return texts, every.withColumn("bib_key", F.concat(F.lit("key:"), "paper_id"))


@query()
def citation_rank(spark, sf):
    """Ranks and counts in the citation graph of citing_papers; a test holds them against a plain loop."""
    texts, keys = citing_papers(spark, sf)
    with stored.run(spark) as own:
        edges = stored.stored(graph.citations(texts, keys), "citations")
        ranks = graph.citation_ranks(keys, edges, tolerance=1e-7)
        return stored.result(graph.citation_counts(keys, edges).join(ranks, "paper_id").select("paper_id", "cites", "cited", F.round("rank", 8).alias("rank")), own)


def reranker(max_length: int = 512) -> prompts.Prompting:
    import public_tokenizers

    return prompts.Prompting(public_tokenizers.path("byte_bpe_50k.json"), "stand-in", max_length)


@query()
def rerank_prompts(spark, sf):
    """The reranker's prompts for every benchmark item beside its five best documents by BM25: tokens, and whether the document was cut; a test holds them against a plain loop."""
    best = with_index(spark, sf, "simple", lambda index: text_index.bm25_search(benchmark_queries(spark, sf), index, 5, digits=6))
    h = best.join(benchmark_queries(spark, sf), "query_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    made = prompts.assemble(h, reranker())
    return made.select("query_id", "chunk_id", F.size("prompt_ids").alias("prompt_tokens"), "cut", F.sha2(F.array_join(F.col("prompt_ids").cast("array<string>"), ","), 256).alias("prompt_sha256"))
