"""Prompts, data sources, the delta table, the catalogue: against plain loops, and what they refuse."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperlane import queries
from paperlane.operators import embedding, prompts
from paperlane.plans import catalogue
from paperlane.sources import connectors, files, tex
from paperlane.streaming import deltas

SF = "/root/testdata/sf0.001"


def test_prompts_equal_a_plain_loop(spark):
    own, texts = queries.reranker(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.query_id: r.query for r in queries.benchmark_queries(spark, SF).collect()}
    tokenizer = Tokenizer.from_file(own.tokenizer)
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    got, cuts = queries.rerank_prompts(spark, SF).collect(), set()
    for r in got:
        body = ids(f"{prompts.PREFIX}<Instruct>: {prompts.INSTRUCTION}\n\n<Query>: {asked[r.query_id]}\n\n<Document>: {texts[r.chunk_id]}")
        want = body[: own.max_length - len(ids(prompts.SUFFIX))] + ids(prompts.SUFFIX)
        assert (r.prompt_tokens, r.cut) == (len(want), len(want) < len(body) + len(ids(prompts.SUFFIX)))
        cuts.add(r.cut)
    assert len(got) > 100 and cuts == {True, False}


def test_requests_are_checked(spark):
    own = queries.reranker()
    rows = spark.createDataFrame([(1, 1, "q", "d " * 500, 0.5), (1, 2, "q", None, 0.5), (1, 3, "q", "e", 0.9), (2, 1, "x", "y", 0.1)], "query_id int, rank int, query string, text string, rerank_score double")
    made = prompts.assemble(rows, own, requested=150).cache()
    assert sorted(len(r.prompt_ids) for r in made.collect())[-1] == 150 and {r.query_id: r.prompt_tokens for r in prompts.usage(made).collect()}[2] < 150
    assert [(r.total_tokens - r.prompt_tokens) for r in prompts.usage(made).orderBy("query_id").collect()] == [3, 1]
    end = own.tokens(own.suffix)
    assert all(r.prompt_ids[-len(end) :] == end for r in made.collect())
    assert sorted((r.query_id, r["rank"], r.text) for r in prompts.ranked(rows, 1).collect()) == [(1, 1, "e"), (2, 1, "y")]
    assert [r.text for r in prompts.ranked(rows.where("query_id = 1")).orderBy("rank").collect()] == ["e", "d " * 500, None]
    with pytest.raises(Exception, match="top_n exceeds"):
        prompts.ranked(rows, 2).collect()
    for bad in (lambda: prompts.ranked(rows, 0), lambda: prompts.check_request(own, top_n=0), lambda: prompts.check_request(own, "other"), lambda: own.room(len(end)), lambda: own.room(0)):
        with pytest.raises(ValueError):
            bad()
    prompts.check_request(own, "stand-in", 3)
    with pytest.raises(Exception, match="must not be empty"):
        prompts.assemble(rows.withColumn("query", F.lit(" ")), own).collect()


def archive(path, *names):
    with tarfile.open(path, "w:gz") as t:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 5
            t.addfile(info, io.BytesIO(b"hello"))


def test_archives_as_batch_and_stream(spark, tmp_path):
    connectors.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    archive(folder / "a1.tar.gz", "main.tex", "part.tex")
    archive(folder / "b2.tar.gz", "../out.tex")
    (folder / "c3.tex").write_text("plain")
    (folder / "_hidden").write_text("x")
    read = spark.read.format("source_archives").option("partitionBytes", "1").load(str(folder))
    assert read.rdd.getNumPartitions() == 3
    assert sorted((r.paper_id, r.path or "", (r.error or "")[:17]) for r in read.collect()) == [("a1", "main.tex", ""), ("a1", "part.tex", ""), ("b2", "", "ValueError: unsaf"), ("c3", "main.tex", "")]
    one = spark.read.format("source_archives").load(f"file://{folder}")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 4

    def more():
        stream = spark.readStream.format("source_archives").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        stream.trigger(once=True).start().awaitTermination()
        return sorted((r.paper_id, r.path) for r in spark.read.parquet(str(tmp_path / "out")).where("path IS NOT NULL").collect())

    first = more()
    assert first == [("a1", "main.tex"), ("a1", "part.tex"), ("c3", "main.tex")] == more()
    archive(folder / "a0.tar.gz", "new.tex")
    assert more() == [("a0", "new.tex"), *first]


def test_matrices(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(9000, 6)).astype(np.float32)
    np.save(tmp_path / "embeddings.npy", m)
    write = lambda rows: (tmp_path / "rows.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    rows = [{"row_index": i, "chunk_id": f"c{i}"} for i in range(9000)]
    write(rows)
    connectors.register(spark)
    read = spark.read.format("npy_matrix").option("partitionBytes", 24 * 2500).load(str(tmp_path / "embeddings.npy"))
    assert read.rdd.getNumPartitions() == 4
    got = {r.chunk_id: r.embedding for r in connectors.read_matrix_rows(spark, str(tmp_path), "row_index long, chunk_id string").collect()}
    assert len(got) == 9000 and all(np.array_equal(np.float32(got[f"c{i}"]), m[i]) for i in range(0, 9000, 97))
    for bad in (rows[:-1], rows + rows[:1], rows[:-1] + [{"row_index": 9000, "chunk_id": "x"}]):
        write(bad)
        with pytest.raises(ValueError, match="indices"):
            connectors.read_matrix_rows(spark, str(tmp_path), "row_index long, chunk_id string")
    write(rows)
    (tmp_path / "config.json").write_text(json.dumps({"count": 9001, "dimension": 6}))
    with pytest.raises(ValueError, match="tells of 9001"):
        connectors.read_matrix_rows(spark, str(tmp_path), "row_index long, chunk_id string")
    whole = (tmp_path / "embeddings.npy").read_bytes()
    for name, data, why in (("cut", whole[:-4], "its header"), ("no", b"nothing at all", "no .npy")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match=why):
            connectors.Header.read(str(tmp_path / name))
    np.save(tmp_path / "line.npy", np.zeros(3))
    with pytest.raises(ValueError, match="row by row"):
        connectors.Header.read(str(tmp_path / "line.npy"))


CHUNK = {"chunk_id": "a", "paper_id": "p", "title": "T", "section_path": ["S"], "living_review_categories": [], "chunk_index": 0, "chunk_type": "paragraph", "text": "one", "token_count": 1, "paragraph_ids": []}


def test_deltas_write_what_is_new(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    sizes = lambda kind: deltas._versions(spark, store, kind)
    for n, texts in enumerate(([("big%d" % i, "word " * 200) for i in range(300)], [("a", "one"), ("b", "one")], [("a", "two"), ("c", "one")])):
        (source / f"{n}.json").write_text("".join(json.dumps(CHUNK | {"chunk_id": c, "text": t}) + "\n" for c, t in texts))
        deltas.stream_deltas(spark, str(source), store, str(tmp_path / "ck"), embedding.HashingEmbedder(8), share=0.9).awaitTermination()
    got = {r.chunk_id: r.text for r in deltas.current(spark, store).collect()}
    assert len(got) == 303 and (got["a"], got["b"], got["c"]) == ("two", "one", "one")
    assert list(sizes("base")) == [0] and sorted(sizes("delta")) == [0, 1, 2]
    assert spark.read.parquet(f"{store}/delta/batch=2").count() == 2  # not the table
    # A batch that runs again, and one that breaks off, change nothing.
    again = spark.read.parquet(f"{store}/delta/batch=2").collect()
    deltas.write_delta(spark.createDataFrame(again + again, spark.read.parquet(f"{store}/delta/batch=2").schema), store, 2)
    (tmp_path / "store/delta/batch=3").mkdir()
    assert {r.chunk_id: r.text for r in deltas.current(spark, store).collect()} == got
    assert not deltas.compact(spark, store, share=0.9) and deltas.compact(spark, store, share=0)
    deltas.vacuum(spark, store)
    assert list(sizes("base")) == [2] and not sizes("delta") and {r.chunk_id: r.text for r in deltas.current(spark, store).collect()} == got
    with pytest.raises(FileNotFoundError):
        deltas.current(spark, str(tmp_path / "none"))


def test_tex_table_function(spark):
    order = ["paper_id", "pos"]
    one, other = (f(spark, SF) for f in (queries.tex_papers, queries.tex_papers_sql))
    assert one.columns == [c for c in one.columns if c in other.columns]
    assert one.orderBy(order).collect() == other.select(one.columns).orderBy(order).collect()
    catalogue.register(spark)
    tree = [("p", "a.tex", "\\documentclass{x}\\begin{document}\\section{S}\\input{b}\\end{document}"), ("p", "b.tex", "one two three four five six seven eight nine"), ("q", "x.txt", "none")]
    spark.createDataFrame(tree, "paper_id string, path string, content string").createOrReplaceTempView("some_files")
    found = spark.sql("SELECT paper_id, text, error FROM parse_tex(TABLE(SELECT *, CASE paper_id WHEN 'p' THEN 'a.tex' END AS main_tex_path FROM some_files)) ORDER BY 1").collect()
    assert [(r.paper_id, r.text, r.error) for r in found] == [("p", "one two three four five six seven eight nine", None), ("q", None, "ValueError: no TeX file")]
    with pytest.raises(Exception, match="main_tex_path"):
        spark.sql("SELECT * FROM parse_tex(TABLE(some_files))")


def test_functions_in_sql(spark):
    catalogue.register(spark)
    catalogue.register(spark)
    row = spark.sql("SELECT lexical_tokens('The JETS, x1') AS t, english_stem('jumping') AS s, inner_product(array(1D, 2D), array(3D, 4D)) AS i, unit_vector(array(3D, 4D)) AS u, rrf(1) AS r, rrf(NULL) AS z").first()
    assert (row.t, row.s, row.i, row.u, row.r, row.z) == (["the", "jets", "x1"], "jump", 11.0, [0.6, 0.8], 1 / 61, 0.0)
    assert [(r.p, r.term) for r in spark.sql("SELECT * FROM token_positions('a B')").collect()] == [(1, "a"), (2, "b")]
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, round(r.lexical_score, 6))
    assert sorted(map(key, queries.bm25_sql(spark, SF).collect())) == sorted(map(key, queries.bm25_topk(spark, SF).collect()))


def test_unpacked_rows_are_those_of_the_operator(spark, tmp_path):
    archive(tmp_path / "a.tar.gz", "m.tex")
    content = (tmp_path / "a.tar.gz").read_bytes()
    plain = files.unpack(spark.createDataFrame([("a", bytearray(content))], "paper_id string, content binary")).collect()
    assert [tuple(r) for r in plain] == list(connectors.unpacked(str(tmp_path), (str(tmp_path / "a.tar.gz"),)))
    assert tex.PARSED.startswith("paper_id")
