"""Expectations of the engine on small inputs."""

import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlane.functions import text as T
from paperlane.functions.porter import stem
from paperlane.operators import chunking, embedding, evidence, lexical, metrics, ranking, vector
from paperlane.plans import config, pipelines
from paperlane.sources import bibtex, categories, files, tex
from paperlane.streaming import ingest


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_sentences_are_packed_and_long_ones_stay_whole(spark):
    assert column(spark, "A b. C d. E f g h i j. K", lambda c: T.pack_sentences(c, 4)) == ["A b. C d.", "E f g h i j.", "K"]
    assert column(spark, "   ", lambda c: T.pack_sentences(c, 4)) == []


def test_chunks(spark):
    long = "Word word word. " * 300
    rows = [("p", 0, "abstract", ["Abstract"], "short text", "p:a"), ("p", 1, "paragraph", ["One"], long, "p:1"), ("p", 2, "paragraph", ["One"], long + "$$x$$", "p:2")]
    df = spark.createDataFrame(rows, "paper_id string, pos int, kind string, section_path array<string>, text string, paragraph_id string")
    got = chunking.chunk_paragraphs(df).orderBy("chunk_index").collect()
    assert [r.token_count for r in got] == [2, 600, 300, 901]
    assert [r.chunk_index for r in got] == [0, 1, 2, 3]
    assert got[0].chunk_id.startswith("p:chunk:00000:") and len(got[0].chunk_id) == 26


def test_renderings(spark):
    df = spark.createDataFrame([("T", ["A", "B"], [["x", "y"], ["z"]], "body"), (None, None, None, "body")], "t string, p array<string>, c array<array<string>>, b string")
    cols = [F.col(c) for c in "tpcb"]
    assert [r[0] for r in df.select(T.render_dense(*cols)).collect()] == ["Title: T\nSection: A > B\nLiving Review categories: x > y; z\n\nbody", "body"]
    assert [r[0] for r in df.select(T.render_lexical(*cols)).collect()] == ["T\nA > B\nx > y\nz\nbody", "body"]


def test_arxiv_ids(spark):
    df = spark.createDataFrame([("2101.00001v2", None), ("hep-ph/9901234", "arXiv"), ("2101.00001", "other"), ("x", None)], "e string, p string")
    assert [r[0] for r in df.select(T.arxiv_id(F.col("e"), F.col("p"))).collect()] == ["2101.00001v2", "hep-ph/9901234", None, None]


def test_citations(spark):
    allowed = F.array(F.lit(1), F.lit(2))
    assert [column(spark, a, lambda c: T.has_valid_citations(c, allowed)) for a in ("a [1]", "none", "a [3]", "a [01]", "[1, 2]")] == [True, False, False, True, False]


def test_bibtex():
    text = '@comment{no}\n@Article{k1, title = {A {Nested}  one}, Year="2020", eprint={2101.00001}, year = 2021}\n@misc(k2, note={x})'
    got = list(bibtex.parse_entries(text))
    assert [(t, k, f) for t, k, f, _ in got] == [("article", "k1", {"title": "A {Nested} one", "year": "2021", "eprint": "2101.00001"}), ("misc", "k2", {"note": "x"})]
    with pytest.raises(ValueError):
        list(bibtex.parse_entries("@article{k, title={x}"))


def test_categories(spark):
    text = "\\begin{itemize}\n\\item \\textbf{Top}\n\\begin{itemize}\n% \\item \\textbf{Not}~\\cite{z}\n\\item \\textbf{Sub}~\\cite{a,b}\n\\textit{about \\& more}\n\\item \\textbf{Other}~\\cite{a}\n\\end{itemize}\n\\end{itemize}"
    df = categories.read_categories(spark.createDataFrame([(text,)], "value string"))
    got = {r.bib_key: r.living_review_categories for r in categories.paths_by_key(df).collect()}
    assert got == {"a": [["Top", "Sub"], ["Top", "Other"]], "b": [["Top", "Sub"]]}
    assert [(r.path, r.description) for r in df.where("kind = 'description'").collect()] == [(["Top", "Sub"], "about & more")]


TREE = {
    "src/main.tex": "\\documentclass{article}\n\\title{The Title}\n\\begin{document}\n\\begin{abstract}A short abstract~here.\\end{abstract}\n\\section{Intro}\nOne two three four five six seven eight \\cite{k}. % gone\n\n% \\input{hidden}\n\\input{part}\n\\section*{Acknowledgments}\nWe thank all of the people who helped us here a lot.\n\\bibliography{x}\nnot this text that is after the end of all\n\\end{document}",
    "src/part.tex": "\\subsection{Sub {nested}}\nBefore the math we have some words\n\\begin{equation}\na=b \\label{e}\n\nc\n\\end{equation}\nand after it.\n\n\\begin{figure}\\caption{A {braced} caption}\\end{figure}\ntoo short\n\n\\singlefigure{a}{b}{Macro caption}{d}",
    "src/hidden.tex": "Hidden words that should never be seen in any of the paragraphs.",
}


def test_papers(spark):
    rows = [("p", k, v) for k, v in TREE.items()] + [("q", "readme.txt", "none")]
    got = tex.parse_papers(spark.createDataFrame(rows, "paper_id string, path string, content string")).orderBy("paper_id", "pos").collect()
    assert [(r.kind, r.section_path, r.text) for r in got if r.paper_id == "p"] == [
        ("abstract", ["Abstract"], "A short abstract here."),
        ("paragraph", ["Intro"], "One two three four five six seven eight \\cite{k}."),
        ("paragraph", ["Intro", "Sub {nested}"], "Before the math we have some words\n\\begin{equation}\na=b\nc\n\\end{equation}\nand after it. too short"),
        ("caption", ["Intro", "Sub {nested}"], "A {braced} caption"),
        ("caption", ["Intro", "Sub {nested}"], "Macro caption"),
    ]
    assert got[0].title == "The Title" and got[0].main_tex_path == "src/main.tex"
    assert [r.error for r in got if r.paper_id == "q"] == ["ValueError: no TeX file"]


def test_sources(spark):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for name in ("a.tex", "../b.tex"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    df = spark.createDataFrame([("p", bytearray(buffer.getvalue())), ("q", bytearray(b"%PDF-1")), ("r", bytearray(b"plain"))], "paper_id string, content binary")
    assert [r[0] for r in df.select(files.source_kind(F.col("content"))).collect()] == ["tar", "pdf", "tex"]
    got = files.unpack(df).collect()
    assert [(r.paper_id, r.path) for r in got] == [("p", None), ("r", "main.tex")] and "unsafe" in got[0].error


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, row_index int"), spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "chunk_id string, row_index int")
    assert sorted(map(tuple, files.upsert(old, new, unique="row_index").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    with pytest.raises(Exception, match="row_index repeats"):
        files.upsert(old, spark.createDataFrame([("d", 1)], old.schema), unique="row_index").collect()


def test_missing_chunk_is_refused(spark):
    rows = spark.createDataFrame([("x", 0)], "chunk_id string, row_index int")
    with pytest.raises(Exception, match="no chunk x"):
        files.join_vectors(rows, spark.createDataFrame([("y", 0, "t")], "chunk_id string, chunk_index int, text string")).collect()


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "formalize": "formal", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "oscillators": "oscil"}
    assert {w: stem(w) for w in pairs} == pairs


def test_web_queries(spark):
    docs = spark.createDataFrame([(1, "the red fox jumps"), (2, "a fox that is red"), (3, "blue fox")], "chunk_id int, search_document string")
    find = lambda q, **k: sorted(r[0] for r in lexical.web_match(docs, q, **k).collect())
    assert find('"red fox"') == [1]
    assert find("red or blue") == [1, 2, 3]
    assert find("fox -red") == [3]
    assert find("jumping fox", analyser="english") == [1]
    assert find("") == []


def test_cover_rank_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.randint(1, 25)))) for i in range(60)]
    queries = [(q, " ".join(rng.sample("abcdef", rng.randint(1, 3)))) for q in range(8)]
    found = lexical.lexical_search(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(docs, "chunk_id int, search_document string"), 1000)
    got = {(r.query_id, r.chunk_id): r.lexical_score for r in found.collect()}

    def brute(terms, words):
        at = [i for i, w in enumerate(words) if w in terms]
        spans = [(i, j) for i in at for j in at if i <= j and terms <= set(words[i : j + 1])]
        covers = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
        return sum(0.1 / (1 + sum(w not in terms for w in words[i : j + 1])) for i, j in covers)

    want = {(q, d): s for q, t in queries for d, x in docs if (s := brute(set(t.split()), x.split()))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_keeps_ids_of_both_pools(spark):
    v = spark.createDataFrame([(0, "a", 0.9, 1), (0, "b", 0.8, 2)], "query_id int, chunk_id string, vector_score double, rank int")
    x = spark.createDataFrame([(0, "b", 3.0, 1), (0, "c", 1.0, 2)], "query_id int, chunk_id string, lexical_score double, rank int")
    got = ranking.fuse(v, x, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[1].lexical_score is None
    assert abs(got[0].rrf_score - (1 / 62 + 1 / 61)) < 1e-12
    with pytest.raises(ValueError):
        ranking.fuse(v, x, 0)


def test_diversify_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(q, r, f"p{rng.randint(0, 4)}") for q in range(5) for r in range(1, 21)]
    got = ranking.diversify(spark.createDataFrame(rows, "query_id int, rank int, paper_id string").withColumn("old", F.col("rank")), 6, 2).collect()
    for q in range(5):
        taken = []
        for _, r, p in [x for x in rows if x[0] == q]:
            if sum(t[1] == p for t in taken) < 2 and len(taken) < 6:
                taken.append((r, p))
        assert sorted((g.rank, g.old) for g in got if g.query_id == q) == [(n, r) for n, (r, _) in enumerate(taken, 1)]


def test_rerank(spark):
    hits = spark.createDataFrame([(0, "q w", 1, "x", 0.9), (0, "q w", 2, "q w", 0.1), (0, "q w", 3, "x", 0.5)], "query_id int, query string, rank int, text string, final_score double")
    assert [(r.text, r.rank) for r in ranking.rerank(hits, ranking.OverlapScorer()).orderBy("rank").collect()] == [("q w", 1), ("x", 2), ("x", 3)]
    with pytest.raises(Exception, match="empty"):
        ranking.rerank(hits.withColumn("query", F.lit(" ")), ranking.OverlapScorer()).collect()


def test_scores_of_a_service(spark):
    parse = lambda b, n: column(spark, b, lambda c: ranking.parse_scores(c, F.lit(n)))
    assert parse('{"results":[{"index":1,"relevance_score":-2},{"index":0,"relevance_score":1}]}', 2) == [1.0, -2.0]
    assert parse('{"data":[{"score":3},{"score":4}]}', 2) == [3.0, 4.0]
    assert parse('{"data":[{"index":0,"score":3}]}', 2) is None


def test_metrics(spark):
    q = spark.createDataFrame([("q", ["a", "c"]), ("n", [])], "query_id string, relevant_paper_ids array<string>")
    c = spark.createDataFrame([("q", p, i) for i, p in enumerate("abc", 1)] + [("n", "a", 1)], "query_id string, paper_id string, paper_rank int")
    per = metrics.query_metrics(q, c, (1, 2, 3))
    got = {r.k: (r.recall, round(r.precision, 3), r.hit, r.non_target) for r in per.where("query_id = 'q'").collect()}
    assert got == {1: (0.5, 1.0, 1.0, 0), 2: (0.5, 0.5, 1.0, 1), 3: (1.0, 0.667, 1.0, 1)}
    ranks = {r.query_id: r for r in metrics.rank_metrics(q, c).collect()}
    assert ranks["q"].mrr == 1 and abs(ranks["q"].average_precision - (1 + 2 / 3) / 2) < 1e-12 and ranks["n"].average_precision == 0
    by_k = metrics.aggregate_metrics(per).orderBy("k").collect()
    assert by_k[0].mean_recall == 0.5 and by_k[0].mean_non_target == 1 and by_k[0].n_without_targets == 1
    assert "| 1 | 0.5000 | 1.0000 | 1.0000 | 1.00 |" in metrics.render_markdown(by_k, "R", (1.0, 1.0), [])


def test_configs():
    with pytest.raises(ValueError):
        config.RetrievalConfig(mode="x")
    with pytest.raises(ValueError):
        config.RetrievalConfig(candidate_k=0)
    with pytest.raises(ValueError):
        config.RetrievalConfig(probes=3)
    with pytest.raises(ValueError):
        config.valid_identifier("1x")
    assert config.redact_url("postgresql://u:p@h:1/d") == "postgresql://***@h:1/d"
    assert config.ServiceConfig.from_artifact(json.dumps({"model": "m", "x": 1})).model == "m"


def index_of(spark):
    rows = [(f"p{i}", i, n, "abstract" if n == 0 else "paragraph", f"{w} topic number {n} with words") for i, w in enumerate(("alpha", "beta", "gamma")) for n in range(4)]
    df = spark.createDataFrame(rows, "paper_id string, i int, chunk_index int, chunk_type string, text string")
    empty = F.array().cast("array<array<string>>")
    df = df.select("paper_id", "chunk_index", "chunk_type", "text", F.format_string("%s-%d", "paper_id", "chunk_index").alias("chunk_id"), F.lit("T").alias("title"), F.array(F.lit("S")).alias("section_path"), empty.alias("living_review_categories"), T.count_words(F.col("text")).cast("int").alias("token_count"), F.lit("u").alias("source_url"))
    return pipelines.index_chunks(df, embedding.HashingEmbedder(32))


def test_ask_and_evaluate(spark):
    index = index_of(spark).cache()
    questions = spark.createDataFrame([("q1", "alpha topic"), ("q2", "gamma topic")], "query_id string, query string")
    got = {r.query_id: r for r in pipelines.ask(questions, index, embedding.HashingEmbedder(32), ranking.OverlapScorer(), evidence.ExtractiveGenerator()).collect()}
    assert got["q1"].valid and got["q1"].context.startswith("[SOURCE 1]\nPaper: T\narXiv: p0\nAbstract:\nalpha topic")
    assert "https://arxiv.org/abs/p2" in got["q2"].sources
    labelled = questions.withColumn("relevant_paper_ids", F.when(F.col("query_id") == "q1", F.array(F.lit("p0"))).otherwise(F.array(F.lit("p2"))))
    embedded = embedding.embed_queries(labelled, embedding.HashingEmbedder(32), prompt="")
    for mode in config.MODES:
        settings = config.EvalConfig(retrieval=config.RetrievalConfig(mode=mode, candidate_k=20))
        _, per, ranks = pipelines.evaluate(embedded, index, settings)
        assert [r.hit for r in per.where("k = 1").collect()] == [1.0, 1.0] and all(r.mrr == 1 for r in ranks.collect())


def test_budget(spark):
    rows = [(0, 1, "p", "T", False, 1, "a", ["S"], "x" * 1600), (0, 1, "p", "T", False, 2, "b", ["S"], "x" * 700), (0, 1, "p", "T", True, None, "c", ["Abstract"], "abs")]
    ranked = spark.createDataFrame(rows, "query_id int, source_number int, paper_id string, title string, is_abstract boolean, position int, chunk_id string, section_path array<string>, text string")
    assert evidence.pack_context(ranked, 500).first().kept == ["a"] and evidence.pack_context(ranked, 800).first().kept == ["a", "b"]
    with pytest.raises(ValueError):
        evidence.pack_context(ranked, 499)
    with pytest.raises(Exception, match="abstracts"):
        evidence.pack_context(ranked.withColumn("text", F.when(F.col("is_abstract"), F.repeat("text", 2000)).otherwise(F.col("text"))), 500).collect()


def test_probing_finds_most_neighbours(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(m)], "chunk_id int, embedding array<double>")
    q = df.where("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    cells = vector.fit_cells(df, 8)
    pairs = lambda x: {(r.query_id, r.chunk_id) for r in x.collect()}
    exact, near = pairs(vector.vector_search(q, df, 5)), pairs(vector.probe_search(q, vector.assign_cells(df, cells), cells, 5, 4))
    assert len(exact & near) >= 0.9 * len(exact)
    assert pairs(vector.top_by(df.crossJoin(q).select("query_id", "chunk_id", T.inner_product(F.col("embedding"), F.col("query_embedding")).alias("s")), 5, F.col("s").desc(), "chunk_id")) == exact


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    row = {"chunk_id": "a", "paper_id": "p", "title": "T", "section_path": ["S"], "living_review_categories": [], "chunk_index": 0, "chunk_type": "paragraph", "text": "one", "token_count": 1, "paragraph_ids": []}
    for n, text in enumerate(("one", "two")):
        (source / f"{n}.json").write_text(json.dumps(row | {"text": text}) + "\n" + json.dumps(row | {"chunk_id": f"x{n}"}) + "\n")
        ingest.stream_chunks(spark, str(source), str(store), str(tmp_path / "ck"), embedding.HashingEmbedder(8)).awaitTermination()
    got = {r.chunk_id: r.text for r in spark.read.parquet(f"{store}/v=2").collect()}
    assert got == {"a": "two", "x0": "one", "x1": "one"}
