"""Evidence: only the lines near a hit are passed on to its queries, and texts are sent by query once."""

from tests.test_index_shuffles import sent

from paperlane.operators import evidence


def test_lines_far_from_hits_are_not_sent(spark):
    lines = [(f"p{p}", f"t{p}", ["S"], n, f"p{p}:{n}", "abstract" if n == 0 else "paragraph", f"line {n} of {p}") for p in range(20) for n in range(150)]
    chunks = spark.createDataFrame(lines, "paper_id string, title string, section_path array<string>, chunk_index int, chunk_id string, chunk_type string, text string").cache()
    hits = [(q, f"p{(q * 7 + r) % 20}", 60 + r, r + 1, f"p{(q * 7 + r) % 20}:{60 + r}") for q in range(200) for r in range(4)] + [(q, f"p{q * 7 % 20}", 62, 5, f"p{q * 7 % 20}:62") for q in range(200)]
    hits = spark.createDataFrame(hits, "query_id int, paper_id string, chunk_index int, rank int, chunk_id string").cache()
    chunks.count(), hits.count()
    before, key = sent(spark, "shuffleWriteRecords"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # as with tables too large to broadcast
    try:
        got = evidence.rank_evidence(hits, evidence.select_evidence(hits, chunks, 1)).collect()
    finally:
        spark.conf.unset(key)
    # 800 papers of queries have 120,000 lines in all, of which 4,200 are near a hit or abstracts.
    assert sent(spark, "shuffleWriteRecords") - before < 40_000
    want = {(q, f"p{(q * 7 + r) % 20}", r + 1, n) for q in range(200) for r in range(4) for n in {0, 59 + r, 60 + r, 61 + r} | ({61, 62, 63} if r == 0 else set())}
    assert len(got) == len(want) and {(g.query_id, g.paper_id, g.source_number, g.chunk_index) for g in got} == want
    first = sorted((g.position, g.chunk_index, g.hit_rank) for g in got if g.query_id == 3 and g.source_number == 1 and not g.is_abstract)
    assert first == [(1, 60, 1), (2, 62, 5), (3, 59, None), (4, 61, None), (5, 63, None)] and sum(g.is_abstract for g in got) == 800
