"""Exact top-k over a table with extra columns whose names the operator uses itself."""

from paperlane.llm import topk


def test_extra_columns(spark):
    rows = [(i, [i % 5 / 64, 1 / 64], 3.5, "x", i, 7, 8) for i in range(40)] + [(None, [1.0, 1.0], 0.0, "y", 1, 1, 1), (90, None, 0.0, "y", 1, 1, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, ids string, rank long, q_block int, dim int")
    own = topk.integer_vectors(table)
    assert own.columns == ["id", "v"]
    got = topk.top_k(own.where("id < 2"), own, k=3).collect()
    want = {q: sorted(((q % 5) * (i % 5) + 1, -i) for i in range(40) if i != q)[::-1][:3] for q in (0, 1)}
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(q, n + 1, -i, s) for q in (0, 1) for n, (s, i) in enumerate(want[q])]
