"""Blocks meet in a product of stored tables, so nothing is dealt many times; histograms hold only what may matter."""

import numpy as np

from paperlane.llm import topk


def test_blocks_are_not_dealt(spark, monkeypatch):
    plans, cut = {}, topk.cut

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, tag)

    monkeypatch.setattr(topk, "cut", noted)
    monkeypatch.setattr(topk, "TASK_QUERIES", 2)
    m = np.random.default_rng(3).integers(-4, 5, (90, 5)).astype(float)
    m[40:] = m[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = topk.top_k(df.where("id % 5 = 0"), df, 6, query_block=3, row_block=7).collect()
    want = [(q, n + 1, i, int(m[i] @ m[q])) for q in range(0, 90, 5) for n, i in enumerate(sorted((i for i in range(90) if i != q), key=lambda i: (-(m[i] @ m[q]), i))[:6])]
    assert sorted(map(tuple, got)) == want
    for tag in ("histograms", "winners"):
        assert "CartesianProduct" in plans[tag]


def test_a_task_sends_the_bins_that_may_hold_the_kth():
    counts = np.array([[5, 0, 3, 2, 1], [9, 1, 0, 0, 0], [0, 0, 0, 0, 7]])
    assert topk._needed(counts, 3).tolist() == [[False, False, False, True, True], [True, True, False, False, False], [False, False, False, False, True]]
    assert topk._needed(counts, 4).tolist()[0] == [False, False, True, True, True]
