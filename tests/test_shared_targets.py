"""Metrics of queries that share targets: the same figures as with a list for each query, without such lists."""

from paperlane import queries
from paperlane.operators import metrics


def test_shared_targets_give_the_same_figures(spark):
    groups = {"a": ["p1", "p2", "p3"], "b": ["p9"]}
    of = {0: "a", 1: "a", 2: "b", 3: "none", 4: None}
    found = spark.createDataFrame([(q, p, n) for q in of for n, p in enumerate(["p2", "p5", "p1", "p9"][q % 3 :], 1)], "query_id int, paper_id string, paper_rank int")
    shared = spark.createDataFrame(list(of.items()), "query_id int, target_group string")
    targets = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in [*ps, ps[0]]], "target_group string, paper_id string")
    own = spark.createDataFrame([(q, groups.get(g, [])) for q, g in of.items()], "query_id int, relevant_paper_ids array<string>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(metrics.query_metrics(shared, found, (1, 2, 4), targets)) == rows(metrics.query_metrics(own, found, (1, 2, 4)))
    assert rows(metrics.rank_metrics(shared, found, targets)) == rows(metrics.rank_metrics(own, found).drop("missing"))


def test_no_list_of_targets_for_each_query(spark):
    for one in (queries.retrieval_metrics_query, queries.retrieval_metrics_agg, queries.average_precision):
        plan = one(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "explode" not in plan
