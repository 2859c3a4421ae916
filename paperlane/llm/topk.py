"""Exact top-k search by distributed histogram selection.

Components x of a vector become floor(64 * x), x as double; the score is the integer inner product. Queries are cut into blocks,
which meet every block of candidates (a stated set of queries against all rows) in a product of the two stored tables, which moves nothing by shuffle. Everything is scored; each
query's scores go into a histogram over an interval that holds its k-th value, histograms are summed over all
blocks (a task sends no bins below that of its own k-th value, as the k-th of all cannot be lower), the bin with the k-th value becomes the next interval, and so on until the k-th value is exact. A last pass keeps
scores above it, and of those equal to it the smallest ids; a slice of SLICE candidates passes on k ties at most, as no more can be among
the k smallest ids, so thousands of equal vectors make no large group.

Vectors that are null, or hold a null or non-finite component, take no part; nor do rows without an id. A query does not meet
rows with its own id. If an id repeats among the queries, it counts once (the smallest vector); repeated candidates
are rows each. Vectors of differing lengths are compared with those of equal length only. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlane.llm.common import cut
from paperlane.plans.stored import over

SCALE, K, QUERY_BLOCK, ROW_BLOCK, BINS = 64, 20, 512, 4096, 256
#: Candidates scored at a time; blocks of queries whose histograms a task sums before it sends them on (a megabyte each); blocks of queries and of rows that a task is to meet.
SLICE, HELD, TASK_QUERIES, TASK_ROWS = 1024, 64, 16, 64


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v (array of whole doubles) of the rows that take part."""
    v = F.col(vec_col)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    good = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return table.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.when(good, scaled).alias("v"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """dim, ids (bytes of int64), data (bytes of float64), one row for each block; blocks end with their partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}

        def full(dim: int, rows: list) -> pd.DataFrame:
            ids, data = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<f8").reshape(len(rows), dim)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "data": [data.tobytes()], "norm": [float(np.sqrt((data * data).sum(axis=1)).max(initial=0))]})

        for batch in batches:
            for i, v in zip(batch.id, batch.v):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield full(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield full(dim, rows)

    return vectors.mapInPandas(run, "dim int, ids binary, data binary, norm double")


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole inner products. Doubles are exact below 2**53, floats below 2**24; beyond both, 64-bit integers are multiplied."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * q.shape[1]
    if bound < 1 << 24:
        return (q.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int32)
    if bound < 1 << 53:
        return (q @ rows.T).astype(np.int64)
    return q.astype(np.int64) @ rows.astype(np.int64).T


def _own_scores(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For SLICE candidates at a time: ids of queries and candidates, scores, and which scores count (not those of a query with itself)."""
    q_ids, every = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
    q, data = np.frombuffer(row.q_data, "<f8").reshape(len(q_ids), row.dim), np.frombuffer(row.data, "<f8").reshape(len(every), row.dim)
    for k in range(0, len(every), SLICE):
        ids = every[k : k + SLICE]
        yield q_ids, ids, _scores(q, data[k : k + SLICE]), q_ids[:, None] != ids[None, :]


def _needed(counts: np.ndarray, k: int) -> np.ndarray:
    """Which counts (bins upwards, the last: above the interval) may matter: not empty, and with fewer than k scores above their bin."""
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    return (counts > 0) & (above < k)


def _histograms(k: int):
    """For each query, how many scores are above its interval [low, low + BINS * width) and how many fall in each bin that may hold the k-th, over all the task's candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for q_block, (ids, flat) in held.items():
                q, b = np.nonzero(_needed(flat[:, 1:], k))
                yield pd.DataFrame({"q_block": q_block, "query_id": ids[q], "bin": b.astype(np.int32), "n": flat[:, 1:][q, b]})
            held.clear()

        for batch in batches:
            for row in batch.itertuples():
                low, width = np.frombuffer(row.low, "<i8")[:, None], np.frombuffer(row.width, "<i8")[:, None]
                if row.q_block not in held:
                    if len(held) == HELD:
                        yield from sent()
                    held[row.q_block] = np.frombuffer(row.q_ids, "<i8").copy(), np.zeros((len(low), BINS + 2), np.int64)
                flat = held[row.q_block][1]
                for q_ids, _, s, counts in _own_scores(row):
                    # Scores below the interval need no bin: most of them, from the second pass on.
                    q, c = np.nonzero((s >= low) & counts)
                    bins = np.minimum((s[q, c] - low[q, 0]) // width[q, 0], BINS) + 1
                    flat += np.bincount(bins + q * (BINS + 2), minlength=flat.size).reshape(flat.shape)
        yield from sent()

    return run


def _winners(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                low = np.frombuffer(row.low, "<i8")[:, None]
                for q_ids, ids, s, counts in _own_scores(row):
                    order = np.argsort(ids, kind="stable")
                    ids, s, counts = ids[order], s[:, order], counts[:, order]
                    tie = (s == low) & counts
                    q, c = np.nonzero((s > low) & counts | tie & (np.cumsum(tie, axis=1) <= k))
                    yield pd.DataFrame({"query_id": q_ids[q], "vec_id": ids[c], "score": s[q, c].astype(np.int64)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (id, v) of every query (id, v), ties to the smaller id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = cut(_blocks(candidates, row_block), "row-blocks")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    q = _blocks(queries, query_block).withColumn("q_block", F.sha2(F.concat(F.col("dim").cast("string"), F.col("ids").cast("string")), 256)).select("q_block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("norm").alias("q_norm"))
    q = cut(q, "query-blocks")
    blocks, top = rows.agg(F.count("*"), F.max("norm")).first() if rows.take(1) else (0, 0)
    if not blocks or not q.take(1):
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = int(top * q.agg(F.max("q_norm")).first()[0]) + 1  # Cauchy-Schwarz
    if reach >= 1 << 61:
        raise ValueError("scores do not fit into 64 bits")
    width = max(1, -(-(2 * reach + 1) // BINS))
    bounds = q.select("q_block", F.col("q_ids").alias("b_ids"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(x) // 8 for x in batch.b_ids]
            yield pd.DataFrame({"q_block": batch.q_block, "low": [np.full(x, -reach, "<i8").tobytes() for x in n], "width": [np.full(x, width, "<i8").tobytes() for x in n]})

    state_type = "q_block string, low binary, width binary"
    state = bounds.mapInPandas(start, state_type)

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block of queries: its bounded histograms (BINS + 1 counts a query) give the next intervals."""
        row = pdf.iloc[0]
        ids = np.frombuffer(row.q_ids, "<i8")
        low, wid = (np.frombuffer(row[c], "<i8") for c in ("low", "width"))
        counts = np.zeros((len(ids), BINS + 1), np.int64)
        place = {int(i): n for n, i in enumerate(ids)}
        known = pd.DataFrame([(c["query_id"], c["bin"], c["n"]) for c in (row.cells if row.cells is not None else ())], columns=["query_id", "bin", "n"])
        np.add.at(counts, (np.array([place[int(i)] for i in known["query_id"]], int), known["bin"].to_numpy(int)), known["n"].to_numpy(np.int64))
        from_top = np.cumsum(counts[:, ::-1], axis=1)
        at = (from_top < k).sum(axis=1)  # bins from the top, that above the interval included, that do not reach k
        short = at > BINS  # fewer scores than k: all of them
        low = np.where(short, low, low + (BINS - np.minimum(at, BINS)) * wid)
        wid = np.maximum(1, -(-wid // BINS))
        return pd.DataFrame({"q_block": [row.q_block], "low": [low.astype("<i8").tobytes()], "width": [wid.astype("<i8").tobytes()]})

    found = _search(rows, int(blocks), q, state, state_type, refine, width, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(rows: DataFrame, row_blocks: int, q: DataFrame, state: DataFrame, state_type: str, refine, width: int, k: int) -> DataFrame:
    """The passes: refine the intervals until they are single values, then keep what reaches them."""
    cores = q.sparkSession.sparkContext.defaultParallelism
    groups = -(-q.count() // TASK_QUERIES)
    # Slices of the rows, each of which meets each group of queries in a task.
    slices = min(row_blocks, max(-(-3 * cores // groups), -(-row_blocks // TASK_ROWS)))
    rows = over(rows, slices).hint("shuffle_replicate_nl")

    def met(state: DataFrame) -> DataFrame:
        asked = over(q.join(state, "q_block"), groups)
        return rows.join(asked, rows["dim"] == asked["q_dim"])

    while True:
        counted = met(state).select("q_block", "dim", "ids", "data", "q_ids", "q_data", "low", "width").mapInPandas(_histograms(k), "q_block string, query_id long, bin int, n long")
        summed = cut(counted.groupBy("q_block", "query_id", "bin").agg(F.sum("n").alias("n")), "histograms")
        # One row a block, so that its ids and intervals are not repeated for every count.
        cells = summed.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "bin", "n")).alias("cells"))
        whole = q.select("q_block", "q_ids").join(state, "q_block").join(cells, "q_block", "left")
        state = cut(whole.groupBy("q_block").applyInPandas(refine, state_type), "intervals")
        if width == 1:
            break
        width = max(1, -(-width // BINS))
    return cut(met(state).select("dim", "ids", "data", "q_ids", "q_data", "low").mapInPandas(_winners(k), "query_id long, vec_id long, score long"), "winners")
