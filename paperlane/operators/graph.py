"""The citation graph: who cites whom by the keys in their texts, and ranks by power iteration.

A paper's rank is (1 - damping) / n, and damping times what flows in: each paper gives its rank in equal shares to what it cites, one without
citations gives its to all alike. Ranks sum to one. Iterations go on until the ranks change by less than a tolerance in all; every one is written, so lineage stays
short and lost executors take nothing with them. The driver sees sums only.

Papers are numbered within parts of some NODES, edges become blocks of numbers by the parts that they lead from and to, and an iteration is one product of blocks: edges
are written once and not sent again, names are joined at the beginning and at the end alone. What flows into a part is added up in each task before it is sent. A paper that cites
or is cited by a great part of all others has its edges over many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlane.plans.stored import drop, over, small_batches, stored

DAMPING, TOLERANCE = 0.85, 1e-9
#: Papers of a part on average; parts whose ranks a task holds, or gathers what flows into before it sends that on; edges of a block at most, by 64.
NODES, PARTS, HOT = 1 << 16, 16, 1000
CITE = r"\\[Cc]ite[A-Za-z]*\*?(?:\[[^\]]*\]){0,2}\{([^}]*)\}"


def citations(texts: DataFrame, keys: DataFrame, id_col: str = "paper_id", text_col: str = "text", key_col: str = "bib_key") -> DataFrame:
    """src, dst: each paper and each other paper that it cites, once. texts: paper_id, text; keys: bib_key, paper_id of the papers that can be cited. Unknown keys cite nothing."""
    found = F.split(F.array_join(F.regexp_extract_all(F.col(text_col), F.lit(CITE), F.lit(1)), ","), ",")
    used = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("src"), F.explode(F.array_distinct(F.transform(found, lambda k: F.trim(k)))).alias("key"))
    named = keys.select(F.col(key_col).alias("key"), F.col(id_col).alias("dst")).where("dst IS NOT NULL").distinct()
    return used.join(named, "key").where("src <> dst").select("src", "dst").distinct()


def citation_counts(papers: DataFrame, edges: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """paper_id, cites, cited of every paper."""
    out, into = (edges.groupBy(F.col(end).alias(id_col)).agg(F.count("*").alias(name)) for end, name in (("src", "cites"), ("dst", "cited")))
    every = papers.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(out, id_col, "left").join(into, id_col, "left")
    return every.select(id_col, F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited", F.lit(0)).alias("cited"))


def citation_ranks(papers: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, id_col: str = "paper_id") -> DataFrame:
    """paper_id, rank of every paper; edges (src, dst) that leave the papers are passed over."""
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError("damping lies from 0 to below 1, the tolerance is above 0")
    nodes = papers.select(F.col(id_col).alias("node")).where("node IS NOT NULL").distinct()
    own = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    own = stored(own, "edges")
    degrees = stored(nodes.join(own.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out")), "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out")), "degrees")
    n = degrees.count()
    if not n:
        return degrees.select(F.col("node").alias(id_col), F.lit(1.0).alias("rank"))
    parts = -(-n // NODES)
    numbered = degrees.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    places = stored(numbered.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1), "places")
    at = lambda end: places.select(F.col("node").alias(end), F.col("part").alias(f"{end}_part"), F.col("i").alias(f"{end}_i"))
    lines = own.join(at("src"), "src").join(at("dst"), "dst").select("src_part", "dst_part", "src_i", "dst_i")
    small_batches(degrees.sparkSession)
    blocks = stored(lines.repartitionByRange("src_part", "dst_part", "dst_i").sortWithinPartitions("src_part", "dst_part").mapInPandas(_edge_blocks, "src_part int, dst_part int, src binary, dst binary"), "edges")
    kind = "part int, outs binary, ranks binary, moved double, lost double"

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        outs = pdf.sort_values("i").out.to_numpy(np.int64)
        return pd.DataFrame({"part": [int(pdf.part.iloc[0])], "outs": [outs.tobytes()], "ranks": [np.full(len(outs), 1.0 / n).tobytes()], "moved": [0.0], "lost": [float((outs == 0).sum()) / n]})

    ranks = stored(places.select("part", "i", "out").groupBy("part").applyInPandas(start, kind), "ranks")
    loose = ranks.agg(F.sum("lost")).first()[0]
    while True:
        held = over(ranks.select(F.col("part").alias("src_part"), "outs", "ranks"), -(-parts // PARTS))
        flows = blocks.hint("shuffle_replicate_nl").join(held, "src_part").select("src_part", "dst_part", "src", "dst", "outs", "ranks").mapInPandas(_flows, "part int, outs binary, ranks binary")
        base = (1 - damping + damping * loose) / n

        def step(pdf: pd.DataFrame) -> pd.DataFrame:  # run before `base` is set anew
            """A part's old ranks, and in rows without `outs` what flows into it."""
            old = pdf[pdf.outs.notna()].iloc[0]
            before, outs, inflow = np.frombuffer(old.ranks), np.frombuffer(old.outs, np.int64), np.zeros(len(old.ranks) // 8)
            for x in pdf[pdf.outs.isna()].ranks:
                some = np.frombuffer(x)
                inflow[: len(some)] += some
            after = base + damping * inflow
            return pd.DataFrame({"part": [int(old.part)], "outs": [old.outs], "ranks": [after.tobytes()], "moved": [float(np.abs(after - before).sum())], "lost": [float(after[outs == 0].sum())]})

        after = stored(ranks.select("part", "outs", "ranks").unionByName(flows).groupBy("part").applyInPandas(step, kind), "ranks")
        moved, loose = after.agg(F.sum("moved"), F.sum("lost")).first()
        drop(ranks)
        ranks = after
        if moved < tolerance:
            break
    found = ranks.select("part", "ranks").mapInPandas(_ranks, "part int, i int, rank double")
    return places.join(found, ["part", "i"]).select(F.col("node").alias(id_col), "rank")


def _edge_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (a, b), group in batch.groupby(["src_part", "dst_part"], sort=False):
            for k in range(0, len(group), 64 * HOT):
                some = group.iloc[k : k + 64 * HOT]
                yield pd.DataFrame({"src_part": [a], "dst_part": [b], "src": [some.src_i.to_numpy(np.int32).tobytes()], "dst": [some.dst_i.to_numpy(np.int32).tobytes()]})


def _flows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What flows into each part, from the task's blocks of edges beside the ranks of the parts that they lead from."""
    held: dict[int, np.ndarray] = {}

    def sent() -> pd.DataFrame:
        return pd.DataFrame({"part": list(held), "outs": [None] * len(held), "ranks": [x.tobytes() for x in held.values()]})

    for batch in batches:
        for r in batch.itertuples():
            src, dst = np.frombuffer(r.src, np.int32), np.frombuffer(r.dst, np.int32)
            into = np.bincount(dst, np.frombuffer(r.ranks)[src] / np.frombuffer(r.outs, np.int64)[src])
            before = held.get(r.dst_part, np.zeros(0))
            more, less = (into, before) if len(into) > len(before) else (before, into)
            more[: len(less)] += less
            held[r.dst_part] = more
            if len(held) > 4 * PARTS:
                yield sent()
                held.clear()
    yield sent()


def _ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, ranks in zip(batch.part, batch.ranks):
            x = np.frombuffer(ranks)
            yield pd.DataFrame({"part": part, "i": np.arange(len(x), dtype=np.int32), "rank": x})
