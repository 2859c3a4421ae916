"""The prefix trie against plain dictionaries: odd rows, long and equal conversations, blocks of few turns so that all levels come into play."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperlane.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, digest string, conv long, block long"


def brute(rows):
    """The contract's rows, from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below[node] = (sum(below[k][0] for k in kids) or 1, saved + sum(below[k][1] for k in kids))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, [])), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(rng):
    rows, roles = [], ["user", "assistant", None]
    for c in [*range(-205, 260, 3), 300, 301, 399, 100, 0, 200]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(roles), rng.choice(["", None, "a", "bb", "Äß日"])))
    rows += [(1000, t, "user", "long") for t in range(90)] + [(1001, t, "user", "long" if t < 80 else "else") for t in range(88)]  # bases absent
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2060) for t in range(7)]  # a group of copies
    rows += [(3000, None, "user", "x")] * 40 + [(3000, 1, "a", "y"), (3000, 1, "b", "y"), (None, 1, "user", "no id"), (4000, 5, None, None)]  # repeats, ties
    rows += [(5000 + k, t, "user", f"path {t}") for k in range(12) for t in range(k + 4)]  # chains upon chains
    rows += [(7000, 0, "user", "z" * 100_000)]
    return rows


def order(row):
    return tuple(-(10**9) if x is None else x for x in row)


@pytest.mark.parametrize("block, chunk", [(256, 1 << 16), (4, 20)])
def test_against_dictionaries(spark, tmp_path, monkeypatch, block, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "HOT", 5 if block == 4 else 1000)
    rows = conversations(random.Random(block))
    spark.createDataFrame([(*r, 9, "d", 8, 7) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)
    assert any(r.depth > 80 for r in got) and any(r.n_convs > 50 and r.depth == 7 for r in got)


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = prefix_trie.trie(*prefix_trie.rebuild(none))
    assert found.nodes.collect() == [] and prefix_trie.id_hashes(found.ends).collect() == []
    one = prefix_trie.trie(*prefix_trie.rebuild(none.unionByName(none.sparkSession.createDataFrame([(1, 0, None, None)], none.schema)), heads=1))
    assert sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_children, r.n_leaves) for r in one.nodes.collect()) == [(1, 0, None, 1, 1), (1, 1, 1, 0, 1)]


def test_suffix_sums(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = [(c, p, p + c) for c, top, to in ((1, 0, 40), (2, 5, 6), (3, 25, 31)) for p in range(top, to)]
    got = prefix_trie.suffix_sums(spark.createDataFrame(rows, "conv long, pos long, x long"), ["x"]).collect()
    assert sorted((r.conv, r.pos, r.x) for r in got) == sorted((c, p, sum(x for k, q, x in rows if k == c and q >= p)) for c, p, _ in rows)


def test_turn_numbers_over_many_partitions(spark):
    """One conversation holds nearly all rows, and its rows are spread over the partitions."""
    rows = spark.range(5000).select(F.lit(7).alias("conv_id"), (F.col("id") % 50).alias("turn"), F.lit("r").alias("role"), F.lit("t").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie.numbered(rows).select("part").distinct().count() > 1
        built, lengths = prefix_trie.rebuild(rows, heads=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.pos for r in built.collect()) == list(range(1, 5001)) and [r.length for r in lengths.collect()] == [5000]
