"""The prefix trie of conversations, without ever holding one conversation or one node's members in a task.

Every distinct sequence of first d turns is a node; its owner is the smallest conversation that begins so. A conversation owns its prefixes
from some depth on, as fewer and fewer begin as it does: these nodes are its chain. The trie is its chains and the places where they are attached.

1. Turns are numbered by a range-partitioned sort, so that a conversation that holds a third of all rows is spread over tasks.
2. Prefix digests run in blocks of BLOCK turns; a block starts from the digest of all turns before it, which comes from
   the same computation over the blocks' own digests, and so on up. One aggregation gives each digest's smallest conversation (the minima).
3. Each block of a conversation searches its first owned depth by halving: every round joins one digest a block with the minima. Digests
   shared by more than one prefix in HOT (there are fewer than HOT of them) are broadcast, the others are joined by shuffle, so no key is hot.
4. Chains without chains below them are summed into the places they are attached to, and leave; their parents follow, until the root's
   chain is left. Sums along a chain run from its end in blocks, again with the blocks' sums on top.

Turns go by their number, null first; turns of equal number by role, then by digest. Null role and text are empty. Rows without a conversation
id take no part. Repeated rows are turns each. Empty tables give an empty trie. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.llm.common import cut, small_batches

BLOCK, HOT, SIZE = 256, 1000, 16
#: Conversations of one base, and the most turns that a conversation takes from its base, plus one.
BASE, HEADS = 100, 6
#: Characters of ids that are gathered before they are hashed.
CHUNK = 1 << 16


@dataclass
class Trie:
    """nodes: conv_id (the owner), depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ends: conv_id of every conversation and the digest of its last node."""

    nodes: DataFrame
    ends: DataFrame


def _short(*parts: Column) -> Column:
    """SIZE bytes of the SHA-256 of the parts, one after the other."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * SIZE))


def numbered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """part, conv, at, digest, n: turns in order of `at` within part, parts in order; a turn's digest stands for its role and text, n counts the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = _short(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role), "utf-8"), F.encode(text, "utf-8"))
    turns = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("n"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.select(F.spark_partition_id().alias("part"), "conv", F.monotonically_increasing_id().alias("at"), "digest", "n"), "ordered-turns")


def rebuild(rows: DataFrame, base: int = BASE, heads: int = HEADS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(turns: conv, pos from 1, digest, n; lengths: conv, length). Each conversation c takes the first h turns of c - c % base in place of its own first h; h = crc32 of c's decimal, modulo heads. heads=1 leaves all as it is."""
    turns = numbered(rows, **columns)
    # A part's rows of one conversation lie together: where they begin and how many come before them in earlier parts; a conversation has a row for each part that it touches.
    spans = turns.groupBy("part", "conv").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    spans = spans.withColumn("before", F.sum("m").over(Window.partitionBy("conv").orderBy("part")) - F.col("m"))
    h, of = F.crc32(F.col("conv").cast("string")) % F.lit(heads), F.col("conv") - F.col("conv") % F.lit(base)
    spans = cut(spans.withColumns({"h": h, "of": of}), "spans")
    lengths = spans.groupBy("conv", "h", "of").agg(F.sum("m").alias("own"))
    bases = lengths.where("conv = of").select(F.col("conv").alias("of"), F.col("own").alias("of_length"))
    lengths = lengths.join(bases, "of", "left").select("conv", "h", "of", "own", F.least("h", F.coalesce("of_length", F.lit(0))).alias("taken"))
    lengths = cut(lengths.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    placed = turns.join(spans.join(lengths.select("conv", "taken"), "conv"), ["part", "conv"]).withColumn("p", F.col("before") + F.col("at") - F.col("first") + 1)
    own = placed.where(F.col("p") > F.col("h")).select("conv", (F.col("p") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n")
    # A base's first turns go to the conversations of its hundred.
    head = placed.where((F.col("conv") % base == 0) & (F.col("p") < heads)).select("of", F.col("p").alias("pos"), "digest", "n")
    taken = lengths.where("taken > 0").select("conv", "of", "taken").join(head, "of").where(F.col("pos") <= F.col("taken")).select("conv", "pos", "digest", "n")
    return own.unionByName(taken), lengths.select("conv", "length")


def chained(items: DataFrame) -> DataFrame:
    """conv, block (from 0), before, digests, sizes: the digests of all prefixes that end within the block, and of the prefix before it, from items (conv, pos from 1, digest, n)."""
    small_batches(items.sparkSession)
    block = F.floor((F.col("pos") - 1) / F.lit(BLOCK)).alias("block")
    gathered = items.groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n"))).alias("turns"))  # BLOCK turns at most
    gathered = gathered.select("conv", "block", F.col("turns.digest").alias("digests"), F.col("turns.n").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a block, a prefix's digest is that of the prefix before it and of the turn."""
        for batch in batches:
            out = []
            for digests in batch.column(2).to_pylist():
                chain, state = [], b""
                for d in digests:
                    state = hashlib.sha256(state + d).digest()[:SIZE]
                    chain.append(state)
                out.append(chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary())), batch.column(3)], ["conv", "block", "digests", "sizes"])

    inner = cut(gathered.mapInArrow(run, "conv long, block long, digests array<binary>, sizes array<long>"), "chains")
    root = F.lit(b"").alias("before")
    ends = inner.where(F.size("digests") == BLOCK).select("conv", (F.col("block") + 1).alias("pos"), F.element_at("digests", -1).alias("digest"), F.lit(0).cast("long").alias("n"))
    if ends.isEmpty():
        return inner.select("conv", "block", root, "digests", "sizes")
    # The same over whole blocks tells what block b starts from: a digest of all turns of the b blocks before it.
    starts = chained(ends).select("conv", F.posexplode("digests").alias("k", "start"), F.col("block").alias("outer"))
    starts = starts.select("conv", (F.col("outer") * BLOCK + F.col("k") + 1).alias("block"), "start")
    later = inner.where("block > 0").join(starts, ["conv", "block"])
    later = later.select("conv", "block", F.transform("digests", lambda d: _short(F.col("start"), d)).alias("digests"), "sizes")
    whole = cut(inner.where("block = 0").select("conv", "block", "digests", "sizes").unionByName(later), "prefixes")
    last = whole.where(F.size("digests") == BLOCK).select("conv", (F.col("block") + 1).alias("block"), F.element_at("digests", -1).alias("before"))
    return whole.where("block = 0").select("conv", "block", root, "digests", "sizes").unionByName(whole.where("block > 0").join(last, ["conv", "block"]).select("conv", "block", "before", "digests", "sizes"))


def minima(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """digest, conv (the smallest conversation), depth, n_convs, n of every prefix; the empty digest is the root's."""
    every = blocks.select("conv", "block", F.posexplode(F.arrays_zip("digests", "sizes")).alias("k", "turn"))
    every = every.select("conv", (F.col("block") * BLOCK + F.col("k") + 1).alias("depth"), F.col("turn.digests").alias("digest"), F.col("turn.sizes").alias("n"))
    every = every.unionByName(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n")))
    return cut(every.groupBy("digest").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("n").alias("n")), "minima")


def first_owned(blocks: DataFrame, owners: DataFrame) -> DataFrame:
    """conv, block, at, parent: a block's prefixes are, from 0, the one before it and those that end in it; `at` is the first that the conversation owns (their number, if none), parent the owner of the prefix before."""
    longest, prefixes = blocks.agg(F.max(F.size("digests"))).first()[0] or 0, owners.agg(F.sum("n_convs")).first()[0] or 0
    owners = owners.select(F.col("digest").alias("probe"), F.col("conv").alias("owner"), "n_convs")
    # Shares of all prefixes sum to one, so fewer than HOT digests have more than one in HOT.
    common = F.broadcast(owners.where(F.col("n_convs") * HOT > prefixes).select(F.col("probe").alias("hot"), F.col("owner").alias("hot_owner")))
    rare = owners.select(F.col("probe").alias("cold"), F.col("owner").alias("cold_owner"))
    state = blocks.select("conv", "block", F.concat(F.array("before"), "digests").alias("all"), F.lit(0).alias("low"), (F.size("digests") + 1).alias("high"), F.lit(None).cast("long").alias("parent"))
    for _ in range((longest + 1).bit_length()):
        middle = F.least(F.floor((F.col("low") + F.col("high")) / 2).cast("int"), F.size("all") - 1)
        state = state.withColumn("middle", middle).withColumn("probe", F.get("all", F.col("middle")))
        state = state.join(common, F.col("probe") == F.col("hot"), "left")
        # Owner known already: a key that is nobody's, and differs by conversation.
        key = F.when(F.col("hot").isNull(), F.col("probe")).otherwise(F.encode(F.concat(F.lit("found "), F.col("conv").cast("string")), "utf-8"))
        state = state.withColumn("key", key).join(rare, F.col("key") == F.col("cold"), "left").withColumn("owner", F.coalesce("hot_owner", "cold_owner"))
        open_, mine = F.col("low") < F.col("high"), F.col("owner") == F.col("conv")
        state = state.select(
            "conv", "block", "all",
            F.when(open_ & ~mine, F.col("middle") + 1).otherwise(F.col("low")).alias("low"), F.when(open_ & mine, F.col("middle")).otherwise(F.col("high")).alias("high"),
            F.when(open_ & ~mine, F.col("owner")).otherwise(F.col("parent")).alias("parent"),
        )
    return state.select("conv", "block", F.col("low").alias("at"), F.size("all").alias("size"), "parent")


def suffix_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (conv, pos from 0, and names) with each name summed from its position to the end of its conversation."""
    rows = rows.withColumn("block", F.floor(F.col("pos") / F.lit(BLOCK)))
    sums = cut(rows.groupBy("conv", "block").agg(*(F.sum(c).alias(c) for c in names)), "block-sums")
    own = Window.partitionBy("conv", "block").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumns({c: F.sum(c).over(own) for c in names})
    if not (sums.agg(F.max("block")).first()[0] or 0):
        return inner.drop("block")
    whole = suffix_sums(sums.withColumnRenamed("block", "pos"), names)
    after = whole.select("conv", (F.col("pos") - 1).alias("block"), *(F.col(c).alias(f"after_{c}") for c in names))
    joined = inner.join(after, ["conv", "block"], "left")
    return joined.select(*rows.drop("block", *names).columns, *((F.col(c) + F.coalesce(f"after_{c}", F.lit(0))).alias(c) for c in names))


def chain_sums(chains: DataFrame) -> DataFrame:
    """conv, depth, leaves, saved: what all chains below bring to the nodes that chains are attached to. chains: conv, parent, place (depth of the parent's node), leaves, saved of the chain by itself."""
    rest, found = chains, []
    while True:
        parents = rest.where("parent IS NOT NULL").select(F.col("parent").alias("conv")).distinct()
        ready = rest.join(parents, "conv", "left_anti").where("parent IS NOT NULL")
        sums = cut(ready.groupBy(F.col("parent").alias("conv"), F.col("place").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "attached")
        if sums.isEmpty():
            break
        found.append(sums)
        below = sums.groupBy("conv").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = rest.join(parents, "conv", "left_semi").join(below, "conv", "left")
        rest = cut(rest.select("conv", "parent", "place", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "chains-left")
    whole = chains.sparkSession.createDataFrame([], "conv long, depth long, leaves long, saved long")
    for sums in found:
        whole = whole.unionByName(sums)
    return whole.groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(turns: DataFrame, lengths: DataFrame) -> Trie:
    """The trie of turns (conv, pos from 1, digest, n) of the conversations in lengths (conv, length)."""
    blocks = chained(turns)
    # A conversation without turns is a block without turns.
    empty = lengths.where("length = 0").select("conv", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("before"), F.array().cast("array<binary>").alias("digests"), F.array().cast("array<long>").alias("sizes"))
    blocks = blocks.unionByName(empty)
    owners = minima(blocks, lengths)
    at = first_owned(blocks, owners)
    heads = at.where((F.col("at") < F.col("size")) & ((F.col("at") > 0) | (F.col("block") == 0))).select("conv", (F.col("block") * BLOCK + F.col("at")).alias("top"), "parent")
    chains = cut(heads.join(lengths, "conv").select("conv", "top", "length", "parent", (F.col("top") - 1).alias("place")), "chains")
    attached = cut(chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), F.col("place").alias("depth")).agg(F.count("*").alias("n_chains")), "places")
    saved = owners.groupBy("conv").agg(F.sum((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    at_end = attached.select("conv", F.col("depth").alias("length"), F.lit(0).cast("long").alias("leaf"))
    alone = chains.join(at_end, ["conv", "length"], "left").join(saved, "conv").select("conv", "parent", "place", F.coalesce("leaf", F.lit(1)).alias("leaves"), "saved")
    below = chain_sums(cut(alone, "chains-left"))
    # Nodes meet their chain block by block, as a chain may hold a third of all nodes.
    chain_blocks = chains.withColumn("block", F.explode(F.sequence(F.floor(F.col("top") / BLOCK), F.floor(F.col("length") / BLOCK)))).select("conv", "block", "top", "length", "parent")
    nodes = owners.withColumn("block", F.floor(F.col("depth") / BLOCK)).join(chain_blocks, ["conv", "block"]).drop("block")
    nodes = nodes.join(attached, ["conv", "depth"], "left").join(below, ["conv", "depth"], "left")
    n_children = F.coalesce("n_chains", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")
    parent = F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv"))
    nodes = nodes.select(
        "conv", F.col("depth").alias("pos"), "digest", parent.alias("parent_conv_id"), "n_convs", n_children.alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + (n_children == 0).cast("long")).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n")).alias("saved_tokens"),
    )
    nodes = suffix_sums(nodes, ["n_leaves", "saved_tokens"])
    last = blocks.select("conv", "block", F.size("digests").alias("m"), F.when(F.size("digests") > 0, F.element_at("digests", -1)).otherwise(F.lit(b"")).alias("digest")).join(lengths, "conv")
    ends = last.where(F.col("block") * BLOCK + F.col("m") == F.col("length")).select(F.col("conv").alias("conv_id"), "digest")
    return Trie(nodes.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "digest", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def id_hashes(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256: the SHA-256 of the ids, in order and joined by commas, of each node's conversations. Ids are ordered and joined to chunks where they lie; one task for a node then takes the chunks in, one after the other, and holds none."""
    small_batches(ends.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first]), pa.array([",".join(ids)])], ["digest", "first", "ids"])

        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (digest != node or size > CHUNK):
                    yield sent()
                    ids, size = [], 0
                if not ids:
                    node, first = digest, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield sent()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([x for _, x in done])], ["digest", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    ordered = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    parts = ordered.mapInArrow(chunks, "digest binary, first long, ids string")
    return parts.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashes, "digest binary, ends_sha256 string")
