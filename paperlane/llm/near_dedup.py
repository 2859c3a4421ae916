"""Near-duplicate classes by ProbMinHash, banding and verification.

Texts are sequences of words (runs of letters or digits, lower-cased); their weighted shingles are runs of five words with their counts (a
text of fewer words, but not none, has one shingle). Two texts are linked when their probability Jaccard similarity
(Moulton and Jiang, 2018) is 0.8 or more; classes are the connected components.

Signatures follow ProbMinHash (Ertl, 2020): every shingle is a Poisson process whose rate is its weight, its arrivals fall on
random components, each component keeps the shingle of its first arrival, and a process stops once its clock is past the
latest first arrival of all components. Two texts share a component with probability equal to their similarity.

Texts with equal words are one node. Nodes meet in the buckets of BANDS bands of ROWS components. No bucket is expanded into pairs. At first every
node goes to its largest bucket alone, and is compared with that bucket's leader, which joins the bulk of a large group at one comparison a node. Then, in
each of ROUNDS rounds, the members of a bucket are compared with one leader of it, from the class that has most of its members, if they are of another class;
classes are merged, by the links between classes alone; leaders change from round to round. What is still in one bucket but in different classes is compared
member by member. A leader's text travels once for every MEMBERS members, and a leader of many is dealt over as many parts.

A comparison first counts equal components of the two signatures; texts are fetched and verified only where
these are within SPREAD standard deviations of what a similarity of 0.8 gives. Nodes left for the last round get a signature of LONG
components besides, which tells 0.75 from 0.8, so that two large groups that are nearly alike are not compared text by text. A pair at 0.8 misses all buckets
with probability 2e-5, and falls out of either spread with probability 2e-4; everything above is likelier to be found. With `spread` off no pair falls out:
all that meet in a bucket are verified.

Null text is empty. Texts without words are alike only if equal as strings. Null ids: the class id is the smallest id of the class, or null.
Repeated rows are copies. An empty table gives an empty result. Extra columns are ignored (classes) or passed on (deduplicate).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.llm.common import cut, row_count_at_most

SHINGLE, SIMILARITY, BANDS, ROWS, ROUNDS, SPREAD = 5, 0.8, 36, 6, 3, 3.5
#: Components, each cut to a byte, in a packed number; the top byte stays free.
PACKED = 7
LEAST_EQUAL = int(BANDS * ROWS * (SIMILARITY - SPREAD * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5))
#: Components of the signatures of the last round, and how many of them must be equal.
LONG = 864
LEAST_LONG = int(LONG * (SIMILARITY - SPREAD * (SIMILARITY * (1 - SIMILARITY) / LONG) ** 0.5))
#: Words whose signatures are made at a time; members that a leader is compared with in one part.
WORDS, MEMBERS = 1 << 16, 512
#: Rows of ids that are broadcast at most.
BROADCAST_ROWS = 200_000
WORD = r"[\p{L}\p{N}]+"
GOLD = 0x9E3779B97F4A7C15


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_codes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit code of each run of `size` words, given the words' codes."""
    words = words.astype(np.int64).view(np.uint64)
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(GOLD) + words[i : i + n])
    return out


def prob_min_hash(texts: list[np.ndarray], components: int) -> np.ndarray:
    """Signatures (texts x components) of texts given by their shingle codes, repeated as often as they occur; none may be empty."""
    found = [np.unique(t, return_counts=True) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(e) for e, _ in found])
    element = np.concatenate([e for e, _ in found])
    rate = np.concatenate([c for _, c in found]).astype(float)
    clock = np.zeros(len(element))
    first = np.full((len(texts), components), np.inf)
    winner = np.zeros((len(texts), components), np.uint64)
    flat_first, flat_winner = first.ravel(), winner.ravel()
    turn = 0
    while len(element):
        turn += 1
        draw = mix(element + np.uint64((turn * 2 * GOLD) % (1 << 64)))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        place = of * components + (mix(draw ^ np.uint64(GOLD)) % np.uint64(components)).astype(np.int64)
        np.minimum.at(flat_first, place, clock)
        won = flat_first[place] == clock
        flat_winner[place[won]] = element[won]
        on = clock < first.max(axis=1)[of]
        element, of, rate, clock = element[on], of[on], rate[on], clock[on]
    return winner


def band_codes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for r in range(rows):
        out = mix(out * np.uint64(GOLD) + signatures[:, r : bands * rows : rows])
    return out.view(np.int64)


def packed(signatures: np.ndarray) -> np.ndarray:
    """The last byte of each component, PACKED to a number, padded with zeros."""
    low = (mix(signatures) & np.uint64(255)).astype(np.int64)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % PACKED))).reshape(len(low), -1, PACKED)
    return (low << (8 * np.arange(PACKED))).sum(axis=2)


def equal_components(a: Column, b: Column) -> Column:
    """How many of the packed bytes are equal: a byte of the xor is zero where adding 0x7F to its low bits and keeping its high bit leaves 0x80 unset."""
    low, high = int("7f" * PACKED, 16), int("80" * PACKED, 16)
    total = F.lit(-(-(BANDS * ROWS) % PACKED))
    for i in range(-(-(BANDS * ROWS) // PACKED)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        filled = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x)
        total = total + F.bit_count(F.bitwise_not(filled).bitwiseAND(F.lit(high)))
    return total


def equal_long(a: Column, b: Column) -> Column:
    """equal_components of signatures of LONG components."""
    low, high = int("7f" * PACKED, 16), int("80" * PACKED, 16)

    def equal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(F.bitwise_not((z.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(z)).bitwiseAND(F.lit(high)))

    return F.aggregate(F.zip_with(a, b, equal), F.lit(-(-LONG % PACKED)), lambda n, x: n + x)


def probability_jaccard(a: Counter, b: Counter) -> float:
    """Sum over common elements d of 1 / sum over all i of max(a_i / a_d, b_i / b_d)."""
    both = Counter((a[k], b[k]) for k in a.keys() & b.keys())
    every = both + Counter((n, 0) for k, n in a.items() if k not in b) + Counter((0, n) for k, n in b.items() if k not in a)
    x = np.array([k for k in every], float).reshape(-1, 2)
    n = np.array(list(every.values()), float)
    return float(sum(m / (np.maximum(x[:, 0] / p, x[:, 1] / q) * n).sum() for (p, q), m in both.items()))


def shingles(words: list[str], size: int = SHINGLE) -> Counter:
    if len(words) <= size:
        return Counter([tuple(words)])
    return Counter(zip(*(words[i:] for i in range(size))))


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The batch in parts of WORDS words together, or of one text."""
    ends = np.cumsum([len(w) for w in batch.codes])
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, side="right")))
        yield batch.iloc[at:to]
        at = to


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _parts(batch):
            full = [n for n, w in enumerate(part.codes) if len(w)]
            bands: list = [np.zeros(0, np.int64)] * len(part)
            signs = list(bands)
            if full:
                signatures = prob_min_hash([shingle_codes(np.asarray(part.codes.iloc[n])) for n in full], BANDS * ROWS)
                for n, c, p in zip(full, band_codes(signatures), packed(signatures)):
                    bands[n], signs[n] = c, p
            yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "text_key": part.text_key, "node": part.node, "bands": bands, "signs": signs})


def _signed_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _parts(batch):
            yield pd.DataFrame({"node": part.node, "more": list(packed(prob_min_hash([shingle_codes(np.asarray(w)) for w in part.codes], LONG)))})


def signed_long(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, more: signatures of LONG components of the wanted nodes; texts: node, words."""
    codes = F.transform(F.split("words", " "), lambda w: F.xxhash64(w))
    rows = texts.join(wanted.select("node").distinct(), "node", "left_semi").select("node", codes.alias("codes"))
    return cut(rows.mapInPandas(_signed_long, "node binary, more array<long>"), "signed-long")


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, node, bands, signs of every row, written; the one pass over all texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    node = F.md5(F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise(F.concat(F.lit("\0"), F.col("text"))))
    rows = rows.select("doc_id", "text_key", F.unhex(node).alias("node"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    return cut(rows.mapInPandas(_signed, "doc_id long, text_key long, node binary, bands array<long>, signs array<long>"), "signed")


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a leader and part come together, the leader's own (without x) first; rows out are the members that are similar."""
    held, own = None, Counter()
    for batch in batches:
        keep = []
        for x, y, part, words in zip(batch.x, batch.y, batch.part, batch.words):
            mine = shingles(words.split(" "))
            if x is None:
                held, own = (y, part), mine
            elif held != (y, part):
                raise ValueError("a leader is missing before its members")
            keep.append(x is not None and probability_jaccard(mine, own) >= SIMILARITY)
        yield batch.loc[keep, ["x", "y"]].rename(columns={"x": "a", "y": "b"})


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x: member, y: leader) that are similar, as a, b; texts: node, words."""
    pairs = pairs.select("y", "x", F.pmod(F.xxhash64("x"), F.lit(1 << 20)).alias("h"))
    many = pairs.groupBy("y").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("long").alias("parts"))
    dealt = pairs.join(many, "y").select("x", "y", F.pmod("h", "parts").cast("int").alias("part"))
    members = dealt.join(texts.select(F.col("node").alias("x"), "words"), "x").select("x", "y", "part", "words")
    led = many.select("y", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")).join(texts.select(F.col("node").alias("y"), "words"), "y")
    rows = members.unionByName(led.select(F.lit(None).cast("binary").alias("x"), "y", "part", "words"))
    ordered = rows.repartition("y", "part").sortWithinPartitions("y", "part", F.col("x").asc_nulls_first())
    return ordered.mapInPandas(_verified, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of all nodes of the edges (a, b).

    Every node goes to its smallest neighbour and on to that one's, the edges between the nodes so reached are kept once each, and so on until none is
    left: a star, which is what leaders make, is gone after one turn.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        low = cut(ends.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("next")), "low")
        up = cut(low.join(low.select(F.col("node").alias("next"), F.col("next").alias("up")), "next").select("node", "up"), "up")
        labels = up.select("node", F.col("up").alias("label")) if labels is None else labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = cut(labels, "labels")
        for end in "ab":
            edges = edges.join(up.select(F.col("node").alias(end), F.col("up").alias(f"up_{end}")), end)
        edges = cut(edges.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).where("a < b").distinct(), "edges")
        if not edges.take(1):
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: bool = True) -> DataFrame:
    """doc_id, class_id, class_size of every row: the smallest doc_id of its class and the number of its rows. spread=False: no filter on signatures."""
    return _classes(docs, signed(docs, id_col, text_col), id_col, text_col, spread).select("doc_id", "class_id", "class_size")


def mixed_buckets(member: DataFrame, labels: DataFrame) -> DataFrame:
    """node, bucket, label of the members of buckets that hold more than one class.

    Buckets are told apart by the smallest and largest label of their members, summed up before rows move; only members of mixed buckets go on.
    """
    named = member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bucket")
    return cut(named.join(mixed, "bucket", "left_semi"), "mixed")


def _classes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, spread: bool = True) -> DataFrame:
    """rows with class_id, class_size, label and keeper (doc_id, text_key of the row that stands for the class)."""
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("low_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("signs").alias("signs")), "nodes")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(member.join(shared, "bucket"), "members")
    largest = member.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("most")).select("node", "most.bucket")
    member = member.drop("n")
    needed = largest.select("node").join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("f_id"), F.col("first.text_key").alias("f_key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), F.xxhash64(text).alias("t_key"), text.alias("t"))
    found = texts.join(needed, F.col("t_id").eqNullSafe(F.col("f_id")) & (F.col("t_key") == F.col("f_key"))).select("node", F.array_join(words_of(F.col("t")), " ").alias("words"))
    found = cut(found.dropDuplicates(["node"]), "texts")
    signs = nodes.select("node", "signs")
    labels, tested = None, None
    least_equal, least_long = (LEAST_EQUAL, LEAST_LONG) if spread else (0, 0)
    for turn in range(ROUNDS + 2):
        last = turn == ROUNDS + 1
        if labels is None:
            now = (member if turn else largest).withColumn("label", F.col("node"))
        else:
            now = mixed_buckets(member, labels)
        now = now.join(signs, "node")
        if not last:
            own = now.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("p"), "node", "signs")).alias("first"))
            lead = own.groupBy("bucket").agg(F.max(F.struct("n", "label", "first")).alias("lead"))
            lead = lead.select("bucket", F.col("lead.first.node").alias("y"), F.col("lead.label").alias("other"), F.col("lead.first.signs").alias("y_signs"))
            apart = (F.col("label") != F.col("other")) & (equal_components(F.col("signs"), F.col("y_signs")) >= least_equal)
        else:
            now = now.join(nodes.select("node", "bands"), "node").join(signed_long(found, now), "node")
            lead = now.select("bucket", F.col("node").alias("y"), F.col("label").alias("other"), F.col("signs").alias("y_signs"), F.col("bands").alias("y_bands"), F.col("more").alias("y_more"))
            # Each pair comes out of one of its buckets only, the first that both share.
            once = F.array_min(F.array_intersect("bands", "y_bands")) == F.col("bucket")
            apart = (F.col("label") < F.col("other")) & (equal_components(F.col("signs"), F.col("y_signs")) >= least_equal) & once & (equal_long(F.col("more"), F.col("y_more")) >= least_long)
        near = now.withColumnRenamed("bucket", "x_bucket").join(lead, (F.col("x_bucket") == F.col("bucket")) & apart)
        pairs = near.select(F.col("node").alias("x"), "y").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = cut(pairs, "pairs")
        if not pairs.take(1):
            continue
        back = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))
        tested = pairs.unionByName(back) if tested is None else tested.unionByName(pairs).unionByName(back)
        links = cut(verify(pairs, found), "links")
        if not links.take(1):
            continue
        if labels is None:
            labels = components(links)
            continue
        # Classes merge by the links between them.
        for end in "ab":
            of = labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
            links = links.join(of, end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
        merged = components(links)
        new = merged.select("node", F.col("label").alias("to"))
        old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        # A class of one node so far has no row in labels yet.
        labels = cut(old.unionByName(new.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))), "labels")
    named = nodes.select("node", "first", "low_id", "copies")
    named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named, "named")
    whole = named.groupBy("label").agg(F.min("low_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("keeper"))
    of = cut(named.select("node", "label").join(whole, "label"), "classes")
    return rows.select("doc_id", "text_key", "node").join(of, "node")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the one with the smallest id; all columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = _classes(docs, signed(docs, id_col, text_col), id_col, text_col)
    gone = cut(found.where(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key")))).select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "gone")
    small = row_count_at_most(gone, BROADCAST_ROWS)
    left = docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_key")), "left_anti")
    # Rows that repeat a kept row's id and text: only those few pass through a window.
    again = cut(found.where(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key"))).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again_id"), F.col("text_key").alias("__again_key")), "again")
    if not again.take(1):
        return left
    same = left[id_col].cast("long").eqNullSafe(F.col("__again_id")) & (F.xxhash64(text) == F.col("__again_key"))
    once = left.join(again, same, "left_anti")
    repeated = left.join(again, same)
    number = F.row_number().over(Window.partitionBy("__again_id", "__again_key").orderBy(F.lit(0)))
    return once.unionByName(repeated.withColumn("__n", number).where("__n = 1").select(*docs.columns))
