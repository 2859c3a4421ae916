"""Importance resampling towards a target: hashed-feature weights, Gumbel scores, and the exact best of them by merged sorted runs.

Words are runs of [0-9a-z] and of all characters beyond ASCII, after lower-casing A-Z. Features are the runs of 1 to 2 words; each falls into one of
BUCKETS buckets by crc32. Tasks count features into one array each; arrays are added up in groups, so what is sent grows with the
number of tasks and not with the corpus. A bucket's gain compares its share in the target with its share in the documents, a document's weight is
the floored mean of its features' gains, and a score adds Gumbel noise that depends on the document's id alone: the best k scores are a draw
without replacement by weight.

The draw: each partition of the scored rows sorts its eligible rows (best score first, ties to the smaller id, then by row) and writes them as a run, in blocks.
The blocks' first rows, weighted by their sizes, give the borders of ranges of about sqrt(n) blocks' rows; borders are rows of a total order, so equal scores
and repeated rows split as well. Counts of each range tell where its ranks begin, and which range is the last one to be
merged. Each range that is needed is merged by itself, from the slices of all runs, by a tournament tree whose inner nodes keep
losers; the last range stops at the exact count. Ranges behind it are neither sent nor merged.

Null text has no words: no features, weight 0. Null ids stand before all others among ties and hash as an empty id. Rows of one id are
rows each; which of two rows equal in score and id comes first is open. Empty tables give empty results. Extra columns are left alone; the columns
added (n_features, weight, score, rank) must be new names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paperlane.llm.common import cut, small_batches
from paperlane.llm.packing import byte_groups, text_bytes

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Rows of a block at least; blocks of a range.
BLOCK, BLOCKS = 4096, 16
#: Arrays of counts that one task adds up.
ADDENDS = 64
#: Everything but [0-9a-z] and bytes beyond ASCII is a blank, A-Z become a-z.
WORDS = bytes(c if c > 127 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def features(text: bytes) -> tuple[int, list[int]]:
    """The number of words, and the crc32 of every feature."""
    words = text.translate(WORDS).split()
    crc32 = zlib.crc32
    ones = list(map(crc32, words))
    return len(words), ones + [crc32(b" " + word, before) for word, before in zip(words[1:], ones)]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, begins = text_bytes(batch.column(0))
            for low, high in byte_groups(begins):
                found: list[int] = []
                for n in range(low, high):
                    found += features(data[begins[n] : begins[n + 1]].tobytes())[1]
                total += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": [total.astype("<i8").tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), "<i8")
        yield pa.RecordBatch.from_pydict({"counts": [total.astype("<i8").tobytes()]})

    sums = cut(docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(count, "counts binary"), "feature-counts")
    while (n := sums.count()) > ADDENDS:
        sums = cut(sums.repartition(-(-n // ADDENDS)).mapInArrow(add, "counts binary"), "feature-counts")
    return sum((np.frombuffer(r.counts, "<i8") for r in sums.collect()), np.zeros(buckets, np.int64))  # ADDENDS arrays at most


def gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's smoothed shares, target to ours)."""
    n = len(ours)
    s_all, t_all = int(ours.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(ours.tolist(), target.tolist())], np.int64)


def noise(doc_id: str) -> int:
    """floor(1000 * a Gumbel variate) from the id's hash."""
    h = int(hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns named in `keep`) with n_words, n_features, weight and score, all long."""
    small_batches(docs.sparkSession)
    names, kept = ("n_words", "n_features", "weight", "score"), docs if keep is None else docs.select(*keep)
    if clash := set(names) & set(kept.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    width, outs = len(kept.columns), [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begins = text_bytes(batch.column(width))
            ids = batch.column(width + 1).to_pylist()
            for low, high in byte_groups(begins):
                out = []
                for n in range(low, high):
                    words, found = features(data[begins[n] : begins[n + 1]].tobytes())
                    weight = int(gain[np.array(found, np.int64) % len(gain)].sum()) // len(found) if found else 0
                    out.append((words, len(found), weight, weight + noise(ids[n])))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(low, high - low) for k in range(width)] + [pa.array(x, pa.int64()) for x in zip(*out)], outs)

    given = docs.select(*(docs[c] for c in kept.columns), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"))
    schema = kept.schema
    for name in names:
        schema = schema.add(name, "long")
    return given.mapInArrow(run, schema)


class Tournament:
    """Merges sorted runs: a tree of matches whose leaves are the runs' first entries and whose inner nodes keep the loser of their match."""

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(runs))
        self.head: list = [next(r, None) for r in self.runs] or [None]
        self.loser = [0] * self.size
        # The first matches, from the leaves (size to 2 * size - 1) up.
        winner = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winner[node], self.loser[node] = self.match(winner[2 * node], winner[2 * node + 1])
        self.best = winner[1] if self.size > 1 else 0

    def match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        return (a, b) if y is None or x is not None and x <= y else (b, a)

    def __iter__(self) -> Iterator:
        while (entry := self.head[self.best]) is not None:
            yield entry
            way = self.best
            self.head[way] = next(self.runs[way], None)
            node = (way + self.size) // 2
            while node:  # replays the matches on the way from the run's leaf to the root
                way, self.loser[node] = self.match(way, self.loser[node])
                node //= 2
            self.best = way


def _key(score: int, own, row: int) -> tuple:
    """The order of rows: best score first, then the smaller id (null before all), then by row."""
    return -score, own is not None, own if own is not None else 0, row


def best(rows: DataFrame, k: int, total: int, block: int | None = None) -> DataFrame:
    """row and rank (from 1) of the k best of `total` rows (row, score, id); row is a long that no two rows share."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType
    if k < 1 or total < 1:
        return spark.createDataFrame([], "row long, rank long")
    block, named, id_type = block or max(BLOCK, math.isqrt(total)), kind.simpleString(), to_arrow_type(kind)
    lists = [pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.int64())]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run in blocks; a task has one run, and holds one block of it."""
        held: tuple[list, list, list] = [], [], []
        run = None

        def sent(n: int) -> pa.RecordBatch:
            part = [x[:n] for x in held]
            for x in held:
                del x[:n]
            first = [pa.array([x[0]], t.value_type) for x, t in zip(part, lists)]
            return pa.RecordBatch.from_arrays([pa.array([run]), pa.array([len(part[0])]), *first, *(pa.array([x], t) for x, t in zip(part, lists))], ["run", "n", "first_score", "first_id", "first_row", "scores", "ids", "rows"])

        for batch in batches:
            for x, column in zip(held, batch.columns):
                x.extend(column.to_pylist())
            run = held[2][0] if run is None and held[2] else run
            while len(held[0]) >= block:
                yield sent(block)
        if held[0]:
            yield sent(block)

    runs = rows.select("score", "id", "row").sortWithinPartitions(F.col("score").desc(), F.col("id").asc_nulls_first(), "row")
    runs = cut(runs.mapInArrow(blocks, f"run long, n long, first_score long, first_id {named}, first_row long, scores array<long>, ids array<{named}>, rows array<long>"), "runs")
    # One row a block, some sqrt(total) in all: the borders, and about BLOCKS blocks' rows between them.
    firsts = sorted((_key(r.first_score, r.first_id, r.first_row), r.n) for r in runs.select("first_score", "first_id", "first_row", "n").collect())
    borders, since = [], 0
    for first, n in firsts:
        if since >= BLOCKS * block:
            borders.append(first)
            since = 0
        since += n

    def cuts(scores: list, ids: list, own: list) -> Iterator[tuple[int, int, int]]:
        """(range, from, to) of the parts of a block."""
        key = lambda n: _key(scores[n], ids[n], own[n])
        at, place = 0, bisect_right(borders, key(0))
        while at < len(scores):
            to = bisect_left(range(len(scores)), borders[place], at, key=key) if place < len(borders) else len(scores)
            if to > at:
                yield place, at, to
            at, place = to, place + 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                for place, a, b in cuts(r["scores"], r["ids"], r["rows"]):
                    found[place] = found.get(place, 0) + b - a
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["range", "n"])

    kept = runs.select("run", "scores", "ids", "rows")
    sizes = {r["range"]: r["n"] for r in kept.mapInArrow(counts, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row a range
    before, start, last = 0, {}, -1
    for place in sorted(sizes):
        if before < k:
            start[place], last = before, place
        before += sizes[place]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = [(place, r["run"], r["scores"][a:b], r["ids"][a:b], r["rows"][a:b]) for place, a, b in cuts(r["scores"], r["ids"], r["rows"]) if place <= last]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), [pa.int64(), pa.int64(), *lists])], ["range", "run", "scores", "ids", "rows"])

    def merge(table: pa.Table) -> pa.Table:
        """The ranks of one range; a run's slices of different blocks follow each other."""
        own: dict[int, list] = {}
        rows = table.to_pylist()
        for r in rows:
            own.setdefault(r["run"], []).append(list(map(_key, r["scores"], r["ids"], r["rows"])))
        merged = Tournament([[x for part in sorted(own[run]) for x in part] for run in sorted(own)])
        first = start[rows[0]["range"]]
        found = [key[-1] for key, _ in zip(merged, range(k - first))]
        return pa.table({"row": pa.array(found, pa.int64()), "rank": pa.array(range(first + 1, first + 1 + len(found)), pa.int64())})

    dealt = kept.mapInArrow(slices, f"range long, run long, scores array<long>, ids array<{named}>, rows array<long>")
    return dealt.groupBy("range").applyInArrow(merge, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank (null where not drawn): percent of those with least_words words or more are drawn.

    keep: the columns that are wanted besides (the id among them; None: all); without the texts, no text is written again.
    """
    if "rank" in docs.columns:
        raise ValueError("there is a column rank already")
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    row = "__row"
    while row in docs.columns:
        row = f"_{row}"
    found = cut(scored(docs, gain, id_col, text_col, keep).withColumn(row, F.monotonically_increasing_id()), "scored")
    eligible = found.where(F.col("n_words") >= least_words).select(F.col(row).alias("row"), "score", F.col(id_col).alias("id"))
    n = eligible.count()
    drawn = cut(best(eligible, percent * n // 100, n), "drawn")
    return found.join(drawn.withColumnRenamed("row", row), row, "left").drop(row)
