"""Best-fit packing by exact-complement hashing.

Every piece's length is counted in a histogram (at most `capacity` bins, whatever the input). The plan is made on it:
the longest length left is opened as a sequence, its gap is looked up among the single lengths, then the sums of pairs, then
of triples that are still available, and the combination is consumed as often as the counts allow; where nothing
fills the gap exactly, the longest length that fits goes in (best fit) until none does. A plan step ends when some length runs out, so
a plan has a few steps for each length, not for each piece. Pieces find their step by their rank among pieces of
equal length, which is taken in slices, so a length that holds a third of all pieces is no single task.

Null text is empty and gives one piece of the end id alone. Repeated rows are packed each for itself. Empty tables give empty results. Extra
columns are ignored. Only documents longer than the capacity are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlane.llm.common import cut
from paperlane.llm.tokenizing import CachedTokenizer

CAPACITY, END_ID = 2048, 0
SLICES = 256
#: Bytes of texts that are encoded at a time; a longer text goes by itself.
TEXT_BYTES = 1 << 20


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, over all its tasks; what it keeps is bounded (some 30 MB)."""
    return CachedTokenizer(path)


def byte_groups(offsets: np.ndarray, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of `most` bytes together, or of one text; offsets: where texts begin, and the end."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column without nulls, and where its texts begin, with the end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begins = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), begins


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        for batch in batches:
            data, begins = text_bytes(batch.column(1))
            for low, high in byte_groups(begins):
                ids, at = tokenizer.encode_texts(data[begins[low] : begins[high]], begins[low : high + 1] - begins[low])
                raw, bounds = memoryview(ids.tobytes()), at.tolist()
                out: list[tuple[int, int, int, int, int]] = []
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    whole = b - a + 1  # with the end
                    for piece, start in enumerate(range(0, whole, capacity)):
                        stop = min(start + capacity, whole)
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + stop, b)])
                        out.append((n, piece, start, stop - start, zlib.crc32(end, crc) if stop == whole else crc))
                of, *numbers = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(of)), *(pa.array(x, t) for x, t in zip(numbers, types[1:]))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) steps that use up the histogram; lengths of a step sum to the capacity at most."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    steps: list[tuple[tuple[int, ...], int]] = []
    sums = PairSums(left, capacity)

    def use(lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        steps.append((lengths, times))
        for x, n in need.items():
            left[x] -= n * times

    residual: list[int] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            left[length] -= 1
            fill = () if not gap else sums.fill(gap)
            left[length] += 1
            if fill is None:
                residual.append(length)
                break
            use((length, *fill))
    # What is left has no exact complement: best fit, longest first, each gap taking the longest length that fits.
    for length in range(capacity, 0, -1):
        while left[length]:
            lengths, gap = (length,), capacity - length
            left[length] -= 1
            taken = [length]
            while gap:
                fits = np.flatnonzero(left[: gap + 1] > 0)
                if not len(fits):
                    break
                exact = sums.fill(gap)
                more = exact if exact else (int(fits[-1]),)
                lengths += more
                gap -= sum(more)
                for x in more:
                    left[x] -= 1
                    taken.append(x)
            for x in taken:
                left[x] += 1
            use(lengths)
    return steps


class PairSums:
    """The index of length sums: which single, pair or triple of available lengths fills a gap exactly."""

    def __init__(self, left: np.ndarray, capacity: int):
        self.left, self.capacity = left, capacity

    def pair(self, gap: int, without: int = 0) -> tuple[int, int] | None:
        """The pair with the longest first length; `without` is a length of which one is spoken for."""
        left = self.left
        if without:
            left = left.copy()
            left[without] -= 1
        low = np.arange(1, gap // 2 + 1)
        good = (left[low] > 0) & (left[gap - low] > 0)
        if not gap % 2 and len(low) and left[gap // 2] < 2:
            good[-1] = False
        found = np.flatnonzero(good)
        return (int(gap - low[found[0]]), int(low[found[0]])) if len(found) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        for first in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.left[first] > 0 and (rest := self.pair(gap - first, first)):
                return (first, *rest)
        return None


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = found.sparkSession
    found = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLICES)).cast("int"))
    sizes = found.groupBy("length", "slice").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots, used, first = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + times, first, offset))
            used[length] += times
            offset += length
        first += times
    slot_rows = spark.createDataFrame(slots, "s_length long, low long, high long, first long, offset long")
    before = sizes.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("own", F.row_number().over(order)).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # A few slots for each length: bounded by the plan, not by the input.
    placed = ranked.join(F.broadcast(slot_rows), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    return pack(cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
