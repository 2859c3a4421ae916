"""Benchmark decontamination: a broadcast hash set of normalised n-grams against every window of the training text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A benchmark item's windows are its runs of `size`
words; an item of fewer words, but not none, is one window. One pass takes a document's words, hashes each word once and each
window from its words' hashes, and looks the windows up in the set; only what is found there is spelt out and compared
word by word. Only DataFrame expressions are used.

Null texts have no words: never hit, no windows. Items with a null id count as hits and name no item. Repeated rows keep a
result each, ties do not arise, empty tables give empty results (or no hits), extra columns are ignored.
The set holds one number a window, and is broadcast only if it has at most `broadcast_windows` of them; beyond that the
same join is shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlane.llm.common import ascii_lower, cut, row_count_at_most

#: What the contract's class leaves, as ranges: the same words, matched several times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Words of a text whose letters were not lower-cased, and what stands between them.
ANY_CASE, BETWEEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: At most so many codes (8 bytes each, some 30 in a hash table) are sent to all executors.
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_code(width: Column, codes: list[Column]) -> Column:
    """The hash of a window, of its width and its words' hashes; an array of hashes gives the same as its elements."""
    return F.xxhash64(width, *codes)


def benchmark_windows(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """width, window (its words joined by blanks), code (hash), items: one row for each distinct window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    width = F.least(F.lit(size), F.size("words"))
    starts = items.select("item", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at"))
    own = starts.select("item", "width", F.slice("words", F.col("at") + 1, F.col("width")).alias("own"))
    spelt = own.select("item", "width", F.array_join("own", " ").alias("window"), window_code(F.col("width"), [F.transform("own", lambda w: F.xxhash64(w))]).alias("code"))
    return spelt.groupBy("width", "window", "code").agg(F.array_sort(F.collect_set("item")).alias("items"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_key, start, width, window: every occurrence of a window, written; start counts words from 0."""
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # `size` values at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, start int, width int, window string").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    n = F.size("codes")
    at = rows.select("*", F.explode(F.when(n >= widths[0], F.sequence(F.lit(0), n - F.lit(widths[0])))).alias("start"))
    code = [window_code(F.lit(w), [F.get("codes", F.col("start") + i) for i in range(w)]) for w in widths]
    if len(widths) == 1:
        at = at.select("doc_id", "text_key", "words", "start", F.lit(widths[0]).alias("width"), code[0].alias("code"))
    else:  # every width in the same pass
        each = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.when(F.col("start") + w <= n, c).alias("code")) for w, c in zip(widths, code))))
        at = at.select("doc_id", "text_key", "words", "start", each.alias("w")).select("doc_id", "text_key", "words", "start", "w.width", "w.code")
    codes = windows.select(F.col("code").alias("w_code")).distinct()
    small = row_count_at_most(codes, broadcast_windows)
    spelt = F.array_join(F.slice("words", F.col("start") + 1, F.col("width")), " ").alias("window")
    if small:
        met = at.join(F.broadcast(codes), F.col("code") == F.col("w_code")).select("doc_id", "text_key", "start", "width", spelt)
    else:  # what is shuffled holds the window's words, not the document's
        met = at.select("doc_id", "text_key", "start", "width", "code", spelt).join(codes, F.col("code") == F.col("w_code")).drop("code", "w_code")
    met = cut(met, "windows-met")
    same = windows.select(F.col("width").alias("s_width"), F.col("window").alias("s_window"))
    return met.join(same, (F.col("width") == F.col("s_width")) & (F.col("window") == F.col("s_window")), "left_semi")


def covered(spans: Column) -> Column:
    """Number of words inside any of the sorted spans (start, end)."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).cast("long").alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for every row of docs; spans are (start, end) in words, sorted."""
    windows = cut(benchmark_windows(benchmark, size, text_col=text_col), "windows")
    found = hits(docs, windows, id_col, text_col, broadcast_windows)
    spans = found.groupBy("doc_id", "text_key").agg(sorted_spans().alias("spans"))
    # A window's items are looked up once for each text that holds it, however often it stands there.
    held = found.select("doc_id", "text_key", "width", "window").distinct().join(windows.select("width", "window", F.explode("items").alias("item")), ["width", "window"])
    named = held.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    alike = spans["doc_id"].eqNullSafe(named["doc_id"]) & (spans["text_key"] == named["text_key"])
    by_row = spans.join(named, alike, "left").select(spans["doc_id"].alias("h_id"), spans["text_key"].alias("h_key"), "spans", "items")
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), F.coalesce(F.regexp_count(text, F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    joined = base.join(by_row, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit")
    return joined.select("doc_id", "n_words", n_hit, F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"))


def sorted_spans() -> Column:
    return F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end"))))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns."""
    found = hits(docs, cut(benchmark_windows(benchmark, size, text_col="text"), "windows"), id_col, text_col, broadcast_windows)
    bad = found.select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad_id")) & (text_key(F.col(text_col)) == F.col("__bad_key")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs with hit words cut out of the text; rows without a hit are unchanged, text between kept words stays."""
    found = hits(docs, cut(benchmark_windows(benchmark, size), "windows"), id_col, text_col, broadcast_windows)
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(sorted_spans().alias("__spans"))
    text = F.col(text_col)
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("__id")) & (text_key(text) == F.col("__key")), "left")
    pieces = F.regexp_extract_all(text, F.lit(ANY_CASE + BETWEEN), F.lit(0))
    inside = lambda i: F.exists(F.col("__spans"), lambda s: (s["start"] <= i) & (i < s["end"]))
    kept = F.filter(F.transform(pieces, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~inside(x["i"]))
    lead = F.regexp_extract(text, "^" + BETWEEN, 0)
    cut_text = F.concat(lead, F.array_join(F.transform(kept, lambda x: x["w"]), ""))
    return joined.withColumn(text_col, F.when(F.col("__spans").isNotNull(), cut_text).otherwise(text)).select(*docs.columns)
