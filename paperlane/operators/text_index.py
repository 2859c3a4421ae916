"""A stored inverted index of texts, and searches that read it in place of the texts.

Two tables in one folder. `rows` holds two kinds of rows, in folders by kind and `bucket` (a hash of the term). `terms`: what a batch of texts adds to a bucket, as arrays in step. An entry is a term in a block of documents: term, block,
n (its postings), most (greatest tf), least (least length); a posting is a term in a document: id, doc (its place in the block), tf, length (tokens of the document), by entry; positions follow by posting. `documents`: a row for each block,
with ids and lengths. A block is neighbours of one partition of the texts, so rows are made where the texts are read: nothing is sent by shuffle, and texts are read once. `collection`: one row of totals and settings.

Searches for the k best documents end early. What a block or a document can score at most follows from its terms' postings or counts, before pairs of queries and documents are scored or positions
are read. The most promising are scored first; their k-th score is a floor, and of the rest only those are scored
whose bound reaches it. The result is that of scoring everything. Of the postings only those of the terms asked for are sent, once each, by block (BM25) or by document; queries meet them there, so no pair of a
query and a document is sent before it is among the best of its partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperlane.functions.porter import stem
from paperlane.operators import lexical
from paperlane.operators.vector import top_by
from paperlane.plans.stored import drop_folder, small_batches, stored

#: Folders of postings, documents of a block on average, and blocks that are scored before there is a floor.
BUCKETS, BLOCK_DOCS, SEEDS = 32, 256, 4
K1, B = 1.2, 0.75
#: Rows of terms, blocks or documents asked for that are broadcast to where the index is read.
FEW = 1 << 20
#: Scores are sums of 64-bit integers, of which this many are 1: the order of a sum does not matter, so that equal documents get equal scores.
ONE = 1 << 48
#: Bytes of texts that become rows of the index at once (a block of documents at least): a bound on a worker's memory.
AT_ONCE = 2 << 20
#: Queries that meet a block at once, and pairs of a query and a posting that are added up at once: bounds on a worker's memory.
SLAB, PAIRS = 1 << 12, 1 << 20
#: Queries of a group of BM25 search: a bound on what the driver keeps of them.
GROUP = 1 << 15
#: Bytes that words consist of, once texts are in lower case (lexical.TOKEN).
IN_WORDS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


@dataclass(frozen=True)
class TextIndex:
    """A source of terms and positions, for lexical.cover_search and lexical.web_query_search too."""

    path: str
    id_col: str
    analyser: str
    buckets: int
    n_docs: int
    mean_length: float
    rows: DataFrame
    documents: DataFrame

    @property
    def postings(self) -> DataFrame:
        """term, id, positions, length, tf, block, bucket."""
        return self.read("positions")

    @property
    def blocks(self) -> DataFrame:
        """term, block, n, tf (the greatest), length (the least), bucket."""
        return self.read("blocks")

    def ids(self) -> DataFrame:
        return self.documents.select(self.id_col).distinct()

    def of(self, terms: DataFrame) -> DataFrame:
        """terms with the bucket that they lie in."""
        return terms.withColumn("bucket", bucket_of(F.col("term"), self.buckets))

    def read(self, what: str, terms: DataFrame | None = None) -> DataFrame:
        """A row for each entry (blocks) or posting (postings; positions, with these), of terms (bucket, term) alone if given. Up to FEW terms are looked up where rows are read."""
        rows, names = self.rows.where("kind = 'terms'"), None
        if terms is not None:
            rows, names = self.only(rows, terms)
        found = rows.select("bucket", "term", "block", "n", *(["most", "least"] if what == "blocks" else ["id", "tf", "length"]), *(["position"] if what == "positions" else []))
        kind = StructType.fromDDL(f"bucket int, term string, block long, n long, tf long, length long" if what == "blocks" else f"bucket int, term string, block long, id {self.documents.schema[self.id_col].dataType.simpleString()}, tf long, length long" + ", positions array<int>" * (what == "positions"))
        schema = to_arrow_schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = {name: batch.column(name) if name == "bucket" else batch.column(name).flatten() for name in batch.schema.names}
                n, wanted = own["n"].to_numpy(), None if names is None else np.flatnonzero(pc.is_in(own["term"], value_set=names))
                at = np.arange(len(n)) if wanted is None else wanted
                of = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("term")).to_numpy())
                if what == "blocks":
                    out = {"tf": own["most"].take(pa.array(at)), "length": own["least"].take(pa.array(at)), "n": own["n"].take(pa.array(at))}
                else:
                    places = runs(np.cumsum(n) - n, n, at)
                    out = {x: own[x].take(pa.array(places)) for x in ("id", "tf", "length")}
                    if what == "positions":
                        tf = own["tf"].to_numpy()
                        lists = own["position"].take(pa.array(runs(np.cumsum(tf) - tf, tf, places)))
                        out["positions"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf[places])), pa.int32()), lists)
                    at = np.repeat(at, n[at])
                out |= {"term": own["term"].take(pa.array(at)), "block": own["block"].take(pa.array(at)), "bucket": own["bucket"].take(pa.array(of[at]))}
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)

        found = found.mapInArrow(run, kind)
        if what != "blocks":
            found = found.withColumnRenamed("id", self.id_col)
        return found if terms is None or names is not None else found.join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")

    def only(self, rows: DataFrame, terms: DataFrame) -> tuple[DataFrame, pa.Array | None]:
        """Rows of the buckets of terms, and the terms, if there are no more than FEW; else all rows and None."""
        table = terms.select("bucket", "term").distinct().limit(FEW + 1).toArrow().combine_chunks()
        if len(table) > FEW:
            return rows, None
        return rows.where(F.col("bucket").isin(table["bucket"].unique().to_pylist())), pa.concat_arrays([pa.array([], pa.string()), *table["term"].cast(pa.string()).chunks])

    def held(self, terms: DataFrame) -> DataFrame:
        """id, term: which of the terms each document holds."""
        return self.read("postings", self.of(terms)).select(self.id_col, "term")

    def positions(self, wanted: DataFrame) -> DataFrame:
        """id, p, term of the pairs (id, term) that are wanted."""
        wanted = stored(self.of(wanted), "wanted")
        found = self.read("positions", wanted)
        # Before many pairs meet the postings, what no pair names is left out.
        if (named := wanted.select(self.id_col).distinct()).count() <= FEW:
            found = found.join(F.broadcast(named), self.id_col, "left_semi")
        found = found.join(beside(wanted), ["bucket", "term", self.id_col], "left_semi")
        return found.select(self.id_col, F.explode("positions").alias("p"), "term")

    def drop(self) -> None:
        """Deletes the index."""
        drop_folder(self.documents.sparkSession, self.path)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def beside(few: DataFrame) -> DataFrame:
    """few, broadcast unless it has more than FEW rows: what it is joined to then stays where it is read."""
    return F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few


def runs(begin: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of runs `at`, one after the other: run r has n[r] places from begin[r]."""
    many = n[at]
    return np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def in_order(key: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers from 0: two passes over 16 bits, which numpy sorts in linear time, where they suffice."""
    if len(key) == 0 or key.max() >= 1 << 32:
        return np.argsort(key, kind="stable")
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (lexical.TOKEN) of texts in lower case, one after the other, and their number in each text."""
    texts = texts.cast(pa.string())
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    letters = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside, some = IN_WORDS[letters], offsets[:-1][np.diff(offsets) > 0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A word does not go on from one text to the next.
    first[some] = inside[some]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    at = np.append(0, np.cumsum(last - first + 1)).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(letters[inside])), np.diff(np.searchsorted(first, offsets))


def index_rows(texts: DataFrame, id_col: str, text_col: str, analyser: str, buckets: int, block_docs: int) -> DataFrame:
    """The rows of the index (as of row_type) of texts (in lower case), made within partitions; blocks are runs of block_docs documents at most."""
    kind = row_type(texts.schema[id_col].dataType.simpleString())
    schema, english = to_arrow_schema(kind), lexical.check_analyser(analyser) == "english"
    stop = frozenset(lexical.stop_words()) if english else frozenset()

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def lists(cuts: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in parts of whole blocks."""
        step = max(1, len(batch) * AT_ONCE // max(1, batch.nbytes) // block_docs) * block_docs
        return (batch.slice(n, step) for n in range(0, len(batch), step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, stems = TaskContext.get().partitionId() << 32, lru_cache(1 << 17)(stem)
        for batch in (part for whole in batches for part in some(whole)):
            ids, (words, lengths) = batch.column(0), words_of(batch.column(1))
            many = -(-len(ids) // block_docs)
            own = np.arange(many) + first
            first += many
            cuts = np.minimum(np.arange(many + 1) * block_docs, len(ids))
            yield rows(many, kind=pa.array(["documents"] * many), block=lists(np.arange(many + 1), own), id=lists(cuts, ids), length=lists(cuts, lengths))
            coded = words.dictionary_encode()
            terms, of = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
            place = (np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)
            if english:
                stemmed = [None if w in stop else stems(w) for w in terms.to_pylist()]
                number = {t: n for n, t in enumerate(dict.fromkeys(t for t in stemmed if t is not None))}
                of = np.array([number.get(t, -1) for t in stemmed], np.int64)[of] if stemmed else of
                terms, doc, place, of = pa.array(list(number), pa.string()), doc[of >= 0], place[of >= 0], of[of >= 0]
            if not len(of):
                continue
            # By bucket, term, block, document, place: a posting is a run of one term in one document, an entry a run of a term's postings in a block.
            bucket = np.array([zlib.crc32(t) % buckets for t in terms.cast(pa.binary()).to_pylist()])
            by_bucket = in_order(bucket)
            rank = np.empty(len(terms), np.int64)
            rank[by_bucket] = np.arange(len(terms))
            key = rank[of] * many + doc // block_docs
            order = in_order(key)
            doc, key, place = doc[order], key[order], place[order]
            begins = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(key) != 0)))
            doc, key, tf = doc[begins], key[begins], np.diff(np.append(begins, len(place)))
            length, at = lengths[doc], np.flatnonzero(np.append(True, np.diff(key) != 0))
            term, block = by_bucket[key[at] // many], own[key[at] % many]
            by_entry = np.searchsorted(bucket[term], np.arange(buckets + 1))
            by_posting = np.append(at, len(doc))[by_entry]
            made = rows(
                buckets, kind=pa.array(["terms"] * buckets), bucket=pa.array(np.arange(buckets)), term=lists(by_entry, terms.take(pa.array(term))), block=lists(by_entry, block), n=lists(by_entry, np.diff(np.append(at, len(doc)))),
                most=lists(by_entry, np.maximum.reduceat(tf, at)), least=lists(by_entry, np.minimum.reduceat(length, at)), id=lists(by_posting, ids.take(pa.array(doc))), doc=lists(by_posting, doc % block_docs),
                tf=lists(by_posting, tf), length=lists(by_posting, length), position=lists(np.append(begins, len(place))[by_posting], place),
            )
            yield made.filter(pa.array(np.diff(by_entry) > 0))

    small_batches(texts.sparkSession)
    return texts.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, kind)


def row_type(kind: str) -> StructType:
    counts = "n array<int>, most array<int>, least array<int>"
    return StructType.fromDDL(f"kind string, bucket int, term array<string>, block array<long>, {counts}, id array<{kind}>, doc array<int>, tf array<int>, length array<int>, position array<int>")


def build_index(docs: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "search_document", analyser: str = "english", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Writes the index of docs under path (which must not exist) and opens it. Documents without an id are not found by searches; an id that repeats is refused."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias(text_col))
    index_rows(texts, id_col, text_col, analyser, buckets, block_docs).write.option("compression", "zstd").partitionBy("kind", "bucket").parquet(f"{path}/rows")
    known = documents_of(spark.read.schema(row_type(kind)).parquet(f"{path}/rows"), id_col)
    n, total = known.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    spark.createDataFrame([(id_col, kind, analyser, buckets, n, total)], "id_col string, id_type string, analyser string, buckets int, n long, total long").coalesce(1).write.parquet(f"{path}/collection")
    index = open_index(spark, path)
    if not index.documents.groupBy(id_col).count().where("count > 1").isEmpty():
        index.drop()
        raise ValueError(f"{id_col} repeats")
    return index


def documents_of(rows: DataFrame, id_col: str) -> DataFrame:
    found = rows.where("kind = 'documents'").select(F.col("block")[0].alias("block"), F.explode(F.arrays_zip("id", "length")).alias("of"))
    return found.select(F.col("of.id").alias(id_col), F.col("of.length").cast("long").alias("length"), "block")


def open_index(spark: SparkSession, path: str) -> TextIndex:
    of = spark.read.parquet(f"{path}/collection").first()
    rows = spark.read.schema(row_type(of["id_type"])).parquet(f"{path}/rows")
    return TextIndex(path, of["id_col"], of["analyser"], of["buckets"], of["n"], of["total"] / max(1, of["n"]), rows, documents_of(rows, of["id_col"]))


def by_document(index: TextIndex, asked: DataFrame, chosen: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score() of the postings of the terms asked for (query_id, bucket, term, ...), beside their queries, in the blocks chosen for the query (query_id, block); both are stored tables.

    Postings are dealt by document before queries meet them, so that score() may group by query and document without sending the pairs. More than FEW queries' terms or blocks go in several groups of queries.
    """
    id_col, groups = index.id_col, max(1, -(-max(asked.count(), chosen.count()) // FEW))

    def some(asked: DataFrame, chosen: DataFrame) -> DataFrame:
        held = index.read("postings", asked).select("bucket", "term", "block", id_col, "tf", "length").join(beside(chosen.select("block").distinct()), "block", "left_semi")
        return score(held.repartition(id_col).join(beside(asked), ["bucket", "term"]).join(beside(chosen), ["query_id", "block"], "left_semi"))

    if groups == 1:
        return some(asked, chosen)
    own = lambda df, n: df.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == n)
    return reduce(DataFrame.unionByName, [stored(some(own(asked, n), own(chosen, n)), "scored-group") for n in range(groups)])


def floors(scored: DataFrame, k: int) -> DataFrame:
    """query_id, floor: the k-th score of the queries that have k."""
    return top_by(scored, k, F.col("lexical_score").desc()).groupBy("query_id").agg(F.count("*").alias("n"), F.min("lexical_score").alias("floor")).where(F.col("n") == k).drop("n")


def reaching(bounded: DataFrame, floor: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Of bounded (query_id, key, bound) what may still be among the best: not done, and the bound reaches the floor, rounding errors of sums allowed for."""
    left = bounded.join(done, ["query_id", *key], "left_anti").join(floor, "query_id", "left")
    return left.where(F.col("floor").isNull() | (F.col("bound") * F.lit(1 + 1e-9) >= F.col("floor"))).drop("floor")


def by_block(index: TextIndex, asked: DataFrame, names: pa.Array) -> DataFrame:
    """A row for each block with a posting of names (the terms asked for): block, terms (numbers of names), n, doc and tf of their postings, ids and lengths of its documents. Postings are sent once, as arrays."""
    rows = index.only(index.rows.where("kind = 'terms'"), asked)[0].select("term", "block", "n", "doc", "tf")
    kind = StructType.fromDDL("block long, terms array<int>, n array<int>, doc array<int>, tf array<int>")
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {name: batch.column(name).flatten() for name in batch.schema.names}
            number = pc.index_in(own["term"], value_set=names).fill_null(-1).to_numpy()
            block, n = own["block"].to_numpy(), own["n"].to_numpy()
            at = np.flatnonzero(number >= 0)
            at = at[np.argsort(block[at], kind="stable")]
            if not len(at):
                continue
            places, cut = pa.array(runs(np.cumsum(n) - n, n, at)), np.flatnonzero(np.append(True, np.diff(block[at]) != 0))
            by_entry = np.append(cut, len(at))
            by_posting = np.append(0, np.cumsum(n[at]))[by_entry]
            lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            out = (pa.array(block[at][cut]), lists(by_entry, pa.array(number[at])), lists(by_entry, pa.array(n[at])), lists(by_posting, own["doc"].take(places)), lists(by_posting, own["tf"].take(places)))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)

    held = rows.mapInArrow(run, kind)
    known = index.rows.where("kind = 'documents'").select(F.col("block")[0].alias("block"), F.col("id").alias("ids"), F.col("length").alias("lengths"))
    parts = held.unionByName(known, allowMissingColumns=True).groupBy("block")
    whole = parts.agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("terms", "n", "doc", "tf")), F.first("ids", ignorenulls=True).alias("ids"), F.first("lengths", ignorenulls=True).alias("lengths"))
    return whole.where(F.size("terms") > 0)


def bm25(tf, length, mean_length: float, k1: float = K1, b: float = B):
    """The part of a term's weight that depends on the document: it grows with tf and falls with the length."""
    return tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / float(mean_length or 1.0)))


@dataclass(frozen=True)
class Blocks:
    """Queries by number, who meet rows of by_block: query of[j] asks for the term whose range of `at` holds j, which counts idf."""

    at: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    queries: int
    mean_length: float
    k1: float
    b: float

    def slabs(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(low, high, at, of) for queries low to high - 1, numbered from 0."""
        out = []
        for low in range(0, self.queries, SLAB):
            inside = (self.of >= low) & (self.of < low + SLAB)
            out.append((low, min(low + SLAB, self.queries), np.append(0, np.cumsum(inside))[self.at], self.of[inside] - low))
        return out

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(row, terms, n, doc, what each posting adds) of the rows."""
        columns = [batch.column(x) for x in ("terms", "n", "doc", "tf", "lengths")]
        for r in range(len(batch)):
            terms, n, doc, tf, lengths = (c[r].values.to_numpy() for c in columns)
            part = np.repeat(self.idf[terms], n) * bm25(tf.astype(np.float64), lengths[doc].astype(np.float64), self.mean_length, self.k1, self.b)
            yield r, terms, n, doc, np.rint(part * ONE).astype(np.int64)

    @staticmethod
    def bounds(slab: tuple, terms: np.ndarray, n: np.ndarray, part: np.ndarray) -> np.ndarray:
        """What a document of the block can score at most, for each query of the slab: no term adds more than its greatest part."""
        low, high, at, of = slab
        many, most = np.diff(at), np.maximum.reduceat(part, np.cumsum(n) - n)
        out = np.zeros(high - low, np.int64)
        np.add.at(out, of[runs(at[:-1], many, terms)], np.repeat(most, many[terms]))
        return out

    @staticmethod
    def scores(slab: tuple, wanted: np.ndarray, docs: int, terms: np.ndarray, n: np.ndarray, doc: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The scores of all documents of the block (columns) for the wanted queries of the slab (rows)."""
        low, high, at, of = slab
        row = np.full(high - low, -1)
        row[wanted] = np.arange(len(wanted))
        of = row[of]
        at, of = np.append(0, np.cumsum(of >= 0))[at], of[of >= 0]
        many, out, term = np.diff(at), np.zeros(len(wanted) * docs, np.int64), np.repeat(terms, n)
        pairs = np.cumsum(many[term])
        for cut in np.split(np.arange(len(term)), np.flatnonzero(np.diff(pairs // PAIRS)) + 1):
            times = many[term[cut]]
            np.add.at(out, of[runs(at[:-1], many, term[cut])] * docs + np.repeat(doc[cut], times), np.repeat(part[cut], times))
        return out.reshape(len(wanted), docs)


def bm25_search(queries: DataFrame, index: TextIndex, k: int, k1: float = K1, b: float = B, term_limit: int | None = None, digits: int | None = None, seeds: int = SEEDS) -> DataFrame:
    """query_id, id, lexical_score, rank, ranked: the k best documents by BM25 over the distinct terms of every query, any of which suffices; ranked counts the documents that were scored for the query.

    idf = ln(1 + (n - df + 0.5) / (df + 0.5)). Scores equal to `digits` places are ties, which go by id. More than FEW terms asked for, or GROUP queries, go in several groups of queries.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    terms = stored(index.of(lexical.asked_terms(queries, index.analyser, term_limit)).where(F.col("query_id").isNotNull()), "terms")
    n_terms, n_queries = terms.agg(F.count("*"), F.count_distinct("query_id")).first()
    groups = max(1, -(-n_terms // FEW), -(-n_queries // GROUP))
    own = lambda n: terms.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == n) if groups > 1 else terms
    every = [_bm25_group(own(n), index, k, k1, b, digits, seeds) for n in range(groups)]
    return every[0] if groups == 1 else reduce(DataFrame.unionByName, [stored(x, "best-group") for x in every])


def _bm25_group(terms: DataFrame, index: TextIndex, k: int, k1: float, b: float, digits: int | None, seeds: int) -> DataFrame:
    spark, id_col = terms.sparkSession, index.id_col
    table = terms.select("query_id", "term").toArrow().combine_chunks()
    names = table["term"].unique().cast(pa.string())
    held = stored(by_block(index, terms, names), "blocks-asked")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(names), np.int64)
        for batch in batches:
            np.add.at(df, batch.column("terms").flatten().to_numpy(), batch.column("n").flatten().to_numpy())
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(df).astype(np.int32), "n": df[df > 0]})

    df = np.zeros(len(names))
    for term, n in held.select("terms", "n").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    ids = table["query_id"].unique()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    number, of = pc.index_in(table["term"].cast(pa.string()), value_set=names).to_numpy(), pc.index_in(table["query_id"], value_set=ids).to_numpy()
    order = np.lexsort((of, number))
    at = np.searchsorted(number[order], np.arange(len(names) + 1))
    met = Blocks(at, of[order], np.log(1 + (index.n_docs - df + 0.5) / (df + 0.5)), len(ids), index.mean_length, k1, b)

    # The most promising blocks of every query.
    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs = met.slabs()
        for batch in batches:
            for r, terms, n, _, part in met.parts(batch):
                for slab in slabs:
                    bound = met.bounds(slab, terms, n, part)
                    q = np.flatnonzero(bound)
                    yield pa.RecordBatch.from_pydict({"query_id": (q + slab[0]).astype(np.int32), "block": np.repeat(batch.column("block")[r].as_py(), len(q)), "bound": bound[q]})

    columns = ("block", "terms", "n", "doc", "tf", "lengths")
    first = top_by(held.select(*columns).mapInArrow(promising, "query_id int, block long, bound long"), seeds, F.col("bound").desc(), "block", rank="place").select("query_id", "block").toArrow()
    done: dict[int, list[int]] = {}
    for q, block in zip(first["query_id"].to_pylist(), first["block"].to_pylist()):
        done.setdefault(block, []).append(q)
    slack, kind = 0.0 if digits is None else 1.01 * 10.0**-digits, StructType.fromDDL(f"query_id int, id {index.documents.schema[id_col].dataType.simpleString()}, lexical_score double, ranked long")
    schema = to_arrow_schema(kind)

    def exact(floor: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Scores the first blocks (no floor), or of the others those whose bound reaches the floor, less what rounding may add. Each task passes on what may be among its k best, and in rows without an id how many documents it scored."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slabs, ranked = met.slabs(), np.zeros(met.queries, np.int64)
            least, found, waiting = np.full(met.queries, -np.inf) if floor is None else floor.copy(), [], 0
            for batch in batches:
                for r, terms, n, doc, part in met.parts(batch):
                    own, ids = np.array(done.get(batch.column("block")[r].as_py(), []), np.int64), batch.column("ids")[r].values
                    for slab in slabs:
                        low, high = slab[:2]
                        seeded = own[(own >= low) & (own < high)] - low
                        wanted = seeded
                        if floor is not None:
                            bound = met.bounds(slab, terms, n, part)
                            reach = (bound > 0) & (bound / ONE >= floor[low:high] - slack)
                            reach[seeded] = False
                            wanted = np.flatnonzero(reach)
                        if not len(wanted):
                            continue
                        score = met.scores(slab, wanted, len(ids), terms, n, doc, part)
                        ranked[low + wanted] += (score > 0).sum(axis=1)
                        score = score.astype(np.float64) / ONE
                        if len(ids) >= k:
                            least[low + wanted] = np.maximum(least[low + wanted], np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
                        row, column = np.nonzero((score > 0) & (score >= (least[low + wanted] - slack)[:, None]))
                        found.append((low + wanted[row], ids.take(pa.array(column)), score[row, column]))
                        waiting += len(row)
                    if waiting > 4 * k * met.queries + PAIRS:
                        found = [best(found, least)]
                        waiting = len(found[0][0])
            if found:
                q, ids, score = best(found, least)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.cast(schema.field("id").type), pa.array(score), pa.nulls(len(q), pa.int64())], schema=schema)
            q = np.flatnonzero(ranked)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.nulls(len(q), schema.field("id").type), pa.nulls(len(q), pa.float64()), pa.array(ranked[q])], schema=schema)

        return run

    def best(found: list[tuple], least: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """What may be among the k best of each query, which make `least` rise: ties, also those by rounding, all stay."""
        q, score = (np.concatenate([x[n] for x in found]) for n in (0, 2))
        order = np.lexsort((-score, q))
        begin = np.searchsorted(q[order], np.arange(len(least) + 1))
        full = np.flatnonzero(np.diff(begin) >= k)
        least[full] = np.maximum(least[full], score[order][begin[full] + k - 1])
        keep = np.flatnonzero(score >= least[q] - slack)
        return q[keep], pa.concat_arrays([x[1] for x in found]).take(pa.array(keep)), score[keep]

    small_batches(spark)
    columns = (*columns, "ids")
    seeded = held.join(F.broadcast(spark.createDataFrame([(x,) for x in done], "block long")), "block", "left_semi")
    scored = stored(seeded.select(*columns).mapInArrow(exact(None), kind), "scored-first")
    floor = np.full(met.queries, -np.inf)
    for q, least in floors(scored.where("ranked IS NULL"), k).collect():
        floor[q] = least
    every = stored(scored.unionByName(held.select(*columns).mapInArrow(exact(floor), kind)), "scored")
    ranked = every.groupBy("query_id").agg(F.sum("ranked").alias("ranked"))
    top = top_by(every.where("ranked IS NULL").drop("ranked").withColumnRenamed("id", id_col), k, lexical.by_score(digits), id_col).join(F.broadcast(ranked), "query_id")
    asked = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(ids)), pa.int32()), "asked": ids}))
    return top.withColumnRenamed("query_id", "number").join(beside(asked), "number").select(F.col("asked").cast(terms.schema["query_id"].dataType).alias("query_id"), id_col, "lexical_score", "rank", "ranked")


def cover_topk(queries: DataFrame, index: TextIndex, k: int, term_limit: int | None = None, digits: int | None = None) -> DataFrame:
    """lexical.cover_search with an early end, and ranked: the number of documents whose covers were found for the query.

    Minimal covers of m terms end in different places, and none in the first m - 1 of the terms' places: a document has at most their number less m - 1 of them, each worth
    0.1 at most. A block that lacks a term holds no match.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    id_col = index.id_col
    terms = stored(index.of(lexical.asked_terms(queries, index.analyser, term_limit)), "terms")
    many = terms.groupBy("query_id").agg(F.count("*").alias("m"))
    there = index.read("blocks", terms).select("bucket", "term", "block").join(beside(terms), ["bucket", "term"]).groupBy("query_id", "block").agg(F.count("*").alias("there"))
    whole = stored(there.join(many, "query_id").where("there = m").select("query_id", "block"), "whole-blocks")
    places = by_document(index, terms, whole, lambda held: held.groupBy("query_id", id_col).agg(F.count("*").alias("there"), F.sum("tf").alias("places")))
    places = places.join(beside(many), "query_id").where("there = m")
    bounded = stored(places.select("query_id", id_col, (F.lit(0.1) * (F.col("places") - F.col("m") + 1)).alias("bound")), "bounds")

    def exact(chosen: DataFrame) -> DataFrame:
        asked = chosen.select("query_id", id_col).join(terms, "query_id")
        found = index.positions(asked.select(id_col, "term").distinct())
        return lexical.rank_covers(asked.join(found, [id_col, "term"]).select("query_id", id_col, "p", "term"), terms, id_col)

    first = top_by(bounded, k, F.col("bound").desc(), id_col, rank="place")
    return _in_two_steps(bounded, first, exact, [id_col], k, digits, id_col)


def _in_two_steps(bounded: DataFrame, first: DataFrame, exact, key: list[str], k: int, digits: int | None, id_col: str) -> DataFrame:
    """The k best of what `exact` scores: of `first`, then of what can still reach their floor. With digits, the floor is lowered by what rounding may add."""
    first = stored(first.select("query_id", *key), "seeds")
    scored = stored(exact(first), "scored-first")
    slack = 0.0 if digits is None else 10.0**-digits
    floor = floors(scored, k).withColumn("floor", F.col("floor") - F.lit(slack))
    rest = exact(stored(reaching(bounded, floor, first, key), "left"))
    every = stored(scored.unionByName(rest), "scored")
    ranked = every.groupBy("query_id").agg(F.count("*").alias("ranked"))
    return top_by(every, k, lexical.by_score(digits), id_col).join(ranked, "query_id")
