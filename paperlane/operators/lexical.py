"""Full-text search: analysis, postings, web-style queries, matching and cover-density ranking.

The `simple` analyser lower-cases and takes runs of [a-z0-9]; `english` also drops stop words and stems (Porter, 1980) the
distinct vocabulary. Searches first find out which documents hold which of the terms asked for, then which documents can match, and only then
read positions, of those terms in those documents. Both come from a source: texts that are read anew (Texts), or a stored index (text_index.TextIndex). Ranking is of the cover-density family (Clarke, Cormack and Tudhope, 2000): the sum over minimal
covers of 0.1 / (1 + words in the cover that are no query terms). Scores are those of this definition, not of any server.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlane.functions.porter import stem
from paperlane.operators.vector import top_by
from paperlane.plans.stored import stored

TOKEN = "[a-z0-9]+"


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, position (from 1, stop words counted), token."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0))
    return docs.select(id_col, F.posexplode(words).alias("p", "term")).withColumn("p", F.col("p") + 1)


def stemmed(words: Column) -> Column:
    """Stems by a function that Spark may not repeat, nor move below the `distinct` of its input."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return stems.asNondeterministic()(words)


def vocabulary(found: DataFrame) -> DataFrame:
    """term, stem of the distinct tokens that are no stop words. They are few bytes and much work, so they are dealt over all cores."""
    words = found.select("term").distinct().where(~F.col("term").isin(stop_words()))
    return words.repartition(found.sparkSession.sparkContext.defaultParallelism, "term").withColumn("stem", stemmed(F.col("term")))


def check_analyser(analyser: str) -> str:
    if analyser not in ("simple", "english"):
        raise ValueError(f"unknown analyser: {analyser}")
    return analyser


def analyse(found: DataFrame, analyser: str = "simple") -> DataFrame:
    """Tokens to terms. The stemmer sees each distinct token once; its table joins back by token, as Spark sees fit."""
    if check_analyser(analyser) == "simple":
        return found
    return found.join(vocabulary(found), "term").drop("term").withColumnRenamed("stem", "term")


class Texts:
    """Documents that are read anew: once for the terms that they hold, and those that may match once more for positions."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, analyser: str = "simple"):
        self.docs, self.id_col, self.text_col, self.analyser, self.stems = docs, id_col, text_col, check_analyser(analyser), None

    def ids(self) -> DataFrame:
        return self.docs.select(self.id_col).distinct()

    def held(self, terms: DataFrame) -> DataFrame:
        """id, term: which of the terms each document holds."""
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(self.text_col)), F.lit(TOKEN), F.lit(0)))
        found = self.docs.select(self.id_col, F.explode(words).alias("term"))
        if self.analyser == "simple":
            return found.join(terms, "term", "left_semi").distinct()
        # The tokens of the terms asked for, as a table of its own, whose size Spark knows when it plans the joins with it.
        self.stems = stored(vocabulary(found).join(terms.select(F.col("term").alias("stem")), "stem", "left_semi").select("term", "stem"), "stems")
        return found.join(self.stems, "term").select(self.id_col, F.col("stem").alias("term")).distinct()

    def positions(self, wanted: DataFrame) -> DataFrame:
        """id, p, term of the pairs (id, term) that are wanted; terms as given to held()."""
        found = tokens(self.docs.join(wanted.select(self.id_col).distinct(), self.id_col, "left_semi"), self.id_col, self.text_col)
        if self.stems is not None:
            found = found.join(self.stems, "term").select(self.id_col, "p", F.col("stem").alias("term"))
        return found.join(wanted, [self.id_col, "term"], "left_semi")


def stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w for x in StopWordsRemover.loadDefaultStopWords("english") for w in [x, *re.findall(TOKEN, x)]})


def postings(docs: DataFrame, id_col: str, text_col: str, analyser: str = "simple") -> DataFrame:
    """id, term, positions: the inverted index, to be written sorted by term."""
    return analyse(tokens(docs, id_col, text_col), analyser).groupBy(id_col, "term").agg(F.array_sort(F.collect_list("p")).alias("positions"))


@dataclass(frozen=True)
class Clause:
    """Alternatives, each a phrase of one term or more; negated clauses forbid."""

    phrases: tuple[tuple[str, ...], ...]
    negated: bool = False
    #: Where each phrase's terms stand from its first; stop words between them leave gaps.
    offsets: tuple[tuple[int, ...], ...] = field(default=(), compare=False)


def parse_query(text: str, analyser: str = "simple", stop: frozenset[str] | None = None) -> list[Clause]:
    """Web syntax: terms are all required, "..." is a phrase, `or` joins its neighbours, a leading - forbids."""
    if stop is None:
        stop = frozenset(stop_words()) if analyser == "english" else frozenset()
    parts: list[tuple[bool, tuple[str, ...], tuple[int, ...]] | None] = []
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text):
        raw, negated = (m[2], bool(m[1])) if m[2] is not None else (m[3], m[3].startswith("-"))
        if m[3] is not None and raw.lower() == "or":
            parts.append(None)
            continue
        kept = [(i, t) for i, t in enumerate(re.findall(TOKEN, raw.lower())) if t not in stop]
        if kept:
            parts.append((negated, tuple(stem(t) if analyser == "english" else t for _, t in kept), tuple(i - kept[0][0] for i, _ in kept)))
    clauses: list[Clause] = []
    joined = False
    for part in parts:
        if part is None:
            joined = bool(clauses)
        elif joined and not part[0] and not clauses[-1].negated:
            clauses[-1] = Clause((*clauses[-1].phrases, part[1]), False, (*clauses[-1].offsets, part[2]))
            joined = False
        else:
            clauses.append(Clause((part[1],), part[0], (part[2],)))
            joined = False
    return clauses


def query_terms(queries: DataFrame, text_col: str = "query", limit: int | None = None) -> DataFrame:
    """query_id, term: the distinct simple terms of every query (its first `limit`), all required."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0)))
    return queries.select("query_id", F.explode(F.slice(words, 1, limit) if limit else words).alias("term"))


def match_all(held: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """query_id, id of documents that hold every term of the query; held: id, term. A query looks only at documents that hold its rarest term."""
    asked = terms.join(held.groupBy("term").agg(F.count("*").alias("held")), "term", "left")
    rare = asked.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "term")).alias("rarest"))
    start = rare.where("rarest.held > 0").select("query_id", "n", F.col("rarest.term").alias("term")).join(held, "term").select("query_id", "n", id_col)
    every = start.join(terms, "query_id").join(held, [id_col, "term"]).groupBy("query_id", id_col, "n").agg(F.count("*").alias("m"))
    return every.where("m = n").select("query_id", id_col)


def cover_noise(places: Column, terms: Column, n: Column) -> Column:
    """For each minimal cover of n terms, ascending, how many words in it are no query terms. places are in order; one sweep, whose oldest last place is a cover's start."""

    @F.pandas_udf("array<long>")
    def noise(places: pd.Series, terms: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([sorted(_sweep(list(p), list(t), k)) for p, t, k in zip(places, terms, n)])

    return noise(places, terms, n)


def _sweep(places: list[int], terms: list[str], n: int) -> Iterator[int]:
    last: dict[str, tuple[int, int]] = {}
    started, nth = -1, 0
    for i, (p, term) in enumerate(zip(places, terms)):
        last.pop(term, None)
        last[term] = (p, nth)
        if i + 1 < len(places) and places[i + 1] == p:
            continue  # terms in one place are taken together
        if len(last) == n:
            start, first = next(iter(last.values()))
            if start > started:
                started = start
                yield (p - start) - (nth - first)
        nth += 1


def rank_covers(hits: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """query_id, id, covers, lexical_score; hits: query_id, id, p, term where the terms stand in the documents that match."""
    wanted = terms.groupBy("query_id").agg(F.count_distinct("term").alias("n"))
    # Few bytes and much work again: one exchange, over all cores.
    hits = hits.repartition(hits.sparkSession.sparkContext.defaultParallelism, "query_id", id_col)
    at = hits.groupBy("query_id", id_col).agg(F.array_sort(F.collect_set(F.struct("p", "term"))).alias("at")).join(wanted, "query_id")
    found = at.select("query_id", id_col, cover_noise(F.col("at.p"), F.col("at.term"), F.col("n")).alias("noise")).where(F.size("noise") > 0)
    # Summed in a fixed order, so that equal texts get equal scores.
    score = F.aggregate("noise", F.lit(0.0), lambda a, x: a + F.lit(0.1) / (F.lit(1.0) + x))
    return found.select("query_id", id_col, F.size("noise").cast("long").alias("covers"), score.alias("lexical_score"))


def by_score(digits: int | None) -> Column:
    """Descending scores; with `digits`, scores equal to so many places are ties."""
    return (F.col("lexical_score") if digits is None else F.round("lexical_score", digits)).desc()


def cover_search(queries: DataFrame, source, k: int, term_limit: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, id, covers, lexical_score, rank for queries whose terms are all required, from a source; `digits` as in by_score."""
    if k < 1:
        raise ValueError("lexical_k must be at least 1")
    terms = stored(asked_terms(queries, source.analyser, term_limit), "terms")
    held = stored(source.held(terms.select("term").distinct()), "held")
    match = stored(match_all(held, terms, source.id_col), "matches")
    asked = match.join(terms, "query_id")
    found = source.positions(asked.select(source.id_col, "term").distinct())
    scored = rank_covers(asked.join(found, [source.id_col, "term"]).select("query_id", source.id_col, "p", "term"), terms, source.id_col)
    return top_by(scored, k, by_score(digits), source.id_col)


def asked_terms(queries: DataFrame, analyser: str, term_limit: int | None = None) -> DataFrame:
    """query_id, term: the distinct terms of every query."""
    terms = query_terms(queries, limit=term_limit)
    return analyse(terms, analyser).distinct() if check_analyser(analyser) == "english" else terms


def lexical_search(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "search_document", analyser: str = "simple", term_limit: int | None = None, digits: int | None = None) -> DataFrame:
    """cover_search over texts."""
    return cover_search(queries, Texts(docs, id_col, text_col, analyser), k, term_limit, digits)


def web_search(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "search_document", analyser: str = "english", digits: int | None = None) -> DataFrame:
    """web_query_search over texts."""
    return web_query_search(queries, Texts(docs, id_col, text_col, analyser), k, digits)


def web_query_search(queries: DataFrame, source, k: int, digits: int | None = None) -> DataFrame:
    """query_id, id, covers, lexical_score, rank for web-style queries, from a source: what web_match selects, ranked by covers of the clauses.

    A clause stands wherever one of its phrases begins. A query of forbidden clauses alone selects with score 0; one without terms selects nothing.
    """
    if k < 1:
        raise ValueError("lexical_k must be at least 1")
    id_col, analyser = source.id_col, source.analyser
    stop = frozenset(stop_words()) if analyser == "english" else frozenset()

    @F.udf("array<struct<clause:int,phrase:int,negated:boolean,terms:array<string>,offsets:array<int>>>")
    def parsed(text):
        clauses = parse_query(text or "", analyser, stop)
        return [(c, n, x.negated, list(x.phrases[n]), list(x.offsets[n])) for c, x in enumerate(clauses) for n in range(len(x.phrases))]

    phrases = queries.select("query_id", "query").distinct().select("query_id", F.explode(parsed("query")).alias("c")).select("query_id", "c.*")
    phrases = stored(phrases.withColumn("key", F.to_json(F.struct("query_id", "clause"))), "phrases")
    words = phrases.withColumn("n", F.size("terms")).withColumn("w", F.explode(F.arrays_zip("terms", "offsets"))).select("query_id", "key", "phrase", "negated", "n", F.col("w.terms").alias("term"), F.col("w.offsets").alias("i"))
    held = stored(source.held(words.select("term").distinct()), "held")
    wanted = phrases.where(~F.col("negated")).select("query_id", F.col("key").alias("term")).distinct()
    alone = phrases.groupBy("query_id").agg(F.min("negated").alias("negated")).where("negated").select("query_id")
    # What may match: for queries with wanted clauses, documents that hold all words of a phrase of each; for the others, those with a forbidden word.
    near = may_match(words.where(~F.col("negated")), wanted, held, id_col)
    near = near.unionByName(words.join(alone, "query_id", "left_semi").join(held, "term").select("query_id", id_col).distinct())
    asked = stored(near.join(words, "query_id").join(held, [id_col, "term"]), "candidates")
    found = source.positions(asked.select(id_col, "term").distinct())
    met = asked.join(found, [id_col, "term"])
    at = met.groupBy("query_id", "key", "phrase", "negated", "n", id_col, (F.col("p") - F.col("i")).alias("p")).agg(F.count("*").alias("held")).where("held = n")
    at = stored(at.select("query_id", "key", "negated", id_col, "p"), "clauses")
    stands = at.where(~F.col("negated")).select("query_id", id_col, "p", F.col("key").alias("term")).distinct()
    forbidden = at.where("negated").select("query_id", id_col).distinct()
    scored = rank_covers(stands, wanted, id_col).join(forbidden, ["query_id", id_col], "left_anti")
    every = unmet(alone, source.ids(), forbidden, k, id_col).select("query_id", id_col, F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("lexical_score"))
    return top_by(scored.unionByName(every), k, by_score(digits), id_col)


def may_match(words: DataFrame, wanted: DataFrame, held: DataFrame, id_col: str) -> DataFrame:
    """query_id, id of documents that hold, for each clause, all words of one of its phrases. A query looks only at documents with the rarest words of its rarest clause."""
    sought = words.join(held.groupBy("term").agg(F.count("*").alias("held")), "term", "left")
    rare = sought.groupBy("query_id", "key", "phrase").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "term")).alias("rarest"))
    clauses = rare.groupBy("query_id", "key").agg(F.sum("rarest.held").alias("held"), F.collect_set("rarest.term").alias("start"))
    first = clauses.groupBy("query_id").agg(F.min(F.struct("held", "key", "start")).alias("c")).select("query_id", F.explode("c.start").alias("term"))
    near = first.join(held, "term").select("query_id", id_col).distinct()
    different = words.groupBy("query_id", "key", "phrase").agg(F.count_distinct("term").alias("m"))
    own = near.join(words.select("query_id", "key", "phrase", "term").distinct(), "query_id").join(held, [id_col, "term"])
    whole = own.groupBy("query_id", id_col, "key", "phrase").agg(F.count("*").alias("there")).join(different, ["query_id", "key", "phrase"]).where("there = m")
    of = wanted.groupBy("query_id").agg(F.count("*").alias("clauses"))
    return whole.groupBy("query_id", id_col).agg(F.count_distinct("key").alias("met")).join(of, "query_id").where("met = clauses").select("query_id", id_col)


def unmet(alone: DataFrame, ids: DataFrame, hit: DataFrame, k: int, id_col: str) -> DataFrame:
    """query_id, id: at least the k smallest ids (or all) that are no hit, of every query in alone. Their scores are equal, so no other can be among the first k.

    Looks at the first ids alone, at more of them only while some query has fewer than k left.
    """
    if alone.isEmpty():
        return hit.limit(0)
    total, reach = ids.count(), 4 * k
    while True:
        some = stored(ids.orderBy(id_col).limit(reach), "first-ids")
        left = alone.crossJoin(some).join(hit, ["query_id", id_col], "left_anti")
        short = alone.join(left.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
        if reach >= total or short.isEmpty():
            return left
        reach *= 8


def web_match(docs: DataFrame, query: str, id_col: str = "chunk_id", text_col: str = "search_document", analyser: str = "simple") -> DataFrame:
    """ids that satisfy one web-style query: every clause, phrases at consecutive positions, no forbidden clause."""
    found = analyse(tokens(docs, id_col, text_col), analyser)
    out = docs.select(id_col).distinct()
    clauses = parse_query(query, analyser)
    if not any(not c.negated for c in clauses):
        return out.limit(0) if not clauses else _without(out, found, clauses, id_col)
    for clause in clauses:
        if not clause.negated:
            out = out.join(_clause_ids(found, clause, id_col), id_col, "left_semi")
    return _without(out, found, clauses, id_col)


def _without(out: DataFrame, found: DataFrame, clauses: list[Clause], id_col: str) -> DataFrame:
    for clause in clauses:
        if clause.negated:
            out = out.join(_clause_ids(found, clause, id_col), id_col, "left_anti")
    return out


def _clause_ids(found: DataFrame, clause: Clause, id_col: str) -> DataFrame:
    ids = None
    for phrase, offsets in zip(clause.phrases, clause.offsets):
        at = None
        for i, term in zip(offsets, phrase):
            own = found.where(F.col("term") == term).select(id_col, (F.col("p") - i).alias("start")).distinct()
            at = own if at is None else at.join(own, [id_col, "start"], "left_semi")
        one = at.select(id_col).distinct()
        ids = one if ids is None else ids.union(one)
    return ids.distinct()
