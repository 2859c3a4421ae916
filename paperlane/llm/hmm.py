"""Hidden Markov language model: Baum-Welch counts summed over partitions, scaled forward recursion for exact likelihoods.

Tokens are white-space separated (ASCII white space), with A-Z lower-cased, then one end token. A state emits one of the HEAD most frequent words
of the training rows, the end, or one of GROUPS groups of other words; a group is a function of a word's spelling, and
within a group a word has probability (c + 1) / (n + v + 1), c its count, n and v the group's tokens and words in
training. That factor does not depend on the state, so the forward recursion runs over the bounded alphabet, and the factor, which
needs every word's count, comes from a join with the whole table of counts. The product is the exact likelihood of the text.

Training is Baum-Welch over all training rows, incrementally (Neal and Hinton, 1998): rows are dealt by a hash over PARTS parts, and after
each part's expected counts, summed over partitions, replace what that part gave before, the parameters are set anew from the
counts of all parts. Each such step raises the free energy (a lower bound of the log likelihood of all rows, and the log of the pull on
the parameters), so that one pass over the rows does the work of several; passes go on until one raises it by less than
TOLERANCE nats a token. Texts are spelt once and passes are made over the letters. A part is as large a share of the rows at every
size, and is spread over the whole cluster.

Null text is empty: one token, the end. Rows with null ids are in fold 0. Repeated rows are scored (and learnt from) each. Without training rows all counts are 0
and the model is uniform. Very long texts are scored whole; ties in the choice of the head go by a hash of the word. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlane.llm.common import cut, fold, small_batches

STATES, HEAD, GROUPS, TOLERANCE, PARTS = 8, 32_768, 1024, 1e-4, 4
#: Letters of a batch of sequences (some 100 bytes each); documents a worker gathers to make such batches; words it counts before it sends them on.
CELLS, GATHER, FLUSH = 1 << 19, 8192, 300_000
#: Rows that are split or numbered in Arrow at once.
SLICE = 1024
#: Letters whose counts travel in one row.
BLOCK = 2048
#: Letters of a sequence that the recursions take one after the other; the spans of a longer one go side by side.
SPAN = 2048
#: Letters whose emissions are counted at once.
COUNTED = 1 << 16
STICKY, PULL = 0.95, 20.0


def tokens(text: str | None) -> list[bytes]:
    """bytes.split parts at \\x20 and \\x09-\\x0D; bytes.lower changes A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def group_of(word: bytes) -> int:
    return crc32(word[:2] + b"|" + word[-2:]) % GROUPS


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens() of all texts at once (none may be null): the words (binary), and where each text's begin, with their end."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = found.flatten().cast(pa.binary())
    # Blanks at a text's ends leave empty words.
    full = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return words.filter(full), before[found.offsets.to_numpy()]


def groups_of(words: pa.Array) -> np.ndarray:
    """group_of() all words."""
    ends = pc.binary_join_element_wise(pc.binary_slice(words, 0, 2), pc.binary_slice(words, -2, None), b"|").dictionary_encode()
    return np.array([crc32(e) % GROUPS for e in ends.dictionary.to_pylist()], np.int32)[ends.indices.to_numpy()]


class Numbers(dict):
    """Letters of head words; any other word's is its group."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word[:2] + b"|" + word[-2:]) % GROUPS


class Alphabet:
    """Letters 0..GROUPS-1 are groups, GROUPS the end, then the head words."""

    def __init__(self, head: list[bytes]):
        self.number = Numbers((w, GROUPS + 1 + i) for i, w in enumerate(head))
        self.size = GROUPS + 1 + len(head)
        self.head = pa.array(head, pa.binary())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The letters of words."""
        place = pc.index_in(words, value_set=self.head)
        out = pc.fill_null(place, -1).to_numpy() + np.int32(GROUPS + 1)
        out[place.is_null().to_numpy(zero_copy_only=False)] = groups_of(words.filter(place.is_null()))
        return out

    def spell_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """spell() of all texts (none may be null): letters (bytes of 32-bit integers), distinct words outside the head, and how often each occurs in its text."""
        words, begins = words_of(texts)
        distinct = words.dictionary_encode()
        index, n = distinct.indices.to_numpy(), len(texts)
        letters = self.numbers(distinct.dictionary)[index]
        spelt = np.insert(letters, begins[1:], np.int32(GROUPS))
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((begins + np.arange(n + 1)) * 4).astype(np.int32)), pa.py_buffer(spelt)])
        at = np.flatnonzero(letters < GROUPS)
        of, size = np.repeat(np.arange(n), np.diff(begins))[at], max(1, len(distinct.dictionary))
        pairs, times = np.unique(of * size + index[at], return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * size), pa.int32())
        return data, pa.ListArray.from_arrays(ends, distinct.dictionary.take(pa.array(pairs % size))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The letters of a text with its end, and its words outside the head."""
        letters = np.fromiter(chain(map(self.number.__getitem__, words), (GROUPS,)), np.int32, len(words) + 1)
        return letters, [words[n] for n in np.flatnonzero(letters < GROUPS).tolist()]


class Parameters:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, kind: type = np.float64):
        """start: K; move: K x K; emit: letters x K, float64. kind: of the numbers that recursions work with."""
        self.start, self.move, self.emit = start, move, emit
        #: A letter's states lie side by side, so that what a time takes of an array is one piece of memory.
        self.by_letter, self.first, self.onward, self.back = (np.ascontiguousarray(x, kind) for x in (emit, start, move, move.T))
        #: A product with it gives the sum of a row in each of its columns.
        self.ones = np.ones_like(self.onward)


def _batches(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of CELLS letters together (or one), longest first: their indices, their letters ordered by time and then by sequence, how many sequences go on at each time, and where each time begins."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    ends = np.cumsum([len(seqs[i]) for i in order])
    at, before = 0, 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
        own, before = order[at:to], int(ends[to - 1])
        at = to
        lengths = np.array([len(seqs[i]) for i in own])
        active = len(own) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        begins = np.append(0, np.cumsum(active))
        x = np.empty(begins[-1], np.int32)
        place = begins[np.arange(begins[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
        place += np.repeat(np.arange(len(own)), lengths)
        x[place] = np.concatenate([seqs[i] for i in own])
        del place
        yield own, x, active, begins


class Spans:
    """Sequences cut into spans of SPAN letters, as rows of a batch like whole ones. The states before a span are all that it shares with the letters before. The states after a first span
    are those of the forward recursion, and what a last span makes of each state before it is that of the backward recursion; between them a span's product of moves and
    emissions (its likelihood from each state before it to each state after) is made beside the others', and the products, one after the other, give what
    the recursions would have come to at each cut. Nothing is left out: the probabilities are those of the whole sequence."""

    def __init__(self, p: Parameters, seqs: list[np.ndarray], back: bool = True):
        """back: whether what follows each span is needed too."""
        parts = np.array([-(-len(s) // SPAN) for s in seqs], int)
        #: The spans, the sequence of each, and which of them go on with one.
        self.seqs = [s[k : k + SPAN] for s in seqs for k in range(0, len(s), SPAN)]
        self.of = np.repeat(np.arange(len(seqs)), parts)
        self.later = np.append(False, self.of[1:] == self.of[:-1])[: len(self.of)]
        goes_on = np.append(self.later[1:], False)[: len(self.of)]
        states, n = len(p.first), len(self.seqs)
        #: States before a span's first letter, what follows its last (beta), and states after it, where another span follows.
        self.first, self.last, self.after = np.tile(p.first, (n, 1)), np.ones((n, states), p.first.dtype), np.zeros((n, states))
        head, middle, tail = (np.flatnonzero(x) for x in (~self.later & goes_on, self.later & goes_on, self.later & ~goes_on))
        self.after[head] = _states_after(p, [self.seqs[i] for i in head.tolist()])
        ends, weights = _products(p, [self.seqs[i] for i in middle.tolist()])
        place, onward = {i: k for k, i in enumerate(middle.tolist())}, p.onward.astype(float)
        for i in np.flatnonzero(self.later).tolist():
            self.first[i] = self.after[i - 1] @ onward
            if (k := place.get(i)) is not None:
                now = (weights[k] * self.after[i - 1]) @ ends[k]
                self.after[i] = now / now.sum()
        if back:
            follows = dict(zip(tail.tolist(), _states_before(p, [self.seqs[i] for i in tail.tolist()])))
            for i in np.flatnonzero(self.later)[::-1].tolist():
                given = follows[i] if i in follows else weights[place[i]] * (ends[place[i]] @ self.last[i])
                self.last[i - 1] = given / (given @ self.after[i - 1])


def _states_after(p: Parameters, seqs: list[np.ndarray]) -> np.ndarray:
    """The states after each sequence (sequences x states); all are equally long."""
    out = np.empty((len(seqs), len(p.first)))
    for own, x, active, begins in _batches(seqs):
        now, at = None, begins.tolist()
        for t in range(len(active)):
            now = (np.tile(p.first, (len(own), 1)) if now is None else now @ p.onward) * p.by_letter.take(x[at[t] : at[t + 1]], axis=0)
            now /= now @ p.ones
        out[own] = now
    return out


def _states_before(p: Parameters, seqs: list[np.ndarray]) -> np.ndarray:
    """The likelihood of each sequence from each state before it (sequences x states), up to a factor of the sequence."""
    out = np.empty((len(seqs), len(p.first)))
    for own, x, active, begins in _batches(seqs):
        beta, at = np.ones((len(own), len(p.first)), p.first.dtype), begins.tolist()
        for t in range(len(active) - 1, -1, -1):
            a, b = at[t], at[t + 1]
            now = p.by_letter.take(x[a:b], axis=0) * beta[: b - a]
            now /= now @ p.ones
            np.matmul(now, p.back, out=beta[: b - a])
        out[own] = beta
    return out


def _products(p: Parameters, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """States after each sequence from each state before it (sequences x states before x states after), and its likelihood from each state before it (sequences x states), up to a factor of the sequence; all are equally long."""
    states = len(p.first)
    ends, weights = np.empty((len(seqs), states, states)), np.empty((len(seqs), states))
    for own, x, active, begins in _batches(seqs):
        # A sequence has a row for each state before it.
        now, logs, at = np.tile(np.eye(states, dtype=p.first.dtype), (len(own), 1)), np.zeros(len(own) * states), begins.tolist()
        for t in range(len(active)):
            now = now @ p.onward
            now *= p.by_letter.take(x[at[t] : at[t + 1]], axis=0).repeat(states, axis=0)
            scale = now @ p.ones
            now /= scale
            logs += np.log(scale[:, 0], dtype=np.float64)
        logs = logs.reshape(-1, states)
        ends[own], weights[own] = now.reshape(-1, states, states), np.exp(logs - logs.max(axis=1, keepdims=True))
    return ends, weights


def _forward(p: Parameters, x: np.ndarray, active: np.ndarray, begins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities and emissions, divided by the scales (letters x states), and scales, of a batch; first: the states before each sequence."""
    emitted = p.by_letter.take(x, axis=0)
    alpha, scales, sums = np.empty_like(emitted), np.empty(len(x), emitted.dtype), np.empty_like(first)
    # One sequence after the next: what the loop calls works on every sequence that goes on.
    at = begins.tolist()
    for t in range(len(active)):
        a, b = at[t], at[t + 1]
        now, emission, scale = alpha[a:b], emitted[a:b], sums[: b - a]
        if t:
            np.matmul(before[: b - a], p.onward, out=now)
        else:
            now[:] = first
        now *= emission
        np.matmul(now, p.ones, out=scale)
        now /= scale
        emission /= scale
        scales[a:b] = scale[:, 0]
        before = now
    return alpha, emitted, scales


def log10_likelihood(p: Parameters, seqs: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion over every letter; of the probabilities only those of one time are held."""
    spans = Spans(p, seqs, back=False)
    logs = np.zeros(len(spans.seqs))
    for own, x, active, begins in _batches(spans.seqs):
        scales, at, alpha = np.empty(len(x)), begins.tolist(), None
        for t in range(len(active)):
            a, b = at[t], at[t + 1]
            now = alpha[: b - a] @ p.onward if t else spans.first[own]
            alpha = now * p.by_letter.take(x[a:b], axis=0)
            scale = alpha @ p.ones
            alpha /= scale
            scales[a:b] = scale[:, 0]
        of = np.arange(len(x)) - np.repeat(begins[:-1], active)
        logs[own] = np.bincount(of, np.log10(scales), len(own))
    return np.bincount(spans.of, logs, len(seqs))


class Expected:
    """Expected counts of starts, moves and emissions, and the log likelihood of what they are counted on."""

    def __init__(self, letters: int, states: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((letters, states))
        self.logs = 0.0

    def add(self, p: Parameters, seqs: list[np.ndarray]) -> None:
        letters, states = self.emit.shape
        spans, emit = Spans(p, seqs), np.zeros((states, letters))
        #: At the first letter of each span: its emissions by what follows.
        heads = np.empty((len(spans.seqs), states))
        for own, x, active, begins in _batches(spans.seqs):
            alpha, emitted, scales = _forward(p, x, active, begins, spans.first[own])
            self.logs += float(np.log(scales, dtype=np.float64).sum())
            # Sums of float32 products hold for the letters of a time, and are added up in 64 bits.
            moves, beta, at = np.zeros((len(active), states, states), alpha.dtype), spans.last[own], begins.tolist()
            for t in range(len(active) - 1, -1, -1):
                a, b = at[t], at[t + 1]
                now, follows = emitted[a:b], beta[: b - a]
                now *= follows
                alpha[a:b] *= follows
                if t:
                    np.matmul(alpha[at[t - 1] : at[t - 1] + b - a].T, now, out=moves[t])
                    np.matmul(now, p.back, out=follows)
            self.move += moves.sum(axis=0, dtype=np.float64) * p.move
            heads[own] = emitted[: len(own)]
            self.start += alpha[: len(own)][~spans.later[own]].sum(axis=0, dtype=np.float64)
            for k in range(0, len(x), COUNTED):
                some, by_state = x[k : k + COUNTED].astype(np.intp), np.ascontiguousarray(alpha[k : k + COUNTED].T, np.float64)
                for s in range(states):
                    emit[s] += np.bincount(some, by_state[s], letters)
            # The next batch takes this one's place in memory.
            del alpha, emitted, scales, now
        self.emit += emit.T
        over = np.flatnonzero(spans.later)
        self.move += (spans.after[over - 1].T @ heads[over]) * p.move

    def plus(self, other: Expected, sign: int = 1) -> None:
        self.start += sign * other.start
        self.move += sign * other.move
        self.emit += sign * other.emit

    def weight(self, p: Parameters) -> float:
        """The log probability under p of what is counted."""
        return float((self.start * np.log(p.start)).sum() + (self.move * np.log(p.move)).sum() + (self.emit * np.log(p.emit)).sum())

    def parameters(self, share: np.ndarray) -> Parameters:
        """share: the letters' shares of all training tokens, to which each state's emissions are drawn a little."""
        start, move = self.start + 0.5, self.move + 0.5
        emit = self.emit + PULL * share[:, None]
        return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def pull(p: Parameters, share: np.ndarray) -> float:
    """The log weight of p by the counts that parameters() adds."""
    return 0.5 * float(np.log(p.start).sum() + np.log(p.move).sum()) + PULL * float((share[:, None] * np.log(p.emit)).sum())


def _first_guess(share: np.ndarray, states: int) -> Parameters:
    rng = np.random.default_rng(7)
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
    move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
    np.fill_diagonal(move, STICKY if states > 1 else 1.0)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _gathered(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), GATHER):
            yield batch.iloc[k : k + GATHER]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            yield batch.slice(k, SLICE)
        # What Arrow has freed goes back to the system, not only to its own pool.
        pa.default_memory_pool().release_unused()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over the column text of all rows; the end is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> list[pa.RecordBatch]:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches() if held else []

        for batch in _slices(batches):
            word, n = words_of(batch.column("text"))[0].value_counts().flatten()
            held.append(pa.table({"word": word, "n": n}))
            if sum(map(len, held)) > FLUSH:
                yield from done()
                held = []
        yield from done()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Alphabet, parameters, counts of head words and of groups (bounded), the table of all counts (distributed), and what each pass gained in free energy."""

    def __init__(self, alphabet, parameters, head_counts, group_tokens, group_words, counts, n, v, gains=(), share=None):
        self.alphabet, self.parameters, self.head_counts, self.group_tokens, self.group_words, self.counts, self.n, self.v = alphabet, parameters, head_counts, group_tokens, group_words, counts, n, v
        self.gains, self.share = gains, share


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def train(docs: DataFrame, states: int = STATES, head: int = HEAD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all rows of docs."""
    rows = rows_of(docs, id_col, text_col).withColumn("taught", F.lit(True))
    counted = count(rows, states, head)
    return learn(counted, spelling(rows, counted.alphabet), tolerance)


def train_and_score(docs: DataFrame, taught: Column, states: int = STATES, head: int = HEAD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() of all rows of docs by train() on those that are taught. Texts are spelt once for both."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), taught.alias("taught"))
    counted = count(rows.where("taught"), states, head)
    spelt = spelling(rows, counted.alphabet)
    return score_spelt(spelt, learn(counted, spelt, tolerance))


def count(rows: DataFrame, states: int, head: int) -> Model:
    """Everything but the parameters, which are a first guess."""
    counts = cut(word_counts(rows), "word-counts")
    texts = rows.count()
    words, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = head_words(counts, head)
    alphabet = Alphabet([bytes(r["word"]) for r in top])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for batch in batches:
            letters = alphabet.numbers(batch.column("word"))
            rest = letters < GROUPS
            np.add.at(n, letters[rest], batch.column("n").to_numpy()[rest])
            v += np.bincount(letters[rest], minlength=GROUPS)
        yield pa.RecordBatch.from_pydict({"g": pa.array(range(GROUPS), pa.int32()), "n": n, "v": v})

    group_n, group_v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in counts.mapInArrow(grouped, "g int, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # GROUPS rows
        group_n[r["g"]], group_v[r["g"]] = r["n"], r["v"]
    head_counts = np.array([r["n"] for r in top], np.int64)
    letters = np.concatenate([group_n, [texts], head_counts]) + 1.0
    share = letters / letters.sum()
    return Model(alphabet, _first_guess(share, states), head_counts, group_n, group_v, counts, int(total) + texts, int(words) + bool(texts), (), share)


def learn(model: Model, spelt: DataFrame, tolerance: float) -> Model:
    """The model with parameters fitted to the taught rows of spelt."""
    if model.n:
        parts = [spelt.where(F.col("part") == n).select("letters") for n in range(PARTS)]
        model.parameters, model.gains = fit(parts, model.share, model.parameters, tolerance * model.n)
    return model


def head_words(counts: DataFrame, head: int) -> list:
    """The `head` most frequent rows of counts. By octaves of n first, so that only words near the top are sorted; the driver takes what it needs from the first partitions."""
    low = 1
    for r in counts.groupBy(F.floor(F.log2("n")).alias("octave")).agg(F.count("*").alias("words")).orderBy(F.col("octave").desc()).collect():  # 64 rows at most
        low, head_left = 1 << r["octave"], (head if low == 1 else head_left) - r["words"]
        if head_left <= 0:
            break
    order = [F.col("n").desc(), F.xxhash64("word"), F.col("word")]
    return counts.where(F.col("n") >= low).repartitionByRange(*order).sortWithinPartitions(*order).limit(head).collect()


def spelling(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """rows (doc_id, text, taught) spelt, as a table: key (of the row), doc_id, letters (those of the text with its end, as bytes of 32-bit integers), words outside the head and
    their times; and part, which lies in folders: for taught rows one of PARTS, by a hash of the letters, -1 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in _slices(batches):
            letters, words, times = alphabet.spell_all(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"key": np.arange(key, key + len(batch)), "doc_id": batch.column("doc_id"), "taught": batch.column("taught"), "letters": letters, "words": words, "times": times})
            key += len(batch)

    small_batches(rows.sparkSession)
    spelt = rows.select("doc_id", "text", "taught").mapInArrow(run, "key long, doc_id long, taught boolean, letters binary, words array<binary>, times array<long>")
    part = F.when(F.col("taught"), F.pmod(F.xxhash64("letters"), F.lit(PARTS)).cast("int")).otherwise(F.lit(-1))
    return cut(spelt.withColumn("part", part).drop("taught"), "letters", by="part")


def fit(parts: list[DataFrame], share: np.ndarray, p: Parameters, least: float) -> tuple[Parameters, list[float]]:
    """Incremental Baum-Welch from p until a pass over all parts raises the free energy by less than `least`; and the gain of each pass but the first."""
    letters, states = len(share), len(p.start)
    own, bound = [Expected(letters, states) for _ in parts], [0.0] * len(parts)
    every, before, gains = Expected(letters, states), None, []
    while True:
        for n, part in enumerate(parts):
            e = baum_welch(part, letters, p)
            every.plus(own[n], -1)
            every.plus(e)
            # The entropy of the part's paths: its share of the free energy that does not depend on later parameters.
            own[n], bound[n] = e, e.logs - e.weight(p)
            p = every.parameters(share)
        reached = sum(bound) + every.weight(p) + pull(p, share)
        if before is not None:
            gains.append(reached - before)
            if gains[-1] < least:
                return p, gains
        before = reached


def baum_welch(spelt: DataFrame, letters: int, p: Parameters) -> Expected:
    """The expected counts under p over all rows, summed over partitions. Counts travel as bytes, BLOCK letters to a row. The parameters are broadcast (letters x states), and taken back from all disks when the counts are in."""
    states, held = len(p.start), spelt.sparkSession.sparkContext.broadcast((p.start, p.move, p.emit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, p = Expected(letters, states), Parameters(*held.value, kind=np.float32)
        for batch in _gathered(batches):
            e.add(p, [np.frombuffer(x, np.int32) for x in batch.letters])
        if e.start.any():
            few = np.concatenate([[e.logs], e.start, e.move.ravel()])
            yield pd.DataFrame({"block": [-1], "counts": [few.tobytes()]})
            # Rounded to 7 digits on the way, and summed with all of 64 bits.
            yield pd.DataFrame({"block": range(0, letters, BLOCK), "counts": [e.emit[k : k + BLOCK].astype("<f4").tobytes() for k in range(0, letters, BLOCK)]})

    def summed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = "<f8" if key[0] < 0 else "<f4"
        total = sum(np.frombuffer(x, kind).astype(float) for batch in batches for x in batch.counts)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    sent = spelt.mapInPandas(run, "block int, counts binary").groupBy("block").applyInPandas(summed, "block int, counts binary")
    e = Expected(letters, states)
    for r in sent.collect():  # the alphabet's counts
        x = np.frombuffer(r["counts"], "<f8")
        if r["block"] < 0:
            e.logs, e.start, e.move = float(x[0]), x[1 : 1 + states].copy(), x[1 + states :].reshape(states, states).copy()
        else:
            e.emit[r["block"] : r["block"] + BLOCK] = x.reshape(-1, states)
    held.destroy()
    return e


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return score_spelt(spelling(rows_of(docs, id_col, text_col).withColumn("taught", F.lit(False)), model.alphabet), model)


def score_spelt(spelt: DataFrame, model: Model) -> DataFrame:
    """score() of the rows of spelling()."""
    p, n, v = model.parameters, model.n, model.v
    log_base = np.log10((np.concatenate([np.zeros(GROUPS), [model.n - int(model.head_counts.sum() + model.group_tokens.sum())], model.head_counts]) + 1) / (n + v + 1))
    log_base[:GROUPS] = 0
    known_end = int(model.n > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _gathered(batches):
            seqs = [np.frombuffer(x, np.int32) for x in batch.letters]
            yield pd.DataFrame({
                "doc_id": batch.doc_id.to_numpy(), "key": batch.key.to_numpy(), "n_tokens": [len(s) for s in seqs], "head_known": [int((s > GROUPS).sum()) + known_end for s in seqs],
                "head_base": [log_base[s].sum() for s in seqs], "head_score": log10_likelihood(p, seqs),
            }).astype({"doc_id": "Int64"})

    heads = cut(spelt.select("doc_id", "key", "letters").mapInPandas(run, "doc_id long, key long, n_tokens long, head_known long, head_base double, head_score double"), "heads")
    spark = spelt.sparkSession
    groups = spark.createDataFrame([(g, float(np.log10(model.group_tokens[g] + model.group_words[g] + 1.0))) for g in range(GROUPS)], "g int, log_size double")
    tail = spelt.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    joined = tail.join(model.counts.withColumnRenamed("word", "c_word"), F.col("word") == F.col("c_word"), "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("c"), group_column(F.col("word")).alias("g"))
    joined = joined.join(F.broadcast(groups), "g")  # GROUPS rows
    summed = joined.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - F.lit(float(np.log10(n + v + 1))))).alias("t_base"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - F.col("log_size"))).alias("t_score"),
    )
    zero = F.lit(0.0)
    return heads.select("doc_id", "key", "n_tokens", "head_known", "head_base", "head_score").join(summed, "key", "left").select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("t_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("t_base", zero)).alias("base_score"), (F.col("head_score") + F.coalesce("t_score", zero)).alias("score"),
    )


def group_column(word):
    """group_of as an expression."""
    first, last = F.substring(word, 1, 2), F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")
    return (F.crc32(F.concat(first, F.lit(b"|"), last)) % F.lit(GROUPS)).cast("int")


def in_training(doc_id):
    return fold(doc_id, 7) != 2
