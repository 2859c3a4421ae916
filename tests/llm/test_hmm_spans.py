import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperlane.llm import hmm

ODD = ["", " \n ", "A", " long" * 5000 + "\t", "ÄÖ ß 日本 😀 Ab", "\x1ca\x0bB\x85c\xa0d\x00e", "W1 w2\tw3\nw1 unseen unseen"]


def parameters(letters: int, states: int, kind: type) -> hmm.Parameters:
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Parameters(norm(rng.random(states), 0), norm(rng.random((states, states)) ** 4, 1), norm(rng.random((letters, states)) ** 4, 0), kind)


@pytest.mark.parametrize("kind, near", [(np.float64, 1e-9), (np.float32, 2e-4)])
def test_long_sequences_go_in_spans_side_by_side_with_the_same_counts(monkeypatch, kind, near):
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 7, 8, 15, 16, 17, 64, 65, 2000, 3)]
    p = parameters(9, 4, kind)

    def added(span: int) -> tuple[hmm.Expected, np.ndarray, int]:
        monkeypatch.setattr(hmm, "SPAN", span)
        steps, plain = [], hmm._batches
        monkeypatch.setattr(hmm, "_batches", lambda s: (steps.append(len(b[2])) or b for b in plain(s)))
        e = hmm.Expected(9, 4)
        e.add(p, seqs)
        out = e, hmm.log10_likelihood(p, seqs), max(steps)
        monkeypatch.setattr(hmm, "_batches", plain)
        return out

    (whole, score, most), (cut, cut_score, cut_most) = added(1 << 30), added(8)
    assert most == 2000 and cut_most == 8
    assert np.allclose(cut_score, score, rtol=near) and np.isclose(cut.logs, whole.logs, rtol=near)
    for a, b in ((cut.start, whole.start), (cut.move, whole.move), (cut.emit, whole.emit)):
        assert np.allclose(a, b, rtol=near, atol=near)
    assert np.isclose(cut.start.sum(), len(seqs)) and np.isclose(cut.move.sum(), sum(map(len, seqs)) - len(seqs), rtol=near)


def test_batches_are_spelt_like_single_texts():
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices([f"w{k}" for k in range(60)] + ["é", "||", "Q"], k=rng.randint(0, 30))) for _ in range(50)] + ODD[:2]
    for head in ([], [b"w1", b"w7", b"long", "é".encode(), b"q"]):
        alphabet = hmm.Alphabet(head)
        for some in (texts, texts[:2], []):
            letters, words, times = alphabet.spell_all(pa.array(["cut off", *some], pa.string())[1:])
            spelt = [alphabet.spell(hmm.tokens(t)) for t in some]
            assert letters.to_pylist() == [s.tobytes() for s, _ in spelt]
            assert [dict(zip(w, n)) for w, n in zip(words.to_pylist(), times.to_pylist())] == [Counter(r) for _, r in spelt]
            assert list(map(len, words.to_pylist())) == [len(set(r)) for _, r in spelt]


def test_words_are_counted_over_batches(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FLUSH", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = hmm.word_counts(spark.createDataFrame([(t,) for t in ODD * 3], "text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {bytes(r.word): r.n for r in got} == Counter(w for t in ODD * 3 for w in hmm.tokens(t)) and len(got) == len({bytes(r.word) for r in got})
    assert hmm.word_counts(spark.createDataFrame([], "text string")).collect() == []


def test_only_spans_between_others_are_made_from_each_state(monkeypatch):
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 9, n).astype(np.int32) for n in (15, 16, 17, 8, 40)]
    sent, plain = [], hmm._products
    monkeypatch.setattr(hmm, "_products", lambda p, s, *more: (sent.extend(map(len, s)), plain(p, s, *more))[1])
    p = parameters(9, 4, np.float64)
    whole = hmm.log10_likelihood(p, seqs)
    monkeypatch.setattr(hmm, "SPAN", 8)
    sent.clear()
    assert np.allclose(hmm.log10_likelihood(p, seqs), whole, rtol=1e-12)
    # One of the three of 17 letters, three of the five of 40.
    assert sent == [8] * 4


def test_a_letter_takes_at_most_150_bytes_of_memory(monkeypatch):
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 50, n).astype(np.int32) for n in rng.integers(100, 400, 4000)]
    monkeypatch.setattr(hmm, "CELLS", 1 << 18)
    p, e = parameters(50, 8, np.float32), hmm.Expected(50, 8)
    tracemalloc.start()
    try:
        e.add(p, seqs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 150 * hmm.CELLS and np.isclose(e.emit.sum(), sum(map(len, seqs)), rtol=1e-4)
