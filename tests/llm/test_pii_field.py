"""The field's learning against numerical derivatives, and the spans it adds against enumeration of all labellings."""

import itertools
import math
import random

import numpy as np

from paperlane.llm import pii


def corpus():
    rng = random.Random(6)
    texts = [None, "", "no digits at all", "7 " * 30_000]
    for i in range(150):
        number = f"+1555{rng.randrange(10**7):07d}"
        mail = f"user{i}@host{i % 7}.example.org"
        texts += [f"Call {number} or write to {mail}, or {number}!", f"From {mail}: the year {1900 + i}, version {i}.{i % 9}", f"At 10.{i}.0.9 and again at 10.{i}.0.9, see {i} or {i * 37}"]
    return texts


def learnt(texts):
    return pii.fit(sorted((*c, 1) for t in texts if t for c in pii.configurations(t)))


def test_gradient_of_the_pseudo_likelihood():
    rng = np.random.default_rng(0)
    data = pii.Configurations([("a", "0f1 1b2", 1, 3), ("b", "0b0", 0, 5), ("", "1f4 1b4", 4, 2), ("a", "", 2, 1)])
    w = {"bias": rng.normal(size=5), "shapes": rng.normal(size=(2, 5)), "near": rng.normal(size=(5, 5)), "far": rng.normal(size=(5, 5))}
    _, g = data.ascent(w)
    for name in w:
        for at in np.ndindex(w[name].shape):
            up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((data.ascent(up)[0] - data.ascent(down)[0]) / 2e-5 - g[name][at]) < 1e-7


def test_added_spans_equal_enumeration(spark):
    texts = corpus()
    field = learnt(texts)
    bare = [(i, f"Tel +1555000{i:04d} now, then 1555000{i:04d} later; id {i}x") for i in range(20)]
    got = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(bare, "doc_id long, text string"), field)).collect()}
    added = 0
    for i, text in bare:
        base = pii.base(text)
        t = pii.Tokens(text, base)
        local = [field.shapes.get(repr(s), field.unseen) for s in t.shape]
        sums, total = np.zeros((len(t.at), 5)), 0.0
        for y in itertools.product(range(5), repeat=len(t.at)):
            if all(not known or known == own for known, own in zip(t.label, y)):
                weight = math.exp(sum(u[a] for u, a in zip(local, y)) + sum(field.pairs[k][y[a], y[b]] for a, b, k in t.links))
                total += weight
                for n, a in enumerate(y):
                    sums[n, a] += weight
        p, want = sums / total, [list(s) for s in base]
        for n, (start, end) in enumerate(t.at):
            kind = int(p[n, 1:].argmax())
            if not t.label[n] and p[n, kind + 1] >= pii.ADDED:
                own = text[start:end].strip(pii.EDGE)
                want[kind].append((start + text[start:end].index(own), start + text[start:end].index(own) + len(own)))
                added += 1
        assert got[i].spans == pii.joined([sorted(s) for s in want]) and got[i].n_phone == len(base[3])
    assert added > 0


def test_links_give_hidden_labels_back():
    texts = [t for t in corpus() if t]
    hidden, linked, found, right = pii.recovery(texts, learnt(texts))
    assert hidden > linked > 20 and found >= 0.9 * linked and right >= 0.9 * found


def test_nothing_to_learn_from(spark):
    assert pii.fit([]).beliefs([pii.Tokens("a 1 b", [[], [], [], []])]).shape == (1, 5)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find(empty)).collect() == []
