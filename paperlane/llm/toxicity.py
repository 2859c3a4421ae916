"""Toxicity classifier with a counterfactual regulariser (after Garg et al., 2019).

A linear logistic model of the words of a text and of their first four and five letters, each present or not. All of them count: identity terms have
a feature each and no prefix features, so nothing leaks to them from other words; the others share SLOTS slots by their crc32. For every labelled row that names a group, the term is
swapped for all others of its kind, and  weight * mean (f(x) - f(x'))^2  is added to the loss: a text must not score differently
for the group it names. A term that the text names already is not gained again.

Null and empty texts have no features and score the logistic of the intercept. Without positive (or negative) labels every
score is the smoothed share of positives. Labels but 0 and 1, and those of null ids, teach nothing. An id counts once in the sample, with the
highest of its labels and, of its texts, the one with the smallest hash; repeated rows are scored each; extra columns stay out. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.llm.common import cut, drawn, hash_order, small_batches

#: Labelled ids of the sample at most, drawn by a hash of the id; slots of the features that are no identity terms.
SAMPLE, SLOTS, STEPS, RATE, DECAY, COUNTERFACTUAL = 20_000, 1 << 18, 400, 0.05, 1e-5, 1.0
THRESHOLD, CHUNK = 0.7, 1024
#: Terms that name groups, by kind; a term is swapped for all others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy", "transgender"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "arab", "european", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("gays", "lesbians", "bisexuals", "heterosexuals"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives", "migrants"),
    ("immigrant", "refugee", "foreigner", "citizen", "native", "migrant"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("americans", "mexicans", "chinese", "indians", "russians", "germans", "french", "spanish", "turks"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)
KIND = {term: kind for kind in IDENTITY for term in kind}
WORDS = re.compile(r"[^\W\d_]+")
CACHE = 500_000


def features_of(word: str) -> tuple[str, ...]:
    if word in KIND or len(word) < 5:
        return (word,)
    return (word, "4" + word[:4], "5" + word[:5]) if len(word) > 5 else (word, "4" + word[:4])


class Featurizer:
    """Feature numbers of a text; a worker keeps those of words it has met."""

    def __init__(self, names: list[str], slots: int = 0):
        """names: features with a number each; the others' numbers are their slots, behind these."""
        self.numbers, self.slots, self.known = {f: n for n, f in enumerate(names)}, slots, {}

    def number(self, feature: str) -> int | None:
        n = self.numbers.get(feature)
        return len(self.numbers) + crc32(feature.encode()) % self.slots if n is None and self.slots else n

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.known
        words = set(WORDS.findall((text or "").lower()))
        new = words.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        for w in new:
            known[w] = tuple(n for f in features_of(w) if (n := self.number(f)) is not None)
        return np.unique(np.array([n for w in words for n in known[w]], np.int32))


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float, pairs: int = 0, slots: int = 0):
        """pairs: how many counterfactuals training saw."""
        self.names, self.weights, self.bias, self.pairs, self.slots = names, weights, bias, pairs, slots

    def scores(self, texts) -> np.ndarray:
        of = Featurizer(self.names, self.slots)
        return np.array([1 / (1 + np.exp(-np.clip(self.weights[of(t)].sum() + self.bias, -30, 30))) for t in texts])


def swaps(rows: list[np.ndarray], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lost feature, gained feature) of each counterfactual; all else in the text is as it was. -1: the gained term is there already."""
    number = {f: n for n, f in enumerate(names)}
    term = {number[t]: [number[o] for o in kind if o != t and o in number] for t, kind in KIND.items() if t in number}
    found = []
    for row in rows:
        own = [n for n in row.tolist() if n in term]
        found += [(n, -1 if other in own else other) for n in own for other in term[n]]
    return tuple(np.array(x, int) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def penalty(w: np.ndarray, lost: np.ndarray, gained: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean squared change of the score over all swaps, and its gradient in w."""
    there = gained < 0
    change = np.where(there, 0.0, w[gained]) - w[lost]
    slope = 2 * change / len(lost)
    return float((change * change).mean()), np.bincount(gained[~there], slope[~there], len(w)) - np.bincount(lost, slope, len(w))


def fit(rows: list[np.ndarray], labels: np.ndarray, names: list[str], steps: int = STEPS, rate: float = RATE, decay: float = DECAY, counterfactual: float = COUNTERFACTUAL, slots: int = 0) -> Model:
    prior = (float(labels.sum()) + 1) / (len(labels) + 2)
    bias = float(np.log(prior / (1 - prior)))
    w = np.zeros(len(names) + slots)
    if not 0 < labels.sum() < len(labels):
        return Model(names, w, bias, slots=slots)
    # Some CHUNK rows at a time, so that a step's working memory is bounded beside the rows themselves.
    chunks = [(slice(low, low + CHUNK), np.concatenate([*rows[low : low + CHUNK], np.zeros(0, np.int32)]), np.repeat(np.arange(len(rows[low : low + CHUNK]), dtype=np.int32), [len(r) for r in rows[low : low + CHUNK]])) for low in range(0, len(rows), CHUNK)]
    lost, gained = swaps(rows, names)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = np.append(decay * w, 0.0)
        for own, of, at in chunks:
            y = labels[own]
            slope = (1 / (1 + np.exp(-np.clip(np.bincount(at, w[of], len(y)) + bias, -30, 30))) - y) / len(rows)
            g[:-1] += np.bincount(of, slope[at], len(w))
            g[-1] += slope.sum()
        if len(lost):
            g[:-1] += penalty(w, lost, gained)[1] * counterfactual
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(names, w, float(bias), len(lost), slots)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", counterfactual: float = COUNTERFACTUAL) -> Model:
    """Learns from the labelled rows given; at most `sample` ids, by a hash of them."""
    small_batches(docs.sparkSession)
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label"))
    chosen = given.join(F.broadcast(drawn(given.select("l_id"), "l_id", sample, 2)), "l_id").groupBy("l_id").agg(F.max("label").alias("label"))
    # `sample` rows of two numbers: bounded. An id's rows meet in one.
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("l_id"))
    once = met.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    rows = cut(once.select(hash_order(F.col("id"), 2).alias("place"), "text", "label"), "toxic-sample")

    names = list(KIND)

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Featurizer(names, slots)
        for batch in batches:
            yield pd.DataFrame({"place": batch.place, "label": batch.label, "x": [of(t) for t in batch.text]})

    found = rows.mapInPandas(featurize, "place long, label int, x array<int>").orderBy("place").toArrow()
    x, labels = found.column("x").combine_chunks(), found.column("label").to_numpy().astype(float)
    numbers, ends = x.values.to_numpy(), x.offsets.to_numpy()
    return fit([numbers[a:b] for a, b in zip(ends[:-1], ends[1:])], labels, names, counterfactual=counterfactual, slots=slots)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and a column `out`; no shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        featurize = Featurizer(model.names, model.slots)
        for texts in batches:
            f = np.array([model.weights[featurize(t)].sum() for t in texts], float) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(f, -30, 30))))

    return docs.withColumn(out, of(F.col(text_col)))
