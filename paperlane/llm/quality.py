"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator (Kiryo et al., 2017).

Trusted positives are rows labelled 1; labels 0 are never read. The unlabelled text is a draw from all documents given, labelled or not. With class
prior p and logistic loss l, the risk is  p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]);  where the bracket turns negative,
its gradient is reversed, as published. f is linear in binned text statistics (one weight a bin, so any shape of dependence on
a statistic), trained by full-batch Adam in a fixed order. The score is the logistic function of f.

The prior is estimated from positives and unlabelled text alone, by the best bin (Garg et al., 2021): a logistic model learns to tell one half of
both apart, and on the other half the share of unlabelled rows over a score, divided by the share of positives over it, is
taken where it is least, with the published allowance for chance.

Statistics are of the text alone, over all of it: a long text is read in one go and no prefix is taken. Besides whole-text
figures, worst-line figures catch text that is spoilt in part.

Null and empty texts have all statistics 0 and get the score of that bin. Without a positive row that has a document every score is 0.5. An id counts
once in the sample, whatever the number of its rows or labels; of its texts the one with the smallest hash is taken. Repeated rows are scored each.
Extra columns stay out of the score. Null labels and null ids teach nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.llm.common import drawn, hash_order, small_batches

#: Positive and unlabelled ids at most (each), drawn by a hash of the id; their statistics are all that reaches the driver.
SAMPLE, BINS, STEPS, RATE, DECAY = 20_000, 24, 800, 0.05, 1e-4
#: Of the prior: the chance allowed for, the weight of its allowance, and steps and decay of the model that tells positives from unlabelled rows.
DELTA, GAMMA, PRIOR_STEPS, PRIOR_DECAY = 0.1, 0.01, 200, 1e-2
THRESHOLD = 0.3
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]")
NAMES = ("words", "distinct", "adjacent", "top_word", "mean_len", "letters", "digits", "upper", "symbols", "spaces", "word_tail", "line_mean", "line_distinct", "line_symbols", "line_upper", "line_adjacent", "stop", "blocks", "bars", "marks", "one_char")


#: The characters that spoilt text is strewn with count by class, through one translation of the text.
CLASS = {i: ("U" if chr(i).isupper() else "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else "_" if chr(i).isspace() else "," if chr(i) in ".,;:'\"-()" else "#") for i in range(0x250)}


class Kinds(dict):
    def __missing__(self, i: int) -> str:
        c = chr(i)
        self[i] = kind = "U" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "_" if c.isspace() else "#"
        return kind


KINDS = Kinds(CLASS)


def statistics(text: str | None) -> list[float]:
    """The figures named NAMES; the line figures are of the worst line of eight words or more."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = text.translate(KINDS)
    chars = max(1, len(text) - kinds.count("_"))
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    adjacent = sum(map(str.__eq__, words, words[1:]))
    tails = sum(map(kinds.count, ("a#", "U#", ",#")))
    lines = text.split("\n")
    line_distinct, line_symbols, line_upper, line_adjacent = 1.0, 0.0, 0.0, 0.0
    start = 0
    for line in lines:
        k = kinds[start : start + len(line)]
        start += len(line) + 1
        if len(line) < 24:
            continue
        own = line.split()
        if len(own) >= 8:
            line_distinct = min(line_distinct, len(set(own)) / len(own))
            line_adjacent = max(line_adjacent, sum(map(str.__eq__, own, own[1:])) / len(own))
            line_symbols = max(line_symbols, k.count("#") / len(line))
            line_upper = max(line_upper, k.count("U") / len(line))
    pieces = [" ".join(words[i : i + 50]) for i in range(0, n, 50)]
    return [
        float(np.log1p(n)), len(count) / n, adjacent / n, max(count.values()) / n, min(chars / n, 60.0), kinds.count("a") / chars, kinds.count("0") / chars, kinds.count("U") / chars, kinds.count("#") / chars,
        kinds.count("_") / len(text), tails / n, min(n / len(lines), 500.0), line_distinct, line_symbols, line_upper, line_adjacent, sum(count[w] for w in count if len(w) <= 3) / n, len(set(pieces)) / len(pieces), text.count("|") / n, text.count("!") / n, sum(count[w] for w in count if len(w) == 1) / n,
    ]


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers, offset by statistic, of the rows of x."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * (edges.shape[1] + 1) for j in range(x.shape[1])], axis=1)


class Model:
    """Bin edges, weights and intercept: a few kilobytes."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[_bins(x, self.edges)].sum(axis=1) + self.bias, -30, 30)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    tails = np.quantile(x, [0.002, 0.005, 0.01, 0.99, 0.995, 0.998], axis=0).T
    return np.sort(np.concatenate([edges, tails], axis=1), axis=1)


def nnpu_gradient(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights w and intercept b, and the direction of descent (the intercept last); p, u: bin numbers of rows."""
    f_p, f_u = w[p].sum(axis=1) + b, w[u].sum(axis=1) + b
    s_p, s_u = 1 / (1 + np.exp(-f_p)), 1 / (1 + np.exp(-f_u))

    def gradient(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), len(w)), slope.sum())

    positive = prior * np.logaddexp(0, -f_p).mean()
    negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    g_negative = gradient(u, s_u / len(u)) - gradient(p, prior * s_p / len(p))
    g = -g_negative if negative < 0 else g_negative + gradient(p, prior * (s_p - 1) / len(p))
    return positive + max(0.0, negative), g


def adam(size: int, b: float, direction, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and intercept after `steps` steps along direction(w, b)."""
    w, m, v = np.zeros(size), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        g = direction(w, b) + decay * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of positives and of unlabelled rows."""
    p, u = np.sort(p), np.sort(u)
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    chance = np.sqrt(np.log(4 / DELTA) / (2 * len(u))) + np.sqrt(np.log(4 / DELTA) / (2 * len(p)))
    best = np.argmin((share_u + (1 + GAMMA) * chance) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 1 / (len(u) + 2), (len(u) + 1) / (len(u) + 2)))


def estimate_prior(p: np.ndarray, u: np.ndarray, size: int) -> float:
    """Learns on even rows, counts on odd ones; with fewer than two of either kind all are used for both."""
    learn, count = (slice(0, None, 2), slice(1, None, 2)) if min(len(p), len(u)) > 1 else (slice(None), slice(None))
    own_p, own_u = p[learn], u[learn]
    rows, y = np.concatenate([own_p, own_u]), np.repeat([1.0, 0.0], [len(own_p), len(own_u)])
    weight = np.repeat([0.5 / len(own_p), 0.5 / len(own_u)], [len(own_p), len(own_u)])  # both kinds count alike

    def direction(w: np.ndarray, b: float) -> np.ndarray:
        slope = (1 / (1 + np.exp(-(w[rows].sum(axis=1) + b))) - y) * weight
        return np.append(np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), size), slope.sum())

    w, b = adam(size, 0.0, direction, PRIOR_STEPS, decay=PRIOR_DECAY)
    return best_bin(w[p[count]].sum(axis=1) + b, w[u[count]].sum(axis=1) + b)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Statistics of trusted positives and of the unlabelled draw; the prior is estimated unless given."""
    width = len(NAMES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((width, 1)), np.zeros(width * 2), 0.0, 0.5)
    edges = bin_edges(unlabelled)
    p, u, size = _bins(positive, edges), _bins(unlabelled, edges), width * (edges.shape[1] + 1)
    prior = estimate_prior(p, u, size) if prior is None else prior
    w, b = adam(size, float(np.log(prior / (1 - prior))), lambda w, b: nnpu_gradient(w, b, p, u, prior)[1])
    return Model(edges, w, b, prior)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labels 1 among those given and from all of docs, at most `sample` ids of either; labels 0 are not read."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    trusted = drawn(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("p_id")).where(F.col("p_id").isNotNull()), "p_id", sample, 1)
    anyone = drawn(rows.select(F.col("id").alias("u_id")), "u_id", sample, 3)
    # Two lists of `sample` ids: bounded. An id's rows meet in one, counted together before they move.
    met = rows.join(F.broadcast(trusted), F.col("id") == F.col("p_id"), "left").join(F.broadcast(anyone), F.col("id") == F.col("u_id"), "left").where("p_id IS NOT NULL OR u_id IS NOT NULL")
    key = F.xxhash64("text")
    once = met.groupBy("id").agg(F.min_by("text", key).alias("text"), F.max(F.col("p_id").isNotNull()).alias("p"), F.max(F.col("u_id").isNotNull()).alias("u"))
    once = once.select(hash_order(F.col("id"), 1).alias("place"), "text", "p", "u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": batch.place, "p": batch.p, "u": batch.u, "x": [statistics(t) for t in batch.text]})

    got = once.mapInPandas(run, "place long, p boolean, u boolean, x array<double>").toPandas()
    got = got.sort_values("place", kind="stable")
    x = np.array(got.x.tolist(), float).reshape(-1, len(NAMES))
    return fit_nnpu(x[got.p.to_numpy(bool)], x[got.u.to_numpy(bool)])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and a column `out`; no shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([statistics(t) for t in texts], float)))

    return docs.withColumn(out, of(F.col(text_col)))
