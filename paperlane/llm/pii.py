"""Personal data: four base patterns and a skip-chain conditional random field over each document.

Base, leftmost and non-overlapping for each kind; matches that fail their test are dropped without another try:
email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). The patterns are run in forms that
find the same matches in time linear in the text.

The field (after Sutton and McCallum, 2004): nodes are the tokens (white space apart) with a digit or an at sign; a token without either
can only be `none`, so it is left out. Labels are none and the four kinds. Factors: a token's shape with its label, labels
of neighbouring tokens, and labels of tokens far apart that are equal or similar (equal letters and digits in
lower case, or seven last digits in common); of such tokens, each is linked with the next, so a token that recurs thousands
of times gives as many links, not their square. Weights maximise the pseudo-likelihood (each label given its neighbours' labels) of what the base
patterns label in all documents, with a Gaussian prior. As those labels follow from the tokens themselves, HIDDEN of a hundred tokens are learnt from without
their shape, so that the links must account for them. What is counted for this are configurations (a shape, and the labels at a
node's links), which do not grow with the documents. Tokens in base spans keep their label; for the others loopy message passing gives beliefs, and a token that is of a kind with
probability ADDED or more becomes a span of that kind, without the punctuation around it.

Null text is empty. Repeated rows are read each. An empty table gives an empty result. Extra columns are ignored. Whole
texts are read, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: A document is swept until no message changes by more than TOLERANCE; loops may keep it from that, so LEAST_SWEEPS sweeps and SWEEPS more a token are the end. (A change is halved by a sweep: TOLERANCE takes 30 of them.)
ADDED, LEAST_SWEEPS, SWEEPS, SMOOTH, TOLERANCE = 0.9, 64, 8, 0.5, 1e-9
#: Tokens of a hundred that are learnt from without their shape; steps and rate of the ascent, and the prior's weight (in tokens).
HIDDEN, STEPS, RATE, PRIOR = 20, 400, 0.05, 1.0

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A token with a digit or an at sign; possessive parts keep the scan linear.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
ANY = re.compile(r"[0-9@]")
EDGE = " \t\n.,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the whole run of its characters before the at sign, as far as no earlier match has it."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind."""
    if not ANY.search(text):
        return [[], [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ips, cards, phones]


class Tokens:
    """The nodes of a document: spans, shapes, base labels, and which are neighbours or alike."""

    def __init__(self, text: str, spans: list[list[tuple[int, int]]]):
        self.at = [m.span() for m in TOKEN.finditer(text)]
        n = len(self.at)
        self.label = np.zeros(n, int)
        starts = np.array([s for s, _ in self.at], int)
        for kind in range(len(KINDS), 0, -1):
            for start, end in spans[kind - 1]:
                i = max(0, int(np.searchsorted(starts, start, side="right")) - 1)
                while i < n and self.at[i][0] < end:
                    if self.at[i][1] > start:
                        self.label[i] = kind
                    i += 1
        self.shape, alike, self.links = [], {}, []
        for i, (start, end) in enumerate(self.at):
            token = text[start:end]
            digits = only_digits(token)
            self.shape.append((min(token.count("@"), 2), sum(len(digits) >= x for x in (1, 4, 7, 8, 10, 12, 16, 20)), min(token.count("."), 4), token[:1] == "+" or token[:2] == "(+", any(c.isalpha() for c in token), "-" in token))
            met = set()  # a pair of tokens has one link, however many ways it is alike
            if i and self.at[i - 1][1] + 1 >= start:
                self.links.append((i - 1, i, 0))
                met.add(i - 1)
            bare = "".join(c for c in token.lower() if c.isalnum() or c == "@")
            for key in (("t", bare), ("d", digits[-7:])) if len(digits) >= 7 else (("t", bare),) if len(bare) >= 4 else ():
                if key in alike and alike[key] not in met:
                    self.links.append((alike[key], i, 1))
                    met.add(alike[key])
                alike[key] = i


def configurations(text: str) -> Iterator[tuple[str, str, int]]:
    """For each node its shape (empty if hidden), what stands at its links, and its label. At a link stand the kind, f or b for the place of the other node after or before, and that node's label."""
    t = Tokens(text, base(text))
    around: list[list[str]] = [[] for _ in t.at]
    for i, j, kind in t.links:
        around[i].append(f"{kind}f{t.label[j]}")
        around[j].append(f"{kind}b{t.label[i]}")
    for (start, end), shape, links, label in zip(t.at, t.shape, around, t.label.tolist()):
        hidden = crc32(f"{start}:{text[start:end]}".encode("utf-8", "surrogatepass")) % 100 < HIDDEN
        yield "" if hidden else repr(shape), " ".join(sorted(links)), label


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter = Counter()
    for batch in batches:
        for text in batch.text:
            if ANY.search(text):
                found.update(configurations(text))
    yield pd.DataFrame([(*c, n) for c, n in found.items()], columns=["shape", "links", "label", "n"])


class Field:
    """Weights by shape and by kind of link. Shapes are made of bounded counts, so the tables are bounded."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        """A first guess, log ratios of counts: (shape, 0, label, n) and (pair and kind of link, label, label, n)."""
        k = len(KINDS) + 1
        shapes: dict[str, np.ndarray] = {}
        pairs = np.full((2, k, k), SMOOTH)
        for what, a, b, n in counts:
            if what.startswith("pair"):
                pairs[int(what[4:]), a, b] += n
            else:
                shapes.setdefault(what, np.full(k, SMOOTH / k))[b] += n
        every = sum(shapes.values(), np.full(k, 1.0))
        self.unseen = np.log(every / every.sum())
        self.shapes = {s: np.log(n / n.sum()) for s, n in shapes.items()}
        joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
        self.pairs = np.log(joint / (joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)))

    def beliefs(self, docs: list[Tokens], settled: list[bool] | None = None) -> np.ndarray:
        """Label probabilities of all nodes of the documents, by sum-product over all links at once. settled: gets, for each document, whether its messages settled."""
        unrest = np.zeros(len(docs), bool)
        shift = np.cumsum([0, *(len(t.at) for t in docs)])
        local = np.array([self.shapes.get(repr(s), self.unseen) for t in docs for s in t.shape]).reshape(-1, len(KINDS) + 1)
        label = np.concatenate([t.label for t in docs])
        local[label > 0] = -30.0
        local[label > 0, label[label > 0]] = 0.0
        links = [(i + s, j + s, kind) for t, s in zip(docs, shift) for i, j, kind in t.links]
        if links:
            i, j, kind = np.array(links, int).T
            source, target = np.concatenate([i, j]), np.concatenate([j, i])
            factor = np.concatenate([self.pairs[kind], self.pairs[kind].transpose(0, 2, 1)])
            reverse = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            sent = np.zeros((len(source), local.shape[1]))
            owner = np.repeat(np.arange(len(docs)), [len(t.links) for t in docs])
            owner, bound = np.concatenate([owner, owner]), LEAST_SWEEPS + SWEEPS * np.array([len(t.at) for t in docs])
            live, sweeps = np.arange(len(source)), 0
            while len(live):
                total = local.copy()
                np.add.at(total, target[live], sent[live])
                x = (total[source[live]] - sent[reverse[live]])[:, :, None] + factor[live]
                top = x.max(axis=1, keepdims=True)
                new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
                new = 0.5 * sent[live] + 0.5 * (new - new.max(axis=1, keepdims=True))
                change = np.zeros(len(docs))
                np.maximum.at(change, owner[live], np.abs(new - sent[live]).max(axis=1))
                sent[live], sweeps = new, sweeps + 1
                unrest[owner[live]] = (change > TOLERANCE)[owner[live]]
                live = live[unrest[owner[live]] & (sweeps < bound)[owner[live]]]
            local = local.copy()
            np.add.at(local, target, sent)
        if settled is not None:
            settled.extend((~unrest).tolist())
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


class Configurations:
    """Counted configurations as arrays: shape number (-1: hidden), labels at links (rows x 4 x labels), label, how often."""

    SIDES = ("0f", "0b", "1f", "1b")

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        k = len(KINDS) + 1
        self.names = sorted({r[0] for r in rows} - {""})
        number = {s: i for i, s in enumerate(self.names)}
        self.shape = np.array([number.get(r[0], -1) for r in rows], int)
        self.links = np.zeros((len(rows), 4, k))
        for i, r in enumerate(rows):
            for link in r[1].split():
                self.links[i, self.SIDES.index(link[:2]), int(link[2:])] += 1
        self.label, self.n = np.array([r[2] for r in rows], int), np.array([r[3] for r in rows], float)

    def ascent(self, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """The mean log pseudo-likelihood with the prior, and its gradient. w: bias (labels), shapes (shapes x labels), near and far (label of the earlier node x label of the later)."""
        total = self.n.sum()
        seen = self.shape >= 0
        score = w["bias"] + sum(self.links[:, s] @ (w[name].T if s % 2 == 0 else w[name]) for s, name in enumerate(("near", "near", "far", "far")))
        score[seen] += w["shapes"][self.shape[seen]]
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(self.n))
        value = (self.n * np.log(p[rows, self.label])).sum()
        away = -p * self.n[:, None]
        away[rows, self.label] += self.n
        shapes = np.zeros_like(w["shapes"])
        np.add.at(shapes, self.shape[seen], away[seen])
        pair = lambda f, b: away.T @ self.links[:, f] + self.links[:, b].T @ away
        gradient = {"bias": away.sum(axis=0), "shapes": shapes, "near": pair(0, 1), "far": pair(2, 3)}
        value -= PRIOR / 2 * sum((x * x).sum() for x in w.values())
        return value / total, {name: (g - PRIOR * w[name]) / total for name, g in gradient.items()}


def fit(rows: list[tuple[str, str, int, int]]) -> Field:
    """The field of greatest pseudo-likelihood of the counted configurations (shape, links, label, n)."""
    k = len(KINDS) + 1
    field = Field([])
    if not rows:
        return field
    data = Configurations(rows)
    # The link of distant tokens has no direction: its weights are kept symmetrical.
    w = {"bias": np.zeros(k), "shapes": np.zeros((len(data.names), k)), "near": np.zeros((k, k)), "far": np.zeros((k, k))}
    m, v = ({name: np.zeros_like(x) for name, x in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        _, g = data.ascent(w)
        g["far"] = (g["far"] + g["far"].T) / 2
        for name in w:
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
            w[name] = w[name] + RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    field.unseen, field.shapes, field.pairs = w["bias"], {s: w["bias"] + x for s, x in zip(data.names, w["shapes"])}, np.stack([w["near"], w["far"]])
    return field


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """Learns from all documents; what reaches the driver is a row for each configuration."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = rows.mapInPandas(_counted, "shape string, links string, label int, n long").groupBy("shape", "links", "label").agg(F.sum("n").alias("n"))
    return fit([tuple(r) for r in counts.orderBy("shape", "links", "label").collect()])


def recovery(texts: list[str], field: Field, share: int = 30) -> tuple[int, int, int, int]:
    """How well the links alone give labels back: of tokens in base spans, `share` of a hundred lose their label and their shape.

    Returns how many were hidden, how many of those have a link to a distant token that kept its label, how many got a label, and how many the right one.
    """
    hidden = linked = found = right = 0
    for text in texts:
        if not ANY.search(text):
            continue
        t = Tokens(text, base(text))
        own = [i for i, (s, e) in enumerate(t.at) if t.label[i] and crc32(f"{e}:{text[s:e]}:{s}".encode("utf-8", "surrogatepass")) % 100 < share]
        true = t.label.copy()
        for i in own:
            t.label[i], t.shape[i] = 0, None
        if own:
            p = field.beliefs([t])
            kept = {x for i, j, kind in t.links if kind for x, y in ((i, j), (j, i)) if t.label[y]}
            hidden, linked = hidden + len(own), linked + len(kept & set(own))
            for i in own:
                if p[i, 1:].max() >= ADDED:
                    found, right = found + 1, right + (int(p[i].argmax()) == true[i])
    return hidden, linked, found, right


def spans_of(texts: list[str], field: Field, settled: list[bool] | None = None) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """For each text, its base spans by kind and all spans by kind. settled: gets, for each text, whether its messages settled."""
    found = [base(t) for t in texts]
    marked = [(n, Tokens(t, found[n])) for n, t in enumerate(texts) if ANY.search(t)]
    every = [[list(s) for s in f] for f in found]
    if marked:
        rest: list[bool] = []
        p, at = field.beliefs([t for _, t in marked], rest), 0
        if settled is not None:
            quiet = dict(zip((n for n, _ in marked), rest))
            settled.extend(quiet.get(n, True) for n in range(len(texts)))
        for n, t in marked:
            own = p[at : at + len(t.at)]
            at += len(t.at)
            for i in np.flatnonzero((t.label == 0) & (own[:, 1:].max(axis=1) >= ADDED)):
                start, end = t.at[i]
                token = texts[n][start:end]
                start, end = start + len(token) - len(token.lstrip(EDGE)), end - (len(token) - len(token.rstrip(EDGE)))
                if start < end:
                    every[n][int(own[i, 1:].argmax())].append((start, end))
    elif settled is not None:
        settled.extend([True] * len(texts))
    return [(f, [sorted(set(s)) for s in e]) for f, e in zip(found, every)]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans) for s, e in own)


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), in code points, end exclusive; settled: false where the messages did not settle within LEAST_SWEEPS sweeps and SWEEPS more a token, so that beliefs are those of the last sweep."""
    small_batches(docs.sparkSession)
    field = field or train(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.iloc[k : k + 512]
                settled: list[bool] = []
                got = spans_of(part.text.tolist(), field, settled)
                flat = lambda by: [{"kind": kind, "start": s, "end": e} for kind, own in zip(KINDS, by) for s, e in own]
                yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64").to_numpy(), "base": [flat(b) for b, _ in got], "spans": [flat(e) for _, e in got], "settled": settled}).astype({"doc_id": "Int64"})

    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInPandas(run, f"doc_id long, base {span}, spans {span}, settled boolean")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans, all spans as text, and whether the document settled."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), "settled")


def base_digest(text: str | None) -> str:
    return sha256(joined(base(text or "")).encode()).hexdigest()
