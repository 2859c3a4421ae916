"""Ids of whole texts by a public tokenizer, each distinct unit of text encoded once.

A text is a run of UTF-8 bytes. Blanks and line feeds cut it into words; a word of ASCII characters and Latin letters alone is
cut again wherever letters and other characters meet. The tokenizer cuts in all these places itself, so the ids
of a text are those of its units, one after the other. Units are found and hashed by array operations over the bytes (two
independent 64-bit hashes, letters of either case alike, as the tokenizer lower-cases), and only a unit that a worker does not know is
handed to the tokenizer: small Latin letters straight to its byte-pair model, since they are one pre-token, and all else the whole way.
Words with anything else in them (apostrophes, other scripts, white space but blanks and line feeds, the sign that opens special
tokens), and very long words, are not hashed but encoded whole.

This holds for tokenizers with the normalizer and pre-tokenizer named in SETTINGS; with another, texts are encoded as they are.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pandas as pd

#: The settings for which cutting as above gives the tokenizer's own ids.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
#: Units that a worker keeps (about 40 bytes each) and words that it keeps as strings, before it starts afresh.
UNITS, WHOLE_WORDS = 500_000, 50_000
#: Bytes of text that are worked on at a time; a word of more than LONG bytes is encoded by itself; strings in one call of the tokenizer.
WINDOW, LONG, GROUP = 1 << 18, 192, 1000
SEPARATOR, LETTER, OTHER, WHOLE = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """The class of each byte by itself; the bytes of two-byte letters are told apart by _class_of."""
    out = np.full(256, WHOLE, np.uint8)
    out[0x21:0x7F] = OTHER
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = LETTER
    out[ord("'")] = out[ord("<")] = WHOLE
    out[ord(" ")] = out[ord("\n")] = SEPARATOR
    return out


CLASSES = _classes()
_RANDOM = np.random.default_rng(20)
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
#: A random number for each byte, the same for A-Z as for a-z, for each of the two hashes.
NUMBERS = [_RANDOM.integers(1, 1 << 63, 256, np.uint64) for _ in BASES]
for _own in NUMBERS:
    _own[ord("A") : ord("Z") + 1] = _own[ord("a") : ord("z") + 1]


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = [_powers(b, WINDOW + LONG + 1) for b in BASES]
INVERSES = [_powers(pow(b, -1, 1 << 64), WINDOW + LONG + 1) for b in BASES]


def _class_of(data: np.ndarray) -> np.ndarray:
    """The class of every byte. Two-byte characters from U+00C0 to U+023F are letters, but for the signs U+00D7 and U+00F7 and for U+0130, whose small form is two characters."""
    out = CLASSES[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    first, second = data[lead], data[lead + 1]
    good = ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0))
    out[lead[good]] = out[lead[good] + 1] = LETTER
    return out


def units_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and which are to be encoded whole without hashing; no unit crosses a byte where a text begins."""
    kind = _class_of(data)
    solid = kind != SEPARATOR
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = edge[-1] = edge[0] = True
    edge[1:-1] |= solid[1:] != solid[:-1]
    starts = np.flatnonzero(solid & edge[:-1])
    ends = np.flatnonzero(solid & edge[1:]) + 1
    odd = np.append(0, np.cumsum(kind == WHOLE, dtype=np.int32))
    whole = (odd[ends] > odd[starts]) | (ends - starts > LONG)
    # Words that may be cut where letters and other characters meet.
    change = np.flatnonzero((kind[1:] != kind[:-1]) & solid[1:] & solid[:-1] & ~edge[1:-1]) + 1
    change = change[~whole[np.searchsorted(starts, change, side="right") - 1]] if len(change) else change
    if not len(change):
        return starts, ends, whole
    place = np.searchsorted(starts, change, side="right")
    return np.insert(starts, place, change), np.insert(ends, np.searchsorted(ends, change, side="left"), change), np.insert(whole, place, False)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each unit data[start:end], by differences of running sums; units lie in order."""
    out = [np.zeros(len(starts), np.uint64) for _ in BASES]
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + WINDOW))
        low = int(starts[at])
        own = data[low : min(int(ends[to - 1]), low + WINDOW + LONG)]
        s, e = starts[at:to] - low, ends[at:to] - low
        for k in range(len(BASES)):
            run = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(NUMBERS[k][own] * POWERS[k][: len(own)], out=run[1:])
            out[k][at:to] = (run[e] - run[s]) * INVERSES[k][s]
        at = to
    # The length goes in: a run of one byte must not look like another of another length by chance of its number.
    return [x ^ (np.asarray(ends - starts).astype(np.uint64) * np.uint64(BASES[1 - k])) for k, x in enumerate(out)]


class Pool:
    """Known units by their hashes, sorted, and their ids, all in one array."""

    def __init__(self):
        self.keys, self.checks, self.at, self.length = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.ids = np.zeros(0, "<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of the units, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are there, whatever their checks."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(every := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = every[order]
        self.checks, self.at, self.length = (np.concatenate(x)[order] for x in ((self.checks, checks), (self.at, at), (self.length, length)))


#: The byte-level alphabet: bytes without a visible Latin-1 character stand, in order, for the characters from U+0100.
HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(HIDDEN)}


class CachedTokenizer:
    """Ids of texts, as of the tokenizer's encode without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        settings = json.loads(self.inner.to_str())
        # Added tokens are looked for in raw text: they must lie within a word and open with the sign that keeps a word whole.
        plain = lambda t: t["content"][:1] == "<" and not any(c.isspace() for c in t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])
        self.cuts = all(settings[k] == v for k, v in SETTINGS.items()) and settings["model"]["type"] == "BPE" and settings["model"]["dropout"] is None and all(map(plain, settings["added_tokens"]))
        self.pool, self.words = Pool(), {}

    def whole_way(self, strings: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(strings), GROUP):
            group = strings[k : k + GROUP]
            encoded = self.inner.encode(group, is_pretokenized=True, add_special_tokens=False)
            ids, n = np.array(encoded.ids, "<u4"), np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(group))
            out += np.split(ids, np.cumsum(n)[:-1])
        return out

    def new_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in lower case, one after the other, and how many each has."""
        letters = [u[:1].isalpha() for u in units]
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(u if u.isascii() else u.encode().decode("latin-1").translate(BYTE_CHARS))] if own else () for u, own in zip(units, letters)]
        rest = [n for n, own in enumerate(letters) if not own]
        for n, ids in zip(rest, self.whole_way([units[n] for n in rest])):
            found[n] = ids.tolist()
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(length.sum())), length

    def encode_bytes(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin; text n is data[begins[n]:begins[n + 1]]."""
        starts, ends, whole = units_of(data, begins[:-1][begins[:-1] < len(data)])
        length, source = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        hashed = np.flatnonzero(~whole)
        keys, checks = hashes(data, starts[hashed], ends[hashed])
        code, unique = pd.factorize(keys)
        first = np.zeros(len(unique), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        unlike = checks != checks[first][code]  # one key, two units: never yet seen
        if len(self.pool.keys) > UNITS:
            self.pool = Pool()
        place = self.pool.find(unique, checks[first])
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            where = hashed[first[new]]
            units = [raw[a:b].decode().lower() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            # A key already there with another check is left out of the pool, and encoded whole.
            clash = self.pool.has(unique[new])
            self.pool.add(unique[new][~clash], checks[first[new]][~clash], *self.new_units([u for u, c in zip(units, clash) if not c]))
            place = self.pool.find(unique, checks[first])
        known = ~unlike & (place >= 0)[code]
        length[hashed[known]], source[hashed[known]] = self.pool.length[place[code[known]]], self.pool.at[place[code[known]]]
        pool = self.pool.ids
        apart = np.sort(np.concatenate([np.flatnonzero(whole), hashed[~known]]))
        if len(apart):
            extra = self.whole_words(data, starts[apart], ends[apart])
            length[apart] = np.fromiter(map(len, extra), np.int64, len(extra))
            source[apart] = len(pool) + np.cumsum(length[apart]) - length[apart]
            pool = np.concatenate([pool, *extra])
        to = np.cumsum(length)
        ids = pool[np.repeat(source - (to - length), length) + np.arange(to[-1] if len(to) else 0)]
        return ids, np.append(0, to)[np.searchsorted(starts, begins)]

    def whole_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        strings = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.words) > WHOLE_WORDS:
            self.words = {}
        new = [w for w in dict.fromkeys(strings) if w not in self.words]
        got = dict(zip(new, self.whole_way(new)))
        out = [got[w] if w in got else self.words[w] for w in strings]
        self.words.update((w, ids) for w, ids in got.items() if len(w) <= LONG)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        begins = np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64))
        ids, at = self.encode_texts(np.frombuffer(b"".join(raw), np.uint8), begins)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode_texts(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.cuts:
            return self.encode_bytes(data, begins)
        raw = data.tobytes()
        ids = [np.array(self.inner.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u4") for a, b in zip(begins[:-1], begins[1:])]
        return np.concatenate([*ids, np.zeros(0, "<u4")]), np.append(0, np.cumsum([len(i) for i in ids], dtype=np.int64))
