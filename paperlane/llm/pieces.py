"""SentencePiece encoding and decoding by a prefix table for models of the merge type (BPE).

Merging joins, over and over, the two neighbours whose union has the best score, the leftmost of equals. Whether a token is in the result
depends on its neighbours alone: a row of tokens is the encoding of its text if and only if each pair of neighbours is
compatible, that is, if merging the pair's own text would leave the border between them alone (the first merge over
a border would take place in the pair by itself as well). So each prefix of a text has one last token: of the tokens that an
automaton finds to end there, the one that is compatible with the last token of the prefix before it. A table of these, filled from left to right,
is read backwards for the ids: time goes with the text's length, however long a run without blanks is.

Pieces hold the blank's sign only in front, so no merge crosses from a letter to a blank after it, and texts fall into units (blanks, then what is no blank)
that are encoded each by itself; a worker keeps units that it has seen, within a bound. Characters without a piece become
the tokens of their bytes and never merge. The model file is read as it is; settings that this method does not cover are refused.

Null text is empty; an empty text has no ids and decodes to an empty text. Repeated rows are encoded each for itself. Empty tables give empty
results. Other columns pass through, whatever their names; the output column must be a new name.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from paperlane.llm.common import small_batches
from paperlane.llm.packing import byte_groups, text_bytes

#: Fixed values of the model format: field numbers and piece types; the sign for a blank; how an unknown id is shown.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK, UNKNOWN_TEXT, BPE = "▁", " ⁇ ", 2
#: Units that a worker keeps twice over (those of now and those before) and tested pairs before it starts afresh, the longest unit kept, and ids decoded at a time.
UNITS, PAIRS, LONGEST, IDS = 150_000, 1 << 18, 64, 1 << 18
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers, and bytes for all else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class PieceTokenizer:
    """Ids of texts and texts of ids."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as file:
            model = list(fields(file.read()))
        trainer, normalizer = ({k: v for n, raw in model if n == part for k, v in fields(raw)} for part in (TRAINER, NORMALIZER))
        self.text, self.score, self.kind = [], [], []
        for n, raw in model:
            if n == PIECES:
                piece = dict(fields(raw))
                self.text.append(piece[1].decode())
                self.score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kind.append(piece.get(3, NORMAL))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        lacks = [
            "a model of another type than merges" if trainer.get(3) != BPE else "",
            "no pieces for all bytes" if not trainer.get(35) or len(self.bytes) != 256 else "",
            "a normalizer" if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not normalizer.get(3, 1) else "",
            "blanks as suffixes" if trainer.get(24) else "",
            "user-defined or unused pieces" if {USER_DEFINED, UNUSED} & set(self.kind) else "",
            "blanks within pieces" if any(BLANK in t.lstrip(BLANK) for t in self.ids) else "",
            "pieces of characters that are no pieces" if any(c not in self.ids for c in {c for t in self.ids for c in t}) else "",
        ]
        if any(lacks):
            raise ValueError(f"{path} is not covered: {', '.join(filter(None, lacks))}")
        self.sizes, self.packed = [len(t) for t in self.text], [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.alphabet = frozenset(t for t in self.ids if len(t) == 1)
        self.merges: dict[int, list | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece) - 1, i, {}))
        self.automaton.make_automaton()
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.n_tested = 0
        shown = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else t.replace(BLANK, " ").encode() for t, k in zip(self.text, self.kind)]
        self.length = np.array([len(s) for s in shown], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    # Merging and pairs

    def merge_steps(self, token: int) -> list[tuple[float, int, int]] | None:
        """How merging makes the token of its characters: score of each merge, and the first and last token after it; None where merging ends otherwise."""
        if token not in self.merges:
            row, steps = [self.ids[c] for c in self.text[token]], []
            while len(row) > 1:
                unions = [self.ids.get(self.text[a] + self.text[b], -1) for a, b in zip(row, row[1:])]
                best = max((n for n, u in enumerate(unions) if u >= 0), key=lambda n: (self.score[unions[n]], -n), default=-1)
                if best < 0:
                    break
                row[best : best + 2] = [unions[best]]
                steps.append((self.score[unions[best]], row[0], row[-1]))
            self.merges[token] = steps if row == [token] else None
        return self.merges[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both leaves the border between them alone (left -1: the beginning). The two merge in the order of their scores; before each merge, that over the border must be worse."""
        ours, theirs = self.merge_steps(left) if left >= 0 else [], self.merge_steps(right)
        fits = theirs is not None and ours is not None
        if fits and left >= 0:
            a, b = self.ids[self.text[left][-1]], self.ids[self.text[right][0]]
            m = n = 0
            while True:
                one = ours[m][0] if m < len(ours) else -np.inf
                two = theirs[n][0] if n < len(theirs) else -np.inf
                union = self.ids.get(self.text[a] + self.text[b], -1)
                # Of equal scores the leftmost goes first: a merge on the left, the border, a merge on the right.
                if union >= 0 and self.score[union] > one and self.score[union] >= two:
                    fits = False
                    break
                if m == len(ours) and n == len(theirs):
                    break
                if m < len(ours) and one >= two:
                    a, m = ours[m][2], m + 1
                else:
                    b, n = theirs[n][1], n + 1
        return fits

    def table(self, known: str) -> list[int]:
        """The last token of each prefix of a string of known characters (-1 for the empty one)."""
        last, want = [-1], 0
        for at, (less, token, tested) in self.automaton.iter(known):
            if at == want:
                before = last[at - less]
                fits = tested.get(before)
                if fits or fits is None and self.test(before, token, tested):
                    last.append(token)
                    want += 1
        return last

    def test(self, before: int, token: int, tested: dict[int, bool]) -> bool:
        """Tests a pair and keeps the answer with the token."""
        if self.n_tested >= PAIRS:
            for _, _, kept in self.automaton.values():
                kept.clear()
            self.n_tested = 0
        self.n_tested += 1
        tested[before] = fits = self.compatible(before, token)
        return fits

    def recover(self, known: str) -> bytes:
        """Ids from the table, backwards."""
        last, at, out, sizes, packed = self.table(known), len(known), [], self.sizes, self.packed
        while at:
            token = last[at]
            out.append(packed[token])
            at -= sizes[token]
        out.reverse()
        return b"".join(out)

    def unit(self, unit: str) -> bytes:
        """The ids of one unit as bytes."""
        out = self.older.get(unit)
        if out is None:
            if self.alphabet.issuperset(unit):
                out = self.recover(unit)
            else:
                parts, begin = [], 0
                for at, c in enumerate([*unit, ""]):
                    if c not in self.alphabet:
                        parts += [self.recover(unit[begin:at]), *(self.packed[self.bytes[b]] for b in c.encode())]
                        begin = at + 1
                out = b"".join(parts)
        if len(unit) <= LONGEST:
            if len(self.units) >= UNITS:
                self.older, self.units = self.units, {}
            self.units[unit] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        return np.frombuffer(b"".join([self.units.get(u) or self.unit(u) for u in UNIT.findall(BLANK + text.replace(" ", BLANK))]), "<i4")

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding put in front goes, bytes that are no UTF-8 become U+FFFD each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.text)):
            raise ValueError("ids outside the model")
        parts = []
        for at in range(0, len(ids), IDS):
            some = ids[at : at + IDS]
            n = self.length[some]
            to = np.cumsum(n)
            parts.append(self.shown[np.repeat(self.start[some] - (to - n), n) + np.arange(to[-1])].tobytes())
        first = next((i for i in ids.tolist() if self.kind[i] != CONTROL), -1)
        whole = b"".join(parts)
        return whole[int(first >= 0 and self.text[first].startswith(BLANK)) :].decode("utf-8", "byte-by-byte")


codecs.register_error("byte-by-byte", lambda e: ("�", e.start + 1))


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> PieceTokenizer:
    """One for each worker process, over all its tasks."""
    return PieceTokenizer(path)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of ids in place of the text."""
    return _over(docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))), model_path, text_col, out, ArrayType(IntegerType()), _encoded)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with their text in place of the ids; null ids are none."""
    return _over(encoded.withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>"))), model_path, ids_col, out, StringType(), _decoded)


def _encoded(tokenizer: PieceTokenizer, texts: pa.Array) -> Iterator[pa.Array]:
    data, begins = text_bytes(texts)
    raw = memoryview(data)
    for low, high in byte_groups(begins):
        ids = [tokenizer.encode(str(raw[begins[n] : begins[n + 1]], "utf-8")) for n in range(low, high)]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def _decoded(tokenizer: PieceTokenizer, lists: pa.Array) -> Iterator[pa.Array]:
    # Parts of a batch, so that the working memory is that of some IDS ids or of one row.
    sizes = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    for low, high in byte_groups(sizes, IDS):
        yield pa.array([tokenizer.decode(lists[n].values.to_numpy(zero_copy_only=False)) for n in range(low, high)], pa.string())


def _over(rows: DataFrame, model_path: str, column: str, out: str, kind, work) -> DataFrame:
    """The rows with `work` of a column in its place, under the name `out`; the other columns go by their places."""
    if out in rows.columns and out != column:
        raise ValueError(f"there is a column {out} already")
    worker_tokenizer(model_path)  # refuses, here and now, a model that is not covered
    small_batches(rows.sparkSession)
    place = rows.columns.index(column)
    schema = StructType(rows.schema.fields[:place] + StructType().add(out, kind).fields + rows.schema.fields[place + 1 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(model_path)
        for batch in batches:
            at = 0
            for part in work(tokenizer, batch.column(place)):
                arrays = [part if n == place else batch.column(n).slice(at, len(part)) for n in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
                at += len(part)

    return rows.mapInArrow(run, schema)
