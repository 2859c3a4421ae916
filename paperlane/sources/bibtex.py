"""BibTeX entries from text, as a Python table function: the grammar nests, so it is read by hand."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSER = {"{": "}", "(": ")"}
SKIPPED = {"comment", "preamble", "string"}
HEAD = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
FIELD = re.compile(r"\s*([A-Za-z][\w\-:.+]*)\s*=\s*")


def _end_of(text: str, start: int, opener: str) -> int:
    """Where the body that begins at `start` (after its opener) closes. Quotes hide nothing but the closing parenthesis."""
    depth, quoted = 0, False
    for i in range(start, len(text)):
        c = text[i]
        if text[i - 1] == "\\":
            continue
        if c == '"' and depth == 0:
            quoted = not quoted
        elif c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
        elif c == CLOSER[opener] and depth == 0 and not quoted:
            return i
    raise ValueError("an entry is not closed")


def _value(body: str, at: int) -> tuple[str, int]:
    """A braced, quoted or bare value and where it ends."""
    if at < len(body) and body[at] in '{"':
        quote, depth = body[at] == '"', 0
        for i in range(at + 1, len(body)):
            c = body[i]
            if body[i - 1] == "\\":
                continue
            if c == ('"' if quote else "}") and depth == 0:
                return body[at + 1 : i], i + 1
            depth += (c == "{") - (c == "}")
        raise ValueError("a value is not closed")
    end = body.find(",", at)
    end = len(body) if end < 0 else end
    return body[at:end], end


def parse_entries(text: str) -> Iterator[tuple[str, str, dict[str, str], str]]:
    """(type, key, fields, raw); types and field names in lower case, white space folded, the last of equal fields wins."""
    at = 0
    while m := HEAD.search(text, at):
        end = _end_of(text, m.end(), m[2])
        at = end + 1
        if m[1].lower() in SKIPPED:
            continue
        key, _, body = text[m.end() : end].partition(",")
        fields, i = {}, 0
        while f := FIELD.match(body, i):
            value, i = _value(body, f.end())
            fields[f[1].lower()] = " ".join(value.split())
            comma = body.find(",", i)
            if comma < 0:
                break
            i = comma + 1
        yield m[1].lower(), key.strip(), fields, text[m.start() : end + 1]


@F.udtf(returnType="entry_type string, key string, fields map<string,string>, raw string")
class BibEntries:
    def eval(self, text: str):
        yield from parse_entries(text or "")


def read_bibliography(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """One row for each entry of each text, beside the columns of texts."""
    return texts.lateralJoin(BibEntries(F.col(text_col).outer()))
