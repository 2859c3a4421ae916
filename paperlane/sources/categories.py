"""Category paths of cited papers from nested lists, and descriptions of categories: a line by line state, so a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CITE = re.compile(r"\\cite\w*\s*(?:\[[^\]]*\])*\s*\{([^}]*)\}")
# Replacements in titles.
LITERALS = (("\\&", "&"), ("\\%", "%"), ("\\_", "_"), ("\\#", "#"), ("~", " "), ("``", '"'), ("''", '"'))


def cite_keys(line: str) -> list[str]:
    return [k.strip() for group in CITE.findall(line) for k in group.split(",") if k.strip()]


def unwrap(text: str, command: str) -> str:
    """The argument where the text is one call of the command, else the text."""
    m = re.fullmatch(rf"\\{command}\s*\{{(.*)\}}", text.strip(), re.S)
    return m[1] if m else text


def clean_title(text: str) -> str:
    for a, b in LITERALS:
        text = text.replace(a, b)
    return " ".join(text.split())


def item_title(line: str) -> str:
    text = line.split("\\item", 1)[1]
    text = re.split(r"~?\\cite|\\\\", text)[0].strip()
    text = text[:-1].rstrip() if text.endswith(".") else text
    title = clean_title(unwrap(unwrap(text, "textbf"), "emph"))
    return title[:-1].rstrip() if title.endswith(".") else title


def parse_categories(tex: str) -> Iterator[tuple[str, str | None, list[str], str | None, int]]:
    """(kind, bib_key, path, description, ord): `cite` rows, each key and path once, and `description` rows."""
    depth, titles, seen, n = 0, [], set(), 0
    for line in tex.split("\n"):
        if line.lstrip().startswith("%"):
            continue
        if "\\item" in line and "\\begin{itemize}" not in line:
            titles = [*titles[: max(0, depth - 1)], item_title(line)]
            for key in cite_keys(line):
                if (key, tuple(titles)) not in seen:
                    seen.add((key, tuple(titles)))
                    yield "cite", key, list(titles), None, n
                    n += 1
        elif titles and (m := re.search(r"\\textit\s*\{((?:[^{}]|\{[^{}]*\})*)\}", line)):
            yield "description", None, list(titles), clean_title(m[1]), n
            n += 1
        depth += line.count("\\begin{itemize}") - line.count("\\end{itemize}")
        titles = titles[: max(0, depth)]


@F.udtf(returnType="kind string, bib_key string, path array<string>, description string, ord int")
class Categories:
    def eval(self, tex: str):
        yield from parse_categories(tex or "")


def read_categories(texts: DataFrame, text_col: str = "value") -> DataFrame:
    return texts.lateralJoin(Categories(F.col(text_col).outer()))


def paths_by_key(found: DataFrame) -> DataFrame:
    """bib_key, living_review_categories: the paths of each key in order."""
    return found.where("kind = 'cite'").groupBy("bib_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("living_review_categories"))
