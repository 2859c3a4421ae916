"""Papers from trees of TeX files: main file, inlined inputs, body, sections, paragraphs and captions.

Files of a paper are grouped and parsed together; a failure is a row of its own and stops nothing.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from paperlane.plans.stored import small_batches

# What marks main files, sections, display mathematics and parts that are left out.
LEVELS = {"section": 0, "subsection": 1, "subsubsection": 2, "paragraph": 3}
MAIN_NAMES = ("main.tex", "paper.tex", "ms.tex", "article.tex")
UNLIKELY_NAMES = ("author", "package", "definition", "macro")
DROPPED_INPUTS = (".bib", ".bbl", ".sty", ".cls")
MATH = ("equation", "equation*", "align", "align*", "eqnarray", "eqnarray*", "gather", "gather*", "multline", "multline*", "split")
FLOATS, LISTS = ("figure", "figure*", "table", "table*"), ("itemize", "enumerate")
FIGURE_MACROS = {"singlefigure": (4, (2,)), "doublefigure": (8, (2, 5, 6))}
REFERENCES = ("ref", "eqref", "autoref", "cref", "Cref", "pageref")
AFTER_BODY = ("\\bibliography", "\\begin{thebibliography}", "\\appendix")
NOT_SEARCHED = re.compile(r"acknowledge?ments?|the .+ collaboration")
LEAST_WORDS, DEEPEST = 8, 10

NESTED = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
SECTION = re.compile(r"\\(section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?" + NESTED)
INPUT = re.compile(r"\\(?:input|include)\s*\{([^}]*)\}")


def environments(names: tuple[str, ...]) -> str:
    """A pattern of whole environments of these names; group `name` is the name, `inside` what it holds."""
    return rf"\\begin\{{(?P<name>{'|'.join(map(re.escape, names))})\}}(?P<inside>.*?)\\end\{{(?P=name)\}}"


MATH_BLOCK = re.compile(environments(MATH) + r"|\\\[.*?\\\]|\$\$.*?\$\$", re.S)
FLOAT, LIST = re.compile(environments(FLOATS), re.S), re.compile(environments(LISTS), re.S)
LABEL, REFERENCE = re.compile(r"\\label\s*\{[^}]*\}"), re.compile(rf"\\(?:{'|'.join(REFERENCES)})\*?(?:\[[^\]]*\])?\s*\{{[^}}]*\}}")
ITEM = re.compile(r"\\item\b(?:\[[^\]]*\])?")
ABSTRACT_HEADING = re.compile(r"(?:\\textbf\{|\{\\bf\s+)Abstract\}(.*?)\\(?:clearpage|newpage|tableofcontents|section\*?\{)", re.S)
#: Stand for a list item, and for the end of a list, until white space is folded.
ITEM_MARK, LIST_END = "\x01", "\x02"


def main_score(path: Column, content: Column) -> Column:
    """How much a file looks like a paper's main file."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    has = lambda mark: F.contains(content, F.lit(mark))
    unlikely = F.lit(False)
    for word in UNLIKELY_NAMES:
        unlikely = unlikely | F.contains(name, F.lit(word))
    sections = F.regexp_count(content, F.lit(rf"\\(?:{'|'.join(LEVELS)})\*?\{{"))
    signs = [(100, has("\\documentclass")), (100, has("\\begin{document}")), (20, has("\\title")), (20, has("\\begin{abstract}") | has("\\abstract{"))]
    likely = 5 * sections
    for points, sign in signs:
        likely = likely + points * sign.cast("int")
    return (likely + F.when(name.isin(*MAIN_NAMES), 20).otherwise(0) - F.when(unlikely, 30).otherwise(0)).cast("int")


def best_main(of: Column) -> Column:
    """score, n (bytes) and path of the best of the files that `of` holds for: the best scored, then the longest, then the last by path."""
    return F.max(F.when(of, F.struct(main_score(F.col("path"), F.col("content")).alias("score"), F.octet_length("content").alias("n"), "path")))


def main_files(files: DataFrame) -> DataFrame:
    """paper_id, main_tex_path: the best scored .tex file, then the longest, then the last by path."""
    tex = files.where(F.lower("path").endswith(".tex"))
    return tex.groupBy("paper_id").agg(best_main(F.lit(True)).alias("best")).select("paper_id", F.col("best.path").alias("main_tex_path"), F.col("best.score").alias("main_score"))


def strip_comments(text: str) -> str:
    out = []
    for line in text.split("\n"):
        kept = re.sub(r"(?<!\\)((?:\\\\)*)%.*", r"\1", line)
        if kept.strip() or not line.strip():
            out.append(kept)
    return "\n".join(out)


def inline_inputs(path: str, files: dict[str, str], seen: set[str] | None = None, depth: int = 0) -> str:
    """The file with its inputs put in place, each once, within the paper's own files; comments go first, so commented inputs stay out."""
    seen = {path} if seen is None else seen
    root = posixpath.dirname(path)

    def put(m: re.Match) -> str:
        name = m[1].strip()
        if depth >= DEEPEST or name.lower().endswith(DROPPED_INPUTS):
            return ""
        for base in (root, ""):
            for end in ("", ".tex"):
                full = posixpath.normpath(posixpath.join(base, name + end))
                if full in files and full not in seen:
                    seen.add(full)
                    return inline_inputs(full, files, seen, depth + 1)
        return ""

    return INPUT.sub(put, strip_comments(files[path]))


def argument(text: str, at: int, opener: str = "{") -> tuple[str, int] | None:
    """The balanced argument at or after white space at `at`, and where it ends; a character after a backslash neither opens nor closes."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text) or text[at] != opener:
        return None
    closer, depth = {"{": "}", "[": "]"}[opener], 0
    for m in re.finditer(rf"\\.|[{re.escape(opener + closer)}]", text[at:], re.S):
        depth += (m[0] == opener) - (m[0] == closer)
        if not depth:
            return text[at + 1 : at + m.start()], at + m.end()
    return None


def captions(text: str) -> list[str]:
    """First the first braces after each \\caption (not of one inside another), then captions of figure macros, macro by macro."""
    found, at = [], 0
    while (start := text.find("\\caption", at)) >= 0 and (brace := text.find("{", start)) >= 0:
        got = argument(text, brace)
        at = got[1] if got else brace + 1
        found += [got[0]] if got else []
    for _, _, args, wanted in macro_calls(text):
        found += [args[i] for i in wanted]
    return [c for t in found if (c := clean(t))]


def macro_calls(text: str):
    """(start, end, arguments, caption places) of the known figure macros that have all their arguments."""
    for name, (n, wanted) in FIGURE_MACROS.items():
        done = 0
        for m in re.finditer(rf"(?<!\\)\\{name}(?![A-Za-z])", text):
            if m.start() < done:
                continue
            at, args = m.end(), []
            if option := argument(text, at, "["):
                at = option[1]
            while len(args) < n and (got := argument(text, at)):
                args.append(got[0])
                at = got[1]
            if len(args) == n:
                done = at
                yield m.start(), at, args, wanted


def clean(text: str) -> str:
    """Readable text: references and labels go, white space folds, list items start lines, display mathematics keeps its own lines; citations stay."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        lines = (line.strip() for line in REFERENCE.sub("", LABEL.sub("", m[0])).splitlines())
        held.append("\n".join(line for line in lines if line))
        return f"\x00{len(held) - 1}\x00"

    prose = REFERENCE.sub(" ", LABEL.sub("", MATH_BLOCK.sub(hold, text).replace("~", " ")))
    prose = re.sub(r"\s+", " ", prose).replace(ITEM_MARK + " ", "\n- ").replace(ITEM_MARK, "\n- ").replace(LIST_END, "\n")
    trim = lambda t: re.sub(r"[ \t]*\n[ \t]*", "\n", t)
    whole = re.sub(r"\x00(\d+)\x00", lambda m: f"\n{held[int(m[1])]}\n", trim(prose))
    return re.sub(r"\n{3,}", "\n\n", trim(whole)).strip()


def set_apart(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The text between the spans, without the white space next to them."""
    edges = [0, *(x for span in spans for x in span), len(text)]
    between = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
    last = len(between) - 1
    return [(t.strip() if 0 < n < last else t.lstrip() if n else t.rstrip()) if last else t for n, t in enumerate(between)]


def without_floats(text: str) -> str:
    """Floats, then figure macros, become line ends; the text around them is one paragraph, unless two of them meet."""
    text = "\n".join(set_apart(text, [m.span() for m in FLOAT.finditer(text)]))
    for name in FIGURE_MACROS:
        own = [(start, end) for start, end, _, _ in macro_calls(text) if text.startswith(name, start + 1)]
        text = "\n".join(set_apart(text, own))
    return text


def for_splitting(text: str) -> str:
    """Without floats, and with lists as lines of the paragraph they stand in."""
    text = without_floats(text)
    found = list(LIST.finditer(text))
    items = [[i.strip() for i in ITEM.split(m["inside"])[1:] if i.strip()] for m in found]
    # A list without items only parts what stands around it.
    kept = [(m, own) for m, own in zip(found, items) if own]
    around = set_apart(text, [m.span() for m, _ in kept])
    lines = ["\n".join(f"{ITEM_MARK} {i}" for i in own) + LIST_END for _, own in kept]
    text = "\n".join(t for pair in zip(around, [*lines, ""]) for t in pair if t)
    text = LIST.sub("\n\n", text)
    text = re.sub(r"\\maketitle\b", "\n\n", text)
    text = re.sub(rf"\\(?:begin|end)\{{(?:{'|'.join(LISTS)})\}}", "\n", text)
    return ITEM.sub(f"\n{ITEM_MARK} ", text)


def split_blocks(text: str) -> list[str]:
    """Blocks between blank lines, except blank lines inside display mathematics."""
    names = "|".join(map(re.escape, MATH))
    blocks: list[list[str]] = [[]]
    depth, bracket, dollars = 0, False, False
    for line in text.splitlines():
        if not line.strip() and not (depth or bracket or dollars):
            blocks.append([])
            continue
        blocks[-1].append(line)
        depth = max(0, depth + len(re.findall(rf"\\begin\{{(?:{names})\}}", line)) - len(re.findall(rf"\\end\{{(?:{names})\}}", line)))
        bracket = (bracket or "\\[" in line) and "\\]" not in line
        dollars ^= line.count("$$") % 2 == 1
    return ["\n".join(b) for b in blocks if b]


def abstract_of(text: str) -> str | None:
    """Of the environment, the command or the heading, the first that holds anything."""
    environment = re.search(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", text, re.S)
    command = re.search(r"\\abstract(?=\{)", text)
    heading = ABSTRACT_HEADING.search(text)
    given = command and argument(text, command.end())
    raw = (environment and environment[1]) or (given and given[0]) or (heading and heading[1])
    return (clean(raw) or None) if raw else None


def body_of(text: str) -> str:
    """From the first section of the document to what follows the body."""
    text = re.split(r"\\begin\{document\}", text, maxsplit=1)[-1]
    text = re.split(r"\\end\{document\}", text, maxsplit=1)[0]
    if m := SECTION.search(text):
        text = text[m.start() :]
    for mark in AFTER_BODY:
        text = text.split(mark, 1)[0]
    return text


def paragraphs_of(paper_id: str, text: str) -> list[tuple[str, str, list[str], str]]:
    """(paragraph_id, kind, section_path, text) of a paper's inlined source, abstract first."""
    out = []
    if found := abstract_of(text):
        out.append((f"{paper_id}:abstract:p000", "abstract", ["Abstract"], found))
    body, path, at, n, c = body_of(text), ["Body"], 0, 0, 0
    for m in [*SECTION.finditer(body), None]:
        part = body[at : m.start() if m else len(body)]
        if not NOT_SEARCHED.fullmatch(re.sub(r"\s+", " ", path[-1].strip().lower())):
            for block in split_blocks(for_splitting(part)):
                if len((t := clean(block)).split()) >= LEAST_WORDS:
                    out.append((f"{paper_id}:p{n:05d}", "paragraph", list(path), t))
                    n += 1
            for t in captions(part):
                out.append((f"{paper_id}:caption:p{c:05d}", "caption", list(path), t))
                c += 1
        if m:
            at = m.end()
            path = path[: LEVELS[m[1]]] + [clean(m[2]) or m[1].title()]
    return out


def title_of(text: str) -> str | None:
    m = re.search(r"\\title(?![A-Za-z])\s*(?:\[[^\]]*\])?", text)
    got = argument(text, m.end()) if m else None
    return (clean(got[0]) or None) if got else None


PARSED = "paper_id string, main_tex_path string, title string, pos int, paragraph_id string, kind string, section_path array<string>, text string, error string"


def parsed_type() -> StructType:
    """PARSED as a type, without a session."""
    kinds = {"string": StringType(), "int": IntegerType(), "array<string>": ArrayType(StringType())}
    return StructType([StructField(name, kinds[kind]) for name, kind in map(str.split, PARSED.split(", "))])


def parsed_rows(paper: str, main: str | None, tree: dict[str, str]) -> list[tuple]:
    """Rows as of PARSED of one paper's tree; a paper that cannot be parsed gives one row with the error."""
    try:
        if main is None:
            raise ValueError("no TeX file")
        text = inline_inputs(main, tree)
        title = title_of(text)
        rows = [(paper, main, title, n, *p, None) for n, p in enumerate(paragraphs_of(paper, text))]
        if not rows:
            raise ValueError("no paragraphs")
    except Exception as e:  # one paper's failure is data
        rows = [(paper, main, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
    return rows


class ParseTex:
    """The table function parse_tex(TABLE files): files (paper_id, path, content, main_tex_path, and columns that are ignored) to rows as of PARSED. Calls need not
    partition the table: it is by paper_id, and one paper's tree is what a task holds."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("parse_tex takes a table of files")
        if missing := {"paper_id", "path", "content", "main_tex_path"} - set(files.dataType.names):
            raise ValueError(f"parse_tex needs the columns {sorted(missing)}")
        return AnalyzeResult(parsed_type(), partitionBy=[PartitioningColumn("paper_id")])

    def __init__(self):
        self.paper, self.main, self.tree = None, None, {}

    def eval(self, file: Row):
        self.paper, self.main = str(file["paper_id"]), file["main_tex_path"]
        self.tree[file["path"]] = file["content"]

    def terminate(self):
        if self.paper is not None:
            yield from parsed_rows(self.paper, self.main, self.tree)


def with_main(files: DataFrame) -> DataFrame:
    """files (paper_id, path, content) with main_tex_path, found by expressions."""
    return files.join(main_files(files).select("paper_id", "main_tex_path"), "paper_id", "left")


def parse_papers(files: DataFrame) -> DataFrame:
    """files (paper_id, path, content) to paragraphs; a paper that cannot be parsed gives one row with the error."""
    # Files are sent once, and a paper's tree becomes a row with its main file, found by expressions; a worker parses papers by the batch.
    tree = F.collect_list(F.struct("path", "content")).alias("tree")
    papers = files.groupBy("paper_id").agg(best_main(F.col("paper_id").isNotNull() & F.lower("path").endswith(".tex"))["path"].alias("main_tex_path"), tree)
    schema = to_arrow_schema(parsed_type())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for paper, main, tree in zip(*(c.to_pylist() for c in batch.columns)) for r in parsed_rows(str(paper), main, {f["path"]: f["content"] for f in tree})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small_batches(files.sparkSession)
    return papers.mapInArrow(parse, parsed_type())
