"""Column functions over text: counting, splitting, identifiers and renderings. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and patterns that results depend on.
PATH_JOINER, CATEGORY_JOINER = " > ", "; "
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
DISPLAY_MATH = r"\\begin\{(?:equation|align|gather|multline|eqnarray|displaymath)\*?\}|\\\[|\$\$"
ARXIV_ID = r"^(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?$"
CHARS_PER_TOKEN = 3.5
QUERY_PROMPT = "Instruct: Given a physics literature search query, retrieve relevant passages that answer the query\nQuery: "


def count_words(text: Column) -> Column:
    """White-space separated tokens, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)))


def estimate_answer_tokens(text: Column) -> Column:
    """The budget estimate of evidence: characters / 3.5, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN))).cast("int")


def has_display_math(text: Column) -> Column:
    return text.rlike(DISPLAY_MATH)


def pack_sentences(text: Column, max_tokens: int) -> Column:
    """Sentences packed greedily into pieces of at most max_tokens words; a longer sentence stays whole."""
    sentences = F.filter(F.split(F.trim(text), SENTENCE_BREAK), lambda s: F.trim(s) != "")
    sized = F.transform(sentences, lambda s: F.struct(F.trim(s).alias("text"), count_words(s).cast("int").alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(state: Column, s: Column) -> Column:
        fits = (state["n"] > 0) & (state["n"] + s["n"] <= max_tokens)
        flush = (state["n"] > 0) & ~fits
        return F.struct(
            F.when(flush, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(fits, F.concat_ws(" ", state["open"], s["text"])).otherwise(s["text"]).alias("open"),
            F.when(fits, state["n"] + s["n"]).otherwise(s["n"]).cast("int").alias("n"),
        )

    return F.aggregate(sized, start, step, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def chunk_id(paper_id: Column, section_path: Column, index: Column, text: Column) -> Column:
    digest = F.sha1(F.concat_ws("\n", paper_id, F.array_join(section_path, "/"), index.cast("string"), F.substring(text, 1, 500)))
    return F.format_string("%s:chunk:%05d:%s", paper_id, index, F.substring(digest, 1, 12))


def join_path(path: Column) -> Column:
    return F.array_join(path, PATH_JOINER)


def render_dense(title: Column, section_path: Column, categories: Column, text: Column) -> Column:
    """Labelled metadata lines, a blank line and the text; the text alone where there is no metadata."""
    names = F.array_join(F.transform(categories, join_path), CATEGORY_JOINER)
    lines = [F.concat(F.lit(label), F.nullif(value, F.lit(""))) for label, value in (("Title: ", title), ("Section: ", join_path(section_path)), ("Living Review categories: ", names))]
    head = F.concat_ws("\n", *lines)
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def render_lexical(title: Column, section_path: Column, categories: Column, text: Column) -> Column:
    """Title, section, each category and the text, one a line; empty parts are left out."""
    names = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<array<string>>")), join_path), lambda x: x != "")
    return F.array_join(F.concat(F.filter(F.array(title, join_path(section_path)), lambda x: x.isNotNull() & (x != "")), names, F.filter(F.array(text), lambda x: x != "")), "\n")


def arxiv_id(eprint: Column, archive_prefix: Column) -> Column:
    clean = F.trim(eprint)
    ours = archive_prefix.isNull() | (F.trim(archive_prefix) == "") | (F.lower(F.trim(archive_prefix)) == "arxiv")
    return F.when(ours & clean.rlike(ARXIV_ID), clean)


def safe_id(value: Column) -> Column:
    return F.replace(value, F.lit("/"), F.lit("_"))


def safe_name(value: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(name == "", F.lit("embeddings")).otherwise(name)


def is_useful_paragraph(text: Column, least: int = 8) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")) >= least


def is_retrieval_section(path: Column) -> Column:
    last = F.lower(F.trim(F.try_element_at(path, F.lit(-1))))
    return ~F.coalesce(last.rlike(r"^(?:acknowledgements?|acknowledgments?|the .+ collaboration)$"), F.lit(False))


def normalize_vector(v: Column) -> Column:
    """v / max(|v|, 1e-12), in doubles."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def yes_probability(log_yes: Column, log_no: Column) -> Column:
    """P(yes) / (P(yes) + P(no)) from log probabilities; a missing one counts as -10."""
    yes, no = F.exp(F.coalesce(log_yes, F.lit(-10.0))), F.exp(F.coalesce(log_no, F.lit(-10.0)))
    return yes / (yes + no)


def cited_numbers(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def has_valid_citations(answer: Column, allowed: Column) -> Column:
    """Some citation, and none outside the allowed numbers."""
    cited = cited_numbers(answer)
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, allowed)) == 0)


def source_numbers(context: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(context, F.lit(r"\[SOURCE (\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
