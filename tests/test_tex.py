"""Paragraphs, lists, floats, display mathematics and captions of TeX sources."""

import io
import tarfile

import pytest

from paperlane.sources import files, tex


def paragraphs(text):
    return [t for b in tex.split_blocks(tex.for_splitting(text)) if (t := tex.clean(b))]


LEAD, TAIL = "An opening sentence with plenty of words that leads to this:", "A last sentence with plenty of words that ends it."


def test_a_list_stays_in_its_paragraph():
    text = f"{LEAD}\n\n\\begin{{itemize}}\n  \\item one of them\n\n  \\item[b] the other\n\\end{{itemize}}\n\n{TAIL}\n\nOn its own."
    assert paragraphs(text) == [f"{LEAD}\n- one of them\n- the other\n{TAIL}", "On its own."]


def test_lists_in_a_row_and_lists_without_items():
    two = "\\begin{enumerate}\\item a\\end{enumerate}\n\n\\begin{itemize}\\item b\\end{itemize}"
    assert paragraphs(f"{LEAD}\n{two}\n{TAIL}") == [f"{LEAD}\n- a\n\n- b\n{TAIL}"]
    assert paragraphs(f"{LEAD}\\begin{{itemize}}\\end{{itemize}}{TAIL}") == [LEAD, TAIL]


def test_floats_do_not_part_a_paragraph():
    figure = "\\begin{figure*}[h]\n\\caption{Gone.}\n\n\\end{figure*}"
    assert paragraphs(f"The value $x$ is\n\n{figure}\n\nsmall here.") == ["The value $x$ is small here."]
    assert paragraphs(f"The value\n{figure}\n\n{figure}\nis") == ["The value", "is"]
    assert paragraphs("\\begin{wrapfigure}x\\end{wrapfigure}") == ["\\begin{wrapfigure}x\\end{wrapfigure}"]


@pytest.mark.parametrize("name", ["equation", "align*", "split", "multline"])
def test_display_mathematics_keeps_its_lines(name):
    text = f"So that\n\\begin{{{name}}}\n  a &= b \\label{{e}} \\\\\n\n  c &= \\eqref{{e}} d\n\\end{{{name}}}\nholds."
    assert paragraphs(text) == [f"So that\n\\begin{{{name}}}\na &= b  \\\\\nc &=  d\n\\end{{{name}}}\nholds."]


def test_other_displays():
    assert paragraphs("a \\[ x\n\ny \\] b $$ z\n\n$$ c") == ["a\n\\[ x\ny \\]\nb\n$$ z\n$$\nc"]
    assert paragraphs("a\n\n\\begin{displaymath}x\n\ny\\end{displaymath}") == ["a", "\\begin{displaymath}x", "y\\end{displaymath}"]


def test_references_go_and_citations_stay():
    assert tex.clean("See~\\ref*{a}, \\cref[s]{q} and \\autoref {x} of \\cite{k}\\label{z}.") == "See , and of \\cite{k}."


def test_comment_lines_do_not_part_a_paragraph():
    assert paragraphs(tex.strip_comments("One % gone\n%\n\\begin{equation}\n50\\% \\\\% two\n\\end{equation}\n%\nwhich is")) == ["One\n\\begin{equation}\n50\\% \\\\\n\\end{equation}\nwhich is"]


def test_section_paths():
    words = "one two three four five six seven eight"
    body = f"\\subsection{{Sub}}{words}\\section{{}}{words}\\paragraph{{P}}{words}\\section*{{The X   Collaboration}}{words}\\section{{Acknowledgement}}{words}\\section[short]{{Long {{name}}}}{words}"
    assert [p for _, _, p, _ in tex.paragraphs_of("x", body)] == [["Body", "Sub"], ["Section"], ["Section", "P"], ["Long {name}"]]


def test_the_body_runs_from_the_first_section_to_the_bibliography():
    words = "one two three four five six seven eight"
    text = f"\\begin{{document}}\\bibliographystyle{{x}} front matter of some more words than eight of them\\section{{A}}{words}\\bibliography{{y}} {words}\\end{{document}}"
    assert [t for *_, t in tex.paragraphs_of("x", text)] == [words]


def test_figure_macros():
    call = "\\doublefigure[htbp]\n{\\begin{tikz} \\draw (0,0); \\end{tikz}}{L}\n{First {a} caption.}\n{\\input{plot}}{R}\n{Second caption.}\n{Both.}\n{fig:x}"
    text = "The text before has enough words to be kept.\n" + call + "\n\\caption[s]{A \\} brace}\nThe text goes on after the macro with words. \\singlefigure{too}{few}"
    found = tex.paragraphs_of("x", "\\section{R}" + text)
    assert [(i, k) for i, k, _, _ in found] == [("x:p00000", "paragraph")] + [(f"x:caption:p{n:05d}", "caption") for n in range(4)]
    assert [t for *_, t in found[1:]] == ["A \\} brace", "First {a} caption.", "Second caption.", "Both."]
    assert "tikz" not in found[0][3] and "plot" not in found[0][3] and "goes on" in found[0][3] and "\\singlefigure{too}" in found[0][3]


def test_abstracts():
    assert tex.abstract_of("\\begin{abstract}\\end{abstract}\\abstract{From {the} command}") == "From {the} command"
    assert tex.abstract_of("{\\bf Abstract} From the heading\n\non. \\newpage \\section{A}") == "From the heading on."
    assert tex.abstract_of("\\textbf{Abstract} without an end") is None


def test_main_files(spark):
    rows = [("p", "a.tex", "\\documentclass{x}\\titlepage"), ("p", "b.tex", "\\documentclass{x}\\abstract x"), ("p", "macros.tex", "\\begin{document}" + "\\paragraph{a}" * 9), ("p", "z.tex", "é" * 9)]
    got = tex.main_files(spark.createDataFrame(rows, "paper_id string, path string, content string")).first()
    assert (got.main_tex_path, got.main_score) == ("a.tex", 120)


def test_source_kinds():
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w", format=tarfile.GNU_FORMAT) as t:
        info = tarfile.TarInfo("a.tex")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    old = bytearray(plain.getvalue())
    old[257:265] = bytes(8)  # as before the mark was introduced
    old[148:156] = b" " * 8
    old[148:156] = b"%06o\0 " % sum(old[:512])
    assert [files.kind_of(x) for x in (plain.getvalue(), bytes(old), b"\x1f\x8bbroken", b"", b"PK\x03\x04 no archive", None)] == ["tar", "tar", "gzip", "tex", "tex", None]
    assert list(files.members(bytes(old))) == [("a.tex", b"hi")]
