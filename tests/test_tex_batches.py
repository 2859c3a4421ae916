"""Papers are parsed by the batch, not each as a group of its own; trees and odd rows as before."""

from paperlane.sources import tex

WORDS = "one two three four five six seven eight"


def test_papers_of_many_files_and_odd_rows(spark):
    files = [
        ("a", "main.tex", f"\\documentclass{{x}}\\begin{{document}}\\section{{S}}\n\\input{{part}}\n\\end{{document}}"), ("a", "part.tex", WORDS), ("a", "notes.txt", "x"),
        ("b", "x.txt", WORDS), ("c", "main.tex", None), (None, "main.tex", WORDS), ("d", "main.tex", ""), ("e", "A.TEX", f"{WORDS}\n\n{WORDS} nine"),
    ]
    found = tex.parse_papers(spark.createDataFrame(files, "paper_id string, path string, content string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.paper_id, r.main_tex_path, r.pos, r.text, tuple(r.section_path or ()), r.error) for r in found.collect()}
    assert {g[:5] for g in got if g[5] is None} == {("a", "main.tex", 0, WORDS, ("S",)), ("e", "A.TEX", 0, WORDS, ("Body",)), ("e", "A.TEX", 1, f"{WORDS} nine", ("Body",))}
    assert {(g[0], g[1], g[5].partition(":")[0]) for g in got if g[5]} == {("b", None, "ValueError"), ("c", "main.tex", "AttributeError"), ("None", None, "ValueError"), ("d", "main.tex", "ValueError")}
