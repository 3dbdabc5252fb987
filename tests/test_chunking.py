import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.operators import chunking as C


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n#`", max_size=300), st.integers(5, 60), st.integers(0, 20), st.sampled_from(["", ".md", ".jsonl"]))
def test_chunks_are_their_spans(text, size, overlap, extension):
    overlap = min(overlap, size - 1)
    out = C.chunks(text, size, overlap, extension=extension)
    assert [c.index for c in out] == list(range(len(out)))
    for c in out:
        assert text[c.start : c.end] == c.text == c.text.strip() and c.text
        assert c.line_start == text[: c.start].count("\n") + 1 and c.line_end == text[: c.end - 1].count("\n") + 1
    covered = set()
    for c in out:
        covered.update(range(c.start, c.end))
    assert all(text[k].isspace() for k in range(len(text)) if k not in covered)


def test_natural_ends():
    text = "Alpha line\n\nBeta gamma delta epsilon"
    out = C.chunks(text, 18, 0)
    assert (out[0].start, out[0].end, out[0].line_start, out[0].line_end) == (0, 10, 1, 1) and out[1].line_start == 3
    assert C.chunks("One two. Three four five", 12, 0)[0].text == "One two."
    assert C.chunks("x" * 25, 10, 2)[1].start == 8
    assert C.chunks("", 10, 0) == [] and C.chunks("  \n ", 10, 0) == []


def test_markdown_sections_and_fences():
    text = "intro\n\n# A\ntext\n\n## B\nmore\n\n```\n# not a heading\n```\n\nC\n=\nend\n"
    out = C.chunks(text, 200, 0, extension=".md")
    assert [c.context for c in out] == ["", "A", "A > B", "C"]
    fenced = "word " * 12 + "\n```\n" + "code\n" * 6 + "```\n" + "tail " * 10
    out = C.chunks(fenced, 80, 10, extension=".md")
    assert any("```" in c.text and c.text.count("```") == 2 for c in out)


def test_json_and_jsonl():
    text = json.dumps({"a": [1, 2, 3], "b": {"c": "x" * 40, "d": "y" * 40}, "odd key": 1}, indent=1)
    out = C.chunks(text, 70, 0, extension=".json")
    assert [c.context for c in out][0].startswith("$") and any(c.context == "$.b.c" for c in out)
    lines = "\n".join(json.dumps({"n": k}) for k in range(10))
    out = C.chunks(lines, 25, 0, extension=".jsonl")
    assert [c.context for c in out] == ["$[0]", "$[2]", "$[4]", "$[6]", "$[8]"]
    assert C.chunks("{not json", 50, 0, extension=".json")[0].context == ""


def test_tables(spark):
    rows = [("a.md", "# T\n\nbody text here", ".md", "clash"), ("b.txt", None, ".txt", ""), ("c.txt", "", ".txt", ""), ("d.txt", "word " * 100_000, None, ""), (None, "x", ".txt", "")]
    df = spark.createDataFrame(rows, "relative_path string, text string, extension string, chunk_index string")
    out = C.chunked(df).collect()
    assert {r.relative_path for r in out} == {"a.md", "d.txt", None}
    assert all(len(r.text) <= 1200 for r in out)
    assert C.chunked(df.limit(0)).count() == 0


def test_pages_and_lines(spark):
    chunks = spark.createDataFrame([("f", 0, 0, 17), ("f", 1, 19, 36), ("f", 2, 10, 25), ("g", 0, 0, 5)], "relative_path string, chunk_index int, char_start int, char_end int")
    pages = spark.createDataFrame([("f", [(1, 0, 17), (2, 19, 36)])], "relative_path string, pages array<struct<page_number:int, char_start:int, char_end:int>>")
    got = {(r.relative_path, r.chunk_index): (r.page_start, r.page_end) for r in C.with_pages(chunks, pages).collect()}
    assert got == {("f", 0): (1, 1), ("f", 1): (2, 2), ("f", 2): (1, 2), ("g", 0): (None, None)}
    df = spark.createDataFrame([("a\nb\nc", 4)], "t string, k int")
    assert df.select(C.line_number(F.col("t"), F.col("k")).alias("x")).first().x == 3
