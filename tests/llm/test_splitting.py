import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.llm import splitting as P

ALPHABET = "ab .,;\n!é́中。\r"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=300), st.integers(1, 60), st.integers(0, 59))
def test_against_brute_force(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans, force = P.spans(text, size, overlap), P.strengths(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 <= e - s <= size for s, e in spans)
    least = min(size, max(overlap + 1, int(size * P.LEAST_SHARE)))
    for (s, e), (t, _) in zip(spans, spans[1:]):
        assert t == e - overlap
        assert e == max(range(s + least, s + size + 1), key=lambda k: (force[k], k))


def test_range_maximum():
    rng = random.Random(1)
    values = [rng.randrange(-1, 5) for _ in range(200)]
    import numpy as np

    index = P.RangeMax(np.array(values))
    for _ in range(500):
        a = rng.randrange(200)
        b = rng.randrange(a, 200)
        assert index.argmax(a, b) == max(range(a, b + 1), key=lambda k: (values[k], k))


def test_prefers_paragraphs_and_sentences():
    text = "One two three. Four five six.\n\nSeven eight nine ten eleven twelve."
    assert text[slice(*P.spans(text, 40, 0)[0])] == "One two three. Four five six.\n\n"
    assert P.spans("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    with pytest.raises(ValueError):
        P.spans("abc", 2, 2)


def test_tables(spark):
    schema = "row_id long, relative_path string, chunk_index int, char_start long, text string, pieces string, piece_index string, id string"
    long = "word " * 20_000
    rows = [(1, "a", 0, 100, long, "", "", ""), (2, "a", 1, None, "short", "", "", ""), (3, None, None, 5, "", "", "", ""), (4, "b", 0, 0, None, "", "", ""), (2, "a", 1, None, "short", "", "", ""), (5, "c", 0, None, "😀" * 1201, "", "", "")]
    df = spark.createDataFrame(rows, schema)
    out = P.split(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.row_id, []).append(r)
    assert 4 not in by and len(by[2]) == 2 and len(by[3]) == 1 and by[3][0].text == ""
    pieces = sorted(by[1], key=lambda r: r.piece_index)
    assert all(len(r.text) <= 1200 and r.char_start == 100 + r.piece_start and r.char_end == r.char_start + len(r.text) for r in pieces)
    assert "".join(r.text if k == 0 else r.text[200:] for k, r in enumerate(pieces)) == long
    assert [r.pieces for r in by[5]] == [2, 2] and by[5][0].char_start is None
    assert P.split(df.limit(0)).count() == 0
