import random

import pytest

from lodespark.llm import page_repair as R

WORDS = "harvest meeting ledger archive warehouse customer delivery measure contract schedule journal complete because another inspection greenhouse certified quarterly document turbine statute reviewer".split()
SCHEMA = "row_id long, relative_path string, text string, page_start int, chunk_index int, defects string, lines string"


def prose(rng, n=70):
    out = []
    while len(out) < n:
        s = rng.choices(WORDS, k=rng.randrange(6, 12))
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out)


def scan(text, header, page, rng, damage=True):
    lines = R._wrap(text, 50)
    if damage:
        w = lines[1].split(" ")[1]
        lines[1] = lines[1].replace(w, w.replace("e", "c", 1) if "e" in w else w.replace("n", "ri", 1), 1)
        last = lines[2].rsplit(" ", 1)
        lines[2], lines[3] = last[0] + " " + last[1][:3] + "-", last[1][3:] + " " + lines[3]
    return "\n".join([header, *lines, f"- {page} -"])


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    clean = [(k, f"docs/{k}.md", prose(rng), None, 0, "d", "l") for k in range(300)]
    scans = [(1000 + k, "scans/a.pdf", scan(prose(rng), "Ostwick Ledger Office", k + 1, rng), k + 1, k, "d", "l") for k in range(8)]
    odd = [(2000, "scans/b.pdf", None, 1, 0, "d", "l"), (2001, "scans/b.pdf", "", 2, 1, "d", "l"), (2002, None, prose(rng), 3, 2, "d", "l"), (2003, "scans/c.pdf", prose(rng, 9000), 3, 2, "d", "l")]
    return spark.createDataFrame(clean + scans + odd, SCHEMA)


def test_finds_and_repairs_every_kind(frame):
    rows = {r.row_id: r for r in R.repaired(frame).collect()}
    assert set(rows) == {*range(1000, 1008), 2000, 2001, 2002, 2003}
    for k in range(1000, 1008):
        assert set(rows[k].defects) == {"header", "page_number", "hyphenation", "misread"}
        assert "Ostwick" not in rows[k].text and "\n" not in rows[k].text
        assert all(w.strip(".").lower() in WORDS for w in rows[k].text.split())
    assert rows[2000].text is None and rows[2000].defects == []
    assert rows[2001].text == "" and rows[2001].defects == []
    assert rows[2002].defects == [] and rows[2003].defects == []
    found = {(r[0], r[1]) for r in R.found(R.repaired(frame)).collect()}
    assert (1000, "header") in found and all(i < 2000 for i, _ in found)


def test_strings_of_code_and_chance_are_no_words(spark):
    rng = random.Random(4)
    text = prose(rng, 200) + "\nA cross-check, isn't it?\n在月底之前，经过核对。"
    code = 'AUD_KEY = "aud+hcr/9"\nrun(aud, "tbe-22")\n  id: EV-17-tlie\nqR/aud+zzk= hcr7\nxYzaB'
    df = spark.createDataFrame([(text,), (text,), (text + " aud",)] + [(code,)] * 200, "text string")
    known = R.vocabulary(df)
    assert not {"aud", "hcr", "tbe", "tlie", "zzk", "qr", "xyzab", "ev"} & set(known)
    assert {*WORDS, "cross-check", "cross", "check", "isn", "在月底之前", "经过核对"} <= set(known)
    chance = spark.createDataFrame([(text,)] * 60 + [(text + " aud",)] * 3, "text string")
    assert "aud" in R.vocabulary(chance) and "aud" not in R.vocabulary(chance, share=1e-3)
    editor = R.train_editor(R.vocabulary(chance, share=1e-3) | {"and": 900}, [text] * 20)
    assert editor.correct("aud") == "and"


def test_empty_tables(spark):
    assert R.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a", "Some text\nhere.", 1, 0, "", "")], SCHEMA)
    assert R.repaired(one).count() == 1  # nothing to learn from


def test_numbers_and_identifiers_stay():
    vocabulary = {w: 50 for w in WORDS}
    editor = R.train_editor(vocabulary, [" ".join(WORDS)] * 20)
    rep = R.Repairer(editor, R.train_furniture([" ".join(WORDS * 5)] * 40))
    text = "See EV-22190-UQ on 2024-03-01 for 1,200 units; mail a.b@c.example and third-party docu-\nment."
    new, kinds = rep.repair(text, {})
    assert "EV-22190-UQ" in new and "2024-03-01" in new and "1,200" in new and "a.b@c.example" in new and "third-party" in new
    assert new.endswith("document.") and kinds == ["hyphenation"]


def test_divided_compounds_keep_their_hyphen():
    vocabulary = {w: 50 for w in WORDS} | {"cross-check": 9, "cross": 9, "check": 9}
    editor = R.train_editor(vocabulary, ["the cross-check of " + " ".join(WORDS)] * 60)
    assert editor.join("cross", "-", "check") == "hyphen"
    assert editor.join("docu", "-", "ment") == "join"
    assert editor.join("EV", "-", "22190") == "hyphen" or editor.join("EV", "-", "22190") == "join"


def test_a_header_folds_with_its_misread_copies():
    assert R.fold("Harmere Pipeline Archive") == R.fold("Harrnere Pipelirie Arcbive")
    assert R.fold("NORVIK BAY OFFICE") == R.fold("Norvlk Bay 0ffice")


def test_misreads_at_held_out_accuracy():
    rng = random.Random(9)
    vocabulary = {w: 50 for w in WORDS}
    editor = R.train_editor(vocabulary, [" ".join(WORDS)] * 40, seed=1)
    right = total = 0
    for w in WORDS * 5:
        seen, n = R._damage(w, rng)
        if n and seen not in vocabulary:
            total += 1
            right += editor.correct(seen) == w
    assert right / total > 0.9
    assert all(editor.correct(w) is None for w in ("Quillanport", "zephyr", "xviii"))


def test_the_editor_decides_about_line_ends():
    vocabulary = {w: 50 for w in WORDS}
    editor = R.train_editor(vocabulary, [" ".join(WORDS)] * 40)
    furniture = R.train_furniture([" ".join(WORDS * 5)] * 40)
    text = "the quarterly docu-\nment and the green-\nhouse report, both pre-\nand certified."
    new, kinds = R.Repairer(editor, furniture).repair(text, {})
    assert "document" in new and "greenhouse" in new and kinds == ["hyphenation"]
    assert editor.join("pre", "-", "and") == "apart" and editor.join("docu", "-", "ment") == "join"
    editor.line_weights = R.Perceptron()  # what knows nothing joins nothing
    assert R.Repairer(editor, furniture).repair(text, {})[1] == []


def test_long_words_and_words_that_no_vocabulary_has():
    rng = random.Random(2)
    made = ["".join(rng.choice(("con", "ter", "man", "el", "ost", "ing", "ment", "ra", "li", "ver", "sta", "tion")) for _ in range(rng.randrange(2, 5))) for _ in range(500)]
    vocabulary = {w: 40 for w in made} | {"communicationinternational": 50}
    editor = R.train_editor(vocabulary, [" ".join(made)] * 20)
    assert editor.correct("cornrnunicationintcrnational") == "communicationinternational"  # three edits, however long
    alone = editor.by_characters("c0nterst4tion")[0]
    assert alone not in vocabulary and alone == "conterstation"  # characters alone
    assert editor.correct("manment" if "manment" in vocabulary else made[0]) is None


def test_the_classifier_sees_every_line():
    text = "annual report of the committee on public works and on the state of its many buildings, roads and bridges\nbody text here\n\n- 4 -"
    assert [(x.at, x.number) for x in R.furniture_lines(text)] == [(0, False), (1, False), (3, True)]
    assert R.rest_of("Ledger Office    17") == "Ledger Office" and R.rest_of("- 4 -") == "" and R.rest_of("plain text") == "plain text"
