import random

import numpy as np
import pytest

from lodespark.llm import languages as L


@pytest.fixture(scope="module")
def samples(spark, tiny):
    df = spark.read.parquet(f"{tiny}/lang_samples.parquet")
    return df, L.sample_rows(df)


@pytest.fixture(scope="module")
def models(samples):
    return L.train(samples[1])


def test_probabilities_sum_to_one(models):
    """Over the characters a model knows and the space that ends a word; what is missing is the share of unseen ones."""
    chars = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïíìñóòôöõùûüúß'"
    for j, start in ((models.languages.index("en"), "th"), (models.languages.index("en"), "q"), (models.languages.index("de"), "sch")):
        place = len(start) + 1  # behind the space in front and the start
        total = sum(np.exp(models.characters([start + c])[place, j]) for c in chars) + np.exp(models.characters([start])[place, j])
        assert 0.9 < total <= 1.001


def test_held_out_accuracy(samples):
    rng = random.Random(1)
    rows = list(samples[1])
    rng.shuffle(rows)
    held, rest = rows[:60], rows[60:]
    own = L.train(rest)
    good = sum(L.languages_of(found) == [code] for (code, _), found in zip(held, L.segments([t for _, t in held], own)))
    assert good >= 58


def test_mixed_documents_and_quotations(samples, models):
    by = {}
    for c, t in samples[1]:
        by.setdefault(c, []).append(t)
    long = lambda c: " ".join(by[c][:4])
    a, b = long("en"), long("fr")
    found = L.segments([a + "\n\n" + b, a + " (" + by["de"][0][:60] + ".) " + a, long("zh") * 2 + "\n\n" + a], models)
    assert L.languages_of(found[0]) == ["en", "fr"] and [x[2] for x in found[0]] == ["en", "fr"]
    assert found[0][1][0] == len(a) + 2 and all(0.9 < x[3] <= 1 for x in found[0])
    assert L.languages_of(found[1]) == ["en"]
    assert L.languages_of(found[2]) == ["en", "zh"]


def test_what_is_no_prose(models):
    texts = ["", "EV-123-AB", "R1.2;3;4\nOPS-1;2;3", "```\nbuild_it(3)\nprint_all()\n```", "0x12ab", "12/34/56", None]
    assert all(not f for f in L.segments(texts, models))
    assert L.segments(["zzxq kkjw vvbq wqxz jjkq zzqx wwvq"], models)[0] == []  # rejected


def test_prose_with_a_few_signs_is_prose(models):
    for sign in ("; ", " | ", " = ", " < ", "\t", " check_count "):
        text = f"Every quarterly release protected that checklist{sign}the report followed the export with few exceptions."
        assert [(s, e) for s, e, _ in L.units(text)] == [(0, len(text))]
    long = "The first team wrote the quarterly report on the archive; the second team checked every page of it; the third team signed the release."
    assert L.languages_of(L.segments([long + " " + long], models)[0]) == ["en"]
    for code in ("const total = first + second + third;", "emit_first_record | trim_all | sort_by_count", "error = parse fetch count;"):
        assert L.units(code) == []


def test_capitals_and_missing_accents(models, samples):
    for c, t in samples[1][::9]:
        for v in (t.upper(), L.without_accents(t)):
            assert L.languages_of(L.segments([v], models)[0]) == [c]


def test_labels(spark):
    rows = [("en", "en"), ("EN", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("deu", "de"), ("French", "fr"), ("Chinese", "zh"), (" nl ", "nl"), ("und", None), ("", None), ("  ", None), ("n/a", None), (None, None), ("sv", "sv"), ("mul", None)]
    df = spark.createDataFrame(rows, "lang string, want string")
    assert [(r.lang, r.got) for r in df.select("lang", "want", L.label_code(df.lang).alias("got")).collect()] == [(a, b) for a, b in rows]


def test_tables(spark, samples):
    text = {c: " ".join(t for k, t in samples[1] if k == c) for c in ("en", "fr")}
    schema = "doc_id long, text string, lang string, lang_code string, chars string"
    rows = [(1, text["en"], "en", "", ""), (2, text["en"], "fr", "", ""), (3, text["fr"], None, "", ""), (4, text["en"] + "\n\n" + text["fr"], "en", "", ""), (5, None, None, "", ""), (6, "", "en", "", ""), (7, "EV-12-AB", None, "", ""),
            (8, text["fr"] * 200, "Deutsch", "", ""), (9, text["fr"][:60], "FR-ca", "", "")]
    df = spark.createDataFrame(rows, schema)
    found = L.segmented(df, samples[0])
    got = sorted(tuple(r) for r in L.mislabelled(df, found).collect())
    assert got == [(2, "en"), (3, "fr"), (4, "en"), (4, "fr"), (8, "fr")]
    one = {r.doc_id: r for r in L.document_languages(found).where("not mixed").collect()}
    assert one[1].lang_code == "en" and one[1].confidence > 0.99
    assert L.mislabelled(df.limit(0), L.segmented(df.limit(0), samples[0])).count() == 0


def test_no_samples(spark, samples):
    df = spark.createDataFrame([(1, "Some words in a row here.", "en")], "doc_id long, text string, lang string")
    assert L.segmented(df, samples[0].limit(0)).count() == 0
