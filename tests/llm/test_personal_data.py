import random

import pytest

from lodespark.llm import personal_data as P

LEXICON = [(t, "given") for t in "Anna Bill Rose Irina Mark".split()] + [
    (h + t, "family") for h in ("Bel", "Dun", "Kes", "Nor", "Vel") for t in ("dahl", "quist", "mere", "stead")
] + [("Page", "family"), (None, "given")]


@pytest.fixture(scope="module")
def book():
    return P.NameBook(LEXICON)


def card(rng):
    n = [rng.randrange(10) for _ in range(15)]
    n[0] = 9
    for last in range(10):
        if P.luhn("".join(map(str, [*n, last]))):
            return "".join(map(str, [*n, last]))


def iban(rng):
    body = "".join(str(rng.randrange(10)) for _ in range(16))
    for k in range(2, 99):
        if P.mod97(f"ZX{k:02d}{body}"):
            return f"ZX{k:02d}{body}"


RNG = random.Random(4)
CARD, IBAN = card(RNG), iban(RNG)
BAD = CARD[:-1] + str((int(CARD[-1]) + 1) % 10)
CASES = [
    ("Write to a.b+c@mail.example now.", "email", "a.b+c@mail.example"),
    ("Write to a.b (at) mail [dot] example now.", "email", "a.b (at) mail [dot] example"),
    ("x.y @ mail.example", "email", "x.y @ mail.example"),
    ("mail a＠mail.example", "email", "a＠mail.example"),
    ("UPPER-E@MAIL.EXAMPLE.", "email", "UPPER-E@MAIL.EXAMPLE"),
    ("Call +44 20 7946 0123.", "phone", "+44 20 7946 0123"),
    ("Call (555) 555-0123 ext. 12, please", "phone", "(555) 555-0123 ext. 12"),
    ("fax/07700 900123", "phone", "07700 900123"),
    ("Tel. 01.99.00.12.34", "phone", "01.99.00.12.34"),
    ("ring oh seven seven zero zero nine zero zero one two three today", "phone", "oh seven seven zero zero nine zero zero one two three"),
    ("SSN 987-65-4321", "id_number", "987-65-4321"),
    ("NI number QQ 12 34 56 C", "id_number", "QQ 12 34 56 C"),
    (f"card {CARD}", "id_number", CARD),
    (f"IBAN {IBAN}", "id_number", IBAN),
    ("passport no. XK1234567", "id_number", "XK1234567"),
    (f"DNI 12345678-{P.identity_letter('12345678')}", "id_number", f"12345678-{P.identity_letter('12345678')}"),
    ("lives at 12b Upper Belmere Road since", "address", "12b Upper Belmere Road"),
    ("at Belmerestraße 12, 12345 Ort", "address", "Belmerestraße 12"),
    ("near 5, rue des Merisiers.", "address", "5, rue des Merisiers"),
    ("to Calle Belmere 12, 3º B", "address", "Calle Belmere 12"),
    ("Ms Anna Belmere will", "name", "Anna Belmere"),
    ("asked Belmere, Anna about", "name", "Belmere, Anna"),
    ("Dr. B. Dunquist said", "name", "B. Dunquist"),
    ("seen by IRINA J. NORDAHL again", "name", "IRINA J. NORDAHL"),
    ("with Keiko Velstead-Kesmere …", "name", "Keiko Velstead-Kesmere"),
]


@pytest.mark.parametrize("text,kind,value", CASES)
def test_finds(book, text, kind, value):
    assert [(text[s:e], k) for s, e, k in P.detect(text, book)] == [(value, kind)]


@pytest.mark.parametrize(
    "text",
    [
        "Pushed to git@forge.example:ops/x.git again.", "https://user:pw@host.example/x", "@channel please read", f"card {BAD} was refused", "P.O. Box 12345", "Build 86.8.61.373", "log at 10.31.3.38", "On 2024-03-01, GRP-12/345",
        "Reference 621322-81712 is a meter", "[REDACTED_EMAIL] asked", "Bill of materials 34-519-18", "Mark Page 3 of the annex", "", "  ",
    ],
)
def test_finds_nothing(book, text):
    assert P.detect(text, book) == []


def test_everything_else_stays(book):
    text = "Ring +44 20 7946 0123 or a (at) b.example; ask Anna Belmere.\n\tÀ bientôt ☃"
    assert P.redact(text, book) == ("Ring [PHONE] or [EMAIL]; ask [NAME].\n\tÀ bientôt ☃", 3)


def test_spans_lie_within_the_source(book):
    rng = random.Random(1)
    parts = [c[0] for c in CASES] + ["​", "＠", " dot ", " (at) ", "&#64;", "ѕ", "☃", "\n"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=6))
        last = 0
        for s, e, _ in P.detect(text, book):
            assert last <= s < e <= len(text)
            last = e


def test_tables(spark):
    schema = "row_id long, text string, kind string, char_pos string, id string"
    rows = [(1, "Mail a@b.example", "k", "c", "i"), (2, None, "k", "c", "i"), (3, "", "k", "c", "i"), (4, "x " * 50_000 + "a@b.example", "k", "c", "i"), (1, "Mail a@b.example", "k", "c", "i"), (None, "a@b.example", None, None, None)]
    df, lexicon = spark.createDataFrame(rows, schema), spark.createDataFrame(LEXICON, "token string, name_part string")
    got = [tuple(r) for r in P.find(df, lexicon).collect()]
    assert sorted(got, key=str) == sorted([(1, "email", 5), (1, "email", 5), (4, "email", 100_000), (None, "email", 0)], key=str)
    out = [(r.row_id, r.redactions) for r in P.redacted(df, lexicon).collect()]
    assert sorted(out, key=str) == sorted([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (None, 1)], key=str)
    assert P.find(df.limit(0), lexicon.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.name_rows(lexicon, bound=2)


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("call me on five five five nine nine nine five nine five five", "phone", "five five five nine nine nine five nine five five"),
        ("ruf an: null zwei null sieben acht neun drei vier fünf sechs", "phone", "null zwei null sieben acht neun drei vier fünf sechs"),
        ("电话一三八零零一三八零零零", "phone", "一三八零零一三八零零零"),
        ("mail \U0001d423\U0001d41a\U0001d427\U0001d41e@mail.example now", "email", "\U0001d423\U0001d41a\U0001d427\U0001d41e@mail.example"),
        ("call +٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨", "phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨"),
        ("jane (arroba) mail (punto) example", "email", "jane (arroba) mail (punto) example"),
        ("Irina Q. Zoltankovics wrote", "name", "Irina Q. Zoltankovics"),
        ("Name: Ada Zoltankovics", "name", "Ada Zoltankovics"),
    ],
)
def test_wider_disguises_and_names(book, text, kind, value):
    assert [(k, text[s:e]) for s, e, k in P.detect(text, book)] == [(kind, value)]


@pytest.mark.parametrize("text", ["one two three four five", "Mark Report and Rose Street", "Dear Sir or Madam", "the one who is two or three, four or five, six", "一二三"])
def test_what_is_no_value(book, text):
    assert P.detect(text, book) == []
