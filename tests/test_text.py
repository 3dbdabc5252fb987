import pytest
from pyspark.sql import functions as F

from lodespark.functions import queries, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "source,want",
    [
        ("Don't stop at example.com, foo_bar or 3.14!", ["don't", "stop", "at", "example.com", "foo_bar", "or", "3.14"]), ("a-b Café", ["cafe"]), ("", []), ("x y zz", ["zz"]),
    ],
)
def test_unicode_tokens(source, want):
    assert text.tokenize(source) == want


def test_single_foreign_characters_are_tokens():
    assert text.tokenize("中 文") == ["中", "文"]


def test_plain_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Quick_fox, a 7 中 x-y.") == ["the", "quick_fox", "中"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []


def test_normalisation(spark):
    assert one(spark, text.normalize_for_match(F.col("t")), t="ÀÉÎ ﬁ Ⅳ") == "aei fi iv"
    assert one(spark, text.normalize_for_match(F.col("t")), t=None) is None


def test_snippet_and_cleaning(spark):
    assert one(spark, text.snippet(F.col("t"), 10), t="a  b\n c  defghijkl") == "a b c d..."
    assert one(spark, text.snippet(F.col("t"), 10), t="short") == "short"
    assert one(spark, text.cleaned(F.col("t")), t="a \r\nb\n\n\n\n\nc " + "A" * 300 + "\n") == "a\nb\n\n\nc"
    assert one(spark, text.dehyphenated(F.col("t")), t="docu-\nment Auto-\nBahn") == "document Auto-\nBahn"


@pytest.mark.parametrize(
    "a,b,want",
    [("abc", "abc", True), ("abc", "abd", False), ("tokens", "tokenize", True), ("identifier", "xdentifier", True), ("wholly", "holly", False), ("abcdefgh", "hgfedcba", False)],
)
def test_related_tokens(spark, a, b, want):
    assert one(spark, text.tokens_related(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("a,b,want", [("req-100", "req-100", True), ("req-100", "req-101", False), ("contract-12", "contracts-12", True), ("a-b", "a-b-c", False), ("contract_x", "contrast-x", True)])
def test_related_identifiers(spark, a, b, want):
    assert one(spark, text.identifiers_related(F.col("a"), F.col("b")), a=a, b=b) is want


def test_anchors(spark):
    assert one(spark, text.anchors(F.col("t")), t="See REQ-12, foo_bar, well-known, x9y8 and 2024 or 12") == ["req-12", "foo_bar", "x9y8", "2024"]


@pytest.mark.parametrize(
    "source,query,method",
    [
        ("  short   one ", "short one", "passthrough"),
        ("x" * 260 + ". Is this the last question? " + "tail " * 5, "Is this the last question?", "question"),
        ("filler words " * 30 + "\nQuestion: where is the archive kept\n" + "more filler " * 5, "where is the archive kept", "labeled-tail"),
        ("filler words here. " * 20 + "The last sentence counts.", "The last sentence counts", "tail-sentence"),
        ("y" * 600, "y" * 200, "tail"),
    ],
)
def test_sanitizer(spark, source, query, method):
    got = one(spark, queries.sanitized(F.col("t")), t=source)
    assert (got.query, got.method) == (query, method)


def test_research_queries(spark):
    got = one(spark, queries.research_queries(F.col("t")), t="what about the retention rules")
    assert got[:3] == ["what about the retention rules", "retention rules", "what about the retention rules scope requirements rules"] and len(got) == 5
    assert one(spark, queries.research_queries(F.col("t")), t="les règles")[2] == "les règles périmètre exigences règles"


def test_routing(spark):
    r = one(spark, queries.routed(F.col("t")), t="audit the knowledge base")
    assert r.use and r.tool == "research"
    r = one(spark, queries.routed(F.col("t")), t="translate this sentence")
    assert not r.use and r.tool == "none" and r.confidence == 0.0
    r = one(spark, queries.routed(F.col("t")), t=None)
    assert not r.use and r.signals == []


def test_research_expansions_take_the_whole_text(spark, tmp_path):
    import hashlib

    from lodespark.functions.queries import SUFFIXES
    from lodespark.functions.text import meaningful_terms
    from lodespark.plans import catalog_text

    texts = {1: "annual ledger " * 12 + "สัญญา", 2: "annual ledger " * 12 + "archive", 3: "  annual ledger " * 12 + "pour  ", 4: "short text"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    terms = {r.doc_id: " ".join(r.t) for r in df.select("doc_id", meaningful_terms(F.trim("text")).alias("t")).collect()}
    got = {r.doc_id: (r.n, r.digest) for r in catalog_text.research_expansions(spark, str(tmp_path)).collect()}
    for k, kind in ((1, "thai"), (2, "other"), (3, "french"), (4, "other")):
        one = texts[k].strip()
        every = list(dict.fromkeys([one, terms[k], *(f"{one} {x}" for x in SUFFIXES[kind])]))[:5]
        assert got[k] == (len(every), hashlib.md5("|".join(every).encode()).hexdigest())
