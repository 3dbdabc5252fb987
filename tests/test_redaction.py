import pytest
from pyspark.sql import functions as F

from lodespark.config import Config, RedactionRule, check_pattern
from lodespark.errors import ConfigError
from lodespark.functions import redaction as R

A = "aB3dE6gH9jkL2mN4pQ5r"
SAMPLES = [
    ("private_key", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"), ("jwt", "eyJabc.eyJdef.ghi"), ("stripe_secret_key", f"sk_live_{A}"), ("gitlab_token", f"glpat-{A}"), ("bearer_token", "Bearer " + "a" * 32),
    ("api_token", f"ghp_{A}"), ("openai_api_key", f"sk-{A}"), ("aws_access_key_id", "AKIA" + "A1" * 8), ("google_api_key", "AIza" + "a" * 35), ("slack_token", "xoxb-1234567890"), ("sendgrid_api_key", "SG." + "a" * 22 + "." + "b" * 43),
    ("url_credentials", "https://user:pass@"), ("email", "a.b@c.example"), ("iban", "DE89370400440532013000"), ("credit_card", "4111 1111 1111 1111"),
]


@pytest.mark.parametrize("name,secret", SAMPLES)
def test_every_kind(spark, name, secret):
    df = spark.createDataFrame([(f"before {secret} after",)], "t string")
    assert df.select(R.redact(F.col("t")).alias("x")).first().x == f"before {R.placeholder(name)} after"


def test_what_stays(spark):
    rows = [("card 4111 1111 1111 1112",), ("plain text",), ("",), (None,), ("x" * 100_000,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.x for r in df.select(R.redact(F.col("t")).alias("x")).collect()] == [r[0] for r in rows]


def test_accents_are_no_word_characters(spark):
    df = spark.createDataFrame([("éa@b.example",)], "t string")
    assert df.select(R.redact(F.col("t")).alias("x")).first().x == "é[REDACTED_EMAIL]"


def test_custom_rules(spark):
    rules = [RedactionRule("ref", r"\bREF-\d{3}\b"), RedactionRule("n", r"\b\d{14}\b", verify="luhn", replacement="#$1"), RedactionRule("fold", "secret", flags="i", replacement="S")]
    df = spark.createDataFrame([("REF-123 SECRET 79927398713000 79927398713001",)], "t string")
    got = df.select(R.redact(F.col("t"), rules).alias("x")).first().x
    assert got.startswith("[REDACTED_REF] S ")
    assert ("#$1" in got) == any(R._luhn(x) for x in ("79927398713000", "79927398713001"))


def test_lines_hold_unless_a_match_spans_them(spark):
    df = spark.createDataFrame([("a@b.example\nx",), (SAMPLES[0][1],), (None,)], "t string")
    got = [r.x for r in df.select(R.redact_with_lines(F.col("t")).alias("x")).collect()]
    assert [(g.text, g.line_map_kept) for g in got] == [("[REDACTED_EMAIL]\nx", True), ("[REDACTED_PRIVATE_KEY]", False), (None, True)]


@pytest.mark.parametrize("pattern", ["", "x" * 600, "(a+)+", "(a|b*)*", "("])
def test_unsafe_patterns(pattern):
    with pytest.raises(ConfigError):
        check_pattern(pattern)


def test_config():
    assert Config.load({"retrieval_profile": "fast"}).top_k == 5
    strict = Config.load({"privacy_profile": "strict", "top_k": 50, "extractors": {".doc": ("x",)}})
    assert (strict.top_k, strict.max_output_bytes, strict.extractors) == (5, 16_384, {})
    assert Config().policy_fingerprint() != Config(chunk_size=500).policy_fingerprint() == Config(chunk_size=500, top_k=3).policy_fingerprint()
    for bad in ({"nope": 1}, {"top_k": 0}, {"chunk_overlap": 1200}, {"retrieval_profile": "x"}):
        with pytest.raises(ConfigError):
            Config.load(bad)


def test_cards_are_replaced_at_their_place_only(spark):
    texts = ["4111111111111111 and 94111111111111111x", "94111111111111111x then 4111111111111111", "\ufdd0 4111111111111111 \ufdd0", "4111111111111112", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(R.redact(F.col("t")).alias("x")).collect()]
    assert got == ["[REDACTED_CREDIT_CARD] and 94111111111111111x", "94111111111111111x then [REDACTED_CREDIT_CARD]", "\ufdd0 [REDACTED_CREDIT_CARD] \ufdd0", "4111111111111112", None, ""]
    both = [r.x.text for r in df.select(R.redact_with_lines(F.col("t")).alias("x")).collect()]
    assert both == got
