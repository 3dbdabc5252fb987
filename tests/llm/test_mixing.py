import math
import random

from pyspark.sql import functions as F

from lodespark.llm import mixing as M
from lodespark.llm import tokens

SCHEMA = "doc_id long, text string, source string, key string, range string, tokens string"


def docs(spark):
    rng = random.Random(2)
    rows = []
    for source, n in (("hot", 600), ("mid", 120), ("small", 10), ("other", 40)):
        rows += [(len(rows) + k, " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(5, 120))), source, "", "", "") for k in range(n)]
    rows += [(9000, None, "hot", "", "", ""), (9001, "", "mid", "", "", ""), (9002, "no source", None, "", "", ""), (9003, "x " * 50_000, "other", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, note string")


def test_against_a_plain_selection(spark):
    df = docs(spark)
    goal = [("hot", 0.5, 1, ""), ("mid", 0.3, 3, ""), ("small", 0.15, 4, ""), ("absent", 0.05, 2, ""), (None, 0.1, 1, "")]
    total = 20_000
    chosen, report = M.mixed(df, targets(spark, goal), total_tokens=total, ranges=16)
    got = {r.doc_id: r.repeats for r in chosen.collect()}
    keys = {r.doc_id: r.k for r in df.where(F.length("text") > 0).select("doc_id", M.exponential_key(F.col("doc_id"), M.quality(F.col("text"))).alias("k")).collect()}
    size = {r.doc_id: len(tokens.encoding().encode_ordinary(r.text)) for r in df.collect() if r.text}
    want = {}
    for source, share, most, _ in goal[:3]:
        own = sorted((r.doc_id for r in df.collect() if r.source == source and r.text), key=lambda i: (keys[i], i))
        available, budget = sum(size[i] for i in own), share * total
        epochs = min(int(budget // available), most)
        rest, at = (budget - epochs * available if epochs < most else 0), 0
        for i in own:
            at += size[i]
            n = epochs + (rest > 0 and at - size[i] / 2 <= rest)
            if n:
                want[i] = n
    assert got == want
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"hot", "mid", "small", "absent"}
    assert by["absent"].chosen_tokens == 0 and by["absent"].shortfall_tokens == 0.05 * total
    for s, share, most, _ in goal[:3]:
        used = sum(size[i] * n for i, n in got.items() if df.where(F.col("doc_id") == i).first().source == s) if s == "small" else by[s].chosen_tokens
        assert by[s].chosen_tokens == used and by[s].most_repeats <= most
        assert used >= min(share * total, by[s].available_tokens * most) - max(size.values())
    assert math.isclose(sum(r.actual_share for r in by.values()), 1.0)


def test_the_number_of_ranges_does_not_matter(spark):
    df, goal = docs(spark), targets(spark, [("hot", 0.4, 1, ""), ("mid", 0.6, 2, "")])
    a, b = (sorted(map(tuple, M.mixed(df, goal, ranges=n)[0].collect())) for n in (3, 200))
    assert a == b


def test_heavier_documents_come_first(spark):
    rows = [(k, ("good words here " if k % 2 else "12 34 56 78 90 !! ") * 40, "s", "", "", "") for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    chosen, _ = M.mixed(df, targets(spark, [("s", 0.3, 1, "")]))
    ids = [r.doc_id for r in chosen.collect()]
    assert sum(i % 2 for i in ids) > 0.6 * len(ids)


def test_empty_tables(spark):
    goal = targets(spark, [("hot", 1.0, 1, ""), ("hot", None, None, "")])
    chosen, report = M.mixed(docs(spark).limit(0), goal)
    assert chosen.count() == 0 and report.first().actual_share == 0.0
    chosen, report = M.mixed(docs(spark), goal.limit(0))
    assert chosen.count() == 0 and report.count() == 0
