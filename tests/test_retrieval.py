import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.functions import citations
from lodespark.functions.embedding import DIMENSION, hashed
from lodespark.functions import text as text_functions
from lodespark.functions.text import tokenize, tokens
from lodespark.operators import candidates, context, evaluate, hybrid, lexical, research, vectors

DOCS = [(k, " ".join(random.Random(k).choices("red green blue cyan lime teal gold grey".split(), k=k % 17 + 1)) + (" rare7" if k % 9 == 0 else "")) for k in range(60)] + [(100, None), (101, "")]


def slow_bm25(docs, terms):
    sets = {k: [w for w in (t or "").split()] for k, t in docs}
    mean = sum(map(len, sets.values())) / len(sets)
    out = {}
    for k, w in sets.items():
        c, score = Counter(w), 0.0
        for t in terms:
            df = sum(t in x for x in sets.values())
            if c[t]:
                score += math.log(1 + (len(sets) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if score:
            out[k] = score
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, score string")


def test_bm25_both_ways(spark, docs):
    asked = spark.createDataFrame([(1, ["red", "rare7"]), (2, ["teal"]), (3, ["absent"]), (4, [])], "query_id long, terms array<string>")
    scored = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(docs, "doc_id", "text", asked, "query_id", "terms").collect()}
    for q, terms in ((1, ["red", "rare7"]), (2, ["teal"])):
        want = slow_bm25(DOCS, terms)
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for (i, k), v in scored.items() if i == q}
        best = sorted(((-round(v, 9), k) for k, v in want.items()))[:5]
        got = [(r.doc_id, r.rank) for r in lexical.bm25_top(docs, "doc_id", "text", asked, "query_id", "terms", 5).where(F.col("query_id") == q).orderBy("rank").collect()]
        assert got == [(k, n) for n, (_, k) in enumerate(best, 1)]
    assert {q for q, _ in scored} == {1, 2}
    assert lexical.bm25_top(docs, "doc_id", "text", asked.limit(0), "query_id", "terms", 5).count() == 0
    assert lexical.bm25_top(docs.limit(0), "doc_id", "text", asked, "query_id", "terms", 5).count() == 0


def test_blocks_of_queries_do_not_matter(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(q, ["red", "blue", "rare7"][: q % 3 + 1]) for q in range(9)], "query_id long, terms array<string>")
    run = lambda: sorted(map(tuple, lexical.bm25_top(docs, "doc_id", "text", asked, "query_id", "terms", 4).collect()))
    want = run()
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    assert run() == want


def test_phrase(spark):
    df = spark.createDataFrame([("a red green fox", ["red", "green"]), ("green red", ["red", "green"]), ("redgreen", ["red", "green"])], "t string, w array<string>")
    assert [r.x for r in df.select(lexical.phrase(F.col("t"), F.col("w")).alias("x")).collect()] == [True, False, False]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    x[10] = x[20] = x[30]  # ties go by key
    df = spark.createDataFrame([(k, v.tolist(), k % 2, "c") for k, v in enumerate(x)] + [(900, None, 0, "c")], "vec_id long, embedding array<double>, label int, rank string").repartition(5)
    asked = spark.createDataFrame([(q, x[q].tolist()) for q in (10, 77)], "query_id long, vector array<double>")
    for where, keep in ((None, range(500)), ("label = 1", range(1, 500, 2))):
        got = {}
        for r in vectors.nearest(df, asked, 6, where=where).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for q in (10, 77):
            assert got[q] == [k for _, k in sorted((float(np.linalg.norm(x[k] - x[q])), k) for k in keep)[:6]]
    assert vectors.nearest(df, asked.limit(0), 3).count() == 0 and vectors.nearest(df.limit(0), asked, 3).count() == 0


def test_codes_find_nearly_all(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    q = vectors.fit_quantizer(df, 16, 16)
    index = vectors.encoded(df, q)
    assert index.count() == df.count()
    exact = vectors.nearest(df, asked, 10)
    assert vectors.recall(exact, vectors.probe(index, q, df, asked, 10, vectors.probes_of(16), 10), "vec_id") >= 0.99
    whole = vectors.probe(index, q, df, asked, 10, 16, df.count())  # all cells, all candidates: exact
    assert vectors.recall(exact, whole, "vec_id") == 1
    assert vectors.fit_quantizer(df.limit(0), 16, 16) is None and vectors.probe(index, None, df, asked, 10, 5, 2).count() == 0


def test_recall_does_not_fall_with_the_table(spark, tmp_path, monkeypatch):
    from lodespark.plans import catalog_search

    x = np.random.default_rng(4).normal(size=(20_000, 16)).astype(np.float32)  # 141 cells
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(vectors, "WIDTH", 16)  # 64 numbers in the tables, 16 here
    exact = catalog_search.knn_exact(spark, str(tmp_path))
    assert vectors.recall(exact, catalog_search.ann_search(spark, str(tmp_path)), "vec_id") >= 0.9


def test_probe_takes_blocks_of_queries(spark, tiny, monkeypatch):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    asked = df.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    q = vectors.fit_quantizer(df, 16, 16)
    run = lambda: sorted(map(tuple, vectors.probe(vectors.encoded(df, q), q, df, asked, 3, 5, 4).collect()))
    want = run()
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vectors, "HELD_DISTANCES", 7)
    assert run() == want and len(want) == 3 * asked.count()


def test_overlap_reaches_over_blocks_of_ids(spark, tmp_path):
    from lodespark.plans import catalog_search

    words = "red green blue cyan lime teal gold grey".split()
    rows = [(k, s, " ".join(random.Random(k).choices(words, k=4))) for s, ids in (("a", range(0, 5000, 300)), ("b", (7, 2500, 9100)), ("c", (1, 2, 3)), ("d", (4,)), (None, (5, 1005))) for k in ids]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for (_, s, x), (k, r, y) in zip(rows, rows[1:]):
        if s == r and s:
            a, b = set(x.split()), set(y.split())
            want[k] = pytest.approx(len(a & b) / len(a | b))
    got = catalog_search.jaccard_overlap(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: r.similarity for r in got} == want


def test_hash_embedding():
    v = hashed("alpha beta alpha")
    assert len(v) == DIMENSION and sum(x * x for x in v) == pytest.approx(1)
    assert hashed("") == [0.0] * DIMENSION
    assert hashed("Alpha, BETA alpha!") == v


def test_every_document_is_embedded(spark, tiny):
    from lodespark.plans import catalog_search

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.largest for r in catalog_search.hash_embedding(spark, tiny).collect()}
    assert set(got) == set(texts)
    for k in list(texts)[:20]:
        assert texts[k] is None or got[k] == pytest.approx(max(hashed(texts[k])), abs=1e-5)


def test_fusion(spark):
    v = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", float("inf")), (1, "d", None)], "query_id long, key string, distance double")
    l = spark.createDataFrame([(1, "b", 3.0), (1, "e", 2.0), (1, "a", 0.0)], "query_id long, key string, score double")  # noqa: E741
    got = [(r.key, round(r.score, 9), r.rank) for r in hybrid.fused(v, l).orderBy("rank").collect()]
    assert got == [("b", round(1 / 61 + 1 / 60, 9), 1), ("a", round(1 / 60, 9), 2), ("e", round(1 / 61, 9), 3)]


def test_evidence(spark):
    rows = [("REQ-12 rules", "see req-12 here", True), ("REQ-12 rules", "see req-13 rules", False), ("retention period", "the retentions", True), ("retention", "nothing", False)]
    df = spark.createDataFrame(rows, "q string, t string, want boolean")
    assert all(r.x == r.want for r in df.select("want", hybrid.has_evidence(F.col("q"), F.col("t")).alias("x")).collect())
    near = spark.createDataFrame([("retention", "nothing", 1.09), ("retention", "nothing", 1.16), ("retention", "nothing", None)], "q string, t string, d double")
    assert [r.x for r in near.select(hybrid.passes(F.col("q"), F.col("t"), F.col("d"), True).alias("x")).collect()] == [True, False, False]


def test_collapse_keeps_the_first_place(spark):
    rows = [(1, 1, "deep/er/path.txt", "Same  text"), (1, 2, "x.txt", "other"), (1, 3, "path.txt", "same text"), (1, 4, "long.txt", "SAME text")]
    df = spark.createDataFrame(rows, "query_id long, rank int, relative_path string, text string")
    assert sorted((r.rank, r.relative_path) for r in hybrid.collapsed(df).collect()) == [(1, "long.txt" if len("long.txt") < len("path.txt") else "path.txt"), (2, "x.txt")]


def test_spread_and_cap(spark):
    rows = [(1, 1, "a", 0, 10), (1, 2, "a", 5, 15), (1, 3, "a", 20, 30), (1, 4, "a", 40, 50), (1, 5, "b", None, None), (1, 6, "b", None, None), (1, 7, "b", None, None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, relative_path string, char_start long, char_end long").withColumn("key", F.col("rank"))
    got = [r.key for r in hybrid.spread(df, 5, 2).orderBy("rank").collect()]
    assert got == [1, 3, 5, 6, 4]
    assert [r.key for r in hybrid.capped(df, 4, 1).orderBy("rank").collect()] == [1, 5, 2, 3]
    assert hybrid.spread(df.limit(0), 5, 2).count() == 0


def test_context_and_citations(spark):
    rows = [("f.txt", k, "ctx", f"t{k}", k * 10, k * 10 + 9, k + 1, k + 1) for k in range(6)] + [("f.txt", 3, "ctx", "t3", 30, 39, 4, 4)]
    df = spark.createDataFrame(rows, "relative_path string, chunk_index int, context_path string, text string, char_start long, char_end long, line_start int, line_end int")
    for c, t in (("page_start", "int"), ("page_end", "int"), ("location_kind", "string"), ("location_start", "int"), ("location_end", "int"), ("location_label", "string"), ("cell_start", "string"), ("cell_end", "string")):
        df = df.withColumn(c, F.lit(None).cast(t))
    hits = spark.createDataFrame([(1, "f.txt", 0), (1, "f.txt", 3)], "query_id long, relative_path string, chunk_index int")
    got = {r.chunk_index: [c.chunk_index for c in r.context] for r in context.neighbours(hits, df, 1).collect()}
    assert got == {0: [0, 1], 3: [2, 3, 4]}
    assert [(r["first"], r["last"]) for r in context.ranges(hits, 1).collect()] == [(0, 4)]
    cited = spark.createDataFrame([("f.txt:L4-L4#3",), ("f.txt:L9-L9#3",), ("none.txt#0",)], "citation string")
    out = {r.citation: (r.found, r.context and len(r.context)) for r in context.expanded(cited, df, 1).collect()}
    assert out == {"f.txt:L4-L4#3": (True, 3), "f.txt:L9-L9#3": (False, None), "none.txt#0": (False, None)}


@pytest.mark.parametrize(
    "values,want",
    [
        (dict(page_start=3, page_end=4), "p/a b.txt:p3-p4#7"), (dict(page_start=3, page_end=3), "p/a b.txt:p3#7"), (dict(location_kind="slide", location_start=2, location_end=5), "p/a b.txt:slide2-slide5#7"),
        (dict(location_kind="epub", location_start=1), "p/a b.txt:spine1#7"), (dict(location_kind="sheet", location_label="My Sheet+ü", cell_start="A1", cell_end="B2"), "p/a b.txt:sheet=My%20Sheet%2B%C3%BC:cells=A1-B2#7"),
        (dict(location_kind="sheet", location_start=2, cell_start="bad"), "p/a b.txt:sheet=2#7"), (dict(line_start=1, line_end=9), "p/a b.txt:L1-L9#7"), (dict(line_start=0, line_end=9), "p/a b.txt#7"),
    ],
)
def test_citation(spark, values, want):
    names = "page_start page_end line_start line_end location_start location_end".split()
    df = spark.range(1).select(F.lit("p/a b.txt").alias("relative_path"), F.lit(7).alias("chunk_index"), *[F.lit(values.get(n)).cast("int").alias(n) for n in names], *[F.lit(values.get(n)).cast("string").alias(n) for n in ("location_kind", "location_label", "cell_start", "cell_end")])
    c = citations.of_chunks()
    r = df.select(c.alias("c"), citations.cited_path(c).alias("p"), citations.cited_index(c).alias("i")).first()
    assert (r.c, r.p, r.i) == (want, "p/a b.txt", 7)


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "z", 1), (4, "q", 1)], "query_id long, value string, rank int")
    judged = spark.createDataFrame([(1, "b", 3), (1, "c", 1), (2, "y", 1), (4, "n", 0)], "query_id long, value string, relevance int")
    asked = spark.createDataFrame([(1, True, "x", "en"), (2, True, "x", "fr"), (3, False, "y", "en"), (4, False, "y", "en")], "query_id long, answerable boolean, category string, locale string")
    case = {r.query_id: r for r in evaluate.cases(results, judged, asked).collect()}
    assert case[1].recall_at_1 == 0 and case[1].recall_at_3 == 0.5 and case[1].reciprocal_rank == 0.5
    assert case[1].ndcg_at_10 == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)))
    assert case[3].recall_at_5 == 1 and case[4].recall_at_5 == 0 and case[4].false_positive and not case[3].false_positive
    m = evaluate.metrics(evaluate.cases(results, judged, asked)).first()
    assert m.answerable_cases == 2 and m.recall_at_3 == 0.25 and m.false_positive_rate == 0.5
    g = {r.metric: r.passed for r in evaluate.gates(evaluate.metrics(evaluate.cases(results, judged, asked))).collect()}
    assert g["precision_at_5"] is True and g["recall_at_10"] is False and g["false_positive_rate"] is False
    only = evaluate.groups(evaluate.cases(results, judged, asked.where("answerable")), "locale").collect()
    assert all(r.false_positive_rate == 0 for r in only)


def test_judgments(spark):
    schema = "query_id long, expected_paths array<string>, expected_citations array<string>, relevance_judgments array<struct<kind:string,value:string,relevance:int>>"
    df = spark.createDataFrame([(1, ["p"], ["c"], []), (2, ["p"], [], [("path", "q", 2)]), (3, ["p"], [], [("citation", "c", 0)])], schema)
    assert sorted((r.query_id, r.kind, r.value, r.relevance) for r in evaluate.judgments_of(df).collect()) == [(1, "citation", "c", 1), (2, "path", "q", 2), (3, "citation", "c", 0), (3, "path", "p", 1)]


def test_research(spark):
    rows = [(1, "main", True, "a", 0, 1), (1, "main", True, "b", 0, 2), (1, "alt", False, "b", 0, 1)]
    df = spark.createDataFrame(rows, "research_id long, query string, is_primary boolean, relative_path string, chunk_index int, rank int")
    asked = spark.createDataFrame([(1, "main"), (1, "alt"), (1, "without results")], "research_id long, query string")
    got = [(r.relative_path, r.score) for r in research.fused_evidence(df, asked).orderBy("rank").collect()]
    assert got == [("b", round(6 / 62 + 1 / 61, 12)), ("a", round(6 / 61, 12))]
    files = spark.createDataFrame([("a", 5), ("b", 90), ("c", 10), ("d", 1), ("e", None)], "relative_path string, bytes long")
    assert [r[0] for r in research.within_budget(files, 3, 20).collect()] == ["a", "c", "d"]
    code = spark.createDataFrame([("x.py", "import os\ndef archiveLedgers(x):\n  pass # Archive ledger now a.b@c.example"), ("y.py", None), ("z.py", "")], "relative_path string, text string")
    asked = spark.createDataFrame([(1, "archive ledger"), (2, "unknown terms"), (3, "archivé  ledger"), (4, None)], "query_id long, query string")
    got = {r.query_id: (r.line, r.matched, r.score, r.snippet) for r in research.code_lines(code, asked).collect()}
    assert got == {1: (3, 2, 1200, "pass # Archive ledger now [REDACTED_EMAIL]"), 3: (2, 2, 200, "def archiveLedgers(x):")}
    assert research.code_lines(code, asked.limit(0)).count() == 0
    many = spark.createDataFrame([(f"f{k:02d}", "archive ledger") for k in range(30)], "relative_path string, text string")
    assert [r.relative_path for r in research.code_lines(many, asked.where("query_id = 1")).orderBy("rank").collect()] == [f"f{k:02d}" for k in range(20)]
    assert research.within_budget(files.limit(0)).count() == 0


def test_partitions_do_not_matter(spark, docs):
    asked = spark.createDataFrame([(1, ["red", "rare7"])], "query_id long, terms array<string>")
    runs = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, lexical.bm25_top(docs.repartition(n), "doc_id", "text", asked, "query_id", "terms", 10).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1] == runs[2]


def test_tokens(spark):
    assert tokenize("Don't É_x 7 中文 a-b 3.14 1,000; ref:x résumé") == ["don't", "e_x", "中", "文", "3.14", "1,000", "ref:x", "resume"] or tokenize("résumé") == ["resume"]
    for t in ("it's a.b.c x:y 3.14 1,000;5 a_.b _ a1.b2 1.a", "'annual' l'avion", ""):
        every = text_functions._compiled()[0].findall(text_functions.normalized(t))
        assert tokenize(t) == [x for x in every if len(x) >= 2 or x == "_"]  # ASCII texts and others are cut alike
    df = spark.createDataFrame([(None,), ("Ünï",)], "t string")
    assert [r.x for r in df.select(tokens(F.col("t")).alias("x")).collect()] == [[], ["uni"]]


def rows_of(spark, texts):
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(texts)], "key long, relative_path string, text string")
    return lexical.index(df, "key", "text").join(df, "key")


def test_stages_of_candidates(spark):
    rows = rows_of(spark, [("docs/a.md", "the warehouse inventory"), ("docs/b.md", "an inventory of warehouses"), ("x/a.md", "nothing"), ("x/c.md", "resumé of req-1234567 and more"), ("x/d.md", None), ("x/e.md", "")])
    asked = spark.createDataFrame([(1, "warehouze"), (2, "a.md"), (3, "docs/a.md"), (4, "warehouse"), (5, "résume"), (6, "???"), (7, "zz req-123456x")], "query_id long, query string")
    got = {}
    for r in candidates.staged(rows, asked, 50, 3).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.key, r.stage, r.path_match))
    assert got[1] == [(0, 2, None)]  # one edit away
    assert [g for g in got[2] if g[1] == 0] == [(0, 0, 1), (2, 0, 1)] and got[3][0] == (0, 0, 2) and (2, 0, 1) in got[3]
    assert got[4][:1] == [(0, 1, None)] and (1, 2, None) in got[4]
    assert got[5] == [(3, 1, None)] and 6 not in got
    assert got[7][0] == (3, 1, None) or got[7][0][0] == 3
    enough = candidates.staged(rows, asked.where("query_id = 4"), 50, 1)
    assert [(r.key, r.stage) for r in enough.collect()] == [(0, 1)]  # enough without supplements
    assert candidates.staged(rows.limit(0), asked, 50, 3).count() == 0 and candidates.staged(rows, asked.limit(0), 50, 3).count() == 0


def test_related_terms_against_all_pairs(spark):
    words = sorted({w for _, t in DOCS for w in (t or "").split()} | {"retention", "retentions", "detention", "ret", "reta", "rete", "greenest", "governance", "governances"})
    terms = ["retention", "ret", "green", "governances", "absent"]
    got = {(r.term, r.token) for r in lexical.related_tokens(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {(t, w) for t in terms for w in words if text_functions.Evidence(w).related(t)}
    assert got == want and ("retention", "retentions") in got and ("ret", "reta") not in got


def test_related_identifiers_against_all_pairs(spark):
    words = ["contract", "contracts", "contrast", "kontract", "contra", "contrac", "1234567", "1234568", "123456a", "x1", "x2", "contraction", "c" * 400, "c" * 401, "c" * 402, "договоры", "договора", "\U00010330" * 7, "\U00010330" * 8]
    names = sorted({f"{a}{sep}{b}" for a in words for b in words for sep in "-_"} | {f"x1-{a}_{b}-x2" for a in words for b in words[:5]} | {"a-b", "a_b", "b-a", "a-b-c", "a_b-c"})
    asked = [n for n in names if "_" in n][::3] + ["a-b", "absent-contract", "absent-word"]
    asked = sorted({*asked, "1234567_x1", f"{'c' * 400}_x1"})
    df = spark.createDataFrame([(n,) for n in [*names, *names[:9], None]], "identifier string")
    got = list(map(tuple, lexical.related_identifiers(df, spark.createDataFrame([(a,) for a in [*asked, *asked[:9], None]], "identifier string")).collect()))
    want = {(a, i) for a in asked for i in names if text_functions.same_identifier(a, i)}
    assert len(got) == len(set(got)) and set(got) == want
    assert ("a-b", "a_b") in want and ("1234567_x1", "123456a-x1") in want and ("1234567_x1", "1234568-x1") not in want and (f"{'c' * 400}_x1", f"{'c' * 401}-x1") in want
    assert lexical.related_identifiers(df.limit(0), df).count() == 0 and lexical.related_identifiers(df, df.limit(0)).count() == 0


def test_identifiers_that_share_long_parts_are_not_compared_with_all(spark):
    names = [f"{shared}-{hashlib.md5(str(k).encode()).hexdigest()}-{shared}" for k in range(3_000) for shared in ("authorization", "certificate")]
    df = spark.createDataFrame([(n,) for n in names], "identifier string")
    pairs = lexical.identifier_candidates(df, df.withColumnRenamed("identifier", "asked")).collect()
    assert {tuple(r) for r in pairs} >= {(n, n) for n in names} and len(pairs) < 4 * len(names)


@pytest.mark.parametrize("word", ["", "a", "aaaa", "contract", "договор", "\U00010330\U0010ffffx"])
def test_words_without_one_character(word):
    keys = lexical.left_out_keys(word)
    shorter = {word[:k] + word[k + 1 :] for k in range(len(word))}
    assert len(keys) == len(shorter | {word}) and all(lexical.left_out_keys(w) & keys for w in shorter) and all(0 <= k < 2**63 for k in keys)


def test_phrases(spark):
    df = spark.createDataFrame([(1, "a red green fox"), (2, "green red"), (3, "Rêd, green red green"), (4, None)], "k long, t string")
    asked = spark.createDataFrame([(1, ["red", "green"]), (2, []), (3, ["fox"])], "q long, w array<string>")
    assert sorted(map(tuple, lexical.phrases(df, "k", "t", asked, "q", "w").collect())) == [(1, 1), (1, 3), (3, 1)]
    assert lexical.phrases(df, "k", "t", asked.limit(0), "q", "w").count() == 0


def test_the_best_are_kept_while_rows_pass(spark, monkeypatch):
    df = spark.createDataFrame([(k, "red " * (k % 7 + 1) + "blue") for k in range(300)], "k long, t string").coalesce(1)
    asked = spark.createDataFrame([(q, ["red", "blue"]) for q in range(3)], "q long, w array<string>")
    want = sorted(map(tuple, lexical.bm25_top(df, "k", "t", asked, "q", "w", 9).collect()))
    monkeypatch.setattr(lexical, "MATRIX", 30)
    monkeypatch.setattr(lexical, "HELD", 5)
    assert sorted(map(tuple, lexical.bm25_top(df, "k", "t", asked, "q", "w", 9).collect())) == want
    monkeypatch.setattr(lexical, "SENT_TOKENS", 1)  # too many tokens to send: the same
    assert sorted(map(tuple, lexical.bm25_top(df, "k", "t", asked, "q", "w", 9).collect())) == want


def test_gates_fail_without_a_value(spark):
    row = spark.createDataFrame([(0.9,)], "recall_at_1 double")
    got = {r.metric: (r.applicable, r.passed) for r in evaluate.gates(row).collect()}
    assert len(got) == 9 and got["recall_at_1"] == (True, True) and got["exact_citation_rate"] == (False, False)
    cases = spark.createDataFrame([(k, k % 2 == 0, True if k % 4 == 0 else None) for k in range(100)], "q long, answerable boolean, citation_hit boolean")
    every = {**evaluate.GATES, **evaluate.MAXIMUM_GATES}
    assert evaluate.verified(cases, every, 0, 5).first().verified
    assert evaluate.verified(cases.limit(40), {"recall_at_1": 1}, 2, 0).first().gaps == ["too few cases", "no graded cases", "thresholds are missing", "files are stale"]
