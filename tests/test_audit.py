import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodespark.operators import audit, maintenance, usage
from lodespark.operators.predicates import context_prefix, is_path_query, normalized_prefixes, search_predicate
from lodespark.sources import inventory

FILES = "relative_path string, checksum string, chunk_count int"


@pytest.fixture(scope="module")
def corpora(spark):
    old = spark.createDataFrame([("a", "1", 2), ("b", "2", 1), ("c", "3", 1)], FILES)
    new = spark.createDataFrame([("a", "1", 2), ("b", "9", 1), ("d", "4", 0), ("e", "5", 1)], FILES)
    return old, new


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_differences(spark, corpora):
    old, new = corpora
    assert rows(audit.missing(new, old)) == [("d",), ("e",)]
    assert rows(audit.missing(new, old, new.where("chunk_count = 0"))) == [("e",)]
    assert rows(audit.stale(old, new)) == [("b", "changed"), ("c", "removed")]
    assert rows(audit.reusable(new, old).select("relative_path")) == [("a",)]
    assert rows(audit.removed(old, new)) == [("c",)]
    assert rows(audit.snapshot_diff(old, new)) == [("b", "changed"), ("c", "local_only"), ("d", "peer_only"), ("e", "peer_only")]
    assert audit.can_resume(old, new).first().resumable is False and audit.can_resume(old, old).first().resumable is True
    assert audit.can_resume(old.limit(0), new.limit(0)).first().resumable is False
    for f in (audit.missing, audit.stale, audit.reusable, audit.removed, audit.snapshot_diff):
        assert f(old.limit(0), new.limit(0)).count() == 0


def test_settings(spark):
    a = spark.createDataFrame([("x", 1, None)], "name_ string, size int, opt string")
    b = spark.createDataFrame([("x", 2, "on")], "name_ string, size int, opt string")
    got = {r["name"]: (r["local"], r["peer"], r.requires_rebuild) for r in audit.setting_diff(a, b, ("size",)).collect()}
    assert got == {"size": ("1", "2", True), "opt": (None, "on", False)}


def test_statistics(spark):
    df = spark.createDataFrame([("x" * 10, "c"), ("x" * 20, "c"), ("x" * 40, ""), (None, "c")], "text string, context_path string")
    r = audit.chunk_stats(df).first()
    assert (r["count"], r.min_chars, r.p50_chars, r.p95_chars, r.max_chars, r.contextual) == (3, 10, 20, 40, 40, 2)
    assert r.avg_chars == pytest.approx(70 / 3) and r.contextual_ratio == pytest.approx(2 / 3)
    assert audit.chunk_stats(df.limit(0)).first()["count"] == 0


def test_fingerprint_knows_files_and_not_their_order(spark, corpora):
    old, _ = corpora
    f = lambda df: audit.corpus_fingerprint(df).first().fingerprint
    assert f(old) == f(old.orderBy(F.desc("relative_path")).repartition(3))
    assert f(old) != f(old.withColumn("checksum", F.lit("1"))) != f(old.where("relative_path <> 'a'"))


def test_merge(spark):
    schema = "row_id long, id string, relative_path string, ingested_at timestamp"
    t = lambda n: dt.datetime(2024, 1, n)
    old = spark.createDataFrame([(1, "i1", "a", t(1)), (2, "i2", "a", t(1)), (3, "i3", "b", t(1))], schema)
    new = spark.createDataFrame([(4, "i2", "a", t(2)), (5, "i2", "a", t(3)), (6, "i9", "c", t(2))], schema)
    replaced = spark.createDataFrame([("a",)], "relative_path string")
    assert rows(audit.merge_chunks(old, new, replaced).select("row_id", "id")) == [(3, "i3"), (5, "i2"), (6, "i9")]
    assert rows(audit.merge_chunks(old, new.limit(0), replaced).select("id")) == [("i3",)]
    assert rows(audit.delete_paths(old, replaced).select("id")) == [("i3",)]


def test_inventory(spark):
    names = ["a/.env", "a/.env.local", "a/id_rsa", "a/x.PEM", "a/b.md", "a/c.MP3", "a/d.doc", "a/e.xls", "a/f.png", "a/big.txt", "a/noext", "a/x.zig"]
    df = spark.createDataFrame([(n, 999 if "big" in n else 5) for n in names], "relative_path string, bytes long").withColumn("extension", inventory.extension_of(F.col("relative_path")))
    got = {r.relative_path: r.reason for r in inventory.classified(df, 100, [".zig"]).collect()}
    assert [n for n in names if got[n] == "sensitive-name"] == names[:4]
    assert got["a/b.md"] is None and got["a/x.zig"] is None and got["a/big.txt"] == "oversized"
    assert all(got[n] == "unsupported-extension" for n in ("a/c.MP3", "a/d.doc", "a/e.xls", "a/f.png", "a/noext"))
    advice = [r.recommendation for r in inventory.classified(df, 100).where("reason = 'unsupported-extension'").collect()]
    assert len(set(advice)) >= 5


def test_input_spec(spark):
    include, exclude = inventory.input_spec(["# all docs", "./docs/", "", "*.md", "!docs/private", "!**/*.tmp"])
    assert (include, exclude) == (["docs/**", "*.md"], ["docs/private/**", "**/*.tmp"])
    df = spark.createDataFrame([("docs/a.txt",), ("docs/private/b.txt",), ("x.md",), ("sub/x.md",), ("docs/c.tmp",), ("docsx/a",)], "p string")
    assert [r.p for r in df.where(inventory.matches(F.col("p"), include) & ~inventory.matches(F.col("p"), exclude)).collect()] == ["docs/a.txt", "x.md"]


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_text("x")
    got = {r.relative_path: (r.bytes, r.extension, r.checksum[:8]) for r in inventory.scanned(spark, str(tmp_path), exclude=["b.md"]).collect()}
    assert got == {"d/a.txt": (5, ".txt", "2cf24dba")}


def test_predicates(spark):
    assert normalized_prefixes([" ./a/b/ ", "a\\b", "", "c"]) == ["a/b", "c"]
    asked = spark.createDataFrame([("docs/a b.md",), ("what is this?",)], "q string")
    assert [r.x for r in asked.select(is_path_query(F.col("q")).alias("x")).collect()] == [True, False]
    df = spark.createDataFrame([("a/x", "T > U"), ("ab/x", "T"), ("a/y/z", "Tx"), ("a", None)], "relative_path string, context_path string")
    assert rows(df.where(search_predicate(["a/"], ["a/y"])).select("relative_path")) == [("a",), ("a/x",)]
    assert rows(df.where(search_predicate(contexts=["T"])).select("relative_path")) == [("a/x",), ("ab/x",)]
    assert df.where(search_predicate()).count() == 4
    assert spark.range(1).select(context_prefix(F.lit("$.a[0]"), "$.a").alias("x")).first().x


def test_usage(spark):
    schema = "log_id long, logged_at timestamp_ntz, action_name string, query_hash string, top_k int, result_count long, redactions long"
    t = lambda n: dt.datetime(2024, 1, n)
    log = spark.createDataFrame([(1, t(1), "search", "h", 8, 4, 0), (2, t(5), "search", "h", 8, 2, 1), (3, t(5), "search", "h", 8, 2, 1), (4, t(6), None, None, None, None, None), (5, t(20), "ask", "k", 1, 1, None)], schema)
    assert usage.distinct_lines(log).count() == 4
    r = usage.report(usage.distinct_lines(log), "2024-01-10 00:00:00", 8).first()
    assert (r.events, r.query_hashes, r.avg_results, r.redactions) == (2, 1, 2.0, 1)
    assert {r.action_name: r.events for r in usage.by_action(log, "2024-01-31 00:00:00", 31).collect()} == {"search": 3, None: 1, "ask": 1}
    assert rows(usage.retained(log, 2).select("log_id")) == [(4,), (5,)]
    assert usage.report(log.limit(0), "2024-01-10 00:00:00").first().events == 0
    out = spark.createDataFrame([("s", 100, 40, True, False), ("s", 0, 0, False, False), ("t", 0, 0, False, True)], "tool string, retrieved_bytes long, returned_bytes long, compacted boolean, truncated boolean")
    assert {r.tool: r.reduction_ratio for r in usage.output_savings(out).collect()} == {"s": 0.6, "t": None}


def test_retention(spark):
    now = "2024-01-31 00:00:00"
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    gens = [("act", t(1), "active", False), ("lease", t(2), None, True), ("new", dt.datetime(2024, 1, 30, 23, 58), None, False), ("g1", t(30), None, False), ("g2", t(29), None, False), ("old", t(3), None, False)]
    df = spark.createDataFrame(gens, "table_name string, last_modified timestamp_ntz, role string, leased boolean")
    got = {r.table_name: (r.state, r.keep) for r in maintenance.retention(df, now).collect()}
    assert got == {"act": ("active", True), "lease": ("leased", True), "new": ("grace", True), "g1": ("retained", True), "g2": ("surplus", False), "old": ("expired", False)}


def test_windows_and_budgets(spark):
    files = [(f"f{k:02d}", b) for k, b in enumerate([10, 10, 50, 200, 10, 10, 10, 10])]
    df = spark.createDataFrame(files, "relative_path string, bytes long")
    got = [r.window for r in maintenance.windows(df, 3, 100, 1000).orderBy("relative_path").collect()]
    assert got == [0, 0, 0, 1, 2, 2, 2, 3]
    assert [r.window for r in maintenance.windows(df.withColumn("lane", F.lit("x")), 3, 100, 1000, lane="lane").orderBy("relative_path").collect()] == got
    assert maintenance.windows(df.limit(0)).count() == 0
    assert maintenance.page_batches([1, 2, 3, 30, 31, 5], 16) == [[1, 2, 3, 5], [30, 31]] and maintenance.page_batches(list(range(40)), 16) == [list(range(16)), list(range(16, 32)), list(range(32, 40))]
    assert [maintenance.column_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    out = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc"), (2, 1, None)], "query_id long, rank int, text string")
    assert rows(maintenance.within_output(out, 9).select("query_id", "rank")) == [(1, 1), (1, 2), (2, 1)]
