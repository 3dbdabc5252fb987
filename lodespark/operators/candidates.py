"""Lexical candidates of a batch of queries in stages: paths first, then full text, then fuzzy supplements where those were few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.text import tokens
from lodespark.operators import lexical
from lodespark.operators.predicates import exact_path, is_path_query
from lodespark.session import stash

#: Scores of rows that a query names by their whole path, or by its end.
EXACT_PATH, PATH_END = 9007199254740991.0, 9007199254740990.0
#: Identifiers in a query, what may be misspelled, and how much a supplement's terms count.
IDENTIFIER = r"([\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)+)"
FUZZY_TERM = r"^[a-z0-9_.-]{7,}$"
IDENTIFIER_BOOST, RARE_BOOST, RARE_TERMS = 2.0, 1.25, 3


def path_rows(rows: DataFrame, queries: DataFrame, key: str = "key", path: str = "relative_path") -> DataFrame:
    """(query_id, key, path_match): rows of files that a query names, 2 by the whole path, 1 by its end.

    The last part of the path is the equi-join key of every kind of match.
    """
    clean = F.regexp_replace(F.replace(F.trim("query"), F.lit("\\"), F.lit("/")), r"^\./", "")
    asked = queries.select("query_id", clean.alias("_query")).where(is_path_query(F.col("_query"))).withColumn("_base", F.substring_index("_query", "/", -1))
    have = rows.select(key, path, F.substring_index(path, "/", -1).alias("_base"))
    pairs = have.join(lexical.small(asked), "_base").select("query_id", key, exact_path(F.col(path), F.col("_query")).alias("path_match"))
    return pairs.where("path_match is not null")


def variants(queries: DataFrame) -> DataFrame:
    """(query_id, variant, term, boost, fuzzy) of the supplements of (query_id, query, tokens), in the order they are tried.

    First the identifiers of the query, distinct and in order, then its longest terms that may be misspelled. The phrase of
    all tokens, which would come before them, finds only rows that the full text of the same tokens has found already.
    """
    ids = F.array_distinct(F.regexp_extract_all(F.col("query"), F.lit(IDENTIFIER), 1))
    # longest first, ties in binary order
    sized = F.transform(F.filter("tokens", lambda t: t.rlike(FUZZY_TERM)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    rare = F.transform(F.slice(F.array_sort(sized), 1, RARE_TERMS), lambda x: x["t"])
    one = lambda terms, boost, first: F.transform(terms, lambda t, k: F.struct((k + first).alias("variant"), t.alias("term"), F.lit(boost).alias("boost")))
    every = queries.select("query_id", F.explode(F.concat(one(ids, IDENTIFIER_BOOST, F.lit(0)), one(rare, RARE_BOOST, F.size(ids)))).alias("v"))
    return every.select("query_id", "v.variant", "v.term", "v.boost", F.col("v.term").rlike(FUZZY_TERM).alias("fuzzy"))


def _expanded(indexed: DataFrame, supplements: DataFrame) -> DataFrame:
    """(q, query_id, variant, token, boost): the tokens of each supplement's term, and for fuzzy ones those of the index one edit away."""
    named = supplements.withColumn("q", F.xxhash64("query_id", "variant")).withColumn("own", F.explode(tokens(F.col("term"))))
    exact = named.select("q", "query_id", "variant", F.col("own").alias("token"), "boost")
    asked = named.where("fuzzy").select(F.col("own").alias("term")).distinct()
    # only words that share a start with an asked term leave the index
    starts = lexical.small(asked.select(F.substring("term", 1, 3).alias("start")).distinct())
    words = indexed.select(F.explode("tokens").alias("token")).withColumn("start", F.substring("token", 1, 3)).join(starts, "start", "left_semi").select("token").distinct()
    near = lexical.fuzzy_tokens(words, asked).withColumnRenamed("token", "found")
    more = named.where("fuzzy").join(lexical.small(near), named["own"] == near["term"]).select("q", "query_id", "variant", F.col("found").alias("token"), "boost")
    return exact.unionByName(more).distinct()


def staged(rows: DataFrame, queries: DataFrame, limit: int, minimum: int, key: str = "key", path: str | None = "relative_path") -> DataFrame:
    """(query_id, key, stage, score, path_match, position): candidates of each query (query_id, query), at most ``limit`` but for paths.

    ``rows`` have the index columns beside ``key``, a whole number. Stage 0 are rows whose path the query names, stage 1 the
    best by full text over its distinct tokens. Where both give fewer than ``minimum`` rows the supplements follow, one
    after the other, until there are enough: stage 2 and on. A row counts once, at its first stage. Queries without tokens
    have no candidates.
    """
    asked = stash(queries.select("query_id", "query", F.array_distinct(tokens(F.col("query"))).alias("tokens")).where(F.size("tokens") > 0))
    full = lexical.scored(rows, key, asked.select(F.col("query_id").alias("q"), F.explode("tokens").alias("token")), limit)
    full = full.select(F.col("q").alias("query_id"), F.col("key").alias(key), F.lit(1).alias("stage"), "rank", "score")
    first = full.withColumn("path_match", F.lit(None).cast("int"))
    if path:
        by_path = Window.partitionBy("query_id").orderBy(F.desc("path_match"), key)
        named = path_rows(rows, asked, key, path).withColumn("rank", F.row_number().over(by_path)).where(F.col("rank") <= limit)
        value = F.when(F.col("path_match") == 2, F.lit(EXACT_PATH)).otherwise(F.lit(PATH_END))
        first = named.select("query_id", key, F.lit(0).alias("stage"), "rank", value.alias("score"), "path_match").unionByName(first)
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("stage"))).where("_n = 1").drop("_n")
    first = stash(first)
    have = first.groupBy("query_id").agg(F.count("*").alias("have"))
    short = asked.join(have, "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < minimum)
    if not short.limit(1).count():
        return _placed(first)
    terms = stash(_expanded(rows, variants(short)))
    found = lexical.scored(rows, key, terms.select("q", "token", "boost"), limit).withColumnRenamed("key", "_key")
    found = found.join(terms.select("q", "query_id", "variant").distinct(), "q").select("query_id", F.col("_key").alias(key), "variant", "rank", "score")
    found = found.join(first.select("query_id", key), ["query_id", key], "left_anti")
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("variant"))).where("_n = 1").drop("_n")
    return _placed(first.unionByName(_enough(found, short.select("query_id", "have"), limit, minimum).withColumn("path_match", F.lit(None).cast("int"))))


def _enough(found: DataFrame, short: DataFrame, limit: int, minimum: int) -> DataFrame:
    """The rows of the supplements up to the one that makes them enough."""
    sizes = found.groupBy("query_id", "variant").agg(F.count("*").alias("n")).join(short, "query_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = sizes.withColumn("before", before + F.col("have")).where(F.col("before") < minimum).select("query_id", "variant", "before")
    rows = found.join(used, ["query_id", "variant"])
    place = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy("rank"))
    return rows.withColumn("_at", place + F.col("before")).where(F.col("_at") <= limit).select(*[c for c in found.columns if c != "variant"], (F.col("variant") + 2).cast("int").alias("stage"))


def _placed(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("stage", "rank")
    return rows.withColumn("position", F.row_number().over(order)).drop("rank")

