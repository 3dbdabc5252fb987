"""Evaluation of rankings against graded judgments, with metrics by group and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)
#: Thresholds of the quality gates; the last is a maximum.
GATES = {"recall_at_1": 0.60, "recall_at_3": 0.75, "recall_at_5": 0.80, "recall_at_10": 0.85, "precision_at_5": 0.10, "mrr_at_10": 0.65, "ndcg_at_10": 0.75, "exact_citation_rate": 0.90}
MAXIMUM_GATES = {"false_positive_rate": 0.05}
LEAST_CASES = 100


def cases(results: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query of (query_id, answerable, category, locale): its metrics.

    ``results`` has (query_id, value, rank from 1) and ``judgments`` (query_id, value, relevance 0 to 3) with an optional
    ``kind``, path or citation. A value counts at its first rank only and keeps that rank. An answerable query is hit by
    any relevant value, one that can't be answered by no value at all; ``citation_hit`` is null where none is asked for.
    """
    relevant = judgments.where("relevance > 0").groupBy("query_id", "value").agg(F.max("relevance").alias("relevance"))
    first = results.groupBy("query_id", "value").agg(F.min("rank").alias("rank"))
    returned = first.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"returned_{k}") for k in CUTS], F.count("*").alias("returned"))
    hit = first.join(relevant, ["query_id", "value"])
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    scored = hit.groupBy("query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in CUTS], F.count("*").alias("hits"), F.min("rank").alias("first_rank"),
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("relevance")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "value"))
    ideal = relevant.withColumn("n", place).groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("n") <= 10, gain(F.col("relevance")) / F.log2(F.col("n") + 1)).otherwise(0.0)).alias("ideal"))
    kind = F.col("kind") if "kind" in judgments.columns else F.lit("path")
    cited = judgments.where((kind == "citation") & (F.col("relevance") > 0)).select("query_id").distinct().withColumn("cited", F.lit(True))
    q = queries.select("query_id", F.coalesce("answerable", F.lit(True)).alias("answerable"), "category", "locale")
    all_ = q.join(ideal, "query_id", "left").join(returned, "query_id", "left").join(scored, "query_id", "left").join(cited, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    recall = {k: F.when(~F.col("answerable"), F.when(zero("returned") == 0, 1.0).otherwise(0.0)).when(zero("relevant") > 0, zero(f"hits_{k}") / F.col("relevant")).otherwise(0.0) for k in CUTS}
    answered = F.when(F.col("answerable"), zero("hits") > 0).otherwise(zero("returned") == 0)
    return all_.select(
        "query_id", "answerable", "category", "locale", zero("returned").alias("returned"), "first_rank",
        *[recall[k].alias(f"recall_at_{k}") for k in CUTS],
        *[(zero(f"hits_{k}") / F.lit(k)).alias(f"precision_at_{k}") for k in CUTS],
        F.when(zero("returned_10") > 0, zero("hits_10") / F.col("returned_10")).otherwise(F.lit(0.0)).alias("precision_of_returned"),
        F.when(F.col("first_rank") <= 10, 1.0 / F.col("first_rank")).otherwise(F.lit(0.0)).alias("reciprocal_rank"),
        F.when(~F.col("answerable"), F.when(zero("returned") == 0, 1.0).otherwise(0.0)).when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg_at_10"),
        answered.alias("hit"), F.when(F.col("cited"), zero("hits") > 0).alias("citation_hit"), (zero("returned") == 0).alias("abstained"),
        (~F.col("answerable") & (zero("returned") > 0)).alias("false_positive"),
    )


def _means():
    ok = F.col("answerable")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return [
        F.count("*").alias("cases"), F.count_if(ok).alias("answerable_cases"), *[mean(f"recall_at_{k}").alias(f"recall_at_{k}") for k in CUTS],
        mean("precision_at_5").alias("precision_at_5"), mean("reciprocal_rank").alias("mrr_at_10"), mean("ndcg_at_10").alias("ndcg_at_10"),
    ]


def metrics(case_rows: DataFrame) -> DataFrame:
    """One row of means over answerable cases; rates are null when nothing falls under them."""
    bad = F.count_if("false_positive")
    none = F.count_if(~F.col("answerable"))
    cited = F.count("citation_hit")
    return case_rows.agg(*_means(), F.when(cited > 0, F.count_if("citation_hit") / cited).alias("exact_citation_rate"), F.when(none > 0, bad / none).alias("false_positive_rate"))


def groups(case_rows: DataFrame, by: str) -> DataFrame:
    """The means by category or locale; the false-positive rate of a group without unanswerable cases is 0."""
    none = F.count_if(~F.col("answerable"))
    return case_rows.groupBy(by).agg(*_means(), F.when(none > 0, F.count_if("false_positive") / none).otherwise(F.lit(0.0)).alias("false_positive_rate"))


def gates(metric_row: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """(metric, direction, threshold, actual, applicable, passed); a metric without a value, or that isn't there, fails."""
    rows = [(k, "minimum", v) for k, v in (GATES if least is None else least).items()] + [(k, "maximum", v) for k, v in (MAXIMUM_GATES if most is None else most).items()]
    value = lambda k: f"cast({k} as double)" if k in metric_row.columns else "cast(null as double)"
    stack = f"stack({len(rows)}, " + ", ".join(f"'{k}', '{d}', cast({v} as double), {value(k)}" for k, d, v in rows) + ") as (metric, direction, threshold, actual)"
    out = metric_row.selectExpr(stack)
    passed = F.when(F.col("direction") == "minimum", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    return out.withColumn("applicable", F.col("actual").isNotNull()).withColumn("passed", F.coalesce(passed, F.lit(False)))


def verified(case_rows: DataFrame, thresholds: dict[str, float], stale_files: int, graded_cases: int, least: int = LEAST_CASES) -> DataFrame:
    """One row (verified, gaps): whether an evaluation may count as proof, and what it lacks for that.

    It needs ``least`` cases, some that can and some that can't be answered, cases with citations and with graded
    judgments, all nine thresholds, and no stale files.
    """
    known = {*GATES, *MAXIMUM_GATES}
    row = case_rows.agg(F.count("*").alias("n"), F.count_if("answerable").alias("yes"), F.count("citation_hit").alias("cited"))
    gap = lambda bad, name: F.when(bad, F.lit(name))
    gaps = F.array_compact(F.array(
        gap(F.col("n") < least, "too few cases"), gap(F.col("yes") == 0, "no answerable cases"), gap(F.col("yes") == F.col("n"), "no unanswerable cases"), gap(F.col("cited") == 0, "no citation cases"),
        gap(F.lit(graded_cases == 0), "no graded cases"), gap(F.lit(not known <= set(thresholds)), "thresholds are missing"), gap(F.lit(stale_files > 0), "files are stale"),
    ))
    return row.select((F.size(gaps) == 0).alias("verified"), gaps.alias("gaps"))


def within_distance(results: DataFrame, most: float | None) -> DataFrame:
    """Results at most that far; those without a distance go. No limit keeps all."""
    return results if most is None else results.where(F.col("distance") <= most)


def judgments_of(golden: DataFrame) -> DataFrame:
    """(query_id, kind, value, relevance): explicit judgments, else the expected values of the kind at relevance 1.

    Where a query has citation judgments above 0, those of paths don't count.
    """
    explicit = golden.select("query_id", F.explode("relevance_judgments").alias("j")).select("query_id", "j.kind", "j.value", "j.relevance")
    expected = golden.select("query_id", F.explode("expected_paths").alias("value")).withColumn("kind", F.lit("path")).unionByName(
        golden.select("query_id", F.explode("expected_citations").alias("value")).withColumn("kind", F.lit("citation"))
    )
    implied = expected.join(explicit.select("query_id", "kind").distinct(), ["query_id", "kind"], "left_anti").select("query_id", "kind", "value", F.lit(1).alias("relevance"))
    every = explicit.unionByName(implied)
    cited = every.where("kind = 'citation' and relevance > 0").select("query_id").distinct().withColumn("cited", F.lit(True))
    return every.join(cited, "query_id", "left").where("cited is null or kind = 'citation'").drop("cited")


def latency(df: DataFrame, column: str, by: str) -> DataFrame:
    """Count, least, mean, nearest-rank percentiles and greatest of a measure by group."""
    p = lambda q, n: F.expr(f"percentile_disc({q}) within group (order by {column})").alias(n)
    return df.groupBy(by).agg(F.count(column).alias("count"), F.min(column).alias("least"), F.avg(column).alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.max(column).alias("greatest"))
