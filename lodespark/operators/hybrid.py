"""Hybrid ranking: fusion of vector and lexical ranks, abstention, collapse of near duplicates, spread over sources.

All steps work on a batch of queries at once; ``query_id`` is part of every key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.text import has_evidence, tokenize

RRF = 60
FARTHEST = 1.1


def fused(vector: DataFrame, lexical: DataFrame, key: str = "key", vector_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """(query_id, key, distance, lexical_score, vector_rank, lexical_rank, score, rank).

    Rows with a finite distance are ranked by distance and key, rows with a score above 0 by score and key, both from 0;
    each rank adds weight / (60 + rank). Rows in neither ranking are dropped; order is score, distance, key.
    """
    own = Window.partitionBy("query_id")
    v = vector.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") != float("inf"))).select("query_id", key, "distance")
    v = v.withColumn("v", F.row_number().over(own.orderBy("distance", key)) - 1)
    l = lexical.where("score > 0").select("query_id", key, F.col("score").alias("lexical_score"))  # noqa: E741
    l = l.withColumn("l", F.row_number().over(own.orderBy(F.desc("lexical_score"), key)) - 1)  # noqa: E741
    both = v.join(l, ["query_id", key], "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (RRF + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("v", vector_weight) + part("l", lexical_weight)).where("score > 0")
    order = [F.desc("score"), F.coalesce("distance", F.lit(float("inf"))), F.col(key)]
    both = both.withColumn("rank", F.row_number().over(own.orderBy(*order)))
    return both.select("query_id", key, "distance", "lexical_score", (F.col("v") + 1).alias("vector_rank"), (F.col("l") + 1).alias("lexical_rank"), "score", "rank")


def passes(query: Column, text: Column, distance: Column | None = None, semantic: bool = False, farthest: float = FARTHEST) -> Column:
    """Abstention: lexical evidence, or with a semantic provider a small distance."""
    lexical = has_evidence(query, text)
    return lexical | F.coalesce(distance <= farthest, F.lit(False)) if semantic and distance is not None else lexical


def collapse_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def text_digest(text: Column) -> Column:
    """Equal for texts that are copies but for case and white space."""
    return F.sha2(collapse_key(text), 256)


def collapsed(rows: DataFrame, text: str = "text", path: str = "relative_path", rank: str = "rank", exact: Column | None = None, digest: str | None = None) -> DataFrame:
    """One row per text and query: at the best rank of its copies, the copy with the exact path, then the shallower, then the shorter path.

    ``digest`` names a column with ``text_digest``, so that the texts themselves needn't come along.
    """
    key = F.col(digest) if digest else text_digest(F.col(text))
    best = F.coalesce(exact.cast("int"), F.lit(0)) if exact is not None else F.lit(0)
    depth = F.size(F.split(path, "/"))
    group = Window.partitionBy("query_id", "_text")
    rows = rows.withColumn("_text", key).withColumn("_first", F.min(rank).over(group))
    rows = rows.withColumn("_pick", F.row_number().over(group.orderBy(F.desc(best), depth, F.length(path), rank)))
    return rows.where("_pick = 1").withColumn(rank, F.col("_first")).drop("_text", "_first", "_pick")


def spread(rows: DataFrame, k: int, cap: int, path: str = "relative_path", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query: at most ``cap`` of a path, then the rest in order; no two that overlap in a file.

    The choice is greedy, so it runs as one Arrow group per query over the ranked candidates, which the candidate limits
    bound. Rows without both offsets overlap nothing.
    """
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable")
        chosen: list[int] = []
        spans: dict[str, list[tuple[float, float]]] = {}
        count: dict[str, int] = {}

        def offer(i: int, limit: int | None) -> None:
            p, s, e = pdf[path].iat[i], pdf["char_start"].iat[i], pdf["char_end"].iat[i]
            if i in chosen or (limit is not None and count.get(p, 0) >= limit):
                return
            if not (pd.isna(s) or pd.isna(e)):
                if any(a < e and s < b for a, b in spans.get(p, ())):
                    return
                spans.setdefault(p, []).append((s, e))
            chosen.append(i)
            count[p] = count.get(p, 0) + 1

        for limit in (cap, None):
            for i in range(len(pdf)):
                if len(chosen) < k:
                    offer(i, limit)
        out = pdf.iloc[chosen].copy()
        out[rank] = range(1, len(out) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(run, schema)


def capped(rows: DataFrame, k: int, cap: int, path: str = "relative_path", rank: str = "rank") -> DataFrame:
    """``spread`` where no rows overlap: two windows, no Python."""
    own = Window.partitionBy("query_id")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", path).orderBy(rank)))
    rows = rows.withColumn("_order", F.row_number().over(own.orderBy((F.col("_nth") > cap).cast("int"), rank)))
    return rows.where(F.col("_order") <= k).withColumn(rank, F.col("_order")).drop("_nth", "_order")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are 0 alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def mmr(rows: DataFrame, k: int, text: str = "text", rank: str = "rank", weight: float = 0.85) -> DataFrame:
    """Maximal marginal relevance: relevance 1 / rank against the largest token overlap with what is chosen."""
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable").reset_index(drop=True)
        sets = [set(tokenize(t or "")) for t in pdf[text]]
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            def gain(i: int) -> float:
                overlap = max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0)
                return weight / (1 + i) - (1 - weight) * overlap

            chosen.append(max((i for i in range(len(pdf)) if i not in chosen), key=lambda i: (gain(i), -i)))
        out = pdf.iloc[chosen].copy()
        out[rank] = range(1, len(out) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(run, schema)


def reranked(rows: DataFrame, scorer, k: int, query: str = "query", text: str = "text") -> DataFrame:
    """Candidates in the order of ``scorer(queries, texts) -> scores``, a batch function such as a cross-encoder's."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(rerank_score=[float(x) for x in scorer(list(pdf[query]), list(pdf[text]))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", rerank_score double"
    scored = rows.mapInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
