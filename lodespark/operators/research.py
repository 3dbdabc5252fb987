"""Research: several queries fused into one list of evidence, and evidence lines in source code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodespark.functions.redaction import redact
from lodespark.functions.text import meaningful_terms, normalize_for_match, normalized, snippet
from lodespark.session import spread, stash

RRF, PRIMARY = 60, 2
#: Queries whose terms one pass over the lines looks for.
BLOCK_QUERIES = 10_000
#: Columns of a compact report.
COMPACT = ("research_id", "rank", "source", "relative_path", "chunk_index", "context_path", "citation", "distance", "line_start", "line_end", "page_start", "page_end", "queries", "best_rank", "score")
LINE_LIMIT, FILES, BYTES = 20, 1_000, 32 * 1024 * 1024


def fused_evidence(results: DataFrame, asked: DataFrame) -> DataFrame:
    """(research_id, relative_path, chunk_index, score, best_rank, queries, rank).

    ``results`` has (research_id, query, is_primary, relative_path, chunk_index, rank from 1), ``asked`` (research_id, query)
    of all queries, with results or without. Each list adds its weight over 60 + rank: the primary query weighs twice the
    number of queries, others 1. Order is score, best rank, path, chunk.
    """
    n = asked.groupBy("research_id").agg(F.countDistinct("query").alias("n"))
    weight = F.when(F.col("is_primary"), F.greatest(F.lit(1), F.col("n") * PRIMARY)).otherwise(F.lit(1))
    sums = results.join(n, "research_id").groupBy("research_id", "relative_path", "chunk_index").agg(
        F.round(F.sum(weight / (RRF + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best_rank"), F.countDistinct("query").alias("queries")
    )
    order = Window.partitionBy("research_id").orderBy(F.desc("score"), "best_rank", "relative_path", "chunk_index")
    return sums.withColumn("rank", F.row_number().over(order))


def code_lines(files: DataFrame, queries: DataFrame, key: str = "relative_path", text: str = "text", limit: int = LINE_LIMIT) -> DataFrame:
    """(query_id, key, line, matched, score, snippet, rank): the best line of each file for each query, the ``limit`` best of a query.

    A line counts with two of the query's terms in it, or the only one; it scores 100 for each term and 1,000 where it
    holds the whole query. Order is score, terms, key, line. The terms of a block of queries are one automaton that passes
    once over the normalised lines; each task keeps the best of each query.
    """
    kind = files.schema[key].dataType.simpleString()
    terms = queries.select("query_id", normalize_for_match(F.trim("query")).alias("query"), meaningful_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    blocks = max(1, -(-terms.count() // BLOCK_QUERIES))
    rows = spread(files.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    schema = f"query_id long, key {kind}, line int, matched int, score int, snippet string"
    every = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if own:
            part = rows.mapInArrow(_code_lines([tuple(r) for r in own], limit, rows.schema["key"].dataType), schema)
            every = part if every is None else every.unionByName(part)
    if every is None:
        every = files.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matched"), "key", "line")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.withColumn("snippet", F.substring(redact(F.col("snippet")), 1, 260)).withColumnRenamed("key", key)


def _code_lines(own: list[tuple[int, str, list[str]]], limit: int, kind):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asking: dict[str, list[int]] = {}
        for j, (_, _, terms) in enumerate(own):
            for t in terms:
                asking.setdefault(t, []).append(j)
        find = ahocorasick.Automaton()
        for t, js in asking.items():
            find.add_word(t, (t, js))
        find.make_automaton()
        least = [min(2, len(terms)) for _, _, terms in own]
        best: list[list[tuple]] = [[] for _ in own]
        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top: dict[int, tuple] = {}
                for n, line in enumerate(re.split(r"\r?\n", text), 1):
                    plain = normalized(line)
                    hits = {t: js for _, (t, js) in find.iter(plain)}
                    for j, matched in Counter(j for js in hits.values() for j in js).items():
                        if matched >= least[j]:
                            found = (-100 * matched - 1000 * (own[j][1] in plain), -matched, key, n, line)
                            if j not in top or found[:2] < top[j][:2]:
                                top[j] = found
                for j, found in top.items():
                    held = best[j]
                    held.append(found)
                    if len(held) >= 4 * limit:
                        held.sort(key=lambda x: x[:4])
                        del held[limit:]
        out = [(own[j][0], key, n, -m, -s, line.strip()) for j, held in enumerate(best) for s, m, key, n, line in sorted(held, key=lambda x: x[:4])[:limit]]
        columns = list(zip(*out)) or [()] * 6
        types = [pa.int64(), to_arrow_type(kind), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "key", "line", "matched", "score", "snippet"])

    return run


def within_budget(files: DataFrame, most_files: int = FILES, most_bytes: int = BYTES, order: str = "relative_path", size: str = "bytes") -> DataFrame:
    """Files in order while there is room: a file that doesn't fit is passed over, the next may still fit.

    The choice is a fold that ends with ``most_files`` files, as each choice hangs on all before it. A file above
    ``most_bytes`` never fits. Ranges of the order follow one another with the state of the fold, two numbers, until one
    of them is full: a range is one task, and later ones aren't read.
    """
    rows = stash(files.select(order, size).where(F.col(size).isNotNull() & (F.col(size) <= most_bytes)).repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    kind, count, total, kept = files.schema[order].dataType.simpleString(), 0, 0, None
    parts = [r[0] for r in rows.select("_part").distinct().orderBy("_part").collect()]
    for part in parts:
        if count >= most_files:
            break

        def run(it, count=count, total=total):
            for pdf in it:
                keep = []
                for b in pdf[size]:
                    ok = count < most_files and total + b <= most_bytes
                    keep.append(ok)
                    count, total = count + ok, total + int(b) * ok
                yield pdf[keep]

        own = stash(rows.where(F.col("_part") == part).select(order, size).coalesce(1).sortWithinPartitions(order).mapInPandas(run, f"`{order}` {kind}, `{size}` long"))
        n, used = own.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        count, total, kept = count + n, total + used, own if kept is None else kept.unionByName(own)
    return kept if kept is not None else rows.select(order, F.col(size).cast("long").alias(size))


def compact(results: DataFrame, text: str = "text", length: int = 260) -> DataFrame:
    """Results with a short snippet instead of the text."""
    return results.withColumn("snippet", snippet(F.col(text), length)).drop(text)


def compact_evidence(evidence: DataFrame, length: int = 260) -> DataFrame:
    """Evidence of a research report in the columns a reader needs, with a short snippet instead of the text."""
    kept = [c for c in COMPACT if c in evidence.columns]
    return evidence.withColumn("snippet", snippet(F.col("text"), length)).select(*kept, "snippet")


def answer(results: DataFrame, citation: str = "citation", text: str = "text") -> DataFrame:
    """(query_id, answer): the results in order, each as [n] citation: text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(citation), F.lit(": "), F.col(text))
    parts = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["line"]), "\n\n").alias("answer"))


def readiness(found: DataFrame, missing: int, stale: int, least: int = 1) -> DataFrame:
    """(research_id, evidence, ready, gaps) of research results."""
    per = found.groupBy("research_id").agg(F.count("*").alias("evidence"))
    gaps = F.filter(
        F.array(F.when(F.col("evidence") < least, "too little evidence"), F.when(F.lit(missing > 0), "files are missing from the index"), F.when(F.lit(stale > 0), "indexed files are stale")), lambda g: g.isNotNull()
    )
    return per.withColumn("gaps", gaps).withColumn("ready", F.size("gaps") == 0)

