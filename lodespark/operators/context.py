"""Neighbours of hits and citations looked up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.citations import cited_index, cited_path
from lodespark.operators.lexical import small

FIELDS = ("chunk_index", "context_path", "text", "char_start", "char_end")


def ranges(hits: DataFrame, radius: int, by: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    """Ranges of chunk indices around hits, with touching or overlapping ranges of a path made one."""
    own = Window.partitionBy(*by).orderBy("first", "last")
    r = hits.select(*by, F.greatest(F.col("chunk_index") - radius, F.lit(0)).alias("first"), (F.col("chunk_index") + radius).alias("last")).distinct()
    before = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("new", F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0))
    r = r.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int, where=None) -> DataFrame:
    """(query_id, relative_path, chunk_index, context): the chunks within ``radius`` of each hit in order.

    An equi-join on path and index: each hit asks for its 2 * radius + 1 indices, so no range join is needed. ``where``
    applies to the neighbours too. Chunks delivered again count once.
    """
    rows = chunks.where(where) if where is not None else chunks
    asked = hits.select("query_id", "relative_path", F.col("chunk_index").alias("hit")).distinct()
    asked = asked.withColumn("chunk_index", F.explode(F.sequence(F.greatest(F.col("hit") - radius, F.lit(0)), F.col("hit") + radius)))
    wanted = small(asked.select("relative_path", "chunk_index").distinct())  # texts of other chunks are not moved
    rows = rows.select("relative_path", *FIELDS).join(wanted, ["relative_path", "chunk_index"], "left_semi").dropDuplicates(["relative_path", "chunk_index"])
    found = asked.join(rows, ["relative_path", "chunk_index"])
    return found.groupBy("query_id", "relative_path", F.col("hit").alias("chunk_index")).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("context"))


def expanded(citations: DataFrame, chunks: DataFrame, radius: int, citation: str = "citation") -> DataFrame:
    """(citation, relative_path, chunk_index, context, found): citations looked up with their neighbours.

    ``found`` is whether the cited chunk exists and its own citation is the given one.
    """
    from lodespark.functions.citations import of_chunks

    asked = citations.select(F.col(citation).alias("citation"), cited_path(F.col(citation)).alias("relative_path"), cited_index(F.col(citation)).alias("chunk_index"))
    wanted = small(asked.select("relative_path", "chunk_index").distinct())
    real = chunks.join(wanted, ["relative_path", "chunk_index"], "left_semi").select("relative_path", "chunk_index", of_chunks().alias("own")).distinct()
    checked = asked.join(real, ["relative_path", "chunk_index"], "left").groupBy("citation", "relative_path", "chunk_index").agg(F.max(F.coalesce(F.col("own") == F.col("citation"), F.lit(False))).alias("found"))
    around = neighbours(checked.where("found").select(F.col("citation").alias("query_id"), "relative_path", "chunk_index"), chunks, radius)
    return checked.join(around.select(F.col("query_id").alias("citation"), "context"), "citation", "left")
