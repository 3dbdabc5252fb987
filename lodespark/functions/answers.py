"""Checks on generated answers and the blocks of sources that go into a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cited_numbers(answer: Column) -> Column:
    """The distinct numbers an answer cites as [n], in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,4})\]"), 1), lambda n: n.cast("int")))


def citation_status(answer: Column, sources: Column) -> Column:
    """none without sources, missing without citations, else valid, partial or invalid by whether they are 1..sources."""
    cited = cited_numbers(answer)
    good = F.size(F.filter(cited, lambda n: (n >= 1) & (n <= sources)))
    return F.when(sources == 0, "none").when(F.size(cited) == 0, "missing").when(good == F.size(cited), "valid").when(good > 0, "partial").otherwise("invalid")


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_blocks(results: DataFrame, most_chars: int, citation: str = "citation", text: str = "text") -> DataFrame:
    """(query_id, blocks, sources): <source n citation>text</source> in rank order while they fit the budget together."""
    block = F.concat(F.lit('<source n="'), F.col("rank").cast("string"), F.lit('" citation="'), escaped(F.col(citation)), F.lit('">\n'), escaped(F.col(text)), F.lit("\n</source>"))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("_block", block).withColumn("_used", F.sum(F.length("_block") + 1).over(run)).where(F.col("_used") <= most_chars + 1)
    parts = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_block"))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["_block"]), "\n").alias("blocks"), F.size("p").alias("sources"))
