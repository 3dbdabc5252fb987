"""Retention of generations, maintenance decisions, windows of work, output budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRACE_MINUTES, KEPT, AGE_DAYS = 5, 3, 7


def retention(generations: DataFrame, now, kept: int = KEPT, age_days: int = AGE_DAYS, grace_minutes: int = GRACE_MINUTES) -> DataFrame:
    """Adds ``state`` and ``keep`` to (table_name, last_modified, role, leased).

    Active, resumable, rollback and leased generations are kept; others within the grace period too; then the newest up
    to ``kept`` in all and of at most ``age_days`` days.
    """
    end = F.lit(now).cast("timestamp_ntz")
    held = F.coalesce(F.col("role").isin("active", "resumable", "rollback"), F.lit(False)) | F.coalesce("leased", F.lit(False))
    rows = generations.withColumn("_held", held).withColumn("_grace", F.col("last_modified") > end - F.expr(f"interval {grace_minutes} minutes"))
    rows = rows.withColumn("_young", F.col("last_modified") >= end - F.expr(f"interval {age_days} days"))
    every = Window.partitionBy()
    rows = rows.withColumn("_slots", F.greatest(F.lit(kept) - F.sum(F.col("_held").cast("int")).over(every), F.lit(0)))
    open_ = ~F.col("_held") & ~F.col("_grace") & F.col("_young")
    rows = rows.withColumn("_n", F.sum(open_.cast("int")).over(every.orderBy(F.desc("last_modified"), "table_name").rowsBetween(Window.unboundedPreceding, 0)))
    state = (
        F.when(F.col("role").isin("active", "resumable", "rollback"), F.col("role")).when(F.coalesce("leased", F.lit(False)), "leased").when(F.col("_grace"), "grace")
        .when(open_ & (F.col("_n") <= F.col("_slots")), "retained").when(~F.col("_young"), "expired").otherwise("surplus")
    )
    return rows.withColumn("state", state).withColumn("keep", ~F.col("state").isin("expired", "surplus")).select(*generations.columns, "state", "keep")


def needs_compaction(rows: Column, mutations: Column, fragments: Column, small: Column) -> Column:
    """Large tables after many changes, or with many fragments of which a quarter is small."""
    share = F.when(fragments > 0, small / fragments).otherwise(F.lit(0.0))
    return (rows >= 100_000) & ((mutations >= 20) | ((fragments >= 8) & (share >= 0.25)))


def estimated_chunks(size: Column, chunk_size: int = 1200, overlap: int = 200) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / max(1, chunk_size - overlap))).cast("long")


def windows(files: DataFrame, most_files: int = 64, most_bytes: int = 50_000_000, most_chunks: int = 8_192, order: str = "relative_path", lane: str | None = None) -> DataFrame:
    """(order, bytes, window): files in order cut into windows that stay within all three limits; a file alone may exceed them.

    The cut is a running sum with resets. With a ``lane`` column each lane is cut on its own, in parallel; without one it
    is a single ordered stream of three numbers.
    """
    cols = [order, "bytes"] + ([lane] if lane else [])
    rows = files.select(*cols).withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long")).withColumn("chunks", estimated_chunks(F.col("bytes")))
    rows = rows.repartition(lane).sortWithinPartitions(lane, order) if lane else rows.repartition(1).sortWithinPartitions(order)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n, size, parts, window = None, 0, 0, 0, 0
        for pdf in it:
            out = []
            lanes = pdf[lane] if lane else [None] * len(pdf)
            for l, b, c in zip(lanes, pdf["bytes"], pdf["chunks"]):  # noqa: E741
                if l != own:
                    own, n, size, parts, window = l, 0, 0, 0, 0
                if n and (n + 1 > most_files or size + b > most_bytes or parts + c > most_chunks):
                    n, size, parts, window = 0, 0, 0, window + 1
                n, size, parts = n + 1, size + b, parts + c
                out.append(window)
            yield pdf.assign(window=out)

    schema = f"`{order}` string, bytes long" + (f", `{lane}` string" if lane else "") + ", chunks long, window int"
    return rows.mapInPandas(run, schema)


def page_batches(pages: list[int], most: int = 16) -> list[list[int]]:
    """Page numbers in batches of at most ``most`` pages that span fewer than ``most`` numbers."""
    out: list[list[int]] = []
    for p in sorted(set(pages)):
        if out and len(out[-1]) < most and p - out[-1][0] < most:
            out[-1].append(p)
        else:
            out.append([p])
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def page_spans(pages: pd.Series) -> pd.Series:
    """``page_batches`` of an array of page numbers."""
    return pages.map(lambda p: [] if p is None else page_batches([int(x) for x in p if x is not None]))


@F.pandas_udf(T.StringType())
def column_names(n: pd.Series) -> pd.Series:
    return n.map(lambda k: None if pd.isna(k) else column_name(int(k)))


def within_output(rows: DataFrame, most_bytes: int, by: str = "query_id", text: str = "text", rank: str = "rank") -> DataFrame:
    """The first rows of each group whose texts fit the byte budget together."""
    run = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used_bytes", F.sum(F.octet_length(F.coalesce(text, F.lit("")))).over(run)).where(F.col("used_bytes") <= most_bytes)


def column_name(n: int) -> str:
    """Spreadsheet name of a column from 1."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
