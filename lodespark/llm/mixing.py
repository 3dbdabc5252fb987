"""Mixing sources to target shares of tokens by weighted sampling without replacement.

Every document has an exponential key, -ln(u) over its quality weight, with u from a hash of its id. A source's budget is
its target share of the total; it gets as many complete epochs as fit, at most its cap, and the rest from the documents
with the smallest keys up to a prefix sum of tokens. The prefix sums are those of ranges of keys first; only the range
in which a budget ends is sorted.

Documents without tokens, of no source or of a source without a target are not chosen. Sources of a target without
documents, and those whose cap is reached, fall short; the report says by how much. A share or cap that is null or
negative counts as 0, repeated targets of a source are added and their largest cap holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.llm import tokens
from lodespark.session import stash

SEED = 20_250
#: Ranges of keys of a source.
RANGES = 4096
#: Targets are a small fixed table; more are an error.
MOST_TARGETS = 10_000


def quality(text: Column) -> Column:
    """A weight of 0.05 to 1: the share of letters and spaces, less for texts of under 200 characters."""
    clean = F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), clean * F.least(F.lit(1.0), 0.5 + F.length(text) / 400))


def exponential_key(id_col: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u uniform in (0, 1) from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / weight


def mixed(
    df: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    ranges: int = RANGES,
    path: str = tokens.RANKS,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, tokens, repeats) and the report by target source.

    ``total_tokens`` is the total that shares are taken of; by default the tokens of all documents of target sources.
    A budget's last document is the one whose middle lies within it, so a source misses it by half a document at most.
    """
    goals = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    if goals.count() > MOST_TARGETS:
        raise ValueError(f"there may be {MOST_TARGETS} targets")
    goals = F.broadcast(goals)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    docs = docs.join(F.broadcast(goals.select("source")), "source", "left_semi").where(F.length("text") > 0)
    keyed = docs.select("doc_id", "source", exponential_key(F.col("doc_id"), quality(F.col("text")), seed).alias("key"), "text")
    pool = tokens.sized(keyed, path=path).where("tokens > 0")
    # any growing function of the key will do, as a range is only a unit of work; this one parts light documents, of large
    # keys, as well as heavy ones
    pool = stash(pool.withColumn("range", F.floor(F.col("key") / (F.col("key") + 1) * ranges).cast("int")))

    parts = pool.groupBy("source", "range").agg(F.sum("tokens").alias("range_tokens"))
    by_source = Window.partitionBy("source")
    parts = parts.withColumn("before", F.sum("range_tokens").over(by_source.orderBy("range")) - F.col("range_tokens"))
    parts = parts.withColumn("available", F.sum("range_tokens").over(by_source))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.lit(float(pool.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]))
    parts = parts.join(goals, "source").withColumn("budget", F.col("target_share") * total)
    parts = parts.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats")).cast("int"))
    parts = parts.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0.0)))
    # of every source the range in which its budget ends: one row for each target
    over = F.col("before") + F.col("range_tokens") > F.col("rest")
    ends = parts.groupBy("source").agg(
        F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.min(F.when(over, F.col("range"))).alias("edge"), F.min(F.when(over, F.col("before"))).alias("before")
    )
    rows = pool.join(F.broadcast(stash(ends)), "source")
    whole = rows.where("edge is null or range <> edge").withColumn("extra", F.when(F.col("edge").isNull() | (F.col("range") < F.col("edge")), 1).otherwise(0))
    up_to = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where("range = edge").withColumn("extra", F.when(up_to - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    chosen = whole.unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("extra")).where("repeats > 0")
    chosen = chosen.select("doc_id", "source", "tokens", "repeats")

    have = pool.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    report = goals.join(have, "source", "left").join(used, "source", "left").withColumn("target_tokens", F.col("target_share") * total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = report.select("source", "target_share", "max_repeats", "target_tokens", zero("available_tokens"), zero("chosen_tokens"), zero("documents"), zero("most_repeats"))
    everything = F.sum("chosen_tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("chosen_tokens") / everything).otherwise(F.lit(0.0)))
    return chosen, report.withColumn("shortfall_tokens", F.greatest(F.col("target_tokens") - F.col("chosen_tokens"), F.lit(0.0)))
