"""Corpus audit: what is missing, stale, reusable, duplicate; statistics and fingerprints of an index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.operators.predicates import archive_like, normalized_prefixes


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` should end in a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def missing(supported: DataFrame, indexed: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """Supported paths that are neither indexed nor known to be empty."""
    out = supported.select("relative_path").distinct().join(indexed.select("relative_path").distinct(), "relative_path", "left_anti")
    return out.join(empty.select("relative_path"), "relative_path", "left_anti") if empty is not None else out


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, reason): indexed paths that are gone or whose current checksum isn't indexed."""
    have = indexed.select("relative_path", "checksum").distinct()
    now = current.select("relative_path", F.col("checksum").alias("now"))
    joined = have.join(now, "relative_path", "left").groupBy("relative_path").agg(F.max(F.col("now").isNotNull()).alias("there"), F.max(F.coalesce(F.col("now") == F.col("checksum"), F.lit(False))).alias("same"))
    return joined.where("not same").select("relative_path", F.when(F.col("there"), "changed").otherwise("removed").alias("reason"))


def reusable(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current files of which path and checksum are in the previous manifest."""
    return current.join(previous.select("relative_path", "checksum").distinct(), ["relative_path", "checksum"], "left_semi")


def removed(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("relative_path").distinct().join(current.select("relative_path"), "relative_path", "left_anti")


def can_resume(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether every file of a run is unchanged."""
    now = current.select("relative_path", F.col("checksum").alias("now"))
    pairs = previous.select("relative_path", "checksum").join(now, "relative_path", "full")
    return pairs.agg(F.coalesce(F.min(F.coalesce(F.col("checksum") == F.col("now"), F.lit(False))), F.lit(False)).alias("resumable"))


IDENTITY = ("relative_path", "bytes", "mtime_ms", "ctime_ms", "device", "inode", "mode")


def reusable_fingerprints(files: DataFrame, cache: DataFrame, now, days: int = 30, strict: bool = False) -> DataFrame:
    """Files with ``cached_checksum``: that of the record of the same path, size, times and identity, verified at most ``days`` days ago.

    ``cache`` has one record of a path. A record from the future, or any in strict mode, isn't used; nulls match nothing.
    """
    if strict:
        return files.withColumn("cached_checksum", F.lit(None).cast("string"))
    keys = [c for c in IDENTITY if c in files.columns and c in cache.columns]
    end = F.lit(now).cast("timestamp_ntz")
    fresh = cache.where(F.col("verified_at").between(end - F.expr(f"interval {days} days"), end)).select(*keys, F.col("checksum").alias("cached_checksum"))
    return files.join(fresh, keys, "left")


def matched_prefixes(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, files): how many paths lie at or below each prefix; 0 for those that match nothing."""
    asked = files.sparkSession.createDataFrame([(p,) for p in normalized_prefixes(prefixes)], "prefix string")
    # every folder above a path is a key, so the prefixes meet equal ones only
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    found = files.select(F.explode(above).alias("prefix")).join(F.broadcast(asked), "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("files"))
    return asked.join(found, "prefix", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def freshness(current: dict) -> Column:
    """Why an index of a manifest isn't fresh against the ``current`` settings, the first rule that it breaks; null where it is.

    The manifest's columns are recovered, schema, embedding_provider, embedding_model, model_revision, model_digest,
    distance_metric, chunks, vector_dimension, index_dimension, index_model, coverage, unindexed, chunk_size,
    chunk_overlap and policy.
    """
    differs = lambda c: ~F.col(c).eqNullSafe(F.lit(current[c]))
    rule = lambda broken, name: F.when(broken, F.lit(name))
    indexed = F.col("index_dimension").isNotNull()
    return F.coalesce(
        rule(F.col("recovered"), "recovered manifest"), rule(differs("schema"), "schema"), rule(differs("embedding_provider"), "embedding provider"), rule(differs("embedding_model"), "embedding model"),
        rule(differs("model_revision"), "embedding revision"), rule(differs("model_digest"), "embedding artifact"), rule(F.col("distance_metric").isNotNull() & differs("distance_metric"), "distance metric"),
        rule((F.col("chunks") > 0) & ~indexed, "vector strategy missing"), rule(indexed & (~F.col("vector_dimension").eqNullSafe(F.col("index_dimension")) | differs("index_model")), "vector strategy incompatible"),
        rule(indexed & ((F.col("coverage") < 1) | (F.col("unindexed") > 0)), "vector coverage"), rule(differs("chunk_size") | differs("chunk_overlap"), "chunking"), rule(differs("policy"), "content policy"),
    )


def health(inventory_: DataFrame, missing_: DataFrame, stale_: DataFrame, empty: DataFrame, limit: int = 50) -> DataFrame:
    """One row: counts and bytes of the inventory (reason null: supported), and missing, stale and empty files with previews.

    A preview has the first ``limit`` paths in order and the number left out.
    """
    why = lambda r: F.count_if(F.col("reason") == r)
    ok = F.col("reason").isNull()
    out = inventory_.agg(
        F.count("*").alias("discovered"), F.count_if(ok).alias("supported"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("supported_bytes"), F.max(F.when(ok, F.col("bytes"))).alias("largest"),
        why("unsupported-extension").alias("unsupported"), why("oversized").alias("oversized"), why("sensitive-name").alias("sensitive"),
    )
    for name, df in (("missing", missing_), ("stale", stale_), ("empty", empty)):
        out = out.join(F.broadcast(preview(df, "relative_path", limit).toDF(name, f"{name}_shown", f"{name}_omitted")))
    return out


def snapshot_diff(local: DataFrame, peer: DataFrame) -> DataFrame:
    """(relative_path, status) of files in one corpus only or with another checksum."""
    a, b = local.select("relative_path", F.col("checksum").alias("x")), peer.select("relative_path", F.col("checksum").alias("y"))
    status = F.when(F.col("y").isNull(), "local_only").when(F.col("x").isNull(), "peer_only").otherwise("changed")
    return a.join(b, "relative_path", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("relative_path", status.alias("status"))


def setting_diff(local: DataFrame, peer: DataFrame, rebuild: tuple[str, ...] = ()) -> DataFrame:
    """(name, local, peer, requires_rebuild) of the settings that differ; one row and the same columns on both sides."""
    names = sorted(local.columns)
    stack = f"stack({len(names)}, " + ", ".join(f"'{n}', cast(`{n}` as string)" for n in names) + ") as (name, value)"
    a, b = local.selectExpr(stack).withColumnRenamed("value", "local"), peer.selectExpr(stack).withColumnRenamed("value", "peer")
    return a.join(b, "name").where(~F.col("local").eqNullSafe(F.col("peer"))).withColumn("requires_rebuild", F.col("name").isin(*rebuild) if rebuild else F.lit(False))


def commit_check(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(relative_path, checksum, expected, actual) of files whose chunks in the index aren't as many as the manifest says."""
    have = chunks.groupBy("relative_path", "checksum").agg(F.countDistinct("chunk_index").alias("actual"))
    both = manifest.select("relative_path", "checksum", F.col("chunk_count").cast("long").alias("expected")).join(have, ["relative_path", "checksum"], "left")
    return both.withColumn("actual", F.coalesce("actual", F.lit(0))).where(~F.col("expected").eqNullSafe(F.col("actual")))


def duplicate_ids(chunks: DataFrame, key: str = "id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def chunk_stats(df: DataFrame, text: str = "text", context: str = "context_path") -> DataFrame:
    """One row: count, shortest, mean, nearest-rank median and 95th percentile, longest, and how many have a context."""
    n = F.length(text)
    stats = df.where(F.col(text).isNotNull()).agg(
        F.count("*").alias("count"), F.min(n).alias("min_chars"), F.avg(n).alias("avg_chars"), F.expr(f"percentile_disc(0.5) within group (order by length({text}))").alias("p50_chars"),
        F.expr(f"percentile_disc(0.95) within group (order by length({text}))").alias("p95_chars"), F.max(n).alias("max_chars"), F.count_if(F.coalesce(F.col(context), F.lit("")) != "").alias("contextual"),
    )
    return stats.withColumn("contextual_ratio", F.when(F.col("count") > 0, F.col("contextual") / F.col("count")).otherwise(F.lit(0.0)))


#: Fixed value: what stands in front of the entries under a corpus's fingerprint.
FINGERPRINT_HEAD = "indexed-corpus-v1\0"


def corpus_fingerprint(files: DataFrame, head: str = FINGERPRINT_HEAD) -> DataFrame:
    """One row: files, chunks and a SHA-256 over the ordered paths and checksums, each with its length in bytes in front.

    Ranges of paths are sorted and their entries joined to blobs in parallel; the blobs then pass in order through one task
    that does nothing but the digest, as each step of it hangs on the one before. Rows without path or checksum don't count.
    """
    known = files.where("relative_path is not null and checksum is not null").select("relative_path", "checksum", F.coalesce(F.col("chunk_count").cast("long"), F.lit(0)).alias("n"))

    def blobs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            entries = [(p.encode(), c.encode()) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if entries:
                blob = b"".join(b"%d:%s%d:%s" % (len(p), p, len(c), c) for p, c in entries)
                first, last = (batch.column(0)[k].as_py() + "\0" + batch.column(1)[k].as_py() for k in (0, len(entries) - 1))
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([blob]), pa.array([len(entries)]), pa.array([sum(batch.column(2).to_pylist())])], ["first", "last", "blob", "files", "chunks"])

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, chunks = hashlib.sha256(head.encode()), 0, 0
        for batch in it:
            for blob in batch.column(2):
                state.update(blob.as_buffer())
            rows, chunks = rows + sum(batch.column(3).to_pylist()), chunks + sum(batch.column(4).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([chunks]), pa.array([state.hexdigest()])], ["files", "chunks", "fingerprint"])

    ranges = known.repartitionByRange("relative_path", "checksum").sortWithinPartitions("relative_path", "checksum")
    joined = ranges.mapInArrow(blobs, "first string, last string, blob binary, files long, chunks long")
    return joined.repartition(1).sortWithinPartitions("first", "last").mapInArrow(digest, "files long, chunks long, fingerprint string")


def duplicate_groups(files: DataFrame, limit: int = 20) -> DataFrame:
    """(checksum12, paths): the largest groups of paths with one checksum (its first 12 characters), by size and key.

    The groups are counted first; only those in the report bring their paths.
    """
    own = files.select(F.substring("checksum", 1, 12).alias("checksum12"), "relative_path").distinct()
    groups = own.groupBy("checksum12").agg(F.count("*").alias("files")).where("files > 1").orderBy(F.desc("files"), "checksum12").limit(limit)
    return own.join(F.broadcast(groups), "checksum12").groupBy("checksum12").agg(F.max("files").alias("files"), F.sort_array(F.collect_list("relative_path")).alias("paths"))


def counts_by(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("bytes").alias("largest"))


def archive_candidates(files: DataFrame, limit: int = 20) -> DataFrame:
    """The first paths in order that look like archives or mirrors."""
    return files.where(archive_like(F.col("relative_path"))).select("relative_path").distinct().orderBy("relative_path").limit(limit)


def preview(df: DataFrame, column: str, limit: int) -> DataFrame:
    """One row: the first ``limit`` values in order, how many there are and how many are left out."""
    total = df.agg(F.count("*").alias("total"))
    first = df.select(column).orderBy(column).limit(limit).agg(F.sort_array(F.collect_list(column)).alias("shown"))
    return total.join(F.broadcast(first)).withColumn("omitted", F.greatest(F.col("total") - limit, F.lit(0)))


def progress(entries: DataFrame) -> DataFrame:
    """Files by the last state of each, with their chunks."""
    last = latest(entries, ["relative_path"], [F.desc("updated_at"), F.desc("entry_id")])
    return last.groupBy("state").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def ocr_totals(parsed: DataFrame) -> DataFrame:
    """OCR metrics added up by kind of file; files without any count as 0."""
    o = lambda f: F.coalesce(F.sum(f"ocr.{f}"), F.lit(0)).alias(f)
    out = parsed.groupBy("extension").agg(F.count("ocr").alias("files"), o("pages"), o("cache_hits"), o("cache_misses"), o("batches"), o("subprocesses"), F.round(F.coalesce(F.sum("ocr.duration_ms"), F.lit(0.0)), 3).alias("duration_ms"))
    return out.where("files > 0")


def merge_chunks(old: DataFrame, new: DataFrame, replaced: DataFrame, order: str = "ingested_at") -> DataFrame:
    """An upsert by id: of replaced paths only the new rows stay, other paths are untouched; the latest row of an id wins."""
    kept = old.join(replaced.select("relative_path").distinct(), "relative_path", "left_anti")
    return latest(kept.unionByName(new), ["id"], [F.desc(order), F.desc("row_id")])


def delete_paths(old: DataFrame, paths: DataFrame) -> DataFrame:
    return old.join(paths.select("relative_path").distinct(), "relative_path", "left_anti")
