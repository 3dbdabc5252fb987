"""Incremental ingestion as a stream: files arrive, each batch is merged into the store, the checkpoint remembers.

Each batch is a layer over the index, so its cost follows the batch. The merge is by path, so a batch that runs again after
a failure gives the same index.
"""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodespark.plans.engine import FILES, Engine
from lodespark.plans.generations import layers_of
from lodespark.sources import inventory, parsers

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, files_per_batch: int = 1_000) -> DataFrame:
    """New files below ``root`` as a stream, at most ``files_per_batch`` in a batch."""
    reader = spark.readStream.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", files_per_batch).load(root)


def _files(batch: DataFrame, root: str) -> DataFrame:
    path = F.regexp_replace("path", r"^file:(?://)?", "")
    rows = batch.select(F.substring(path, len(root.rstrip("/")) + 2, 1 << 30).alias("relative_path"), F.col("length").alias("bytes"), (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"), F.sha2("content", 256).alias("checksum"), "content")
    return rows.withColumn("source", F.substring_index("relative_path", "/", 1)).withColumn("extension", inventory.extension_of(F.col("relative_path")))


def merge_batch(engine: Engine, root: str, batch: DataFrame, batch_id: int) -> None:
    """Merge one batch: the paths in it are replaced, failed ones keep their last good chunks, others are untouched."""
    store = engine.store
    files = inventory.supported_files(_files(batch, root), most_bytes=engine.config.max_file_bytes)
    if not files.limit(1).count():
        return
    with store.writing():
        old = store.manifest()
        layers = layers_of(old) if old and old.get("policy") == engine.config.policy_fingerprint() else []
        known = store.layered("files", layers) if layers else None
        generation = store.new_generation()
        parsed = parsers.parsed(files, engine.config.extractors).withColumn("source", F.substring_index("relative_path", "/", 1))
        store.write(parsed, generation, "parsed")
        now = time.time()
        counts = engine.write_layer(generation, store.table("parsed", generation), None, known, layers, True, now)
        engine.activate_layer(generation, counts | {"batch": batch_id}, layers, now)


def ingest_available(engine: Engine, root: str, checkpoint: str, files_per_batch: int = 1_000) -> StreamingQuery:
    """Ingest all files that are there and not yet in the checkpoint, then end."""
    stream = file_stream(engine.spark, root, files_per_batch)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(functools.partial(merge_batch, engine, root)).start()


def windowed_usage(events: DataFrame, at: str = "ts", by: str = "event_type", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by event-time window with a watermark; works on a stream and on a table. Not in the reference."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "events")


__all__ = ["FILES", "file_stream", "ingest_available", "merge_batch", "windowed_usage"]
