"""Files beside the corpus: access logs, golden queries, snapshots, the cache of recognised pages."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import queue
import threading
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.config import fingerprint, stable_json
from lodespark.errors import InputError

LINE = "timestamp string, action string, queryHash string, topK int, resultCount long, redactions long, kind string, tool string, retrievedBytes long, returnedBytes long, compacted boolean, truncated boolean"
MOST_GOLDEN_BYTES, MOST_CASES, MOST_SNAPSHOT_BYTES = 16 * 1024 * 1024, 1_000, 64 * 1024 * 1024
QUEUE, BATCH, TRIM_BYTES, TRIM_LINES = 1_024, 64, 10 * 1024 * 1024, 50_000


def access_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON log with ``valid``: malformed lines, and those without a time or an action, are not valid."""
    rows = spark.read.schema(LINE + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    at = F.try_to_timestamp("timestamp")
    return rows.withColumn("logged_at", at).withColumn("valid", F.col("_corrupt").isNull() & at.isNotNull() & (F.col("action").isNotNull() | F.col("tool").isNotNull()))


def parsed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """``access_lines`` of a column that holds the lines."""
    rows = lines.withColumn("_x", F.from_json(column, LINE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).select(*lines.columns, "_x.*")
    at = F.try_to_timestamp("timestamp")
    return rows.withColumn("logged_at", at).withColumn("valid", F.col("_corrupt").isNull() & at.isNotNull() & (F.col("action").isNotNull() | F.col("tool").isNotNull()))


def invalid_lines(lines: DataFrame) -> int:
    return lines.where("not valid").count()


def query_hash(query: str, salt: bytes) -> str:
    """HMAC-SHA256 of a query under the project's salt, so logs hold no query text."""
    return hmac.new(salt, query.encode(), hashlib.sha256).hexdigest()


def query_hashes(salt: bytes):
    """The hash as a column function."""

    @F.pandas_udf(T.StringType())
    def hashed(query: pd.Series) -> pd.Series:
        return query.map(lambda q: None if q is None else query_hash(q, salt))

    return hashed


class AccessLog:
    """Appends events in batches from a bounded queue; when it is full, events are dropped and counted."""

    def __init__(self, path: str, salt: bytes) -> None:
        self.path, self.salt, self.dropped = path, salt, 0
        self._queue: queue.Queue = queue.Queue(QUEUE)
        self._lock = threading.Lock()

    def record(self, action: str, query: str | None = None, **counts: int) -> bool:
        line = {"timestamp": datetime.now(UTC).isoformat(), "action": action} | counts | ({"queryHash": query_hash(query, self.salt)} if query else {})
        try:
            self._queue.put_nowait(line)
        except queue.Full:
            self.dropped += 1
            return False
        if self._queue.qsize() >= BATCH:
            self.flush()
        return True

    def flush(self) -> None:
        with self._lock:
            lines = []
            while not self._queue.empty():
                lines.append(stable_json(self._queue.get_nowait()))
            if lines:
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write("\n".join(lines) + "\n")
            self._trim()

    def _trim(self) -> None:
        if os.path.exists(self.path) and os.path.getsize(self.path) > TRIM_BYTES:
            with open(self.path, encoding="utf-8") as f:
                kept = f.readlines()[-TRIM_LINES:]
            with open(self.path + ".new", "w", encoding="utf-8") as f:
                f.writelines(kept)
            os.replace(self.path + ".new", self.path)


_JUDGMENT = "array<struct<kind:string, value:string, relevance:int>>"
GOLDEN = f"query_id long, id string, query string, answerable boolean, category string, locale string, expected_paths array<string>, expected_citations array<string>, relevance_judgments {_JUDGMENT}"


def golden_queries(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The cases of a golden file and its thresholds; a file too large, without cases or with a bad one is an error."""
    if os.path.getsize(path) > MOST_GOLDEN_BYTES:
        raise InputError("the golden file is too large")
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    data = {"queries": data} if isinstance(data, list) else data
    cases = data.get("queries", [])
    if not 0 < len(cases) <= MOST_CASES:
        raise InputError(f"a golden file has 1 to {MOST_CASES} cases")
    rows = []
    for k, c in enumerate(cases):
        judged = c.get("relevanceJudgments") or []
        if not str(c.get("query", "")).strip():
            raise InputError(f"case {k} has no query")
        if any(not 0 <= int(j.get("relevance", -1)) <= 3 for j in judged):
            raise InputError(f"case {k} has a relevance that isn't 0 to 3")
        answerable = c.get("answerable", True)
        if answerable and not (c.get("expectedPaths") or c.get("expectedCitations") or any(j["relevance"] > 0 for j in judged)):
            raise InputError(f"case {k} is answerable but expects nothing")
        kinds = [("path" if "path" in j else "citation", j.get("path") or j.get("citation") or j.get("value"), int(j["relevance"])) for j in judged]
        rows.append((k, c.get("id"), c["query"], answerable, c.get("category"), c.get("locale"), c.get("expectedPaths") or [], c.get("expectedCitations") or [], kinds))
    return spark.createDataFrame(rows, GOLDEN), data.get("thresholds", {})


def write_snapshot(path: str, label: str, configuration: dict, files: DataFrame) -> dict:
    """A corpus's settings and file list as one checked JSON file."""
    rows = [r.asDict() for r in files.select("relative_path", "checksum", F.col("chunk_count").cast("int")).orderBy("relative_path").collect()]
    body = {"label": label, "configuration": configuration, "files": rows}
    text = stable_json(body | {"digest": fingerprint(body)})
    if len(text.encode()) > MOST_SNAPSHOT_BYTES:
        raise InputError("the snapshot is too large")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return body


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(settings, files) of a snapshot whose digest holds."""
    if os.path.getsize(path) > MOST_SNAPSHOT_BYTES:
        raise InputError("the snapshot is too large")
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    if body.pop("digest", None) != fingerprint(body):
        raise InputError("the snapshot has been changed")
    files = spark.createDataFrame([(f["relative_path"], f["checksum"], f["chunk_count"]) for f in body["files"]], "relative_path string, checksum string, chunk_count int")
    return body["configuration"], files


def page_key(checksum: str, page: int, command: tuple[str, ...]) -> str:
    """Key of a recognised page in the cache."""
    return fingerprint({"checksum": checksum, "page": page, "command": list(command)})


def pages_to_read(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Blank pages that the cache doesn't have, by key."""
    return pages.where("coalesce(text, '') = ''").join(cache.select("key"), "key", "left_anti")


def filled_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with the cached text where they are blank."""
    have = cache.select("key", F.col("text").alias("_cached"))
    return pages.join(have, "key", "left").withColumn("text", F.when(F.coalesce("text", F.lit("")) == "", F.col("_cached")).otherwise(F.col("text"))).drop("_cached")
