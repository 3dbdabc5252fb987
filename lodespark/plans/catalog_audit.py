"""Catalogue: inventory, audit, manifests, usage and maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodespark.operators import audit, maintenance, usage
from lodespark.sources import inventory
from lodespark.session import table

UNTIL, DAYS = "2025-01-10 00:00:00", 10

#: The last parse of each path that has no error.
CURRENT = """current_files AS (
  SELECT relative_path, source, extension, checksum, bytes, mtime_ms, ocr, redactions FROM (
    SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY parsed_at DESC, checksum, bytes, redactions) AS n FROM parsed_files) WHERE n = 1 AND error IS NULL)"""
LAST_STATE = """last_state AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY updated_at DESC, entry_id DESC) AS n FROM ingest_files) WHERE n = 1)"""


def current(s, d):
    rows = audit.latest(table(s, d, "parsed_files"), ["relative_path"], [F.desc("parsed_at"), "checksum", "bytes", "redactions"])
    return rows.where("error is null")


def indexed(s, d):
    return table(s, d, "chunks").select("relative_path", "checksum", "chunk_index")


def inventory_classes(s, d):
    files = current(s, d).select("relative_path", "extension", "bytes")
    return inventory.classified(files, most_bytes=20_000).groupBy("reason").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def inventory_recommendations(s, d):
    files = current(s, d).select("relative_path", "extension", "bytes")
    return inventory.classified(files, most_bytes=20_000).where("reason is not null").select("relative_path", "reason", "recommendation")


def inventory_summary(s, d):
    return audit.counts_by(current(s, d), F.coalesce("source", F.lit("(none)")), "source")


def unsupported_extensions(s, d):
    files = inventory.classified(current(s, d).select("relative_path", "extension", "bytes"))
    return files.where("reason = 'unsupported-extension'").groupBy("extension").agg(F.count("*").alias("files"))


def sensitive_names(s, d):
    return current(s, d).select("relative_path").where(inventory.is_sensitive(F.col("relative_path")))


def manifest_missing(s, d):
    empty = audit.latest(table(s, d, "ingest_files"), ["relative_path"], [F.desc("updated_at"), F.desc("entry_id")]).where("chunk_count = 0")
    return audit.missing(current(s, d), indexed(s, d), empty)


def manifest_stale(s, d):
    return audit.stale(indexed(s, d), table(s, d, "manifest_files"))


def manifest_reusable(s, d):
    return audit.reusable(current(s, d), table(s, d, "manifest_files")).select("relative_path", "checksum")


def manifest_removed(s, d):
    return audit.removed(table(s, d, "manifest_files"), current(s, d))


def snapshot_diff(s, d):
    return audit.snapshot_diff(table(s, d, "manifest_files"), current(s, d))


def commit_check(s, d):
    return audit.commit_check(table(s, d, "chunks"), table(s, d, "manifest_files"))


def resume_check(s, d):
    return audit.can_resume(table(s, d, "manifest_files"), current(s, d))


def duplicate_chunk_ids(s, d):
    return audit.duplicate_ids(table(s, d, "chunks"))


def chunk_stats(s, d):
    return audit.chunk_stats(table(s, d, "chunks")).withColumn("avg_chars", F.round("avg_chars", 9)).withColumn("contextual_ratio", F.round("contextual_ratio", 9))


def corpus_fingerprint(s, d):
    return audit.corpus_fingerprint(table(s, d, "manifest_files"))


def duplicate_groups(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.sha2("text", 256).alias("checksum"))
    return audit.duplicate_groups(docs)


def archive_candidates(s, d):
    return audit.archive_candidates(table(s, d, "manifest_files"))


def audit_preview(s, d):
    return audit.preview(manifest_stale(s, d), "relative_path", 50)


def ingest_progress(s, d):
    return audit.progress(table(s, d, "ingest_files"))


def last_known_good(s, d):
    last = audit.latest(table(s, d, "ingest_files"), ["relative_path"], [F.desc("updated_at"), F.desc("entry_id")])
    good = F.col("state") == "error"
    return last.select(
        "relative_path", "state", F.when(good, F.col("last_good_checksum")).otherwise(F.col("checksum")).alias("served_checksum"), F.when(good, F.col("last_good_chunk_count")).otherwise(F.col("chunk_count")).alias("served_chunks")
    )


def ocr_totals(s, d):
    return audit.ocr_totals(current(s, d))


def _deliveries(s, d):
    """(old, new, replaced): the table before its later deliveries, these, and the paths they replace: those of every tenth file."""
    order = Window.partitionBy("id").orderBy("ingested_at", "row_id")
    rows = table(s, d, "chunks").withColumn("_n", F.row_number().over(order))
    replaced = table(s, d, "manifest_files").where(F.conv(F.substring("checksum", 1, 2), 16, 10).cast("int") % 10 == 0).select("relative_path")
    changed = rows.join(replaced, "relative_path", "left_semi").where("chunk_index % 2 = 0").withColumn("id", F.when(F.col("chunk_index") % 4 == 0, F.sha2("id", 256)).otherwise(F.col("id")))
    new = rows.where("_n > 1").unionByName(changed).drop("_n")
    return rows.where("_n = 1").drop("_n"), new, replaced


def merge_upsert(s, d):
    """A merge in which every branch runs: ids delivered again are updated, new ids inserted, and of replaced paths only new rows stay."""
    old, new, replaced = _deliveries(s, d)
    return audit.merge_chunks(old, new, replaced).select("row_id", "id", "relative_path", "chunk_index")


def delete_paths(s, d):
    gone = audit.removed(table(s, d, "manifest_files"), current(s, d))
    return audit.delete_paths(table(s, d, "manifest_files"), gone).select("relative_path", "checksum")


def manifest_page(s, d):
    return table(s, d, "manifest_files").orderBy("relative_path", "checksum").offset(20).limit(50).select("relative_path", "checksum", "chunk_count")


def source_catalog(s, d):
    return table(s, d, "chunks").groupBy("relative_path").agg(F.countDistinct("chunk_index").alias("chunks"), F.max("bytes").alias("bytes"), F.max("ingested_at").alias("last_ingested_at"))


def count_rows(s, d):
    return table(s, d, "chunks").agg(F.count("*").alias("rows"), F.countDistinct("relative_path").alias("files"))


def ingest_windows(s, d):
    files = table(s, d, "manifest_files").withColumn("lane", F.substring_index("relative_path", "/", 1))
    return maintenance.windows(files, 16, 200_000, 256, lane="lane").groupBy("lane", "window").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def estimated_chunks(s, d):
    return table(s, d, "manifest_files").select("relative_path", maintenance.estimated_chunks(F.coalesce("bytes", F.lit(0))).alias("estimated_chunks"))


def usage_report(s, d):
    log = usage.distinct_lines(table(s, d, "access_log"))
    return usage.report(log, UNTIL, DAYS).withColumn("avg_results", F.round("avg_results", 9))


def usage_by_action(s, d):
    log = usage.distinct_lines(table(s, d, "access_log"))
    return usage.by_action(log, UNTIL, DAYS).withColumn("avg_results", F.round("avg_results", 9))


def usage_rollup(s, d):
    log = table(s, d, "access_log")
    out = log.rollup(F.to_date("logged_at").alias("day"), "action_name").agg(F.count("*").alias("events"), F.grouping_id().alias("level"))
    return out.select(F.col("day").cast("string").alias("day"), "action_name", "events", F.col("level").cast("int").alias("level"))


def log_retention(s, d):
    return usage.retained(table(s, d, "access_log"), 500).select("log_id", "action_name")


def events_sessions(s, d):
    return usage.sessions(table(s, d, "events"), "user_id", "ts").select("user_id", F.col("session").cast("int").alias("session"), "started", "ended", "events")


def events_hourly(s, d):
    hours = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return hours.agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def latency_percentiles(s, d):
    from lodespark.operators.evaluate import latency

    return latency(table(s, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 9))


def _generations(s, d):
    files = table(s, d, "ingest_files").groupBy(F.col("run_id").alias("table_name")).agg(F.max("updated_at").alias("last_modified"))
    first = F.substring("table_name", 1, 1)
    return files.select("table_name", "last_modified", F.when(first == "a", "resumable").alias("role"), (first == "0").alias("leased"))


def generation_retention(s, d):
    return maintenance.retention(_generations(s, d), "2024-12-31 00:00:00").select("table_name", "state", "keep")


def maintenance_plan(s, d):
    small = F.col("bytes") < 1500
    per = table(s, d, "chunks").groupBy("source").agg((F.count("*") * 200).alias("rows"), F.countDistinct("relative_path").alias("fragments"), F.countDistinct(F.when(small, F.col("relative_path"))).alias("small"))
    return per.select("source", maintenance.needs_compaction(F.col("rows"), F.lit(0), F.col("fragments"), F.col("small")).alias("compact"))


def index_policy(s, d):
    from lodespark.config import vector_index_policy

    n = [10, 99_999, 100_000, 250_000, 1_000_000]
    rows = [(k, *(vector_index_policy(k, 384).get(x, 0) for x in ("strategy", "num_partitions", "num_sub_vectors", "nprobes", "refine_factor"))) for k in n]
    return s.createDataFrame(rows, "rows long, strategy string, num_partitions int, num_sub_vectors int, nprobes int, refine_factor int")


def candidate_limits(s, d):
    from lodespark.config import lexical_candidate_limit, vector_candidate_limit

    rows = [(p, k, vector_candidate_limit(k, p), lexical_candidate_limit(k, p)) for p in ("fast", "balanced", "quality") for k in (1, 8, 20, 100)]
    return s.createDataFrame(rows, "profile string, top_k int, vector_limit int, lexical_limit int")


_EXTS = ", ".join(f"'{e}'" for e in inventory.SUPPORTED)
_SENSITIVE = f"""(regexp_extract(lower(relative_path), '[^/]*$') IN ({", ".join(f"'{n}'" for n in inventory.SENSITIVE_NAMES)})
  OR regexp_matches(regexp_extract(lower(relative_path), '[^/]*$'), '^\\.env(\\..*)?$')
  OR regexp_matches(lower(relative_path), '\\.({"|".join(e[1:] for e in inventory.SENSITIVE_ENDINGS)})$'))"""
_CLASS = f"""CASE WHEN {_SENSITIVE} THEN 'sensitive-name' WHEN lower(coalesce(extension, '')) NOT IN ({_EXTS}) THEN 'unsupported-extension' WHEN bytes > 20000 THEN 'oversized' END"""

SQL = {
    "inventory_classes": f"WITH {CURRENT} SELECT {_CLASS} AS reason, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM current_files GROUP BY 1",
    "inventory_summary": f"WITH {CURRENT} SELECT coalesce(source, '(none)') AS source, count(*) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, max(bytes) AS largest FROM current_files GROUP BY 1",
    "unsupported_extensions": f"WITH {CURRENT} SELECT CASE WHEN coalesce(extension, '') = '' THEN '(none)' ELSE lower(extension) END AS extension, count(*) AS files FROM current_files WHERE NOT {_SENSITIVE} AND lower(coalesce(extension, '')) NOT IN ({_EXTS}) GROUP BY 1",
    "sensitive_names": f"WITH {CURRENT} SELECT relative_path FROM current_files WHERE {_SENSITIVE}",
    "manifest_missing": f"""WITH {CURRENT}, {LAST_STATE} SELECT DISTINCT relative_path FROM current_files WHERE relative_path NOT IN (SELECT relative_path FROM chunks)
  AND relative_path NOT IN (SELECT relative_path FROM last_state WHERE chunk_count = 0)""",
    "manifest_stale": """SELECT c.relative_path, CASE WHEN bool_or(m.checksum IS NOT NULL) THEN 'changed' ELSE 'removed' END AS reason
  FROM (SELECT DISTINCT relative_path, checksum FROM chunks) c LEFT JOIN manifest_files m USING (relative_path) GROUP BY 1 HAVING NOT bool_or(coalesce(m.checksum = c.checksum, false))""",
    "manifest_reusable": f"WITH {CURRENT} SELECT c.relative_path, c.checksum FROM current_files c WHERE EXISTS (SELECT 1 FROM manifest_files m WHERE m.relative_path = c.relative_path AND m.checksum = c.checksum)",
    "manifest_removed": f"WITH {CURRENT} SELECT DISTINCT relative_path FROM manifest_files WHERE relative_path NOT IN (SELECT relative_path FROM current_files)",
    "snapshot_diff": f"""WITH {CURRENT} SELECT relative_path, CASE WHEN c.checksum IS NULL THEN 'local_only' WHEN m.checksum IS NULL THEN 'peer_only' ELSE 'changed' END AS status
  FROM manifest_files m FULL JOIN current_files c USING (relative_path) WHERE m.checksum IS DISTINCT FROM c.checksum""",
    "commit_check": """SELECT m.relative_path, m.checksum, CAST(m.chunk_count AS BIGINT) AS expected, coalesce(c.n, 0) AS actual FROM manifest_files m
  LEFT JOIN (SELECT relative_path, checksum, count(DISTINCT chunk_index) AS n FROM chunks GROUP BY 1, 2) c USING (relative_path, checksum) WHERE m.chunk_count IS DISTINCT FROM coalesce(c.n, 0)""",
    "resume_check": f"WITH {CURRENT} SELECT bool_and(coalesce(m.checksum = c.checksum, false)) AS resumable FROM manifest_files m FULL JOIN current_files c USING (relative_path)",
    "duplicate_chunk_ids": "SELECT id, count(*) AS rows FROM chunks GROUP BY id HAVING count(*) > 1",
    "chunk_stats": """SELECT count(*) AS count, CAST(min(length(text)) AS INT) AS min_chars, round(avg(length(text)), 9) AS avg_chars, CAST(quantile_disc(length(text), 0.5) AS INT) AS p50_chars,
  CAST(quantile_disc(length(text), 0.95) AS INT) AS p95_chars, CAST(max(length(text)) AS INT) AS max_chars, count(*) FILTER (coalesce(context_path, '') <> '') AS contextual,
  round(count(*) FILTER (coalesce(context_path, '') <> '') / count(*), 9) AS contextual_ratio FROM chunks WHERE text IS NOT NULL""",
    "corpus_fingerprint": """SELECT count(*) AS files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, sha256('indexed-corpus-v1' || chr(0) || string_agg(strlen(relative_path) || ':' || relative_path || strlen(checksum) || ':' || checksum, '' ORDER BY relative_path, checksum)) AS fingerprint FROM manifest_files WHERE checksum IS NOT NULL""",
    "duplicate_groups": "SELECT substr(sha256(text), 1, 12) AS checksum12, count(*) AS files, list_sort(list(CAST(doc_id AS VARCHAR))) AS paths FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY files DESC, checksum12 LIMIT 20",
    "archive_candidates": r"SELECT DISTINCT relative_path FROM manifest_files WHERE regexp_matches(relative_path, '(?i)(?:^|[/_.\-])(?:archive[sd]?|backup|bak|copy|old|final|mirror)(?:[/_.\-]|\d|$)') ORDER BY relative_path LIMIT 20",
    "ingest_progress": f"WITH {LAST_STATE} SELECT state, count(*) AS files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM last_state GROUP BY state",
    "last_known_good": f"WITH {LAST_STATE} SELECT relative_path, state, CASE WHEN state = 'error' THEN last_good_checksum ELSE checksum END AS served_checksum, CASE WHEN state = 'error' THEN last_good_chunk_count ELSE chunk_count END AS served_chunks FROM last_state",
    "ocr_totals": f"""WITH {CURRENT} SELECT extension, count(ocr) AS files, CAST(coalesce(sum(ocr.pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(ocr.cache_hits), 0) AS BIGINT) AS cache_hits, CAST(coalesce(sum(ocr.cache_misses), 0) AS BIGINT) AS cache_misses,
  CAST(coalesce(sum(ocr.batches), 0) AS BIGINT) AS batches, CAST(coalesce(sum(ocr.subprocesses), 0) AS BIGINT) AS subprocesses, round(coalesce(sum(ocr.duration_ms), 0), 3) AS duration_ms FROM current_files GROUP BY 1 HAVING count(ocr) > 0""",
    "merge_upsert": """WITH r AS (SELECT row_id, id, relative_path, chunk_index, ingested_at, row_number() OVER (PARTITION BY id ORDER BY ingested_at, row_id) AS n FROM chunks), p AS (SELECT relative_path FROM manifest_files WHERE ('0x' || substr(checksum, 1, 2))::INT % 10 = 0),
  m AS (SELECT * FROM r WHERE n = 1 AND relative_path NOT IN (FROM p) UNION ALL SELECT * FROM r WHERE n > 1 UNION ALL SELECT row_id, CASE WHEN chunk_index % 4 = 0 THEN sha256(id) ELSE id END, relative_path, chunk_index, ingested_at, n FROM r WHERE relative_path IN (FROM p) AND chunk_index % 2 = 0)
  SELECT row_id, id, relative_path, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, row_id DESC) AS k FROM m) WHERE k = 1""",
    "delete_paths": f"WITH {CURRENT} SELECT relative_path, checksum FROM manifest_files WHERE relative_path IN (SELECT relative_path FROM current_files)",
    "manifest_page": "SELECT relative_path, checksum, chunk_count FROM manifest_files ORDER BY relative_path, checksum LIMIT 50 OFFSET 20",
    "source_catalog": "SELECT relative_path, count(DISTINCT chunk_index) AS chunks, max(bytes) AS bytes, max(ingested_at) AS last_ingested_at FROM chunks GROUP BY 1",
    "count_rows": "SELECT count(*) AS rows, count(DISTINCT relative_path) AS files FROM chunks",
    "estimated_chunks": "SELECT relative_path, CAST(greatest(1, ceil(coalesce(bytes, 0) / 1000.0)) AS BIGINT) AS estimated_chunks FROM manifest_files",
    "usage_report": f"""WITH log AS (SELECT min(log_id) AS log_id, logged_at, action_name, query_hash, top_k, result_count, redactions FROM access_log GROUP BY ALL)
  SELECT count(*) AS events, count(DISTINCT query_hash) AS query_hashes, round(avg(result_count), 9) AS avg_results, CAST(coalesce(sum(redactions), 0) AS BIGINT) AS redactions, max(logged_at) AS last_event_at
  FROM log WHERE logged_at BETWEEN TIMESTAMP '{UNTIL}' - INTERVAL {DAYS} DAY AND TIMESTAMP '{UNTIL}'""",
    "usage_by_action": f"""WITH log AS (SELECT min(log_id) AS log_id, logged_at, action_name, query_hash, top_k, result_count, redactions FROM access_log GROUP BY ALL)
  SELECT action_name, count(*) AS events, count(DISTINCT query_hash) AS query_hashes, round(avg(result_count), 9) AS avg_results
  FROM log WHERE logged_at BETWEEN TIMESTAMP '{UNTIL}' - INTERVAL {DAYS} DAY AND TIMESTAMP '{UNTIL}' GROUP BY 1""",
    "usage_rollup": "SELECT CAST(day AS VARCHAR) AS day, action_name, count(*) AS events, CAST(grouping(day, action_name) AS INT) AS level FROM (SELECT CAST(logged_at AS DATE) AS day, action_name FROM access_log) GROUP BY ROLLUP (day, action_name)",
    "log_retention": "SELECT log_id, action_name FROM access_log ORDER BY log_id DESC LIMIT 500",
    "events_sessions": """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
  SELECT user_id, CAST(session AS INT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY 1, 2""",
    "events_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "latency_percentiles": """SELECT event_type, count(value) AS count, min(value) AS least, round(avg(value), 9) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS greatest
  FROM events GROUP BY 1""",
    "generation_retention": """WITH g AS (SELECT run_id AS table_name, max(updated_at) AS last_modified FROM ingest_files GROUP BY 1),
  h AS (SELECT *, substr(table_name, 1, 1) = 'a' AS resumable, substr(table_name, 1, 1) = '0' AS leased, last_modified > TIMESTAMP '2024-12-31' - INTERVAL 5 MINUTE AS grace, last_modified >= TIMESTAMP '2024-12-31' - INTERVAL 7 DAY AS young FROM g),
  i AS (SELECT *, greatest(3 - (SELECT count(*) FROM h WHERE resumable OR leased), 0) AS slots, NOT resumable AND NOT leased AND NOT grace AND young AS free FROM h),
  j AS (SELECT *, sum(CAST(free AS INT)) OVER (ORDER BY last_modified DESC, table_name ROWS UNBOUNDED PRECEDING) AS n FROM i),
  k AS (SELECT table_name, CASE WHEN resumable THEN 'resumable' WHEN leased THEN 'leased' WHEN grace THEN 'grace' WHEN free AND n <= slots THEN 'retained' WHEN NOT young THEN 'expired' ELSE 'surplus' END AS state FROM j)
  SELECT table_name, state, state NOT IN ('expired', 'surplus') AS keep FROM k""",
    "maintenance_plan": """SELECT source, count(*) * 200 >= 100000 AND count(DISTINCT relative_path) >= 8 AND count(DISTINCT CASE WHEN bytes < 1500 THEN relative_path END) / count(DISTINCT relative_path) >= 0.25 AS compact FROM chunks GROUP BY 1""",
    "index_policy": """SELECT CAST(n AS BIGINT) AS rows, CASE WHEN n < 100000 THEN 'exact' ELSE 'ivf-pq' END AS strategy, CASE WHEN n >= 100000 THEN CAST(greatest(16, round(sqrt(n))) AS INT) ELSE 0 END AS num_partitions, CASE WHEN n >= 100000 THEN 24 ELSE 0 END AS num_sub_vectors,
  CASE WHEN n >= 1000000 THEN CAST(round(sqrt(n)) AS INT) WHEN n >= 100000 THEN 32 ELSE 0 END AS nprobes, CASE WHEN n >= 1000000 THEN 100 WHEN n >= 100000 THEN 10 ELSE 0 END AS refine_factor FROM (VALUES (10), (99999), (100000), (250000), (1000000)) t(n)""",
    "candidate_limits": """SELECT p AS profile, CAST(k AS INT) AS top_k, CAST(least(1000, greatest(vmin, k * vmul)) AS INT) AS vector_limit, CAST(least(4000, greatest(lmin, k * lmul)) AS INT) AS lexical_limit
  FROM (VALUES ('fast', 40, 3, 100, 10), ('balanced', 80, 4, 250, 20), ('quality', 200, 8, 500, 40)) t(p, vmin, vmul, lmin, lmul), (VALUES (1), (8), (20), (100)) u(k)""",
}

QUERIES = {f.__name__: f for f in (
    inventory_classes, inventory_recommendations, inventory_summary, unsupported_extensions, sensitive_names, manifest_missing, manifest_stale, manifest_reusable, manifest_removed, snapshot_diff, commit_check,
    resume_check, duplicate_chunk_ids, chunk_stats, corpus_fingerprint, duplicate_groups, archive_candidates, audit_preview, ingest_progress, last_known_good, ocr_totals, merge_upsert, delete_paths, manifest_page,
    source_catalog, count_rows, ingest_windows, estimated_chunks, usage_report, usage_by_action, usage_rollup, log_retention, events_sessions, events_hourly, latency_percentiles, generation_retention,
    maintenance_plan, index_policy, candidate_limits,
)}
SQL["inventory_recommendations"] = f"WITH {CURRENT} SELECT relative_path, reason, CASE reason WHEN 'sensitive-name' THEN '{inventory.ADVICE['sensitive-name']}' WHEN 'oversized' THEN '{inventory.ADVICE['oversized']}' ELSE {inventory.advice_sql('extension')} END AS recommendation FROM (SELECT *, {_CLASS} AS reason FROM current_files) WHERE reason IS NOT NULL"
SQL["audit_preview"] = f"WITH s AS ({SQL['manifest_stale']}) SELECT count(*) AS total, (SELECT list(relative_path ORDER BY relative_path) FROM (SELECT relative_path FROM s ORDER BY 1 LIMIT 50)) AS shown, greatest(count(*) - 50, 0) AS omitted FROM s"
