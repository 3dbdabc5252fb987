"""Catalogue: parts of ingestion, structure, retrieval and reports that other queries only use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import answers, citations, redaction, text
from lodespark.functions.embedding import hash_embedding as hash_vector
from lodespark.functions.embedding import prefixed
from lodespark.operators import audit, chunking, evaluate, hybrid, lexical, maintenance, research, usage, vectors
from lodespark.plans import catalog_audit, catalog_search
from lodespark.plans.catalog_audit import CURRENT, LAST_STATE, UNTIL, current
from lodespark.plans.catalog_search import _CHUNKS, _EMBED, _FOUND, _IDS, _chunks_asked, _found_chunks, _research_asked
from lodespark.plans.catalog_text import CITATION_SQL, _redact_sql, folded_sql, terms_sql, tokens_sql
from lodespark.session import spread, table
from lodespark.sources import inventory, logs

PATTERNS = ["# sources", "services/", "./legal", "!services/worker", "exports/*/*.jsonl", ""]


def supported_files(s, d):
    return inventory.supported_files(current(s, d).select("relative_path", "extension", "bytes"), most_bytes=20_000).select("relative_path", "extension")


def input_patterns(s, d):
    include, exclude = inventory.input_spec(PATTERNS)
    path = F.col("relative_path")
    return table(s, d, "manifest_files").where(inventory.matches(path, include) & ~inventory.matches(path, exclude)).select("relative_path")


def fingerprint_reuse(s, d):
    """Current files against the last journalled state of each as the cache."""
    last = audit.latest(table(s, d, "ingest_files"), ["relative_path"], [F.desc("updated_at"), F.desc("entry_id")])
    cache = last.select("relative_path", "bytes", "mtime_ms", "checksum", F.col("updated_at").alias("verified_at"))
    return audit.reusable_fingerprints(current(s, d).select("relative_path", "bytes", "mtime_ms"), cache, UNTIL, 30).select("relative_path", "cached_checksum")


def log_lines(s, d):
    """The access log as JSON lines, every fiftieth of them cut off, read again."""
    log = table(s, d, "access_log")
    line = F.to_json(F.struct(F.date_format("logged_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("action_name").alias("action"), F.col("query_hash").alias("queryHash"), F.col("result_count").alias("resultCount")))
    lines = log.select(F.when(F.col("log_id") % 50 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line"))
    return logs.parsed_lines(lines).groupBy(F.when(F.col("valid"), F.col("action")).alias("action")).agg(F.count("*").alias("lines"), F.count_if("valid").alias("valid"), F.sum(F.when(F.col("valid"), F.col("resultCount"))).alias("results"))


def code_budget(s, d):
    """Files in order within 300 files and 900,000 bytes; those that don't fit are passed over."""
    return research.within_budget(current(s, d).select("relative_path", "bytes"), 300, 900_000)


def preview_prefixes(s, d):
    return audit.matched_prefixes(table(s, d, "manifest_files"), ["services", "./legal/claims/", "no/such/folder", "exports"])


#: Settings that the manifests of ``index_freshness`` are held against.
SETTINGS = {
    "schema": 11, "embedding_provider": "local-hash", "embedding_model": "local-hash-384", "model_revision": None, "model_digest": "d0", "distance_metric": "l2", "index_model": "m0", "chunk_size": 1200, "chunk_overlap": 200,
    "policy": "p0",
}


def index_freshness(s, d):
    """Manifests made from the journal, each with something else that may be out of date, and the first rule each breaks."""
    k = F.col("entry_id")
    off = lambda n, a, b: F.when(k % n == 0, F.lit(a)).otherwise(F.lit(b))
    rows = table(s, d, "ingest_files").select(
        "entry_id", (k % 41 == 0).alias("recovered"), off(7, 10, 11).alias("schema"), off(11, "other", "local-hash").alias("embedding_provider"), off(13, "m", "local-hash-384").alias("embedding_model"),
        F.when(k % 17 == 0, "r1").alias("model_revision"), off(19, "d1", "d0").alias("model_digest"), F.when(k % 23 == 0, "cosine").when(k % 2 == 0, "l2").alias("distance_metric"), F.coalesce("chunk_count", F.lit(0)).alias("chunks"),
        F.lit(384).alias("vector_dimension"), F.when(k % 29 == 0, None).when(k % 31 == 0, 64).otherwise(384).alias("index_dimension"), off(37, "m1", "m0").alias("index_model"), off(3, 0.5, 1.0).alias("coverage"), off(43, 4, 0).alias("unindexed"),
        off(4, 1000, 1200).alias("chunk_size"), F.lit(200).alias("chunk_overlap"), off(5, "p1", "p0").alias("policy"),
    )
    return rows.select("entry_id", audit.freshness(SETTINGS).alias("warning"))


def research_compact(s, d):
    """The fused evidence as a compact report with snippets."""
    found = catalog_search.research_fusion(s, d)
    chunks = table(s, d, "chunks").withColumn("citation", citations.of_chunks()).groupBy("relative_path", "chunk_index").agg(F.min_by(F.struct("source", "context_path", "citation", "text"), "row_id").alias("c"))
    rows = found.join(chunks, ["relative_path", "chunk_index"]).select(*found.columns, "c.*")
    return research.compact_evidence(rows).select("research_id", "rank", "citation", "context_path", "snippet", "queries", "best_rank")


def index_maintenance(s, d):
    """Actions for every source as an index of its own, in states made from its counts."""
    per = table(s, d, "chunks").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    k = F.pmod(F.ascii("source") + F.col("n"), F.lit(6))
    rows = F.when(k < 3, F.col("n")).otherwise(F.col("n") * 1000)
    kind, path_kind = F.when(k % 3 == 1, "IVF_PQ").when(k % 3 == 2, "IVF_FLAT"), F.when(k != 0, "BTREE")
    behind = F.when(k == 4, 5).otherwise(0)
    actions = vectors.index_actions(F.when(rows < 100_000, "exact").otherwise("ivf-pq"), rows, (kind, rows, behind), (path_kind, rows, behind), k == 1)
    return per.select("source", F.array_join(actions, ",").alias("actions"))


def embedding_inputs(s, d):
    """What models of three families get for a document as a passage, and as a query."""
    docs = table(s, d, "documents")
    cols = [F.md5(prefixed(F.col("text"), m, q)).alias(f"{n}_{'query' if q else 'passage'}") for n, m in (("e5", "multilingual-e5-small"), ("mxbai", "mxbai-embed-large"), ("plain", "other")) for q in (True, False)]
    return docs.select("doc_id", *cols)


def identifier_relations(s, d):
    """Identifiers of the whole table related to one of every hundredth chunk."""
    chunks = spread(table(s, d, "chunks").select("row_id", "text"), "row_id")
    ids = chunks.select("row_id", F.explode(F.array_distinct(text.identifiers(F.col("text")))).alias("identifier"))
    return lexical.related_identifiers(ids, ids.where("row_id % 100 = 0"))


def chunk_regions(s, d):
    """The page that places each chunk: the first that ends after its start."""
    pages = table(s, d, "parsed_files").where("pages is not null and error is null").groupBy("relative_path").agg(F.min_by("pages", F.struct("parsed_at", "checksum")).alias("pages"))
    rows = table(s, d, "chunks").where("char_start is not null").select("row_id", "relative_path", "char_start")
    return rows.join(pages, "relative_path").select("row_id", chunking.first_region(F.col("pages"), F.col("char_start"))["page_number"].alias("page"))


def setting_changes(s, d):
    """Facts of the documents and of the chunks as two settings of one name list."""
    facts = lambda name, key: table(s, d, name).agg(F.count("*").alias("rows"), F.max(F.length("text")).alias("longest"), F.count_if(F.col(key).isNull()).alias("unnamed"), F.lit("l2").alias("metric"))
    return audit.setting_diff(facts("documents", "source"), facts("chunks", "source"), ("longest",))


def alias_search(s, d):
    """The five nearest contents of every hundredth document, with all documents that hold each."""
    docs = table(s, d, "documents").where("text is not null")
    rows = spread(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("key"), hash_vector(F.col("text")).alias("vector"), F.md5("text").alias("digest"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), hash_vector(F.col("text")).alias("vector"))
    return vectors.nearest_with_aliases(rows, asked, 5, digits=6).select("query_id", "canonical", F.col("key").alias("doc_id"), "distance", "rank")


def health_snapshot(s, d):
    files = inventory.classified(current(s, d).select("relative_path", "extension", "bytes"), most_bytes=20_000)
    empty = audit.latest(table(s, d, "ingest_files"), ["relative_path"], [F.desc("updated_at"), F.desc("entry_id")]).where("chunk_count = 0").select("relative_path")
    return audit.health(files, catalog_audit.manifest_missing(s, d), catalog_audit.manifest_stale(s, d), empty, 5)


def jsonl_groups(s, d):
    """Lines of chunks taken together while they fit 300 characters."""
    rows = spread(table(s, d, "chunks").where("length(text) > 0").select("row_id", "text"), "row_id")
    return rows.select("row_id", F.explode(chunking.region_spans(".jsonl", 300)(F.col("text"))).alias("r")).select("row_id", "r.char_start", "r.char_end", "r.context")


def heading_paths(s, d):
    """Sections of Markdown chunks and of documents with the path of their headings."""
    docs = table(s, d, "documents").where("text is not null").select((-F.col("doc_id")).alias("id"), "text")
    rows = table(s, d, "chunks").where("relative_path rlike '[.]mdx?$' and text is not null").select(F.col("row_id").alias("id"), "text").unionByName(docs)
    return rows.select("id", F.explode(chunking.region_spans(".md", 1200)(F.col("text"))).alias("r")).select("id", "r.char_start", "r.char_end", "r.context")


def fence_pairs(s, d):
    """Fenced blocks of all documents and chunks of Markdown."""
    rows = table(s, d, "documents").select("text").unionByName(table(s, d, "chunks").where("relative_path like '%.md%'").select("text")).where("text is not null")
    return rows.select(F.md5("text").alias("digest"), F.explode(chunking.fence_spans(F.col("text"))).alias("r")).select("digest", "r.char_start", "r.char_end").distinct()


def page_batches(s, d):
    """Pages of scanned files that aren't divisible by 5, in batches for recognition."""
    files = current(s, d).where("pages is not null").select("relative_path", F.filter(F.transform("pages", lambda p: p["page_number"]), lambda n: n % 5 != 0).alias("pages"))
    return files.select("relative_path", F.posexplode(maintenance.page_spans("pages")).alias("batch", "own")).select("relative_path", "batch", F.size("own").alias("pages"), F.array_min("own").alias("first"), F.array_max("own").alias("last"))


def rerank(s, d):
    """The found chunks in the order of a scorer that counts the query's words in the text."""

    def scorer(queries, texts):
        return [float(len(set(q.split()) & set(text.tokenize(t)))) for q, t in zip(queries, texts)]

    rows = _found_chunks(s, d).select("query_id", "row_id", "rank").join(_chunks_asked(s, d), "query_id").join(table(s, d, "chunks").select("row_id", "text"), "row_id")
    return hybrid.reranked(rows, scorer, 5).select("query_id", "row_id", "rerank_score", "rank")


def sheet_columns(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("n")).where("n > 0").distinct().select("n", maintenance.column_names("n").alias("name"))


def normalized_text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.normalize_for_match(F.col("text"))).alias("digest"))


def redaction_lines(s, d):
    """Redaction that says whether the lines of the source still hold."""
    rows = spread(table(s, d, "chunks").select("row_id", "text"), "row_id").select("row_id", redaction.redact_with_lines(F.col("text")).alias("r"))
    return rows.select("row_id", F.md5("r.text").alias("digest"), F.col("r.line_map_kept").alias("lines_hold"))


def citation_checks(s, d):
    """Answers made of chunks: how their citations fit three sources."""
    k = F.col("row_id")
    cited = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit(" [1] and ["), (k % 3 + 1).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit(" ["), (k % 7).cast("string"), F.lit("] [2]")))
    rows = table(s, d, "chunks").select("row_id", F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]]", ""), cited).alias("answer"))
    return rows.select("row_id", answers.citation_status(F.col("answer"), F.when(k % 11 == 0, 0).otherwise(3)).alias("status"))


def source_blocks(s, d):
    rows = _found_chunks(s, d).select("query_id", "row_id", "rank").join(table(s, d, "chunks").select("row_id", citations.of_chunks().alias("citation"), "text"), "row_id")
    return answers.source_blocks(rows, 3_000).select("query_id", "sources", F.md5("blocks").alias("digest"))


def query_hashes(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", logs.query_hashes(b"salt")(F.col("text")).alias("hash"))


def output_savings(s, d):
    """Bytes saved by tools, from log lines with sizes made of their counts."""
    log = table(s, d, "access_log").where("action_name is not null").select(
        F.col("action_name").alias("tool"), (F.col("result_count") * 1000).alias("retrieved_bytes"), (F.col("result_count") * 400 + 7).alias("returned_bytes"), (F.col("top_k") % 2 == 0).alias("compacted"), (F.col("result_count") > 5).alias("truncated")
    )
    return usage.output_savings(log).withColumn("reduction_ratio", F.round("reduction_ratio", 9))


def display_order(s, d):
    """Files in the order of storage and in that of a reader's language, page by page."""
    paths = table(s, d, "manifest_files").select("relative_path")
    shown = paths.orderBy(F.collate("relative_path", "UNICODE"), "relative_path").offset(10).limit(40).withColumn("list", F.lit("display"))
    return shown.unionByName(paths.orderBy("relative_path").offset(10).limit(40).withColumn("list", F.lit("storage")))


def preview_limits(s, d):
    from lodespark.plans.service import preview_limit

    return s.createDataFrame([(k, preview_limit(k)) for k in (1, 511, 512, 5_000, 65_536, 102_400, 10_000_000)], "most_bytes int, items int")


def upgrade_decisions(s, d):
    from lodespark.plans.service import upgrade_decision

    versions = [(a, b, c) for a in (1, 2) for b in (0, 3) for c in (0, 1)]
    rows = [(f"{i}", f"{j}", r, upgrade_decision(versions[i], versions[j], r)) for i in range(8) for j in range(8) for r in (False, True)]
    return s.createDataFrame(rows, "installed string, available string, schema_changed boolean, decision string")


def ocr_pages(s, d):
    """Blank pages of scanned files that the cache of recognised pages lacks, and what the others are filled with."""
    files = current(s, d).where("pages is not null").select("relative_path", "checksum", F.explode("pages").alias("p"))
    pages = files.select(F.sha2(F.concat_ws(":", "checksum", F.col("p.page_number").cast("string")), 256).alias("key"), "relative_path", F.col("p.page_number").alias("page"), F.when(F.col("p.page_number") % 3 == 0, "").otherwise(None).alias("text"))
    cache = pages.where("page % 2 = 0").select("key", F.concat(F.lit("page "), F.col("page").cast("string")).alias("text"))
    waiting = logs.pages_to_read(pages, cache).select("relative_path", "page", F.lit(None).cast("string").alias("text"))
    return waiting.unionByName(logs.filled_pages(pages, cache).where("coalesce(text, '') <> ''").select("relative_path", "page", "text"))


def chunk_plain(s, d):
    """Chunks of all documents read as plain text."""
    return chunking.chunked(table(s, d, "documents").select("doc_id", "text"), key="doc_id", extension=None).select("doc_id", "chunk_index", "char_start", "char_end", "line_start", "line_end")


def quality_proof(s, d):
    """Whether the evaluation may count as proof, and what it lacks."""
    return evaluate.verified(evaluate.cases(*catalog_search._judged(s, d)), {**evaluate.GATES, **evaluate.MAXIMUM_GATES}, catalog_audit.manifest_stale(s, d).count(), 1)


QUERIES = {f.__name__: f for f in (
    supported_files, input_patterns, fingerprint_reuse, log_lines, code_budget, preview_prefixes, index_freshness, research_compact, index_maintenance, embedding_inputs, identifier_relations, chunk_regions, setting_changes,
    alias_search, health_snapshot, jsonl_groups, heading_paths, fence_pairs, page_batches, rerank, sheet_columns, normalized_text, redaction_lines, citation_checks, source_blocks, query_hashes, output_savings, display_order,
    preview_limits, upgrade_decisions, ocr_pages, chunk_plain, quality_proof,
)}

_SUPPORTED = f"WITH {CURRENT} SELECT *, {catalog_audit._CLASS} AS reason FROM current_files"
_PAD = lambda x: "".join(f"{(b ^ x):02x}" for b in b"salt".ljust(64, b"\0"))
_LINE = "regexp_matches(line, '^ {0,3}(`{3,}|~{3,})')"


def _rfind(s: str, w: str = "w") -> str:
    """Position from 0 of the last place of a literal in a window, -1 without one."""
    n = len(s)
    lit = "||".join(f"chr({ord(c)})" for c in s)
    turned = "||".join(f"chr({ord(c)})" for c in reversed(s))
    return f"CASE WHEN contains({w}, {lit}) THEN length({w}) - strpos(reverse({w}), {turned}) + 1 - {n} ELSE -1 END"


_SENTENCE = "greatest(" + ", ".join(f"CASE WHEN contains(w, '{m}') THEN {_rfind(m)} + 1 ELSE -1 END" for m in (". ", "? ", "! ", "。", "？", "！")) + ")"

SQL = {
    "supported_files": f"SELECT relative_path, CASE WHEN coalesce(extension, '') = '' THEN '(none)' ELSE lower(extension) END AS extension FROM ({_SUPPORTED}) WHERE reason IS NULL",
    "input_patterns": "SELECT relative_path FROM manifest_files WHERE (starts_with(relative_path, 'services/') OR starts_with(relative_path, 'legal/') OR regexp_full_match(relative_path, 'exports/[^/]*/[^/]*\\.jsonl')) AND NOT starts_with(relative_path, 'services/worker/')",
    "fingerprint_reuse": f"""WITH {CURRENT}, {LAST_STATE} SELECT c.relative_path, l.checksum AS cached_checksum FROM current_files c LEFT JOIN last_state l ON l.relative_path = c.relative_path AND l.bytes = c.bytes AND l.mtime_ms = c.mtime_ms
  AND l.updated_at BETWEEN TIMESTAMP '{UNTIL}' - INTERVAL 30 DAY AND TIMESTAMP '{UNTIL}'""",
    "log_lines": """WITH l AS (SELECT *, log_id % 50 <> 0 AND action_name IS NOT NULL AS valid FROM access_log) SELECT CASE WHEN valid THEN action_name END AS action, count(*) AS lines, count(*) FILTER (valid) AS valid, CAST(sum(result_count) FILTER (valid) AS BIGINT) AS results FROM l GROUP BY 1""",
    "code_budget": f"""WITH RECURSIVE {CURRENT}, f AS (SELECT relative_path, bytes, row_number() OVER (ORDER BY relative_path) AS k FROM current_files WHERE bytes <= 900000),
  g AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS used, false AS kept UNION ALL SELECT f.k, n + CAST(n < 300 AND used + bytes <= 900000 AS INT), used + CASE WHEN n < 300 AND used + bytes <= 900000 THEN bytes ELSE 0 END, n < 300 AND used + bytes <= 900000 FROM g JOIN f ON f.k = g.k + 1)
  SELECT relative_path, bytes FROM g JOIN f USING (k) WHERE kept""",
    "preview_prefixes": "SELECT prefix, (SELECT count(*) FROM manifest_files WHERE relative_path = prefix OR starts_with(relative_path, prefix || '/')) AS files FROM (VALUES ('services'), ('legal/claims'), ('no/such/folder'), ('exports')) t(prefix)",
    "index_freshness": """SELECT entry_id, CASE WHEN entry_id % 41 = 0 THEN 'recovered manifest' WHEN entry_id % 7 = 0 THEN 'schema' WHEN entry_id % 11 = 0 THEN 'embedding provider' WHEN entry_id % 13 = 0 THEN 'embedding model' WHEN entry_id % 17 = 0 THEN 'embedding revision'
  WHEN entry_id % 19 = 0 THEN 'embedding artifact' WHEN entry_id % 23 = 0 THEN 'distance metric' WHEN entry_id % 29 = 0 THEN CASE WHEN coalesce(chunk_count, 0) > 0 THEN 'vector strategy missing' WHEN entry_id % 4 = 0 THEN 'chunking' WHEN entry_id % 5 = 0 THEN 'content policy' END
  WHEN entry_id % 31 = 0 OR entry_id % 37 = 0 THEN 'vector strategy incompatible' WHEN entry_id % 3 = 0 OR entry_id % 43 = 0 THEN 'vector coverage' WHEN entry_id % 4 = 0 THEN 'chunking' WHEN entry_id % 5 = 0 THEN 'content policy' END AS warning FROM ingest_files""",
    "research_compact": rf"""WITH f AS ({catalog_search.SQL['research_fusion']}), c AS (SELECT *, {CITATION_SQL} AS citation, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one, row_number() OVER (PARTITION BY relative_path, chunk_index ORDER BY row_id) AS n FROM chunks)
  SELECT research_id, rank, citation, context_path, CASE WHEN length(one) > 260 THEN rtrim(substr(one, 1, 257)) || '...' ELSE one END AS snippet, queries, best_rank FROM f JOIN c USING (relative_path, chunk_index) WHERE n = 1""",
    "index_maintenance": """WITH p AS (SELECT coalesce(source, 'none') AS source, count(*) AS n FROM chunks GROUP BY 1), k AS (SELECT source, (ascii(source) + n) % 6 AS k, n FROM p), r AS (SELECT *, CASE WHEN k < 3 THEN n ELSE n * 1000 END AS rows FROM k)
  SELECT source, concat_ws(',', CASE WHEN rows < 100000 THEN CASE WHEN k % 3 <> 0 THEN 'drop-vector-index' END WHEN k % 3 <> 1 THEN 'create-vector-index' WHEN k = 1 OR k = 4 THEN 'refresh-vector-index' END,
    CASE WHEN rows < 10000 THEN CASE WHEN k <> 0 THEN 'drop-relative-path-index' END WHEN k = 0 THEN 'create-relative-path-index' WHEN k = 4 THEN 'refresh-relative-path-index' END) AS actions FROM r""",
    "embedding_inputs": """SELECT doc_id, md5('query: ' || text) AS e5_query, md5('passage: ' || text) AS e5_passage, md5('Represent this sentence for searching relevant passages: ' || text) AS mxbai_query, md5(text) AS mxbai_passage, md5(text) AS plain_query, md5(text) AS plain_passage FROM documents""",
    "identifier_relations": f"""WITH i AS (SELECT DISTINCT row_id % 100 = 0 AS q, unnest({_IDS}) AS i FROM chunks), p AS (SELECT q, i, regexp_split_to_array(i, '[-_]') AS p FROM i), a AS (SELECT DISTINCT i, p FROM p WHERE q), b AS (SELECT DISTINCT i, p FROM p)
  SELECT a.i AS asked, b.i AS identifier FROM a JOIN b ON len(a.p) = len(b.p) AND len(list_filter(list_zip(a.p, b.p), lambda z: z[1] = z[2] OR (NOT (regexp_full_match(z[1], '\\d+') AND regexp_full_match(z[2], '\\d+')) AND length(z[1]) >= 7 AND length(z[2]) >= 7 AND levenshtein(z[1], z[2]) <= 1))) = len(a.p)""",
    "chunk_regions": """WITH p AS (SELECT relative_path, min_by(pages, {'a': parsed_at, 'b': checksum}) AS pages FROM parsed_files WHERE pages IS NOT NULL AND error IS NULL GROUP BY 1)
  SELECT row_id, coalesce(list_filter(pages, lambda p: p.char_end > char_start)[1].page_number, pages[1].page_number) AS page FROM chunks JOIN p USING (relative_path) WHERE char_start IS NOT NULL""",
    "setting_changes": """WITH l AS (SELECT count(*) AS r, max(length(text)) AS x, count(*) FILTER (source IS NULL) AS u FROM documents), p AS (SELECT count(*) AS r, max(length(text)) AS x, count(*) FILTER (source IS NULL) AS u FROM chunks)
  SELECT * FROM (SELECT unnest(['rows', 'longest', 'unnamed', 'metric']) AS name, unnest([l.r::VARCHAR, l.x::VARCHAR, l.u::VARCHAR, 'l2']) AS local, unnest([p.r::VARCHAR, p.x::VARCHAR, p.u::VARCHAR, 'l2']) AS peer, unnest([false, true, false, false]) AS requires_rebuild FROM l, p) WHERE local <> peer""",
    "alias_search": f"""WITH {_EMBED}, c AS (SELECT md5(text) AS h, min(doc_id) AS canonical FROM documents WHERE text IS NOT NULL GROUP BY 1), dot AS (SELECT q.doc_id AS query_id, d.doc_id AS key, sum(q.v * d.v) AS dot FROM emb q JOIN emb d USING (b) WHERE q.doc_id % 100 = 0 AND d.doc_id IN (SELECT canonical FROM c) GROUP BY ALL),
  near AS (SELECT q.doc_id AS query_id, d.doc_id AS canonical, round(sqrt(greatest(q.n2 + d.n2 - 2 * coalesce(dot, 0), 0)), 6) AS distance FROM size q JOIN size d ON q.doc_id % 100 = 0 AND d.doc_id IN (SELECT canonical FROM c) LEFT JOIN dot ON dot.query_id = q.doc_id AND dot.key = d.doc_id),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, canonical) AS rank FROM near) WHERE rank <= 5)
  SELECT query_id, canonical, doc_id, distance, CAST(rank AS INT) AS rank FROM top JOIN c USING (canonical) JOIN documents ON md5(text) = h""",
    "health_snapshot": f"""WITH i AS ({_SUPPORTED}), m AS ({catalog_audit.SQL['manifest_missing']}), st AS ({catalog_audit.SQL['manifest_stale']}), {LAST_STATE}, e AS (SELECT relative_path FROM last_state WHERE chunk_count = 0),
  t AS (SELECT count(*) AS discovered, count(*) FILTER (reason IS NULL) AS supported, CAST(coalesce(sum(bytes) FILTER (reason IS NULL), 0) AS BIGINT) AS supported_bytes, max(bytes) FILTER (reason IS NULL) AS largest, count(*) FILTER (reason = 'unsupported-extension') AS unsupported, count(*) FILTER (reason = 'oversized') AS oversized, count(*) FILTER (reason = 'sensitive-name') AS sensitive FROM i)
  SELECT *, (SELECT count(*) FROM m) AS missing, coalesce((SELECT list_sort(list(relative_path)) FROM m), [])[1:5] AS missing_shown, greatest((SELECT count(*) FROM m) - 5, 0) AS missing_omitted, (SELECT count(*) FROM st) AS stale, coalesce((SELECT list_sort(list(relative_path)) FROM st), [])[1:5] AS stale_shown, greatest((SELECT count(*) FROM st) - 5, 0) AS stale_omitted,
    (SELECT count(*) FROM e) AS empty, coalesce((SELECT list_sort(list(relative_path)) FROM e), [])[1:5] AS empty_shown, greatest((SELECT count(*) FROM e) - 5, 0) AS empty_omitted FROM t""",
    "jsonl_groups": """WITH RECURSIVE t AS (SELECT row_id, length(text) AS n, string_split(text, chr(10)) AS l FROM chunks WHERE length(text) > 0),
  l AS (SELECT row_id, n, unnest(l) AS line, generate_subscripts(l, 1) AS k, l AS every FROM t), p AS (SELECT row_id, line, k, list_sum(list_transform(every[1:k - 1], lambda x: length(x) + 1)) AS s0, n FROM l),
  q AS (SELECT row_id, coalesce(s0, 0) AS s, least(coalesce(s0, 0) + length(line) + 1, n) AS e, row_number() OVER (PARTITION BY row_id ORDER BY k) AS i FROM p WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
  g AS (SELECT row_id, i, s AS first, e, 0 AS nth FROM q WHERE i = 1 UNION ALL SELECT q.row_id, q.i, CASE WHEN q.e - first > 300 THEN q.s ELSE first END, q.e, CASE WHEN q.e - first > 300 THEN q.i - 1 ELSE g.nth END FROM g JOIN q ON q.row_id = g.row_id AND q.i = g.i + 1)
  SELECT row_id, CAST(first AS BIGINT) AS char_start, CAST(max(e) AS BIGINT) AS char_end, '$[' || nth || ']' AS context FROM g GROUP BY row_id, first, nth""",
    "page_batches": f"""WITH RECURSIVE {CURRENT}, x AS (SELECT relative_path, unnest(list_sort(list_distinct(list_filter(list_transform(pages, lambda p: p.page_number), lambda n: n % 5 <> 0)))) AS n FROM (SELECT * FROM parsed_files QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY parsed_at DESC, checksum, bytes, redactions) = 1) WHERE error IS NULL AND pages IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY n) AS k FROM x),
  g AS (SELECT relative_path, k, n, n AS first, 1 AS size, 0 AS batch FROM o WHERE k = 1 UNION ALL SELECT o.relative_path, o.k, o.n, CASE WHEN size < 16 AND o.n - first < 16 THEN first ELSE o.n END, CASE WHEN size < 16 AND o.n - first < 16 THEN size + 1 ELSE 1 END, batch + CASE WHEN size < 16 AND o.n - first < 16 THEN 0 ELSE 1 END FROM g JOIN o ON o.relative_path = g.relative_path AND o.k = g.k + 1)
  SELECT relative_path, CAST(batch AS INT) AS batch, CAST(count(*) AS INT) AS pages, min(n) AS first, max(n) AS last FROM g GROUP BY relative_path, batch""",
    "rerank": f"""WITH {_FOUND}, q AS (SELECT row_id AS query_id, {terms_sql('text')} AS terms FROM chunks WHERE row_id % 100 = 0 AND text IS NOT NULL), r AS (SELECT query_id, f.row_id, f.rank, CAST(len(list_intersect(list_distinct(terms), {tokens_sql('c.text')})) AS DOUBLE) AS rerank_score FROM found f JOIN q USING (query_id) JOIN chunks c ON c.row_id = f.row_id)
  SELECT query_id, row_id, rerank_score, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS n FROM r) WHERE n <= 5""",
    "sheet_columns": """SELECT n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INT)) || chr(CAST(65 + (n - 27) % 26 AS INT)) ELSE chr(CAST(65 + (n - 703) // 676 AS INT)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 703) % 26 AS INT)) END AS name FROM (SELECT DISTINCT l_partkey AS n FROM lineitem WHERE l_partkey > 0)""",
    "normalized_text": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE md5({folded_sql('text')}) END AS digest FROM documents",
    "citation_checks": """WITH a AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN [] WHEN row_id % 5 = 1 THEN list_distinct([1, row_id % 3 + 1]) ELSE list_distinct([row_id % 7, 2]) END AS c, CASE WHEN row_id % 11 = 0 THEN 0 ELSE 3 END AS n FROM chunks), g AS (SELECT *, len(list_filter(c, lambda x: x BETWEEN 1 AND n)) AS good FROM a)
  SELECT row_id, CASE WHEN n = 0 THEN 'none' WHEN len(c) = 0 THEN 'missing' WHEN good = len(c) THEN 'valid' WHEN good > 0 THEN 'partial' ELSE 'invalid' END AS status FROM g""",
    "source_blocks": f"""WITH {_FOUND}, b AS (SELECT query_id, rank, '<source n="' || rank || '" citation="' || replace(replace(replace(replace({CITATION_SQL}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || chr(10) || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || chr(10) || '</source>' AS block FROM found JOIN chunks USING (row_id)),
  u AS (SELECT *, sum(length(block) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b) SELECT query_id, CAST(count(*) AS INT) AS sources, md5(string_agg(block, chr(10) ORDER BY rank)) AS digest FROM u WHERE used <= 3001 GROUP BY 1""",
    "query_hashes": f"SELECT doc_id, sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(text)))) AS hash FROM documents WHERE text IS NOT NULL",
    "output_savings": """SELECT action_name AS tool, count(*) AS responses, CAST(sum(result_count * 1000) AS BIGINT) AS retrieved_bytes, CAST(sum(result_count * 400 + 7) AS BIGINT) AS returned_bytes, CAST(sum(result_count * 1000) - sum(result_count * 400 + 7) AS BIGINT) AS saved_bytes,
  CASE WHEN sum(result_count) > 0 THEN round(1 - sum(result_count * 400 + 7) / sum(result_count * 1000), 9) END AS reduction_ratio, count(*) FILTER (top_k % 2 = 0) AS compacted, count(*) FILTER (result_count > 5) AS truncated FROM access_log WHERE action_name IS NOT NULL GROUP BY 1""",
    "display_order": "SELECT * FROM (SELECT relative_path, 'display' AS list FROM manifest_files ORDER BY relative_path COLLATE en, relative_path LIMIT 40 OFFSET 10) UNION ALL SELECT * FROM (SELECT relative_path, 'storage' FROM manifest_files ORDER BY relative_path LIMIT 40 OFFSET 10)",
    "preview_limits": "SELECT CAST(b AS INT) AS most_bytes, CAST(greatest(1, least(200, b // 512)) AS INT) AS items FROM (VALUES (1), (511), (512), (5000), (65536), (102400), (10000000)) t(b)",
    "upgrade_decisions": """WITH v AS (SELECT i, i // 4 + 1 AS a, (i // 2) % 2 * 3 AS b, i % 2 AS c FROM range(8) t(i))
  SELECT CAST(x.i AS VARCHAR) AS installed, CAST(y.i AS VARCHAR) AS available, r AS schema_changed, CASE WHEN y.i <= x.i THEN 'none' WHEN r THEN 'rebuild' WHEN y.a > x.a THEN 'major' WHEN y.b > x.b THEN 'minor' ELSE 'patch' END AS decision FROM v x, v y, (VALUES (false), (true)) z(r)""",
    "ocr_pages": """WITH c AS (SELECT relative_path, unnest(pages).page_number AS page FROM (SELECT * FROM parsed_files QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY parsed_at DESC, checksum, bytes, redactions) = 1) WHERE error IS NULL AND pages IS NOT NULL) SELECT relative_path, page, CASE WHEN page % 2 = 0 THEN 'page ' || page END AS text FROM c""",
    "chunk_plain": rf"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
  c AS (SELECT doc_id, 0::BIGINT AS s, e FROM (SELECT doc_id, n, text, substr(text, 1, 1200) AS w FROM d), LATERAL (SELECT CASE WHEN n <= 1200 THEN n WHEN {_rfind(chr(10) * 2)} > 540 THEN {_rfind(chr(10) * 2)} WHEN {_SENTENCE} > 660 THEN {_SENTENCE} WHEN {_rfind(chr(10))} > 780 THEN {_rfind(chr(10))} WHEN {_rfind(' ')} > 900 THEN {_rfind(' ')} ELSE 1200 END AS e)
    UNION ALL SELECT doc_id, b, b + e FROM (SELECT c.doc_id, greatest(c.e - 200, c.s + 1) AS b, n, substr(text, CAST(greatest(c.e - 200, c.s + 1) + 1 AS BIGINT), 1200) AS w FROM c JOIN d USING (doc_id) WHERE c.e < n),
      LATERAL (SELECT CASE WHEN n - b <= 1200 THEN n - b WHEN {_rfind(chr(10) * 2)} > 540 THEN {_rfind(chr(10) * 2)} WHEN {_SENTENCE} > 660 THEN {_SENTENCE} WHEN {_rfind(chr(10))} > 780 THEN {_rfind(chr(10))} WHEN {_rfind(' ')} > 900 THEN {_rfind(' ')} ELSE 1200 END AS e)),
  t AS (SELECT doc_id, text, s, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS p FROM c JOIN d USING (doc_id)), u AS (SELECT doc_id, text, s + length(regexp_extract(p, '^[\s\p{{Z}}]*')) AS a, s + length(p) - length(regexp_extract(p, '[\s\p{{Z}}]*$')) AS b FROM t WHERE regexp_matches(p, '[^\s\p{{Z}}]'))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INT) AS chunk_index, CAST(a AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end, CAST(1 + a - length(replace(substr(text, 1, CAST(a AS BIGINT)), chr(10), '')) AS INT) AS line_start,
    CAST(b - length(replace(substr(text, 1, CAST(b - 1 AS BIGINT)), chr(10), '')) AS INT) AS line_end FROM u""",
    "quality_proof": f"WITH {catalog_search._EVAL}, st AS ({catalog_audit.SQL['manifest_stale']}), g AS (SELECT list_filter([CASE WHEN count(*) < 100 THEN 'too few cases' END, CASE WHEN count(*) FILTER (answerable) = 0 THEN 'no answerable cases' END, CASE WHEN count(*) FILTER (NOT answerable) = 0 THEN 'no unanswerable cases' END, CASE WHEN count(citation_hit) = 0 THEN 'no citation cases' END, CASE WHEN (SELECT count(*) FROM st) > 0 THEN 'files are stale' END], lambda x: x IS NOT NULL) AS gaps FROM cases) SELECT len(gaps) = 0 AS verified, gaps FROM g",
}


def _lines_sql() -> str:
    """The redacted text and whether a match had a line end, pattern by pattern."""
    steps, before = [], "SELECT row_id, text AS x, true AS kept FROM chunks"
    for k, (name, pattern, fold) in enumerate(redaction.PATTERNS[:-1]):
        p = ("(?i)" if fold else "") + pattern.replace("'", "''")
        steps.append(f"r{k} AS (SELECT row_id, regexp_replace(x, '{p}', '{redaction.placeholder(name)}', 'g') AS x, kept AND len(list_filter(regexp_extract_all(coalesce(x, ''), '{p}'), lambda m: contains(m, chr(10)))) = 0 AS kept FROM ({before}))")
        before = f"SELECT * FROM r{k}"
    return "WITH " + ", ".join(steps), f"r{len(steps) - 1}"


def _card_lines() -> str:
    from lodespark.plans.catalog_text import _CARD, _LUHN

    steps, last = _lines_sql()
    return f"{steps} SELECT row_id, md5(array_to_string(list_transform(string_split(regexp_replace(x, '{_CARD}', chr(1) || '\\0' || chr(1), 'g'), chr(1)), lambda m, k: CASE WHEN k % 2 = 0 AND {_LUHN} THEN '[REDACTED_CREDIT_CARD]' ELSE m END), '')) AS digest, kept AS lines_hold FROM {last}"


SQL["redaction_lines"] = _card_lines()
_PAIRS = f"""WITH RECURSIVE x AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL UNION SELECT text FROM chunks WHERE relative_path LIKE '%.md%' AND text IS NOT NULL), t AS (SELECT md5(text) AS digest, text, length(text) AS n, string_split(text, chr(10)) AS l FROM x WHERE contains(text, '```') OR contains(text, '~~~')),
  p AS (SELECT digest, n, line, k, coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x) + 1)), 0) AS s FROM (SELECT digest, n, l, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM t)),
  m AS (SELECT digest, n, s, least(s + length(line) + 1, n) AS e, substr(ltrim(line), 1, 1) AS mark, row_number() OVER (PARTITION BY digest ORDER BY k) AS i FROM p WHERE {_LINE}),
  g AS (SELECT digest, i, mark AS open, s AS since, NULL::BIGINT AS a, NULL::BIGINT AS b FROM m WHERE i = 1 UNION ALL SELECT m.digest, m.i, CASE WHEN open IS NULL THEN mark WHEN open = mark THEN NULL ELSE open END, CASE WHEN open IS NULL THEN s ELSE since END, CASE WHEN open = mark THEN since END, CASE WHEN open = mark THEN e END FROM g JOIN m ON m.digest = g.digest AND m.i = g.i + 1)"""
SQL["fence_pairs"] = f"{_PAIRS} SELECT digest, CAST(a AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end FROM g WHERE b IS NOT NULL UNION SELECT digest, CAST(since AS BIGINT), CAST(n AS BIGINT) FROM (SELECT g.digest, since, open, n, row_number() OVER (PARTITION BY g.digest ORDER BY g.i DESC) AS k FROM g JOIN t USING (digest)) WHERE k = 1 AND open IS NOT NULL"
SQL["heading_paths"] = rf"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n, string_split(text, chr(10)) AS l FROM (SELECT -doc_id AS doc_id, text FROM documents UNION ALL SELECT row_id, text FROM chunks WHERE regexp_matches(relative_path, '[.]mdx?$')) WHERE text IS NOT NULL),
  p AS (SELECT doc_id, n, line, l[k + 1] AS below, k, coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x) + 1)), 0) AS s FROM (SELECT doc_id, n, l, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM t)),
  f AS (SELECT *, sum(CAST({_LINE} AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS marks, {_LINE} AS fence FROM p),
  h AS (SELECT doc_id, n, s, k, CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]+.') THEN length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) WHEN regexp_matches(below, '^ {{0,3}}=+[ \t]*$') THEN 1 ELSE 2 END AS level,
    trim(regexp_replace(CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]+.') THEN regexp_extract(line, '^ {{0,3}}#{{1,6}}[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$', 1) ELSE line END, '\s+', ' ', 'g')) AS title
    FROM f WHERE marks % 2 = 0 AND NOT fence AND (regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]+.+?') OR (trim(line) <> '' AND regexp_matches(coalesce(below, ''), '^ {{0,3}}(=+|-+)[ \t]*$')))),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, lead(s, 1, n) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM h),
  g AS (SELECT doc_id, i, s, e, [{{'l': level, 't': title}}] AS path FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, o.s, o.e, list_append(list_filter(path, lambda x: x.l < o.level), {{'l': o.level, 't': o.title}}) FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1)
  SELECT doc_id AS id, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end, array_to_string(list_transform(path, lambda x: x.t), ' > ') AS context FROM g UNION ALL SELECT doc_id, 0, CAST(s AS BIGINT), '' FROM o WHERE i = 1 AND s > 0"""
#: SQL of queries of the other catalogues that greedy choices make recursive.
SQL_ELSEWHERE = {
    "ingest_windows": """WITH RECURSIVE f AS (SELECT split_part(relative_path, '/', 1) AS lane, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(greatest(1, ceil(coalesce(bytes, 0) / 1000.0)) AS BIGINT) AS parts, row_number() OVER (PARTITION BY split_part(relative_path, '/', 1) ORDER BY relative_path) AS k FROM manifest_files),
  g AS (SELECT lane, k, bytes, 1 AS n, bytes AS size, parts AS p, 0 AS w FROM f WHERE k = 1 UNION ALL SELECT f.lane, f.k, f.bytes, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN f.bytes ELSE size + f.bytes END, CASE WHEN cut THEN f.parts ELSE p + f.parts END, w + CAST(cut AS INT)
    FROM g JOIN f ON f.lane = g.lane AND f.k = g.k + 1, LATERAL (SELECT n + 1 > 16 OR size + f.bytes > 200000 OR p + f.parts > 256 AS cut))
  SELECT lane, CAST(w AS INT) AS "window", count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY lane, w""",
    "spread_results": f"""WITH RECURSIVE {_FOUND}, c AS (SELECT query_id, row_id, f.rank, relative_path AS p, char_start AS s, char_end AS e, count(*) OVER (PARTITION BY query_id) AS n FROM found f JOIN chunks USING (row_id)),
  g AS (SELECT query_id, n, 0 AS step, []::STRUCT(row_id BIGINT, p VARCHAR, s BIGINT, e BIGINT)[] AS chosen FROM (SELECT DISTINCT query_id, n FROM c) UNION ALL
    SELECT g.query_id, g.n, step + 1, CASE WHEN len(chosen) < 5 AND len(list_filter(chosen, lambda x: x.row_id = c.row_id)) = 0 AND (step >= g.n OR len(list_filter(chosen, lambda x: x.p = c.p)) < 2)
      AND len(list_filter(chosen, lambda x: x.p = c.p AND c.s IS NOT NULL AND c.e IS NOT NULL AND x.s < c.e AND c.s < x.e)) = 0 THEN list_append(chosen, {{'row_id': c.row_id, 'p': c.p, 's': CASE WHEN c.e IS NULL THEN NULL ELSE c.s END, 'e': CASE WHEN c.s IS NULL THEN NULL ELSE c.e END}}) ELSE chosen END
    FROM g JOIN c ON c.query_id = g.query_id AND c.rank = step % g.n + 1 WHERE step < 2 * g.n)
  SELECT query_id, unnest(chosen).row_id AS row_id, CAST(generate_subscripts(chosen, 1) AS INT) AS rank FROM g WHERE step = 2 * n""",
    "mmr_rerank": f"""WITH RECURSIVE {_FOUND}, c AS (SELECT query_id, row_id, f.rank AS i, list_distinct({tokens_sql('text')}) AS t FROM found f JOIN chunks USING (row_id)), m AS (SELECT a.query_id, a.i, list(CASE WHEN len(a.t) + len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END ORDER BY b.i) AS s FROM c a JOIN c b USING (query_id) GROUP BY ALL),
  a AS (SELECT query_id, list(s ORDER BY i) AS s FROM m GROUP BY 1),
  g AS (SELECT query_id, s, 0 AS step, []::BIGINT[] AS chosen FROM a UNION ALL SELECT query_id, s, step + 1, list_append(chosen, list_sort(list_transform(list_filter(range(1, len(s) + 1), lambda i: NOT list_contains(chosen, i)), lambda i: {{'g': -round(0.85 / i - 0.15 * coalesce(list_max(list_transform(chosen, lambda j: s[i][j])), 0), 12), 'i': i}}))[1].i) FROM g WHERE step < least(5, len(s)))
  SELECT c.query_id, row_id, CAST(list_position(chosen, i) AS INT) AS rank FROM g JOIN c ON c.query_id = g.query_id AND list_contains(chosen, i) WHERE step = least(5, len(s))""",
    "abstention_filter": f"""WITH {_FOUND}, q AS (SELECT query_id, {tokens_sql('query')} AS asked FROM (SELECT row_id AS query_id, array_to_string({terms_sql('text')}, ' ') AS query FROM chunks WHERE row_id % 100 = 0 AND text IS NOT NULL)),
  h AS (SELECT *, list_filter(asked, lambda t: length(t) >= 4 AND regexp_matches(t, '\\d') AND (regexp_matches(t, '\\p{{L}}') OR regexp_matches(t, '^\\d{{4,}}$'))) AS anchors FROM q), o AS (SELECT row_id, {tokens_sql('text')} AS own FROM chunks WHERE text IS NOT NULL),
  v AS (SELECT query_id, row_id, rank, CASE WHEN len(anchors) > 0 THEN len(list_intersect(anchors, own)) > 0 ELSE len(list_filter(asked, lambda term: {catalog_search._TERM_HIT})) > 0 END AS evidence FROM found JOIN h USING (query_id) JOIN o USING (row_id))
  SELECT query_id, row_id, evidence, evidence OR 2.0 / rank <= 1.1 AS semantic FROM v""",
    "rtf_text": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('{\rtf1\ansi ' || text || '\par}', '\\par[d]?\b', chr(10), 'g'), '\\''[0-9a-fA-F]{2}', ' ', 'g'), '\\[a-zA-Z]+-?\d* ?', '', 'g'), '[{}]', '', 'g'))) AS digest FROM documents""",
    "xml_text": r"""SELECT row_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '<!--(?s:.)*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM chunks WHERE relative_path LIKE '%.xml'""",
}
SQL |= SQL_ELSEWHERE
