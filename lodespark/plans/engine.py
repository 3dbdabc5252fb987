"""The engine: ingest a corpus, search it in batches, ask, expand citations, research, evaluate, audit."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.config import Config, context_radius, lexical_candidate_limit, vector_candidate_limit, vector_index_policy
from lodespark.errors import CitationMismatch, IndexUnavailable, InputError
from lodespark.functions import citations, redaction
from lodespark.functions.embedding import hash_embedding, prefixed
from lodespark.functions.queries import research_queries, sanitized
from lodespark.functions.text import matched_terms, snippet
from lodespark.operators import audit, candidates, chunking, context, evaluate, hybrid, lexical, predicates, research, vectors
from lodespark.operators.maintenance import within_output
from lodespark.plans.generations import COUNTS, MOST_LAYERS, Store, layers_of
from lodespark.sources import inventory, parsers

FILES = "relative_path string, source string, extension string, checksum string, bytes long, mtime_ms double"


class Engine:
    """A session, a store and settings; queries come as DataFrames (query_id, query) and leave as DataFrames."""

    def __init__(self, spark: SparkSession, store: str | Store, config: Config | None = None, provider=None, on_progress=None) -> None:
        """``provider`` is a batch UDF from texts to vectors; ``on_progress`` is called with a stage and its counts."""
        self.spark, self.config, self.provider = spark, config or Config(), provider
        self.on_progress = on_progress or (lambda stage, counts: None)
        self.store = store if isinstance(store, Store) else Store(spark, store)

    # -- ingestion

    def chunks_of(self, parsed: DataFrame) -> DataFrame:
        """Redacted, chunked and embedded rows of parsed files."""
        c = self.config
        text = redaction.redact(F.col("text"), c.custom_redactions) if c.redaction else F.col("text")
        # line numbers hold while no match or replacement has a line end
        breaks = lambda t: F.regexp_count(t, F.lit("\n"))
        spoils = any("\n" in (r.replacement or "") for r in c.custom_redactions)
        parsed = parsed.withColumn("_source", F.col("text"))
        docs = parsed.where("error is null").withColumn("text", text)
        docs = docs.withColumn("_lined", (F.col("text") == F.col("_source")) if spoils else (breaks(F.col("text")) == breaks(F.col("_source")))).drop("_source")
        rows = chunking.chunked(docs, c.chunk_size, c.chunk_overlap)
        # the first region that ends after the chunk's start places the chunk
        regions = docs.select("relative_path", F.col("extension").alias("_ext"), "source", "checksum", "bytes", "mtime_ms", "regions", "_lined")
        rows = rows.join(regions, "relative_path")
        region = chunking.first_region(F.col("regions"), F.col("char_start"))
        lined = F.col("_lined") & ~F.col("_ext").isin(".docx", ".pptx", ".xlsx", ".odt", ".ods", ".odp", ".epub", ".html", ".htm")
        place = lambda f, kind: F.when(F.size("regions") > 0, region[f]).cast(kind)
        rows = rows.withColumns({
            "location_kind": place("kind", "string"), "location_start": place("first", "int"), "location_end": place("last", "int"), "location_label": F.nullif(place("label", "string"), F.lit("")),
            "cell_start": F.nullif(place("cell_start", "string"), F.lit("")), "cell_end": F.nullif(place("cell_end", "string"), F.lit("")), "page_start": F.when(region["kind"] == "page", region["first"]).cast("int"), "page_end": F.when(region["kind"] == "page", region["last"]).cast("int"),
            "line_start": F.when(lined, F.col("line_start")), "line_end": F.when(lined, F.col("line_end")),
        })
        rows = rows.withColumn("search_text", chunking.search_text(F.col("context_path"), F.col("text")))
        rows = rows.withColumn("_index", lexical.index_columns(F.col("search_text"))).select("*", "_index.*").drop("_index")
        rows = rows.withColumn("vector", self.embed(F.col("search_text"), query=False)).withColumn("embedding_provider", F.lit(c.embedding_provider)).withColumn("embedding_model", F.lit(c.embedding_model))
        return rows.drop("regions", "_ext", "_lined")

    def embed(self, text, query: bool):
        """Vectors of texts by the provider the engine was made with; the hash embedding without one."""
        return hash_embedding(text) if self.provider is None else self.provider(prefixed(text, self.config.embedding_model, query))

    def ingest(self, root: str, include=(), exclude=(), preserve_last_good: bool = True, now: float | None = None) -> dict:
        """Bring the index up to date with the files below ``root``: unchanged files are kept, changed ones read again.

        A file that fails keeps its last good chunks, or loses them without ``preserve_last_good``.
        """
        c, store, began = self.config, self.store, time.monotonic()
        now = now or time.time()
        with store.writing():
            old = store.manifest()
            same_policy = old is not None and old.get("policy") == c.policy_fingerprint()
            layers = layers_of(old) if same_policy else []
            known = store.layered("files", layers) if layers else None
            cache = None
            if known is not None:
                # a checksum that was verified long ago, or comes from the future, is taken again
                age = F.lit(now) - F.col("verified_at")
                cache = known.where((age >= 0) & (age <= c.fingerprint_days * 86_400)).select("relative_path", "bytes", "mtime_ms", F.col("checksum").alias("cached_checksum"))
            found = inventory.classified(inventory.scanned(self.spark, root, include, exclude, content=True, known=cache), c.max_file_bytes, c.include_extensions)
            current = found.where("reason is null")
            self.on_progress("inventoried", {})
            kept = audit.reusable(current.select("relative_path", "checksum"), known.where("error is null")) if known is not None else current.select("relative_path", "checksum").limit(0)
            fresh = current.join(kept.select("relative_path"), "relative_path", "left_anti")
            missing = fresh.where("content is null").select("relative_path")  # unchanged but never read without an error
            if known is not None and missing.limit(1).count():
                again = inventory.classified(inventory.scanned(self.spark, root, include, exclude, content=True), c.max_file_bytes, c.include_extensions)
                fresh = fresh.where("content is not null").unionByName(again.join(missing, "relative_path", "left_semi").select(*fresh.columns))
            parsed = parsers.parsed(fresh, c.extractors).withColumn("source", F.substring_index("relative_path", "/", 1))
            generation = store.new_generation()
            store.write(parsed, generation, "parsed")
            parsed = store.table("parsed", generation)
            self.on_progress("parsed", {"files": parsed.count()})
            counts = self.write_layer(generation, parsed, current.drop("content"), known, layers, preserve_last_good, now)
            store.write(found.where("reason is not null").select("relative_path", "extension", "bytes", "reason", "recommendation"), generation, "skipped")
            counts |= {"reused": kept.count(), "seconds": round(time.monotonic() - began, 3)}
            return self.activate_layer(generation, counts, layers, now)

    def write_layer(self, generation: str, parsed: DataFrame, current: DataFrame | None, known: DataFrame | None, layers: list[str], preserve_last_good: bool, now: float) -> dict:
        """Write what a run brings: chunks of parsed files, their state, and the paths whose older rows end; returns the counts.

        ``current`` are all files there are; None means that files which aren't in ``parsed`` stay as they are. A file that
        failed but has good chunks below keeps them.
        """
        store = self.store
        good = parsed.where("error is null").select("relative_path")
        dropped = good
        if known is not None:
            gone = audit.removed(known, current) if current is not None else known.select("relative_path").limit(0)
            failed = parsed.where("error is not null").select("relative_path")
            dropped = dropped.unionByName(gone) if preserve_last_good else dropped.unionByName(gone).unionByName(failed)
        store.write(self.chunks_of(parsed), generation, "chunks")
        new = store.table("chunks", generation)
        if new.groupBy("id").count().where("count > 1").limit(1).count():
            raise InputError("two chunks have one id; the generation isn't activated")
        self.on_progress("embedded", {"chunks": new.count()})
        per_file = new.groupBy("relative_path").agg(F.count("*").cast("int").alias("chunk_count"))
        state = parsed.select("relative_path", "source", "extension", "checksum", "bytes", "mtime_ms", "error").join(per_file, "relative_path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("verified_at", F.lit(now))
        if known is not None and preserve_last_good:
            last = known.select("relative_path", F.col("chunk_count").alias("_last"))
            state = state.join(last, "relative_path", "left").withColumn("chunk_count", F.when(F.col("error").isNotNull(), F.coalesce("_last", F.lit(0))).otherwise(F.col("chunk_count"))).drop("_last")
        store.write(state, generation, "files")
        # the state of a failed file is new though its chunks stay, so the two tables have lists of their own
        store.write(dropped.select("relative_path").distinct(), generation, "dropped")
        store.write((dropped if known is None else dropped.unionByName(parsed.select("relative_path"))).distinct(), generation, "dropped_files")
        store.write(state.where("error is null and chunk_count = 0").select("relative_path", "checksum"), generation, "empty_texts")
        if layers:
            files = store.layered("files", [*layers, generation])
        else:
            files = store.table("files", generation)
        totals = files.agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0)), F.count("error")).first()
        return {"files": totals[0], "chunks": int(totals[1]), "errors": totals[2]}

    def activate_layer(self, generation: str, counts: dict, layers: list[str], now: float) -> dict:
        """Bring the codes of the vectors up to the policy and make the layers the index; many layers are made one first."""
        store = self.store
        policy = self.index_layer(generation, counts, layers)
        self.on_progress("indexed", counts)
        manifest = store.activate(generation, self.config, counts | {"vector_index": policy}, now, layers)
        if len(layers) + 1 > MOST_LAYERS:
            manifest = store.merge(self.config, layers_of(manifest), {k: v for k, v in manifest.items() if k in COUNTS or k == "vector_index"})
        return manifest

    def index_layer(self, generation: str, counts: dict, layers: list[str]) -> dict:
        """Codes for the rows of a layer as the index policy has it; the quantizer is fitted once and again when the policy changes."""
        store, chunks = self.store, self.store.table("chunks", generation)
        width = len((chunks.select("vector").where("vector is not null").first() or [[]])[0])
        policy = vector_index_policy(counts["chunks"], width, self.config.ann_least_rows)
        old = store.manifest() or {}
        if policy["strategy"] == "exact":
            return policy
        same = layers and (old.get("vector_index") or {}).get("strategy") == policy["strategy"] and all(store.has("codes", g) for g in layers)
        # cells follow the root of the rows; a table four times as large is fitted anew
        same = same and policy["num_partitions"] < 2 * old["vector_index"]["num_partitions"]
        rows = chunks if same or not layers else store.layered("chunks", [*layers, generation])
        keyed = lambda df: df.select(F.xxhash64("relative_path", "chunk_index").alias("key"), "relative_path", "vector")
        if same:
            quantizer, policy = vectors.Quantizer.load(store.table("quantizer", next(g for g in reversed(layers) if store.has("quantizer", g)))), old["vector_index"]
        else:
            quantizer = vectors.fit_quantizer(keyed(rows), policy["num_partitions"], width // vectors.WIDTH, "key", "vector")
            store.write(quantizer.table(self.spark), generation, "quantizer")
        targets = [(generation, chunks)] if same else [(g, store.table("chunks", g)) for g in [*layers, generation]]
        for name, part in targets:
            codes = vectors.encoded(keyed(part), quantizer, "key", "vector").join(keyed(part).select("key", "relative_path"), "key")
            store.write(codes, name, "codes") if not store.has("codes", name) else store.replace(codes, name, "codes")
        return policy

    def preview(self, root: str, paths=(), files: int = 5, chunks: int = 5) -> DataFrame:
        """The first chunks of the first files as they would be ingested; nothing is written."""
        found = inventory.supported_files(inventory.scanned(self.spark, root, content=True), most_bytes=self.config.max_file_bytes)
        if inc := predicates.normalized_prefixes(paths):
            found = found.where(predicates.any_of([predicates.path_prefix(F.col("relative_path"), p) for p in inc]))
        first = found.orderBy("relative_path").limit(files)
        parsed = parsers.parsed(first, self.config.extractors)
        return chunking.chunked(parsed.where("error is null"), self.config.chunk_size, self.config.chunk_overlap).where(F.col("chunk_index") < chunks).select("relative_path", "chunk_index", "context_path", snippet(F.col("text")).alias("snippet"))

    def unmatched(self, root: str, paths) -> list[str]:
        """The prefixes of a preview that match no file below ``root``."""
        found = audit.matched_prefixes(inventory.scanned(self.spark, root), list(paths))
        return sorted(r[0] for r in found.where("files = 0").collect())

    # -- retrieval

    def search(self, queries: DataFrame, top_k: int | None = None, include=None, exclude=None, contexts=None, radius: int | None = None, explain: bool = False) -> DataFrame:
        """(query_id, rank, relative_path, chunk_index, citation, text, context[, scores]) for a batch of queries.

        Paths and contexts filter before ranking and again for neighbours. Queries are cut to what can be retrieved; rows
        without evidence are dropped, copies of a text are one, and sources are spread.
        """
        c = self.config
        k = top_k or c.top_k
        if not 1 <= k <= 100:
            raise InputError("top_k must be 1 to 100")
        self.store.require(c)
        where = predicates.search_predicate(include, exclude, contexts)
        chunks = self.store.table("chunks").where(where).withColumn("key", F.xxhash64("relative_path", "chunk_index"))
        asked = queries.select("query_id", sanitized(F.col("query"))["query"].alias("query"))
        words = self._lexical(asked, chunks, k)
        probes = asked.select("query_id", self.embed(F.col("query"), query=True).alias("vector"))
        near = self._nearest(chunks, probes, vector_candidate_limit(k, c.retrieval_profile), filtered=bool(include or exclude or contexts))
        pool = hybrid.fused(near.select("query_id", "key", "distance"), words.select("query_id", "key", "score"))
        named = words.where("path_match is not null").select("query_id", "key", "path_match")
        rows = pool.join(chunks.drop("vector", *lexical.INDEX), "key").join(asked, "query_id").join(named, ["query_id", "key"], "left")
        rows = rows.where(F.col("path_match").isNotNull() | hybrid.passes(F.col("query"), F.col("search_text"), F.col("distance"), c.embedding_provider != "local-hash"))
        rows = hybrid.collapsed(rows, exact=F.col("path_match") == 2)
        from lodespark.config import SOURCE_CAPS

        best = hybrid.spread(rows, k, SOURCE_CAPS[c.retrieval_profile])
        around = context.neighbours(best, chunks, context_radius(c.context_radius if radius is None else radius))
        out = best.join(around, ["query_id", "relative_path", "chunk_index"], "left").withColumn("citation", citations.of_chunks())
        cols = ["query_id", "rank", "relative_path", "chunk_index", "citation", "context_path", "text", "context"]
        if explain:
            out = out.withColumn("matched_terms", matched_terms(F.col("query"), F.col("search_text")))
        return out.select(*cols, *(["distance", "lexical_score", "vector_rank", "lexical_rank", "score", "matched_terms"] if explain else []))

    def _lexical(self, asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        """The staged candidates of full text and paths, from the index beside the chunks.

        A store without it is scanned where the scan limit allows to scan all of it, else the search is refused.
        """
        c = self.config
        if "tokens" not in chunks.columns:
            if c.scan_limit < self.store.require().get("chunks", 0):
                raise IndexUnavailable("full text isn't indexed and the scan limit doesn't reach all chunks; compact or ingest again")
            chunks = chunks.withColumn("_index", lexical.index_columns(F.col("search_text"))).select("*", "_index.*").drop("_index")
        return candidates.staged(chunks, asked, lexical_candidate_limit(k, c.retrieval_profile), k)

    def _nearest(self, chunks: DataFrame, probes: DataFrame, limit: int, filtered: bool) -> DataFrame:
        """The nearest chunks: by codes where the index has them and nothing is filtered, else exactly."""
        m = self.store.require()
        policy, layers = m.get("vector_index") or {"strategy": "exact"}, layers_of(m)
        if filtered or policy["strategy"] == "exact" or not all(self.store.has("codes", g) for g in layers):
            return vectors.nearest(chunks, probes, limit, "key", "vector")
        quantizer = vectors.Quantizer.load(self.store.table("quantizer", next(g for g in reversed(layers) if self.store.has("quantizer", g))))
        return vectors.probe(self.store.table("codes"), quantizer, chunks, probes, limit, vectors.probes_of(len(quantizer.cells)), policy["refine_factor"], "key", "vector")

    def ask(self, queries: DataFrame, **options) -> DataFrame:
        """(query_id, answer): the found passages, each with its citation."""
        return research.answer(self.search(queries, **options))

    def expand(self, cited: DataFrame, radius: int = 1, strict: bool = True) -> DataFrame:
        out = context.expanded(cited, self.store.table("chunks"), context_radius(radius))
        if strict and out.where("not found").limit(1).count():
            raise CitationMismatch("a citation isn't in the index")
        return out

    def compact(self, results: DataFrame, length: int = 260) -> DataFrame:
        return research.compact(results.drop("context"), length=length)

    def fit_output(self, results: DataFrame) -> DataFrame:
        return within_output(results, self.config.max_output_bytes)

    def research(self, queries: DataFrame, top_k: int | None = None, code: DataFrame | None = None) -> dict[str, DataFrame]:
        """Evidence fused over a query and its expansions, lines of code, and whether it is enough."""
        k = top_k or self.config.top_k
        each = queries.select(F.col("query_id").alias("research_id"), F.col("query").alias("primary"), F.posexplode(research_queries(F.col("query"))).alias("n", "query"))
        each = each.withColumn("query_id", F.col("research_id") * 8 + F.col("n"))
        found = Engine(self.spark, self.store, replace(self.config, context_radius=0)).search(each.select("query_id", "query"), max(2, -(-k // 2)))
        joined = found.join(each.select("query_id", "research_id", F.col("query").alias("asked"), (F.col("n") == 0).alias("is_primary")), "query_id")
        evidence = research.fused_evidence(joined.select("research_id", F.col("asked").alias("query"), "is_primary", "relative_path", "chunk_index", "rank"), each.select("research_id", "query")).where(F.col("rank") <= k)
        report = self.audit(None)
        ready = research.readiness(evidence, report["missing"], report["stale"])
        lines = research.code_lines(code, queries).where("score > 0") if code is not None else None
        return {"evidence": evidence, "ready": ready} | ({"code": lines} if lines is not None else {})

    def evaluate(self, golden: DataFrame, thresholds: dict[str, float] | None = None) -> dict[str, DataFrame]:
        """Metrics of the engine on golden queries (query_id, query, answerable, category, locale and judgments)."""
        found = self.search(golden.select("query_id", "query"), top_k=max(self.config.top_k, 10), radius=0)
        judged = evaluate.judgments_of(golden)
        kinds = judged.groupBy("query_id").agg(F.max(F.col("kind")).alias("kind"), F.max((F.col("kind") == "citation").cast("int")).alias("cites"))
        value = F.when(F.col("cites") == 1, F.col("citation")).otherwise(F.col("relative_path"))
        results = found.join(kinds.select("query_id", "cites"), "query_id", "left").select("query_id", value.alias("value"), "rank")
        cases = evaluate.cases(results, judged, golden)
        metrics = evaluate.metrics(cases)
        graded = judged.where("relevance > 1").select("query_id").distinct().count()
        proof = evaluate.verified(cases, thresholds or {}, self.audit(None)["stale"], graded)
        return {"proof": proof, "cases": cases, "metrics": metrics, "by_category": evaluate.groups(cases, "category"), "by_locale": evaluate.groups(cases, "locale"), "gates": evaluate.gates(metrics, thresholds)}

    # -- reports

    def audit(self, root: str | None) -> dict:
        """Missing and stale files against those below ``root`` (or of the last ingestion), statistics, duplicates and likely archives."""
        m = self.store.require()
        files, chunks = self.store.table("files"), self.store.table("chunks")
        current = inventory.supported_files(inventory.scanned(self.spark, root), most_bytes=self.config.max_file_bytes).select("relative_path", "checksum") if root else files.select("relative_path", "checksum")
        empty = files.where("chunk_count = 0 and error is null").select("relative_path")
        return {
            "generation": m["generation"], "missing": audit.missing(current, chunks, empty).count(), "stale": audit.stale(chunks, current).count(),
            "duplicates": [r.asDict() for r in audit.duplicate_groups(files).collect()], "archives": [r[0] for r in audit.archive_candidates(files).collect()],
            "stats": audit.chunk_stats(chunks).first().asDict(), "fingerprint": audit.corpus_fingerprint(files).first()["fingerprint"],
        }

    def status(self) -> dict:
        """What the manifest says, without opening a table."""
        m = self.store.manifest()
        return {"ready": False, "reason": "there is no index"} if m is None else {"ready": m["policy"] == self.config.policy_fingerprint(), "age_seconds": max(0.0, time.time() - m["activated_at"])} | m

    def sources(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return self.store.table("files").orderBy("relative_path").offset(offset).limit(limit)

    def snapshot(self) -> DataFrame:
        return self.store.table("files").select("relative_path", "checksum", "chunk_count")
