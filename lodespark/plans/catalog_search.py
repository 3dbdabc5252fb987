"""Catalogue: full-text, vectors, fusion, evaluation, research.

Query sets are every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.config import lexical_candidate_limit, vector_candidate_limit, vector_index_policy
from lodespark.functions import citations, text
from lodespark.functions.embedding import hash_embedding as hash_vector
from lodespark.operators import candidates, context, evaluate, hybrid, lexical, research, vectors
from lodespark.plans.catalog_text import CITATION_SQL, folded_sql, terms_sql, tokens_sql, words_sql
from lodespark.session import spread, stash, table

K = 10
#: Endings of source code.
CODE = r"\.(?:py|js|ts|tsx|jsx|java|go|rs|rb|php|cs|cpp|c|h|kt|scala|swift|sh|sql)$"


def _asked(s, d):
    """Documents with an id divisible by 100 as queries of their meaningful terms."""
    return table(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), text.meaningful_terms(F.col("text")).alias("terms"))


def _chunks_asked(s, d):
    rows = table(s, d, "chunks").where("row_id % 100 = 0 and text is not null")
    return rows.select(F.col("row_id").alias("query_id"), F.array_join(text.meaningful_terms(F.col("text")), " ").alias("query"))


def _vectors_asked(s, d):
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def document_frequency(s, d):
    posted = lexical.postings(table(s, d, "documents"), "doc_id", "text")
    return lexical.document_frequency(posted)


def postings_checksum(s, d):
    posted = lexical.postings(table(s, d, "documents"), "doc_id", "text")
    return posted.groupBy("doc_id", "len").agg(F.count("*").alias("tokens"), F.max("tf").alias("most"))


def bm25_scores(s, d):
    return lexical.bm25(table(s, d, "documents"), "doc_id", "text", _asked(s, d), "query_id", "terms")


def bm25_topk(s, d):
    return lexical.bm25_top(table(s, d, "documents"), "doc_id", "text", _asked(s, d), "query_id", "terms", K)


def phrase_match(s, d):
    """Rows that hold the first four tokens of a query one after the other."""
    asked = table(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.slice(text.tokens(F.col("text")), 1, 4).alias("phrase"))
    return lexical.phrases(table(s, d, "documents"), "doc_id", "text", asked, "query_id", "phrase")


def _words(s, d):
    return lexical.index(table(s, d, "documents"), "doc_id", "text").select(F.explode("tokens").alias("token")).distinct()


def fuzzy_terms(s, d):
    return lexical.fuzzy_tokens(_words(s, d), _asked(s, d).select(F.explode("terms").alias("term")))


def related_terms(s, d):
    return lexical.related_tokens(_words(s, d), _asked(s, d).select(F.explode("terms").alias("term")))


def _misspelled(s, d):
    """Queries that full text alone answers badly: every hundredth document's longest term with its fourth character left out.

    Every third of them also names a file, by name or by whole path.
    """
    terms = F.transform(F.col("terms"), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    longest = F.array_min(terms)["t"]
    broken = F.concat(F.substring(longest, 1, 3), F.substring(longest, 5, 1000))
    return _asked(s, d).where("size(terms) > 0").select("query_id", F.when(F.col("query_id") % 300 == 0, F.concat(F.lit("notes/"), F.col("query_id"), F.lit(".txt"))).otherwise(broken).alias("query"))


def staged_candidates(s, d):
    """Candidates of misspelled queries and of named files, with the stage that found each; documents stand as files notes/<id>.txt."""
    docs = table(s, d, "documents")
    rows = stash(lexical.index(docs, "doc_id", "text")).select(F.col("doc_id").alias("key"), *lexical.INDEX)
    rows = rows.withColumn("relative_path", F.concat(F.lit("notes/"), F.col("key").cast("string"), F.lit(".txt")))
    return candidates.staged(rows, _misspelled(s, d), 50, 8).select("query_id", "key", "stage", F.when(F.col("stage") > 0, F.round("score", 9)).alias("score"), "path_match", "position")


def identifier_match(s, d):
    """Rows that name an identifier, with a digit or underscore, of every hundredth chunk."""
    chunks = table(s, d, "chunks")
    asked = chunks.where("row_id % 100 = 0").select(F.col("row_id").alias("q"), F.explode(F.array_distinct(text.identifiers(F.col("text")))).alias("identifier")).where(F.col("identifier").rlike(r"\d|_"))
    return lexical.identifier_rows(chunks, "row_id", "text", asked).select(F.col("q").alias("query_id"), "identifier", F.col("key").alias("row_id"))


def matched_terms(s, d):
    """Which terms of a query each of its found chunks is related to."""
    found = _found_chunks(s, d).select("query_id", "row_id").join(_chunks_asked(s, d), "query_id").join(_chunk_texts(s, d), "row_id")
    return found.select("query_id", "row_id", F.array_join(text.matched_terms(F.col("query"), F.col("text")), " ").alias("matched"))


def query_anchors(s, d):
    rows = table(s, d, "chunks")
    return rows.select("row_id", F.array_join(F.array_sort(text.anchors(F.col("text"))), "|").alias("anchors"))


def knn_exact(s, d):
    out = vectors.nearest(table(s, d, "embeddings"), _vectors_asked(s, d), K)
    return out.withColumn("distance", F.round("distance", 6))


def knn_filtered(s, d):
    out = vectors.nearest(table(s, d, "embeddings"), _vectors_asked(s, d), K, where="label < 5")
    return out.withColumn("distance", F.round("distance", 6))


def hash_embedding(s, d):
    """Norm and largest coordinate of the feature-hash embedding of every document."""
    rows = spread(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", hash_vector(F.col("text")).alias("v"))
    return rows.select("doc_id", F.round(F.array_max("v"), 6).alias("largest"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


def _lexical_vectors(s, d):
    """The candidates of two rankings of documents for every hundredth one: the distance of hash embeddings, and BM25."""
    docs = table(s, d, "documents")
    scored = lexical.bm25_top(docs, "doc_id", "text", _asked(s, d), "query_id", "terms", lexical_candidate_limit(K)).select("query_id", F.col("doc_id").alias("key"), "score")
    embedded = spread(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("key"), hash_vector(F.col("text")).alias("vector"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), hash_vector(F.col("text")).alias("vector"))
    return vectors.nearest(embedded, asked, vector_candidate_limit(K), "key", "vector", digits=6).drop("rank"), scored


def rrf_hybrid(s, d):
    near, scored = _lexical_vectors(s, d)
    out = hybrid.fused(near, scored).where(F.col("rank") <= K)
    return out.select("query_id", "key", "distance", "vector_rank", "lexical_rank", F.round("score", 9).alias("score"), "rank")


def near_dup_collapse(s, d):
    near, scored = _lexical_vectors(s, d)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), hybrid.text_digest(F.col("text")).alias("digest"), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("relative_path"))
    rows = hybrid.fused(near, scored).where(F.col("rank") <= 100).select("query_id", "key", "rank").join(docs, "key")
    return hybrid.collapsed(rows, digest="digest").select("query_id", "key", "rank")


def source_cap_topk(s, d):
    near, scored = _lexical_vectors(s, d)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("none")).alias("relative_path"))
    rows = hybrid.fused(near, scored).where(F.col("rank") <= 200).select("query_id", "key", "rank").join(docs, "key")
    return hybrid.capped(rows, 8, 2).select("query_id", "key", "rank")


def _chunk_texts(s, d):
    return table(s, d, "chunks").select("row_id", "text")


def _found_chunks(s, d):
    """The ten best chunks of every hundredth chunk's terms, with text and place."""
    chunks = table(s, d, "chunks").where("text is not null")
    asked = _chunks_asked(s, d).withColumn("terms", F.split("query", " "))
    return lexical.bm25_top(chunks, "row_id", "text", asked, "query_id", "terms", K)


def abstention_filter(s, d):
    """Which of the found chunks support their query: lexical evidence, one of its anchors if it has any, or with a semantic provider a small distance."""
    found = _found_chunks(s, d).join(_chunks_asked(s, d), "query_id").join(_chunk_texts(s, d), "row_id")
    far = (2.0 / F.col("rank")).cast("double")
    return found.select("query_id", "row_id", hybrid.has_evidence(F.col("query"), F.col("text")).alias("evidence"), hybrid.passes(F.col("query"), F.col("text"), far, True).alias("semantic"))


def spread_results(s, d):
    found = _found_chunks(s, d).select("query_id", "row_id", "rank").join(table(s, d, "chunks").select("row_id", "relative_path", "char_start", "char_end"), "row_id")
    return hybrid.spread(found, 5, 2).select("query_id", "row_id", "rank")


def neighbor_context(s, d):
    hits = table(s, d, "chunks").where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "relative_path", "chunk_index")
    out = context.neighbours(hits, table(s, d, "chunks"), 1)
    return out.select("query_id", "relative_path", "chunk_index", F.array_join(F.transform("context", lambda c: c["chunk_index"].cast("string")), ",").alias("around"))


def context_islands(s, d):
    hits = table(s, d, "chunks").where("row_id % 10 = 0").select("relative_path", "chunk_index")
    return context.ranges(hits, 2).select("relative_path", F.col("first").cast("int").alias("first_chunk"), F.col("last").cast("int").alias("last_chunk"))


def citation_expand(s, d):
    cited = table(s, d, "chunks").where("row_id % 100 = 0").select(citations.of_chunks().alias("citation")).distinct()
    return context.expanded(cited, table(s, d, "chunks"), 1).select("citation", "found", F.size("context").alias("chunks"))


def jaccard_overlap(s, d):
    """Token overlap of every document with the one before it in its source.

    Blocks of a thousand ids spread a large source; the first of a block meets the last of the block before it in the source.
    """
    from pyspark.sql import Window

    thousand = F.floor(F.col("doc_id") / 1000).alias("thousand")
    docs = table(s, d, "documents").where("source is not null").select("doc_id", "source", thousand, F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    inner = docs.withColumn("b", F.lag("t").over(Window.partitionBy("source", "thousand").orderBy("doc_id")))
    blocks = docs.groupBy("source", "thousand").agg(F.min("doc_id").alias("doc_id"), F.min_by("t", "doc_id").alias("t"), F.max_by("t", "doc_id").alias("last"))
    before = docs.select("source", "thousand").distinct().withColumn("before", F.lag("thousand").over(Window.partitionBy("source").orderBy("thousand")))
    edges = blocks.join(before, ["source", "thousand"]).join(blocks.select("source", F.col("thousand").alias("before"), F.col("last").alias("b")), ["source", "before"])
    pairs = inner.select("doc_id", "t", "b").unionByName(edges.select("doc_id", "t", "b")).where("b is not null")
    return pairs.select("doc_id", F.round(hybrid.jaccard(F.col("t"), F.col("b")), 9).alias("similarity"))


def mmr_rerank(s, d):
    found = _found_chunks(s, d).select("query_id", "row_id", "rank").join(table(s, d, "chunks").select("row_id", "text"), "row_id")
    return hybrid.mmr(found, 5).select("query_id", "row_id", "rank")


#: Farther results don't count in the evaluation.
FARTHEST = 1.1


def _judged(s, d):
    """Results, judgments and queries: the nearest twenty within a distance, judged by the nearest ten of the lower labels.

    Queries of labels above 7 have nothing that is right; those divisible by 300 ask for citations, so path judgments don't count.
    """
    every, asked = table(s, d, "embeddings"), _vectors_asked(s, d)
    results = evaluate.within_distance(vectors.nearest(every, asked, 20, digits=6), FARTHEST).where("vec_id <> query_id").select("query_id", F.col("vec_id").cast("string").alias("value"), "rank")
    right = vectors.nearest(every, asked.where("label <= 7"), 10, where="label < 5", digits=6).where("vec_id <> query_id")
    judged = right.select("query_id", F.when((F.col("query_id") % 300 == 0) & (F.col("rank") > 3), "citation").otherwise("path").alias("kind"), F.col("vec_id").cast("string").alias("value"), F.greatest(F.lit(0), 4 - F.col("rank")).alias("graded"))
    golden = judged.groupBy("query_id").agg(
        F.collect_list(F.when(F.col("kind") == "path", F.struct("kind", "value", F.col("graded").alias("relevance")))).alias("relevance_judgments"),
        F.collect_list(F.when(F.col("kind") == "path", F.col("value"))).alias("expected_paths"), F.collect_list(F.when(F.col("kind") == "citation", F.col("value"))).alias("expected_citations"),
    )
    queries = asked.select("query_id", (F.col("label") <= 7).alias("answerable"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("category"), F.when(F.col("query_id") % 200 == 0, "en").otherwise("fr").alias("locale"))
    return results, evaluate.judgments_of(golden), queries


def _rounded(df, skip=("query_id", "category", "locale")):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def eval_cases(s, d):
    return _rounded(evaluate.cases(*_judged(s, d))).select("query_id", "first_rank", "recall_at_1", "recall_at_5", "recall_at_10", "precision_at_5", "precision_of_returned", "reciprocal_rank", "ndcg_at_10", "hit", "citation_hit", "abstained", "false_positive")


def eval_metrics(s, d):
    return _rounded(evaluate.metrics(evaluate.cases(*_judged(s, d)))).select("cases", "answerable_cases", "recall_at_10", "precision_at_5", "mrr_at_10", "ndcg_at_10", "exact_citation_rate", "false_positive_rate")


def eval_groups(s, d):
    return _rounded(evaluate.groups(evaluate.cases(*_judged(s, d)), "locale")).select("locale", "cases", "recall_at_10", "mrr_at_10", "ndcg_at_10", "false_positive_rate")


def eval_gates(s, d):
    return evaluate.gates(evaluate.metrics(evaluate.cases(*_judged(s, d)))).select("metric", "direction", "threshold", "applicable", "passed")


def _approximate(s, d, asked):
    df = table(s, d, "embeddings")
    policy = vector_index_policy(df.count(), 64, least_rows=1)
    q = vectors.fit_quantizer(df, policy["num_partitions"], 64 // vectors.WIDTH)
    return vectors.probe(vectors.encoded(df, q), q, df, asked, K, vectors.probes_of(len(q.cells)), policy["refine_factor"])


def ann_search(s, d):
    """Cells as the index policy has them, the square root of the rows; a fixed share of them is visited, so that recall doesn't fall with the table."""
    return _approximate(s, d, _vectors_asked(s, d)).withColumn("distance", F.round("distance", 6))


def ann_recall(s, d):
    """Recall at 10 of the approximate search against the exact one, for each query."""
    asked = _vectors_asked(s, d)
    exact = vectors.nearest(table(s, d, "embeddings"), asked, K).select("query_id", "vec_id")
    found = _approximate(s, d, asked).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 9).alias("recall"))


def _research_asked(s, d):
    base = _chunks_asked(s, d)
    short = base.select("query_id", F.array_join(F.slice(F.split("query", " "), 1, 4), " ").alias("query"))
    return base.withColumn("is_primary", F.lit(True)).unionByName(short.withColumn("is_primary", F.lit(False))).where("query <> ''")


def research_fusion(s, d):
    """The found chunks of each query and of its first four terms, fused."""
    chunks = table(s, d, "chunks").where("text is not null")
    asked = _research_asked(s, d).withColumn("q", F.col("query_id") * 2 + F.col("is_primary").cast("int"))
    ranked = lexical.bm25_top(chunks, "row_id", "text", asked.select("q", F.split("query", " ").alias("terms")), "q", "terms", 5).join(asked, "q")
    rows = ranked.join(chunks.select("row_id", "relative_path", "chunk_index"), "row_id")
    out = research.fused_evidence(rows.select(F.col("query_id").alias("research_id"), F.col("q").alias("query"), "is_primary", "relative_path", "chunk_index", "rank"), asked.select(F.col("query_id").alias("research_id"), F.col("q").alias("query")))
    return out.where("rank <= 5").select("research_id", "relative_path", "chunk_index", F.round("score", 9).alias("score"), "best_rank", "queries", "rank")


def code_evidence(s, d):
    """The twenty best lines of code for the first line of every hundredth chunk."""
    code = table(s, d, "chunks").where(F.lower("relative_path").rlike(CODE)).select("row_id", "text")
    asked = table(s, d, "chunks").where("row_id % 100 = 0 and text is not null").select(F.col("row_id").alias("query_id"), F.split("text", "\n")[0].alias("query"))
    return research.code_lines(code, asked, "row_id").select("query_id", "row_id", "line", "matched", "score", "rank")


def answer_text(s, d):
    found = _found_chunks(s, d).where("rank <= 3").select("query_id", "row_id", "rank")
    rows = found.join(table(s, d, "chunks").select("row_id", citations.of_chunks().alias("citation"), text.snippet(F.col("text")).alias("text")), "row_id")
    return research.answer(rows).select("query_id", F.md5("answer").alias("digest"))


def output_budget(s, d):
    from lodespark.operators.maintenance import within_output

    found = _found_chunks(s, d).select("query_id", "row_id", "rank").join(table(s, d, "chunks").select("row_id", "text"), "row_id")
    return within_output(found, 2_000).select("query_id", "row_id", "rank", "used_bytes")


QUERIES = {f.__name__: f for f in (
    document_frequency, postings_checksum, bm25_scores, bm25_topk, phrase_match, fuzzy_terms, related_terms, staged_candidates, identifier_match, matched_terms, query_anchors, knn_exact, knn_filtered, hash_embedding, rrf_hybrid, near_dup_collapse, source_cap_topk,
    abstention_filter, spread_results, neighbor_context, context_islands, citation_expand, jaccard_overlap, mmr_rerank, eval_cases, eval_metrics, eval_groups, eval_gates, ann_search, ann_recall, research_fusion, code_evidence, answer_text, output_budget,
)}


def _posted(source: str, key: str) -> str:
    return f"SELECT {key}, token, any_value(n) AS len, count(*) AS tf FROM (SELECT {key}, len(t) AS n, unnest(t) AS token FROM (SELECT {key}, {tokens_sql('text')} AS t FROM {source})) GROUP BY {key}, token"


def _bm25_sql(source: str, key: str, asked: str) -> str:
    """CTEs up to ``scored`` (query_id, key, score); ``asked`` has (query_id, token)."""
    return f"""tok AS (SELECT {key}, {tokens_sql('text')} AS t FROM {source}), stat AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM tok),
  post AS (SELECT {key}, token, any_value(n) AS len, count(*) AS tf FROM (SELECT {key}, len(t) AS n, unnest(t) AS token FROM tok) GROUP BY {key}, token), asked AS ({asked}),
  freq AS (SELECT token, count(*) AS df FROM post WHERE token IN (SELECT token FROM asked) GROUP BY token),
  scored AS (SELECT query_id, {key}, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM asked JOIN freq USING (token) JOIN post USING (token), stat GROUP BY ALL)"""


_ASKED = f"SELECT doc_id AS query_id, unnest({terms_sql('text')}) AS token FROM documents WHERE doc_id % 100 = 0"
#: Hash embeddings: ``emb`` (doc_id, b, v), of unit length, and ``size`` (doc_id, n2) of all documents with a text.
_EMBED = f"""etok AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL), etf AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(t) AS token FROM etok) GROUP BY ALL),
  feat AS (SELECT token, token AS f, CASE WHEN length(token) >= 6 THEN 1.4 ELSE 1.0 END::DOUBLE AS w FROM (SELECT DISTINCT token FROM etf) UNION ALL SELECT token, 'ngram:' || substr(token, i, 3), 0.35::DOUBLE FROM (SELECT token, unnest(range(1, length(token) - 1)) AS i FROM (SELECT DISTINCT token FROM etf))),
  hashed AS (SELECT f, sha256(f) AS h FROM (SELECT DISTINCT f FROM feat)),
  place AS (SELECT token, ('0x' || substr(h, 1, 8))::UBIGINT % 384 AS b, sum(w * CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM feat JOIN hashed USING (f) GROUP BY ALL),
  raw AS (SELECT doc_id, b, sum(n * v) AS v FROM etf JOIN place USING (token) GROUP BY ALL), norm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM raw GROUP BY 1),
  emb AS (SELECT doc_id, b, CASE WHEN n > 0 THEN v / n ELSE 0 END AS v FROM raw JOIN norm USING (doc_id)), size AS (SELECT etok.doc_id, coalesce(sum(v * v), 0) AS n2 FROM etok LEFT JOIN emb USING (doc_id) GROUP BY 1)"""
_DOCS = _bm25_sql("documents", "doc_id", _ASKED)
_CHUNKS = _bm25_sql("(SELECT * FROM chunks WHERE text IS NOT NULL)", "row_id", f"SELECT row_id AS query_id, unnest({terms_sql('text')}) AS token FROM chunks WHERE row_id % 100 = 0 AND text IS NOT NULL")
_FOUND = f"{_CHUNKS}, found AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INT) AS rank FROM scored WHERE score > 0) WHERE rank <= {K})"
_WORDS = f"words AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS token FROM documents), terms AS (SELECT DISTINCT token AS term FROM ({_ASKED}))"
_NEAR = f"""{_EMBED}, dot AS (SELECT q.doc_id AS query_id, d.doc_id AS key, sum(q.v * d.v) AS dot FROM emb q JOIN emb d USING (b) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
  near AS (SELECT q.doc_id AS query_id, d.doc_id AS key, round(sqrt(greatest(q.n2 + d.n2 - 2 * coalesce(dot, 0), 0)), 6) AS distance FROM size q JOIN size d ON q.doc_id % 100 = 0 LEFT JOIN dot ON dot.query_id = q.doc_id AND dot.key = d.doc_id)"""
_FUSED = f"""{_DOCS}, {_NEAR}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) - 1 AS v FROM near) WHERE v < {vector_candidate_limit(K)}),
  l AS (SELECT * FROM (SELECT query_id, doc_id AS key, score AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS l FROM scored WHERE score > 0) WHERE l < {lexical_candidate_limit(K)}),
  b AS (SELECT query_id, key, distance, v, l, coalesce(1.0 / (60 + v), 0) + coalesce(1.0 / (60 + l), 0) AS score FROM v FULL JOIN l USING (query_id, key)),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(score AS DOUBLE) DESC, coalesce(distance, 'infinity'::DOUBLE), key) AS rank FROM b)"""
_GRAMS = "list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)))"
_RELATED = f"""(term = token OR (length(term) >= 4 AND length(token) >= 4 AND substr(term, 1, 4) = substr(token, 1, 4)) OR (length(term) >= 7 AND length(token) >= 7 AND abs(length(term) - length(token)) <= 1
  AND 2.0 * len(list_intersect({_GRAMS.format(c='term')}, {_GRAMS.format(c='token')})) / (len({_GRAMS.format(c='term')}) + len({_GRAMS.format(c='token')})) >= 0.5))"""
_IDS = rf"list_distinct(regexp_extract_all({folded_sql('text')}, '[\p{{L}}\p{{N}}]+(?:[-_][\p{{L}}\p{{N}}]+)+'))"


def _knn(where: str, k: int = K) -> str:
    return f"""SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


_EVAL = f"""res AS (SELECT query_id, vec_id AS value, rank FROM ({_knn('true', 20)}) WHERE distance <= 1.1 AND vec_id <> query_id), ask AS (SELECT vec_id AS query_id, label <= 7 AS answerable, CASE WHEN vec_id % 200 = 0 THEN 'en' ELSE 'fr' END AS locale FROM embeddings WHERE vec_id % 100 = 0),
  judged AS (SELECT query_id, vec_id AS value, query_id % 300 = 0 AND rank > 3 AS cited, CASE WHEN query_id % 300 = 0 AND rank > 3 THEN 1 ELSE greatest(0, 4 - rank) END AS relevance FROM ({_knn('e.label < 5', 10)}) JOIN ask USING (query_id) WHERE answerable AND vec_id <> query_id),
  rel AS (SELECT query_id, value, relevance, cited FROM judged WHERE relevance > 0 AND (cited OR query_id NOT IN (SELECT query_id FROM judged WHERE cited))),
  ideal AS (SELECT query_id, count(*) AS relevant, bool_or(cited) AS cited, sum(CASE WHEN n <= 10 THEN (2 ** relevance - 1) / log2(n + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, CAST(value AS VARCHAR)) AS n FROM rel) GROUP BY 1),
  back AS (SELECT query_id, count(*) AS back, count(*) FILTER (rank <= 10) AS back10 FROM res GROUP BY 1),
  hit AS (SELECT query_id, count(*) AS h, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first_rank, sum(CASE WHEN rank <= 10 THEN (2 ** relevance - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM res JOIN rel USING (query_id, value) GROUP BY 1),
  every AS (SELECT ask.*, relevant, cited, ideal, coalesce(back, 0) AS back, coalesce(back10, 0) AS back10, coalesce(h, 0) AS h, coalesce(h1, 0) AS h1, coalesce(h3, 0) AS h3, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, first_rank, coalesce(dcg, 0) AS dcg FROM ask LEFT JOIN ideal USING (query_id) LEFT JOIN back USING (query_id) LEFT JOIN hit USING (query_id)),
  cases AS (SELECT query_id, answerable, locale, CAST(first_rank AS INT) AS first_rank, CASE WHEN NOT answerable THEN CAST(back = 0 AS INT) ELSE coalesce(h1 / relevant, 0) END AS recall_at_1, CASE WHEN NOT answerable THEN CAST(back = 0 AS INT) ELSE coalesce(h3 / relevant, 0) END AS recall_at_3,
    CASE WHEN NOT answerable THEN CAST(back = 0 AS INT) ELSE coalesce(h5 / relevant, 0) END AS recall_at_5, CASE WHEN NOT answerable THEN CAST(back = 0 AS INT) ELSE coalesce(h10 / relevant, 0) END AS recall_at_10, h5 / 5.0 AS precision_at_5, CASE WHEN back10 > 0 THEN h10 / back10 ELSE 0 END AS precision_of_returned,
    CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0 END AS reciprocal_rank, CASE WHEN NOT answerable THEN CAST(back = 0 AS INT) ELSE coalesce(dcg / ideal, 0) END AS ndcg_at_10, CASE WHEN answerable THEN h > 0 ELSE back = 0 END AS hit, CASE WHEN cited THEN h > 0 END AS citation_hit, back = 0 AS abstained, NOT answerable AND back > 0 AS false_positive FROM every)"""
_R = lambda c: f"round(CAST({c} AS DOUBLE), 9) AS {c}"
_A = lambda c, n: f"round(CAST(avg({c}) FILTER (answerable) AS DOUBLE), 9) AS {n}"

SQL = {
    "document_frequency": f"SELECT token, count(*) AS df FROM ({_posted('documents', 'doc_id')}) GROUP BY 1",
    "postings_checksum": f"SELECT doc_id, CAST(any_value(len) AS INT) AS len, count(*) AS tokens, max(tf) AS most FROM ({_posted('documents', 'doc_id')}) GROUP BY 1",
    "bm25_topk": f"WITH {_DOCS} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {K}",
    "bm25_scores": f"WITH {_DOCS} SELECT query_id, doc_id, score FROM scored WHERE score > 0",
    "phrase_match": f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), p AS (SELECT doc_id AS query_id, list_slice(t, 1, 4) AS p FROM t WHERE doc_id % 100 = 0 AND len(t) > 0),
  x AS (SELECT doc_id, t, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM t) SELECT DISTINCT query_id, doc_id FROM p JOIN x ON token = p[1] AND list_slice(t, pos, pos + len(p) - 1) = p""",
    "fuzzy_terms": f"WITH {_WORDS} SELECT term, token FROM terms JOIN words ON substr(term, 1, 3) = substr(token, 1, 3) WHERE length(term) >= 7 AND regexp_matches(term, '^[a-z0-9_.-]+$') AND regexp_matches(token, '^[a-z0-9_.-]+$') AND abs(length(term) - length(token)) <= 1 AND levenshtein(term, token) <= 1",
    "related_terms": f"WITH {_WORDS} SELECT term, token FROM terms, words WHERE {_RELATED}",
    "identifier_match": rf"WITH i AS (SELECT row_id, unnest({_IDS}) AS identifier FROM chunks), j AS (SELECT * FROM i WHERE regexp_matches(identifier, '\d|_')) SELECT q.row_id AS query_id, q.identifier, i.row_id FROM j q JOIN j i USING (identifier) WHERE q.row_id % 100 = 0",
    "query_anchors": rf"""SELECT row_id, array_to_string(list_sort(list_distinct(list_concat(list_filter({_IDS}, lambda t: regexp_matches(t, '\d|_')), list_filter({tokens_sql('text')}, lambda t: length(t) >= 4 AND regexp_matches(t, '\d') AND (regexp_matches(t, '\p{{L}}') OR regexp_matches(t, '^\d{{4,}}$')))))), '|') AS anchors
  FROM chunks""",
    "knn_exact": _knn("true"),
    "knn_filtered": _knn("e.label < 5"),
    "rrf_hybrid": f"WITH {_FUSED} SELECT query_id, key, distance, CAST(v + 1 AS INT) AS vector_rank, CAST(l + 1 AS INT) AS lexical_rank, round(CAST(score AS DOUBLE), 9) AS score, CAST(rank AS INT) AS rank FROM fused WHERE rank <= {K}",
    "near_dup_collapse": rf"""WITH {_FUSED}, c AS (SELECT query_id, key, rank, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS x, concat_ws('/', coalesce(source, 'none'), lpad(CAST(doc_id AS VARCHAR), 7, '0')) AS p FROM fused JOIN documents ON doc_id = key WHERE rank <= 100)
  SELECT query_id, key, CAST(f AS INT) AS rank FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, x) AS f, row_number() OVER (PARTITION BY query_id, x ORDER BY len(string_split(p, '/')), length(p), rank) AS n FROM c) WHERE n = 1""",
    "source_cap_topk": f"""WITH {_FUSED}, c AS (SELECT query_id, key, rank, coalesce(source, 'none') AS p FROM fused JOIN documents ON doc_id = key WHERE rank <= 200), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY rank) AS nth FROM c),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(nth > 2 AS INT), rank) AS o FROM n) SELECT query_id, key, CAST(o AS INT) AS rank FROM o WHERE o <= 8""",
    "neighbor_context": """WITH c AS (SELECT DISTINCT relative_path, chunk_index FROM chunks) SELECT h.row_id AS query_id, h.relative_path, h.chunk_index, string_agg(CAST(c.chunk_index AS VARCHAR), ',' ORDER BY c.chunk_index) AS around
  FROM chunks h JOIN c ON c.relative_path = h.relative_path AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 WHERE h.row_id % 100 = 0 GROUP BY ALL""",
    "context_islands": """WITH r AS (SELECT DISTINCT relative_path, greatest(chunk_index - 2, 0) AS f, chunk_index + 2 AS l FROM chunks WHERE row_id % 10 = 0),
  s AS (SELECT *, CASE WHEN f > coalesce(max(l) OVER w + 1, -1) THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY relative_path ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY relative_path ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT relative_path, CAST(min(f) AS INT) AS first_chunk, CAST(max(l) AS INT) AS last_chunk FROM i GROUP BY relative_path, island""",
    "citation_expand": f"""WITH h AS (SELECT DISTINCT {CITATION_SQL} AS citation, relative_path, chunk_index FROM chunks WHERE row_id % 100 = 0), c AS (SELECT DISTINCT relative_path, chunk_index FROM chunks)
  SELECT citation, true AS found, CAST(count(*) AS INT) AS chunks FROM h JOIN c ON c.relative_path = h.relative_path AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY citation""",
    "jaccard_overlap": f"""WITH t AS (SELECT doc_id, source, list_distinct({tokens_sql('text')}) AS t FROM documents WHERE source IS NOT NULL), b AS (SELECT *, lag(t) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM t)
  SELECT doc_id, round(CASE WHEN len(t) + len(b) > 0 THEN len(list_intersect(t, b)) / CAST(len(t) + len(b) - len(list_intersect(t, b)) AS DOUBLE) ELSE 0 END, 9) AS similarity FROM b WHERE b IS NOT NULL""",
    "eval_cases": f"WITH {_EVAL} SELECT query_id, first_rank, {', '.join(map(_R, ('recall_at_1', 'recall_at_5', 'recall_at_10', 'precision_at_5', 'precision_of_returned', 'reciprocal_rank', 'ndcg_at_10')))}, hit, citation_hit, abstained, false_positive FROM cases",
    "eval_metrics": f"WITH {_EVAL} SELECT count(*) AS cases, count(*) FILTER (answerable) AS answerable_cases, {_A('recall_at_10', 'recall_at_10')}, {_A('precision_at_5', 'precision_at_5')}, {_A('reciprocal_rank', 'mrr_at_10')}, {_A('ndcg_at_10', 'ndcg_at_10')}, round(count(*) FILTER (citation_hit) / nullif(count(citation_hit), 0), 9) AS exact_citation_rate, round(count(*) FILTER (false_positive) / nullif(count(*) FILTER (NOT answerable), 0), 9) AS false_positive_rate FROM cases",
    "eval_groups": f"WITH {_EVAL} SELECT locale, count(*) AS cases, {_A('recall_at_10', 'recall_at_10')}, {_A('reciprocal_rank', 'mrr_at_10')}, {_A('ndcg_at_10', 'ndcg_at_10')}, coalesce(round(count(*) FILTER (false_positive) / nullif(count(*) FILTER (NOT answerable), 0), 9), 0) AS false_positive_rate FROM cases GROUP BY locale",
    "research_fusion": f"""WITH base AS (SELECT row_id AS research_id, {terms_sql('text')} AS terms FROM chunks WHERE row_id % 100 = 0 AND text IS NOT NULL), every AS (SELECT research_id, terms, true AS is_primary FROM base WHERE len(terms) > 0 UNION ALL SELECT research_id, list_slice(terms, 1, 4), false FROM base WHERE len(terms) > 0),
  {_bm25_sql("(SELECT * FROM chunks WHERE text IS NOT NULL)", "row_id", "SELECT research_id || '#' || is_primary AS query_id, unnest(terms) AS token FROM every")},
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5),
  e AS (SELECT CAST(string_split(query_id, '#')[1] AS BIGINT) AS research_id, query_id, string_split(query_id, '#')[2] = 'true' AS is_primary, relative_path, chunk_index, rank FROM ranked JOIN chunks USING (row_id)),
  n AS (SELECT research_id, count(*) AS n FROM every GROUP BY 1), f AS (SELECT research_id, relative_path, chunk_index, round(sum(CAST(CASE WHEN is_primary THEN 2 * n ELSE 1 END AS DOUBLE) / (60 + rank)), 12) AS score, min(rank) AS best_rank, count(DISTINCT query_id) AS queries FROM e JOIN n USING (research_id) GROUP BY ALL)
  SELECT research_id, relative_path, chunk_index, round(score, 9) AS score, CAST(best_rank AS INT) AS best_rank, queries, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY score DESC, best_rank, relative_path, chunk_index) AS rank FROM f) WHERE rank <= 5""",
    "code_evidence": rf"""WITH q AS (SELECT row_id AS query_id, regexp_replace({folded_sql('one')}, '^\s+|\s+$', '', 'g') AS query, {terms_sql('one')} AS terms FROM (SELECT row_id, string_split(text, chr(10))[1] AS one FROM chunks WHERE row_id % 100 = 0 AND text IS NOT NULL)),
  w AS (SELECT query_id, query, len(terms) AS n, unnest(terms) AS term FROM q WHERE len(terms) > 0),
  l AS (SELECT row_id, line, {folded_sql('content')} AS content FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM chunks WHERE regexp_matches(lower(relative_path), '{CODE}') AND text IS NOT NULL)),
  h AS (SELECT query_id, row_id, line, n, count(*) AS matched, max(CASE WHEN contains(content, query) THEN 1000 ELSE 0 END) AS whole FROM l JOIN w ON contains(content, term) GROUP BY ALL HAVING count(*) >= least(2, n)),
  b AS (SELECT * FROM (SELECT *, 100 * matched + whole AS score, row_number() OVER (PARTITION BY query_id, row_id ORDER BY 100 * matched + whole DESC, matched DESC, line) AS k FROM h) WHERE k = 1)
  SELECT query_id, row_id, CAST(line AS INT) AS line, CAST(matched AS INT) AS matched, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, row_id, line) AS rank FROM b) WHERE rank <= 20""",
    "answer_text": rf"""WITH {_FOUND}, r AS (SELECT query_id, rank, {CITATION_SQL} AS citation, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM found JOIN chunks USING (row_id) WHERE rank <= 3)
  SELECT query_id, md5(string_agg('[' || rank || '] ' || citation || ': ' || CASE WHEN length(one) > 260 THEN rtrim(substr(one, 1, 257)) || '...' ELSE one END, chr(10) || chr(10) ORDER BY rank)) AS digest FROM r GROUP BY 1""",
    "output_budget": f"WITH {_FOUND} SELECT query_id, row_id, rank, used_bytes FROM (SELECT query_id, row_id, rank, CAST(sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_bytes FROM found JOIN chunks USING (row_id)) WHERE used_bytes <= 2000",
}
SQL["eval_gates"] = f"""WITH {_EVAL}, m AS (SELECT avg(recall_at_1) FILTER (answerable) AS r1, avg(recall_at_3) FILTER (answerable) AS r3, avg(recall_at_5) FILTER (answerable) AS r5, avg(recall_at_10) FILTER (answerable) AS r10, avg(precision_at_5) FILTER (answerable) AS p5,
    avg(reciprocal_rank) FILTER (answerable) AS mrr, avg(ndcg_at_10) FILTER (answerable) AS ndcg, count(*) FILTER (citation_hit) / nullif(count(citation_hit), 0) AS cite, count(*) FILTER (false_positive) / nullif(count(*) FILTER (NOT answerable), 0) AS fpr FROM cases),
  g AS (SELECT metric, direction, CAST(threshold AS DOUBLE) AS threshold, CASE metric WHEN 'recall_at_1' THEN r1 WHEN 'recall_at_3' THEN r3 WHEN 'recall_at_5' THEN r5 WHEN 'recall_at_10' THEN r10 WHEN 'precision_at_5' THEN p5 WHEN 'mrr_at_10' THEN mrr WHEN 'ndcg_at_10' THEN ndcg WHEN 'exact_citation_rate' THEN cite ELSE fpr END AS actual
    FROM (VALUES ('recall_at_1', 'minimum', 0.6), ('recall_at_3', 'minimum', 0.75), ('recall_at_5', 'minimum', 0.8), ('recall_at_10', 'minimum', 0.85), ('precision_at_5', 'minimum', 0.1), ('mrr_at_10', 'minimum', 0.65), ('ndcg_at_10', 'minimum', 0.75), ('exact_citation_rate', 'minimum', 0.9), ('false_positive_rate', 'maximum', 0.05)) t(metric, direction, threshold), m)
  SELECT metric, direction, threshold, actual IS NOT NULL AS applicable, coalesce(CASE WHEN direction = 'minimum' THEN actual >= threshold ELSE actual <= threshold END, false) AS passed FROM g"""
SQL["hash_embedding"] = f"WITH {_EMBED} SELECT documents.doc_id, round(CASE WHEN documents.text IS NULL THEN NULL ELSE greatest(max(v), CASE WHEN count(v) < 384 THEN 0 ELSE max(v) END) END, 6) AS largest, round(CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(sum(v * v), 0) END, 6) AS norm2 FROM documents LEFT JOIN emb USING (doc_id) GROUP BY documents.doc_id, documents.text"
#: A term and a token of the text that belong together.
_TERM_HIT = f"list_contains(own, term) OR len(list_filter(own, lambda token: {_RELATED})) > 0"
SQL["matched_terms"] = f"""WITH {_FOUND}, q AS (SELECT row_id AS query_id, {terms_sql('text')} AS terms FROM chunks WHERE row_id % 100 = 0 AND text IS NOT NULL), o AS (SELECT row_id, {tokens_sql('text')} AS own FROM chunks WHERE text IS NOT NULL)
  SELECT query_id, row_id, array_to_string(list_filter(terms, lambda term: {_TERM_HIT}), ' ') AS matched FROM found JOIN q USING (query_id) JOIN o USING (row_id)"""
SQL["staged_candidates"] = f"""WITH b AS (SELECT doc_id AS query_id, {terms_sql('text')} AS terms FROM documents WHERE doc_id % 100 = 0), l AS (SELECT query_id, list_sort(list_transform(terms, lambda t: {{'n': -length(t), 't': t}}))[1].t AS t FROM b WHERE len(terms) > 0),
  a AS (SELECT query_id, CASE WHEN query_id % 300 = 0 THEN 'notes/' || query_id || '.txt' ELSE substr(t, 1, 3) || substr(t, 5) END AS query FROM l), w AS (SELECT query_id, query, list_distinct({tokens_sql('query')}) AS tokens FROM a),
  tok AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), stat AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM tok), post AS (SELECT doc_id, token, any_value(n) AS len, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM tok) GROUP BY ALL),
  freq AS (SELECT token, count(*) AS df FROM post GROUP BY 1), asked AS (SELECT query_id, unnest(tokens) AS token FROM w WHERE len(tokens) > 0),
  part AS (SELECT doc_id, token, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM post JOIN freq USING (token), stat),
  full_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (SELECT query_id, doc_id AS key, round(sum(part), 9) AS score FROM asked JOIN part USING (token) GROUP BY ALL)) WHERE rank <= 50),
  first_ AS (SELECT query_id, query_id AS key, 0 AS stage, 1 AS rank, NULL AS score, 2 AS path_match FROM a WHERE query_id % 300 = 0 UNION ALL SELECT query_id, key, 1, rank, score, NULL FROM full_ WHERE NOT (query_id % 300 = 0 AND key = query_id)),
  short AS (SELECT w.*, coalesce(h, 0) AS have FROM w LEFT JOIN (SELECT query_id, count(*) AS h FROM first_ GROUP BY 1) USING (query_id) WHERE len(tokens) > 0 AND coalesce(h, 0) < 8),
  ids AS (SELECT query_id, have, list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}]+(?:[-_.][\\p{{L}}\\p{{N}}]+)+'), lambda x, i: true) AS ids, list_transform(list_slice(list_sort(list_transform(list_filter(tokens, lambda t: regexp_full_match(t, '[a-z0-9_.-]{{7,}}')), lambda t: {{'n': -length(t), 't': t}})), 1, 3), lambda x: x.t) AS rare FROM short),
  sup AS (SELECT query_id, have, unnest(ids) AS term, generate_subscripts(ids, 1) - 1 AS variant, 2.0 AS boost FROM ids UNION ALL SELECT query_id, have, unnest(rare), generate_subscripts(rare, 1) - 1 + len(ids), 1.25 FROM ids),
  own AS (SELECT query_id, have, variant, boost, regexp_full_match(term, '[a-z0-9_.-]{{7,}}') AS fuzzy, unnest({tokens_sql('term')}) AS token FROM sup),
  wide AS (SELECT query_id, have, variant, boost, token FROM own UNION SELECT query_id, have, variant, boost, f.token FROM own JOIN freq f ON fuzzy AND length(own.token) >= 7 AND regexp_full_match(own.token, '[a-z0-9_.-]+') AND regexp_full_match(f.token, '[a-z0-9_.-]+') AND substr(f.token, 1, 3) = substr(own.token, 1, 3) AND abs(length(f.token) - length(own.token)) <= 1 AND levenshtein(f.token, own.token) <= 1),
  got AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, key) AS rank FROM (SELECT query_id, have, variant, doc_id AS key, round(sum(part * boost), 9) AS score FROM wide JOIN part USING (token) GROUP BY ALL)),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY variant) AS n FROM got WHERE rank <= 50 AND (query_id, key) NOT IN (SELECT (query_id, key) FROM first_)) WHERE n = 1),
  size AS (SELECT query_id, variant, have + coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fresh GROUP BY query_id, have, variant),
  more AS (SELECT query_id, key, variant + 2 AS stage, rank, score FROM (SELECT f.*, before + row_number() OVER (PARTITION BY f.query_id, f.variant ORDER BY rank) AS pos FROM fresh f JOIN size USING (query_id, variant) WHERE before < 8) WHERE pos <= 50)
  SELECT query_id, key, CAST(stage AS INT) AS stage, score, CAST(path_match AS INT) AS path_match, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage, rank) AS INT) AS position FROM (SELECT * FROM first_ UNION ALL SELECT *, NULL FROM more)"""
