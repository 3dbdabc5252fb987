"""Catalogue: text functions, redaction, citations, chunk coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import citations, queries, redaction, text
from lodespark.operators import candidates, chunking, predicates
from lodespark.session import table

#: What joins two letters or two digits to one token, with the private character that stands for it while a text is split.
_JOINS = [(".", "\ue000"), ("'", "\ue001"), ("’", "\ue002"), (":", "\ue003"), (",", "\ue004"), (";", "\ue005")]


def folded_sql(c: str) -> str:
    """Lower case without accents, for the characters that the tables hold."""
    return f"translate(lower(strip_accents(coalesce({c}, ''))), 'ºª，：；！？（）^`', 'oa,:;!?()')"


def tokens_sql(c: str) -> str:
    """Unicode word segments: ideographs alone, points, apostrophes and colons inside words, commas and semicolons inside numbers."""
    x = rf"regexp_replace({folded_sql(c)}, '([\p{{Han}}\p{{Hiragana}}])', ' \1 ', 'g')"
    for mark, put in _JOINS * 2:  # twice, as a letter may stand between two marks
        for kind in ["L"] * (mark in ".'’:") + ["N"] * (mark != ":"):
            plain = {".": r"\.", "'": "''"}.get(mark, mark)
            x = rf"regexp_replace({x}, '(\p{{{kind}}}){plain}(\p{{{kind}}})', '\1{put}\2', 'g')"
    private = "".join(p for _, p in _JOINS)
    split = rf"regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_\x{{AD}}{private}]+')"
    marks = "".join(m for m, _ in _JOINS).replace("'", "''")
    return rf"list_filter(list_transform({split}, lambda t: translate(t, '{private}', '{marks}')), lambda t: length(t) >= 2 OR regexp_matches(t, '[^\p{{Latin}}\p{{N}}]'))"


def distinct_sql(a: str) -> str:
    """Distinct elements of a list in the order of their first place."""
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def words_sql(c: str) -> str:
    """Normalised words of three characters or more that are no stop words."""
    return rf"list_filter(regexp_extract_all({folded_sql(c)}, '[\p{{L}}\p{{N}}]{{3,}}'), lambda t: t NOT IN ('about', 'avec', 'dans', 'des', 'for', 'les', 'pour', 'que', 'qui', 'sur', 'the', 'une', 'what'))"


def terms_sql(c: str, n: int = 8) -> str:
    return f"list_slice({distinct_sql(words_sql(c))}, 1, {n})"


def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def meaningful_terms(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(text.meaningful_terms(F.col("text")), " ").alias("terms"))


def snippets(s, d):
    return table(s, d, "chunks").select("row_id", text.snippet(F.col("text")).alias("snippet"))


def cleaned_text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.cleaned(F.col("text"))).alias("digest"))


def dehyphenated_text(s, d):
    return table(s, d, "chunks").select("row_id", F.md5(text.dehyphenated(F.col("text"))).alias("digest"))


def redacted_text(s, d):
    rows = table(s, d, "chunks").select("row_id", redaction.redact(F.col("text")).alias("redacted"))
    return rows.select("row_id", F.md5("redacted").alias("digest"), redaction.placeholders_in(F.col("redacted")).alias("placeholders"))


def redaction_counts(s, d):
    rows = table(s, d, "chunks")
    cols = [F.sum(redaction.match_count(F.col("text"), n)).cast("long").alias(n) for n, _, _ in redaction.PATTERNS]
    return rows.agg(*cols)


def luhn_cards(s, d):
    rows = table(s, d, "chunks").select("row_id", "text").where(redaction.gated(F.col("text"), "credit_card")).select("row_id", F.explode(redaction.card_numbers(F.col("text"))).alias("card"))
    return rows.select("row_id", F.regexp_replace("card", "[^0-9]", "").alias("digits"))


def custom_redaction(s, d):
    from lodespark.config import RedactionRule

    rules = [RedactionRule("hex_token", r"\b[0-9a-f]{40}\b"), RedactionRule("reference", r"\bEV-\d{5}-[A-Z]{2}\b", replacement="[REF]")]
    return table(s, d, "chunks").select("row_id", F.md5(redaction.redact(F.col("text"), rules)).alias("digest"))


def citation_strings(s, d):
    return table(s, d, "chunks").select("row_id", citations.of_chunks().alias("citation"))


def citation_parts(s, d):
    c = citations.of_chunks()
    return table(s, d, "chunks").select("row_id", citations.cited_path(c).alias("path"), citations.cited_index(c).alias("cited_chunk"))


def query_sanitize(s, d):
    rows = table(s, d, "documents").select("doc_id", queries.sanitized(F.col("text")).alias("q"))
    return rows.select("doc_id", "q.method", F.col("q.query").alias("query"))


def research_expansions(s, d):
    rows = table(s, d, "documents").select("doc_id", queries.research_queries(F.col("text")).alias("q"))
    return rows.select("doc_id", F.size("q").alias("n"), F.md5(F.array_join("q", "|")).alias("digest"))


def prompt_route(s, d):
    rows = table(s, d, "chunks").select("row_id", queries.routed(F.col("text")).alias("r"))
    return rows.select("row_id", "r.use", "r.confidence", "r.tool", F.array_join(F.col("r.signals").cast("array<string>"), ",").alias("signals"))


def path_prefix_filter(s, d):
    return table(s, d, "chunks").where(predicates.search_predicate(["./services", "legal/claims/"], ["services/worker"])).select("row_id", "relative_path")


def context_prefix_filter(s, d):
    return table(s, d, "chunks").where(predicates.search_predicate(contexts=["$", "Cable", "Terms"])).select("row_id", "context_path")


def exact_path_lookup(s, d):
    """Every path and every name of a file looked up as a query."""
    files = table(s, d, "manifest_files").select("relative_path", F.xxhash64("relative_path").alias("key"))
    asked = files.select(F.explode(F.array("relative_path", F.substring_index("relative_path", "/", -1))).alias("query")).distinct()
    found = candidates.path_rows(files, asked.withColumn("query_id", F.col("query")))
    return found.join(files, "key").select(F.col("query_id").alias("query"), "relative_path", F.col("path_match").alias("match"))


def chunk_lines(s, d):
    rows = table(s, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text").cast("int"), F.lit(200))).alias("position"))
    return rows.select("doc_id", "position", chunking.line_number(F.col("text"), F.col("position")).alias("line"))


def chunk_ids(s, d):
    return table(s, d, "chunks").select("row_id", chunking.chunk_id(F.col("relative_path"), F.col("chunk_index"), F.col("context_path"), F.col("text")).alias("chunk_id"))


def search_texts(s, d):
    return table(s, d, "chunks").select("row_id", F.md5(chunking.search_text(F.col("context_path"), F.col("text"))).alias("digest"))


def joined_parts(s, d):
    return chunking.joined_parts(table(s, d, "chunks").where("text is not null"), "relative_path", "row_id", "text").select("row_id", "part_start", "part_end")


def page_overlap(s, d):
    """Chunks against the pages of their parsed file by characters."""
    pages = table(s, d, "parsed_files").where("pages is not null and error is null").groupBy("relative_path").agg(F.min_by("pages", F.struct("parsed_at", "checksum")).alias("pages"))
    rows = table(s, d, "chunks").where("char_start is not null and char_end is not null").select("row_id", "relative_path", "char_start", "char_end")
    return chunking.with_pages(rows.join(pages.select("relative_path"), "relative_path", "left_semi"), pages).select("row_id", "page_start", "page_end")


def chunk_documents(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id"), "text", F.concat(F.lit("."), "doc_format").alias("extension"))
    return chunking.chunked(docs, key="doc_id").select("doc_id", "chunk_index", "context_path", "char_start", "char_end", "line_start", "line_end", "id")


def rtf_text(s, d):
    from lodespark.sources.parsers import rtf_plain

    return table(s, d, "documents").select("doc_id", F.md5(rtf_plain(F.concat(F.lit("{\\rtf1\\ansi "), F.col("text"), F.lit("\\par}")))).alias("digest"))


def xml_text(s, d):
    from lodespark.sources.parsers import xml_plain

    return table(s, d, "chunks").where("relative_path like '%.xml'").select("row_id", xml_plain(F.col("text")).alias("plain"))


def json_pretty(s, d):
    from lodespark.sources.parsers import parse_text

    rows = table(s, d, "chunks").where("relative_path like '%.json' and text is not null")
    return rows.select("row_id", F.md5(parse_text(F.lit(".json"), F.col("text"))).alias("digest"))


def html_to_text_rows(s, d):
    from lodespark.sources.parsers import parse_text

    rows = table(s, d, "chunks").where("relative_path like '%.html' and text is not null")
    return rows.select("row_id", parse_text(F.lit(".html"), F.concat(F.lit("<html><body><p>"), F.col("text"), F.lit("</p></body></html>"))).alias("plain"))


QUERIES = {f.__name__: f for f in (
    token_counts, meaningful_terms, snippets, cleaned_text, dehyphenated_text, redacted_text, redaction_counts, luhn_cards, custom_redaction, citation_strings, citation_parts, query_sanitize,
    research_expansions, prompt_route, path_prefix_filter, context_prefix_filter, exact_path_lookup, chunk_lines, chunk_ids, search_texts, joined_parts, page_overlap, chunk_documents, rtf_text, xml_text, json_pretty, html_to_text_rows,
)}


def _q(x: str) -> str:
    return x.replace("'", "''")


def _redact_sql(c: str) -> str:
    out = c
    for name, pattern, fold in redaction.PATTERNS[:-1]:
        out = f"regexp_replace({out}, '{_q(pattern)}', '{redaction.placeholder(name)}', '{'gi' if fold else 'g'}')"
    return out


_CARD = _q(redaction.PATTERNS[-1][1])
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""(length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN TRY_CAST(c AS INT) ELSE (TRY_CAST(c AS INT) * 2) // 10 + (TRY_CAST(c AS INT) * 2) % 10 END)) % 10 = 0)"""


def _cards(c: str) -> str:
    return f"list_filter(regexp_extract_all({c}, '{_CARD}'), lambda m: {_LUHN})"


def _redacted() -> str:
    return f"WITH a AS (SELECT row_id, {_redact_sql('text')} AS x FROM chunks), b AS (SELECT row_id, array_to_string(list_transform(string_split(regexp_replace(x, '{_CARD}', chr(1) || '\\0' || chr(1), 'g'), chr(1)), lambda m, k: CASE WHEN k % 2 = 0 AND {_LUHN} THEN '[REDACTED_CREDIT_CARD]' ELSE m END), '') AS x FROM a)"


_COUNT = [f"""CAST(coalesce(sum(len(regexp_extract_all(text, '{"(?i)" if f else ""}{_q(p)}'))), 0) AS BIGINT) AS {n}""" for n, p, f in redaction.PATTERNS[:-1]] + [f"CAST(coalesce(sum(len({_cards('text')})), 0) AS BIGINT) AS credit_card"]

_ENC = "replace(replace(replace(replace(replace(replace(url_encode(trim(location_label)), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~'), '%2A', '*')"


def _span(p: str, a: str, b: str) -> str:
    return f"':{p}' || {a} || CASE WHEN {b} > 0 AND {b} <> {a} THEN '-{p}' || {b} ELSE '' END"


CITATION_SQL = f"""relative_path || CASE WHEN page_start > 0 THEN {_span('p', 'page_start', 'page_end')} WHEN location_kind = 'slide' AND location_start > 0 THEN {_span('slide', 'location_start', 'location_end')}
  WHEN location_kind = 'epub' AND location_start > 0 THEN {_span('spine', 'location_start', 'location_end')}
  WHEN location_kind = 'sheet' THEN CASE WHEN coalesce(trim(location_label), '') <> '' THEN ':sheet=' || {_ENC} WHEN location_start > 0 THEN ':sheet=' || location_start ELSE '' END
    || CASE WHEN regexp_matches(coalesce(cell_start, ''), '^[A-Z]+[0-9]+$') THEN ':cells=' || cell_start || CASE WHEN regexp_matches(coalesce(cell_end, ''), '^[A-Z]+[0-9]+$') AND cell_end <> cell_start THEN '-' || cell_end ELSE '' END ELSE '' END
  ELSE '' END || CASE WHEN line_start > 0 AND line_end > 0 THEN ':L' || line_start || '-L' || line_end ELSE '' END || '#' || chunk_index"""

_ONE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_USABLE = r"length(s) BETWEEN 10 AND 250 AND regexp_matches(s, '[\p{L}\p{N}]')"
_SANITIZE = rf"""WITH a AS (SELECT doc_id, text, {_ONE} AS one FROM documents),
  b AS (SELECT *, list_filter(list_transform(regexp_extract_all(one, '[^.?!]*[.?!]?'), lambda s: trim(s)), lambda s: ends_with(s, '?') AND {_USABLE})[-1] AS question,
    list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: regexp_matches(s, '(?i)^(?:{'|'.join(queries.LABELS)})\s*:')), lambda s: trim(regexp_replace(s, '^[^:]*:', ''))), lambda s: {_USABLE})[-1] AS label,
    list_filter(list_transform(regexp_split_to_array(one, '[.?!]'), lambda s: trim(s)), lambda s: {_USABLE})[-1] AS sentence FROM a)
  SELECT doc_id, CASE WHEN length(one) <= 250 THEN 'passthrough' WHEN question IS NOT NULL THEN 'question' WHEN label IS NOT NULL THEN 'labeled-tail' WHEN sentence IS NOT NULL THEN 'tail-sentence' WHEN one IS NOT NULL THEN 'tail' END AS method,
    CASE WHEN length(one) <= 250 THEN one ELSE trim(substr(coalesce(question, label, sentence, right(one, 200)), 1, 250)) END AS query FROM b"""


def _suffix_lists() -> str:
    arrays = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in queries.SUFFIXES.items()}
    french = r"[àâçéèêëîïôùûüÿœÀÂÇÉÈÊËÎÏÔÙÛÜŸŒ]|(?i)(?:\b(?:avec|dans|des|exigences|les|politique|pour|quelle?|règles?|une)\b)"
    return rf"CASE WHEN regexp_matches(one, '\p{{Thai}}') THEN {arrays['thai']} WHEN regexp_matches(one, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]') THEN {arrays['cjk']} WHEN regexp_matches(one, '{french}') THEN {arrays['french']} ELSE {arrays['other']} END"


def _route_sql() -> str:
    """The routing of prompts, written out."""
    yes = lambda p: f"regexp_matches(p, '(?i){_q(p)}')"
    weights = [
        (0.45, r"\b(lodespark|lodespark_(search|ask|research)|local rag|knowledge base)\b"),
        (0.28, r"\bmcp\b.+\b(lodespark|local|repo|repository|context|knowledge|docs|agents?)\b|\b(lodespark|local|repo|repository|context|knowledge|docs|agents?)\b.+\bmcp\b"),
        (0.35, r"\b(this|current|local|target)\s+(repo|repository|project|workspace|codebase)\b"),
        (0.34, r"(^|\s)([\w.-]+/[\w./-]+|\.[\w-]+/[\w./-]+|[\w-]+\.(mdx?|txt|tsx?|jsx?|jsonl?|yaml|yml|toml|csv|pdf|docx|xlsx|pptx|rs|go|py|java|rb|php|astro))(\s|$)"),
        (0.25, r"\b(local|private|confidential|internal|sources?|documents?|docs|evidence|citations?|cited|passages?)\b"),
        (0.25, r"\b(what|how|why|where|which|comment|pourquoi|quel|quelle)\b.+\b(local|private|confidential|sources?|documents?|docs|evidence|citations?)\b"),
        (0.26, r"\b(architecture|implementation plan|release readiness|migration|refactor|audit|review|risks?|decisions?|history|previous|existing behavior|how does .+ work)\b"),
        (0.28, r"\b(agents?|codex|claude|cline|opencode|kimi)\b.+\b(context|evidence|docs|repo|repository|knowledge)\b"),
        (0.20, r"\b(find|search|where is|which file|what file|show me|cite|quote|source)\b"),
        (-0.35, r"^(translate|traduis|rewrite|rephrase|corrige|fix grammar|improve this sentence)\b"),
        (-0.30, r"\b(current time|current date|today's date|date du jour|heure actuelle|weather)\b"),
        (-0.18, r"^(what is|explain|define|c'est quoi|explique)\b"),
    ]
    total = " + ".join(["0.12"] + [f"CASE WHEN {yes(p)} THEN {w} ELSE 0 END" for w, p in weights])
    signals = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {yes(p)} THEN {k} END" for k, (_, p) in enumerate(weights, 1)) + "], lambda x: x IS NOT NULL), ',')"
    tools = [
        ("research", r"\b(audit|review|plan|strategy|architecture|investigate|debug|risks?|release readiness|migration|refactor|summari[sz]e|synthesi[sz]e|compare|why)\b"),
        ("status", r"\b(status|doctor|ready|readiness|setup|configured|index fresh|stale index)\b"), ("search", r"\b(find|search|where is|which file|what file|show me|cite|quote|exact|passage|source)\b"),
        ("ask", r"\b(how|why|what|when|where|who|comment|pourquoi|quoi|quel|quelle)\b|\?"),
    ]
    tool = " ".join(f"WHEN {yes(p)} THEN '{n}'" for n, p in tools)
    return rf"""WITH a AS (SELECT row_id, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 1200) AS p FROM chunks),
  b AS (SELECT *, CASE WHEN p = '' THEN 0.0 ELSE round(CAST(greatest(0.0, least(0.95, {total})) AS DOUBLE), 2) END AS confidence, {signals} AS signals FROM a)
  SELECT row_id, p <> '' AND (signals = '1' OR starts_with(signals, '1,') OR confidence >= 0.55) AS use, confidence, CASE WHEN p <> '' AND (signals = '1' OR starts_with(signals, '1,') OR confidence >= 0.55) THEN CASE {tool} ELSE 'search' END ELSE 'none' END AS tool, signals FROM b"""


SQL = {
    "token_counts": f"SELECT doc_id, CAST(len(t) AS INT) AS tokens, CAST(len(list_distinct(t)) AS INT) AS distinct_tokens FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "meaningful_terms": f"SELECT doc_id, array_to_string(list_slice({distinct_sql('w')}, 1, 8), ' ') AS terms FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)",
    "snippets": rf"SELECT row_id, CASE WHEN length(one) > 260 THEN rtrim(substr(one, 1, 257)) || '...' ELSE one END AS snippet FROM (SELECT row_id, {_ONE} AS one FROM chunks)",
    "cleaned_text": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9+/]{240,}={0,2}', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents",
    "dehyphenated_text": r"SELECT row_id, md5(regexp_replace(text, '([\p{L}\p{N}])-\n(\p{Ll})', '\1\2', 'g')) AS digest FROM chunks",
    "redacted_text": rf"{_redacted()} SELECT row_id, md5(x) AS digest, CAST(len(regexp_extract_all(x, '\[REDACTED_[A-Z_]+\]')) AS INT) AS placeholders FROM b",
    "redaction_counts": "SELECT " + ", ".join(_COUNT) + " FROM chunks",
    "luhn_cards": f"SELECT row_id, regexp_replace(card, '[^0-9]', '', 'g') AS digits FROM (SELECT row_id, unnest({_cards('text')}) AS card FROM chunks WHERE text IS NOT NULL)",
    "custom_redaction": rf"{_redacted()} SELECT row_id, md5(regexp_replace(regexp_replace(x, '\b[0-9a-f]{{40}}\b', '[REDACTED_HEX_TOKEN]', 'g'), '\bEV-\d{{5}}-[A-Z]{{2}}\b', '[REF]', 'g')) AS digest FROM b",
    "citation_strings": f"SELECT row_id, {CITATION_SQL} AS citation FROM chunks",
    "citation_parts": "SELECT row_id, relative_path AS path, chunk_index AS cited_chunk FROM chunks",
    "query_sanitize": _SANITIZE,
    "research_expansions": f"""WITH a AS (SELECT doc_id, trim(text) AS one FROM documents), w AS (SELECT doc_id, one, {words_sql('one')} AS w FROM a),
  b AS (SELECT doc_id, list_filter(list_concat([one, array_to_string(list_slice({distinct_sql('w')}, 1, 8), ' ')], list_transform({_suffix_lists()}, lambda s: one || ' ' || s)), lambda q: length(q) > 0) AS every FROM w),
  c AS (SELECT doc_id, list_slice({distinct_sql('every')}, 1, 5) AS q FROM b) SELECT doc_id, CAST(len(q) AS INT) AS n, md5(array_to_string(q, '|')) AS digest FROM c""",
    "prompt_route": _route_sql(),
    "path_prefix_filter": """SELECT row_id, relative_path FROM chunks WHERE (relative_path = 'services' OR starts_with(relative_path, 'services/') OR relative_path = 'legal/claims' OR starts_with(relative_path, 'legal/claims/'))
  AND NOT (relative_path = 'services/worker' OR starts_with(relative_path, 'services/worker/'))""",
    "context_prefix_filter": "SELECT row_id, context_path FROM chunks, (VALUES ('$'), ('Cable'), ('Terms')) p(x) WHERE context_path = x OR starts_with(context_path, x || ' > ') OR starts_with(context_path, x || '.') OR starts_with(context_path, x || '[')",
    "exact_path_lookup": """WITH q AS (SELECT DISTINCT unnest([relative_path, regexp_extract(relative_path, '[^/]*$')]) AS query FROM manifest_files)
  SELECT query, relative_path, CASE WHEN relative_path = query AND contains(query, '/') THEN 2 ELSE 1 END AS match FROM manifest_files JOIN q ON regexp_extract(relative_path, '[^/]*$') = regexp_extract(query, '[^/]*$')
  WHERE regexp_full_match(query, '(?i)[\\p{L}\\p{N}_. /\\\\-]+\\.[a-z0-9]{1,12}')""",
    "chunk_lines": "SELECT doc_id, CAST(k AS INT) AS position, CAST(1 + length(substr(text, 1, k)) - length(replace(substr(text, 1, k), chr(10), '')) AS INT) AS line FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1, 200)) AS k FROM documents)",
    "chunk_ids": "SELECT row_id, sha256(concat_ws(':', relative_path, chunk_index, coalesce(context_path, ''), text)) AS chunk_id FROM chunks",
    "search_texts": "SELECT row_id, md5(CASE WHEN coalesce(context_path, '') = '' THEN text ELSE context_path || chr(10) || text END) AS digest FROM chunks",
    "joined_parts": """SELECT row_id, CAST(s AS BIGINT) AS part_start, CAST(s + length(text) AS BIGINT) AS part_end FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY relative_path ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM chunks WHERE text IS NOT NULL)""",
    "page_overlap": """WITH p AS (SELECT relative_path, min_by(pages, {'a': parsed_at, 'b': checksum}) AS pages FROM parsed_files WHERE pages IS NOT NULL AND error IS NULL GROUP BY 1),
  c AS (SELECT row_id, list_transform(list_filter(pages, lambda p: p.char_end > char_start AND p.char_start < char_end), lambda p: p.page_number) AS n FROM chunks JOIN p USING (relative_path) WHERE char_start IS NOT NULL AND char_end IS NOT NULL)
  SELECT row_id, list_min(n) AS page_start, list_max(n) AS page_end FROM c""",
}
