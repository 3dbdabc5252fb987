"""Chunks of documents with exact coordinates: structure, regions, fences, natural ends, lines and pages.

Positions are code points. The whole step runs in one Arrow stage over the documents; a document is the unit of work.
Null and empty texts have no chunks.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.session import spread

#: Least share of the size at which a break of a kind ends a chunk.
PARAGRAPH, SENTENCE, LINE, SPACE = 0.45, 0.55, 0.65, 0.75
_ENDS = ((". ", 1), ("? ", 1), ("! ", 1), ("。", 1), ("？", 1), ("！", 1))
MARKDOWN = (".md", ".mdx", ".markdown", ".mdown")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


@dataclass(frozen=True)
class Region:
    start: int
    end: int
    context: str = ""


@dataclass(frozen=True)
class Chunk:
    index: int
    start: int
    end: int
    context: str
    text: str
    line_start: int
    line_end: int


def _lines(text: str) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, min(at + len(line) + 1, len(text)), line))
        at += len(line) + 1
    return out


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced blocks; an unclosed one runs to the end."""
    out, opened = [], None
    for start, end, line in _lines(text):
        if m := _FENCE.match(line):
            if opened is None:
                opened = (m[1][0], start)
            elif opened[0] == m[1][0]:
                out.append((opened[1], end))
                opened = None
    return out + ([(opened[1], len(text))] if opened else [])


def markdown_regions(text: str) -> list[Region]:
    """Sections with the path of their headings; headings in fences don't count."""
    hidden = fences(text)
    heads: list[tuple[int, int, str]] = []
    lines = _lines(text)
    for k, (start, _, line) in enumerate(lines):
        if any(a <= start < b for a, b in hidden):
            continue
        if m := _HEADING.match(line):
            heads.append((start, len(m[1]), re.sub(r"\s+", " ", m[2]).strip()))
        elif k + 1 < len(lines) and line.strip() and not any(a <= lines[k + 1][0] < b for a, b in hidden) and (m := _UNDERLINE.match(lines[k + 1][2])):
            heads.append((start, 1 if m[1][0] == "=" else 2, re.sub(r"\s+", " ", line).strip()))
    if not heads:
        return []
    out = [Region(0, heads[0][0])] if heads[0][0] else []
    stack: list[tuple[int, str]] = []
    for k, (start, level, title) in enumerate(heads):
        stack = [s for s in stack if s[0] < level] + [(level, title)]
        out.append(Region(start, heads[k + 1][0] if k + 1 < len(heads) else len(text), " > ".join(t for _, t in stack)))
    return out


def jsonl_regions(text: str, size: int) -> list[Region]:
    """Runs of entries that fit the size; each region's context is that of its first entry."""
    out: list[Region] = []
    first = last = None
    number = 0
    at = 0
    for start, end, line in _lines(text):
        if not line.strip():
            continue
        if first is not None and end - first > size:
            out.append(Region(first, last, f"$[{at}]"))
            first = None
        if first is None:
            first, at = start, number
        last = end
        number += 1
    return out + ([Region(first, last, f"$[{at}]")] if first is not None else [])


def json_regions(text: str, size: int) -> list[Region]:
    """Nodes of a JSON text with their paths; neighbours of one parent go together while they fit the size."""
    try:
        json.loads(text)
    except ValueError:
        return []
    nodes: list[tuple[int, int, str, str]] = []
    decoder = json.JSONDecoder()
    space = re.compile(r"[ \t\r\n]*")

    def skip(k: int) -> int:
        return space.match(text, k).end()

    def walk(k: int, path: str, parent: str, depth: int) -> int:
        k = skip(k)
        end = decoder.raw_decode(text, k)[1]
        if end - k <= size or text[k] not in "{[" or depth > 40:
            nodes.append((k, end, path, parent))
            return end
        inside, n, opened = k + 1, 0, text[k]
        while (inside := skip(inside)) < end - 1:
            begin, own = inside, f"{path}[{n}]"
            if opened == "{":
                name, inside = decoder.raw_decode(text, inside)
                own = f"{path}.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"{path}[{json.dumps(name)}]"
                inside = skip(inside) + 1
            before = len(nodes)
            inside = skip(walk(inside, own, path, depth + 1))
            if len(nodes) == before + 1 and nodes[-1][2] == own:
                nodes[-1] = (begin, nodes[-1][1], own, path)
            inside, n = inside + (text[inside : inside + 1] == ","), n + 1
        return end

    walk(0, "$", "", 0)
    out: list[Region] = []
    parents: list[str] = []
    for s, e, path, parent in nodes:
        if out and parents[-1] == parent and e - out[-1].start <= size:
            out[-1] = Region(out[-1].start, e, parent or "$")
        else:
            out.append(Region(s, e, path))
            parents.append(parent)
    return out


def structural_regions(text: str, extension: str, size: int) -> list[Region]:
    if extension in MARKDOWN:
        return markdown_regions(text)
    if extension == ".json":
        return json_regions(text, size)
    if extension in (".jsonl", ".ndjson"):
        return jsonl_regions(text, size)
    return []


def chunk_end(text: str, at: int, size: int, stop: int, hidden: list[tuple[int, int]]) -> int:
    """Where the chunk from ``at`` ends: the region, a fence that fits, or the last natural break that leaves enough."""
    hard = min(at + size, stop)
    if hard == stop:
        return hard
    fence = next(((a, b) for a, b in hidden if a < hard < b), None)
    if fence and fence[1] <= stop and fence[1] - fence[0] <= size:
        return fence[0] if fence[0] > at else fence[1]
    last = lambda s: text.rfind(s, at, hard) - at
    if (k := last("\n\n")) > size * PARAGRAPH:
        return at + k
    if (k := max((last(s) + n if last(s) >= 0 else -1) for s, n in _ENDS)) > size * SENTENCE:
        return at + k
    if (k := last("\n")) > size * LINE:
        return at + k
    if (k := last(" ")) > size * SPACE:
        return at + k
    return hard


def chunks(text: str, size: int = 1200, overlap: int = 200, regions: list[Region] | None = None, extension: str = "") -> list[Chunk]:
    """Chunks of a text: regions given, else those of its structure, else the whole; the index runs through all."""
    if not text:
        return []
    regions = regions or structural_regions(text, extension, size) or [Region(0, len(text))]
    hidden = fences(text) if extension in MARKDOWN else []
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda k: bisect.bisect_left(breaks, k) + 1
    out: list[Chunk] = []
    for region in regions:
        at = region.start
        while at < region.end:
            end = chunk_end(text, at, size, region.end, hidden)
            piece = text[at:end]
            s = at + len(piece) - len(piece.lstrip())
            e = end - (len(piece) - len(piece.rstrip()))
            if s < e:
                out.append(Chunk(len(out), s, e, region.context, text[s:e], line(s), line(e - 1)))
            if end >= region.end:
                break
            back = max(end - overlap, at + 1, region.start)
            inside = next((a for a, b in hidden if a < back < b), None)
            at = end if any(a == end for a, _ in hidden) else inside if inside is not None and inside > at else back
    return out


def chunk_id(path: Column, index: Column, context: Column, text: Column) -> Column:
    """SHA-256 of path, index, context and text joined by colons."""
    return F.sha2(F.concat_ws(":", path, index.cast("string"), F.coalesce(context, F.lit("")), text), 256)


def search_text(context: Column, text: Column) -> Column:
    """The context, a line end and the text, or the text alone."""
    return F.when(F.coalesce(context, F.lit("")) == "", text).otherwise(F.concat(context, F.lit("\n"), text))


def chunked(df: DataFrame, size: int = 1200, overlap: int = 200, key: str = "relative_path", text: str = "text", extension: str | None = "extension") -> DataFrame:
    """The chunks of documents: (key, chunk_index, context_path, text, char_start, char_end, line_start, line_end, id)."""
    names = [key, "chunk_index", "context_path", "text", "char_start", "char_end", "line_start", "line_end"]
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[] for _ in names]
            for k, t, x in zip(*(c.to_pylist() for c in batch.columns)):
                for c in chunks(t, size, overlap, extension=x or ""):
                    for column, value in zip(out, (k, c.index, c.context, c.text, c.start, c.end, c.line_start, c.line_end)):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    ext = F.lower(F.col(extension)) if extension and extension in df.columns else F.lit("")
    rows = spread(df.where(F.length(text) > 0).select(F.col(key), F.col(text).alias("text"), ext.alias("extension")), key)
    made = rows.mapInArrow(run, f"`{key}` {kind}, chunk_index int, context_path string, text string, char_start long, char_end long, line_start int, line_end int")
    return made.withColumn("id", chunk_id(F.col(key).cast("string"), F.col("chunk_index"), F.col("context_path"), F.col("text")))


def with_pages(chunks_: DataFrame, pages: DataFrame, key: str = "relative_path") -> DataFrame:
    """Chunks with the first and last page that their characters overlap; ``pages`` has (key, pages array)."""
    own = pages.select(key, "pages")
    hit = F.filter("pages", lambda p: (p["char_end"] > F.col("char_start")) & (p["char_start"] < F.col("char_end")))
    numbers = F.transform(hit, lambda p: p["page_number"])
    return chunks_.join(own, key, "left").withColumn("page_start", F.array_min(numbers)).withColumn("page_end", F.array_max(numbers)).drop("pages")


def first_region(regions: Column, start: Column) -> Column:
    """The region that places a chunk: the first one that ends after its start, else the first."""
    return F.coalesce(F.get(F.filter(regions, lambda r: r["char_end"] > start), F.lit(0)), F.get(regions, F.lit(0)))


def _spans_udf(made):
    """A column of (char_start, char_end, context) structs from a function of a text."""
    kind = T.ArrayType(T.StructType([T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()), T.StructField("context", T.StringType())]))

    @F.pandas_udf(kind)
    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"char_start": s, "char_end": e, "context": c} for s, e, c in made(t)] if t else [])

    return spans


def region_spans(extension: str, size: int):
    """Structural regions of texts of one kind as a column function."""
    return _spans_udf(lambda t: [(r.start, r.end, r.context) for r in structural_regions(t, extension, size)])


fence_spans = _spans_udf(lambda t: [(s, e, "") for s, e in fences(t)])


def line_number(text: Column, offset: Column) -> Column:
    """The line of a position: one more than the line ends before it."""
    return 1 + F.length(F.substring(text, 1, offset)) - F.length(F.replace(F.substring(text, 1, offset), F.lit("\n"), F.lit("")))


def joined_parts(df: DataFrame, key: str, order: str, text: str, gap: int = 2, block: int = 10_000) -> DataFrame:
    """Where each part begins and ends when the parts of a key are joined by blank lines; ``order`` is a whole number.

    The sums of blocks of the order come first, so a key with many parts is spread over tasks.
    """
    size = F.length(text) + gap
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.sum(size).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    rows = rows.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    own = F.sum(size).over(Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_before") + F.coalesce(own, F.lit(0))
    return rows.withColumn("part_start", start).withColumn("part_end", start + F.length(text)).drop("_block", "_key", "_b", "_before")
