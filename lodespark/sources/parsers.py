"""Text of files by their ending: Office and EPUB archives, HTML, XML, JSON, YAML, RTF and plain text.

A file's parse is one struct: text, located regions, and an error instead of an exception. Archives are read within
limits on entries and sizes. PDF pages are read by ``pdf``; those without text go to a command that recognises them, if one
is set under ``.pdf``, unless the cache of recognised pages has them.
"""

from __future__ import annotations

import functools
import hashlib
import html
import io
import json
import posixpath
import re
import subprocess
import threading
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.operators.maintenance import column_name, page_batches
from lodespark.sources import pdf
from lodespark.sources.logs import page_key

#: Limits of an archive: entries, bytes of an entry, bytes in all.
MOST_ENTRIES, MOST_ENTRY, MOST_TOTAL = 512, 25_000_000, 50_000_000
OUTPUT_CAP, TIMEOUT = 25_000_000, 120


class ParseError(ValueError):
    pass


# ---- built-in expressions --------------------------------------------------------------------------------------------


def rtf_plain(text: Column) -> Column:
    """RTF without control words, groups and escapes."""
    c = F.regexp_replace(text, r"\\par[d]?\b", "\n")
    c = F.regexp_replace(c, r"\\'[0-9a-fA-F]{2}", " ")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+-?\d* ?", "")
    return F.trim(F.regexp_replace(c, r"[{}]", ""))


def xml_plain(text: Column) -> Column:
    """XML without tags, entities decoded, white space single."""
    c = F.regexp_replace(F.regexp_replace(text, r"<!--[\s\S]*?-->", " "), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# ---- Python parsers --------------------------------------------------------------------------------------------------


class _Text(HTMLParser):
    _BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer table ul ol pre blockquote".split())
    _HIDDEN = frozenset("script style head title noscript template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in self._HIDDEN
        if tag in self._BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in self._HIDDEN and self.hidden > 0
        if tag in self._BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(source: str) -> str:
    """The visible text; links give their words, images nothing, lines aren't wrapped."""
    p = _Text()
    p.feed(source)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(p.out))).strip()


def json_text(source: str) -> str:
    try:
        return json.dumps(json.loads(source), indent=2, ensure_ascii=False)
    except ValueError:
        return source


def yaml_text(source: str) -> str:
    try:
        import yaml
    except ImportError:
        return source
    try:
        return yaml.safe_dump(yaml.safe_load(source), allow_unicode=True, sort_keys=False)
    except yaml.YAMLError:
        return source


def xml_text(source: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<!--[\s\S]*?-->", " ", source)))).strip()


def archive(content: bytes) -> dict[str, bytes]:
    """Entries of a zip file within the limits."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ParseError("not an archive") from e
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MOST_ENTRIES:
        raise ParseError("too many entries")
    if any(i.file_size > MOST_ENTRY for i in infos) or sum(i.file_size for i in infos) > MOST_TOTAL:
        raise ParseError("entries are too large")
    return {i.filename: z.read(i) for i in infos if re.search(r"\.(?:xml|rels|xhtml|html?|opf|ncx)$", i.filename)}


def _root(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:2000] and b"<!ENTITY" in data[:10000]:
        raise ParseError("entities are not read")
    return ElementTree.fromstring(data)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _paragraphs(root: ElementTree.Element, paragraph: str = "p", run: str = "t") -> list[str]:
    out = []
    for p in root.iter():
        if _name(p) == paragraph:
            parts = []
            for e in p.iter():
                if _name(e) == run and e.text:
                    parts.append(e.text)
                elif _name(e) == "tab":
                    parts.append("\t")
                elif _name(e) == "br":
                    parts.append("\n")
            if text := "".join(parts).strip():
                out.append(text)
    return out


def _numbered(names: Iterator[str], pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n)))


Part = tuple[str, str, int, int, str, str, str]  # text, kind, start, end, label, first cell, last cell


def docx_parts(e: dict[str, bytes]) -> list[Part]:
    if "word/document.xml" not in e:
        raise ParseError("no document")
    return [("\n\n".join(_paragraphs(_root(e["word/document.xml"]))), "", 0, 0, "", "", "")]


def pptx_parts(e: dict[str, bytes]) -> list[Part]:
    """Slides in the order of the presentation with their notes."""
    order = [n for _, n in _numbered(iter(e), r"ppt/slides/slide(\d+)\.xml")]
    if "ppt/presentation.xml" in e and "ppt/_rels/presentation.xml.rels" in e:
        target = {r.get("Id"): posixpath.normpath(posixpath.join("ppt", r.get("Target", ""))) for r in _root(e["ppt/_rels/presentation.xml.rels"])}
        ids = [v for x in _root(e["ppt/presentation.xml"]).iter() if _name(x) == "sldId" for k, v in x.attrib.items() if k.endswith("}id")]
        order = [target[i] for i in ids if target.get(i) in e] or order
    out = []
    for k, name in enumerate(order, 1):
        text = "\n".join(_paragraphs(_root(e[name])))
        rels = f"ppt/slides/_rels/{posixpath.basename(name)}.rels"
        for r in _root(e[rels]) if rels in e else ():
            notes = posixpath.normpath(posixpath.join("ppt/slides", r.get("Target", "")))
            if "notesSlide" in r.get("Type", "") and notes in e:
                text += "\n\n" + "\n".join(_paragraphs(_root(e[notes])))
        if text.strip():
            out.append((text.strip(), "slide", k, k, "", "", ""))
    return out


def xlsx_parts(e: dict[str, bytes]) -> list[Part]:
    """One part per row that isn't empty, cells joined by tabs."""
    shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in _root(e["xl/sharedStrings.xml"]) if _name(si) == "si"] if "xl/sharedStrings.xml" in e else []
    names = [x.get("name", "") for x in _root(e["xl/workbook.xml"]).iter() if _name(x) == "sheet"] if "xl/workbook.xml" in e else []
    out = []
    for k, (_, name) in enumerate(_numbered(iter(e), r"xl/worksheets/sheet(\d+)\.xml"), 1):
        label = names[k - 1] if k <= len(names) else f"Sheet{k}"
        for row in (x for x in _root(e[name]).iter() if _name(x) == "row"):
            cells = []
            for n, c in enumerate((x for x in row if _name(x) == "c"), 1):
                value = next((v.text or "" for v in c.iter() if _name(v) in ("v", "t")), "")
                if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells.append((c.get("r") or f"{column_name(n)}{row.get('r', '1')}", value.strip()))
            filled = [c for c in cells if c[1]]
            if filled:
                out.append(("\t".join(v for _, v in cells).strip(), "sheet", k, k, label, filled[0][0], filled[-1][0]))
    return out


def odf_parts(e: dict[str, bytes]) -> list[Part]:
    if "content.xml" not in e:
        raise ParseError("no content")
    out = []
    for name in ("meta.xml", "content.xml"):
        if name in e:
            texts = ["".join(x.itertext()).strip() for x in _root(e[name]).iter() if _name(x) in ("p", "h", "title", "subject", "description")]
            out += [t for t in texts if t]
    return [("\n\n".join(out), "", 0, 0, "", "", "")]


def epub_parts(e: dict[str, bytes]) -> list[Part]:
    """Entries in the order of the spine."""
    package = next((x.get("full-path") for x in _root(e["META-INF/container.xml"]).iter() if _name(x) == "rootfile"), None) if "META-INF/container.xml" in e else None
    package = package or next((n for n in e if n.endswith(".opf")), None)
    if package not in e:
        raise ParseError("no package")
    root, base = _root(e[package]), posixpath.dirname(package)
    items = {x.get("id"): posixpath.normpath(posixpath.join(base, x.get("href", ""))) for x in root.iter() if _name(x) == "item"}
    out = []
    for k, ref in enumerate((x.get("idref") for x in root.iter() if _name(x) == "itemref"), 1):
        if items.get(ref) in e and (text := html_text(e[items[ref]].decode("utf-8", "replace"))):
            title = re.search(r"<h[1-3][^>]*>(.*?)</h[1-3]>", e[items[ref]].decode("utf-8", "replace"), re.S)
            out.append((text, "epub", k, k, html_text(title[1]) if title else "", "", ""))
    return out


_ARCHIVES = {".docx": docx_parts, ".pptx": pptx_parts, ".xlsx": xlsx_parts, ".odt": odf_parts, ".ods": odf_parts, ".odp": odf_parts, ".epub": epub_parts}
_TEXTS = {".html": html_text, ".htm": html_text, ".json": json_text, ".ipynb": json_text, ".yaml": yaml_text, ".yml": yaml_text, ".xml": xml_text, ".svg": xml_text, ".rss": xml_text, ".atom": xml_text}


def run_command(command: tuple[str, ...], path: str, timeout: float = TIMEOUT, cap: int = OUTPUT_CAP, **values: str) -> str:
    """The output of an external reader: arguments as a list, {path} and other names replaced, no shell, time and output limited.

    It is read as it comes and the reader ended once it is beyond the cap or the time, first asked to, then killed.
    """
    args = [functools.reduce(lambda a, kv: a.replace("{" + kv[0] + "}", kv[1]), {"path": path, **values}.items(), a) for a in command]
    try:
        done = subprocess.Popen(args, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    except OSError as e:
        raise ParseError(f"the reader can't be run: {e}") from e
    late = threading.Event()
    timer = threading.Timer(timeout, lambda: (late.set(), done.terminate()))
    timer.start()
    out = bytearray()
    try:
        while piece := done.stdout.read1(1 << 16):
            out += piece
            if len(out) > cap:
                raise ParseError("the reader wrote too much")
        code = done.wait(5)
    except subprocess.TimeoutExpired:
        code = -1
    finally:
        timer.cancel()
        if done.poll() is None:
            done.terminate()
            try:
                done.wait(2)
            except subprocess.TimeoutExpired:
                done.kill()
                done.wait()
        done.stdout.close()
    if late.is_set():
        raise ParseError("the reader took too long")
    if code:
        raise ParseError(f"the reader ended with {code}")
    return out.decode("utf-8", "replace")


def pdf_parts(content: bytes, path: str, command: tuple[str, ...] | None, cached: dict[str, str] | None = None) -> list[Part]:
    """One part per page with text; blank pages come from ``cached`` by key, else from the command, in batches of {pages}.

    The command prints its pages with a form feed between them.
    """
    try:
        texts = pdf.pages(content)
    except pdf.PdfError as e:
        raise ParseError(str(e)) from e
    checksum = hashlib.sha256(content).hexdigest()
    blank = [k for k, t in enumerate(texts, 1) if not t]
    for k in blank:
        if cached and (key := page_key(checksum, k, command or ())) in cached:
            texts[k - 1] = cached[key]
    for own in page_batches([k for k in blank if not texts[k - 1]]) if command else ():
        read = run_command(command, path, pages=",".join(map(str, own))).split("\f")
        for k, t in zip(own, read):
            texts[k - 1] = t.strip()
    return [(t, "page", k, k, "", "", "") for k, t in enumerate(texts, 1) if t]


def parse(content: bytes, extension: str, path: str = "", commands: dict[str, tuple[str, ...]] | None = None, cached: dict[str, str] | None = None) -> list[Part]:
    """The located parts of a file."""
    if extension in _ARCHIVES:
        return _ARCHIVES[extension](archive(content))
    if extension == ".pdf":
        return pdf_parts(content, path, (commands or {}).get(".pdf"), cached)
    if commands and extension in commands:
        return [(run_command(commands[extension], path), "", 0, 0, "", "", "")]
    text = content.decode("utf-8", "replace").lstrip("﻿")
    if extension == ".rtf":
        text = re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", re.sub(r"\\'[0-9a-fA-F]{2}", " ", re.sub(r"\\pard?\b", "\n", text)))).strip()
    return [(_TEXTS[extension](text) if extension in _TEXTS else text, "", 0, 0, "", "", "")]


REGION = "struct<char_start:long, char_end:long, kind:string, first:int, last:int, label:string, cell_start:string, cell_end:string>"


def parsed(files: DataFrame, commands: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(relative_path, extension, checksum, bytes, mtime_ms, text, regions, error) of files with their content."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts, regions, errors = [], [], []
            for path, ext, content in zip(pdf["relative_path"], pdf["extension"], pdf["content"]):
                try:
                    parts, text, own = parse(bytes(content), ext, path, commands), "", []
                    for t, kind, a, b, label, c1, c2 in parts:
                        text += "\n\n" if text else ""
                        if kind:
                            own.append((len(text), len(text) + len(t), kind, a, b, label, c1, c2))
                        text += t
                    texts.append(text)
                    regions.append(own)
                    errors.append(None)
                except (ParseError, ElementTree.ParseError, UnicodeError, KeyError, RecursionError, zipfile.BadZipFile) as e:
                    texts.append(None)
                    regions.append([])
                    errors.append(str(e)[:200] or type(e).__name__)
            yield pdf.drop(columns=["content"]).assign(text=texts, regions=regions, error=errors)

    rows = files.select("relative_path", F.lower("extension").alias("extension"), "checksum", F.col("bytes").cast("long"), F.col("mtime_ms").cast("double"), "content")
    return rows.mapInPandas(run, f"relative_path string, extension string, checksum string, bytes long, mtime_ms double, text string, regions array<{REGION}>, error string")


@F.pandas_udf(T.StringType())
def parse_text(extension: pd.Series, text: pd.Series) -> pd.Series:
    """The plain text of a source text by the ending of its file; null stays null."""
    return pd.Series([None if t is None else _TEXTS.get(e, lambda x: x)(t) for e, t in zip(extension, text)])


__all__ = ["ParseError", "parse", "parse_text", "parsed", "rtf_plain", "run_command", "xml_plain"]
