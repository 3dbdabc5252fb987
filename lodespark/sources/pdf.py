"""Text of PDF files page by page, with the standard library alone.

Reads objects, object streams and flate streams, follows the page tree, and runs the text operators of each page's
contents: codes become characters by the font's ToUnicode map, else as Latin-1. That covers text that programs write; pages
of images give no text and are what recognition is for. Encrypted files, and those beyond the limits, are errors.
"""

from __future__ import annotations

import re
import zlib

MOST_PAGES, MOST_CHARACTERS, MOST_STREAM = 1_000, 25_000_000, 50_000_000

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_TOKEN = re.compile(
    rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\((?:\\.|[^()\\])*(?:\((?:\\.|[^()\\])*\)(?:\\.|[^()\\])*)*\)|<[0-9A-Fa-f\s]*>|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][A-Za-z0-9'\"*]*", re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


class Ref(int):
    """The number of another object."""


def _string(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def put(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", put, raw[1:-1], flags=re.S)


def _tokens(data: bytes, at: int = 0):
    while at < len(data):
        m = _TOKEN.match(data, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if not m[0].isspace() and m[0][:1] != b"%":
            yield m[0]


def _values(data: bytes):
    """The values and operators of a piece of PDF: dicts, lists, strings as bytes, names and operators as text, numbers, Refs."""
    stack: list[list] = [[]]
    for t in _tokens(data):
        top = stack[-1]
        if t in (b"<<", b"["):
            stack.append([])
        elif t == b"]" and len(stack) > 1:
            stack[-2].append(stack.pop())
        elif t == b">>" and len(stack) > 1:
            own = stack.pop()
            stack[-1].append({k: v for k, v in zip(own[::2], own[1::2]) if isinstance(k, str)})
        elif t[:1] in b"(<" and t not in (b"<<", b">>"):
            top.append(_string(t))
        elif t[:1] == b"/":
            top.append(t.decode("latin-1"))
        elif t == b"R" and len(top) > 1 and isinstance(top[-2], (int, float)):
            top[-2:] = [Ref(int(top[-2]))]
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            top.append(float(t) if b"." in t else int(t))
        else:
            top.append(t.decode("latin-1"))
    return stack[0]


class Document:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("the PDF is encrypted")
        self.objects: dict[int, tuple[dict | list | bytes | int | float | str | None, bytes | None]] = {}
        self.fonts: dict[int, dict[bytes, str]] = {}
        places = [(int(m[1]), m.end()) for m in _OBJECT.finditer(data)]
        for k, (number, start) in enumerate(places):
            end = data.find(b"endobj", start)
            end = end if end >= 0 else places[k + 1][1] if k + 1 < len(places) else len(data)
            body = data[start:end]
            stream = None
            if (m := re.search(rb"stream\r?\n", body)) and b">>" in body[: m.start()]:
                stop = body.rfind(b"endstream")
                stream, body = body[m.end() : stop if stop >= 0 else len(body)], body[: m.start()]
            values = _values(body)
            self.objects[number] = (values[0] if values else None, stream)
        for value, stream in list(self.objects.values()):
            if isinstance(value, dict) and value.get("/Type") == "/ObjStm" and stream is not None:
                plain, first = self.plain(value, stream), int(self.get(value.get("/First")) or 0)
                heads = [int(x) for x in _values(plain[:first]) if isinstance(x, int)]
                spots = list(zip(heads[::2], heads[1::2]))
                for k, (number, offset) in enumerate(spots):
                    stop = spots[k + 1][1] + first if k + 1 < len(spots) else len(plain)
                    inside = _values(plain[first + offset : stop])
                    self.objects.setdefault(number, (inside[0] if inside else None, None))

    def get(self, value):
        """A value, or what a reference names."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value, (None, None))[0]
        return None

    def plain(self, head: dict, stream: bytes) -> bytes:
        filters = self.get(head.get("/Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) != "/FlateDecode":
                return b""  # images and what text is never packed in
            unpack = zlib.decompressobj()
            try:
                stream = unpack.decompress(stream, MOST_STREAM)
            except zlib.error:
                return b""
            if unpack.unconsumed_tail:
                raise PdfError("a stream is too large")
        return stream

    def pages(self) -> list[dict]:
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("/Type") == "/Catalog"]
        out: list[dict] = []

        def walk(node, given: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 60:
                return
            given = given | {k: node[k] for k in ("/Resources",) if k in node}
            if "/Kids" in node:
                for kid in self.get(node["/Kids"]) or []:
                    walk(kid, given, depth + 1)
            else:
                out.append(given | node)
                if len(out) > MOST_PAGES:
                    raise PdfError("the PDF has too many pages")

        for root in roots[-1:]:
            walk(root.get("/Pages"), {}, 0)
        return out

    def characters(self, font) -> dict[bytes, str]:
        """The ToUnicode map of a font."""
        key = int(font) if isinstance(font, Ref) else id(font)
        if key not in self.fonts:
            self.fonts[key] = {}
            own = self.get(font)
            named = own.get("/ToUnicode") if isinstance(own, dict) else None
            head, stream = self.objects.get(named, (None, None)) if isinstance(named, Ref) else (None, None)
            if stream is not None and isinstance(head, dict):
                self.fonts[key] = _unicode_map(self.plain(head, stream))
        return self.fonts[key]

    def text(self, page: dict) -> str:
        contents = page.get("/Contents")
        value = self.get(contents)
        parts = value if isinstance(value, list) else [contents]
        data = b"\n".join(self.plain(*self.objects[p]) for p in parts if isinstance(p, Ref) and p in self.objects and self.objects[p][1] is not None and isinstance(self.objects[p][0], dict))
        resources = self.get(page.get("/Resources")) or {}
        fonts = self.get(resources.get("/Font")) if isinstance(resources, dict) else None
        return _run(data, fonts if isinstance(fonts, dict) else {}, self)


def _unicode_map(data: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    words: list = []
    for v in _values(data):
        if v in ("beginbfchar", "beginbfrange"):
            words = []
        elif v == "endbfchar":
            out.update({a: b.decode("utf-16-be", "replace") for a, b in zip(words[::2], words[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)})
        elif v == "endbfrange":
            for a, b, to in zip(words[::3], words[1::3], words[2::3]):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(low, min(high, low + 65_535) + 1):
                    target = to[k - low] if isinstance(to, list) and k - low < len(to) else to
                    if isinstance(target, bytes):
                        last = int.from_bytes(target[-2:], "big") + (0 if isinstance(to, list) else k - low)
                        out[k.to_bytes(len(a), "big")] = (target[:-2] + (last & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
        else:
            words.append(v)
    return out


def _decoded(raw: bytes, table: dict[bytes, str]) -> str:
    if not table:
        return raw.decode("cp1252", "replace")
    size = max(map(len, table))
    return "".join(table.get(raw[k : k + size], "") for k in range(0, len(raw), size))


def _run(data: bytes, fonts: dict, document: Document) -> str:
    """The text that a page's operators show, with a line end where the line moves and a space where a gap is wide."""
    out: list[str] = []
    args: list = []
    table: dict[bytes, str] = {}

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for v in _values(data):
        if not isinstance(v, str) or v[:1] == "/":
            args.append(v)
            continue
        if v == "Tf" and args and isinstance(args[0], str):
            table = document.characters(fonts[args[0]]) if args[0] in fonts else {}
        elif v == "Tj" and args and isinstance(args[-1], bytes):
            out.append(_decoded(args[-1], table))
        elif v in ("'", '"') and args and isinstance(args[-1], bytes):
            line()
            out.append(_decoded(args[-1], table))
        elif v == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    out.append(_decoded(x, table))
                elif isinstance(x, (int, float)) and x < -180 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif v in ("Td", "TD") and len(args) >= 2 and isinstance(args[-1], (int, float)) and args[-1] != 0 or v in ("T*", "ET", "Tm"):
            line()
        elif v in ("Td", "TD") and out and not out[-1].endswith((" ", "\n")):
            out.append(" ")
        args = []
    return re.sub(r"[ \t]+\n", "\n", "".join(out)).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page, empty where there is none."""
    document = Document(data)
    out, size = [], 0
    for page in document.pages():
        out.append(document.text(page))
        size += len(out[-1])
        if size > MOST_CHARACTERS:
            raise PdfError("the PDF has too much text")
    if not out:
        raise PdfError("the PDF has no pages")
    return out
