"""Credentials in source code and configuration: found by issuer format or by the name they are assigned to, then masked.

A keyword automaton passes over each file first and says which kinds of format can be in it; only these are matched.
Matches are checked for structure: the checksum of issuers that have one and the header of web tokens prove a value;
without such a proof it needs the length and alphabet of the format and characters as varied as a key's, as issuers don't
publish all checksums. Placeholders and references are none. The mask has the length and alphabet of the value (hex stays
hex, base32 base32, base64 decodes), so code around it still parses and runs.

Null and empty texts have no credentials; a file of any length is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.session import spread

#: Endings and names of source code and configuration files.
CODE_ENDINGS = (
    "bash bat c cc cfg conf config cpp cs env go gradle groovy h hcl ini java js json jsx kt lua mjs php pl properties"
    " ps1 py r rb rs sbt scala sh sql swift tf tfvars toml ts tsx vue xml yaml yml zsh"
).split()
CODE_NAMES = "dockerfile makefile jenkinsfile vagrantfile procfile .env .npmrc .pypirc .netrc .htpasswd".split()

#: Words one of which stands in every file with a credential, by the kind of format they give away.
KEYWORDS = {
    "assigned": "pass pwd secret token key pat bearer basic jwt auth cred".split(),
    "issuer": "akia asia aiza ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- npm_ sg. sk_ rk_ sk- xoxa xoxb xoxe xoxo xoxp xoxr xoxs eyj pypi- hvs. dop_v1_ shpat_".split(),
    "url": ["://"],
    "connection": "password pwd accountkey sharedaccesskey sharedsecret".split(),
    "scheme": "bearer basic".split(),
    "block": ["private key"],
}

#: Formats that issuers publish.
ISSUERS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|AIza[\w-]{30,45}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}"
    r"|glpat-[\w-]{16,}"
    r"|npm_[A-Za-z0-9]{30,}"
    r"|pypi-[\w-]{30,}"
    r"|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|sk-(?:proj-|ant-)?[\w-]{20,}"
    r"|xox[abeoprs]-[\w-]{10,}"
    r"|hvs\.[\w-]{20,}|dop_v1_[a-f0-9]{40,}|shpat_[a-f0-9]{30,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"
    r")"
)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s\\:,\"'-]*)")
URL = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/@:\"'`<>]*:([^\s/\"'`<>]+)@(?=[\w\[.-])", re.I)
CONNECTION = re.compile(r"(?:;|[\"'`=\s])(?:password|pwd|accountkey|sharedaccesskey|sharedsecret)\s*=\s*([^;\"'`\s]+)", re.I)
SCHEME = re.compile(r"\b(?:Bearer|Basic)[ \t]+([^\s\"'`,;<>)}\]]+)")

_FALLBACK = r"(?:os\.(?:getenv|environ\.get)\(\s*[\"'][^\"'\n]*[\"']\s*,\s*|(?:process\.env\.\w+|System\.getenv\([^)\n]*\))\s*(?:\?\?|\|\|)\s*|\$\{\w+:-|\([ \t]*\n?[ \t]*)?"
_VALUE = r"(?:(?P<q>\"\"\"|'''|[\"'`])(?P<quoted>(?:\\.|(?!(?P=q))[^\n\\])*)(?P<end>(?P=q))?|(?P<plain>[^\s\"'`]+))"
_NAME = r"(?<![A-Za-z0-9_])(?P<name>(?:[A-Za-z0-9]+[_.\-])*[A-Za-z0-9]*?(?:PASS|PASSWORD|PASSWD|PASSPHRASE|PWD|SECRET|TOKEN|KEY|PAT|BEARER|JWT|CREDENTIALS?|AUTHORIZATION))(?![A-Za-z0-9_\-])"
ASSIGNED = re.compile(
    _NAME
    + r"(?:"
    + r"[\"'`]?\]?[ \t]*(?::[ \t]*[A-Za-z]+[ \t]*)?(?::=|=>|=|:)[ \t]*(?:[|>][+\-]?[ \t]*\n[ \t]*)?"  # name = value, name: value, name: | value
    + r"|[\"'`][ \t]*,[ \t]*"  # put("name", "value")
    + r"|[\"'`]?[ \t]*\n[ \t]*value:[ \t]*"  # - name: NAME / value: VALUE
    + r"|[\"'`][ \t]*\{[ \t]*\n?[ \t]*default[ \t]*=[ \t]*"  # variable "name" { default = "value" }
    + r"|[\"'][ \t]+value[ \t]*=[ \t]*"  # <add key="name" value="value" />
    + r"|>[ \t]*(?=[^<\s])"  # <name>value</name>
    + r"|[ \t]+(?=[\"'`]|[^\s=:<>(){}\[\],;]{6,}(?:[ \t]*(?:-->|\*/)|[ \t]*$))"  # --name value, and comments
    + r")"
    + _FALLBACK
    + r"(?:(?:Bearer|Basic)[ \t]+)?"
    + _VALUE,
    re.I | re.M,
)
#: A literal that goes on after a plus, a backslash or a line end.
MORE = re.compile(r"[ \t]*(?:\+|\.|\\)?[ \t]*\\?\n?[ \t]*(?:\+[ \t]*)?([\"'`])([A-Za-z0-9+/=_.\-]{4,})\1")

PLACEHOLDER = re.compile(
    r"^(?:\$[\{\(A-Za-z_]|<|\[|\{\{|\{%|%[({]|#\{|@|your|replace|change[-_]?(?:me|it|this)|example|redacted|insert|todo|none\b|null\b|true\b|false\b|undefined\b"
    r"|dummy|placeholder|fill|tbd\b|n/a\b|vault[:/]|arn:|op://|ref\+|ssm:|secretsmanager|env[.(:]|process\.|os\.|ssh-|sha\d+-|var\.|local\.|data\.|self\.|this\.|config\.|settings\.|https?://|-----BEGIN|eyJ\.\.\.|test$|secret$|password$|token$)"
    r"|^(.)\1*$|[Xx]{6,}|\*{3,}|^0+$|\.\.\.|^-+$",
    re.I,
)
_WORDS = re.compile(r"^[a-z]+(?:[-_. ][a-z]+)*$|^[A-Z][a-z]+(?:[- ][a-z]+)*$|^[A-Z]+(?:_[A-Z]+)*$")
_NUMBER = re.compile(r"^-?\d+(?:\.\d+)?(?:ms|s|m|h|d|kb|mb|gb|%)?$", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_COMMENT = re.compile(r"^\s*(?:#|//|;|--|/\*|\*|<!--|rem\b|\")", re.I)
#: Endings of files in which a value needs no quotes.
BARE_ENDINGS = frozenset("bash cfg conf config env ini properties sh toml tfvars yaml yml zsh".split())

#: Last parts of names whose value a person may have chosen, words or several words included.
CHOSEN = ("pass", "password", "passwd", "passphrase", "pwd")
#: Words of texts about passwords, which are no passwords.
ABOUT = frozenset(
    "a an the is are was not no of or to for in on at by with your you must should enter invalid wrong missing required please new old current confirm password passwords passphrase"
    " secret token key login user username field value string text hidden show reset forgot change changed update default empty unknown expired too short long length characters".split()
)

_automaton = None
_KINDS = {kind: 1 << k for k, kind in enumerate(KEYWORDS)}
_ALL = (1 << len(KEYWORDS)) - 1


def _keywords() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        masks: dict[str, int] = {}
        for kind, words in KEYWORDS.items():
            for word in words:
                masks[word] = masks.get(word, 0) | _KINDS[kind]
        for word in masks:  # a longer keyword ends where a shorter one in it may begin
            masks[word] |= sum({m for other, m in masks.items() if other != word and word.endswith(other) and not m & masks[word]})
        _automaton = ahocorasick.Automaton()
        for word, mask in masks.items():
            _automaton.add_word(word, mask)
        _automaton.make_automaton()
    return _automaton


def kinds_in(text: str) -> int:
    """The kinds of format that a text may hold by its keywords, as bits of ``_KINDS``."""
    found = 0
    for _, mask in _keywords().iter(text.lower()):
        found |= mask
        if found == _ALL:
            break
    return found


def may_hold(text: str) -> bool:
    """Whether the text has any keyword."""
    return kinds_in(text) > 0


# ---- checks ----------------------------------------------------------------------------------------------------------

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of those before, as GitHub and npm put it into their tokens."""
    m = re.fullmatch(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30,})", token)
    if not m:
        return False
    body, crc, tail = m[1][:-6], zlib.crc32(m[1][:-6].encode()), ""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        tail = _BASE62[r] + tail
    return bool(body) and m[1].endswith(tail)


def web_token(token: str) -> bool:
    """Whether the first part of a three-part token decodes to a JSON header with an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def varied(token: str) -> bool:
    """Whether the part after the prefix has the variety of a key: random text of its length nearly always has."""
    body = re.sub(r"^(?:[A-Za-z0-9]+[_\-.])+(?=[A-Za-z0-9]{8})|^A[KS]IA|^AIza", "", token)
    counts = Counter(body)
    n = len(body)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    return len(counts) >= min(6, n) and bits >= min(2.5, 0.6 * math.log2(max(2, n)))


def is_issued(token: str) -> bool:
    """Whether a token of an issuer's format is a real one."""
    if checksum_holds(token) or (token.startswith("eyJ") and web_token(token)):
        return True
    return varied(token) and not re.search(r"[Xx]{6,}|\*{3,}|0{10,}", token)


def is_chosen(name: str, value: str) -> bool:
    """Whether a quoted value of letters, or of several words, is what a person chose as the password of this name."""
    if not name.lower().endswith(CHOSEN) or PLACEHOLDER.search(value):
        return False
    words = value.split()
    plain = all(re.fullmatch(r"[A-Za-z0-9!@#$%^&*?+-]+", w) for w in words)
    about = sum(re.sub(r"\W", "", w).lower() in ABOUT for w in words)
    if len(words) == 1:
        return plain and len(value) >= 6 and re.fullmatch(r"[a-z]+|[A-Z][a-z]+|[A-Z]+", value) is not None and not about
    return plain and len(value) >= 12 and about == 0 and not re.search(r"[.:?,;]\s*$", value)


def is_secret_value(value: str) -> bool:
    """Whether an assigned value can be a secret: no placeholder, reference, word, number or id."""
    return (
        len(value) >= 6
        and not PLACEHOLDER.search(value)
        and not _WORDS.match(value)
        and not _NUMBER.match(value)
        and not _UUID.match(value)
    )


def _decodes(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def _ending(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else name


def credentials(text: str, path: str = "") -> list[tuple[int, int]]:
    """Spans of the secret values in ``text``, in order and disjoint; a divided literal gives one span for each piece."""
    return [(s, e) for s, e, _ in _pieces(text, path)]


def _goes_on(more: re.Match) -> bool:
    """Whether what stands before the next literal makes it a piece of the one before."""
    return "\n" in more[0] or "+" in more[0][: more.start(1) - more.start()] or "\\" in more[0]


def _pieces(text: str, path: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it opens a credential)."""
    kinds = kinds_in(text) if text else 0
    if not kinds:
        return []
    has = lambda kind: kinds & _KINDS[kind]
    found: list[tuple[int, int]] = [m.span() for m in BLOCK.finditer(text)] if has("block") else []
    found += [m.span() for m in ISSUERS.finditer(text) if is_issued(m[0])] if has("issuer") else []
    found += [m.span(1) for m in URL.finditer(text) if not PLACEHOLDER.search(m[1])] if has("url") else []
    found += [m.span(1) for m in CONNECTION.finditer(text) if is_secret_value(m[1])] if has("connection") else []
    for m in SCHEME.finditer(text) if has("scheme") else ():
        if m[0][:2] == "Ba" and not _decodes(m[1]):
            continue
        if is_secret_value(m[1]):
            found.append(m.span(1))
    bare = _ending(path) in BARE_ENDINGS or _ending(path) == "dockerfile"
    at = 0
    while (m := ASSIGNED.search(text, at)) if has("assigned") else None:
        at = max(m.start("plain") if m["plain"] is not None else m.start("quoted"), m.end("name"))
        quoted = m["quoted"] is not None
        value, (s, e) = (m["quoted"], m.span("quoted")) if quoted else (m["plain"], m.span("plain"))
        if not quoted:
            value = re.sub(r"(?:[;,)\]}]|</.*|-->)+$", "", value)
            e = s + len(value)
            if "(" in value or "{" in value:
                continue
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            own = text[m.end("name") : s]
            if not bare and not _COMMENT.match(line) and ">" not in own and "\n" not in own and not line.rstrip().endswith("--") and not re.search(r"[\"']$|\[[\"']--$", line.rstrip(" -")):
                continue
        if " " in value or "\t" in value:
            if quoted and is_chosen(m["name"], value):
                found.append((s, e))
            continue
        last = text[m.end("name") - 4 : m.end("name")].lower()
        if quoted and (more := MORE.match(text, m.end())) and re.fullmatch(r"[A-Za-z0-9+/=_.\-]{4,}", value):
            pieces = []
            while more and _goes_on(more):
                pieces.append(more.span(2))
                more = MORE.match(text, more.end())
            if pieces and is_secret_value(value + "".join(text[a:b] for a, b in pieces)):
                found += [(s, e), *((a, -b) for a, b in pieces)]
                continue
        if last.endswith("pat") and len(value) < 8:
            continue
        if (is_secret_value(value) and (is_issued(value) if ISSUERS.fullmatch(value) else True)) or (quoted and is_chosen(m["name"], value)):
            found.append((s, e))
    out: list[tuple[int, int, bool]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -abs(x[1]))):
        opens, e = e > 0, abs(e)
        if out and s < out[-1][1]:
            continue
        out.append((s, e, opens))
    return out


def mask(value: str) -> str:
    """A placeholder of the same length and alphabet; the lines that open and close a key block stay."""
    if value.startswith("-----BEGIN"):
        head = value.index("-----", 5) + 5
        tail = value.rfind("-----END")
        tail = len(value) if tail < 0 else tail
        return value[:head] + mask(value[head:tail]) + value[tail:]
    # in an alphabet of few characters the mask is its zero, which decodes; elsewhere letters and digits keep their kind
    if re.fullmatch(r"(?:0[xX])?(?:[0-9a-f]{8,}|[0-9A-F]{8,})", value) and re.search(r"\d", value):
        head = 2 if value[:2] in ("0x", "0X") else 0
        return value[:head] + "0" * (len(value) - head)
    if re.fullmatch(r"[A-Z2-7]{8,}=*", value) and re.search(r"[2-7=]", value) or re.fullmatch(r"[A-Za-z0-9+/_-]{4,}={1,2}", value):
        return re.sub(r"[^=]", "A", value)
    out, k = [], 0
    while k < len(value):
        c = value[k]
        if c == "\\" and k + 1 < len(value):
            out.append(value[k : k + 2])
            k += 2
            continue
        out.append("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c)
        k += 1
    return "".join(out)


def redact(text: str, path: str = "") -> tuple[str, int]:
    """The text with all secret values masked, and the number of credentials."""
    out, at, n = [], 0, 0
    for s, e, opens in _pieces(text, path):
        out += [text[at:s], mask(text[s:e])]
        at, n = e, n + opens
    return "".join([*out, text[at:]]), n


def is_code_path(path: Column) -> Column:
    """Whether a path names source code or configuration."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.substring_index(name, ".", -1).isin(CODE_ENDINGS) & name.contains(".") | name.isin(CODE_NAMES) | name.startswith("dockerfile.")


def find(df: DataFrame, id_col: str = "row_id", path_col: str = "relative_path", text_col: str = "text") -> DataFrame:
    """(row_id, char_pos): the first character of each credential in files of code and configuration."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, at = [], []
            for i, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                for s, _, opens in _pieces(t, p):
                    if opens:
                        ids.append(i)
                        at.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], ["row_id", "char_pos"])

    code = df.where(is_code_path(F.col(path_col)) & (F.length(text_col) > 0))
    code = spread(code.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")), "id")
    return code.mapInArrow(run, "row_id long, char_pos long")


def redacted(df: DataFrame, id_col: str = "row_id", path_col: str = "relative_path", text_col: str = "text") -> DataFrame:
    """(row_id, text, credentials): the files of code and configuration with their credentials masked; null stays null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, paths, texts = batch.columns
            done = [(None, 0) if t is None else redact(t, p) for p, t in zip(paths.to_pylist(), texts.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["row_id", "text", "credentials"]
            )

    code = df.where(is_code_path(F.col(path_col)))
    code = spread(code.select(F.col(id_col).cast("long").alias("row_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")), "row_id")
    return code.mapInArrow(run, "row_id long, text string, credentials int")
