"""Files of a corpus: scan, classes, checksums."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.session import stash

#: Endings that are read.
SUPPORTED = (
    ".atom .adoc .astro .bash .bat .c .cjs .cfg .cmd .conf .cpp .cs .css .csv .cts .diff .docx .eml .epub .example .exemple .go .h .hpp .htm .html .ics .ini .java .js .json .jsonl .jsx .ipynb"
    " .log .markdown .md .mdown .mdx .mmd .mjs .mts .ndjson .odp .ods .odt .patch .pdf .php .pptx .properties .ps1 .py .rb .rst .rs .rss .rtf .scss .srt .svelte .svg .sh .sql .tex .text .toml .ts"
    " .tsv .tsx .txt .vtt .vue .xml .xlsx .yaml .yml"
).split()
#: Names and endings of files that hold secrets.
SENSITIVE_NAMES = ".htpasswd .netrc .npmrc .pgpass .pypirc credentials id_dsa id_ecdsa id_ed25519 id_rsa".split()
SENSITIVE_ENDINGS = ".asc .cer .crt .der .gpg .jks .kdbx .key .keystore .ovpn .p12 .p8 .pem .pfx .ppk".split()
SUPPORTED_NAMES = ("dockerfile", "makefile", "license", "readme")
IMAGES, OLD_WORD, OLD_EXCEL = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp", ".gif"), (".doc",), (".xls",)
SPEECH = (".mp3", ".wav", ".m4a", ".mp4", ".mov", ".webm", ".ogg", ".flac")
#: What to do about files that are passed over.
ADVICE = {
    "sensitive-name": "Look at it by hand: files that may hold keys or passwords are never read.",
    "oversized": "Split it, or raise the limit once the file is known to be safe and useful.",
    "image": "Set an image reader, or save the recognised text next to it.",
    "old-word": "Set a reader for old Word files, or convert it.",
    "old-excel": "Convert it to a current workbook or to CSV.",
    "speech": "Transcribe it to text first.",
    "other": "Convert it to a supported format.",
}
_KINDS = (("image", IMAGES), ("old-word", OLD_WORD), ("old-excel", OLD_EXCEL), ("speech", SPEECH))


def extension_of(path: Column) -> Column:
    """The ending in lower case, (none) without one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1)), F.lit("")), F.lit("(none)"))


def is_sensitive(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return name.isin(*SENSITIVE_NAMES) | name.rlike(r"^\.env(\..*)?$") | name.rlike(r"\.(?:" + "|".join(e[1:] for e in SENSITIVE_ENDINGS) + r")$")


def is_supported(extension: Column, more: Iterable[str] = ()) -> Column:
    return F.lower(extension).isin(*SUPPORTED, *[e.lower() for e in more])


def recommendation(reason: Column, extension: Column) -> Column:
    out = F.lit(ADVICE["other"])
    for kind, endings in reversed(_KINDS):
        out = F.when(F.lower(extension).isin(*endings), F.lit(ADVICE[kind])).otherwise(out)
    return F.when(reason.isin("sensitive-name", "oversized"), F.when(reason == "oversized", F.lit(ADVICE["oversized"])).otherwise(F.lit(ADVICE["sensitive-name"]))).otherwise(out)


def advice_sql(extension: str) -> str:
    """The advice for an unsupported ending as an SQL expression."""
    cases = " ".join("WHEN lower({}) IN ({}) THEN '{}'".format(extension, ", ".join(f"'{e}'" for e in endings), ADVICE[kind]) for kind, endings in _KINDS)
    return f"CASE {cases} ELSE '{ADVICE['other']}' END"


def classified(files: DataFrame, most_bytes: int = 50_000_000, more: Iterable[str] = ()) -> DataFrame:
    """Adds ``reason`` (null: read) and ``recommendation``; the name is looked at first, then the ending, then the size."""
    ext = F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("(none)"))
    reason = F.when(is_sensitive(F.col("relative_path")), "sensitive-name").when(~is_supported(ext, more), "unsupported-extension").when(F.col("bytes") > most_bytes, "oversized")
    out = files.withColumn("extension", ext).withColumn("reason", reason)
    return out.withColumn("recommendation", F.when(F.col("reason").isNotNull(), recommendation(F.col("reason"), ext)))


def supported_files(files: DataFrame, **options) -> DataFrame:
    return classified(files, **options).where("reason is null").drop("reason", "recommendation")


def input_spec(lines: Iterable[str]) -> tuple[list[str], list[str]]:
    """Included and excluded patterns: # starts a comment, ! excludes, a plain path stands for all below it."""
    include, exclude = [], []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        target = exclude if line.startswith("!") else include
        pattern = line.lstrip("!").strip().replace("\\", "/")
        pattern = re.sub(r"^(?:\./)+", "", pattern).rstrip("/")
        target.append(pattern if re.search(r"[*?\[\]{}]", pattern) else pattern + "/**")
    return include, exclude


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a path fits one of the glob patterns."""
    out = []
    for p in patterns:
        if p.endswith("/**"):
            out.append((path == p[:-3]) | F.startswith(path, F.lit(p[:-2])))
        else:
            body = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            out.append(path.rlike(f"^{body}$"))
    return functools.reduce(operator.or_, out) if out else F.lit(False)


#: Paths that are named one by one to a reader; more are read by a scan of all.
NAMED_PATHS = 20_000


def _escaped(path: str) -> str:
    """A path without the signs that a reader takes for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def scanned(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = (), content: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Files below ``root`` with size, time and SHA-256; the listing is parallel and the hash runs where the bytes are.

    ``known`` has (relative_path, bytes, mtime_ms, cached_checksum): files of the same size and time take that checksum and
    their bytes aren't read. With ``content`` the files that were read bring theirs, the others null.
    """
    base = root.rstrip("/")
    path = F.substring(F.regexp_replace(F.col("path"), r"^file:(?://)?", ""), len(base) + 2, 1 << 30).alias("relative_path")
    facts = F.col("length").alias("bytes"), (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms")
    bytes_of = F.sha2("content", 256).alias("checksum"), *(["content"] if content else [])
    inc, exc = list(include), list(exclude)

    def load(*paths: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.where(matches(F.col("relative_path"), inc)) if inc else rows
        return rows.where(~matches(F.col("relative_path"), exc)) if exc else rows

    if known is None:
        rows = kept(load(base).select(path, *facts, *bytes_of))
    else:
        cached = known.select("relative_path", "bytes", "mtime_ms", "cached_checksum")
        seen = stash(kept(load(base).select(path, *facts)).join(cached, ["relative_path", "bytes", "mtime_ms"], "left"))
        changed = seen.where("cached_checksum is null").select("relative_path")
        names = [r[0] for r in changed.limit(NAMED_PATHS + 1).collect()]
        same = seen.where("cached_checksum is not null").withColumnRenamed("cached_checksum", "checksum").withColumns({"content": F.lit(None).cast("binary")} if content else {})
        if len(names) > NAMED_PATHS:
            rows = same.unionByName(load(base).select(path, *facts, *bytes_of).join(changed, "relative_path", "left_semi"))
        else:
            rows = same.unionByName(load(*(f"{base}/{_escaped(n)}" for n in names)).select(path, *facts, *bytes_of)) if names else same
    return rows.withColumn("source", F.substring_index("relative_path", "/", 1)).withColumn("extension", extension_of(F.col("relative_path")))
