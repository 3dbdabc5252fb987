"""Configuration with its defaults, bounds, profiles and fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace

from lodespark.errors import ConfigError

TOP_K_RANGE = (1, 100)
MAX_CONTEXT_RADIUS = 3
INDEX_SCHEMA_VERSION = 11
#: Top-k and scan limit of the retrieval profiles.
PROFILES = {"fast": {"top_k": 5, "scan_limit": 2_000}, "balanced": {}, "quality": {"top_k": 12, "scan_limit": 10_000}, "custom": {}}
#: Candidate policies of the profiles.
VECTOR_CANDIDATES = {"fast": (40, 3), "balanced": (80, 4), "quality": (200, 8), "custom": (80, 4)}
LEXICAL_CANDIDATES = {"fast": (100, 10), "balanced": (250, 20), "quality": (500, 40), "custom": (250, 20)}
SOURCE_CAPS = {"fast": 1, "balanced": 2, "quality": 4, "custom": 2}
MAX_VECTOR_CANDIDATES, MAX_LEXICAL_CANDIDATES = 1_000, 4_000


@dataclass(frozen=True)
class RedactionRule:
    """A custom redaction pattern."""

    name: str
    pattern: str
    flags: str = ""
    replacement: str | None = None
    verify: str | None = None


@dataclass(frozen=True)
class Config:
    """Settings of an engine; unknown keys and values out of bounds are errors."""

    retrieval_profile: str = "balanced"
    privacy_profile: str = "private"
    top_k: int = 8
    scan_limit: int = 5_000
    context_radius: int = 1
    chunk_size: int = 1_200
    chunk_overlap: int = 200
    max_file_bytes: int = 50_000_000
    max_output_bytes: int = 65_536
    embedding_provider: str = "local-hash"
    embedding_model: str = "local-hash-384"
    redaction: bool = True
    custom_redactions: tuple[RedactionRule, ...] = ()
    include_extensions: tuple[str, ...] = ()
    extractors: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ann_least_rows: int = 100_000
    fingerprint_days: int = 30
    window_files: int = 64
    window_bytes: int = 50_000_000
    window_chunks: int = 8_192

    def __post_init__(self) -> None:
        if self.retrieval_profile not in PROFILES:
            raise ConfigError(f"unknown retrieval profile {self.retrieval_profile!r}")
        if not TOP_K_RANGE[0] <= self.top_k <= TOP_K_RANGE[1]:
            raise ConfigError("top_k must be 1 to 100")
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("chunk_overlap must be at least 0 and less than chunk_size")
        if len(self.custom_redactions) > 64:
            raise ConfigError("at most 64 custom redaction patterns")

    @staticmethod
    def load(values: dict | None = None) -> Config:
        """Defaults, then the profile, then the values, then the floor of strict privacy."""
        values = dict(values or {})
        known = {f.name for f in fields(Config)}
        if unknown := sorted(set(values) - known):
            raise ConfigError(f"unknown settings: {', '.join(unknown)}")
        values["custom_redactions"] = tuple(r if isinstance(r, RedactionRule) else RedactionRule(**r) for r in values.get("custom_redactions", ()))
        config = Config(**(PROFILES.get(values.get("retrieval_profile", "balanced"), {}) | values))
        if config.privacy_profile == "strict":
            config = replace(config, top_k=min(config.top_k, 5), max_output_bytes=min(config.max_output_bytes, 16_384), extractors={})
        return config

    def policy_fingerprint(self) -> str:
        """SHA-256 of the settings that decide what is in an index."""
        own = {k: v for k, v in asdict(self).items() if k in ("chunk_size", "chunk_overlap", "embedding_provider", "embedding_model", "redaction", "custom_redactions", "include_extensions", "extractors")}
        return fingerprint(own | {"schema": INDEX_SCHEMA_VERSION})


def stable_json(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=list)


def fingerprint(value: object) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def vector_candidate_limit(top_k: int, profile: str = "balanced") -> int:
    least, times = VECTOR_CANDIDATES[profile]
    return min(MAX_VECTOR_CANDIDATES, max(least, top_k * times))


def lexical_candidate_limit(top_k: int, profile: str = "balanced") -> int:
    least, times = LEXICAL_CANDIDATES[profile]
    return min(MAX_LEXICAL_CANDIDATES, max(least, top_k * times))


def context_radius(value: int) -> int:
    if value < 0:
        raise ConfigError("context radius must not be negative")
    return min(value, MAX_CONTEXT_RADIUS)


def vector_index_policy(rows: int, dimension: int, least_rows: int = 100_000) -> dict:
    """Exact search for small tables, cells of about the square root of the rows for larger ones."""
    if rows < least_rows or dimension <= 0:
        return {"strategy": "exact"}
    parts = max(16, round(rows**0.5))
    large = rows >= 1_000_000
    sub = next((d for d in (dimension // 16,) if d and dimension % d == 0), 1)
    return {"strategy": "ivf-pq", "num_partitions": parts, "num_sub_vectors": sub, "nprobes": parts if large else min(parts, 32), "refine_factor": 100 if large else 10}


_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\d*\})")


def check_pattern(pattern: str, flags: str = "") -> None:
    """Refuse patterns that are empty, very long, not compilable, or repeat a repetition."""
    if not pattern or len(pattern) > 500:
        raise ConfigError("a pattern must have 1 to 500 characters")
    if not set(flags) <= set("gimsu"):
        raise ConfigError("flags may be g, i, m, s and u")
    if _NESTED.search(pattern):
        raise ConfigError("a repeated group must not repeat inside")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"pattern does not compile: {e}") from e
