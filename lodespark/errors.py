"""Errors of the engine: each has a code and says whether trying again may help."""

from __future__ import annotations


class EngineError(Exception):
    code, retryable = "ENGINE_ERROR", False

    def __init__(self, message: str, *, cause: BaseException | None = None) -> None:
        super().__init__(message)
        self.__cause__ = cause


class ConfigError(EngineError):
    code = "INVALID_CONFIG"


class InputError(EngineError):
    code = "INVALID_INPUT"


class IndexMissing(EngineError):
    code = "INDEX_NOT_FOUND"


class IndexIncompatible(EngineError):
    code = "INDEX_INCOMPATIBLE"


class IndexUnavailable(EngineError):
    code, retryable = "INDEX_UNAVAILABLE", True


class WriterBusy(EngineError):
    code, retryable = "WRITE_LOCKED", True


class Cancelled(EngineError):
    code, retryable = "CANCELLED", True


class CitationMismatch(EngineError):
    code = "CITATION_NOT_FOUND"
