"""Filters on paths and contexts."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_prefixes(prefixes: Iterable[str] | None) -> list[str]:
    """Prefixes with forward slashes, without a leading ./ or trailing /, distinct, in order."""
    out = []
    for p in prefixes or ():
        p = re.sub(r"/+$", "", re.sub(r"^(?:\./)+", "", p.strip().replace("\\", "/")))
        if p and p not in out:
            out.append(p)
    return out


def path_prefix(path: Column, prefix: str) -> Column:
    """The path itself or anything below it."""
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def context_prefix(context: Column, prefix: str) -> Column:
    """The context itself, a heading below it, or a member of it."""
    starts = [F.startswith(context, F.lit(prefix + s)) for s in (" > ", ".", "[")]
    return functools.reduce(operator.or_, starts, context == prefix)


def any_of(columns: list[Column]) -> Column:
    return functools.reduce(operator.or_, columns)


def search_predicate(include: Iterable[str] | None = None, exclude: Iterable[str] | None = None, contexts: Iterable[str] | None = None, path: str = "relative_path", context: str = "context_path") -> Column:
    """One of the included paths, none of the excluded, one of the contexts; an empty list asks nothing."""
    p, c = F.col(path), F.coalesce(F.col(context), F.lit(""))
    out = F.lit(True)
    if inc := normalized_prefixes(include):
        out = out & any_of([path_prefix(p, x) for x in inc])
    if exc := normalized_prefixes(exclude):
        out = out & ~any_of([path_prefix(p, x) for x in exc])
    if ctx := [x.strip() for x in contexts or () if x.strip()]:
        out = out & any_of([context_prefix(c, x) for x in ctx])
    return out


def is_path_query(query: Column) -> Column:
    """Whether a query reads like the path or name of a file."""
    return query.rlike(r"(?i)^[\p{L}\p{N}_. /\\-]+\.[a-z0-9]{1,12}$")


def exact_path(path: Column, query: Column) -> Column:
    """2 where a query with a folder is the path, 1 where its last part is the path or its end, else null."""
    base = F.substring_index(query, "/", -1)
    return F.when((path == query) & F.contains(query, F.lit("/")), 2).when((path == base) | F.endswith(path, F.concat(F.lit("/"), base)), 1)


def archive_like(path: Column) -> Column:
    """Paths that look like archives or mirrors of others."""
    return path.rlike(r"(?i)(?:^|[/_.\-])(?:archive[sd]?|backup|bak|copy|old|final|mirror)(?:[/_.\-]|\d|$)")
