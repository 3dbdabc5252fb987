"""Redaction of secrets by a fixed list of patterns, as chained built-in replacements.

Word boundaries are those of ASCII letters, digits and the underscore. Card-shaped numbers are replaced only where their
check digit holds. Custom patterns follow the built-in ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.config import RedactionRule, check_pattern

#: Names, patterns and case folding in the order they apply; \b is the ASCII boundary.
PATTERNS: list[tuple[str, str, bool]] = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", False),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", False),
    ("stripe_secret_key", r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}\b", False),
    ("gitlab_token", r"\bglpat-[A-Za-z0-9_-]{18,}\b", False),
    ("bearer_token", r"\b(?:Bearer|bearer)\s+[A-Za-z0-9_-]{32,}\b", False),
    ("api_token", r"\b(?:sk|pk|ghp|gho|github_pat|npm)_[A-Za-z0-9_=-]{20,}\b|\b[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b", False),
    ("openai_api_key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", False),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", False),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b", False),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", False),
    ("sendgrid_api_key", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b", False),
    ("url_credentials", r"\b[a-z][a-z0-9+.-]*://[^\s/@]+:[^\s/@]+@", True),
    ("email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", True),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", True),
    ("credit_card", r"\b(?:\d[ -]*?){13,19}\b", False),
]
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: What a text must have for a pattern to be tried at all: a plain scan is cheaper than one with boundaries.
GATES = {
    "private_key": "PRIVATE KEY-----", "jwt": "eyJ", "stripe_secret_key": "k_", "gitlab_token": "glpat-", "bearer_token": "earer", "openai_api_key": "sk-", "google_api_key": "AIza",
    "slack_token": "xox", "sendgrid_api_key": "SG.", "url_credentials": "://", "email": "@",
}
#: Noncharacters that stand around matches while they are checked.
MARKS = ("\ufdd0", "\ufdd1")
GATE_PATTERNS = {"api_token": r"[A-Za-z0-9_=-]{20}", "aws_access_key_id": r"A[KS]IA[0-9A-Z]{16}", "iban": r"(?i)[A-Z]{2}\d{2}[A-Z0-9]{11}", "credit_card": r"\d(?:[ -]*\d){12}"}


def ascii_edges(pattern: str, fold: bool = False, plain: bool = False) -> str:
    """The pattern with ASCII word boundaries in the JVM's syntax.

    ``plain`` is for patterns whose boundaries all stand next to word characters, where one look is enough.
    """
    if plain:
        pattern = re.sub(r"\\b(?=[(\[\w])", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")
    elif re.match(r"\\b(?:\(\?:[a-zA-Z]|[a-zA-Z]|\[A-Z\]|\[a-z\]|\(\?:\\d)", pattern):
        pattern = "(?<![A-Za-z0-9_])" + pattern[2:]
    return ("(?i)" if fold else "") + pattern.replace(r"\b", _EDGE)


def let(value: Column, then) -> Column:
    """``then`` of a value that the expression holds once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def gated(text: Column, name: str) -> Column:
    """Whether a text may hold a match of the pattern."""
    return F.contains(text, F.lit(GATES[name])) if name in GATES else text.rlike(GATE_PATTERNS[name])


def placeholder(name: str) -> str:
    return f"[REDACTED_{name.upper()}]"


def card_numbers(text: Column) -> Column:
    """Card-shaped substrings whose 13 to 19 digits pass the check."""
    shaped = F.regexp_extract_all(text, F.lit(f"({ascii_edges(PATTERNS[-1][1])})"), 1)
    return F.filter(shaped, lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"[^0-9]", "")))


def redact(text: Column, rules: Iterable[RedactionRule] = ()) -> Column:
    """The text with every match replaced; null stays null."""
    out = text
    for name, pattern, fold in PATTERNS[:-1]:
        out = let(out, _replacing(name, ascii_edges(pattern, fold)))
    out = let(out, lambda t: F.when(gated(t, "credit_card"), _checked(f"({ascii_edges(PATTERNS[-1][1])})", placeholder("credit_card"))(t)).otherwise(t))
    for rule in rules:
        check_pattern(rule.pattern, rule.flags)
        flags = "".join(f for f in rule.flags if f in "ims")
        target = rule.replacement if rule.replacement is not None else placeholder(rule.name)
        if rule.verify == "luhn":
            pattern = f"({'(?' + flags + ')' if flags else ''}{ascii_edges(rule.pattern)})"

            out = let(out, _checked(pattern, target))
        else:
            out = F.regexp_replace(out, (f"(?{flags})" if flags else "") + ascii_edges(rule.pattern), re.sub(r"([$\\])", r"\\\1", target))
    return out


def _replacing(name: str, pattern: str):
    return lambda t: F.when(gated(t, name), F.regexp_replace(t, pattern, placeholder(name))).otherwise(t)


def _checked(pattern: str, target: str):
    """Replaces the matches whose digits pass the check, each at its place and nowhere else.

    The matches are set between marks, so that every second piece of the text is one; the marks are noncharacters, of
    which a text doesn't hold both.
    """
    good = lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"[^0-9]", ""))

    def then(t: Column) -> Column:
        def laced(mark: str) -> Column:
            pieces = F.split(F.regexp_replace(t, pattern, f"{mark}$1{mark}"), mark, -1)
            return F.array_join(F.transform(pieces, lambda m, k: F.when((k % 2 == 1) & good(m), F.lit(target)).otherwise(m)), "")

        return F.when(F.contains(t, F.lit(MARKS[0])), laced(MARKS[1])).otherwise(laced(MARKS[0]))

    return then


def placeholders_in(text: Column) -> Column:
    """How many placeholders a redacted text holds."""
    return F.regexp_count(text, F.lit(r"\[REDACTED_[A-Z_]+\]"))


def match_count(text: Column, name: str) -> Column:
    """Matches of one built-in pattern on its own; cards count when the check digit holds."""
    if name == "credit_card":
        return F.when(gated(text, name), F.size(card_numbers(text))).otherwise(F.lit(0))
    pattern, fold = next((p, f) for n, p, f in PATTERNS if n == name)
    return F.when(gated(text, name), F.regexp_count(text, F.lit(ascii_edges(pattern, fold)))).otherwise(F.lit(0))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("line_map_kept", T.BooleanType())]))
def redact_with_lines(text: pd.Series) -> pd.DataFrame:
    """Redaction that says whether source lines still hold: they don't once a match or replacement has a line end."""
    compiled = [(n, re.compile(p, re.ASCII | (re.I if f else 0))) for n, p, f in PATTERNS]
    outs, kept = [], []
    for t in text:
        keep = True
        if t is not None:
            for name, pattern in compiled:

                def put(m: re.Match, name: str = name) -> str:
                    nonlocal keep
                    digits = re.sub(r"\D", "", m[0])
                    if name == "credit_card" and not (13 <= len(digits) <= 19 and _luhn(digits)):
                        return m[0]
                    keep = keep and "\n" not in m[0]
                    return placeholder(name)

                t = pattern.sub(put, t)
        outs.append(t)
        kept.append(keep)
    return pd.DataFrame({"text": outs, "line_map_kept": kept})


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0
