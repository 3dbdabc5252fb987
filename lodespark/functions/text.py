"""Text functions: normalisation, tokens, cleaning, snippets.

Column functions stay in the JVM where built-ins can express them. Compatibility decomposition and Unicode word
segmentation have no built-in, so what rests on them is an Arrow UDF; ASCII texts take a plain regular expression there.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no meaning in a query.
STOP_WORDS = ("about", "avec", "dans", "des", "for", "les", "pour", "que", "qui", "sur", "the", "une", "what")

#: Segments of ASCII text: a point, apostrophe or colon joins letters, a point, apostrophe, comma or semicolon digits.
_ASCII_WORD = re.compile(r"\w+(?:(?:(?<=[a-z])[.':](?=[a-z])|(?<=\d)[.',;](?=\d))\w+)*", re.ASCII)
_segmenter = _foreign = _marks = None


def _compiled():
    """The same rule for all scripts: marks and format characters stay with what they follow, ideographs stand alone."""
    global _segmenter, _foreign, _marks
    if _segmenter is None:
        import regex

        alone, kana, after = r"[\p{Han}\p{Hiragana}]", r"[\p{Katakana}ー]", r"[\p{M}\p{Cf}]*"
        letter = rf"[\p{{L}}--{alone}--{kana}]"
        word = rf"(?:[\p{{L}}\p{{N}}_--{alone}--{kana}]{after})+"
        joined = rf"(?:(?<={letter}{after})[.'’:·‧]{after}(?={letter})|(?<=\p{{N}}{after})[.'’,;]{after}(?=\p{{N}}))"
        _segmenter = regex.compile(rf"{word}(?:{joined}{word})*|{alone}{after}|(?:{kana}{after})+", regex.V1)
        _foreign, _marks = regex.compile(r"[^\p{Latin}\p{N}]"), regex.compile(r"\p{Diacritic}+")
    return _segmenter, _foreign, _marks


def normalized(text: str) -> str:
    """Lower case, compatibility decomposition, no diacritics."""
    low = text.lower()
    if low.isascii():
        return low.replace("^", "").replace("`", "")
    return _compiled()[2].sub("", unicodedata.normalize("NFKD", low))


def tokenize(text: str) -> list[str]:
    """Unicode word segments of the normalised text: two characters or more, or one that is neither Latin nor a digit."""
    plain = normalized(text)
    if plain.isascii():
        return [t for t in _ASCII_WORD.findall(plain) if len(t) >= 2 or t == "_"]
    segmenter, foreign, _ = _compiled()
    return [t for t in segmenter.findall(plain) if len(t) >= 2 or foreign.search(t)]


@F.pandas_udf(T.StringType())
def normalize_for_match(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalized(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unicode_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else tokenize(t))


def tokens(text: Column) -> Column:
    """The Unicode tokens of a text; null gives an empty array."""
    return F.coalesce(unicode_tokens(text), F.array().cast("array<string>"))


def meaningful_terms(text: Column, limit: int = 8) -> Column:
    """The first distinct normalised words of three letters or digits or more that are no stop words."""
    words = F.regexp_extract_all(normalize_for_match(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]{3,})"), 1)
    return F.slice(F.array_distinct(F.filter(words, lambda t: ~t.isin(*STOP_WORDS))), 1, limit)


def collapsed(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, length: int = 260) -> Column:
    """Collapsed text of at most ``length`` characters, cut ones with three dots."""
    one = collapsed(text)
    return F.when(F.length(one) > length, F.concat(F.rtrim(F.substring(one, 1, length - 3)), F.lit("..."))).otherwise(one)


def cleaned(text: Column) -> Column:
    """Without embedded base64 runs, with bare line feeds, no trailing blanks and at most two empty lines."""
    c = F.regexp_replace(text, r"[A-Za-z0-9+/]{240,}={0,2}", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def dehyphenated(text: Column) -> Column:
    """Words joined that a hyphen divides before a line that goes on in lower case."""
    return F.regexp_replace(text, r"([\p{L}\p{N}])-\n(\p{Ll})", "$1$2")


def trigrams(token: Column) -> Column:
    """Distinct runs of three characters of a token of three or more."""
    return F.when(F.length(token) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of the trigram sets of two tokens; 0 where one has none."""
    x, y = trigrams(a), trigrams(b)
    total = F.size(x) + F.size(y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(F.lit(0.0))


def tokens_related(a: Column, b: Column) -> Column:
    """Equal; or both of four characters or more with the first four the same; or alike by trigrams, long and of like length."""
    prefix = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))
    alike = (F.length(a) >= 7) & (F.length(b) >= 7) & (F.abs(F.length(a) - F.length(b)) <= 1)
    return (a == b) | prefix | (alike & (dice(a, b) >= 0.5))


def identifiers(text: Column) -> Column:
    """Compound words joined by hyphens or underscores, normalised. A word that isn't one is not tried again from its middle."""
    return F.regexp_extract_all(normalize_for_match(F.coalesce(text, F.lit(""))), F.lit(r"((?<![\p{L}\p{N}])[\p{L}\p{N}]++(?:[-_][\p{L}\p{N}]++)+)"), 1)


def anchors(text: Column) -> Column:
    """What a query must find: compound identifiers with a digit or underscore, and tokens with digits."""
    compound = F.filter(identifiers(text), lambda t: t.rlike(r"\d|_"))
    with_digits = F.filter(tokens(text), lambda t: (F.length(t) >= 4) & t.rlike(r"\d") & (t.rlike(r"\p{L}") | t.rlike(r"^\d{4,}$")))
    return F.array_distinct(F.concat(compound, with_digits))


class Evidence:
    """What a text offers to the terms of queries: its tokens, and the starts and trigrams by which others are related to them."""

    def __init__(self, text: str) -> None:
        self.tokens = set(tokenize(text))
        self.starts = {t[:4] for t in self.tokens if len(t) >= 4}
        self.long = [(len(t), {t[k : k + 3] for k in range(len(t) - 2)}) for t in self.tokens if len(t) >= 7]

    def related(self, term: str) -> bool:
        """Whether a token is equal, starts with the same four characters, or is alike by trigrams, long and of like length."""
        if term in self.tokens or (len(term) >= 4 and term[:4] in self.starts):
            return True
        if len(term) < 7:
            return False
        own = {term[k : k + 3] for k in range(len(term) - 2)}
        return any(abs(n - len(term)) <= 1 and 4 * len(own & grams) >= len(own) + len(grams) for n, grams in self.long)


_IDENTIFIER = re.compile(r"[^\W_]+(?:[-_][^\W_]+)+")


def compound_words(text: str) -> set[str]:
    """``identifiers`` of a text in Python."""
    return set(_IDENTIFIER.findall(normalized(text)))


@lru_cache(10_000)
def _wanted(query: str) -> tuple[list[str], list[str]]:
    """(anchors, tokens) of a query."""
    own = tokenize(query)
    compound = [i for i in _IDENTIFIER.findall(normalized(query)) if re.search(r"\d|_", i)]
    digits = [t for t in own if len(t) >= 4 and re.search(r"\d", t) and (re.search(r"[^\W\d_]", t) or re.match(r"\d{4,}$", t))]
    return list(dict.fromkeys(compound + digits)), list(dict.fromkeys(own))


def same_identifier(a: str, b: str) -> bool:
    """As many parts, each pair equal or one edit apart when long; parts of digits must be equal."""
    x, y = re.split("[-_]", a), re.split("[-_]", b)
    return len(x) == len(y) and all(p == q or (not (p.isdigit() and q.isdigit()) and len(p) >= 7 and len(q) >= 7 and one_edit(p, q)) for p, q in zip(x, y))


def one_edit(a: str, b: str) -> bool:
    """Whether one replacement, insertion or deletion at most makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (c, d) in enumerate(zip(a, b)) if c != d), len(a))
    return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def supports(query: str, text: str) -> bool:
    """Whether a text supports a query: one of its anchors if it has any, else any related token."""
    anchored, terms = _wanted(query)
    own = Evidence(text)
    if not anchored:
        return any(map(own.related, terms))
    if not own.tokens.isdisjoint(anchored):
        return True
    found = set(_IDENTIFIER.findall(normalized(text)))
    return any(same_identifier(a, i) for a in anchored for i in found)


@F.pandas_udf(T.BooleanType())
def has_evidence(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([q is not None and t is not None and supports(q, t) for q, t in zip(query, text)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def matched_terms(query: pd.Series, text: pd.Series) -> pd.Series:
    """The distinct tokens of a query that a token of the text is related to."""
    out = []
    for q, t in zip(query, text):
        own = Evidence(t or "")
        out.append([x for x in _wanted(q or "")[1] if own.related(x)])
    return pd.Series(out)


def identifiers_related(a: Column, b: Column) -> Column:
    """Same number of parts, each pair equal or one edit apart when long; parts of digits must be equal."""
    x, y = F.split(a, "[-_]"), F.split(b, "[-_]")

    def part(p: Column) -> Column:
        l, r = p["x"], p["y"]
        digits = l.rlike(r"^\d+$") & r.rlike(r"^\d+$")
        near = (F.length(l) >= 7) & (F.length(r) >= 7) & (F.abs(F.length(l) - F.length(r)) <= 1) & (F.levenshtein(l, r, 1) >= 0)  # -1 beyond one
        return (l == r) | (~digits & near)

    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda l, r: F.struct(l.alias("x"), r.alias("y"))), part)
