"""Personal data in free text: found in a normalised reading of the text, replaced at the source characters.

``Reading`` is the output of a transducer with an offset map: full-width, mathematical, enclosed and look-alike characters,
digits of other scripts, zero-width characters, character references, digits spelled in the eight languages of the texts
and written-out at and dot signs become what they stand for, and every normalised character knows the source characters it came from. Identifiers are detected in the reading; where they have
check digits a number that fails them is none.

Null texts stay null, empty ones empty; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")

# ---- reading ---------------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοօսոհɑɡı",
    "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXoounhagi",
)
#: Digits as words, zero to nine, in the languages of the texts; the last are other words for some.
_DIGIT_WORDS = [
    "zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve", "zero um dois três quatro cinco seis sete oito nove", "zero uno due tre quattro cinque sei sette otto nove",
    "nul een twee drie vier vijf zes zeven acht negen", "零 一 二 三 四 五 六 七 八 九",
]
SPELLED = {w: str(d) for words in _DIGIT_WORDS for d, w in enumerate(words.split())} | {"oh": "0", "zwo": "2", "uma": "1", "duas": "2", "une": "1", "〇": "0", "幺": "1"}
_IDEOGRAPHS = "".join(w for w in SPELLED if not w.isascii() and len(w) == 1)
_DIGIT_WORD = "|".join(sorted((w for w in SPELLED if w not in _IDEOGRAPHS), key=lambda w: (-len(w), w)))
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "doppio": 2, "dubbel": 2, "triple": 3}
_MORE = rf"(?:(?:{'|'.join(_TIMES)})[ -])?"
#: Format and zero-width characters, full-width, mathematical and enclosed ones, look-alikes, and digits of other scripts.
_ODD_CHARACTER = r"[\u200b-\u200d\u2060\ufeff\u00ad]|[！-～]|[\U0001d400-\U0001d7ff\u2460-\u24ff]|[Ͱ-ϿЀ-ԯօսոհɑɡı]|(?![0-9])\d"
_RULES = re.compile(
    r"(?P<entity>&(?:#64|#x40|commat);)"
    r"|(?P<dotentity>&(?:#46|#x2e|period);)"
    r"|(?P<at>\s*[\(\[\{<]\s*(?:at|ät|arobase|arroba|chiocciola|@)\s*[\)\]\}>]\s*)"
    r"|(?P<dot>\s*[\(\[\{<]\s*(?:dot|punkt|point|punto|ponto|punt|\.)\s*[\)\]\}>]\s*)"
    r"|(?P<atdot>(?<=[\w])\s+at\s+(?=[\w-]+(?:\s+dot\s+[\w-]+)+\b))"
    r"|(?P<dotword>(?<=[\w])\s+dot\s+(?=[\w-]+))"
    r"|(?P<spaced>(?<=\w)\s?[@＠]\s(?=\w)|(?<=\w)\s[@＠](?=\w+[\w-]*\.))"
    rf"|(?P<digits>(?<![\w-]){_MORE}(?:{_DIGIT_WORD})(?:[ ,-]+{_MORE}(?:{_DIGIT_WORD})){{5,}}(?![\w-])|[{_IDEOGRAPHS}]{{7,}})"
    rf"|(?P<odd>{_ODD_CHARACTER})",
    re.I,
)
_BRACKETED = re.compile(r"[\(\[\{<]\s*(?:at|ät|arobase|arroba|chiocciola|@|dot|punkt|point|punto|ponto|punt)\s*[\)\]\}>]|&(?:#|commat|period)", re.I)
_ODD = re.compile(_ODD_CHARACTER)
_digit_words = None


def _spells_digits(low: str) -> bool:
    """Whether six digits stand in a text as words, the least that a number is spelled with."""
    global _digit_words
    if _digit_words is None:
        _digit_words = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in SPELLED:
            _digit_words.add_word(word)
        _digit_words.make_automaton()
    found = 0
    for end, length in _digit_words.iter(low):
        after, before = low[end + 1 : end + 2], low[end - length : end - length + 1]
        if low[end] in _IDEOGRAPHS or not (after.isalnum() or (end >= length and before.isalnum())):
            found += 1
            if found >= 6:
                return True
    return False


def _disguised(text: str) -> bool:
    """Whether any rule of the transducer may apply; plain tests first, as most texts have nothing."""
    low = text.lower()
    if " dot " in low or "@ " in text or " @" in text:
        return True
    if ("(" in text or "[" in text or "&" in text or "{" in text or "<" in text) and _BRACKETED.search(text):
        return True
    if not text.isascii() and _ODD.search(text):
        return True
    return _spells_digits(low)


class Reading:
    """A normalised text; ``source(s, e)`` gives the source span of normalised characters."""

    def __init__(self, text: str) -> None:
        self.source_text, self.text, self.starts, self.ends = text, text, None, None
        if not _disguised(text):
            return
        out: list[str] = []
        starts: list[int] = []
        ends: list[int] = []

        def put(chars: str, s: int, e: int) -> None:
            out.append(chars)
            starts.extend([s] * len(chars))
            ends.extend([e] * len(chars))

        at = 0
        for m in _RULES.finditer(text):
            for k in range(at, m.start()):
                put(text[k], k, k + 1)
            at, kind = m.end(), m.lastgroup
            if kind in ("entity", "at", "atdot", "spaced"):
                put("@", m.start(), m.end())
            elif kind in ("dotentity", "dot", "dotword"):
                put(".", m.start(), m.end())
            elif kind == "digits":
                times = 1
                for w in re.finditer(rf"[{_IDEOGRAPHS}]|[^\W\d_]+", m[0]):
                    word = w[0].lower()
                    if word in _TIMES:
                        times = _TIMES[word]
                        continue
                    put(SPELLED[word] * times, m.start() + w.start(), m.start() + w.end())
                    times = 1
            else:
                if unicodedata.category(m[0]) == "Nd":
                    put(str(unicodedata.digit(m[0])), m.start(), m.end())
                elif unicodedata.category(m[0]) != "Cf":
                    put(unicodedata.normalize("NFKC", m[0]).translate(LOOKALIKES), m.start(), m.end())
        for k in range(at, len(text)):
            put(text[k], k, k + 1)
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def source(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.starts is None else (self.starts[s], self.ends[e - 1])


# ---- checks ----------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def identity_letter(number: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23]


# ---- patterns --------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?<![\w.+@/:-])[A-Za-z0-9](?:[\w.+'-]*[\w+])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@]|\.[A-Za-z]|-[\w.-]*:)(?!:[\w~/.-])")
EMAIL_AFTER = re.compile(r"(?:mailto|e-?mail|mail|contact|adresse électronique|correo)\s*[:=/]\s*$", re.I)
PHONE = re.compile(
    r"(?<![\w+.@#-])(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}"
    r"|00[1-9]\d{8,12}"
    r"|(?:1[-. ])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|(?:1[-. ])?\d{3}([.\- ])\d{3}\1\d{4}"
    r"|0\d(?:[. -]?\d{2}){4}"
    r"|(?<!\d )\(?0\d{2,5}\)?[ /-]\d{3,8}(?:[ -]\d{1,6}){0,2}(?! \d)"
    r")(?:,?\s*(?:ext\.?|extension|extn\.?|x|poste|durchwahl|apdo\.?)\s*\d{1,6})?(?![\w@-]|\.\d)",
    re.I,
)
#: A number without any grouping; taken only where it was spelled in words.
SPOKEN = re.compile(r"(?<![A-Za-z0-9_+.@#-])\d{9,13}(?![A-Za-z0-9_@-]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
NINO = re.compile(r"(?<![\w-])[A-Z]{2}([ -]?)\d{2}\1\d{2}\1\d{2}\1[A-D](?![\w-])")
IDENTITY = re.compile(r"(?<![\w-])(\d{8})[- ]?([A-Z])(?![\w-])")
PASSPORT = re.compile(r"(?<![\w-])[A-Z]{1,2}\d{6,8}(?![\w-])")
PASSPORT_LABEL = re.compile(r"(?:passport|travel doc|reisepass|passeport|pasaporte|passaporto|paspoort)[^\n]{0,24}$", re.I)
NUMBER_LABEL = re.compile(r"(?:social\s*sec|soc\.?\s*sec|ssn|sozialvers|sécurité\s+sociale)[^\n]{0,24}$", re.I)
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![\w-])")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")

#: What every identity number has somewhere.
ID_GATE = re.compile(r"[A-Z]{1,2}[ -]?\d\d[ \d-]|\d{3}[- ]\d\d[- ]|\d{8}|\d{4}[ -]\d{4}")

#: Words of streets.
_AFTER = r"(?:(?:Street|Road|Avenue|Lane|Drive|Court|Close|Square|Terrace|Way|Boulevard|Crescent|Place|Row|Walk|Gardens|Grove|Hill|Mews|Parade|Alley|Quay|Green|Rise|Highway|Parkway)\b|(?:St|Rd|Ave|Ln|Dr|Ct|Sq|Blvd|Cres|Pl|Hwy|Pkwy)\b\.?)"
_WORD = r"[A-ZÀ-Þ][\wÀ-ÿ'’-]*"
_HOUSE = r"\d{1,4}(?:[a-zA-Z]|\s?(?:bis|ter))?"
STREETS = re.compile(
    rf"(?<![\w.\-/+])(?:"
    rf"{_HOUSE},?\s+(?:{_WORD}\s+){{1,3}}{_AFTER}(?!\s*\d)"
    rf"|{_HOUSE},?\s+(?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route|passage|sentier)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s?)*{_WORD}(?: (?:(?:de|du|des|la|le|les) )?{_WORD}){{0,2}}"
    rf"|(?:{_WORD}\s)?{_WORD}(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Ww]eg|[Gg]asse|[Pp]latz|[Aa]llee|[Uu]fer|[Rr]ing|[Dd]amm|STRASSE|STRAßE|WEG|straat|laan|plein|gracht|kade)\s+{_HOUSE}(?!\s?[%€\w])"
    rf"|(?:Calle|CALLE|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Via|Viale|Piazza|Corso|Vicolo|Rua|Travessa|Praça|Largo|Alameda)\s+(?:(?:de|del|da|do|dos|das|di|la|las|los|della|dei)\s+)*{_WORD}(?:\s+(?:(?:de|del|da|do|di|la)\s+)?{_WORD})*,?\s+(?:n[.º°o]*\s*)?{_HOUSE}(?![\w%])"
    rf")"
)
_NOT_STREET = re.compile(r"^(?:January|February|March|April|May|June|July|August|September|October|November|December)\b")

# ---- names -----------------------------------------------------------------------------------------------------------

#: Capitalised words that stand before a family name without being a given name.
NO_GIVEN = frozenset(
    "Calle Avenida Plaza Paseo Via Rua Upper Lower Old New North South East West Great Little Saint St Mount The A An And At By For From In Of On To With"
    " Mr Mrs Ms Miss Mx Dr Prof Sir Lady Frau Herr Herrn Mme Mlle Monsieur Madame Señor Señora Sr Sra Don Doña Dott Sig Signora Signor Dhr Mevr"
    " Dear Caller Contact Name Address Email Phone Fax Mobile Tel See This That These Those Its Their Our Your His Her Each Every Another One Please Regards"
    " Kind When Where However Before After Since Then Meanwhile Also".split()
)
#: Capitalised words that follow a given name without being a family name.
NO_FAMILY = frozenset(
    "Street Road Avenue Lane Drive Court Close Square Terrace Way Boulevard Crescent Place Row Walk Gardens Grove Hill Mews Parade Alley Quay Green Rise Highway Parkway House Hall Park"
    " Bank University School College Hospital Institute Foundation Department Office Team Group Company Centre Center Committee Council Project Report Page Section Chapter Ltd Inc Llc Gmbh Plc".split()
)
#: Characters before a family name in which its given part is looked for.
NAME_REACH = 120
_GIVEN = r"[A-ZÀ-Þ][\wÀ-ÿ]+(?:-[A-ZÀ-Þ][\wÀ-ÿ]+)?"
_CAPITAL = re.compile(r"(?<![\w@+])[A-ZÀ-Þ][a-zA-ZÀ-ÿ]{2,}(?:-[A-ZÀ-Þ][a-zA-ZÀ-ÿ]+)*(?![\w@+]|-[\w.+-]*@)")
_LEFT = re.compile(rf"(?<![\w@+.\-/])({_GIVEN}(?:\s(?:[A-ZÀ-Þ]\.\s?)+|\s)|(?:[A-ZÀ-Þ]\.\s?)+)$")
_RIGHT = re.compile(rf",\s(?:({_GIVEN})(?![\w@+]|\.\w)(?:\s(?:[A-Z]\.)+)?|((?:[A-Z]\.\s?)+)(?!\w))")


class NameBook:
    """Given and family names of a lexicon, and the beginnings and endings its family names are made of."""

    def __init__(self, rows: Iterable[tuple[str, str]]) -> None:
        rows = [(t, k) for t, k in rows if t]
        self.given = {t.title() for t, k in rows if k == "given"}
        self.family = {t.title() for t, k in rows if k == "family"}
        heads: dict[str, set] = {}
        tails: dict[str, set] = {}
        for t in self.family:
            for k in range(3, len(t) - 2):
                heads.setdefault(t[:k], set()).add(t[k:])
                tails.setdefault(t[k:], set()).add(t[:k])
        self.heads = {h for h, s in heads.items() if len(s) >= 3}
        self.tails = {h for h, s in tails.items() if len(s) >= 3}
        self.is_family = lru_cache(100_000)(self._is_family)

    def _is_family(self, word: str) -> bool:
        if "-" in word:
            return all(self._is_family(part) for part in word.split("-"))
        w = word.title()
        if w in self.family:
            return True
        if w in self.given:
            return False
        return any(w[:k] in self.heads and w[k:] in self.tails for k in range(3, len(w) - 2))

    def knows_given(self, word: str) -> bool:
        return word.title() in self.given


def _names(text: str, book: NameBook) -> Iterator[tuple[int, int]]:
    end = -1
    for m in _CAPITAL.finditer(text):
        if m.start() < end:
            continue
        stop = m.end()
        if not book.is_family(m[0]):
            begin = _named_by_given(text, m, book)
            if begin is not None and begin >= end:
                yield begin, stop
                end = stop
            continue
        left = _LEFT.search(text, max(0, m.start() - NAME_REACH, end), m.start())
        if left:
            begin, given = left.start(), re.match(_GIVEN, left[1])
            word = given[0] if given else ""
            if word.title() in NO_GIVEN and "." in left[1]:  # a title and an initial
                begin, word = left.start() + len(re.match(rf"{_GIVEN}\.?\s+", left[1])[0]), ""
            initial = not word
            ordinary = word.isupper() != m[0].isupper() and len(word) > 1
            if (initial and not ordinary) or (
                not initial
                and word.title() not in NO_GIVEN
                and not ordinary
                and (book.knows_given(word) or ("\n" not in left[1] and not book.is_family(word)))
                and not (m[0].title() in ("Page",) and re.match(r"\s*\d", text[stop:]))
            ):
                yield begin, stop
                end = stop
                continue
        right = _RIGHT.match(text, stop)
        if right:
            word = right[1]
            if word is None or book.knows_given(word) or (word.title() not in NO_GIVEN and not re.search(r"\d[\w, º°]*$", text[max(0, m.start() - 12) : m.start()]) and word.lower() not in _STARTERS):
                yield m.start(), right.end(1) if word is not None and right.end() == right.end(1) else right.end()
                end = right.end()


#: A title or a label, and the full name of two words or more that it announces.
_ANNOUNCED = re.compile(
    r"(?:\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Frau|Herrn?|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Signora?|Dhr|Mevr)\.?|\b(?:Name|Contact|Attn|Patient|Signed|Kontakt|Nom|Nombre|Nome|Naam)\s?:)[ \t]+"
    rf"({_GIVEN}(?: [A-ZÀ-Þ]\.)* [A-ZÀ-Þ][a-zà-ÿ]{{2,}}(?:-[A-ZÀ-Þ][a-zà-ÿ]+)?)(?![\w@+]|-[\w.+-]*@)"
)
_GIVEN_BEFORE = re.compile(rf"(?<![\w@+.\-/])({_GIVEN}) (?:[A-ZÀ-Þ]\. ?)*$")


def _named_by_given(text: str, m: re.Match, book: NameBook) -> int | None:
    """Where a name begins whose family part no lexicon has: a known given name stands before it, in the same case."""
    at = m.start()
    if text[at - 1 : at] != " " or m[0].title() in NO_FAMILY or m[0].title() in NO_GIVEN or m[0].lower() in _STARTERS or book.knows_given(m[0]):
        return None
    left = _GIVEN_BEFORE.search(text, max(0, at - NAME_REACH), at) if text[at - 2].isalpha() or text[at - 2] == "." else None
    return left.start(1) if left and book.knows_given(left[1]) and left[1].isupper() == m[0].isupper() else None


#: Words that start sentences after a place name and a comma.
_STARTERS = frozenset(
    "also außerdem jedoch además también inoltre além ook the this that these those its their our your his her each every another one no any all some both in on at by for from of to with before after since when"
    " where while as if à but and or see please write also however meanwhile then thus so der die das ein eine le la les un une el los las una il lo gli i o os uma de het een".split()
)

# ---- detection -------------------------------------------------------------------------------------------------------



def detect(text: str, book: NameBook) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal values in ``text``, in order and disjoint, in source positions."""
    if not text:
        return []
    reading = Reading(text)
    t = reading.text
    taken: list[tuple[int, int, str]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b, _ in taken)

    def take(s: int, e: int, kind: str) -> None:
        if free(s, e):
            taken.append((s, e, kind))

    if "@" in t:
        for m in EMAIL.finditer(t):
            if not re.search(r"://[^\s/]*$", t[max(0, m.start() - 80) : m.start()]):
                take(*m.span(), "email")
        for m in re.finditer(r"(?<=[:/])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@]|\.[A-Za-z])(?!:[\w~/.-])", t):
            if EMAIL_AFTER.search(t[max(0, m.start() - 30) : m.start()]):
                take(*m.span(), "email")
    if re.search(r"\d", t):
        ids = ID_GATE.search(t)
        for m in IBAN.finditer(t) if ids else ():
            account = re.sub(r"[ -]", "", m[0])
            # the last group may be a following word: give it up when only the shorter one checks
            for cut in (account, account[: len(account) - len(re.search(r"[A-Z0-9]*$", m[0])[0])]):
                if 15 <= len(cut) <= 34 and mod97(cut):
                    e = m.end() if cut is account else m.start() + len(m[0].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789").rstrip(" -"))
                    take(m.start(), e, "id_number")
                    break
        for m in CARD.finditer(t) if ids else ():
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19 and not digits.startswith("00") and luhn(digits):
                take(*m.span(), "id_number")
        for m in SSN.finditer(t) if ids else ():
            if m[1] == "-" or NUMBER_LABEL.search(t[max(0, m.start() - 44) : m.start()]):
                take(*m.span(), "id_number")
        for m in NINO.finditer(t) if ids else ():
            take(*m.span(), "id_number")
        for m in IDENTITY.finditer(t) if ids else ():
            if m[2] == identity_letter(m[1]):
                take(*m.span(), "id_number")
        for m in PASSPORT.finditer(t) if ids else ():
            if PASSPORT_LABEL.search(t[max(0, m.start() - 44) : m.start()]):
                take(*m.span(), "id_number")
        for m in PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 20:
                take(*m.span(), "phone")
        if reading.starts is not None:
            for m in SPOKEN.finditer(t):
                if text[slice(*reading.source(*m.span()))] != m[0]:
                    take(*m.span(), "phone")
        for m in STREETS.finditer(t):
            body = re.sub(r"^[\d, ]+[a-z]?\s+", "", m[0])
            if not _NOT_STREET.match(body):
                end = m.end()
                while (last := re.search(r"\s+(\S+)$", t[m.start() : end])) and last[1].lower() in _STARTERS:
                    end = m.start() + last.start()
                take(m.start(), end, "address")
    for s, e in _names(t, book):
        take(s, e, "name")
    for m in _ANNOUNCED.finditer(t):
        words = re.split(r"[ -]", m[1])
        if not any(w.title() in NO_GIVEN or w.title() in NO_FAMILY or w.lower() in _STARTERS for w in words):
            take(*m.span(1), "name")
    return sorted((*reading.source(s, e), kind) for s, e, kind in taken)


def redact(text: str, book: NameBook) -> tuple[str, int]:
    """The text with each value replaced by a placeholder of its kind, and the number of values."""
    out, at, n = [], 0, 0
    for s, e, kind in detect(text, book):
        out += [text[at:s], f"[{kind.upper()}]"]
        at, n = e, n + 1
    return "".join([*out, text[at:]]), n


def name_rows(lexicon: DataFrame, bound: int = 100_000) -> list[tuple[str, str]]:
    """The (token, name_part) rows of a name lexicon, which is a fixed table; more than ``bound`` of them are an error."""
    rows = lexicon.select("token", "name_part").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"a name lexicon may have {bound} rows")
    return [(r[0], r[1]) for r in rows]


def find(df: DataFrame, lexicon: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, kind, char_pos) of each personal value."""
    names = name_rows(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = NameBook(names)
        for batch in it:
            ids, kinds, at = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s, _, kind in detect(t, book):
                    ids.append(i)
                    kinds.append(kind)
                    at.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(at, pa.int64())], ["row_id", "kind", "char_pos"])

    rows = spread(df.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    return rows.mapInArrow(run, "row_id long, kind string, char_pos long")


def redacted(df: DataFrame, lexicon: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, text, redactions) of all rows; a null text stays null with 0 redactions."""
    names = name_rows(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = NameBook(names)
        for batch in it:
            done = [(None, 0) if t is None else redact(t, book) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["row_id", "text", "redactions"]
            )

    return spread(df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")), "row_id").mapInArrow(run, "row_id long, text string, redactions int")
