"""Repair of text from scanned pages: hyphenated line ends, misread characters, running headers and page numbers.

Averaged perceptrons do the deciding. The editor scores character operations (keep, replace, delete, insert, and at line
ends join, join with the hyphen or keep apart) by the characters around them and by whether what comes out is spelled like
the words of the corpus; whole words only add how common they are. An unknown word becomes the best of the known words
within reach and of what the character operations make of it alone, which may be a word that no vocabulary has. The
furniture classifier sees every line and calls it body, header or page number by its shape, length, place on the page and
how often it returns in its file. All are trained on clean rows of the same table, damaged on purpose: a bounded sample
for the weights, word counts over all rows for the vocabulary.

Rows without a page, null and empty texts have no damage.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.operators.lexical import small
from lodespark.session import spread, stash

#: Clean rows that train the perceptrons at most, those with the smallest hashes of their ids.
TRAINING_ROWS = 1_500
#: Times that a word stands in clean prose before it counts as known, and its least share of the words of all prose, so that
#: chance strings don't become known as the table grows. A share bounds the vocabulary: 1,000,000 words at most, 100 MB on an executor.
LEAST_COUNT, LEAST_SHARE = 3, 1e-6
#: Words a task counts before it hands the counts on.
COUNTED = 300_000
EPOCHS = 5
#: Words and line ends of the training rows that train the editor at most.
TRAINING_WORDS, TRAINING_ENDS = 8_000, 6_000
#: Share of clean words the vocabulary lacks that may be rewritten to another unknown word, on held-out ones.
SPOILED = 0.0005

#: What scanners read, and what stands on the page.
MISREADINGS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("0", "o"), ("o", "0"),
    ("1", "l"), ("1", "i"), ("l", "1"), ("|", "l"), ("!", "l"), ("b", "h"), ("h", "b"), ("(", "c"), ("5", "s"), ("$", "s"), ("n", "u"), ("u", "n"), ("rn", "m"),
    ("m", "rn"), ("v", "y"), ("y", "v"), ("9", "g"), ("g", "q"), ("q", "g"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("h", "li"), ("li", "h"), ("8", "b"),
    ("6", "b"), ("3", "e"), ("4", "a"), ("2", "z"), ("7", "t"), ("a", "o"), ("o", "a"), ("s", "5"), ("tr", "m"), ("nn", "m"), ("in", "m"), ("iii", "m"), ("j", "i"),
    ("é", "è"), ("è", "é"), ("o", "ö"), ("u", "ü"), ("a", "ä"), ("e", "é"), ("e", "è"), ("a", "à"), ("c", "ç"), ("n", "ñ"),
]
#: Marks that divide a word at a line end.
DIVIDERS = "-­¬‐‑=~"

_MOST_EDITS = 3
_BY_SEEN: dict[str, list[str]] = defaultdict(list)
for _seen, _true in MISREADINGS:
    _BY_SEEN[_seen].append(_true)
_TO_DAMAGE: dict[str, list[str]] = defaultdict(list)
for _seen, _true in MISREADINGS[:46]:
    _TO_DAMAGE[_true].append(_seen)

#: A word with the odd characters that misreading puts into it.
_PART = r"[^\W\d_](?:[^\W_]|[(|!$](?=[^\W\d_]))*|[(|!$\d](?=[^\W\d_])[^\W_](?:[^\W_]|[(|!$](?=[^\W\d_]))*"
TOKEN = re.compile(rf"(?:{_PART})(?:-(?:{_PART}))*")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’‐–—-][^\W\d_]+)*")
_AROUND = "\"'()[]«»„“”‘’*.,;:!?…"
_POINTS = re.compile("[，。、；：！？（）《》「」]")
_DIVIDED = re.compile(rf"([^\W_])([{re.escape(DIVIDERS)}])[ \t]*$")
_D = r"[\dlIOoSiB|]"
_ROMAN = r"[ivxlcIVXLC1|]{1,8}"
_NUMBER = rf"(?:[-–—]\s?{_D}{{1,4}}\s?[-–—]|\[\s?{_D}{{1,4}}\s?\]|\(\s?{_D}{{1,4}}\s?\)|{_D}{{1,4}}\s?/\s?{_D}{{1,4}}|[Pp][ae.i][^\W\d_]{{0,3}}\.?\s?{_D}{{1,4}}(?:\s(?:of|o[ft]|von|de|sur|di|van)\s{_D}{{1,4}})?|[A-Z5$][^\s\d]{{2,6}}\.?\s{_D}{{1,4}}(?:\s[^\W\d_(]{{1,3}}\s{_D}{{1,4}})?|{_D}{{1,4}}|{_ROMAN})"
_ALONE = re.compile(rf"\s*{_NUMBER}\s*")
_LEADING = re.compile(rf"\s*({_NUMBER})\s*(?:\||\s{{3,}}|\t)\s*(\S.*)")
_TRAILING = re.compile(rf"\s*(\S.*?)\s*(?:\||\s{{3,}}|\t)\s*({_NUMBER})\s*")
_FOLD_PAIRS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("ii", "n"), ("li", "h")]
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "$": "s", "9": "g", "q": "g", "(": "c", "e": "c", "b": "h", "f": "t", "u": "n", "v": "y"})


def fold(line: str) -> str:
    """A key that a header and its misread copies share."""
    s = re.sub(r"\s+", " ", line.lower()).strip(" .,:;|-—–")
    for a, b in _FOLD_PAIRS:
        s = s.replace(a, b)
    return s.translate(_FOLD)


# ---- averaged perceptron ---------------------------------------------------------------------------------------------


class Perceptron:
    """Multiclass averaged perceptron over sets of string features."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float)
        self._total: dict[tuple[str, str], float] = defaultdict(float)
        self._seen: dict[tuple[str, str], int] = defaultdict(int)
        self._step = 0

    def score(self, label: str, features: list[str]) -> float:
        w = self.weights
        return sum(w.get((label, f), 0.0) for f in features)

    def change(self, label: str, features: list[str], by: float) -> None:
        for f in features:
            key = (label, f)
            self._total[key] += (self._step - self._seen[key]) * self.weights[key]
            self._seen[key] = self._step
            self.weights[key] += by

    def step(self) -> None:
        self._step += 1

    def average(self) -> None:
        for key, w in self.weights.items():
            self._total[key] += (self._step - self._seen[key]) * w
        self.weights = {k: v / max(1, self._step) for k, v in self._total.items() if v}
        self._total, self._seen = {}, {}


# ---- editor ----------------------------------------------------------------------------------------------------------

Edit = tuple[int, str, str]


class Vocabulary(dict):
    """Counts of known words, with what tells whether one begins with some letters and how words are spelled."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(counts)
        self.sorted = sorted(counts)
        grams: Counter = Counter()
        for w in counts:
            grams.update({f"^{w}$"[k : k + 3] for k in range(len(w))})
        self.grams = {g for g, n in grams.items() if n > 1}

    def __reduce__(self):
        return Vocabulary, (dict(self),)

    def begins(self, letters: str) -> bool:
        k = bisect_left(self.sorted, letters)
        return k < len(self.sorted) and self.sorted[k].startswith(letters)

    def spelled(self, letters: str) -> bool:
        """Whether all runs of three of the letters stand in at least two words."""
        return all(letters[k : k + 3] in self.grams for k in range(len(letters) - 2))


def candidates(word: str, known: Vocabulary) -> list[tuple[str, tuple[Edit, ...]]]:
    """Known words that up to three replacements of misreadings make of a word, each with its fewest edits.

    The search goes through the word from the left and keeps only what some known word begins with, so its length doesn't
    limit the edits.
    """
    out: dict[str, tuple[Edit, ...]] = {}
    size = len(word)

    def walk(at: int, made: str, edits: tuple[Edit, ...]) -> None:
        if at == size:
            if edits and made in known and made != word and (made not in out or len(edits) < len(out[made])):
                out[made] = edits
            return
        if known.begins(made + word[at]):
            walk(at + 1, made + word[at], edits)
        if len(edits) < _MOST_EDITS:
            for n in (1, 2, 3):
                for true in _BY_SEEN.get(word[at : at + n], ()) if at + n <= size else ():
                    if known.begins(made + true):
                        walk(at + n, made + true, (*edits, (at, word[at : at + n], true)))

    walk(0, "", ())
    fewest = min((len(e) for e in out.values()), default=0)
    return [(w, e) for w, e in out.items() if len(e) == fewest]


def character_features(word: str, edit: Edit, made: str, known: Vocabulary) -> list[tuple[str, list[str]]]:
    """(operation, features) of the characters of one edit; ``made`` is the word before it as already repaired."""
    k, seen, true = edit
    before, rest = made[-1:] or "^", word[k + len(seen) :]
    after = rest[:1] or "$"
    left = f"^{made}"[-2:]
    was, now = known.spelled(left + seen + f"{rest}$"[:2]), known.spelled(left + true + f"{rest}$"[:2])
    out = [("replace", [f"{seen}>{true}", f"{seen}>{true}|{before}", f"{seen}>{true}|{after}", f"was={was}|now={now}", f"{seen}>{true}|was={was}|now={now}"])]
    if len(seen) > len(true):
        out.append(("delete", [f"{seen}>{true}", f"now={now}"]))
    elif len(seen) < len(true):
        out.append(("insert", [f"{seen}>{true}", f"now={now}"]))
    return out


def edit_features(word: str, edits: tuple[Edit, ...], count: int, known: Vocabulary) -> list[tuple[str, list[str]]]:
    """(operation, features) of every character operation but the plain keeps, and of the word as a whole."""
    odd = any(not c.isalpha() for c in word)
    if not edits:
        return [("keep", ["word", f"odd={odd}", f"length={min(len(word), 12)}", f"spelled={known.spelled(f'^{word}$')}"])]
    out = [("rewrite", ["word", f"edits={len(edits)}", f"odd={odd}", f"length={min(len(word), 12)}", f"count={min(count.bit_length(), 8)}", f"known={count > 0}|odd={odd}|edits={len(edits)}"])]
    made, at = "", 0
    for edit in edits:
        made += word[at : edit[0]]
        out += character_features(word, edit, made, known)
        made, at = made + edit[2], edit[0] + len(edit[1])
    return out


LINE_ENDS = ("apart", "join", "hyphen")


@dataclass
class Editor:
    vocabulary: Vocabulary
    weights: Perceptron
    line_weights: Perceptron
    #: By how much a word that no vocabulary has must be better than the one that stands there.
    margin: float = 0.0
    seen: dict[str, str | None] = field(default_factory=dict)

    def score(self, word: str, edits: tuple[Edit, ...], count: int) -> float:
        return sum(self.weights.score(op, fs) for op, fs in edit_features(word, edits, count, self.vocabulary))

    def by_characters(self, word: str) -> tuple[str, tuple[Edit, ...]]:
        """What the operations make of a word alone: from the left the best at each character, where one is better than to keep it."""
        made, at, edits = "", 0, []
        while at < len(word):
            best, top = None, 0.0
            for n in (1, 2, 3):
                for true in _BY_SEEN.get(word[at : at + n], ()) if at + n <= len(word) else ():
                    edit = (at, word[at : at + n], true)
                    value = sum(self.weights.score(op, fs) for op, fs in character_features(word, edit, made, self.vocabulary))
                    if value > top:
                        best, top = edit, value
            if best is None:
                made, at = made + word[at], at + 1
            else:
                edits.append(best)
                made, at = made + best[2], at + len(best[1])
        return made, tuple(edits)

    def options(self, word: str, known: list[tuple[str, tuple[Edit, ...]]]) -> list[tuple[str, tuple[Edit, ...], int]]:
        """The word itself, the known words within reach and what the characters alone give, with their counts."""
        alone = self.by_characters(word)
        out = [(word, (), 0), *((w, e, self.vocabulary[w]) for w, e in known)]
        return out + [(*alone, 0)] if alone[1] and alone[0].isalpha() and alone[0] not in self.vocabulary else out

    def correct(self, word: str) -> str | None:
        """What an unknown word should be, or None to keep it. Capitals stay where the letters do."""
        low = word.lower()
        if low in self.vocabulary or len(low) < 2:
            return None
        if low not in self.seen:
            if len(self.seen) > COUNTED:
                self.seen.clear()
            scored = [(self.score(low, e, n) - (self.margin if e and not n else 0.0), w, e) for w, e, n in self.options(low, candidates(low, self.vocabulary))]
            best = max(scored, key=lambda x: x[0])
            self.seen[low] = best[1] if best[2] else None
        best = self.seen[low]
        if best is None:
            return None
        if word.isupper():
            return best.upper()
        return best[:1].upper() + best[1:] if word[:1].isupper() else best

    def correct_compound(self, word: str) -> str | None:
        """The known compound that is meant, or the compound of the corrected parts."""
        new = self.correct(word)
        if new is not None:
            return new
        parts = word.split("-")
        fixed = [self.correct(p) for p in parts]
        return None if not any(fixed) else "-".join(f or p for f, p in zip(fixed, parts))

    def join(self, left: str, mark: str, right: str) -> str:
        """apart, join or hyphen: whether what stands around a mark at a line end is one word, and whether the mark stays in it."""
        fs = join_features(left, mark, right, self.vocabulary)
        return max(LINE_ENDS, key=lambda op: self.line_weights.score(op, fs))


#: Words after a hyphen that stands for the second part of a compound.
SUSPENDED = "and or und oder et ou y o e ed en of bis to nor sowie".split()


def join_features(left: str, mark: str, right: str, vocabulary) -> list[str]:
    whole, compound = (left + right).lower(), f"{left}-{right}".lower()
    kind = lambda s: "none" if not s else "digit" if s[0].isdigit() else "upper" if s[0].isupper() else "lower" if s[0].isalpha() else "other"
    end = "digit" if left[-1:].isdigit() else "upper" if left[-1:].isupper() else "lower"
    soft = mark != "-"
    known, and_ = whole in vocabulary, right.lower() in SUSPENDED and whole not in vocabulary
    return [
        "bias", f"soft={soft}", f"whole={known}", f"compound={compound in vocabulary}", f"parts={left.lower() in vocabulary}{right.lower() in vocabulary}", f"and={and_}", f"and={and_}|soft={soft}",
        f"whole={known}|compound={compound in vocabulary}", f"kinds={end}{kind(right)}", f"kinds={end}{kind(right)}|soft={soft}", f"right={bool(right)}|soft={soft}",
    ]


def _damage(word: str, rng: random.Random) -> tuple[str, int]:
    """The word with one or two misreadings."""
    n = 0
    for _ in range(1 + (rng.random() < 0.25)):
        spots = [(k, t, s) for k in range(len(word)) for t in (word[k : k + 1], word[k : k + 2]) if t for s in _TO_DAMAGE.get(t, ())]
        if not spots:
            break
        k, t, s = rng.choice(spots)
        word = word[:k] + s + word[k + len(t) :]
        n += 1
    return word, n


def train_editor(vocabulary: dict[str, int], texts: list[str], seed: int = 5) -> Editor:
    """An editor trained on words and line ends of clean texts."""
    rng = random.Random(seed)
    words = [w.lower() for t in texts for w in _WORD.findall(t) if len(w) > 2]
    rng.shuffle(words)
    words = words[:TRAINING_WORDS]
    distinct = sorted(set(words))
    held = set(rng.sample(distinct, len(distinct) // 10)) if words else set()
    # what the held words teach is to keep and to repair words that no vocabulary has
    seen = Vocabulary({w: n for w, n in vocabulary.items() if w not in held})
    editor = Editor(seen, Perceptron(), Perceptron())
    cases: list[tuple[str, str]] = []
    for w in words:
        if w in held and rng.random() < 0.7:
            cases.append((w, w))
        elif w in held or w in seen:
            damaged, n = _damage(w, rng)
            if n and damaged not in seen:
                cases.append((damaged, w))
    prepared = [(word, true, candidates(word, seen)) for word, true in cases]
    rng.shuffle(prepared)
    for_margin = [c for c in prepared[: len(prepared) // 5] if c[0] == c[1]]
    prepared = prepared[len(prepared) // 5 :]
    p = editor.weights
    for _ in range(EPOCHS):
        rng.shuffle(prepared)
        for word, true, found in prepared:
            p.step()
            options = editor.options(word, found)
            right = next((o for o in options if o[0] == true), options[0])
            guess = max(options, key=lambda o: editor.score(word, o[1], o[2]))
            if guess[0] != right[0]:
                for op, fs in edit_features(word, right[1], right[2], seen):
                    p.change(op, fs, 1.0)
                for op, fs in edit_features(word, guess[1], guess[2], seen):
                    p.change(op, fs, -1.0)
    p.average()
    # how far unknown rewrites of clean unknown words are above keeping them
    gains = []
    for word, _, found in for_margin:
        options = editor.options(word, found)
        gains += [editor.score(word, e, n) - editor.score(word, (), 0) for _, e, n in options[1:] if not n]
    gains.sort()
    spared = int(SPOILED * len(for_margin))
    editor.margin = max(0.0, gains[-1 - spared] + 1e-9 if len(gains) > spared else 0.0)
    editor.vocabulary = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary(vocabulary)
    editor.seen.clear()
    train_line_ends(editor, texts, rng)
    return editor


def train_line_ends(editor: Editor, texts: list[str], rng: random.Random) -> None:
    """Line ends made of clean words: divided ones, with and without the rest, compounds, and hyphens that stand for a second part."""
    known = editor.vocabulary
    ends: list[tuple[str, list[str]]] = []
    tokens = [w for t in texts for w in re.findall(r"[^\s.,;:!?\"'()]+", t)]
    rng.shuffle(tokens)
    for w in tokens[:TRAINING_ENDS]:
        mark = rng.choice("--" + DIVIDERS[:3] + "=~")
        if "-" in w[1:-1] and rng.random() < 0.9:
            k = rng.choice([i for i, c in enumerate(w) if c == "-" and 0 < i < len(w) - 1] or [0])
            if k:
                ends.append(("hyphen", join_features(w[:k], "-", w[k + 1 :] if rng.random() < 0.9 else "", known)))
        elif len(w) > 4 and w.isalpha():
            k = rng.randrange(2, len(w) - 1)
            ends.append(("join", join_features(w[:k], mark, w[k:] if rng.random() < 0.85 else "", known)))
            if rng.random() < 0.1:
                ends.append(("apart", join_features(w, "-", rng.choice(SUSPENDED), known)))
        elif len(w) > 4 and w.isalnum():  # dates, numbers and identifiers are divided too
            k = rng.randrange(1, len(w))
            ends.append(("join", join_features(w[:k], mark, w[k:], known)))
    q = editor.line_weights
    for _ in range(EPOCHS):
        rng.shuffle(ends)
        for label, fs in ends:
            q.step()
            guess = max(LINE_ENDS, key=lambda op: q.score(op, fs))
            if guess != label:
                q.change(label, fs, 1.0)
                q.change(guess, fs, -1.0)
    q.average()


# ---- furniture -------------------------------------------------------------------------------------------------------


@dataclass
class Line:
    """A line that may be furniture: its number, the rest beside a page number, and what tells furniture from body."""

    at: int
    number: bool
    rest: str
    features: list[str]


def _shape(s: str) -> str:
    """How a line is written: in capitals, as a title, as a sentence's beginning, or otherwise."""
    words = s.split()
    letters = "".join(c for c in s if c.isalpha())
    if letters and sum(c.isupper() for c in letters) >= 0.8 * len(letters):
        return "capitals"
    ups = sum(w[:1].isupper() or not w[:1].isalpha() for w in words)
    return "title" if ups == len(words) else "sentence" if words[0][:1].isupper() else "small"


_INSIDE = re.compile(r"\d{2}|\(\w+-|[.:;?] ")


def furniture_lines(text: str) -> list[Line]:
    """All lines of a text that aren't empty, with what tells furniture from body."""
    lines = text.split("\n")
    alone = [bool(l.strip()) and _ALONE.fullmatch(l) is not None for l in lines]
    filled = [k for k, l in enumerate(lines) if l.strip()]
    if not filled:
        return []
    widest = max(len(l) for l in lines)
    firsts = [""] * (len(lines) + 1)  # of the next line of text after each
    for k in range(len(lines) - 1, -1, -1):
        firsts[k] = firsts[k + 1] if alone[k] or not lines[k].strip() else lines[k].lstrip()[:1]
    out = []
    for k in filled:
        line = lines[k]
        rest = rest_of(line)
        number = rest != line.strip()
        words = len(rest.split())
        shape = _shape(rest) if rest else "none"
        inside = "inside" if rest and (_INSIDE.search(rest) or rest[-1] in ".,;:?") else "clean"
        size = "none" if not rest else "short" if len(rest) <= 30 else "middle" if len(rest) <= 60 else "long" if len(rest) <= 90 else "longest"
        many = "one" if words == 1 else "few" if words <= 7 else "many"
        place = "first" if k == filled[0] else "last" if k == filled[-1] else "inner"
        near = any(0 <= j < len(lines) and alone[j] for j in (k - 1, k + 1)) or (number and bool(rest))
        after = firsts[k + 1]
        begins = "none" if not after else "small" if after.islower() else "capital"
        stop = k > 0 and lines[k - 1].rstrip()[-1:] in ".!?"
        digits = "digits" if any(c.isdigit() for c in line) else "none"
        like = f"{shape}|{inside}|{many}|{size}"
        features = ["bias", f"shape={like}", f"number={number}", f"place={place}", f"near={near}", f"stop={stop}", f"shape={like}|place={place}", f"shape={like}|near={near}",
                    f"number={number}|place={place}|{digits}", f"short={len(line) < 0.75 * widest}", f"alone={alone[k]}|{digits}", f"words={min(words, 12)}", f"begins={begins}",
                    f"shape={like}|begins={begins}|short={len(rest) < 0.8 * widest}|near={near}", f"shape={like}|words={min(words, 12)}", f"inside={inside}", f"size={size}", f"many={many}",
                    f"shape={shape}|{inside}|{many}|near={near}|place={place}"]
        out.append(Line(k, number, rest, features))
    return out


def rest_of(line: str) -> str:
    """A line without the page number beside its text; nothing where it is a number alone."""
    if not line.strip() or _ALONE.fullmatch(line):
        return ""
    if "|" in line or "\t" in line or "   " in line:
        if m := _LEADING.fullmatch(line):
            return m[2].strip()
        if m := _TRAILING.fullmatch(line):
            return m[1].strip()
    return line.strip()


def count_features(line: Line, times: int) -> list[str]:
    n = "0" if not line.rest else str(min(times, 4))
    shape = line.features[1]
    return [*line.features, f"times={n}", f"times={n}|{shape}", f"times={n}|{line.features[4]}"]


def classify(p: Perceptron, line: Line, times: int) -> tuple[bool, bool]:
    """(holds a header, holds a page number)."""
    fs = count_features(line, times)
    number = line.number and p.score("number", fs) > p.score("body", fs)
    header = bool(line.rest) and p.score("header", fs) > p.score("text", fs)
    return header, number


#: How page numbers are printed.
_PRINTED = ["{n}", "- {n} -", "— {n} —", "[{n}]", "Page {n}", "Page {n} of {m}", "p. {n}", "Seite {n}", "{n}/{m}", "{r}"]


def _roman(n: int) -> str:
    out = ""
    for v, s in ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def _wrap(text: str, width: int) -> list[str]:
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def train_furniture(texts: list[str], seed: int = 6) -> Perceptron:
    """A classifier trained on pages made of clean texts, with headers and numbers put in by known rules."""
    rng = random.Random(seed)
    p = Perceptron()
    words = sorted({w.lower() for t in texts for w in _WORD.findall(t) if len(w) > 3}) or ["page"]
    cases: list[tuple[Line, int, bool, bool]] = []
    bodies = [t for t in texts if len(t) > 200]
    for start in range(0, len(bodies) - 4, 4):
        header = " ".join(w.capitalize() for w in rng.choices(words, k=rng.choice((2, 3, 3, 3, 4))))
        style = rng.random()
        if style < 0.3:
            header = header.upper()
        elif style < 0.6:
            header = " ".join([rng.choice(words).capitalize(), rng.choice(words), rng.choice(("of", "for", "under", "and", "in")), *rng.choices(words, k=2)])
        form, top, beside = rng.choice(_PRINTED), rng.random() < 0.5, rng.choice(("", "", "    ", " | "))
        has_header, has_number = rng.random() < 0.75, rng.random() < 0.8
        first = rng.randrange(1, 60)
        pages: list[tuple[str, set[str], set[str]]] = []
        for k, body in enumerate(bodies[start : start + rng.choice((1, 2, 4))]):
            lines = _wrap(body, rng.choice((rng.randrange(44, 70), rng.randrange(44, 70), rng.randrange(44, 70), rng.randrange(70, 130), 10_000)))
            if rng.random() < 0.4:  # rows begin and end within lines
                lines[0] = " ".join(lines[0].split()[-rng.randrange(1, 5) :])
            if rng.random() < 0.5:
                lines[-1] = " ".join(lines[-1].split()[: rng.randrange(1, 6)])
            n = form.format(n=first + k, m=first + 50, r=_roman(first + k))
            if rng.random() < 0.15:
                n = n.replace("1", "l").replace("0", "O")
            h = header
            if rng.random() < 0.25:
                h = " ".join(_damage(w, rng)[0] if rng.random() < 0.6 else w for w in header.split(" "))
            heads, numbers = set(), set()
            if has_header and has_number and beside:
                both = f"{h}{beside}{n}" if rng.random() < 0.5 else f"{n} | {h}"
                lines.insert(0, both)
                heads.add(both)
                numbers.add(both)
            else:
                if has_header and rng.random() < 0.9:
                    lines.insert(0, h)
                    heads.add(h)
                if has_number and rng.random() < 0.9:
                    lines.insert(int(bool(heads)) if top else len(lines), n)
                    numbers.add(n)
            pages.append(("\n".join(lines), heads, numbers))
        for k in range(len(pages) - 1):  # rows often run into the next page, and may end anywhere on it
            if rng.random() < 0.5:
                text, heads, numbers = pages[k]
                more = pages[k + 1][0].split("\n")[: rng.choice((1, 1, 2, 2, 4, 8))]
                pages[k] = ("\n".join([text, *more]), heads | pages[k + 1][1], numbers | pages[k + 1][2])
        for k in range(1, len(pages)):  # and may repeat the end of the one before
            if rng.random() < 0.4:
                text, heads, numbers = pages[k]
                before = [l for l in pages[k - 1][0].split("\n")[-rng.choice((1, 2, 3, 5)) :] if l not in pages[k - 1][1] | pages[k - 1][2]]
                pages[k] = ("\n".join([*before, text]), heads, numbers)
        times = Counter(fold(x.rest) for text, _, _ in pages for x in furniture_lines(text) if x.rest)
        for text, heads, numbers in pages:
            own = text.split("\n")
            for x in furniture_lines(text):
                cases.append((x, times[fold(x.rest)] if x.rest else 0, own[x.at] in heads, own[x.at] in numbers))
    for _ in range(EPOCHS):
        rng.shuffle(cases)
        for line, times, is_header, is_number in cases:
            p.step()
            fs = count_features(line, times)
            header, number = classify(p, line, times)
            if line.number and number != is_number:
                p.change("number", fs, 1.0 if is_number else -1.0)
                p.change("body", fs, -1.0 if is_number else 1.0)
            if line.rest and header != is_header:
                p.change("header", fs, 1.0 if is_header else -1.0)
                p.change("text", fs, -1.0 if is_header else 1.0)
    p.average()
    return p


# ---- rows ------------------------------------------------------------------------------------------------------------


@dataclass
class Repairer:
    editor: Editor
    furniture: Perceptron
    #: What lines of the same features were called.
    called: dict[tuple, tuple[bool, bool]] = field(default_factory=dict)

    def _classified(self, line: Line, times: int) -> tuple[bool, bool]:
        key = (times if times < 4 else 4, line.number, bool(line.rest), *line.features)
        if key not in self.called:
            if len(self.called) > COUNTED:
                self.called.clear()
            self.called[key] = classify(self.furniture, line, times)
        return self.called[key]

    def marks(self, text: str, times: dict[int, int]) -> dict[int, tuple[Line, bool, bool]]:
        """Lines that hold furniture; ``times`` says how often the line's header returns in the file."""
        out = {}
        for line in furniture_lines(text):
            header, number = self._classified(line, times.get(line.at, 1))
            if header or number:
                out[line.at] = (line, header, number)
        return out

    def repair(self, text: str, times: dict[int, int]) -> tuple[str, list[str]]:
        """The text in continuous paragraphs, and the kinds of damage found."""
        marks = self.marks(text, times)
        defects = set()
        body: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k in marks:
                found, header, number = marks[k]
                defects |= ({"header"} if header else set()) | ({"page_number"} if number else set())
                if found.rest and not header:
                    body.append(found.rest)
                continue
            body.append(line)
        paragraphs: list[str] = []
        open_ = ""
        after = False  # the line before ended in a divided word
        for k, line in enumerate(body):
            if not line.strip():
                # an empty line ends a paragraph, but not inside a divided word
                if open_ and not after:
                    paragraphs.append(open_)
                    open_ = ""
                continue
            line = line.strip(" \t")
            m = _DIVIDED.search(line)
            if after:
                open_ += line
            else:
                open_ = f"{open_} {line}" if open_ else line
            after = False
            if m:
                nxt = next((x.strip() for x in body[k + 1 :] if x.strip()), "")
                left = re.search(r"[^\s.,;:!?\"'()]*$", line[: m.start(2)])[0]
                right = re.match(r"[^\s.,;:!?\"')]*", nxt)[0]
                op = self.editor.join(left, m[2], right)
                if op != "apart":
                    defects.add("hyphenation")
                if right and op != "apart":
                    open_ = open_[: open_.rindex(m[2])] + ("-" if op == "hyphen" else "")
                    after = True
        if open_:
            paragraphs.append(open_)
        out = []
        for paragraph in paragraphs:
            fixed, at = [], 0
            for m in TOKEN.finditer(paragraph):
                whole = m[0]
                if whole.lower() in self.editor.vocabulary or sum(c.isdigit() for c in whole) > len(whole) // 2:
                    continue
                around = paragraph[m.start() - 1 : m.start()] + "|" + paragraph[m.end() : m.end() + 1]
                if re.search(r"[-/@_#\d]\||\|[@_/\d]|\|-\d", around + paragraph[m.end() + 1 : m.end() + 2]):
                    continue  # part of an identifier
                if (m.start() == 0 and paragraph is paragraphs[0] and whole[0].islower()) or (paragraph is paragraphs[-1] and m.end() >= len(paragraph.rstrip(DIVIDERS))):
                    continue  # a piece of a word that the row's edge cuts
                new = self.editor.correct(whole) if "-" not in whole else self.editor.correct_compound(whole)
                if new is not None:
                    fixed += [paragraph[at : m.start()], new]
                    at = m.end()
                    defects.add("misread")
            out.append("".join([*fixed, paragraph[at:]]))
        return "\n\n".join(out), sorted(defects)


class _Prose(dict):
    """The words and compounds that a string between blanks counts for; none for parts of code, keys and identifiers."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        bare = token.strip(_AROUND)
        out: tuple[str, ...] = ()
        if _PLAIN.fullmatch(bare):
            parts = _WORD.findall(bare)
            if all(p[1:] == p[1:].lower() or p.isupper() for p in parts):
                low = bare.lower()
                out = (*_WORD.findall(low), *re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)+", low))
        if len(self) >= COUNTED:
            self.clear()
        self[token] = out
        return out


def prose_words(text: str, known: _Prose) -> list[tuple[str, ...]]:
    """What the strings of a text count for, in lines of which more than half are words."""
    out = []
    for line in _POINTS.sub(" ", text).split("\n"):
        tokens = line.split()
        words = [w for t in tokens if (w := known[t])]
        if 2 * len(words) > len(tokens):
            out += words
    return out


def vocabulary(df: DataFrame, text_col: str = "text", least: int = LEAST_COUNT, share: float = LEAST_SHARE) -> dict[str, int]:
    """Counts of the words and hyphenated compounds of all prose: those with ``least`` or more and a ``share`` of all words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Prose()
        forms: Counter = Counter()

        def out() -> pa.RecordBatch:
            counts: Counter = Counter()
            for words, n in forms.items():
                for w in words:
                    counts[w] += n
                counts[""] += n  # how many there are in all
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in it:
            for t in batch.column(0).to_pylist():
                forms.update(prose_words(t, known))
            if len(forms) > COUNTED:
                yield out()
                forms.clear()
        yield out()

    words = spread(df.where(F.length(text_col) > 0).select(text_col), text_col).mapInArrow(run, "word string, n long")
    # longer strings are keys and codes
    words = stash(words.where(F.length("word") <= 40).groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("word") == "")))
    total = words.where("word = ''").agg(F.sum("n")).first()[0] or 0
    return {r[0]: r[1] for r in words.where((F.col("n") >= max(least, share * total)) & (F.col("word") != "")).collect()}


def compounds(scans: DataFrame, text_col: str = "text", least: int = LEAST_COUNT, share: float = LEAST_SHARE) -> dict[str, int]:
    """Hyphenated compounds inside the lines of scanned texts, and their parts.

    One that a misreading may have made of another, at least ten times as frequent, is left out.
    """
    found = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}+(?:-\p{L}+)+)(?!\s*[\n\p{L}])"), 1)).alias("word")
    counts = stash(scans.where(F.length(text_col) > 0).select(found).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sound_compounds({r[0]: r[1] for r in counts.where((F.col("n") >= max(least, share * total)) & (F.length("word") <= 40)).collect()})


def sound_compounds(n: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    known = Vocabulary(n)
    for word, times in n.items():
        if any(n[other] >= 10 * times for other, _ in candidates(word, known)):
            continue
        for w in (word, *word.split("-")):
            out[w] = out.get(w, 0) + times
    return out


def training_texts(df: DataFrame, id_col: str = "row_id", text_col: str = "text", bound: int = TRAINING_ROWS) -> list[str]:
    """A bounded sample of clean prose, the rows with the smallest hashes of their ids."""
    prose = df.where((F.length(text_col) > 200) & (F.length(text_col) < 4000) & ~F.col(text_col).rlike(r"[{}<>;=|\t]"))
    ids = prose.orderBy(F.xxhash64(id_col), id_col).limit(bound).select(id_col)  # only ids meet on the driver's way
    rows = prose.select(id_col, text_col).join(F.broadcast(ids), id_col, "left_semi")
    return [r[0] for r in rows.orderBy(F.xxhash64(id_col), id_col).select(text_col).collect()]


def trained(clean: DataFrame, scans: DataFrame) -> Repairer:
    """The models; the words of clean texts and the compounds of all texts are known."""
    texts, known = training_texts(clean), vocabulary(clean)
    for word, n in compounds(scans).items():
        known.setdefault(word, n)
    return Repairer(train_editor(known, texts), train_furniture(texts))


def repaired(df: DataFrame, id_col: str = "row_id", path_col: str = "relative_path", text_col: str = "text", page_col: str = "page_start", index_col: str = "chunk_index") -> DataFrame:
    """(row_id, text, defects) of all rows with a page; the rows without one train the models.

    A header returns in its file when it stands in more than one place, a place being a chunk index and a line, so that
    rows delivered again don't count.
    """
    base = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"), F.col(page_col).alias("page"), F.col(index_col).cast("int").alias("index"))
    model = df.sparkSession.sparkContext.broadcast(trained(base.where("page is null"), base.where("page is not null")))
    scans = spread(base.where("page is not null").select("row_id", "path", "index", "text"), "row_id")

    def lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[], [], [], []]
            for i, path, index, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at, line in enumerate((text or "").split("\n")):
                    if len(key := fold(rest_of(line))) > 3:
                        for column, value in zip(out, (i, index, at, xxhash.xxh64_intdigest(f"{path}\0{key}") - (1 << 63))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["row_id", "index", "at", "key"])

    # a line of a file is a hash of 64 bits; the few of them that return are what goes back to the rows
    found = stash(scans.mapInArrow(lines, "row_id long, index int, at int, key long"))
    places = found.select("key", "index", "at").distinct().groupBy("key").agg(F.count("*").alias("times"))
    times = stash(places.where("times > 1"))
    per_row = found.join(small(times), "key").groupBy("row_id").agg(F.collect_list(F.struct("at", F.least("times", F.lit(9)).alias("times"))).alias("lines"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer: Repairer = model.value
        for batch in it:
            texts, defects = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                new, kinds = (text, []) if not text else repairer.repair(text, {x["at"]: x["times"] for x in own or ()})
                texts.append(new)
                defects.append(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(defects, pa.list_(pa.string()))], ["row_id", "text", "defects"])

    joined = scans.select("row_id", "text").join(per_row, "row_id", "left").select("row_id", "text", "lines")
    return joined.mapInArrow(run, "row_id long, text string, defects array<string>")


def found(rows: DataFrame) -> DataFrame:
    """(row_id, defect) from repaired rows."""
    return rows.select("row_id", F.explode("defects").alias("defect"))
