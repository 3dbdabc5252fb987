"""Languages of documents and of the segments of mixed ones, by character language models.

One interpolated Kneser-Ney model per language is trained on the words of a table of labelled samples, each with the
spaces around it. The n-grams of all models lie in one sorted array of hashes for each order, with a row of log
probabilities and of back-off weights, a column for each language. As no n-gram reaches into the word before, a worker
scores each distinct word once. Sentences and inserted quotations get the language of the lowest cross-entropy per character along a path that
pays for each change; what no model explains as well as it explains held-out text of its language is rejected.

Null and empty texts, and texts without a sentence of at least three words (or four Han characters), have no language.
Without samples no text has one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.session import spread

ORDER = 5
#: Distinct words whose scores a worker keeps.
CACHE = 400_000
#: Characters an unseen one is drawn from.
ALPHABET = 30_000
#: Characters of running text from which a language counts in a document.
LEAST_CHARS = 150
#: Labelled samples the models are trained on at most, those with the smallest ids.
MAX_SAMPLES = 20_000
#: Price in nats of a change of language between neighbouring units.
CHANGE = 14.0
#: Folds for the held-out text that calibrates rejection and confidence.
FOLDS = 4

#: Three-letter codes and English names of languages with a two-letter code.
LANGUAGE_NAMES = {
    "eng": "en", "english": "en", "fra": "fr", "fre": "fr", "french": "fr", "deu": "de", "ger": "de", "german": "de",
    "spa": "es", "spanish": "es", "castilian": "es", "por": "pt", "portuguese": "pt", "ita": "it", "italian": "it",
    "nld": "nl", "dut": "nl", "dutch": "nl", "flemish": "nl", "zho": "zh", "chi": "zh", "chinese": "zh", "mandarin": "zh", "cmn": "zh",
}
#: Labels that name no language.
NO_LANGUAGE = ("und", "unknown", "unk", "n/a", "na", "none", "null", "mul", "mis", "zxx", "xx", "??", "?", "-", "other", "auto", "tbd")

_U = np.uint64
_ODD = (np.random.default_rng(808).integers(1, 2**63, 64, dtype=np.uint64) << _U(1)) | _U(1)


def label_code(label: Column) -> Column:
    """The two-letter code a label means; null if it names no language; an unknown name stays as it is."""
    low = F.lower(F.trim(label))
    first = F.regexp_extract(low, r"^([a-z]+)(?:[-_].*)?$", 1)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.when(label.isNull() | (low == "") | low.isin(*NO_LANGUAGE), None).otherwise(
        F.coalesce(F.try_element_at(names, first), F.when(first != "", first).otherwise(low))
    )


# ---- models ----------------------------------------------------------------------------------------------------------


def _gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each position, for n = 1..order; the first n - 1 are meaningless."""
    from lodespark.llm.setsketch import mix

    c = codes.astype(np.uint64) + _U(1)
    out = [mix(c * _ODD[0])]
    for n in range(2, order + 1):
        moved = np.zeros_like(c)
        moved[n - 1 :] = c[: max(0, len(c) - n + 1)]
        out.append(mix(out[-1] + moved * _ODD[n]))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_REFERENCE = re.compile(r"[A-Za-z]*-?\d[\w./:-]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def words_of(text: str) -> list[str]:
    """The words the models see: lower case, without numbers and references."""
    text = text.lower()
    return _WORD.findall(_REFERENCE.sub(" ", text) if _DIGIT.search(text) else text)


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@dataclass
class Models:
    """Merged models: per order the sorted hashes, log probabilities (n, languages) and log back-off weights."""

    languages: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    #: Highest cross-entropy in nats per character that still counts as the language.
    worst: np.ndarray | None = None
    temperature: float = 1.0

    def characters(self, words: list[str]) -> np.ndarray:
        """Log probability of each character of the words and the spaces around them, (characters, languages)."""
        codes = _codes(" " + " ".join(words) + " ")
        n, wide = len(codes), len(self.languages)
        space = codes == 32
        before = np.maximum.accumulate(np.where(space, np.arange(n), 0))
        reach = np.arange(n) - np.r_[0, before[:-1]]  # to the space in front of the word
        at = []
        for k, grams in enumerate(_gram_hashes(codes, ORDER)):
            table = self.hashes[k]
            pos = np.minimum(np.searchsorted(table, grams), len(table) - 1)
            at.append(np.where((table[pos] == grams) & (k <= reach), pos, -1))
        out = np.full((n, wide), -np.log(ALPHABET), np.float32)
        longest = np.zeros(n, np.int8)
        for k, pos in enumerate(at):
            hit = pos >= 0
            out[hit] = self.logp[k][pos[hit]]
            longest[hit] = k + 1
        out[longest == 0] += self.floor
        for k in range(1, ORDER):  # back-off of contexts of k characters where only shorter n-grams are known
            context = np.full(n, -1)
            context[1:] = at[k - 1][:-1]
            need = (longest <= k) & (context >= 0) & (k <= reach)
            out[need] += self.backoff[k - 1][context[need]]
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word and the space after it under each language, (words, languages)."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        sizes = np.array([len(w) + 1 for w in words])
        return np.add.reduceat(self.characters(words), np.cumsum(sizes) - sizes + 1, axis=0)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for the words; words not met before are scored together."""
        index = self.index
        fresh = list({w for w in words if w not in index})
        if fresh:
            if len(index) + len(fresh) > CACHE:
                index.clear()
                self.table = np.zeros((0, len(self.languages)), np.float32)
                fresh = list(set(words))
            first = len(index)
            self.table = np.concatenate([self.table, *(self.scores(fresh[a : a + 50_000]) for a in range(0, len(fresh), 50_000))])
            index.update(zip(fresh, range(first, first + len(fresh))))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def __post_init__(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)), np.float32)

    floor: np.ndarray | float = 0.0


def _counts(words: Counter) -> list[Counter]:
    """Raw counts of the highest order and of what begins a word, continuation counts of the other n-grams."""
    out = []
    for n in range(1, ORDER + 1):
        raw: Counter = Counter()
        left: dict[str, set] = defaultdict(set)
        for word, times in words.items():
            t = f" {word} "
            for i in range(len(t) - n + 1):
                if n == 1 and i == 0:
                    continue  # the space in front is given
                if n == ORDER or i == 0:
                    raw[t[i : i + n]] += times
                else:
                    left[t[i : i + n]].add(t[i - 1])
        out.append(raw + Counter({g: len(s) for g, s in left.items()}))
    return out


def train(samples: list[tuple[str, str]], calibrate: bool = True) -> Models:
    """Models of all languages of the (code, text) samples; each is read as it is and without accents."""
    samples = [(c, t) for c, t in samples if c and t and words_of(t)]
    languages = sorted({c for c, _ in samples})
    if not languages:
        return Models([])
    counts = {c: _counts(Counter(w for k, t in samples if k == c for v in (t, without_accents(t)) for w in words_of(v))) for c in languages}
    models = Models(languages)
    known: dict[str, np.ndarray] = {}
    floor = np.zeros(len(languages))
    for n in range(1, ORDER + 1):
        context_total = [Counter() for _ in languages]
        context_types = [Counter() for _ in languages]
        discounts = []
        for j, c in enumerate(languages):
            table = counts[c][n - 1]
            once, twice = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
            discounts.append(once / (once + 2 * twice) if once and twice else 0.5)
            for g, v in table.items():
                context_total[j][g[:-1]] += v
                context_types[j][g[:-1]] += 1
        gammas: dict[str, np.ndarray] = {}

        def gamma(h: str) -> np.ndarray:
            if h not in gammas:
                gammas[h] = np.array([discounts[j] * context_types[j][h] / context_total[j][h] if context_total[j][h] else 1.0 for j in range(len(languages))])
            return gammas[h]

        grams = sorted({g for c in languages for g in counts[c][n - 1]})
        lower = known
        known = {}
        for g in grams:
            h = g[:-1]
            below = lower[g[1:]] if n > 1 else np.full(len(languages), 1.0 / ALPHABET)
            own = np.array([max(counts[c][n - 1][g] - discounts[j], 0) / context_total[j][h] if context_total[j][h] else 0.0 for j, c in enumerate(languages)])
            known[g] = own + gamma(h) * below
        if n == 1:
            floor = np.log(gamma(""))
        else:
            models.backoff.append(_rows_for(previous, {h: np.log(gamma(h)) for h in previous}, len(languages)))
        previous = grams
        keys = np.array([_gram_hashes(_codes(g), n)[n - 1][-1] for g in grams], np.uint64)
        order = np.argsort(keys)
        models.hashes.append(keys[order])
        models.logp.append(np.log(np.array([known[g] for g in grams])[order]).astype(np.float32))
    models.backoff.append(np.zeros((0, len(languages)), np.float32))
    models.floor = floor.astype(np.float32)
    if calibrate:
        _calibrate(models, samples)
    return models


#: Models of the last samples, by their fingerprint: training takes seconds, and the samples are a fixed table.
_trained: dict[str, Models] = {}


def trained(samples: list[tuple[str, str]]) -> Models:
    """``train``, once for the same samples."""
    key = hashlib.sha256(repr(sorted(samples, key=repr)).encode()).hexdigest()
    if key not in _trained:
        _trained.clear()
        _trained[key] = train(samples)
    return _trained[key]


def _rows_for(grams: list[str], values: dict[str, np.ndarray], wide: int) -> np.ndarray:
    n = len(grams[0])
    keys = np.array([_gram_hashes(_codes(g), n)[n - 1][-1] for g in grams], np.uint64)
    return np.array([values[grams[i]] for i in np.argsort(keys)], np.float32).reshape(-1, wide)


def _calibrate(models: Models, samples: list[tuple[str, str]]) -> None:
    """Rejection level and temperature from models trained without the fold they are tried on."""
    entropy: dict[str, list[float]] = defaultdict(list)
    cuts: list[tuple[int, np.ndarray]] = []
    for fold in range(FOLDS):
        own = train([s for k, s in enumerate(samples) if k % FOLDS != fold], calibrate=False)
        for c, t in (s for k, s in enumerate(samples) if k % FOLDS == fold):
            if c not in own.languages:
                continue
            j, words = own.languages.index(c), words_of(t)
            s = own.scores(words).astype(float)
            for a in range(0, len(words), 6):
                part, size = s[a : a + 6].sum(0), sum(len(w) + 1 for w in words[a : a + 6])
                entropy[c].append(float(-part[j] / size))
                cuts.append((j, s[a : a + 2].sum(0)))
    models.worst = np.array([np.mean(entropy[c]) + 4 * np.std(entropy[c]) if len(entropy[c]) > 1 else np.inf for c in models.languages])
    best, at = -np.inf, 1.0
    for temperature in np.linspace(0.5, 6, 23):
        like = sum(s[j] / temperature - np.logaddexp.reduce(s / temperature) for j, s in cuts)
        if like > best:
            best, at = like, float(temperature)
    models.temperature = at


# ---- documents -------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^(?:```|~~~)[^\n]*\n[\s\S]*?(?:^(?:```|~~~)[^\n]*$|\Z)", re.M)
_MARK = re.compile("[.!?。！？\\n«»„“”\"(（)）]")
_CLOSERS = "\"”»’)]"
_INSERT = re.compile(r"\s*(?:(?:[^\W\d_]+[\s,，'’]+){2}|[一-鿿]{4})")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
_CODE = re.compile(r"\w\(.*\)\s*[;{]?$|^\s*(?:def|class|import|return|if|for|while|function|const|let|var|SELECT)\b.*[({;:]\s*$|^\s*[\w.]+\s*[:=]\s*\S+$")
#: Signs that prose has a few of and code many, and the letters that prose has for each at least.
_SIGN, LETTERS_A_SIGN = re.compile(r"[{};=<>|\t]|\w+_\w+"), 30
_CODE_SIGN = re.compile(r"[{};=<>|\t_:]|\)\s*$")
_DIGIT = re.compile(r"\d")


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of sentences and inserted quotations that are prose."""
    out: list[tuple[int, int, list[str]]] = []

    def add(s: int, e: int) -> None:
        piece = text[s:e]
        bare = piece.lstrip(" \t\r\n-*•#>")
        s, bare = s + len(piece) - len(bare), bare.rstrip()
        if not bare:
            return
        words = words_of(bare)
        if len(words) < 8 and sum(len(w) > 1 for w in words) < 3 and len(_HAN.findall(bare)) < 4:
            return
        if _CODE_SIGN.search(bare) and (_CODE.search(bare) or len(_SIGN.findall(bare)) * LETTERS_A_SIGN > sum(map(str.isalpha, bare))):
            return
        out.append((s, s + len(bare), words))

    def region(a: int, b: int) -> None:
        at = a
        for m in _MARK.finditer(text, a, b):
            k = m.start()
            if k < at:
                continue
            c, stop = text[k], k + 1
            if c in ".!?":
                while stop < b and text[stop] in _CLOSERS:
                    stop += 1
                if stop < b and not text[stop].isspace():
                    continue
                add(at, stop)
            elif c in "。！？":
                add(at, stop)
            elif c in "(（" and not _INSERT.match(text, stop):
                continue
            elif c in ")）" and text[k - 1] not in ".。":
                continue
            else:
                add(at, k)
            at = stop
        add(at, b)

    at = 0
    if "```" in text or "~~~" in text:
        for m in _FENCE.finditer(text):
            region(at, m.start())
            at = m.end()
    region(at, len(text))
    return out


def _path(scores: np.ndarray) -> np.ndarray:
    """The best language of each unit when every change costs ``CHANGE``."""
    first = scores.argmax(1)
    if (first == first[0]).all():
        return first
    n, wide = scores.shape
    total, back = scores[0].copy(), np.zeros((n, wide), np.int16)
    for k in range(1, n):
        top = int(total.argmax())
        stay = total >= total[top] - CHANGE
        back[k] = np.where(stay, np.arange(wide), top)
        total = np.where(stay, total, total[top] - CHANGE) + scores[k]
    out = np.empty(n, int)
    out[-1] = int(total.argmax())
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k][out[k]]
    return out


def segments(texts: list[str], models: Models) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its (start, end, language, confidence, characters of running text), neighbours of a language joined."""
    if not models.languages:
        return [[] for _ in texts]
    spans = [units(t or "") for t in texts]
    words = [w for own in spans for *_, ws in own for w in ws]
    sizes = [len(ws) for own in spans for *_, ws in own]
    chars = np.array([sum(map(len, ws)) + len(ws) for own in spans for *_, ws in own])
    scores = np.zeros((0, len(models.languages)))
    if words:
        rows = models.rows(words)
        scores = np.add.reduceat(models.table[rows].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
    out, at = [], 0
    for own in spans:
        mine, long = scores[at : at + len(own)], chars[at : at + len(own)]
        at += len(own)
        rows: list[list] = []
        if len(own):
            best = _path(mine)
            for (s, e, _), j, score, size in zip(own, best, mine, long):
                if models.worst is not None and -score[j] > models.worst[j] * max(size, 1):
                    continue
                if rows and rows[-1][2] == j:
                    rows[-1][1] = e
                    rows[-1][3] += score
                    rows[-1][4] += e - s
                else:
                    rows.append([s, e, j, score.copy(), e - s])
        done = []
        for s, e, j, score, size in rows:
            scaled = score / models.temperature
            done.append((s, e, models.languages[j], float(np.exp(scaled[j] - np.logaddexp.reduce(scaled))), size))
        out.append(done)
    return out


def languages_of(found: list[tuple[int, int, str, float, int]], least: int = LEAST_CHARS) -> list[str]:
    """Languages with enough running text, or the one with the most of a shorter text."""
    size: Counter = Counter()
    for *_, code, _, n in found:
        size[code] += n
    if not size:
        return []
    return sorted(c for c, n in size.items() if n >= least) or [min(size, key=lambda c: (-size[c], c))]


def sample_rows(samples: DataFrame, bound: int = MAX_SAMPLES) -> list[tuple[str, str]]:
    """The (code, text) rows with the ``bound`` smallest sample ids."""
    rows = samples.where("lang_code is not null and sample_text is not null").orderBy("sample_id").limit(bound)
    return [(r[0], r[1]) for r in rows.select("lang_code", "sample_text").collect()]


def segmented(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment_index, char_start, char_end, lang_code, confidence, chars) of every segment of every document."""
    models = df.sparkSession.sparkContext.broadcast(trained(sample_rows(samples)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "segment_index", "char_start", "char_end", "lang_code", "confidence", "chars"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
        for batch in it:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(ids), 200):
                out: list[list] = [[] for _ in names]
                for i, found in zip(ids[a : a + 200], segments(texts[a : a + 200], models.value)):
                    for k, (s, e, code, sure, size) in enumerate(found):
                        for column, value in zip(out, (i, k, s, e, code, sure, size)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    rows = spread(df.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    schema = "doc_id long, segment_index int, char_start long, char_end long, lang_code string, confidence double, chars long"
    return rows.mapInArrow(run, schema)


def document_languages(found: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, lang_code, chars, confidence, mixed) from segments: one row per language of the document."""
    by = found.groupBy("doc_id", "lang_code").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
    by = by.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("chars")).alias("minus"), "lang_code", "confidence"))).alias("all"))
    enough = F.filter("all", lambda x: x["minus"] <= -least)
    own = by.select("doc_id", F.when(F.size(enough) > 0, enough).otherwise(F.slice("all", 1, 1)).alias("own"))
    return own.select("doc_id", F.explode("own").alias("x"), (F.size("own") > 1).alias("mixed")).select(
        "doc_id", "x.lang_code", (-F.col("x.minus")).alias("chars"), "x.confidence", "mixed"
    )


def mislabelled(df: DataFrame, found: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_code): the languages of documents that are mixed or whose label is missing or wrong."""
    labels = df.select(F.col(id_col).cast("long").alias("doc_id"), label_code(F.col(lang_col)).alias("label"))
    own = document_languages(found).join(labels, "doc_id")
    return own.where(F.col("mixed") | ~F.col("label").eqNullSafe(F.col("lang_code"))).select("doc_id", "lang_code")
