"""Full-text operators: the inverted index, BM25, phrases, fuzzy and identifier matches.

The index is a table of one row for each text, (key, len, tokens, tfs): it is made in one narrow pass, holds all that
BM25 needs, and lies beside the texts, so that a hot token is spread like the rows that hold it. Queries are a stated set
and meet the rows in blocks; each task keeps the best of each query, so what is shuffled grows with the queries only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.functions.text import compound_words, identifiers_related, tokenize, tokens
from lodespark.session import BROADCAST_KEYS, semi_by_key, spread, stash

K1, B = 1.2, 0.75
#: Queries that one pass over the index answers; their terms are what a worker holds.
BLOCK_QUERIES = 4_000
#: Scores held at once: queries times texts.
MATRIX = 4_000_000
#: Rows held for the best of a block's queries before they are cut to the best.
HELD = 2_000_000
#: Distinct tokens of queries that are sent to the workers, so that the index of one search holds no others.
SENT_TOKENS = 500_000
INDEX = ("len", "tokens", "tfs")
#: Characters of a part of an identifier from which on another may be one edit apart.
FUZZY_LENGTH = 7
#: Words as numbers: those of ``left_out_keys`` fit a long.
KEY_PRIME, KEY_BASE = 2**61 - 1, 1_000_003


def small(df: DataFrame, bound: int = BROADCAST_KEYS // 4) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``bound`` rows, else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def index(df: DataFrame, key: str, text: str, only: list[str] | None = None) -> DataFrame:
    """(key, len, tokens, tfs) of every row: how many tokens its text has, the distinct ones and how often each stands there.

    With ``only`` just these tokens are kept, while ``len`` counts all. Null and empty texts have none.
    """
    kept = None if only is None else frozenset(only)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lens, offsets, tokens, tfs = [], [0], [], []
            for t in batch.column(1).to_pylist():
                every = tokenize(t) if t else []
                counts = Counter(every if kept is None else [w for w in every if w in kept])
                lens.append(len(every))
                tokens += counts
                tfs += counts.values()
                offsets.append(len(tokens))
            at = pa.array(offsets, pa.int32())
            arrays = [batch.column(0), pa.array(lens, pa.int32()), pa.ListArray.from_arrays(at, pa.array(tokens, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, *INDEX])

    rows = spread(df.select(F.col(key), F.col(text).alias("_text")), key)
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, len int, tokens array<string>, tfs array<int>")


@F.pandas_udf(T.StructType([T.StructField("len", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]))
def index_columns(text: pd.Series) -> pd.DataFrame:
    """The columns of ``index`` of a text, for tables that keep them beside it."""
    every = [tokenize(t) if t else [] for t in text]
    counts = [Counter(e) for e in every]
    return pd.DataFrame({"len": [len(e) for e in every], "tokens": [list(c) for c in counts], "tfs": [list(c.values()) for c in counts]})


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, len): each token of each text, how often it stands there and how many tokens the text has."""
    each = index(df, key, text).select(key, "len", F.explode(F.arrays_zip("tokens", "tfs")).alias("x"))
    return each.select(key, F.col("x.tokens").alias("token"), F.col("x.tfs").cast("long").alias("tf"), "len")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def _counting(wanted: set[str] | None):
    """(token, n): in how many rows each wanted token stands; under the null token all rows, under the empty one all their tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in it:
            tokens = batch.column(1).flatten().to_pylist()
            counts.update(tokens if wanted is None else [t for t in tokens if t in wanted])
            counts[None] += len(batch)
            counts[""] += sum(batch.column(0).to_pylist())
            if len(counts) > SENT_TOKENS:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    return run


Terms = list[tuple[int, str, float]]


def sent(asked: DataFrame) -> Terms | DataFrame:
    """(q, token, boost) of the terms of queries: on the driver where they are few enough to send, else as a table."""
    boost = F.col("boost") if "boost" in asked.columns else F.lit(1.0)
    asked = asked.select("q", "token", boost.cast("double").alias("boost"))
    terms = asked.limit(SENT_TOKENS + 1).collect()
    return [tuple(r) for r in terms] if len(terms) <= SENT_TOKENS else stash(asked)


def scored(indexed: DataFrame, key: str, asked: DataFrame | Terms, k: int | None, digits: int = 9) -> DataFrame:
    """(q, key, score[, rank]) by BM25 of the rows of an index; with ``k`` the best of each query, ties by key, else all above 0.

    ``asked`` is (q, token) with an optional ``boost``, or what ``sent`` made of it, ``key`` a whole number. N and the mean
    length are those of all rows, null and empty texts included; a mean length of 0 counts as 1. Scores are rounded to
    ``digits`` before they are ranked.
    """
    asked = sent(asked) if isinstance(asked, DataFrame) else asked
    few = isinstance(asked, list)
    counts = indexed.select("len", "tokens").mapInArrow(_counting({t for _, t, _ in asked} if few else None), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = counts if few else stash(counts)
    known = {r[0]: r[1] for r in (counts if few else counts.where("token is null or token = ''")).collect()}
    docs, mean = known.get(None, 0), (known.get("", 0) / known[None] if known.get(None) else 0.0) or 1.0
    rows = indexed.select(F.col(key).cast("long").alias("key"), *INDEX)
    parts = []
    for own in _blocks(asked, counts, known):
        terms = [(q, t, w * float(np.log(1 + (docs - n + 0.5) / (n + 0.5)))) for q, t, w, n in own if n]
        if terms:
            parts.append(rows.mapInArrow(_scoring(terms, mean, k, digits), "q long, key long, score double"))
    if not parts:
        return indexed.sparkSession.createDataFrame([], "q long, key long, score double" + (", rank int" if k else ""))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return top(every, "q", [F.desc("score"), F.col("key")], k) if k else every


def _blocks(asked: DataFrame | Terms, counts: DataFrame, known: dict[str | None, int]) -> Iterator[list[tuple[int, str, float, int]]]:
    """(q, token, boost, rows with the token) of the queries of one block after the other; only a block is on the driver."""
    if isinstance(asked, list):
        queries = sorted({q for q, _, _ in asked})
        block = {q: n // BLOCK_QUERIES for n, q in enumerate(queries)}
        out: list[list] = [[] for _ in range(0, len(queries), BLOCK_QUERIES)]
        for q, t, w in asked:
            out[block[q]].append((q, t, w, known.get(t, 0)))
        yield from out
        return
    blocks = -(-asked.select("q").distinct().count() // BLOCK_QUERIES)
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n)
        yield [tuple(r) for r in own.join(counts, "token").select("q", "token", "boost", "n").collect()]


def _scoring(own: list[tuple[int, str, float]], mean: float, k: int | None, digits: int):
    ids = np.array(sorted({q for q, _, _ in own}), np.int64)
    place = {q: j for j, q in enumerate(ids.tolist())}
    names = sorted({t for _, t, _ in own})
    number = {t: n for n, t in enumerate(names)}
    by_token: list[tuple[list[int], list[float]]] = [([], []) for _ in names]
    for q, t, w in own:
        by_token[number[t]][0].append(place[q])
        by_token[number[t]][1].append(w)
    asked = [(np.array(js), np.array(ws)) for js, ws in by_token]

    def scores(lens: np.ndarray, counts: np.ndarray, tokens: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """(queries, texts) of the texts with so many postings each."""
        text = np.repeat(np.arange(len(lens)), counts)
        norm = K1 * (1 - B + B * lens / mean)
        part = tfs * (K1 + 1) / (tfs + norm[text])
        order = np.argsort(tokens, kind="stable")
        order = order[np.searchsorted(tokens[order], 0) :]  # tokens that no query has are -1
        edges = np.flatnonzero(np.diff(tokens[order], prepend=-1, append=-1))
        out = np.zeros((len(ids), len(lens)))
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            js, ws = asked[tokens[at[0]]]
            out[np.ix_(js, text[at])] += ws[:, None] * part[at]
        return np.round(out, digits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(ids), 10.0**-digits / 2)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            j, keys, score = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((keys, -score, j))
            j, keys, score = j[order], keys[order], score[order]
            nth = np.arange(len(j)) - np.searchsorted(j, j)
            last = nth == k - 1
            floor[j[last]] = score[last]
            keep = nth < k
            return j[keep], keys[keep], score[keep]

        step = max(1, MATRIX // len(ids))
        for batch in it:
            keys, lens = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
            offsets = batch.column(2).offsets.to_numpy()
            tokens = np.array([number.get(t, -1) for t in batch.column(2).flatten().to_pylist()], np.int64)
            tfs, first = batch.column(3).flatten().to_numpy().astype(float), offsets[0]
            for a in range(0, len(keys), step):
                b = min(a + step, len(keys))
                s, e = offsets[a] - first, offsets[b] - first
                got = scores(lens[a:b], np.diff(offsets[a : b + 1]), tokens[s:e], tfs[s:e])
                j, at = np.nonzero(got >= floor[:, None])
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(keys[a:b][at]), pa.array(got[j, at])], ["q", "key", "score"])
                    continue
                held.append((j, keys[a:b][at], got[j, at]))
                rows += len(j)
                if rows > HELD + k * len(ids):
                    held[:] = [best()]
                    rows = len(held[0][0])
        if held:
            j, keys, score = best()
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(keys), pa.array(score)], ["q", "key", "score"])

    return run


def _index_for(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, terms: str) -> tuple[DataFrame, DataFrame | Terms]:
    """The index of one search as a table, of the asked tokens where they are few enough to send, else of all; and the terms."""
    asked = sent(queries.select(F.col(query_key).cast("long").alias("q"), F.explode(F.array_distinct(terms)).alias("token")))
    return stash(index(df, key, text, sorted({t for _, t, _ in asked}) if isinstance(asked, list) else None)), asked


def bm25(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, terms: str) -> DataFrame:
    """(query_key, key, score) of every row with a term of a query; ``terms`` are tokens of the query."""
    indexed, asked = _index_for(df, key, text, queries, query_key, terms)
    return scored(indexed, key, asked, None).select(F.col("q").alias(query_key), F.col("key").alias(key), "score")


def bm25_top(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, terms: str, k: int) -> DataFrame:
    """(query_key, key, score, rank): the ``k`` best rows of each query by BM25, ties by key."""
    indexed, asked = _index_for(df, key, text, queries, query_key, terms)
    return scored(indexed, key, asked, k).select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")


def top(scored: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``by`` with their rank from 1; partial top-k runs before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def phrases(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, words: str) -> DataFrame:
    """(query_key, key): the rows that hold all tokens of a query one after the other.

    The phrases meet the rows in blocks; a row's tokens are looked up by the first token of a phrase. A phrase without
    tokens is in no row.
    """
    asked = queries.where(F.size(words) > 0).select(F.col(query_key).cast("long").alias("q"), F.col(words).alias("words"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    rows = spread(df.where(F.length(text) > 0).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key")
    every = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        if own:
            part = rows.mapInArrow(_phrases([(r[0], tuple(r[1])) for r in own]), "q long, key long")
            every = part if every is None else every.unionByName(part)
    if every is None:
        every = df.sparkSession.createDataFrame([], "q long, key long")
    return every.select(F.col("q").alias(query_key), F.col("key").alias(key))


def _phrases(own: list[tuple[int, tuple[str, ...]]]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_first: dict[str, dict[tuple[str, ...], list[int]]] = {}
        for q, words in own:
            by_first.setdefault(words[0], {}).setdefault(words, []).append(q)
        for batch in it:
            qs, keys = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, found = tokenize(t), set()
                for k, token in enumerate(tokens):
                    for words in by_first.get(token, ()):
                        if words not in found and tuple(tokens[k : k + len(words)]) == words:
                            found.add(words)
                mine = [q for words in found for q in by_first[words[0]][words]]
                qs += mine
                keys += [key] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(keys, pa.int64())], ["q", "key"])

    return run


def phrase(text: Column, words: Column) -> Column:
    """Whether the tokens of ``text`` hold those of ``words`` one after the other."""
    joined = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(words) > 0) & F.contains(joined(tokens(text)), joined(words))


def fuzzy_tokens(vocabulary: DataFrame, terms: DataFrame, token: str = "token", term: str = "term") -> DataFrame:
    """(term, token): tokens one edit away from a term of seven or more characters with the first three the same, both ASCII."""
    long = small(terms.where(F.length(term) >= 7).where(F.col(term).rlike(r"^[a-z0-9_.-]+$")).select(term).distinct())
    pairs = vocabulary.where(F.col(token).rlike(r"^[a-z0-9_.-]+$")).select(token).distinct().join(long, F.substring(token, 1, 3) == F.substring(term, 1, 3))
    return pairs.where((F.abs(F.length(token) - F.length(term)) <= 1) & (F.levenshtein(token, term) <= 1)).select(term, token)


def related_tokens(vocabulary: DataFrame, terms: DataFrame, token: str = "token", term: str = "term") -> DataFrame:
    """(term, token) that are related: equal, the first four characters the same, or alike by trigrams, long and of like length.

    The terms are a stated set and meet the vocabulary in blocks; a word is looked up by its start and its trigrams, so
    no start or trigram that many words share becomes a key of a shuffle.
    """
    asked = terms.select(F.col(term).alias("term")).where("term is not null").distinct()
    blocks = max(1, -(-asked.count() // SENT_TOKENS))
    words = vocabulary.select(F.col(token).alias("token")).distinct()
    every = None
    for block in range(blocks):
        own = [r[0] for r in asked.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()]
        part = words.mapInArrow(_related(own), "term string, token string")
        every = part if every is None else every.unionByName(part)
    return every.select(F.col("term").alias(term), F.col("token").alias(token))


def grams(word: str) -> set[str]:
    return {word[k : k + 3] for k in range(len(word) - 2)}


def _related(own: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_start: dict[str, list[str]] = {}
        by_gram: dict[str, list[str]] = {}
        for t in own:
            by_start.setdefault(t[:4], []).append(t)
            for g in grams(t) if len(t) >= 7 else ():
                by_gram.setdefault(g, []).append(t)
        for batch in it:
            out: list[tuple[str, str]] = []
            for w in batch.column(0).to_pylist():
                found = {t for t in by_start.get(w[:4], ()) if t == w or (len(t) >= 4 and len(w) >= 4)}
                if len(w) >= 7:
                    mine = grams(w)
                    shared = Counter(t for g in mine for t in by_gram.get(g, ()))
                    found.update(t for t, n in shared.items() if abs(len(t) - len(w)) <= 1 and 4 * n >= len(mine) + len(grams(t)))
                out += [(t, w) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], ["term", "token"])

    return run


def identifier_rows(df: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """(q, identifier, key): the rows that name an identifier with a digit or underscore of a query (q, identifier).

    The queries' identifiers meet the rows in blocks, so one that many rows name is no key of a shuffle.
    """
    wanted = stash(asked.select(F.col("q").cast("long").alias("q"), "identifier").distinct())
    blocks = max(1, -(-wanted.count() // SENT_TOKENS))
    rows = spread(df.where(F.length(text) > 0).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key")
    every = None
    for block in range(blocks):
        own = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("q", "identifier"), F.lit(blocks)) == block).collect()]
        part = rows.mapInArrow(_identifier_rows(own), "q long, identifier string, key long")
        every = part if every is None else every.unionByName(part)
    return every


def _identifier_rows(own: list[tuple[int, str]]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name: dict[str, list[int]] = {}
        for q, i in own:
            by_name.setdefault(i, []).append(q)
        for batch in it:
            out = [(q, i, k) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in sorted(compound_words(t)) for q in by_name.get(i, ())]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["q", "identifier", "key"])

    return run


def related_identifiers(vocabulary: DataFrame, asked: DataFrame, column: str = "identifier") -> DataFrame:
    """(asked, identifier): the identifiers related to an asked one, by ``text.identifiers_related``."""
    wanted = stash(asked.select(F.col(column).alias("asked")).where("asked is not null").distinct())
    rows = stash(vocabulary.select(F.col(column).alias("identifier")).where("identifier is not null").distinct())
    return identifier_candidates(rows, wanted).where(identifiers_related(F.col("asked"), F.col("identifier")))


def identifier_candidates(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(asked, identifier), each pair once: all that are related, and few others.

    Related ones have the same short parts, and at each place of a long one parts that are equal or one edit apart. An
    asked one is looked up by that place of its own where the fewest identifiers have such a part, so a part that many
    share costs nothing where another tells them apart.
    """
    keyed = _long_parts(rows, "identifier").select("identifier", F.xxhash64("frame", "place", "part").alias("key"))
    places = _long_parts(wanted, "asked")
    like = near_parts(_long_parts(rows, "identifier").select("part").distinct(), places.select("part").distinct())
    keys = stash(places.join(small(like), "part").select("asked", "place", F.xxhash64("frame", "place", "like").alias("key")).distinct())
    counts = semi_by_key(keyed, keys.select("key").distinct(), "key").groupBy("key").agg(F.count("*").alias("n"))
    found = keys.join(counts, "key", "left").groupBy("asked", "place").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = found.groupBy("asked").agg(F.min_by("place", F.struct("n", "place")).alias("place"))
    chosen = stash(keys.join(best, ["asked", "place"]).select("asked", "key"))
    return keyed.join(small(chosen), "key").select("asked", "identifier")


def _long_parts(df: DataFrame, column: str) -> DataFrame:
    """(``column``, frame, place, part): the long parts of identifiers and the short ones around them; an empty part where none is long."""
    parts = F.split(column, "[-_]")
    frame = F.array_join(F.transform(parts, lambda p: F.when(F.length(p) < FUZZY_LENGTH, p).otherwise("*")), "-")
    long = F.filter(F.transform(parts, lambda p, k: F.struct(k.alias("place"), p.alias("part"))), lambda x: F.length(x["part"]) >= FUZZY_LENGTH)
    none = F.array(F.struct(F.lit(-1).alias("place"), F.lit("").alias("part")))
    return df.select(column, frame.alias("frame"), F.explode(F.when(F.size(long) > 0, long).otherwise(none)).alias("x")).select(column, "frame", "x.place", "x.part")


def near_parts(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """(part, like): for each asked part the others that are equal or one edit apart.

    Such words are equal once a character at most is left out of either, and few words are equal so: no key is hot.
    """
    own = stash(asked.select("part", F.explode(left_out("part")).alias("key")))
    others = semi_by_key(parts.select(F.col("part").alias("like"), F.explode(left_out("part")).alias("key")), own.select("key").distinct(), "key")
    return stash(others.join(small(own), "key").select("part", "like").distinct().where(identifiers_related(F.col("part"), F.col("like"))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def left_out(word: pd.Series) -> pd.Series:
    return word.map(lambda w: list(left_out_keys(w)))


def left_out_keys(word: str) -> set[int]:
    """A number for the word and for what is left without each of its characters, in time that follows its length."""
    tail, power, tails = 0, 1, []
    for c in reversed(word):
        tails.append((tail, power))
        tail, power = (tail + (ord(c) + 1) * power) % KEY_PRIME, power * KEY_BASE % KEY_PRIME
    head, keys = 0, {tail}
    for c, (rest, power) in zip(word, reversed(tails)):
        keys.add((head * power + rest) % KEY_PRIME)
        head = (head * KEY_BASE + ord(c) + 1) % KEY_PRIME
    return keys
