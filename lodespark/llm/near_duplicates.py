"""Near-duplicate records: SetSketch bands find candidates, a joint likelihood sifts them, exact similarity decides.

Texts are sets of shingles (runs of words). Texts of the same words in the same order form a class, and everything but
the last expansion works on classes, so any number of copies costs one band entry per task. Neither rows nor links nor
candidates are capped: a bucket with many classes is cut into blocks that are compared in pairs of blocks.

Null and empty texts, and texts with fewer words than a shingle, belong to no pair and form groups of their own row.
Rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm import setsketch as S
from lodespark.operators.lexical import small
from lodespark.session import semi_by_key, stash

BANDS, ROWS = 20, 3
REGISTERS = BANDS * ROWS
#: Register parities a band entry carries for the first sieve; the other 8 bits hold the logarithm of the set's size.
PARITIES = 56
#: Classes of a bucket that are compared within one streaming step; a larger bucket is cut into blocks of this size.
BLOCK = 1024
#: Classes whose keys a task remembers so as to send each class once.
SEEN = 500_000
#: Standard deviations by which an estimate may fall short of the threshold before the pair is dropped.
SLACK = 3.5
#: Sketches keep candidates for thresholds down to this.
LEAST_THRESHOLD = 0.5
_U = np.uint64
_SIZE_STEP = 16.0


def _batches(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list]:
    for batch in it:
        yield [batch.column(batch.schema.get_field_index(c)) for c in columns]


def _sketches(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, paths, texts in _batches(it, "id", "path", "text"):
            texts = texts.to_pylist()
            for a, b in S.slices([len(t) for t in texts]):
                hashes, counts = S.words(texts[a:b])
                elements, n = S.shingles(hashes, counts, width)
                keys = S.sequence_keys(hashes, counts)
                lead = np.zeros(len(keys), bool)
                for k in np.flatnonzero(n):
                    if (key := int(keys[k])) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        lead[k] = True
                sketch = [None] * len(keys)
                if lead.any():
                    regs = S.registers(elements[np.repeat(lead, n)], n[lead], REGISTERS)
                    for k, row in zip(np.flatnonzero(lead), regs):
                        sketch[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], paths[a:b], pa.array(keys.view(np.int64)), pa.array(S.distinct(elements, n).astype(np.int32)), pa.array(sketch, pa.binary())],
                    ["id", "path", "cls", "n", "sketch"],
                )

    return run


def sketched(df: DataFrame, id_col: str, path_col: str, text_col: str, width: int) -> DataFrame:
    """(id, path, cls, n, sketch) of all rows with text; ``n`` is the size of the set, ``sketch`` is null where the task has met the class before."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")
    ).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    return rows.mapInArrow(_sketches(width), "id long, path string, cls long, n int, sketch binary")


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _band_entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cls, n, sketch in _batches(it, "cls", "n", "sketch"):
        if not len(cls):
            continue
        regs = _registers_of(sketch).astype(np.uint64)
        bits = np.bitwise_or.reduce((regs[:, :PARITIES] & _U(1)) << np.arange(8, 8 + PARITIES, dtype=np.uint64), axis=1)
        size = np.minimum(np.log2(n.to_numpy().astype(float)) * _SIZE_STEP, 255).astype(np.uint64)
        r = regs.reshape(len(regs), BANDS, ROWS)
        key = (np.arange(BANDS, dtype=np.uint64) << _U(48)) | (r[:, :, 0] << _U(32)) | (r[:, :, 1] << _U(16)) | r[:, :, 2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.ravel().view(np.int64)),
                pa.array(np.repeat(cls.to_numpy(), BANDS)),
                pa.array(np.repeat((bits | size).view(np.int64), BANDS)),
            ],
            ["key", "cls", "mark"],
        )


def least_agreement(threshold: float) -> int:
    """Parities that must agree: half of the unequal registers agree by chance."""
    p = (1 + threshold) / 2
    return int(np.floor(PARITIES * p - 3 * np.sqrt(PARITIES * p * (1 - p))))


def _sift(mark_a: np.ndarray, mark_b: np.ndarray, threshold: float) -> np.ndarray:
    x = mark_a ^ mark_b
    agree = PARITIES - np.bitwise_count(x >> _U(8)).astype(int)
    gap = np.abs((mark_a & _U(255)).astype(int) - (mark_b & _U(255)).astype(int))
    return (agree >= least_agreement(threshold)) & (gap <= -np.log2(threshold) * _SIZE_STEP + 1.01)


def _pairs_within(cls: np.ndarray, mark: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(cls), 1)
    keep = _sift(mark[i], mark[j], threshold) & (cls[i] != cls[j])
    i, j = i[keep], j[keep]
    return np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])


def _as_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    return a, b


def _bucket_pairs(threshold: float, block: int):
    """Streams entries sorted by (key, cls): pairs of small buckets, and the entries of large ones with their block."""
    names = ["a", "b", "key", "mark", "block"]

    def rows(a=(), b=(), key=None, mark=None, at=None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a, pa.int64()),
                none if key is not None else pa.array(b, pa.int64()),
                none if key is None else pa.array(key, pa.int64()),
                none if key is None else pa.array(mark, pa.int64()),
                none if key is None else pa.array(at, pa.int64()),
            ],
            names,
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open bucket: key, cls, mark, members already sent to blocks
        sent = 0

        for cols in _batches(it, "key", "cls", "mark"):
            key, cls, mark = (c.to_numpy() for c in cols)
            if not len(key):
                continue
            if held is not None:
                key, cls, mark = (np.concatenate([h, c]) for h, c in zip(held, (key, cls, mark)))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, mark = key[fresh], cls[fresh], mark[fresh]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            found = []
            two = starts[:-1][(ends - starts)[:-1] == 2]
            if sent and len(starts) > 1:  # the large bucket of the batches before ends here
                s, e = starts[0], ends[0]
                yield rows(cls[s:e], (), key[s:e], mark[s:e], np.full(e - s, sent // block))
                two = two[two != s]
            if len(two):
                keep = _sift(mark[two].view(np.uint64), mark[two + 1].view(np.uint64), threshold)
                found.append((cls[two[keep]], cls[two[keep] + 1]))
            for s, e in zip(starts[:-1], ends[:-1]):
                if e - s <= 2 or (sent and s == starts[0]):
                    continue
                if e - s <= block:
                    found.append(_pairs_within(cls[s:e], mark[s:e].view(np.uint64), threshold))
                else:
                    yield rows(cls[s:e], (), key[s:e], mark[s:e], np.arange(e - s) // block)
            if len(starts) > 1:
                sent = 0
            s = starts[-1]
            # all but the last member of an open large bucket can go to blocks; the last stays to recognise repeats
            while len(key) - s > block:
                yield rows(cls[s : s + block], (), key[s : s + block], mark[s : s + block], np.full(block, sent // block))
                s, sent = s + block, sent + block
            held = key[s:], cls[s:], mark[s:]
            if found:
                yield rows(*_as_pairs(found))
        if held is not None:
            key, cls, mark = held
            if sent:
                yield rows(cls, (), key, mark, np.full(len(cls), sent // block))
            elif len(cls) > 1:
                yield rows(*_as_pairs([_pairs_within(cls, mark.view(np.uint64), threshold)]))

    return run


def _tile(threshold: float):
    """Pairs between the two blocks of a tile, one row of the first block at a time."""

    def run(pdf):
        import pandas as pd

        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        lc, lm = left.cls.to_numpy(), left.mark.to_numpy().view(np.uint64)
        rc, rm = right.cls.to_numpy(), right.mark.to_numpy().view(np.uint64)
        parts = []
        for c, m in zip(lc, lm):
            keep = _sift(np.full(len(rm), m), rm, threshold) & (rc != c)
            parts.append((np.minimum(c, rc[keep]), np.maximum(c, rc[keep])))
        a, b = _as_pairs(parts)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return run


def candidates(marked: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a < b) of classes that share a band and whose parities agree well enough."""
    parts = max(12, int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = marked.mapInArrow(_band_entries, "key long, cls long, mark long")
    sorted_ = entries.repartition(parts, "key").sortWithinPartitions("key", "cls")
    out = stash(sorted_.mapInArrow(_bucket_pairs(threshold, block), "a long, b long, key long, mark long, block long"))
    small = out.where("key is null").select("a", "b")
    large = out.where("key is not null").select(F.col("a").alias("cls"), "key", "mark", F.col("block").cast("int").alias("block"))
    blocks = large.groupBy("key").agg(F.max("block").alias("last"))
    # each member goes to the tiles (own block, later block) on side 0 and (earlier or own block, own block) on side 1
    spread = large.join(blocks, "key").withColumn("tile", F.explode(F.sequence(F.lit(0), "last")))
    tiles = spread.select(
        "key",
        F.least("block", "tile").alias("i"),
        F.greatest("block", "tile").alias("j"),
        F.when(F.col("block") == F.col("tile"), F.array(F.lit(0), F.lit(1))).when(F.col("block") < F.col("tile"), F.array(F.lit(0))).otherwise(F.array(F.lit(1))).alias("sides"),
        "cls",
        "mark",
    ).withColumn("side", F.explode("sides"))
    far = tiles.groupBy("key", "i", "j").applyInPandas(_tile(threshold), "a long, b long")
    return small.unionByName(far).distinct()


def _likely(threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, na, nb, sa, sb in _batches(it, "a", "b", "na", "nb", "sa", "sb"):
            if not len(a):
                continue
            x, y = na.to_numpy().astype(float), nb.to_numpy().astype(float)
            guess = S.joint_estimate(_registers_of(sa), _registers_of(sb), x, y)
            room = SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
            keep = pa.array(guess >= threshold - room)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def _verified(threshold: float, width: int):
    def sets(texts: list[str]) -> list[np.ndarray]:
        out = []
        for s, e in S.slices([len(t) for t in texts]):
            hashes, counts = S.words(texts[s:e])
            elements, n = S.shingles(hashes, counts, width)
            out += [np.unique(p) for p in np.split(elements, np.cumsum(n)[:-1])]
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, ta, tb in _batches(it, "a", "b", "ta", "tb"):
            if not len(a):
                continue
            sim = np.array([S.jaccard(x, y) for x, y in zip(sets(ta.to_pylist()), sets(tb.to_pylist()))])
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(sim).filter(keep)], ["a", "b", "similarity"])

    return run


def class_links(
    df: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float = 0.8, width: int = 5, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts: (a, b, similarity) with a < b, and the rows (id, path, cls, n).

    A link is a pair whose exact similarity is at least ``threshold``, which may be 0.5 to 1.
    """
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"threshold must be {LEAST_THRESHOLD} to 1")
    rows = stash(sketched(df, id_col, path_col, text_col, width))
    marked = rows.where("sketch is not null").select("cls", "n", "sketch")
    pairs = stash(candidates(marked, threshold, block))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sketches = semi_by_key(marked, ids, "cls").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    near = pairs.join(sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    near = near.join(sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    likely = stash(near.mapInArrow(_likely(threshold), "a long, b long"))
    ids = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    first = semi_by_key(rows.where("sketch is not null").select("cls", "id"), ids, "cls").groupBy("cls").agg(F.min("id").alias("id"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = stash(first)
    texts = semi_by_key(texts, first.select("id"), "id").join(first, "id").groupBy("cls").agg(F.first("text").alias("text"))
    exact = likely.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    exact = exact.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    links = stash(exact.mapInArrow(_verified(threshold, width), "a long, b long, similarity double"))
    return links, rows.select("id", "path", "cls", "n")


def row_pairs(links: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs of rows (row_id_a < row_id_b) of different paths whose classes are equal or linked.

    Null paths count as a path of their own. The size of this list is the square of the copies; ``grouped`` has one row each.
    """
    rows = rows.where("n > 0")
    both = links.select("a", "b").unionByName(rows.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    ids = both.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    members = semi_by_key(rows, ids, "cls").select("id", "path", "cls")
    # the members of a class of many copies meet in several tasks: one side is dealt over salts, the other stands in each
    many = small(members.groupBy("cls").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("cls", F.ceil(F.col("c") / BLOCK).cast("int").alias("salts")))
    salted = members.join(many, "cls", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = members.select(F.col("cls").alias("a"), F.col("id").alias("ia"), F.col("path").alias("pa"))
    b = salted.select(F.col("cls").alias("b"), F.col("id").alias("ib"), F.col("path").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = both.join(many.select(F.col("cls").alias("b"), "salts"), "b", "left").join(a, "a").withColumn("salt", F.pmod(F.xxhash64("ia"), F.coalesce("salts", F.lit(1))).cast("int"))
    out = left.join(b, ["b", "salt"]).where(~F.col("pa").eqNullSafe(F.col("pb")) & ((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib"))))
    return out.select(F.least("ia", "ib").alias("row_id_a"), F.greatest("ia", "ib").alias("row_id_b"))


def components(links: DataFrame) -> DataFrame:
    """(cls, root): the smallest class each linked class can reach, by alternating star contraction.

    Every round sends each class's larger neighbours to its smallest one, then its smaller neighbours likewise; the
    edges end as stars. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select("a", "b")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()
        # small star: a > all of b
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = stash(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return edges.select(F.col("a").alias("cls"), F.col("b").alias("root"))
        before = now


def grouped(links: DataFrame, rows: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """One row per row of ``df``: (row_id, class_id, group_id, links).

    ``class_id`` is the smallest row id with the same words, ``group_id`` the smallest row id of the chain of links,
    ``links`` the number of other classes linked to the row's class.
    """
    first = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    linked = degree.join(components(links), "cls", "left").select("cls", "links", F.coalesce("root", "cls").alias("root"))
    linked = linked.join(first, "cls")
    top = linked.groupBy("root").agg(F.min("class_id").alias("group_id"))
    linked = linked.join(top, "root").select("cls", "links", "group_id")
    known = rows.where("n > 0").select("id", "cls").join(first, "cls").join(linked, "cls", "left")
    known = known.select(F.col("id").alias("row_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rest = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id")).join(rows.where("n > 0").select(F.col("id").alias("row_id")), "row_id", "left_anti")
    return known.unionByName(rest.select("row_id", F.col("row_id").alias("class_id"), F.col("row_id").alias("group_id"), F.lit(0).cast("long").alias("links")))
