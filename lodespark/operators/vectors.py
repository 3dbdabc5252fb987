"""Vector search: exact in blocks, and approximate by product-quantised codes in cells, refined by the vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.operators.lexical import small
from lodespark.session import stash

#: Query vectors that one pass over the table holds: 64 MB of doubles at 2,000 dimensions.
BLOCK_QUERIES = 4_000
#: Rows the coarse quantiser is fitted on at most, those with the smallest hashes of their ids.
FIT_ROWS = 50_000
#: Share of the cells that a search visits. Recall follows the share and not the number of cells, so it is the same at every size.
PROBED_SHARE = 0.9
#: Rounds of Lloyd's algorithm, and how many values the code of a sub-vector has.
ROUNDS, CODES = 12, 256
#: Numbers that one code stands for.
WIDTH = 4
#: Distances that a batch holds at once: 80 MB of doubles.
HELD_DISTANCES = 10_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where=None, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """(query_id, key, distance, rank): the ``k`` nearest rows of each query by squared-root L2 distance, ties by key.

    With ``digits`` distances are rounded before they are ranked.

    ``queries`` is a stated query set (query_id, vector); blocks of it meet every row once. Each batch of rows hands on
    its ``k`` best of each query only. Null vectors are in no result; ``where`` filters before the search.
    """
    if metric != "l2":
        raise ValueError("only l2")
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    n = asked.count()
    parts = []
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BLOCK_QUERIES)))))
    for block in range(max(1, -(-n // BLOCK_QUERIES))):
        own = numbered.where(F.col("block") == block).select("query_id", "vector").collect()
        if own:
            parts.append(rows.mapInArrow(_partial(*_sent(df, own), k, digits=digits), "query_id long, key long, distance double"))
    if not parts:
        return df.sparkSession.createDataFrame([], f"query_id long, {key} long, distance double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "distance", "rank")


def _sent(df: DataFrame, own: list) -> tuple:
    """Ids and the matrix of a block of queries, the matrix as a broadcast variable."""
    return np.array([r[0] for r in own], np.int64), df.sparkSession.sparkContext.broadcast(np.array([r[1] for r in own], np.float64))


def _partial(ids: np.ndarray, asked_matrix, k: int, reach: np.ndarray | None = None, digits: int | None = None, decode=None):
    """The ``k`` best of each query in each batch.

    ``reach`` (queries, cells) limits a query to rows of some cells, the third column; ``decode`` makes vectors of the
    second column where that holds codes.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = asked_matrix.value
        square = (matrix**2).sum(1)
        for batch in it:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            rows = _matrix(batch.column(1)) if decode is None else decode(batch.column(1), batch.column(2).to_numpy())
            size = (rows**2).sum(1)
            step = max(1, HELD_DISTANCES // len(keys))
            for a in range(0, len(ids), step):
                own, asked = ids[a : a + step], matrix[a : a + step]
                rough = square[a : a + step, None] + size[None, :] - 2 * asked @ rows.T
                if reach is not None:
                    within = reach[a : a + step][:, batch.column(2).to_numpy()]
                    rough[~within] = np.inf
                take = min(len(keys), k + 8)  # a few more, as the fast form rounds
                near = np.argpartition(rough, take - 1, axis=1)[:, :take] if take < len(keys) else np.tile(np.arange(len(keys)), (len(own), 1))
                exact = np.sqrt(((rows[near] - asked[:, None, :]) ** 2).sum(2))
                exact = exact if digits is None else np.round(exact, digits)
                if reach is not None:
                    exact[~np.take_along_axis(within, near, 1)] = np.inf
                order = np.lexsort((keys[near], exact), axis=1)[:, :k]
                near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
                found = np.repeat(own, near.shape[1]), keys[near].ravel(), exact.ravel()
                if reach is not None:
                    keep = np.isfinite(found[2])
                    found = tuple(c[keep] for c in found)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "key", "distance"])

    return run


def _lloyd(x: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_cell(x, c)
        sums, sizes = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def _nearest_cell(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, HELD_DISTANCES // max(1, len(c)))
    parts = [((c**2).sum(1)[None, :] - 2 * x[a : a + step] @ c.T).argmin(1) for a in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


@dataclass
class Quantizer:
    """Cells of the whole vectors, and codebooks (sub-vectors, codes, width) of what is left of a vector beside its cell."""

    cells: np.ndarray
    books: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest_cell(x, self.cells)
        rest = (x - self.cells[cell]).reshape(len(x), len(self.books), -1)
        codes = np.stack([_nearest_cell(rest[:, m], self.books[m]) for m in range(len(self.books))], 1)
        return cell.astype(np.int32), codes.astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.cells[cell] + np.concatenate([self.books[m][codes[:, m]] for m in range(len(self.books))], 1)

    def table(self, spark: SparkSession) -> DataFrame:
        """The quantizer as a table of two rows."""
        return spark.createDataFrame([(n, list(x.shape), bytearray(x.astype(np.float64).tobytes())) for n, x in (("cells", self.cells), ("books", self.books))], "name string, shape array<int>, data binary")

    @staticmethod
    def load(table: DataFrame) -> Quantizer:
        parts = {r["name"]: np.frombuffer(bytes(r["data"]), np.float64).reshape(r["shape"]) for r in table.collect()}
        return Quantizer(parts["cells"], parts["books"])


def fit_quantizer(df: DataFrame, cells: int, sub_vectors: int, key: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS, seed: int = 3) -> Quantizer | None:
    """Cells and codebooks by Lloyd's rounds on a bounded sample; None without rows. The width must be a multiple of ``sub_vectors``."""
    rows = df.where(F.col(vector).isNotNull())
    ids = rows.orderBy(F.xxhash64(key), key).limit(fit_rows).select(key)  # only ids are sorted
    x = np.array([r[0] for r in rows.select(key, vector).join(F.broadcast(ids), key, "left_semi").orderBy(key).select(vector).collect()], np.float64)
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    centres = _lloyd(x, cells, rng)
    rest = (x - centres[_nearest_cell(x, centres)]).reshape(len(x), sub_vectors, -1)
    books = [_lloyd(rest[:, m], CODES, rng) for m in range(sub_vectors)]
    # codes that a small sample leaves over repeat the last one, so no vector gets them
    return Quantizer(centres, np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in books]))


def encoded(df: DataFrame, quantizer: Quantizer, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index: every row with its cell and codes, (key, codes, cell); null vectors are in none."""
    sent = df.sparkSession.sparkContext.broadcast(quantizer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if len(batch):
                cell, codes = sent.value.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell)], ["key", "codes", "cell"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, "key long, codes binary, cell int")


def probes_of(cells: int, share: float = PROBED_SHARE) -> int:
    """How many of the cells a search visits."""
    return min(cells, int(np.ceil(cells * share)))


def probe(indexed: DataFrame, quantizer: Quantizer | None, df: DataFrame, queries: DataFrame, k: int, probes: int, refine: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, distance, rank): the ``k`` nearest rows of each query among the best ``refine`` times ``k`` by code.

    Blocks of queries meet the codes of every row once and look at those in the ``probes`` cells nearest to each; only the
    best of each query by code fetch their vectors, by which they are ranked exactly, ties by key.
    """
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    most, every = k * refine, None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if not own or quantizer is None:
            continue
        ids, matrix = _sent(df, own)
        far = (quantizer.cells**2).sum(1)[None, :] - 2 * matrix.value @ quantizer.cells.T
        reach = np.zeros(far.shape, bool)
        np.put_along_axis(reach, np.argsort(far, axis=1, kind="stable")[:, :probes], True, 1)
        sent = df.sparkSession.sparkContext.broadcast(quantizer)

        def decode(column: pa.Array, cell: np.ndarray, sent=sent) -> np.ndarray:
            codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
            return sent.value.decode(codes, cell)

        part = indexed.select("key", "codes", "cell").mapInArrow(_partial(ids, matrix, most, reach, decode=decode), "query_id long, key long, distance double")
        every = part if every is None else every.unionByName(part)
    if every is None:
        return df.sparkSession.createDataFrame([], f"query_id long, {key} long, distance double, rank int")
    near = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    best = every.withColumn("n", near).where(F.col("n") <= most).select("query_id", "key")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("_own"))
    far = F.aggregate(F.zip_with("vector", "_own", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    exact = rows.join(small(stash(best)), "key").join(small(asked), "query_id").select("query_id", "key", F.sqrt(far).alias("distance"))
    return exact.withColumn("rank", near).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "distance", "rank")


def nearest_with_aliases(df: DataFrame, queries: DataFrame, k: int, key: str = "key", vector: str = "vector", digest: str = "digest", digits: int | None = None) -> DataFrame:
    """(query_id, canonical, key, distance, rank): the ``k`` nearest contents of each query, each with every row that holds it.

    Rows of one ``digest`` are one content, searched once under its smallest key.
    """
    first = stash(df.where(F.col(vector).isNotNull()).groupBy(digest).agg(F.min(key).alias("canonical")))
    contents = df.join(first.select(F.col("canonical").alias(key)), key, "left_semi")
    found = nearest(contents, queries, k, key, vector, digits=digits).withColumnRenamed(key, "canonical")
    return found.join(first, "canonical").join(df.select(digest, key), digest).select("query_id", "canonical", key, "distance", "rank")


def index_actions(policy: Column, rows: Column, vector: tuple[Column, Column, Column], path: tuple[Column, Column, Column], changed: Column, least_rows: int = 10_000) -> Column:
    """What maintenance does to the vector index and the index on paths, in order.

    ``policy`` is exact or ivf-pq; an index is (kind or null, indexed rows, rows not indexed). An exact policy drops the
    vector index; otherwise one of another kind is created anew and one that is behind or of another policy refreshed.
    Likewise the index on paths, which is kept from ``least_rows`` rows.
    """
    behind = lambda i: (i[2] > 0) | (i[1] != rows)
    for_vectors = F.when(policy == "exact", F.when(vector[0].isNotNull(), "drop-vector-index")).otherwise(
        F.when(~vector[0].eqNullSafe(F.lit("IVF_PQ")), "create-vector-index").when(changed | behind(vector), "refresh-vector-index")
    )
    for_paths = F.when(rows < least_rows, F.when(path[0].isNotNull(), "drop-relative-path-index")).otherwise(
        F.when(~path[0].eqNullSafe(F.lit("BTREE")), "create-relative-path-index").when(behind(path), "refresh-relative-path-index")
    )
    return F.array_compact(F.array(for_vectors, for_paths))


def recall(expected: DataFrame, actual: DataFrame, key: str = "key") -> float:
    """Share of the expected (query_id, key) rows that are in the actual ones."""
    hit = expected.select("query_id", key).join(actual.select("query_id", key).distinct(), ["query_id", key], "left_semi").count()
    return hit / max(1, expected.count())
