"""Filling sequences of fixed capacity with whole documents by the sum-of-squares rule.

Each document goes where the sum over all gaps of the squared number of open sequences with that gap becomes smallest: in
an open sequence it fits in, or a new one. Documents above the capacity give full pieces, which are sequences of their
own, and a remainder that is placed like a document. Tasks pack their share of the documents as a stream; what they hold
is their open sequences.

Documents without tokens (null or empty) are in no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm import tokens
from lodespark.session import stash

CAPACITY = 2048
#: Documents of a task, about; there are at most ``MOST_TASKS`` tasks, which then stream more.
TASK_ROWS, MOST_TASKS = 25_000, 50_000


class Packer:
    """Sum-of-squares placement into sequences of ``capacity``."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.sequences = capacity, 0
        self.open = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a gap of 0 is closed and not counted
        self.by_gap: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int, int]:
        """(sequence, position in it, offset) for an item of 1..capacity."""
        n, b = self.open, self.capacity
        have = n[size:]
        # change of the sum of squares, less 2: one fewer with the old gap, one more with the new one
        change = np.where(have > 0, 2 * (n[: b + 1 - size] - have), np.iinfo(np.int64).max)
        change[0] = -2 * have[0] - 1 if have[0] else change[0]
        fresh = 2 * n[b - size] - 1 if size < b else -2
        k = int(change.argmin())  # ties: the smallest gap
        if change[k] <= fresh:
            gap = size + k
            sequence, position = self.by_gap[gap].pop()
            n[gap] -= 1
        else:
            gap, sequence, position = b, self.sequences, 0
            self.sequences += 1
        left = gap - size
        if left:
            n[left] += 1
            self.by_gap[left].append((sequence, position + 1))
        return sequence, position, b - gap


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(token start, tokens) of the pieces of a document."""
    return [(a, min(capacity, size - a)) for a in range(0, size, capacity)]


_NAMES = ["doc_id", "piece", "pieces", "token_start", "tokens", "sequence_id", "position", "offset"]


def packed(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.RANKS) -> DataFrame:
    """(doc_id, piece, pieces, token_start, tokens, sequence_id, position, offset): where each document or piece stands."""
    sizes = tokens.sized(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path=path)
    sizes = stash(sizes.where("tokens > 0"))
    tasks = min(MOST_TASKS, -(-sizes.count() // TASK_ROWS)) or 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(capacity), TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in it:
            out: list[list] = [[] for _ in _NAMES]
            for i, n in zip(*(c.to_pylist() for c in batch.columns)):
                parts = pieces(n, capacity)
                for k, (start, size) in enumerate(parts):
                    s, position, offset = packer.place(size)
                    for column, value in zip(out, (i, k, len(parts), start, size, base + s, position, offset)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], _NAMES)

    schema = "doc_id long, piece int, pieces int, token_start long, tokens long, sequence_id long, position int, offset long"
    # the order of arrival is that of a hash: the same at every run, and no size comes in a block
    spread = sizes.withColumn("h", F.xxhash64("doc_id", "tokens")).repartition(tasks, "h").sortWithinPartitions("h", "doc_id")
    return spread.select("doc_id", "tokens").mapInArrow(run, schema)


def fill(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, sequences, tokens, unused tokens and the filled share."""
    per = rows.groupBy("sequence_id").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("piece") == 0).cast("long")).alias("documents"))
    total = per.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.count("*").alias("sequences"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    room = F.col("sequences") * capacity
    return total.withColumn("unused", room - F.col("tokens")).withColumn("filled", F.when(room > 0, F.col("tokens") / room))
