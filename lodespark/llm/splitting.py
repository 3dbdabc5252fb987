"""Splitting oversized texts at natural boundaries with a range-maximum index over boundary strengths.

Every position of a text has a strength as a cut. A sparse table of maxima over windows of two-power lengths answers for
any window where its strongest cut is, the rightmost of equals. From a start the cut is the strongest within the
permissible lengths; the next piece starts ``overlap`` characters before the cut.

Null texts give no piece, texts within the limit (empty ones too) are one piece. Pieces cover the whole text in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1200, 200
#: Share of the size that a piece has at least, unless the text ends.
LEAST_SHARE = 0.5

#: Strength of a cut after the match, weakest first: a later rule overrides an earlier one.
RULES: list[tuple[int, re.Pattern]] = [
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:、，；][\"'”’)\]]*\s*")),
    (3, re.compile(r"\r?\n")),
    (4, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][”’」）]*\s*")),
    (5, re.compile(r"(?:\r?\n[ \t]*){2,}|\n(?=#{1,6} |```|~~~)|\f")),
]
#: Never cut before these: marks that belong to the character in front.
_BOUND = re.compile(r"[̀-ͯ‍︀-️]|(?<=\r)\n|(?<=‍).")


def strengths(text: str) -> np.ndarray:
    """Strength of a cut in front of each position 0..len; -1 where a cut would divide a character."""
    out = np.zeros(len(text) + 1, np.int8)
    for level, rule in RULES:
        at = [m.end() for m in rule.finditer(text)]
        out[at] = level
    out[[m.start() for m in _BOUND.finditer(text)]] = -1
    return out


class RangeMax:
    """Sparse table: the rightmost position of the maximum over any range of up to ``widest`` positions."""

    def __init__(self, values: np.ndarray, widest: int | None = None) -> None:
        n = len(values)
        widest = n if widest is None else min(n, widest)
        # value and position in one number: the larger position wins a tie
        level = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels, width = n, [level], 1
        while 2 * width <= widest:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def argmax(self, low: int, high: int) -> int:
        """Position of the rightmost maximum in low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]) % (self.n + 1))


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP, least_share: float = LEAST_SHARE) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: each at most ``size`` long, each starting ``overlap`` before the last end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = len(text)
    if n <= size:
        return [(0, n)]
    least = min(size, max(overlap + 1, int(size * least_share)))
    index = RangeMax(strengths(text), size - least + 1)
    out, start = [], 0
    while n - start > size:
        cut = index.argmax(start + least, start + size)
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, n)]


def split(
    df: DataFrame,
    size: int = SIZE,
    overlap: int = OVERLAP,
    id_col: str = "row_id",
    text_col: str = "text",
    path_col: str = "relative_path",
    index_col: str = "chunk_index",
    start_col: str = "char_start",
) -> DataFrame:
    """The pieces of all rows: (row_id, relative_path, chunk_index, piece_index, pieces, piece_start, char_start, char_end, text).

    ``piece_start`` counts within the row's text, ``char_start`` and ``char_end`` within the file, null where the row's
    own is null. Rows within the limit pass by without leaving the JVM. A row is a task's smallest unit; its memory is
    about ten numbers a character of the longest text.
    """
    names = ["row_id", "relative_path", "chunk_index", "piece_index", "pieces", "piece_start", "char_start", "char_end", "text"]
    schema = "row_id long, relative_path string, chunk_index int, piece_index int, pieces int, piece_start long, char_start long, char_end long, text string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[] for _ in names]
            for i, path, index, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = spans(text, size, overlap)
                for k, (s, e) in enumerate(pieces):
                    row = (i, path, index, k, len(pieces), s, None if at is None else at + s, None if at is None else at + e, text[s:e])
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    rows = df.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(path_col).cast("string").alias("relative_path"),
        F.col(index_col).cast("int").alias("chunk_index"),
        F.col(start_col).cast("long").alias("char_start"),
        F.col(text_col).alias("text"),
    )
    long = rows.where(F.char_length("text") > size).mapInArrow(run, schema)
    short = rows.where(F.char_length("text") <= size).select(
        "row_id", "relative_path", "chunk_index", F.lit(0).alias("piece_index"), F.lit(1).alias("pieces"), F.lit(0).cast("long").alias("piece_start"),
        "char_start", (F.col("char_start") + F.char_length("text")).alias("char_end"), "text",
    )
    return short.unionByName(long)
