"""Sizes of texts in tokens of a public byte-level BPE tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, text_col: str = "text", size_col: str = "tokens", path: str = RANKS) -> DataFrame:
    """The other columns of ``df`` with the tokens of its text (0 for null), without the text."""
    rest = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in rest] + [size_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in it:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{size_col}` long"
    return df.select(*[F.col(f.name) for f in rest], F.col(text_col)).mapInArrow(run, schema)
