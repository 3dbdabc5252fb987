"""The pN_ queries over the store's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodespark.llm import credentials, languages, mixing, near_duplicates, packing, page_repair, personal_data, splitting
from lodespark.session import table

#: Similarity and shingle width that the task gives for edited copies of chunks.
COPY_THRESHOLD, COPY_WIDTH = 0.6, 3


def _links(spark: SparkSession, d: str):
    return near_duplicates.class_links(table(spark, d, "chunks"), "row_id", "relative_path", "text", COPY_THRESHOLD, COPY_WIDTH)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.row_pairs(*_links(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.grouped(*_links(spark, d), table(spark, d, "chunks"), "row_id")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return page_repair.repaired(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_repair.found(p2_repaired(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.find(table(spark, d, "chunks"), table(spark, d, "name_lexicon"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.redacted(table(spark, d, "chunks"), table(spark, d, "name_lexicon"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find(table(spark, d, "chunks"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "chunks"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("pieces > 1 and piece_index = 0").select("row_id")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segmented(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"), p8_segments(spark, d))


_QUERIES = [p1_found, p1_groups, p2_found, p2_repaired, p3_found, p3_redacted, p4_found, p4_redacted, p5_found, p5_pieces, p6_packed, p6_fill, p7_mixed, p7_shares, p8_found, p8_segments]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_ORACLES = {
    "p1_found": r"""WITH w AS (SELECT row_id, relative_path, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE text IS NOT NULL),
  s AS (SELECT row_id, relative_path, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
  t AS (SELECT row_id, relative_path, len(s) AS n, unnest(s) AS g FROM s)
  SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM t a JOIN t b ON a.g = b.g AND a.row_id < b.row_id AND a.relative_path <> b.relative_path AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n)
  GROUP BY a.row_id, b.row_id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))""",
    "p5_found": "SELECT row_id FROM chunks WHERE length(text) > 1200",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
