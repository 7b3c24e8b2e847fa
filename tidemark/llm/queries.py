"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licences
from .ann import nearest
from .common import table
from .exact import exact_groups
from .lines import dedup_lines
from .mixing import mix_plan
from .packing import pack
from .quality import score_quality
from .simhash import near_groups
from .substrings import repeated_passages
from .toxicity import score_toxicity


def tokenizer_path() -> str:
    """The public vocabulary that the packing contract names; a path that executors can read as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).drop("source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op8_license_scan": licences.oracle(),
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
o AS (SELECT *,
        CAST(sum(source_size) OVER () AS HUGEINT) - coalesce(sum(cap) OVER b, 0) AS left_words,
        CAST(sum(weight) OVER () AS HUGEINT) - coalesce(sum(weight) OVER b, 0) AS left_weight
      FROM w WINDOW b AS (ORDER BY cap * CAST(6 / weight AS BIGINT), source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * left_weight <= weight * left_words AS is_full FROM o),
t AS (SELECT source, source_size,
        CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * (
          CAST(sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE)
          / CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE)) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS rounds,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(rounds * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - rounds * source_size - ahead)) AS BIGINT) AS taken
FROM p""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d),
h AS (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS k FROM s),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM h),
g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, s + 50)) AS i FROM m WHERE first < doc_id) GROUP BY doc_id),
u AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
x AS (SELECT u.doc_id, array_to_string(list(word ORDER BY u.i), ' ') AS kept, count(*) AS n_kept
      FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM g) r ON u.doc_id = r.doc_id AND u.i = r.i WHERE r.i IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id""",
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t""",
}
