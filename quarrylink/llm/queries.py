"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm import ann, decontaminate, langid, line_dedup, quality, secrets, simhash, sp_offsets, substring_dedup, toxicity
from quarrylink.llm.common import table

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    return os.path.join(TOKENIZER_DIR, name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans the operator finds."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["begin"], s["finish"]))
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "random"), lambda s: F.concat_ws(":", s["kind"], s["begin"], s["finish"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_offsets.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_line_dedup, op3_decontaminate, op4_quality, op5_secrets, op6_substring_dedup, op7_ann, op8_sentencepiece, op9_simhash, op10_langid, pipeline)
    return {f.__name__: f for f in own}


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), r AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * {line_dedup.MULTIPLIER} + h) % {line_dedup.MODULUS} AS rolled, count(*) OVER (PARTITION BY doc_id) AS n FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, CASE WHEN i >= 2 AND i <= n - 2 AND rolled < lag(rolled) OVER w AND rolled < lead(rolled) OVER w THEN 1 ELSE 0 END AS starts FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS place FROM c
), k AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM g GROUP BY doc_id, place
), d AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) AS nth FROM k
), t AS (
  SELECT doc_id, sum(n) AS n_lines, sum(CASE WHEN n >= 2 AND nth > 1 THEN n ELSE 0 END) AS n_removed,
         coalesce(string_agg(CASE WHEN n < 2 OR nth = 1 THEN chunk END, chr(10) ORDER BY place), '') AS kept
  FROM d GROUP BY doc_id
)
SELECT o.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN o.text IS NOT NULL THEN sha256(t.kept) END AS kept_sha256
FROM documents o LEFT JOIN t ON o.doc_id = t.doc_id
"""

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50
), h AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS window_text FROM x
), f AS (
  SELECT md5(window_text) AS k, min(doc_id) AS first FROM h GROUP BY 1
), dup AS (
  SELECT doc_id, pos FROM h JOIN f ON md5(h.window_text) = f.k WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM dup
), p AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT p.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op6_substring_dedup": OP6_SQL}
