"""Corpus pipeline over ``documents``: language identification, line dedup, near-duplicate removal, benchmark
decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir).  All but the last keep the columns of ``documents``; ``run`` writes every
stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm import decontaminate, langid, line_dedup, similar, sp_offsets
from quarrylink.llm.common import table
from quarrylink.llm.queries import tokenizer_path
from quarrylink.sources import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no learned language go: null, without a letter, or explained by none better than by random bytes.

    The model is learned on ``docs``.
    """
    return langid.in_known_language(docs, langid.learn(docs, tokenizer_path()))


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks go, and n_chars follows the text.  Rows without a word left go with them."""
    cut = line_dedup.dedup_lines(docs)
    cut = cut.where(F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word similarity 0.8 or more) the row with the smallest id stays.

    A row is told by its id and text.  A null id comes after all others, so that a group without any id keeps one
    row too; of equal ids the smallest hash of the text decides; rows that repeat id and text stay once.  Different
    texts that share an id stay both.
    """
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    row = F.unhex(F.md5(F.concat_ws(":", F.hex(key), F.col("doc_id"))))
    # In a struct no column's name can clash with a working one.
    rows = docs.select(F.struct(*docs.columns).alias("all"), key.alias("key"), row.alias("row"), F.col("doc_id").alias("id"))
    groups = similar.groups(docs.select(key.alias("key"), "text"))
    # First the least row of each text, then of each group: no task gathers a text's copies.
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "row")
    least = rows.groupBy("key").agg(F.min(order).alias("least")).join(groups, "key").groupBy("root").agg(F.min("least").alias("least"))
    counts = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(least.select("least.row", F.lit(True).alias("stays")), "row", "left")
    # Texts are joined with the few rows that go or that repeat, which adaptive execution may broadcast.
    odd = scratch.written(counts.where("stays IS NULL OR n > 1").select("row", F.col("stays").isNotNull().alias("stays")), "odd", docs.count())
    once = rows.join(odd.select("row"), "row", "left_anti")
    again = rows.join(odd.where("stays").select("row"), "row", "left_semi").dropDuplicates(["row"])
    return once.unionByName(again).select("all.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes of what is left."""
    return sp_offsets.round_trip_digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_chunks),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", tokens),
]

#: Language identification and tokenisation cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), set(scratch.PATHS)
    for name, stage in STAGES:
        after = stage(spark, docs, sf_dir)
        path = scratch.new_path(spark, name)
        after.write.parquet(path)
        docs = spark.read.schema(after.schema).parquet(path)
        # What the stage wrote on its way, and its input, are read no more.
        scratch.delete(spark, scratch.PATHS - others)
        scratch.PATHS.add(path)
    return docs
