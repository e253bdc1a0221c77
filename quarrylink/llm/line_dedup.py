"""Line dedup by content-defined chunks, in DataFrame expressions only.

A text is its lines.  A hash rolls over the hashes of two neighbouring lines; a chunk begins at each line whose
rolling hash is smaller than those of the line before and the line after.  Such a boundary depends on four lines
around it alone, so that chunks find their boundaries again after lines were put in or taken out, and no chunk of
a text with several lines has fewer than two.  A chunk of two or more lines that occurs more than once is kept
where it occurs first, by doc_id and then by place, and removed elsewhere.  Occurrences are gathered by hash and
compared as bytes: texts are grouped by the chunk itself.  A row's chunks find their group by the hash and the MD5
digest together, so that two chunks that share a 64-bit hash are still told apart and both lose their repeats.

Defined results: a null text stays null and the empty text empty; a text all of whose chunks go becomes empty;
rows with a null id lose what any row with an id has and are never the first; repeated rows (the same id and
text) are each treated alike, so the first row's copies keep what it keeps; of different texts with one id the one
with the smaller hash comes first; other columns pass through, whatever
their names; an empty table gives an empty table.  Nothing is capped: a text may have any number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import written

MULTIPLIER, MODULUS = 1_000_003, 2_147_483_647
LEAST_LINES = 2


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds lines and cuts (where chunks begin, and the number of lines) to a table with an id and a text."""
    at = lambda name, i: F.get(F.col(name), i)
    n = F.size("_ql_lines")
    rolled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.coalesce(at("_ql_hashes", i - 1), F.lit(0)) * MULTIPLIER + at("_ql_hashes", i)) % MODULUS)
    inner = F.when(n >= 4, F.filter(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), lambda i: (at("_ql_rolled", i) < at("_ql_rolled", i - 1)) & (at("_ql_rolled", i) < at("_ql_rolled", i + 1))))
    return (
        df.withColumn("_ql_id", F.col(f"`{id_col}`"))
        .withColumn("_ql_text", F.col(f"`{text_col}`").cast("string"))
        .withColumn("_ql_key", F.xxhash64("_ql_text"))
        .withColumn("_ql_lines", F.split("_ql_text", "\n", -1))
        .withColumn("_ql_hashes", F.transform("_ql_lines", line_hash))
        .withColumn("_ql_rolled", rolled)
        .withColumn("_ql_cuts", F.concat(F.array(F.lit(0)), F.coalesce(inner, F.array().cast("array<int>")), F.array(n)))
    )


def chunk(i: Column) -> Column:
    begin = F.get(F.col("_ql_cuts"), i)
    return F.slice("_ql_lines", begin + 1, F.get(F.col("_ql_cuts"), i + 1) - begin)


def chunk_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash of the text), place, chunk, hash, digest for each chunk of two or more lines."""
    rows = chunked(df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL"), "i", "t")
    chunks = F.transform(F.sequence(F.lit(0), F.size("_ql_cuts") - 2), lambda i: F.when(F.size(chunk(i)) >= LEAST_LINES, F.array_join(chunk(i), "\n")))
    rows = rows.select(F.col("_ql_id").alias("id"), F.col("_ql_key").alias("key"), F.posexplode(chunks).alias("place", "chunk")).where("chunk IS NOT NULL")
    return rows.withColumn("hash", chunk_hash(F.col("chunk"))).withColumn("digest", F.unhex(F.md5("chunk")))


def chunk_hash(text: Column) -> Column:
    return F.xxhash64(text)


def removals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, drop: the places of the chunks that go, for rows that lose any.

    What is looked up is a written table, so that the rows of a chunk that very many texts hold can be dealt to
    several tasks.  A row that repeats id and text has the same places, which count once.
    """
    rows = chunk_rows(df, id_col, text_col)
    place = F.struct("id", "key", "place")
    same = rows.groupBy("hash", "digest", "chunk").agg(F.min(F.when(F.col("id").isNotNull(), place)).alias("first"), F.count(F.lit(1)).alias("n"))
    known = written(same.where("n > 1 AND first IS NOT NULL").select("hash", "digest", "first"), "chunks")
    told = rows.select("id", "key", "place", "hash", "digest").join(known, ["hash", "digest"]).where(~place.eqNullSafe(F.col("first")))
    return told.groupBy("id", "key").agg(F.collect_set("place").alias("drop"))


def with_kept_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a struct of ``df``'s columns but the text) with working columns and _ql_drop; ``kept_lines`` reads them."""
    drop = removals(df, id_col, text_col).select(F.col("id").alias("_ql_of"), F.col("key").alias("_ql_of_key"), F.col("drop").alias("_ql_drop"))
    # In a struct no column's name can clash with a working one.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row"), F.col(f"`{id_col}`").alias("_ql_i"), F.col(f"`{text_col}`").cast("string").alias("_ql_t"))
    # The hash of a null text is never looked up: such a row has no removals.
    rows = rows.withColumn("_ql_key", F.xxhash64("_ql_t"))
    # The texts' side is neither sorted nor gathered: the removals of a partition are the hash table.
    joined = rows.join(drop.hint("shuffle_hash"), F.col("_ql_i").eqNullSafe(F.col("_ql_of")) & (F.col("_ql_key") == F.col("_ql_of_key")), "left").drop("_ql_of", "_ql_of_key", "_ql_key")
    return chunked(joined, "_ql_i", "_ql_t")


def kept_lines() -> Column:
    places = F.sequence(F.lit(0), F.size("_ql_cuts") - 2)
    kept = F.when(F.col("_ql_drop").isNull(), F.col("_ql_lines")).otherwise(F.flatten(F.transform(F.array_except(places, "_ql_drop"), chunk)))
    return F.when(F.col("_ql_text").isNotNull(), kept)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text column cut."""
    rows = with_kept_lines(df, id_col, text_col)
    # What a caller asks of the text cannot be pushed below the generator, where it would repeat the work.
    rows = rows.select("row", F.explode(F.array(F.array_join(kept_lines(), "\n"))).alias("cut"))
    return rows.select(*[F.col("cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; null for a null text)."""
    rows = with_kept_lines(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "doc_id", "text")
    rows = rows.withColumn("_ql_kept", kept_lines())
    lines = F.when(F.col("_ql_text").isNotNull(), F.size("_ql_lines")).otherwise(0).cast("bigint")
    left = F.when(F.col("_ql_text").isNotNull(), F.size("_ql_kept")).otherwise(0).cast("bigint")
    return rows.select("row.doc_id", lines.alias("n_lines"), (lines - left).alias("n_removed"), F.sha2(F.encode(F.array_join("_ql_kept", "\n"), "UTF-8"), 256).alias("kept_sha256"))
