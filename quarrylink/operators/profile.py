"""Data profiling, sampling and feature analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylink.functions import text as T


def shape(df: DataFrame) -> DataFrame:
    """n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls, pct."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("nulls")) for c in columns]))
    return row.select("n", pairs.alias("p")).select("p.column", "p.nulls", (F.col("p.nulls") * 100.0 / F.col("n")).alias("pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, duplicates, pct: rows beyond the first of each distinct combination, nulls equal."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c"))
    return groups.agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("duplicates")).withColumn("pct", F.col("duplicates") * 100.0 / F.col("n"))


def text_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.max(F.length(c)).alias("max_length"), F.avg(T.token_count(T.fold_space(T.text_or_empty(c)))).alias("mean_tokens"), (F.avg(T.is_non_ascii(T.text_or_empty(c)).cast("double")) * 100).alias("non_ascii_pct"))


def shared_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of several records with equal keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def shuffled(key: str, seed: int = 42) -> Column:
    """What random orders go by: the MD5 digest of the key and the seed, which any engine can compute."""
    return F.md5(F.concat_ws(":", F.col(key), F.lit(seed)))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones on every run."""
    return df.orderBy(shuffled(key, seed), key).limit(n)


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows with the smallest keys: a prefix that does not depend on the order of files."""
    return df.orderBy(key).limit(n)


def sample_and_cut(df: DataFrame, n: int, first: int, key: str, seed: int = 42) -> DataFrame:
    """n rows as in ``sample_exact``, with is_first for the first of them."""
    chosen = sample_exact(df, n, key, seed)
    ahead = chosen.select(key).orderBy(shuffled(key, seed), key).limit(first).select(F.col(key).alias("_k"), F.lit(True).alias("_first"))
    return chosen.join(ahead, F.col(key) == F.col("_k"), "left").select(*df.columns, F.coalesce("_first", F.lit(False)).alias("is_first"))


def benchmark_corpus(corpus: DataFrame, truth: DataFrame, noise: int, key: str = "entity_id", source: Column | None = None) -> DataFrame:
    """All true targets and ``noise`` other rows, of each source where one is given (sources are few)."""
    targets = truth.select(F.col("candidate_id").alias(key)).distinct()
    rest = corpus.join(targets, key, "left_anti")
    kinds = [None] if source is None else [r[0] for r in corpus.select(source.alias("s")).distinct().orderBy("s").collect()]
    out = corpus.join(targets, key, "left_semi")
    for kind in kinds:
        out = out.unionByName(sample_exact(rest if source is None else rest.where(source.eqNullSafe(F.lit(kind))), noise, key))
    return out.dropDuplicates([key])


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds is_train: the first ``share`` of each class in hash order.

    A class may be most of the table, so rows are ranked inside 4,096 ranges of the hash; the counts of the ranges
    before, a table of 4,096 rows a class, are added to those ranks.
    """
    rows = df.withColumn("_h", shuffled(key, seed)).withColumn("_range", F.substring("_h", 1, 3))
    sizes = rows.groupBy(F.col(label).alias("_label"), "_range").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_label")
    sizes = sizes.select("_label", F.col("_range").alias("_r"), (F.sum("_c").over(whole.orderBy("_range")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    place = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key))
    joined = rows.withColumn("_place", place).join(sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("is_train", F.col("_place") + F.col("_before") <= share * F.col("_n")).select(*df.columns, "is_train")


def share_containing(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """n, found, pct: rows whose lower-cased text holds one of the words between spaces; the whole table is read."""
    text = F.lower(T.text_or_empty(F.col(column)))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(f" {w} "))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("found"))
    return row.withColumn("pct", F.col("found") * 100.0 / F.col("n"))


def fan_in(truth: DataFrame) -> DataFrame:
    return truth.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def match_distribution(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: hits in each source; then how many have none, several, only one source, both."""
    per = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("candidate_id").startswith("S2-").cast("int")).alias("s2"), F.max(F.col("candidate_id").startswith("S3-").cast("int")).alias("s3"))
    every = queries.select("query_id").distinct().join(per, "query_id", "left").na.fill(0)
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return every.agg(n("n = 0").alias("none"), n("n > 1").alias("several"), F.max("n").alias("most"), n("s2 = 1 AND s3 = 0").alias("only_s2"), n("s2 = 0 AND s3 = 1").alias("only_s3"), n("s2 = 1 AND s3 = 1").alias("both"))


def class_separation(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """feature, mean_1, mean_0, separation."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p")).select(label, "p.*")
    mean = lambda y: F.avg(F.when(F.col(label) == y, F.col("v")))
    return long.groupBy("feature").agg(mean(1).alias("mean_1"), mean(0).alias("mean_0")).withColumn("separation", F.abs(F.col("mean_1") - F.col("mean_0")))


def correlations(df: DataFrame, features: list[str], least: float = 0.0) -> DataFrame:
    """a, b, corr of each unordered pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col(f"c{i}")).alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return row.select(table.alias("p")).select("p.*").where(F.col("corr") >= least)


def mutual_information(df: DataFrame, feature: str, label: str = "label", bins: int = 10, digits: int = 6) -> DataFrame:
    """Information between a feature in quantile bins and the label, in nats.

    A bin is how many of the exact quantiles a value exceeds; values count to ``digits`` digits, which bounds the table
    of distinct values that the quantiles need for features of a bounded range.
    """
    rows = df.select(F.round(F.col(feature).cast("double"), digits).alias("v"), F.col(label).alias("y")).where("v IS NOT NULL")
    cuts = rows.agg(F.percentile("v", [i / bins for i in range(1, bins)])).first()[0] or []
    above = sum(((F.col("v") > round(c, 9)).cast("int") for c in cuts), F.lit(0))
    joint = rows.groupBy(above.alias("bin"), "y").agg(F.count(F.lit(1)).alias("c"))
    all_of = lambda *keys: F.sum("c").over(Window.partitionBy(*keys))
    cells = joint.select("c", all_of("bin").alias("cx"), all_of("y").alias("cy"), all_of(F.lit(1)).alias("n"))
    return cells.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi")).select(F.lit(feature).alias("feature"), "mi")
