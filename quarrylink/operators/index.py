"""Term indexes as posting tables: tokenisers, TF-IDF and BM25 weights.

Weights and joins stay in DataFrames keyed by term, so an index grows over partitions and not over memory; cutting
frequent terms (max_df) bounds the largest posting list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylink.sources.scratch import written


@dataclass(frozen=True)
class IndexConfig:
    analyzer: str = "word"
    ngrams: tuple[int, int] = (1, 1)
    sublinear: bool = True
    min_df: int = 2
    max_df: float = 0.15
    max_features: int | None = None


WORDS = IndexConfig()
CHARACTERS = IndexConfig("char_wb", (2, 4), False, 1, 1.0, 50_000)
NAME_VIEW = IndexConfig("char_wb", (2, 5), max_df=1.0)
UNSPACED_VIEW = IndexConfig("char", (3, 6), min_df=1, max_df=1.0)
ADDRESS_VIEW = IndexConfig("word", (1, 2), max_df=1.0)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def word_grams(words: Column, low: int, high: int) -> Column:
    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)]) if (low, high) != (1, 1) else words


def char_grams(c: Column, low: int, high: int) -> Column:
    """All grams, repeats included; a text shorter than a gram's length has none of it."""

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def bounded_grams(c: Column, low: int, high: int) -> Column:
    """Grams inside each token padded by a space on both sides; a padded token shorter than a gram's length gives itself once."""
    tokens = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")

    def of(token: Column) -> Column:
        padded = F.concat(F.lit(" "), token, F.lit(" "))

        def grams(n: int) -> Column:
            all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
            short = F.array(padded) if n == low else F.array().cast("array<string>")
            return F.when(F.length(padded) >= n, all_of).otherwise(short)

        return F.concat(*[grams(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(tokens, of))


def terms(c: Column, config: IndexConfig) -> Column:
    c = F.coalesce(c, F.lit(""))
    if config.analyzer == "word":
        return word_grams(words_of(c), *config.ngrams)
    return char_grams(F.lower(c), *config.ngrams) if config.analyzer == "char" else bounded_grams(c, *config.ngrams)


def term_counts(df: DataFrame, id_col: str, text: Column, config: IndexConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, term, tf (and the kept columns)."""
    rows = df.select(F.col(id_col).alias("id"), *keep, F.explode(terms(text, config)).alias("term"))
    return rows.groupBy("id", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def fit_idf(counts: DataFrame, n_docs: int, config: IndexConfig) -> DataFrame:
    """term, df, idf: smoothed inverse document frequency of the terms within the cut-offs."""
    found = document_frequency(counts).where((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * n_docs))
    if config.max_features:
        found = found.orderBy(F.desc("total"), "term").limit(config.max_features)
    return found.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, idf: DataFrame, config: IndexConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, term, weight: TF-IDF rows of unit length; terms outside the vocabulary fall away."""
    tf = F.lit(1.0) + F.log("tf") if config.sublinear else F.col("tf").cast("double")
    raw = counts.join(idf, "term").select("id", *keep, "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", *keep, "term", (F.col("w") / norm).alias("weight"))


@dataclass
class Index:
    idf: DataFrame
    postings: DataFrame
    config: IndexConfig

    def transform(self, df: DataFrame, id_col: str, text: Column, keep: tuple[str, ...] = ()) -> DataFrame:
        return weigh(term_counts(df, id_col, text, self.config, keep), self.idf, self.config, keep)


def build(corpus: DataFrame, id_col: str, text: Column, config: IndexConfig = WORDS, keep: tuple[str, ...] = (), fit_on: DataFrame | None = None) -> Index:
    """An index of ``corpus``, with its vocabulary from ``fit_on`` (the corpus unless given).

    Term counts and vocabulary are written once: the weights, and each ``transform``, read them.
    """
    counts = written(term_counts(corpus, id_col, text, config, keep), "counts")
    base = corpus if fit_on is None else fit_on
    idf = written(fit_idf(counts.drop(*keep) if fit_on is None else term_counts(fit_on, id_col, text, config), base.count(), config), "idf")
    return Index(idf, weigh(counts, idf, config, keep), config)


def bm25(corpus: DataFrame, id_col: str, text: Column, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """id, term, weight: Okapi weights of white-space tokens; a negative idf becomes ``epsilon`` times the mean idf."""
    rows = corpus.select(F.col(id_col).alias("id"), F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "").alias("words"))
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    counts = rows.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5)).alias("idf"))
    average = idf.agg(F.avg("idf")).first()[0]
    idf = idf.select("term", F.when(F.col("idf") < 0, F.lit(epsilon * (average or 0.0))).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
    return counts.join(idf, "term").select("id", "term", weight.alias("weight"))


def save(index: Index, path: str, by: tuple[str, ...] = ()) -> None:
    """``by``: kept columns, such as the country, that the postings are partitioned by."""
    index.idf.write.mode("overwrite").parquet(f"{path}/idf")
    index.postings.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/postings")


def load(spark, path: str, config: IndexConfig) -> Index:
    return Index(spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/postings"), config)
