"""Entity resolution end to end: ``fit`` trains on labelled queries, ``resolve`` links new ones with the same settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.functions import text as T
from quarrylink.operators import evaluate, features, index, match, retrieve
from quarrylink.sources.scratch import written


@dataclass(frozen=True)
class Settings:
    """One object for training and inference, so that they cannot drift apart."""

    index: index.IndexConfig = index.WORDS
    threshold: float = 0.15
    k: int = 30
    by_country: bool = False
    inputs: tuple[str, ...] = tuple(features.PIPELINE)
    sweep: tuple[float, ...] = field(default=tuple(round(0.1 * i, 1) for i in range(1, 10)))


@dataclass
class Model:
    settings: Settings
    index: index.Index
    corpus: DataFrame
    classifier: PipelineModel
    threshold: float


def normalised(df: DataFrame) -> DataFrame:
    """Adds name_lex and addr_lex; a missing column counts as empty."""
    for c in ("business_name", "business_address", "country"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.withColumn("name_lex", T.clean_name("business_name", sort=True)).withColumn("addr_lex", T.clean_address("business_address", sort=True))


def lexical_text(df: DataFrame, sort: bool = False):
    """Normalised name, address and country, and the domain and phone digits of tables that have url and phone."""
    name, address = (F.col(c) if c in df.columns else F.lit("") for c in ("business_name", "business_address"))
    parts = [T.clean_name(name, sort=sort), T.clean_address(address, sort=sort), T.assembled("country") if "country" in df.columns else F.lit("")]
    parts += [f(c) for c, f in (("url", T.domain), ("phone", T.phone_digits)) if c in df.columns]
    return F.concat_ws(" | ", *parts)


def search_text():
    return F.concat_ws(" ", "name_lex", "addr_lex")


def build_index(corpus: DataFrame, settings: Settings) -> index.Index:
    keep = ("country",) if settings.by_country else ()
    return index.build(corpus, "entity_id", search_text(), settings.index, keep)


def candidates(queries: DataFrame, built: index.Index, settings: Settings) -> DataFrame:
    keep = ("country",) if settings.by_country else ()
    pairs = retrieve.scores(built.transform(queries, "entity_id", search_text(), keep), built.postings, settings.threshold, keep, k=settings.k)
    return retrieve.top_k(pairs, settings.k)


def pair_features(queries: DataFrame, corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    attached = features.attach(pairs, queries, corpus)
    return features.pipeline(attached).select("query_id", "candidate_id", *features.PIPELINE)


def fit(queries: DataFrame, corpus: DataFrame, truth: DataFrame, settings: Settings = Settings(), trees: int = 20) -> Model:  # noqa: B008
    """truth: query_id, candidate_id.  The features are written once; training and the sweep read them."""
    queries, corpus = written(normalised(queries), "queries"), written(normalised(corpus), "corpus")
    built = build_index(corpus, settings)
    pairs = candidates(queries, built, settings)
    labelled = pair_features(queries, corpus, pairs).join(truth.withColumn("label", F.lit(1)), ["query_id", "candidate_id"], "left").na.fill(0, ["label"])
    labelled = written(labelled, "features")
    model = match.train(labelled, list(settings.inputs), trees=trees)
    held = match.score(model, match.hash_split(labelled).where("is_valid"), list(settings.inputs)).select("query_id", "candidate_id", F.col("probability_match").alias("p"))
    ids = match.hash_split(queries.select(F.col("entity_id").alias("query_id"))).where("is_valid").select("query_id")
    own = truth.join(ids, "query_id", "left_semi")
    table = evaluate.sweep(ids, own, held, [(t,) for t in settings.sweep], ["p"])
    best = table.orderBy(F.desc(F.round("f05", 9)), "t0").first()
    return Model(settings, built, corpus, model, best["t0"] if best else 0.1)


def save(model: Model, path: str) -> None:
    """Index, corpus, classifier, settings and threshold below ``path``, for another session to ``load``."""
    spark = model.corpus.sparkSession
    index.save(model.index, f"{path}/index", ("country",) if model.settings.by_country else ())
    model.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    model.classifier.write().overwrite().save(f"{path}/classifier")
    row = (json.dumps(asdict(model.settings)), float(model.threshold))
    spark.createDataFrame([row], "settings string, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Model:
    row = spark.read.schema("settings string, threshold double").json(f"{path}/settings").first()
    told = json.loads(row["settings"])
    config = index.IndexConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.pop("index").items()})
    settings = Settings(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})
    return Model(settings, index.load(spark, f"{path}/index", config), spark.read.parquet(f"{path}/corpus"), PipelineModel.load(f"{path}/classifier"), row["threshold"])


def resolve(queries: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """The result list and the candidate list; candidates are written once, so matches are always among them."""
    queries = written(normalised(queries), "queries")
    pairs = written(candidates(queries, model.index, model.settings), "candidates")
    scored = match.score(model.classifier, pair_features(queries, model.corpus, pairs), list(model.settings.inputs))
    result = match.matches(scored, queries, model.threshold, "probability_match")
    listed = match.matches(pairs, queries, float("-inf")).withColumnRenamed("matched_entity_ids", "candidate_entity_ids")
    return result, listed


def union_of_views(queries: DataFrame, corpus: DataFrame, k: int = 20, max_df: float = 1.0) -> DataFrame:
    """Six retrieval views joined by reciprocal rank: names, unspaced names, addresses, both, reverse, words.

    No view cuts frequent terms but the last; ``max_df`` does in all of them, which large tables need: a posting
    list's cost grows with the product of both sides' frequencies.
    """
    name, address = F.col("name_lex"), F.col("addr_lex")
    unspaced = F.regexp_replace("name_lex", " ", "")
    views = {"name": (name, index.NAME_VIEW), "nospace": (unspaced, index.UNSPACED_VIEW), "address": (address, index.ADDRESS_VIEW), "hvt": (search_text(), index.IndexConfig(max_df=0.5))}
    cut = lambda config: replace(config, max_df=min(config.max_df, max_df))
    sides = {}
    for label, (text, config) in views.items():
        built = index.build(corpus, "entity_id", text, cut(config))
        sides[label] = (built.transform(queries, "entity_id", text), built.postings)
    ranked = {label: retrieve.top_k(retrieve.scores(*s, 0.01, strict=True, k=k), k) for label, s in sides.items()}
    ranked["combo"] = retrieve.top_k(retrieve.combined_scores(sides["name"], sides["address"], 0.01, k), k)
    back = index.build(queries, "entity_id", name, cut(index.NAME_VIEW))
    reverse = retrieve.scores(back.postings, back.transform(corpus, "entity_id", name), 0.01, strict=True, k=10, best_of="candidate_id")
    ranked["reverse"] = retrieve.reverse_top_k(reverse, 10)
    return retrieve.rrf(ranked)


def index_sweep(queries: DataFrame, corpus: DataFrame, truth: DataFrame, text, grid: list[tuple[float, float, int | None]]) -> DataFrame:
    """max_df, threshold, k (0 where unlimited), micro_recall, per_query at each grid point.

    One index and one similarity join serve all points with the same max_df.  Truth outside the corpus is not counted.
    """
    ids = corpus.select(F.col("entity_id").alias("candidate_id"))
    known = truth.join(ids, "candidate_id", "left_semi").select("query_id", "candidate_id", F.lit(1).alias("hit"))
    totals = known.agg(F.count(F.lit(1)).alias("n_true")).crossJoin(queries.agg(F.count(F.lit(1)).alias("n_queries")))
    out = None
    for max_df in sorted({g[0] for g in grid}):
        points = [g[1:] for g in grid if g[0] == max_df]
        built = index.build(corpus, "entity_id", text, index.IndexConfig(max_df=max_df))
        pairs = retrieve.scores(built.transform(queries, "entity_id", text), built.postings, min(t for t, _ in points))
        if any(k for _, k in points):
            pairs = retrieve.ranked(pairs)
        flagged = pairs.join(known, ["query_id", "candidate_id"], "left")
        sums = []
        for i, (t, k) in enumerate(points):
            passed = F.round("score", 9) >= t
            passed = (passed & (F.col("rank") <= k) if k else passed).cast("int")
            sums += [F.coalesce(F.sum(passed), F.lit(0)).alias(f"k{i}"), F.coalesce(F.sum(passed * F.coalesce("hit", F.lit(0))), F.lit(0)).alias(f"h{i}")]
        rows = [F.struct(F.lit(max_df).alias("max_df"), F.lit(t).alias("threshold"), F.lit(k or 0).alias("k"), (F.col(f"h{i}") / F.col("n_true")).alias("micro_recall"), (F.col(f"k{i}") / F.col("n_queries")).alias("per_query")) for i, (t, k) in enumerate(points)]
        part = flagged.agg(*sums).crossJoin(totals).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out
