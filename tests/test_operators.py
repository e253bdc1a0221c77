import pytest
from pyspark.sql import functions as F

from quarrylink.functions import similarity
from quarrylink.operators import evaluate, index, match, profile, retrieve
from quarrylink.plans import catalog, resolve
from quarrylink.sources import io
from quarrylink.streaming import incremental

ROWS = [
    ("S1-1", "harbor alliance bakery", "45 goff street corning", "us"),
    ("S1-2", "lonely planet", None, "fr"),
    ("S2-1", "harbor alliance bakery", "45 goff street corning", "us"),
    ("S2-2", "harbour alliance", "45 goff street corning", "us"),
    ("S3-1", "blue whale shipping", "9 ocean road", "us"),
    ("S3-2", "blue whale shipping", "9 ocean road", "us"),
    ("S3-3", None, None, None),
]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ROWS, io.ENTITY)


def split(entities):
    return entities.where("entity_id LIKE 'S1%'"), entities.where("entity_id NOT LIKE 'S1%'")


def test_self_similarity_and_order(spark, entities):
    queries, corpus = split(entities)
    text = F.concat_ws(" ", "business_name", "business_address")
    built = index.build(corpus, "entity_id", text, index.IndexConfig(min_df=1, max_df=1.0))
    got = retrieve.top_k(retrieve.scores(built.transform(queries, "entity_id", text), built.postings, 0.1), 2).orderBy("rank").collect()
    assert [(r["query_id"], r["candidate_id"]) for r in got] == [("S1-1", "S2-1"), ("S1-1", "S2-2")]
    assert got[0]["score"] == pytest.approx(1.0)


@pytest.mark.parametrize("keys", [(), ("country",)])
def test_hot_terms_are_cut_without_loss(spark, monkeypatch, keys):
    monkeypatch.setattr(retrieve, "CELL", 3)
    monkeypatch.setattr(retrieve, "PAIRS_A_TASK", 20)
    side = lambda name, n: [(f"{name}{i}", t, ("us", "fr", None)[i % 3], 1.0 + i) for i in range(n) for t in ("hot", f"t{i % 5}")]
    asked, held = [*side("q", 17), ("q0", "hot", "us", 0.5)], side("c", 11)
    frame = lambda rows: spark.createDataFrame(rows, "id string, term string, country string, weight double")
    want = {}
    for a in asked:
        for b in held:
            if a[1] == b[1] and (not keys or a[2] == b[2]):
                want[a[0], b[0]] = want.get((a[0], b[0]), 0) + a[3] * b[3]
    got = {(r["query_id"], r["candidate_id"]): r["score"] for r in retrieve.scores(frame(asked), frame(held), on=keys).collect()}
    assert got == pytest.approx(want)
    assert retrieve.scores(frame(asked).limit(0), frame(held), on=keys).count() == 0


def test_partial_and_final_limit_in_plan(spark, entities):
    queries, corpus = split(entities)
    built = index.build(corpus, "entity_id", F.col("business_name"), index.IndexConfig(min_df=1, max_df=1.0))
    plan = retrieve.top_k(retrieve.scores(built.postings, built.postings), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_golden_f05(spark):
    ids = spark.createDataFrame([("q",), ("single",)], "query_id string")
    truth = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, candidate_id string")
    pred = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query_id string, candidate_id string")
    got = {r["query_id"]: r["f05"] for r in evaluate.query_scores(evaluate.counts(ids, truth, pred)).collect()}
    assert got["q"] == pytest.approx(0.714, abs=1e-3) and got["single"] == 1


def test_truth_parsing(spark):
    rows = spark.createDataFrame([("a", "x, y"), ("b", None), ("c", ""), ("d", "nan"), ("e", "None")], io.TRUTH)
    assert sorted(map(tuple, evaluate.explode_truth(rows).collect())) == [("a", "x"), ("a", "y")]


def test_clusters_and_components(spark, entities):
    clusters = match.duplicate_clusters(entities)
    assert sorted(r["members"] for r in clusters.collect()) == [["S1-1", "S2-1"], ["S3-1", "S3-2"]]
    pairs = spark.createDataFrame([("S1-1", "S3-1")], "query_id string, candidate_id string")
    assert {r["candidate_id"] for r in match.expand(pairs, clusters).collect()} == {"S3-1", "S3-2"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    assert {r["component"] for r in match.connected_components(chain).collect()} == {0, 30}


def test_round_trips(spark, entities, tmp_path):
    entities.coalesce(1).write.csv(str(tmp_path / "t.tsv"), sep="\t", header=True, quote="", emptyValue="")
    assert io.read_either(spark, str(tmp_path / "t")).count() == len(ROWS)
    io.write_threshold(spark, str(tmp_path / "thr"), 0.3)
    assert io.read_threshold(spark, str(tmp_path / "thr")) == 0.3 and io.read_threshold(spark, str(tmp_path / "no")) == 0.1
    out = str(tmp_path / "blocks")
    for _ in range(2):
        io.append_block(spark.range(3), out, 1)
    assert spark.read.parquet(out).count() == 3
    todo = spark.createDataFrame([(1,), (2,)], "block int")
    assert [r[0] for r in io.unfinished(spark, todo, out).collect()] == [2]


def test_lexical_text(spark):
    row = spark.createDataFrame([("Harbor Alliance Inc", "45 Goff St", " US ", "https://www.harbor.example:80/x", "+1 (607) 555")], "business_name string, business_address string, country string, url string, phone string")
    assert row.select(resolve.lexical_text(row)).first()[0] == "harbor alliance | 45 goff street | us | harbor.example:80 | 1607555"
    bare = row.select("business_name").withColumn("business_name", F.lit(None).cast("string"))
    assert bare.select(resolve.lexical_text(bare)).first()[0] == " |  | "


def test_cross_validation_scores_every_row_once(spark):
    rows = spark.range(400).selectExpr("concat('q', id div 4) AS query_id", "id AS candidate_id", "id % 2 AS x", "CAST(id % 2 AS INT) AS label")
    got = match.cross_validated(rows, ["x"], folds=3, trees=2).collect()
    assert sorted(r["candidate_id"] for r in got) == list(range(400))
    assert all((r["probability_match"] > 0.5) == (r["label"] == 1) for r in got)
    assert max(len({r["fold"] for r in got if r["query_id"] == q}) for q in {r["query_id"] for r in got}) == 1


def test_sample_is_repeatable(spark, entities):
    a, b = (profile.sample_exact(entities, 3, "entity_id").collect() for _ in range(2))
    assert a == b and len(a) == 3


def test_stream_links_like_batch(spark, entities, tmp_path):
    queries, corpus = split(entities)
    settings = resolve.Settings(index=index.IndexConfig(min_df=1, max_df=1.0))
    built = resolve.build_index(resolve.normalised(corpus), settings)
    queries.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(io.ENTITY).parquet(str(tmp_path / "in"))
    incremental.link_stream(stream, built, settings, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["query_id"], r["candidate_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["query_id"], r["candidate_id"]) for r in resolve.candidates(resolve.normalised(queries), built, settings).collect()}
    assert got == want and got


def test_best_pairs_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Each query's (and each candidate's) best k over blocks, with ties, against brute force; no product becomes a row."""
    monkeypatch.setattr(retrieve, "CELL", 4)
    side = lambda mark, n, m: [(f"{mark}{i:02}", t, float(1 + i % m)) for i in range(n) for t in ("hot", f"t{i % 3}")]
    frame = lambda rows: spark.createDataFrame(rows, "id string, term string, weight double")
    first, second = [(side("q", 13, 2), side("c", 19, m)) for m in (2, 3)]

    def brute(asked, held):
        out = {}
        for a, t, x in asked:
            for b, u, y in held:
                if t == u:
                    out[a, b] = out.get((a, b), 0) + x * y
        return out

    def best(pairs, k, by):
        groups = {}
        for pair, score in pairs.items():
            groups.setdefault(pair[by], []).append((-round(score, 9), pair[1 - by]))
        return {(key, other): pytest.approx(-s) for key, found in groups.items() for s, other in sorted(found)[:k]}

    q, c = map(frame, first)
    pairs = retrieve.scores(q, c, 3.0, k=3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and pairs.count() < len(brute(*first))
    got = {(r["query_id"], r["candidate_id"]): r["score"] for r in retrieve.top_k(pairs, 3).collect()}
    assert got == best({p: s for p, s in brute(*first).items() if s >= 3}, 3, 0)
    got = {(r["candidate_id"], r["query_id"]): r["score"] for r in retrieve.reverse_top_k(retrieve.scores(q, c, 0.01, strict=True, k=3, best_of="candidate_id"), 3).collect()}
    assert got == best(brute(*first), 3, 1)
    one, two = ({p: s for p, s in brute(*x).items() if s > 2} for x in (first, second))
    both = {p: 0.6 * one.get(p, 0) + 0.4 * two.get(p, 0) for p in {*one, *two}}
    got = {(r["query_id"], r["candidate_id"]): r["score"] for r in retrieve.top_k(retrieve.combined_scores((q, c), tuple(map(frame, second)), 2.0, 3), 3).collect()}
    assert got == best(both, 3, 0)


def test_negative_products_are_pairs_too(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, term string, weight double")
    asked, held = frame([("q", "a", 1.0), ("q", "b", 1.0)]), frame([("c", "a", -2.0), ("d", "b", 1.0), ("d", "b", -1.0), ("e", "x", 1.0)])
    got = {(r["candidate_id"], r["score"]) for r in retrieve.scores(asked, held, float("-inf"), k=5).collect()}
    assert got == {("c", -2.0), ("d", 0.0)}


def test_classes_say_what_their_pairs_say(spark):
    """Counts, lists, sweeps and traps of a truth by classes are those of its pairs, and no plan expands them."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    classes = evaluate.Classes(frame([(f"q{i}", f"k{i % 3}") for i in range(9)], "query_id string, class string"), frame([(f"c{i}", f"k{i % 4}") for i in range(10)], "candidate_id string, class string"))
    ids = frame([(f"q{i}",) for i in range(11)], "query_id string")
    scored = frame([(f"q{i}", f"c{(i * j) % 10}", j / 4, j) for i in range(11) for j in range(1, 4)] + [(f"q{i}", f"c{j}", 0.9, 4 + j) for i in (1, 4) for j in (1, 5, 9)], "query_id string, candidate_id string, score double, rank int")
    scored = scored.dropDuplicates(["query_id", "candidate_id"]).persist()
    texts = frame([(f"{m}{i}", "é" if i == 3 else f"t{i % 2}", i == 2, "de") for m in "qc" for i in range(11)], "entity_id string, text string, no_address boolean, country string")
    predicted = scored.where("score >= 0.6").select("query_id", "candidate_id")

    def told(truth):
        wrong = evaluate.wrong(ids, truth, predicted)
        tables = [
            evaluate.counts(ids, truth, predicted), wrong, evaluate.errors(ids, truth, predicted).select("query_id", F.array_sort("false_positives"), F.array_sort("false_negatives")),
            evaluate.error_kinds(ids, truth, predicted, scored.where("score >= 0.8")), evaluate.at_k(truth, scored, [1, 3]), evaluate.sweep(ids, truth, scored, [(0.5,), (0.8,)], ["score"]),
            evaluate.threshold_table(truth, scored, scored, [0.5, 0.8]), evaluate.traps(wrong, truth, texts, "de"), evaluate.with_hits(scored, truth, F.lit(1)).select("query_id", "candidate_id", "hit"),
        ]
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        return [sorted((tuple(map(plain, r)) for r in t.collect()), key=str) for t in tables]

    assert told(classes) == told(classes.pairs().persist())
    assert 0 < evaluate.wrong(ids, classes, predicted).count() < 11


def test_names_are_compared_once(spark, monkeypatch):
    """Pairs of equal names share one comparison, and each keeps its own row; a missing name is empty."""
    columns = "query_id string, candidate_id string, q_business_name string, c_business_name string"
    rows = [(f"q{i}", f"c{j}", ("blue whale", "harbor", None)[i % 3], ("blue wale", "old harbor")[j % 2]) for i in range(6) for j in range(4)]
    monkeypatch.setattr(catalog, "attached", lambda spark, sf: spark.createDataFrame(rows, columns))
    got = catalog.pair_indel_family(spark, "")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython") :]
    of = lambda f, a, b: f(a, b) if a and b else 0.0
    functions = (similarity.indel, similarity.token_sort, similarity.token_set, similarity.partial)
    assert sorted(map(tuple, got.collect())) == sorted((q, c, *(of(f, a, b) for f in functions)) for q, c, a, b in rows)
