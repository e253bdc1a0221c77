"""Operators that compare texts with each other, against brute force."""

import random
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylink.llm import ann, decontaminate, line_dedup, queries, similar, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in texts], schema)


# Benchmark decontamination


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (12, 30))
        assert decontaminate.semi_global(decontaminate.bits_of(p), len(p), t) == distance(p, t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(8))) for i in range(6)]
    texts = []
    for i in range(60):
        body = list(" ".join(word() for _ in range(10)) + " " + items[i % 6][1].upper() + " " + word())
        for _ in range(rng.randint(0, 8)):
            body[rng.randrange(len(body))] = rng.choice("xyz ")
        texts.append((i, "".join(body) if i % 3 else " ".join(word() for _ in range(20))))
    docs = frame(spark, [*texts, (None, items[0][1]), (99, None), (98, "")])
    bench = spark.createDataFrame([*items, (7, None), (8, "short"), (None, items[1][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for i, t in [*texts, (None, items[0][1])]:
        for k, s in items:
            s = decontaminate.normalise(s)
            if (d := distance(s, decontaminate.normalise(t))) <= int(len(s) * decontaminate.ERROR_RATE):
                want[i, k] = d
    assert set(got) == set(want) and all(got[k] >= want[k] for k in want)
    clean = {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _ in want} | {98, 99}
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_short_items_and_slices(spark, monkeypatch):
    docs = frame(spark, [(1, "What is the  Capital of France?"), (2, "capital of francez"), (3, "no such thing"), (4, "xcapital of france"), (None, "the capital of France? yes")])
    bench = spark.createDataFrame([(1, "capital of France?"), (2, "thing"), (3, "hin"), (4, "what is the capital of frence?"), (5, "absent")], "item_id long, text string")
    want = {(1, 1, 0), (1, 4, 1), (3, 2, 0), (None, 1, 0)}
    for chars in (decontaminate.SLICE_CHARS, 10):
        monkeypatch.setattr(decontaminate, "SLICE_CHARS", chars)
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench).collect()} == want
        assert {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()} == {2, 4}


def test_leaks_with_clashing_columns_and_long_texts(spark):
    long = "word " * 40_000 + "which of these answers is the right one to give " + "word " * 40_000
    docs = spark.createDataFrame([(1, long, "x", "y", 1), (1, long, "x", "y", 1), (2, "clean", None, None, None)], "doc_id long, text string, item_id string, distance string, hits int")
    bench = spark.createDataFrame([(1, "which of these answers is the right one to give", 5)], "item_id long, text string, doc_id int")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1, 0)]
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("list_rows", [2000, 3])
def test_simhash_against_brute_force(spark, monkeypatch, list_rows):
    monkeypatch.setattr(simhash, "LIST_ROWS", list_rows)
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    texts = [(i, base.replace(f"w{i}", "changed", 1)) for i in range(1, 60)] + [(100 + i, " ".join(f"v{rng.randrange(9)}" for _ in range(i))) for i in range(6)]
    texts += [(200, None), (201, ""), (202, " \t"), (203, base), (203, base)]
    got = simhash.near_duplicates(frame(spark, [*texts, (None, base)])).collect()
    fps = {i: brute_fingerprint(t) for i, t in texts}
    roots = brute_components(fps)
    assert len(got) == len(texts) + 1
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", roots[r["doc_id"]])


@pytest.mark.parametrize("local", [0, 30, 10_000])
def test_components_of_a_long_chain(spark, monkeypatch, local):
    monkeypatch.setattr(simhash, "LOCAL_LINKS", local)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(41)} | {(50, 50), (51, 50)}


def test_tally_counts_shared_bytes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 50), np.int64).view(np.uint64)
    b[:9] = a[:9] ^ np.uint64(0xFF00)
    want = [[sum((int(x) >> 8 * k & 255) == (int(y) >> 8 * k & 255) for k in range(8)) for y in b] for x in a]
    assert simhash.tally(a, b).tolist() == want and want[0][0] == 7


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 1), (2, "A B c d", "y", 2), (None, "a b c d", None, None), (4, "word " * 200_000, "z", 3)], "doc_id long, text string, fp string, component_id int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == got[None] == (f"{brute_fingerprint('a b c d'):016x}", 1) and got[4] == (f"{brute_fingerprint('word word word'):016x}", 4)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_triples_meet_every_qualifying_pair():
    from itertools import combinations

    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))


# Line dedup and substring dedup


def duck(documents):
    con = duckdb.connect()
    con.register("frame", documents.toPandas())
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM frame")
    return con


def compare(got, con, sql, columns):
    want = con.sql(sql).project(", ".join(columns)).fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def repeated_texts(unit, sep, n=40):
    rng = random.Random(6)
    shared = [sep.join(unit(rng) for _ in range(rng.randint(60, 120))) for _ in range(4)]
    texts = []
    for i in range(n):
        parts = [sep.join(unit(rng) for _ in range(rng.randint(0, 90))) for _ in range(2)]
        texts.append((i, sep.join([parts[0], rng.choice(shared), parts[1]]) if i % 3 else parts[0]))
    return [*texts, (90, texts[1][1]), (91, None), (92, ""), (93, sep.join(["same"] * 300)), (94, sep.join(["same"] * 200))]


def test_line_dedup_against_sql(spark):
    docs = frame(spark, repeated_texts(lambda r: f"line {r.randrange(5000)} é", "\n"))
    compare(line_dedup.report(docs), duck(docs), queries.OP2_SQL, ["doc_id", "n_lines", "n_removed", "kept_sha256"])
    plan = line_dedup.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_edges(spark):
    block = "\n".join(f"line {i}" for i in range(12))
    docs = frame(spark, [(1, block), (2, block), (2, block), (None, block), (3, None), (4, ""), (5, "one\ntwo")]).withColumnRenamed("lang", "id")
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, block), (2, ""), (2, ""), (None, ""), (3, None), (4, ""), (5, "one\ntwo")], key=str)
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.report(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("source", "_ql_cuts").withColumnRenamed("n_chars", "_ql_text")
    cut = line_dedup.dedup_lines(clash)
    assert cut.columns == clash.columns and sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted(got, key=str)


def test_line_dedup_when_chunks_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "chunk_hash", lambda text: F.lit(7).cast("bigint"))
    docs = frame(spark, repeated_texts(lambda r: f"line {r.randrange(5000)}", "\n", 20))
    compare(line_dedup.report(docs), duck(docs), queries.OP2_SQL, ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def test_substring_dedup_against_sql(spark):
    docs = frame(spark, repeated_texts(lambda r: f"w{r.randrange(3000)}é", " "))
    compare(substring_dedup.digests(docs), duck(docs), queries.OP6_SQL, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def test_substring_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, long), (2, "a " + long + "  b"), (2, "a " + long + "  b"), (None, long), (3, None), (4, ""), (5, "short")])
    got = sorted(((r["doc_id"], r["kept"], [tuple(s) for s in r["spans"]]) for r in substring_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(1, long, []), (2, "a b", [(1, 61)]), (2, "a b", [(1, 61)]), (None, long, []), (3, "", []), (4, "", []), (5, "short", [])], key=str)
    assert substring_dedup.digests(docs.limit(0)).count() == 0


def test_factors_are_copies_of_their_source(spark):
    docs = frame(spark, repeated_texts(lambda r: f"w{r.randrange(3000)}", " "))
    words = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    rows = substring_dedup.dedup(docs).collect()
    lengths = []
    for r in rows:
        gone = {i for s in r["spans"] for i in range(s["begin"], s["finish"])}
        for f in r["factors"]:
            own = words[r["doc_id"]][f["begin"] : f["begin"] + f["length"]]
            assert own == words[f["source"]][f["source_begin"] : f["source_begin"] + f["length"]] and f["source"] < r["doc_id"]
            assert f["length"] >= substring_dedup.WINDOW and set(range(f["begin"], f["begin"] + f["length"])) <= gone
            lengths.append(f["length"])
    assert max(lengths) > 100
    (whole,) = [r["factors"] for r in rows if r["doc_id"] == 90]
    assert len(whole) <= 3


def test_substring_dedup_with_text_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("b", long, 1, 2), ("a", long, 3, 4), (None, long, 5, 6), ("c", "x " + long, None, None)], "doc_id string, text string, key int, copies int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.digests(docs).collect()}
    assert got == {"a": (60, 0), "b": (60, 60), None: (60, 0), "c": (61, 60)}


# Nearest neighbours


def test_recall_and_order(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = defaultdict(list), ann.brute_force(vectors)
    for r in ann.nearest(vectors).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sum(len({v for v, _ in got[q]} & set(ids)) for q, ids in want.items()) >= 0.9 * sum(map(len, want.values()))
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 5


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0])]
    rows += [(i, [2.0, 0.0]) for i in range(20, 9, -1)] + [(50, [0.0, 3.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got[:5]] == [(0, i, 1.0) for i in range(10, 15)]
    assert [r["vec_id"] for r in got[5:]] == [0, 10, 11, 12, 13]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty).count() == 0


def test_extreme_magnitudes(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [5e-324, 0.0]), (50, [-1e308, 1e308])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(df).collect()}
    assert len(got) == 8 and got[0, 1] == pytest.approx(1, abs=1e-15) and got[0, 2] == got[0, 3] == pytest.approx(0.5**0.5) and got[0, 50] == pytest.approx(0)


def test_blocks_of_a_leaf_cover_it(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = ann.brute_force(df)
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == want


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    line = lambda n, k: "\n".join(f"the words of line {n} number {i} are here and there for all of {k}" for i in range(8))
    item = "which of these answers is the right one to give when nobody knows the question"
    docs = [(1, line(1, "us")), (2, line(2, "them") + "\n" + line(1, "us")), (3, line(3, "you")), (4, line(3, "you")), (5, "123 456"), (6, None), (7, line(7, "we") + " " + item)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs] + [(100 + i, f"plain words in number {i} that say {i * 7} other things", "en", "s", 9) for i in range(30)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"] for r in now.collect()})
    assert not {5, 6} & kept[0] and {1, 2, 3, 7} <= kept[0]
    assert {1, 2, 3} <= kept[2] and 7 not in kept[3] and {1, 2, 3} <= kept[3]
    assert c.run(spark, str(tmp_path)).count() == len(kept[3])
    assert not list(Path(tmp_path).glob("quarrylink*"))


def five_word_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("list_rows, block_rows, long_set", [(50, 1000, 1000), (3, 1000, 20), (3, 2, 1000)])
def test_similar_groups_against_brute_force(spark, monkeypatch, list_rows, block_rows, long_set):
    monkeypatch.setattr(similar, "LIST_ROWS", list_rows)
    monkeypatch.setattr(similar, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(similar, "LONG_SET", long_set)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 8)):
            copy = base[: rng.randint(len(base) * 3 // 4, len(base))]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = [five_word_sets(x) for x in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in linked:
        root = [root[j] if r == root[i] else r for r in root]
    got = {r["key"]: r["root"] for r in similar.groups(spark.createDataFrame(list(enumerate(texts)), "key int, text string")).collect()}
    assert len(got) == len(texts) and any((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3 for i, j in linked)
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(i))


def test_similar_groups_begin_with_simhash(spark, monkeypatch):
    exact = similar.pairs_of
    monkeypatch.setattr(similar, "pairs_of", lambda *x: exact(*x).limit(0))
    words, often = [f"w{i}" for i in range(400)], [f"r{i}" for i in range(11)] * 200
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*often, *words[:50]]), " ".join([*often, *words[100:150]])]
    prints = [simhash.fingerprint(x, similar.SHINGLE) for x in texts]
    assert all((prints[i] ^ prints[i + 1]).bit_count() <= simhash.DISTANCE for i in (0, 2))
    got = {r["key"]: r["root"] for r in similar.groups(spark.createDataFrame(list(enumerate(texts)), "key int, text string")).collect()}
    # The last two have near fingerprints and unlike sets.
    assert got[0] == got[1] and len(set(got.values())) == 3


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_lists_of_one_set_go(step):
    rng = random.Random(step)
    rows = sorted((rng.randrange(30), rng.randrange(3)) for _ in range(60))
    sets = defaultdict(set)
    for of, sig in rows:
        sets[of].add(sig)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + step], strict=True)], names=["list", "sig"]) for at in range(0, 60, step)]
    got = [(r["list"], r["sig"]) for b in similar.shared(iter(batches)) for r in b.to_pylist()]
    assert got == sorted((of, sig) for of, s in sets.items() if len(s) > 1 for sig in s)


def test_near_duplicates_stage_takes_near_copies(spark, tmp_path):
    import corpus_pipeline as c

    rows = []
    for n in range(12):
        words = [f"word{n}x{i}" for i in range(100)]
        near = " ".join(words[:40] + ["other", "names", "here"] + words[43:])
        far = " ".join(w if i % 10 else "far" for i, w in enumerate(words))
        rows += [(n, " ".join(words)), (100 + n, near), (200 + n, far)]
    kept = c.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(12), *range(200, 212)]


def test_near_duplicates_stage_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as c

    text = lambda n: " ".join(f"word{n}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (5, text(3)), (5, text(5)), (5, text(6)), (5, text(6)), (None, text(6)), (None, None), (9, "")]
    kept = c.near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, text(1)), (None, text(2)), (3, text(3)), (5, text(5)), (5, text(6)), (9, "")], key=str)


def test_stages_on_empty_null_and_clashing_tables(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, "which of these answers is the right one to give")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = SCHEMA + ", key string, _ql_row string, root string, lang_pred string"
    english = [f"these are some plain words in a text with number {i} and that is all there is to it" for i in range(30)]
    rows = [(i, t, "en", "s", 9, "k", "r", "o", "p") for i, t in enumerate(english)] + [(None, english[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (40, "", "en", "s", 0, "", "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    now, none = docs, docs.limit(0)
    for name, stage in c.STAGES[:-1]:
        now, none = stage(spark, now, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert now.columns == none.columns == docs.columns and none.count() == 0, name
    assert {r["doc_id"] for r in now.collect()} <= set(range(30)) and now.count() >= 1
    assert c.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
