"""Operators that judge one text at a time."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quarrylink.llm import langid, quality, secrets, sp_offsets, toxicity
from quarrylink.llm.common import ARROW_BYTES, ARROW_KEY, in_small_batches, map_batches
from quarrylink.llm.queries import op5_secrets, op8_sentencepiece, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string"
ODD = [(1, "the cat sat on the mat", "en", None, None, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "", ""), (None, "le chat est sur la table", "fr", "s", 1, "", ""), (5, "12 34 !?", "en", "s", 2, "", ""), (1, "the cat sat on the mat", "en", None, None, "x", "y"), (7, "word " * 50_000, "en", "s", 3, "", ""), (8, "x" * 30_000, "en", "s", 3, "", "")]


def test_a_worker_takes_few_bytes_at_once(spark):
    # The first row is over the bound by itself and comes whole.
    sizes = [3 * ARROW_BYTES] + [10_000] * 2000 + [500_000] * 20
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").coalesce(1).selectExpr("doc_id", "repeat('x', n) AS text")

    def make():
        return lambda part: {"doc_id": part["doc_id"], "rows": [len(part["text"])] * len(part["text"]), "size": [len(x) for x in part["text"]], "total": [sum(map(len, part["text"]))] * len(part["text"])}

    found = map_batches(rows, make, "doc_id long, rows int, size int, total int").collect()
    assert [r["size"] for r in sorted(found)] == sizes
    assert max(r["total"] for r in found if r["rows"] > 1) <= ARROW_BYTES + 500_000


def test_a_lower_bound_of_the_session_stays(spark):
    before = spark.conf.get(ARROW_KEY)
    try:
        spark.conf.set(ARROW_KEY, "1000b")
        in_small_batches(spark.range(1))
        assert spark.conf.get(ARROW_KEY) == "1000b"
    finally:
        spark.conf.set(ARROW_KEY, before)



@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# SentencePiece


def test_ids_and_round_trip(spark, texts):
    codec = sp_offsets.Codec(sp_offsets.read_model(tokenizer_path()))
    for text in [*texts[:40], "", " ", "  a  b ", "日本 語\n", "a▁b", "\x00é <s>"]:
        got = codec.encode([text])[0]
        assert got.ids == codec.library.encode(text, add_bos=True, add_eos=True)
        data, at = text.encode(), 0
        for i, b, e in zip(got.ids, got.begins, got.ends, strict=True):
            assert b <= e and b <= at
            at = max(at, e)
            piece = codec.library.id_to_piece(i)
            if codec.width[i] > 0 and not piece.startswith("<0x") and "▁" not in piece and e > b:
                assert data[b:e].decode(errors="ignore") in piece or piece in data[b:e].decode(errors="ignore")
        assert at == len(data)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_ids_and_spans_come_through_the_aligned_normaliser(rule, texts):
    """The dealt model with a filled character map: ids against the library's, spans against a walk over prefixes."""
    proto = model_pb2.ModelProto()
    proto.ParseFromString(sp_offsets.read_model(tokenizer_path()))
    if rule != "identity":
        own = model_pb2.ModelProto()
        own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.name, proto.normalizer_spec.precompiled_charsmap = rule, own.normalizer_spec.precompiled_charsmap
    codec = sp_offsets.Codec(proto.SerializeToString())
    # Canonical composition is not in the map, so that a mapped prefix may be several characters but texts need no more than it.
    for text in ["ﬁ  Ａ é", " ", "", "ｶﾞ x​y　", "㍿ ①", "plain words", "日本語 \U0001f600", *(t for t in texts[:15] if t)]:
        (got,) = codec.encode([text])
        assert got.ids == codec.library.encode(text, add_bos=True, add_eos=True)
        data, normal = text.encode(), codec.normalise(text.encode())[0]
        assert sum(w for w in codec.width[got.ids]) == len(normal)
        assert (np.diff(got.begins) >= 0).all() and got.ends[-1] == len(data)
        # Each piece's own bytes normalise to bytes that hold the piece.
        for i, b, e in zip(got.ids, got.begins, got.ends, strict=True):
            piece = codec.library.id_to_piece(i)
            if codec.width[i] > 0 and not piece.startswith("<0x") and e > b and (own := data[b:e].decode(errors="ignore")).encode() == data[b:e]:
                assert piece.replace("▁", "").casefold() in codec.library.normalize(own).replace("▁", "").casefold()


def test_digests_of_the_query(spark, texts):
    rows = {r["doc_id"]: r for r in op8_sentencepiece(spark, SF).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        got = rows[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest() and got["covered_bytes"] == len((r["text"] or "").encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf"])
def test_character_map_matches_library(rule, texts):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    codec = sp_offsets.Codec.__new__(sp_offsets.Codec)
    spec = proto.normalizer_spec
    codec.map = sp_offsets.CharacterMap(spec.precompiled_charsmap)
    codec.dummy_prefix, codec.squeeze, codec.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
    for text in ["ﬁ  Ａ é", " ", "", "ｶﾞ x​y　", "㍿ ①", *texts[:20]]:
        normal, origin = codec.normalise(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(origin) == len(normal) + 1 and (np.diff(origin) >= 0).all()


def test_encode_and_decode_frames(spark, odd):
    coded = sp_offsets.encode_offsets(odd, tokenizer_path())
    back = {r["doc_id"]: r["text"] for r in sp_offsets.decode_ids(coded, tokenizer_path()).collect()}
    assert back[1] == "the cat sat on the mat" and back[2] == "" and back[3] == ""
    odd = odd.withColumnsRenamed({"spans": "ids", "score": "n_tokens"})
    digests = {r["doc_id"]: r for r in sp_offsets.round_trip_digests(odd, tokenizer_path()).collect()}
    assert digests[2]["n_tokens"] == 2 and digests[7]["covered_bytes"] == 250_000
    assert sp_offsets.round_trip_digests(odd.limit(0), tokenizer_path()).count() == 0


# Secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(found)]


def test_secrets_against_brute_force(spark):
    rows = op5_secrets(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = brute_spans(r["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == want
        assert r["n_assign"] == sum(s.startswith("assign") for s in want)


def test_secret_edges():
    assert secrets.scan('é token = "abcdef" x') == [("assign", 2, 17)]
    assert secrets.scan("token=abc") == [] and secrets.scan(None) == []
    assert secrets.scan("toKen:token=abcdefg")[0] == ("assign", 0, 19)


def test_battery_tells_random_from_words():
    rng = random.Random(5)
    letters = secrets.ALPHABETS["base64"][:62]
    hits = sum(any(k == "random" for k, _, _ in secrets.scan("say " + "".join(rng.choice(letters) for _ in range(40)) + " here")) for _ in range(200))
    words = sum(any(k == "random" for k, _, _ in secrets.scan(w)) for w in ("thisisaverylongwordwithoutanyspaces", "some_snake_case_identifier_name", "Path/to/some/longer/Folder/name", "a" * 60, "ABABABABABABABABABABABABAB"))
    assert hits >= 190 and words == 0


def test_battery_tests_the_value_of_a_name_alone():
    rng = random.Random(6)
    letters = secrets.ALPHABETS["base64"][:62]
    for name in ("AUTH=", "private_key=", "session==", "?sig="):
        values = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(100)]
        assert sum(secrets.scan(f"é {name}{v} here") == [("random", 2 + len(name), 42 + len(name))] for v in values) >= 95, name
        assert sum(secrets.scan(f"{name}{v}== here") == [("random", len(name), 42 + len(name))] for v in values) >= 95, name


def slow_cuts(pairs, fdr):
    """The step-up rule on (p, weight), sorted: how many it rejects."""
    mean = sum(w for _, w in pairs) / len(pairs)
    ordered = sorted(p / w * mean for p, w in pairs)
    return max((i for i, p in enumerate(ordered, 1) if p <= fdr * i / len(ordered)), default=0)


def test_step_up_over_the_scan(spark):
    rng = random.Random(8)
    letters = secrets.ALPHABETS["base64"][:62]
    words = ["some", "snake", "case", "identifier", "Longer", "Names", "here"]
    texts = [" ".join(["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))) if rng.random() < 0.3 else "_".join(rng.choices(words, k=5)) for _ in range(8)]) for _ in range(60)]
    runs = [r for t in texts for r in secrets.runs_of(t)[1]]
    tally = secrets.Tally()
    tally.add(runs)
    cuts = tally.cuts()
    for place, cut, rate in ((3, cuts[0], secrets.FDR[0]), (4, cuts[1], secrets.FDR[1])):
        rejected = sum(secrets.bin_of(r[place], r[2]) >= cut for r in runs)
        exact = slow_cuts([(r[place], r[2]) for r in runs], rate)
        assert exact * 0.95 - 2 <= rejected <= exact
    found = {r["doc_id"]: [(s["kind"], s["begin"], s["finish"]) for s in r["spans"]] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert found == {i: secrets.spans_under(*secrets.runs_of(t), cuts) for i, t in enumerate(texts)}
    random_words = [w for t in texts for w in t.split() if "_" not in w]
    hit = [texts[i][s:e] for i, spans in found.items() for k, s, e in spans if k == "random"]
    assert len(hit) >= 0.85 * len(random_words) and sum("_" in h for h in hit) <= 0.02 * len(hit)


def test_offsets_of_long_texts():
    text = "é" * 100_000 + " " + "0123456789abcdef" * 2 + " " + "ü" * 100_000
    assert secrets.scan(text) == [("hex", 100_001, 100_033)]


def test_secrets_odd_rows(spark, odd):
    assert secrets.find_secrets(odd).count() == len(ODD)
    assert secrets.find_secrets(odd.limit(0)).count() == 0


# Language


def test_forward_sums_all_segmentations():
    table = langid.PieceTable([bytes((i,)) for i in range(256)] + [b" a", b"ab", b" ab", b"aba"])
    rng = np.random.default_rng(0)
    p = rng.random((260, 2))
    model = langid.Model(table, ["x", "y"], p / p.sum(axis=0))
    prob = {w: model.scaled[i] / langid.PER_BYTE ** len(w) for i, w in enumerate(table.pieces)}

    def total(word):
        return sum((prob[word[:n]] * total(word[n:]) for n in range(1, len(word) + 1) if word[:n] in prob), np.zeros(2)) if word else np.ones(2)

    for word in (b" abab", b" a", b"bababa"):
        assert np.allclose(np.exp(model.forward([word])[0]), total(word))
    long = b" " + b"ab" * 40
    assert np.allclose(model._forward_long(long[:30]), model.forward([long[:30]])[0])


def test_rare_bytes_and_long_pieces():
    pieces = langid.vocabulary(tokenizer_path())
    proto = model_pb2.ModelProto()
    proto.ParseFromString(sp_offsets.read_model(tokenizer_path()))
    plain = {p.piece.lower().replace("▁", " ").encode() for p in proto.pieces if p.type == 1}
    assert {p for p in plain if b" " not in p[1:]} <= set(pieces) and max(map(len, pieces)) > 12
    table = langid.PieceTable([bytes((i,)) for i in range(256)])
    p = np.full((256, 2), 1e-9)
    p[65] = 1 - 255e-9
    model = langid.Model(table, ["x", "y"], p)
    assert np.allclose(model.forward([b"z" * 47]), 47 * np.log(1e-9))
    found = langid.expect(table, p, {b"z" * 47: np.array([2.0, 1.0])})
    assert np.allclose(found[ord("z")], [94, 47])


def slow_expect(table, p, counts):
    """Expected piece counts by listing all segmentations."""
    number = {w: i for i, w in enumerate(table.pieces)}
    ways = lambda w: [[w[:n], *rest] for n in range(1, len(w) + 1) if w[:n] in number for rest in ways(w[n:])] if w else [[]]
    out = np.zeros_like(p)
    for word, weight in counts.items():
        each = [(x, np.prod([p[number[w]] for w in x], axis=0)) for x in ways(word)]
        total = sum(q for _, q in each)
        for x, q in each:
            for w in x:
                out[number[w]] += weight * q / total
    return out


def test_expectation_against_all_segmentations():
    table = langid.PieceTable([bytes((i,)) for i in range(256)] + [b" a", b"ab", b" ab", b"aba"])
    p = np.random.default_rng(2).random((260, 2))
    counts = {b" abab": np.array([1.0, 2.0]), b" aab": np.array([3.0, 0.0]), b"bab": np.array([0.5, 1.0])}
    assert np.allclose(langid.expect(table, p / p.sum(axis=0), counts), slow_expect(table, p / p.sum(axis=0), counts))


def test_long_words_are_learned(monkeypatch):
    table = langid.PieceTable([bytes((i,)) for i in range(256)] + [b" a", b"ab", b" ab", b"aba"])
    words = {b" " + b"ab" * 15: np.array([3.0, 0.0]), b" " + b"abc" * 14: np.array([1.0, 2.0])}
    p = np.random.default_rng(0).random((260, 2))
    want = langid.expect(table, p / p.sum(axis=0), words)
    monkeypatch.setattr(langid, "LONG_WORD", 8)
    assert np.allclose(langid.expect(table, p / p.sum(axis=0), words), want) and want.sum() > 0
    counts = {b" " + b"ab" * 2000: np.array([1.0, 0.0]), b" " + b"cd" * 2000: np.array([0.0, 1.0])}
    logs = langid.fit(table, ["x", "y"], counts).forward([b" " + b"ab" * 40, b" " + b"cd" * 40])
    assert logs[0, 0] > logs[0, 1] + 10 and logs[1, 1] > logs[1, 0] + 10


def test_language_accuracy_and_edges(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, tokenizer_path(), per_language=60)
    told = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[8]["lang_pred"] != "und"
    assert langid.identify(odd.limit(0), tokenizer_path()).count() == 0
    # Null, empty and letterless texts go, and so does a script that no learned language has.
    junk = spark.createDataFrame([(1, "ጐ ጒ ጓ ጔ ጕ ጘ ጙ ጚ ጛ " * 5, "x"), (2, "the people of this place are here", None)], "doc_id long, text string, lang_pred string")
    assert [r["doc_id"] for r in langid.in_known_language(junk, model).collect()] == [2]
    assert langid.in_known_language(odd, model).count() == 5
    for r in langid.predict(docs, model).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    assert langid.learn(odd.where("doc_id IS NULL"), tokenizer_path()) is None


# Quality and toxicity


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(20, 6, replace=False)).astype(np.int32) for _ in range(60)]
    signs = np.array([1.0 if 3 in r else -1.0 for r in rows])
    values, cost = [np.ones(6) / np.sqrt(6) for _ in rows], np.ones(60)
    weights, bias = quality.dual_coordinate_descent(rows, values, signs, cost, 400)
    margin = np.array([bias + (weights[r] * v).sum() for r, v in zip(rows, values, strict=True)])
    assert (np.sign(margin) == signs).all()
    # The dual by projected gradient steps, of which no alpha may exceed its row's cost.
    x = np.zeros((60, 21))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r], x[i, 20] = v, 1
    x *= signs[:, None]
    for top in (1.0, 0.2):
        cost, alpha, gram = np.full(60, top), np.zeros(60), x @ x.T
        for _ in range(20_000):
            alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cost)
        got = quality.dual_coordinate_descent(rows, values, signs, cost, 400)
        want = x.T @ alpha
        assert np.abs(got[0][:20] - want[:20]).max() < 1e-3 and abs(got[1] - want[20]) < 1e-3 and (alpha > top - 1e-9).any()


def test_features_against_a_slow_count():
    for text in ("a b b b c", "x", "one two", "b b b b b b", "é é"):
        data = text.encode()
        words = data.split()
        grams = {int.from_bytes(data[i : i + n]) + (0, 1 << 24, 1 << 25)[n - 1] for n in (1, 2, 3) for i in range(len(data) - n + 1)}
        want = {(g * 2654435761 % 2**32) >> 14 for g in grams} | {xxhash.xxh3_64_intdigest(w) % quality.BUCKETS for w in words}
        again = max((sum(1 for _ in g) - 1 for _, g in groupby(words)), default=0)
        want |= {quality.BUCKETS + n for n in range(min(again, quality.REPEATS))}
        found = quality.features(text)
        assert set(found.tolist()) == want and (quality.unpacked(quality.packed(found)) == found).all()


@pytest.mark.parametrize("operator, column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, operator, column):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = operator.learn(docs, labels, limit=2000)
    got = operator.score(docs, model)
    least = 0.7 if operator is toxicity else 0.5
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= least)
    got = got.join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col(column) == F.col("predicted")).cast("int"))).first()[0] > 0.97


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, operator):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = operator.learn(odd, labels)
    rows = operator.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = operator.learn(odd, labels.limit(0))
    assert operator.score(odd.limit(0), empty).count() == 0


def test_grammar_composes():
    sign = lambda s: [(c, 2.0 if c == "I" else 0.0) for c in s]
    plain, aimed = toxicity.clause_weight(sign("OIO")), toxicity.clause_weight(sign("YOI"))
    assert aimed == toxicity.clause_weight(sign("IOY")) > plain
    assert toxicity.clause_weight(sign("NOI")) < plain and toxicity.clause_weight(sign("ROOOOI")) < plain
    assert toxicity.clause_weight(sign("YT")) > toxicity.clause_weight(sign("OT")) > 0 == toxicity.clause_weight(sign("OO"))


def test_fixed_signs_stay_signs():
    lexicon = toxicity.Lexicon({"kill": 2.0, "you": 5.0, "idiot": 3.0}, {})
    weigh = lambda text: toxicity.text_weights(text, lexicon, lexicon.finder())[0]
    assert weigh("I will kill you") >= toxicity.FIXED_WEIGHT + 2.0 and weigh("kill") < toxicity.FIXED_WEIGHT
    assert weigh("you") == 0 and weigh("you idiot") > weigh("an idiot") > weigh("not an idiot") > 0
    assert weigh("they said you are an idiot") < weigh("you are an idiot")


def test_no_insult_arc_is_cut(spark):
    from itertools import islice, product

    many = " ".join("".join(x) for x in islice(product("bcdfghjklmnpqrstvwxz", repeat=4), 5200))
    texts = [(i, f"{many} {'rare' if i % 2 else 'none'} {i}", 1) for i in range(60)] + [(100 + i, f"the word idiot is in a calm text {i}", 0) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).lexicon
    assert "rare" in lexicon.words and "idiot" not in lexicon.words and "stupid" in lexicon.words
