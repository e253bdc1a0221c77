"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, lower-cased (pieces that differ in case alone become one), and
every single byte.  A lower-cased text is a sequence of
white-space-separated words, each led by a space mark as the vocabulary's own pieces are; no piece crosses a
word's end, so a text's probability is the product of its words' probabilities, and a word's is the forward
algorithm's sum over all its segmentations.  Per-language piece probabilities come from expectation-maximisation
over word counts of a bounded sample: at most ROWS_PER_LANGUAGE labelled rows of each language, those with the
smallest xxhash64 of their id.

The score of a prediction is the posterior of the predicted language, with the likelihood taken over EVIDENCE
average words, so that it stays below 1 on mixed texts.

As a filter, ``in_known_language`` also rejects texts whose best language gives them less probability than drawing
their bytes at random would: no learned language explains them.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where no language could be
learned; a null language is not learned; a null id is not learned from and stays null in the result; ties go to
the language first in alphabetical order; repeated rows give one row each; extra columns are ignored.  Whole
texts are scored, however long; words of over LONG_WORD bytes, and words whose sums are too small for a double, are
learned and scored with rescaled sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quarrylink.llm.common import id_and_text, id_remainder, in_small_batches, is_held_out, map_batches, parts, release

ROWS_PER_LANGUAGE = 400
ROUNDS = 2
EVIDENCE = 20
LONG_WORD = 48
#: Words of one length that are scored at a time.
WORDS_AT_ONCE = 1000
#: Sums below this may have lost paths that no double holds.
SMALL = 1e-200
#: Each byte's probability is multiplied by this, which keeps sums near 1; it is divided out of the logarithm.
PER_BYTE = 20.0
WORDS_KEPT = 60_000
MERGE_PARTS = 64
ASCII_LETTER = re.compile("[A-Za-z]")


def vocabulary(path: str) -> list[bytes]:
    """All single bytes and the model's pieces, with a space for the space mark; no word holds a space further on."""
    proto = model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = model_pb2.ModelProto.SentencePiece.NORMAL
    pieces = {p.piece.lower().replace("▁", " ").encode() for p in proto.pieces if p.type == normal}
    pieces = {p for p in pieces if len(p) > 1 and b" " not in p[1:]}
    return [bytes((i,)) for i in range(256)] + sorted(pieces)


class PieceTable:
    """Piece number by rolling hash, for many substrings at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
    BITS = 20

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = sorted({len(p) for p in pieces}, reverse=True)
        self.longest = self.lengths[0]
        self.powers = np.ones(self.longest + 1, np.uint64)
        for i in range(1, self.longest + 1):
            self.powers[i] = int(self.powers[i - 1]) * int(self.BASE) % 2**64
        self.hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        if len(set(self.hashes.tolist())) < len(pieces):
            raise ValueError("two pieces share a hash")
        #: Two direct tables; what both places hold already goes to the next.
        self.tables = []
        left = np.arange(len(pieces), dtype=np.int32)
        for mult in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
            slots = np.full(1 << self.BITS, -1, np.int32)
            at = self._slot(self.hashes[left], mult)
            slots[at] = left
            self.tables.append((mult, slots))
            left = left[slots[at] != left]
            if not len(left):
                break
        else:
            raise ValueError("pieces do not fit the tables")

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(self.BASE) + b + 1) % 2**64
        return h

    def _slot(self, hashes: np.ndarray, mult: int) -> np.ndarray:
        return (hashes * np.uint64(mult)) >> np.uint64(64 - self.BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; len(pieces) where there is none."""
        none = np.int32(len(self.pieces))
        out = np.full(len(hashes), none, np.int32)
        for mult, slots in self.tables:
            got = slots[self._slot(hashes, mult)]
            hit = (got >= 0) & (self.hashes[got] == hashes)
            out[hit] = got[hit]
        return out

    def lattice(self, words: list[bytes]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length: (start, end, rows, pieces) of every position pair that some words have a piece at."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        n = raw.shape[1]
        prefix = np.zeros((len(words), n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * self.BASE + raw[:, i]
        edges = []
        for end in range(1, n + 1):
            for start in (end - n for n in self.lengths if n <= end):
                pieces = self.find(prefix[:, end] - prefix[:, start] * self.powers[end - start])
                rows = np.flatnonzero(pieces < len(self.pieces))
                if len(rows):
                    edges.append((start, end, rows, pieces[rows]))
        return edges


def by_length(words: Iterable[bytes]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


class Model:
    """Piece probabilities, one column for each language."""

    def __init__(self, table: PieceTable, languages: list[str], probability: np.ndarray):
        self.table, self.languages = table, languages
        lengths = np.array([len(p) for p in table.pieces], float)
        self.scaled = probability * (PER_BYTE**lengths)[:, None]
        self.number = {p: i for i, p in enumerate(table.pieces)}
        self.kept: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(languages)))

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each of some words of one length, by language."""
        n = len(words[0])
        if n > LONG_WORD:
            return np.array([self._forward_long(w) for w in words])
        sums = np.zeros((n + 1, len(words), len(self.languages)))
        sums[0] = 1
        for start, end, rows, pieces in self.table.lattice(words):
            sums[end, rows] += sums[start, rows] * self.scaled[pieces]
        small = (sums[n] < SMALL).any(axis=1)
        logs = np.log(np.where(small[:, None], 1.0, sums[n])) - n * np.log(PER_BYTE)
        for i in np.flatnonzero(small):
            logs[i] = self._forward_long(words[i])
        return logs

    def _forward_long(self, word: bytes) -> np.ndarray:
        """The same for one word, keeping the last sums that a piece can reach and rescaling them."""
        sums, shift = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for end in range(1, len(word) + 1):
            total = np.zeros(len(self.languages))
            for back in range(1, min(end, self.table.longest) + 1):
                piece = self.number.get(word[end - back : end])
                if piece is not None:
                    total = total + sums[-back] * self.scaled[piece]
            sums = [*sums[1 - self.table.longest :], total]
            if end % 16 == 0:
                shift += np.log(total)
                sums = [s / total for s in sums]
        return np.log(sums[-1]) + shift - len(word) * np.log(PER_BYTE)

    def text_logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log probabilities by text and language, and counts of words and of bytes."""
        words = [[b" " + w for w in t.lower().encode().split()] for t in texts]
        if len(self.kept) > WORDS_KEPT:
            self.kept, self.logs = {}, self.logs[:0]
        new = set(chain.from_iterable(words)) - self.kept.keys()
        blocks = [self.logs]
        for same in by_length(new).values():
            for at in range(0, len(same), WORDS_AT_ONCE):
                part = same[at : at + WORDS_AT_ONCE]
                self.kept.update(zip(part, range(len(self.kept), len(self.kept) + len(part)), strict=True))
                blocks.append(self.forward(part))
        if len(blocks) > 1:
            self.logs = np.concatenate(blocks)
        known = self.kept.__getitem__
        sums = [self.logs[np.fromiter(map(known, w), np.int64, len(w))].sum(axis=0) if w else np.zeros(len(self.languages)) for w in words]
        return np.array(sums), np.array([len(w) for w in words]), np.array([sum(map(len, w)) for w in words])


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def add_long(out: np.ndarray, model: Model, word: bytes, weight: np.ndarray) -> None:
    """Adds one word's expected piece counts (forward-backward on the logarithms of the sums)."""
    n = len(word)
    edges = [(end - back, end, piece) for end in range(1, n + 1) for back in range(1, min(end, model.table.longest) + 1) if (piece := model.number.get(word[end - back : end])) is not None]
    up, down = np.zeros((2, n + 1, out.shape[1]))
    by_end, by_start = [[[] for _ in range(n + 1)] for _ in range(2)]
    for start, end, piece in edges:
        by_end[end].append((start, piece))
        by_start[start].append((end, piece))
    for end in range(1, n + 1):
        starts, pieces = map(list, zip(*by_end[end], strict=True))
        total = (np.exp(up[starts] - up[end - 1]) * model.scaled[pieces]).sum(axis=0)
        up[end] = up[end - 1] + np.log(total)
    for start in range(n - 1, -1, -1):
        ends, pieces = map(list, zip(*by_start[start], strict=True))
        total = (np.exp(down[ends] - down[start + 1]) * model.scaled[pieces]).sum(axis=0)
        down[start] = down[start + 1] + np.log(total)
    starts, ends, pieces = map(list, zip(*edges, strict=True))
    np.add.at(out, pieces, weight * np.exp(up[starts] + down[ends] - up[n]) * model.scaled[pieces])


def expect(table: PieceTable, probability: np.ndarray, counts: dict[bytes, np.ndarray]) -> np.ndarray:
    """Expected piece counts by language over all segmentations of counted words (forward-backward)."""
    model = Model(table, [""] * probability.shape[1], probability)
    out = np.zeros_like(probability)
    for n, words in by_length(w for w in counts if len(w) <= LONG_WORD).items():
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            weight = np.array([counts[w] for w in part])
            edges = table.lattice(part)
            ahead, back = np.zeros((2, n + 1, len(part), probability.shape[1]))
            ahead[0] = back[n] = 1
            for start, end, rows, pieces in edges:
                ahead[end, rows] += ahead[start, rows] * model.scaled[pieces]
            for start, end, rows, pieces in sorted(edges, key=lambda e: -e[1]):
                back[start, rows] += back[end, rows] * model.scaled[pieces]
            small = (ahead[n] < SMALL).any(axis=1)
            share = np.where(small[:, None], 0.0, weight / np.where(small[:, None], 1.0, ahead[n]))
            for i in np.flatnonzero(small):
                add_long(out, model, part[i], weight[i])
            for start, end, rows, pieces in edges:
                used = ahead[start, rows] * model.scaled[pieces] * back[end, rows] * share[rows]
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(pieces, used[:, k], len(out))
    for word in counts:
        if len(word) > LONG_WORD:
            add_long(out, model, word, counts[word])
    return out


def fit(table: PieceTable, languages: list[str], counts: dict[bytes, np.ndarray], rounds: int = ROUNDS) -> Model:
    """From probabilities that fall with a piece's length, ``rounds`` of expectation and maximisation, half a count added."""
    lengths = np.array([len(p) for p in table.pieces], float)
    start = PER_BYTE**-lengths
    probability = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        found = expect(table, probability, counts) + 0.5
        probability = found / found.sum(axis=0)
    return Model(table, languages, probability)


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """lang, text of the sample.  Ids are chosen without reading texts.

    Every input partition hands on at most ``per_language`` ids of a language; MERGE_PARTS tasks a language merge
    those, so that the last task of a language reads at most MERGE_PARTS times ``per_language`` ids at any size.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where((id_remainder("doc_id") != 1) & F.col("lang").isNotNull())
    ids = rows.select("doc_id", "lang", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    chosen = ids.select("doc_id").distinct()
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")


def learn(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """The model of the sample; None if it holds no word.  Word counts are summed on the executors."""
    rows = training_rows(df, id_col, text_col, lang_col, per_language)
    words = F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")
    counted = rows.where(F.col("text").isNotNull()).select("lang", words).where("word <> ''").groupBy("lang", "word").count().toPandas()
    if counted.empty:
        return None
    languages = sorted(counted["lang"].unique())
    column = {lang: i for i, lang in enumerate(languages)}
    counts: dict[bytes, np.ndarray] = {}
    for lang, word, n in zip(counted["lang"], counted["word"], counted["count"], strict=True):
        counts.setdefault(b" " + word.encode(), np.zeros(len(languages)))[column[lang]] += n
    return fit(PieceTable(vocabulary(vocabulary_path)), languages, counts)


class Judge:
    """Predicts one batch of texts after another."""

    def __init__(self, packed):
        self.model = None
        if packed:
            pieces, languages, scaled = packed
            self.model = Model(PieceTable(pieces), languages, scaled * 0)
            self.model.scaled = scaled

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and, for each byte, the logarithm of how much likelier the language is than random bytes."""
        known = [i for i, x in enumerate(texts) if self.model and x is not None and has_letter(x)]
        langs, scores, gains = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if known:
            sums, counts, sizes = self.model.text_logs([texts[i] for i in known])
            for i, logs, n, size in zip(known, sums, counts, sizes, strict=True):
                part = np.exp((logs - logs.max()) * min(1.0, EVIDENCE / n))
                best = int(logs.argmax())
                langs[i], scores[i] = self.model.languages[best], float(part[best] / part.sum())
                gains[i] = float(logs[best] / size + np.log(256))
        return langs, scores, gains


def packed(model: Model | None):
    """What travels to the executors: its size is bounded by the vocabulary and the languages."""
    return model and (model.table.pieces, model.languages, model.scaled)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = packed(model)

    def make():
        judge = Judge(sent)

        def work(rows):
            langs, scores, _ = judge(rows["text"])
            return {"doc_id": rows["doc_id"], "lang_pred": langs, "score": scores}

        return work

    done = map_batches(id_and_text(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, lang_pred string, score double")
    return done.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def in_known_language(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns kept, whose text a learned language explains.  Nothing is shuffled."""
    sent, place = packed(model), df.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa

        judge = Judge(sent)
        for batch in batches:
            for part in parts(batch):
                langs, _, gains = judge(part.column(place).cast(pa.string()).to_pylist())
                yield part.filter(pa.array([x != "und" and g > 0 for x, g in zip(langs, gains, strict=True)], pa.bool_()))
        del judge
        release()

    return in_small_batches(df).mapInArrow(keep, df.schema)


def identify(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(df, learn(df, vocabulary_path, id_col, text_col, lang_col), id_col, text_col)
