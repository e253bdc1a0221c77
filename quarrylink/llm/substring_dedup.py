"""Substring dedup by relative Lempel-Ziv parsing.

Every text is both parsed and, for the texts after it, reference.  Its WINDOW-word windows fall into blocks: a
window belongs to the smallest hash among its ANCHOR-word sequences, and a block is a stretch of windows with the
same one.  Where two texts agree, they have the same blocks, except at the edges of the agreement.  The index
holds each distinct block (its anchor and a digest of all its windows) with its first place: the smallest doc_id
that has it and the smallest word there.

A text is parsed greedily from its first word to its last: at each block that the index has from an earlier text a
factor begins, and it goes on for as long as the next block stands next in the same source.  A factor is (begin,
length, source, source_begin), in words; it holds at least one window, so none is shorter than WINDOW.  At a factor's
boundaries blocks differ although windows may still agree, so where an anchor is shared by several blocks the
windows themselves are looked up.  One text of each distinct block is enough to put its windows into that second
look-up, and only that text needs the answer: all others have the whole block from an earlier text.  A window is
thus a duplicate exactly if its words also begin a window in a text with a smaller doc_id, as told by two 64-bit
hashes that are independent from the words on (128 bits).  The words of factors and duplicate windows are removed.

Words are runs of characters other than ASCII white space.  Ids keep their type and are compared as it orders them.
Defined results: null, empty and short texts (under WINDOW words) lose nothing; rows with a null id lose nothing and
are no reference; repeated rows are treated alike, and rows that share an id are no reference for each other; extra
columns are ignored; an empty table gives an empty table.  Whole texts are parsed, however long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import id_and_text, map_batches, written

WINDOW = 50
ANCHOR = 10
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD1342543DE82EF95


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two hashes of each word, one in each row."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def doubled(x: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each ``width`` neighbours of the last axis, from halves that may overlap."""
    have = 1
    while have * 2 <= width:
        x = join(x[..., : x.shape[-1] - have], x[..., have:])
        have *= 2
    rest = width - have
    return join(x[..., : x.shape[-1] - rest], x[..., rest:]) if rest else x


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    return doubled(words, width, lambda a, b: mixed(a * MIX + mixed(b)))


def parse(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
    """Of a text's windows: their two hashes, and the begin, length, anchor and two content hashes of each block."""
    x = word_hashes(words)
    windows = sequence_hashes(x, window)
    smallest = doubled(sequence_hashes(x[0], anchor), window - anchor + 1, np.minimum)
    begins = np.concatenate([[0], np.flatnonzero(smallest[1:] != smallest[:-1]) + 1])
    lengths = np.diff(np.concatenate([begins, [windows.shape[1]]]))
    place = np.arange(windows.shape[1]) - np.repeat(begins, lengths)
    powers = np.full(int(lengths.max()), STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    content = mixed(np.add.reduceat(windows * powers[place], begins, axis=1) + lengths.astype(np.uint64))
    return windows, begins, lengths, smallest[begins], content


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, key, block, at (its first word), anchor, c0, c1 of every block."""

    def make():
        def work(rows):
            out = {k: [] for k in ("doc_id", "key", "at", "anchor", "c0", "c1")}
            for doc_id, key, text in zip(rows["doc_id"], rows["key"], rows["text"], strict=True):
                if len(words := split(text)) < WINDOW:
                    continue
                _, begins, _, anchors, content = parse(words)
                for k, v in zip(out, (doc_id, key, begins.astype(np.int32), anchors.view(np.int64), *content.view(np.int64)), strict=True):
                    out[k].append(v)
            return out

        return work

    kind = dict(docs.dtypes)["doc_id"]
    found = map_batches(docs.where("doc_id IS NOT NULL").select("doc_id", "key", "text"), make, f"doc_id {kind}, key bigint, at array<int>, anchor array<bigint>, c0 array<bigint>, c1 array<bigint>")
    return found.select("doc_id", "key", F.posexplode(F.arrays_zip("at", "anchor", "c0", "c1")).alias("block", "b")).select("doc_id", "key", "block", "b.*")


def block_answers(found: DataFrame) -> DataFrame:
    """doc_id, key, copies (blocks an earlier text has, with their place there), asks (blocks whose windows must be looked up)."""
    kinds = found.groupBy("anchor", "c0", "c1").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"))
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("varied"))
    kinds = kinds.join(shared, "anchor", "left").where("first.doc_id < last OR varied").select("anchor", "c0", "c1", "first", F.coalesce("varied", F.lit(False)).alias("varied"))
    # A written table, so that the rows of a block that very many texts hold can be dealt to several tasks.
    kinds = written(kinds, "kinds")
    told = found.join(kinds, ["anchor", "c0", "c1"]).where("doc_id > first.doc_id OR varied")
    copy = F.col("doc_id") > F.col("first.doc_id")
    copies = F.collect_set(F.when(copy, F.struct("block", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_begin"))))
    return told.groupBy("doc_id", "key").agg(F.array_sort(copies).alias("copies"), F.collect_set(F.when(~copy, F.col("block"))).alias("asks"))


def asked_windows(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, key, at, h0, h1 of the windows in the blocks asked for."""

    def make():
        def work(rows):
            out = {k: [] for k in ("doc_id", "key", "at", "h0", "h1")}
            for doc_id, key, text, asks in zip(rows["doc_id"], rows["key"], rows["text"], rows["asks"], strict=True):
                windows, begins, lengths, _, _ = parse(split(text))
                own = np.zeros(len(begins), bool)
                own[asks] = True
                at = np.flatnonzero(np.repeat(own, lengths))
                for k, v in zip(out, (doc_id, key, at.astype(np.int32), *windows[:, at].view(np.int64)), strict=True):
                    out[k].append(v)
            return out

        return work

    kind = dict(docs.dtypes)["doc_id"]
    own = docs.join(answers.where("size(asks) > 0").select("doc_id", "key", "asks").hint("shuffle_hash"), ["doc_id", "key"])
    found = map_batches(own.select("doc_id", "key", "text", "asks"), make, f"doc_id {kind}, key bigint, at array<int>, h0 array<bigint>, h1 array<bigint>")
    return found.select("doc_id", "key", F.explode(F.arrays_zip("at", "h0", "h1")).alias("w")).select("doc_id", "key", "w.*")


def factors_of(begins: np.ndarray, lengths: np.ndarray, copies: list[dict]) -> list[dict]:
    """The greedy parse: begin, length, source and source_begin of each factor, in words.

    ``copies`` has block, source and source_begin, in order of blocks.
    """
    out: list[dict] = []
    last = None
    for c in copies:
        begin, end = int(begins[c["block"]]), int(begins[c["block"]] + lengths[c["block"]]) + WINDOW - 1
        if last == (c["block"], c["source"]) and c["source_begin"] - begin == out[-1]["source_begin"] - out[-1]["begin"]:
            out[-1]["length"] = end - out[-1]["begin"]
        else:
            out.append({"begin": begin, "length": end - begin, "source": c["source"], "source_begin": c["source_begin"]})
        last = (c["block"] + 1, c["source"])
    return out


def duplicate_words(text: str | None, copies: list[dict] | None, starts: list[int] | None) -> tuple[list[bytes], np.ndarray, list[dict]]:
    """The words of a text, which of them go, and its factors."""
    words = split(text)
    if len(words) < WINDOW or not (copies or starts):
        return words, np.zeros(len(words), bool), []
    factors = []
    if copies:
        _, begins, lengths, _, _ = parse(words)
        factors = factors_of(begins, lengths, copies)
    edges = np.zeros(len(words) + 1, np.int64)
    for f in factors:
        edges[f["begin"]] += 1
        edges[f["begin"] + f["length"]] -= 1
    if starts:
        np.add.at(edges, np.array(starts), 1)
        np.add.at(edges, np.array(starts) + WINDOW, -1)
    return words, np.cumsum(edges[:-1]) > 0, factors


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def parsed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, text, copies, starts: each row with what the look-ups said about it."""
    docs = id_and_text(df, id_col, text_col).withColumn("key", F.xxhash64("text"))
    found = written(blocks(docs), "blocks")
    answers = written(block_answers(found), "answers")
    windows = written(asked_windows(docs, answers), "windows")
    first = windows.groupBy("h0", "h1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h0", "h1", "first")
    late = windows.join(written(first, "first"), ["h0", "h1"]).where("doc_id > first").groupBy("doc_id", "key").agg(F.collect_set("at").alias("starts"))
    told = answers.select("doc_id", "key", "copies").join(late, ["doc_id", "key"], "full")
    # The texts' side is not sorted: what a partition's texts were told is the hash table.
    return docs.join(told.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "copies", "starts")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word ranges that go, end exclusive), factors, kept (the other words, joined by one space)."""

    def make():
        def work(rows):
            out = {k: [] for k in ("doc_id", "n_words", "spans", "factors", "kept")}
            for doc_id, text, copies, starts in zip(*(rows[k] for k in ("doc_id", "text", "copies", "starts")), strict=True):
                words, gone, factors = duplicate_words(text, copies, starts)
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["spans"].append([{"begin": a, "finish": b} for a, b in spans_of(gone)])
                out["factors"].append(factors)
                out["kept"].append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    factor = f"struct<begin:bigint,length:bigint,source:{kind},source_begin:bigint>"
    return map_batches(parsed(df, id_col, text_col), make, f"doc_id {kind}, n_words bigint, spans array<struct<begin:bigint,finish:bigint>>, factors array<{factor}>, kept string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, without sending the kept texts back."""

    def make():
        def work(rows):
            out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256")}
            for doc_id, text, copies, starts in zip(*(rows[k] for k in ("doc_id", "text", "copies", "starts")), strict=True):
                words, gone, _ = duplicate_words(text, copies, starts)
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(left)).hexdigest())
            return out

        return work

    return map_batches(parsed(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, n_words bigint, n_removed bigint, kept_sha256 string")
