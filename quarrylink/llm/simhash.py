"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has 64 bits; bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word
shingles.  Fingerprints at DISTANCE or fewer differing bits link.  Such a pair differs in at most DISTANCE of its
8 positional bytes, so it shares at least 8 - DISTANCE of them: that is the guaranteed minimum.  Within a list of
the index the shared positional bytes of each pair are tallied; pairs that reach the minimum are verified bit by bit.

Posting lists of single positional bytes would each hold a 256th of all fingerprints.  The index keeps them in
combination instead: of any 5 shared positions, 3 fall among the bytes 0-3 or among 4-7, so the lists of the 8
triples within a half meet every pair that the count filter can pass.  Equal fingerprints are one entry, however
many documents have them.  Lists of over LIST_ROWS entries are split again by each two of the five other bytes
(a qualifying pair shares at least two), and what is still longer is compared block against block, so that no
task holds more than two blocks and no pair is left out.  From every list or pair of blocks only a spanning
forest of the links found is kept.  Components come from repeated smallest-neighbour steps over those links, on
written tables.

Result: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).  Defined results:
texts without words (null, empty, blank) have fingerprint 0 and link like any other; a null doc_id is never the
smallest unless its whole component has none; rows are taken one by one, so repeated rows give one result row
each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import id_and_text, map_batches, written

SEED = 42
DISTANCE = 3
SHINGLE = 3
LIST_ROWS = 2000
#: Links that one task takes.
LOCAL_LINKS = 1_000_000
#: Shingles whose bits are laid out at a time.
SLICE = 1 << 16
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        value = digest(b" ".join(words), SEED)
        return value - (1 << 64) if value >> 63 else value
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: -shingle]])
    hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(begins.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, len(begins))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [fingerprint(x, shingle) for x in rows["text"]]}

    return map_batches(id_and_text(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, fp bigint")


def byte_at(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)


def key_of(number: int, positions: tuple[int, ...]) -> Column:
    """A list's key: which positions, and their bytes."""
    key = F.lit(number).cast("bigint")
    for i in positions:
        key = key * 256 + byte_at(i)
    return key


def posting_lists(fps: DataFrame) -> DataFrame:
    """list, fp for each triple; and, for long lists, each of their parts by two more positions."""
    entries = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("triple"), key_of(n, t).alias("list")) for n, t in enumerate(TRIPLES, 1)])).alias("e")).select("fp", "e.*")
    sizes = entries.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = entries.join(sizes, "list")
    short = entries.where(F.col("size") <= LIST_ROWS).select("list", F.lit(0).alias("part"), "fp")
    parts = F.lit(None)
    for n, t in enumerate(TRIPLES, 1):
        rest = [i for i in range(8) if i not in t]
        parts = F.when(F.col("triple") == n, F.array(*[key_of(16 + k, two).cast("int") for k, two in enumerate(combinations(rest, 2))])).otherwise(parts)
    long = entries.where(F.col("size") > LIST_ROWS).select("list", F.explode(parts).alias("part"), "fp")
    return short.unionByName(long)


def in_blocks(lists: DataFrame) -> DataFrame:
    """list, part, block pair, side, fp: what is compared in one go.  Lists of over LIST_ROWS go to several pairs of blocks."""
    sizes = lists.groupBy("list", "part").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("blocks")).where("blocks > 0")
    lists = lists.join(sizes, ["list", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "own").alias("low"), F.greatest(b, "own").alias("high")))
    return lists.select("list", "part", F.explode(pair).alias("p"), "own", "fp").select("list", "part", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "own", "fp")


def tally(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes each pair shares."""
    a, b = rows.view(np.uint8).reshape(-1, 8), others.view(np.uint8).reshape(-1, 8)
    shared = np.zeros((len(rows), len(others)), np.uint8)
    for i in range(8):
        shared += a[:, i, None] == b[None, :, i]
    return shared


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints; no member is left out, chunks bound the memory.

    Shared positional bytes are tallied for each pair; pairs that reach the guaranteed minimum are verified bit by bit.
    """
    fps = np.unique(fps.view(np.uint64))
    links, group = [], np.arange(len(fps))
    for at in range(0, len(fps), 256):
        a, b = np.nonzero(tally(fps[at : at + 256], fps[at:]) >= 8 - DISTANCE)
        a, b = a[a < b] + at, b[a < b] + at
        near = np.bitwise_count(fps[a] ^ fps[b]) <= DISTANCE
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            ri, rj = i, j
            while group[ri] != ri:
                group[ri] = group[group[ri]]
                ri = group[ri]
            while group[rj] != rj:
                group[rj] = group[group[rj]]
                rj = group[rj]
            if ri != rj:
                group[max(ri, rj)] = min(ri, rj)
                links.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
    return links


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect what all links connect, among distinct fingerprints ``fps``."""
    blocks = in_blocks(posting_lists(fps))
    keys = ["list", "part", "low", "high"]
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held, of = [], None

        def found():
            own = spanning_links(np.concatenate(held)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            fp = batch.column(5).to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            many = []
            for keys_of, part in zip(key[np.concatenate([[0], cuts])].tolist(), np.split(fp, cuts), strict=True):
                if keys_of != of and held:
                    many.append(found())
                    held = []
                of = keys_of
                held.append(part)
            yield from (m for m in many if m.num_rows)
        if held:
            yield found()

    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def local_components(edges: np.ndarray) -> np.ndarray:
    """(node, root) of every node of the edges (two columns): the smallest node of its component."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        # Both ends' roots go to the smaller of the two, then every node to its root's root.
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            return np.stack([nodes, nodes[root]], axis=1)
        root = after


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): the smallest node of its component.

    Large-star and small-star steps: every node points its larger neighbours at its smallest one, then its smaller
    neighbours and itself at the smallest of them; the links shrink to stars in a number of rounds that grows
    with the logarithm of the component's size.  Each round is written to the shared folder.  As soon as no more than
    LOCAL_LINKS links are left, of 16 bytes each, one task ends the work.  ``rows``: about how many links there are.
    """
    pairs = written(edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct(), name, rows)

    def solve(batches):
        held = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1) for batch in batches]
        found = local_components(np.concatenate([np.zeros((0, 2), np.int64), *held]))
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["node", "root"])

    while (n := pairs.count()) > LOCAL_LINKS:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, name, n)
        if after.count() == n and not after.exceptAll(pairs).take(1):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        pairs = after
    return written(pairs.repartition(1).mapInArrow(solve, "node bigint, root bigint"), name)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    rows = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    n = rows.count()
    entries = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(entries.select("fp")), rows=n)
    named = entries.join(roots, entries["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "entries", n)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(named.join(smallest, "root").select("fp", "component_id"), "classes", n)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
