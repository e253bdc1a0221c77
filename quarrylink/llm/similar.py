"""The pipeline's form of ``simhash``: the Jaccard similarity of the sets of five-word shingles is 0.8 or more.

First comes SimHash, over five-word shingles: fingerprints, their index of positional bytes, the tally of shared bytes
and the check of the bits are those of ``simhash``.  What it links is verified on the whole sets and makes the first
groups.  It cannot find all such pairs: at a similarity of 0.8 about 15 % of a fingerprint's bits differ, ten of 64,
so that no number of shared bytes is guaranteed.  An exact check follows for the sets that SimHash left in different
groups.

Words are those of ``simhash`` (split at white space, ASCII letters in lower case); a text of fewer than five words is
one shingle.  In the check, prefix filtering finds every pair: two sets of this similarity share one of their first
n - ceil(0.8 n) + 1 shingles in any order that is the same for all texts.  Shingles that are frequent in a sample come
last, which keeps the lists short; the sample decides the order alone and loses no pair.  Lists whose sets are in one group are left out.
Lists of up to LIST_ROWS sets give all their pairs of different groups.  Longer ones first pair each set with the smallest, and then, in blocks, all sets that are
not yet in one group.  Pairs that the sizes, the places in the order or the parities of the sets rule out are not looked at; all
others are verified on their whole sets, pair by pair in the join, so that no task gathers a list of sets.
Shingles and sets are told apart by 64-bit hashes.

Defined results: null, empty and blank texts are similar to each other only; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylink.llm import simhash
from quarrylink.llm.common import in_small_batches, map_batches, parts, release, written
from quarrylink.llm.simhash import components

SHINGLE = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
LIST_ROWS = 50
PARITY_BITS, BUCKETS = 2048, 1 << 22
#: Sets of over LONG_SET members have wide parities too.
LONG_SET, WIDE_BITS = 1000, 32_768
#: Sets of one block, and rows and pairs of them that are compared at a time.
BLOCK_ROWS, PAIR_ROWS, PAIRS_AT_ONCE = 1000, 256, 20_000
SAMPLE_ROWS, SAMPLE_LEAST, MOST_FREQUENT = 8192, 4, 1 << 17
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of the text's shingles, distinct and ascending."""
    words = text.encode().lower().split() if text else []
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SHINGLE)], np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    x = sum((of[k : k + n] * FACTORS[k] for k in range(1, SHINGLE)), of[:n] * FACTORS[0])
    x = (x ^ (x >> np.uint64(31))) * FACTORS[1]
    return np.unique(x ^ (x >> np.uint64(29)))


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles, rarest first, that a similar set must share one of."""
    at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
    count = np.where(frequent[at] == hashes, counts[at], 0) if len(frequent) else np.zeros(len(hashes), np.int64)
    n = len(hashes)
    return hashes[np.lexsort((hashes, count))][: n - -(-OVER * n // UNDER) + 1]


def parity(hashes: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """``bits`` bits, each 1 if an odd number of hashes falls on it: two sets differ in at least as many members as bits."""
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1).view(np.int64)


def few_bits_differ() -> Column:
    """Whether the parities allow the similarity."""
    # Written out, this is compiled code; a loop over arrays is not.
    differ = sum((F.bit_count(F.get("p_parity", F.lit(i)).bitwiseXOR(F.get("q_parity", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return differ * (OVER + UNDER) <= (F.col("p_n") + F.col("q_n")) * (2 * UNDER - OVER - UNDER)


def few_wide_bits_differ() -> Column:
    """The same for the wide parities of long sets; others, which have none, pass."""
    differ = F.aggregate(F.zip_with("p_wide", "q_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (F.size("p_wide") != F.size("q_wide")) | (F.size("p_wide") == 0) | (differ * (OVER + UNDER) <= (F.col("p_n") + F.col("q_n")) * (2 * UNDER - OVER - UNDER))


def sets_similar() -> Column:
    both = F.size(F.array_intersect("p_hashes", "q_hashes"))
    return both * UNDER >= (F.size("p_hashes") + F.size("q_hashes") - both) * OVER


def fingerprint_pairs(rows: DataFrame, n: int) -> DataFrame:
    """a < b: the sets that SimHash links.

    Each set of a fingerprint is paired with its smallest one, and of two fingerprints at ``simhash.DISTANCE`` or
    fewer differing bits the smallest sets; links that others imply are left out.
    """
    sets = written(rows.select("fp", "sig").distinct(), "fingerprints", n)
    least = written(sets.groupBy("fp").agg(F.min("sig").alias("least")), "fingerprints", n)
    equal = sets.join(least, "fp").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    of = lambda key, name: least.select(F.col("fp").alias(key), F.col("least").alias(name))
    near = simhash.links(least.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near).where("a < b").distinct()


def frequent_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of what is frequent in a sample."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    found = map_batches(texts.where(F.rand(42) < share).select("text"), lambda: lambda rows: {"h": [shingles(x).view(np.int64) for x in rows["text"]]}, "h array<bigint>")
    top = found.select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= SAMPLE_LEAST).orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()
    hashes = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r[1] for r in top], np.int64)[order]


def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (list, sig, ...) sorted by these, each list's sets once, without lists of one set.  One row is held back."""
    last, last_goes = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        of, sig = (batch.column(i).to_numpy() for i in (0, 1))
        same = of[1:] == of[:-1]
        new = np.concatenate([[True], ~same | (sig[1:] != sig[:-1])])
        # Of a set that repeats in a list the first row stands, wherever its list's next set begins.
        batch, of = batch.filter(pa.array(new)), of[new]
        same = of[1:] == of[:-1]
        goes = np.concatenate([[last_goes], same]) | np.concatenate([same, [False]])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(goes[:-1]))
        last, last_goes = batch.slice(batch.num_rows - 1), bool(goes[-1])
    if last is not None:
        yield last.filter(pa.array([last_goes]))


def may_be_similar(a: str, b: str) -> Column:
    """Whether sizes and places allow the similarity when a pair's first shared shingle is at these places."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return most * (OVER + UNDER) >= (n + m) * OVER


def pairs_of(left: DataFrame, right: DataFrame, wanted: Column) -> DataFrame:
    """a < b: the sets that meet in a list."""
    met = left.alias("x").join(right.alias("y"), "list").where(wanted & may_be_similar("x", "y"))
    return met.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def each_pair(pairs: DataFrame, sets: DataFrame, columns: list[str], holds: Column) -> DataFrame:
    """The pairs for which ``holds`` is true of what ``sets`` has of their two sets (p_ and q_)."""
    side = lambda key, mark: sets.select(F.col("sig").alias(key), *[F.col(c).alias(mark + c) for c in columns])
    return pairs.join(side("a", "p_"), "a").join(side("b", "q_"), "b").where(holds).select("a", "b")


def parities(rows: DataFrame) -> DataFrame:
    """sig, n, parity of each set."""
    return rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))


def block_pairs(of: DataFrame, rows: DataFrame) -> DataFrame:
    """a < b: the sets of different groups that meet in a list and that sizes, places and parities allow.

    Long lists are dealt out in pairs of blocks of about BLOCK_ROWS sets, which tasks compare as arrays: only what
    passes becomes a row.
    """
    sizes = of.groupBy("list").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")).where("low < high").select("list", "blocks")
    entries = of.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks"))).join(parities(rows).select("sig", "parity"), "sig")
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "own").alias("low"), F.greatest(b, "own").alias("high")))
    dealt = entries.select("list", F.explode(pair).alias("p"), "own", "sig", "n", "pos", "group", "parity").select("list", "p.low", "p.high", "own", "sig", "n", "pos", "group", "parity")
    dealt = dealt.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")

    def compare(table: pa.Table) -> pa.RecordBatch:
        low, high, own, sig, n, pos, group = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "own", "sig", "n", "pos", "group"))
        bits = table.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sig), -1)
        found = []
        for at in range(0, len(sig), PAIR_ROWS):
            part = slice(at, at + PAIR_ROWS)
            ok = (sig[part, None] < sig[None]) & (group[part, None] != group[None]) & ((low[0] == high[0]) | (own[part, None] != own[None]))
            total = n[part, None] + n[None]
            ok &= np.minimum((n - pos)[part, None], (n - pos)[None]) * (OVER + UNDER) >= total * OVER
            i, j = np.nonzero(ok)
            for some in range(0, len(i), PAIRS_AT_ONCE):
                x, y = i[some : some + PAIRS_AT_ONCE] + at, j[some : some + PAIRS_AT_ONCE]
                near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) * (OVER + UNDER) <= (n[x] + n[y]) * (2 * UNDER - OVER - UNDER)
                found.append(np.stack([sig[x[near]], sig[y[near]]]))
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, of_key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]]).tolist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if of_key != (now := key[s].tolist()) and held:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                of_key = now
                held.append(batch.slice(s, e - s))
        if held:
            yield compare(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs whose whole sets are similar, of pairs that their parities allow; ``n`` is the number of texts.

    Long sets are made again with wide parities first, which rule out most that are not similar.
    """
    pairs = written(pairs, "pairs", n)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(rows.groupBy("sig").agg(F.min("key").alias("key")), "sig").select("sig", "key")
    asked = written(asked, "asked", n)
    # Texts are read where they are; the table of buckets, of fixed size, lets through what is asked for and a few others.
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    held = np.zeros(BUCKETS, bool)
    held[asked.select(bucket.alias("bucket")).distinct().toPandas()["bucket"].to_numpy(np.int64)] = True
    bits = np.packbits(held)

    def make(batches):
        for batch in batches:
            at = batch.column(1).to_numpy()
            for part in parts(batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))):
                made = [shingles(x) for x in part.column(2).to_pylist()]
                wide = [parity(x, WIDE_BITS).view(np.int64) if len(x) > LONG_SET else np.zeros(0, np.int64) for x in made]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in made], pa.int32()), pa.array(wide, kind), pa.array([x.view(np.int64) for x in made], kind)], names=["key", "n", "wide", "hashes"])
        release()

    kind = dict(texts.dtypes)["key"]
    sets = in_small_batches(texts.select("key", bucket.alias("bucket"), F.col("text").cast("string"))).mapInArrow(make, f"key {kind}, n int, wide array<bigint>, hashes array<bigint>")
    # Rows of equal texts have equal sets, of which one is kept.
    sets = written(asked.join(sets, "key").dropDuplicates(["key"]).select("sig", "n", "wide", "hashes"), "sets", n)
    pairs = written(each_pair(pairs, sets, ["n", "wide"], few_wide_bits_differ()), "pairs", n)
    return each_pair(pairs, sets, ["hashes"], sets_similar())


def groups(texts: DataFrame) -> DataFrame:
    """key, root for each key of ``texts`` (key: a hash of the text, text)."""
    n = texts.count()
    frequent, counts = frequent_shingles(texts, n)

    def make():
        def work(rows):
            sets = [shingles(x) for x in rows["text"]]
            return {"key": rows["key"], "sig": [set_id(x) for x in sets], "n": [len(x) for x in sets], "fp": [simhash.fingerprint(x, SHINGLE) for x in rows["text"]], "prefix": [prefix(x, frequent, counts).view(np.int64) for x in sets], "parity": [parity(x) for x in sets]}

        return work

    kind = dict(texts.dtypes)["key"]
    rows = written(map_batches(texts.select("key", "text"), make, f"key {kind}, sig bigint, n int, fp bigint, prefix array<bigint>, parity array<bigint>"), "prefixes")
    checked = lambda pairs: verified(each_pair(pairs, parities(rows), ["n", "parity"], few_bits_differ()), rows, texts, n)
    links = written(checked(fingerprint_pairs(rows, n)), "links", n)
    roots = components(links, rows=n)

    posts = rows.select("sig", "n", F.posexplode("prefix").alias("pos", "list")).select("list", "sig", "n", "pos")
    lists = written(posts.repartition("list").sortWithinPartitions("list", "sig").mapInArrow(shared, posts.schema), "posts", n)
    lists = grouped(lists, roots)
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.min("sig").alias("least"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    lists = written(lists.join(sizes.drop("low", "high"), "list"), "lists", n)

    short, long = lists.where(F.col("size") <= LIST_ROWS), lists.where(F.col("size") > LIST_ROWS)
    apart = F.col("x.group") != F.col("y.group")
    first = pairs_of(short, short, apart & (F.col("x.sig") < F.col("y.sig")))
    if has_long := bool(long.take(1)):
        first = first.unionByName(pairs_of(long, long.where("sig = least"), apart)).distinct()
    links = written(links.unionByName(checked(first)), "links", n)
    roots = components(links, rows=n)
    if has_long:
        rest = written(block_pairs(grouped(long.drop("group"), roots), rows), "pairs", n)
        if rest.take(1):
            roots = components(links.unionByName(verified(rest, rows, texts, n)), rows=n)
    return rows.select("key", "sig").distinct().join(roots, F.col("sig") == F.col("node"), "left").select("key", F.coalesce("root", "sig").alias("root"))


def grouped(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists' sets with their groups so far."""
    return lists.join(roots, lists["sig"] == roots["node"], "left").select("list", "sig", "n", "pos", F.coalesce("root", "sig").alias("group"))
