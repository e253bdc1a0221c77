"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits a sample by the hyperplane half-way between two random members, at the median of the projections,
until LEAF_ROWS or fewer are left.  The forest is fitted on a bounded sample (SAMPLE_ROWS distinct vectors, those
with the smallest xxhash64) and every vector is put into one leaf of each tree.  A query walks all trees through
one priority queue, nearest hyperplane first, until it has reached SEARCH_SHARE of the forest's leaves (LEAST_LEAVES
at least).  In every leaf reached the queries are ranked exactly, by cosine in double precision on the original
vectors, against all rows there; the best of all leaves are merged.

Equal vectors are one entry with their K + 1 smallest ids: ties go to smaller ids, so a query can never need more
of them.  Leaves of over BLOCK_ROWS entries are dealt out in blocks, each of which gets the leaf's queries.

Result: query_id, rank, vec_id, score.  Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows with a null id or with another length than the most common one (ties:
the smaller length); repeated rows count once; rows that repeat an id with other vectors are all candidates, and
their queries' results are merged under that id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylink.llm.common import written

K = 5
TREES = 8
LEAF_ROWS = 128
SAMPLE_ROWS = 65_536
SEARCH_SCALE, SEARCH_POWER = 0.41, 0.8
BLOCK_ROWS = 4000
QUERY_EVERY = 50
CLOSE = 1e-9
#: Components between which squares and their sums neither vanish nor overflow.
TINY, HUGE = 1e-140, 1e140
#: Queries whose best a task holds before it hands them on.
QUERIES_HELD = 100_000


@dataclass
class Forest:
    """Nodes of all trees: hyperplane, threshold, two children; a child below 0 is the leaf ~child."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.cuts[node]
                at[inner] = self.children[node, right.astype(int)]
            out[:, t] = ~at
        return out

    def search(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that one queue over all trees reaches."""
        offset = (self.planes @ q - self.cuts).tolist() if len(self.planes) else []
        queue, found = [(0.0, t, root) for t, root in enumerate(self.roots)], []
        heapq.heapify(queue)
        while queue and len(found) < leaves:
            margin, t, at = heapq.heappop(queue)
            while at >= 0:
                d = offset[at]
                left, right = self.children[at]
                heapq.heappush(queue, (max(margin, abs(d)), t, int(left if d > 0 else right)))
                at = int(right if d > 0 else left)
            found.append(~at)
        return found


def fit(sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    planes, cuts, children, leaves = [], [], [], 0
    rows_of = unit(sample)

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        plane = None
        if len(rows) > leaf_rows:
            a, b = rows_of[rng.choice(rows, 2, replace=False)]
            length = float(np.linalg.norm(a - b))
            plane = (a - b) / length if length else None
        if plane is not None:
            along = rows_of[rows] @ plane
            cut = float(np.median(along))
            right = along > cut
        if plane is None or not right.any() or right.all():
            leaves += 1
            return ~(leaves - 1)
        me = len(planes)
        planes.append(plane)
        cuts.append(cut)
        children.append(None)
        children[me] = (grow(rows[~right]), grow(rows[right]))
        return me

    roots = [grow(np.arange(len(rows_of))) for _ in range(trees)]
    width = sample.shape[1]
    return Forest(np.array(planes).reshape(-1, width), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), roots, leaves)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: no rounding, no overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows; where squares leave the range of doubles, of the rows divided by their largest component."""
    size = np.abs(np.concatenate([a, b], axis=1))
    odd = (size.max(axis=1, initial=0) > HUGE) | (size.min(axis=1, initial=np.inf, where=size > 0) < TINY)
    if odd.any():
        a, b = (np.where(odd[:, None], scaled(x), x) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def best_in_block(query_ids, queries: np.ndarray, ids: list[list[int]], rows: np.ndarray, k: int = K) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's k nearest ids in one block."""
    if not len(queries) or not len(rows):
        return []
    units = unit(rows)
    out = []
    for at in range(0, len(queries), 512):
        part = queries[at : at + 512]
        rough = unit(part) @ units.T
        # One more than k: the query itself may be one entry.
        least = np.partition(rough, len(rows) - min(k + 1, len(rows)), axis=1)[:, len(rows) - min(k + 1, len(rows))]
        qi, ri = np.nonzero(rough >= least[:, None] - CLOSE)
        scores = exact_cosine(part[qi], rows[ri])
        near: dict[int, list[tuple[float, int]]] = {}
        for q, r, s in zip(qi.tolist(), ri.tolist(), scores.tolist(), strict=True):
            own = query_ids[at + q]
            near.setdefault(q, []).extend((-s, i) for i in ids[r] if i != own)
        out += [(query_ids[at + q], i, -s) for q, found in near.items() for s, i in heapq.nsmallest(k, set(found))]
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part, each once."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite).where(F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("vec") == (width["w"] if width else 0)).distinct()


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, search_scale: float = SEARCH_SCALE, search_power: float = SEARCH_POWER) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``query_every``."""
    spark = df.sparkSession
    rows = written(usable(df, id_col, vec_col), "vectors")
    order = Window.partitionBy("vec").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.collect_list("vec_id").alias("ids"))
    entries = written(entries, "entries")
    picked = entries.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(sample_rows).select("vec").toPandas()["vec"]
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not len(picked):
        return empty
    sample = np.stack(picked.to_numpy()).astype(np.float64)
    width = sample.shape[1]
    fitted = fit(sample, trees, leaf_rows)
    packed = spark.sparkContext.broadcast((fitted.planes, fitted.cuts, fitted.children, fitted.roots, fitted.leaves))
    leaves = max(trees, math.ceil(search_scale * fitted.leaves**search_power))

    def put(batches):
        forest = Forest(*packed.value)
        for batch in batches:
            if batch.num_rows:
                leaf = forest.leaf_of(unit(vectors_of(batch.column(0), width))).ravel()
                at = pa.array(np.repeat(np.arange(batch.num_rows), len(forest.roots)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "vec", "ids"])

    def ask(batches):
        forest = Forest(*packed.value)
        for batch in batches:
            found = [forest.search(q, leaves) for q in unit(vectors_of(batch.column(1), width))] if batch.num_rows else []
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([y for x in found for y in x], pa.int64()), batch.column(1).take(at), batch.column(0).take(at)], names=["leaf", "vec", "query_id"])

    index = written(entries.select("vec", "ids").mapInArrow(put, "leaf bigint, vec array<double>, ids array<bigint>"), "index")
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    asked = rows.where(F.col("vec_id") % query_every == 0).mapInArrow(ask, "leaf bigint, vec array<double>, query_id bigint").join(sizes, "leaf")
    asked = asked.select("leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "query_id", "vec", F.lit(None).cast("array<bigint>").alias("ids"))
    held = index.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("vec"), F.col("blocks")).alias("block"), F.lit(None).cast("bigint").alias("query_id"), "vec", "ids")
    dealt = held.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block")

    def rank(batches):
        group, of, best = [], None, {}

        def take():
            """Ranks one block and merges it into what the task knows of its queries."""
            whole = pa.Table.from_batches(group)
            is_query = whole.column("query_id").is_valid().to_numpy()
            vectors = vectors_of(whole.column("vec").combine_chunks(), width)
            query_ids = whole.column("query_id").filter(pa.array(is_query)).to_pylist()
            ids = whole.column("ids").filter(pa.array(~is_query)).to_pylist()
            for q, i, s in best_in_block(query_ids, vectors[is_query], ids, vectors[~is_query], k):
                near = best.setdefault(q, {})
                near[i] = max(s, near.get(i, s))
                if len(near) > 4 * k:
                    best[q] = dict(heapq.nsmallest(k, near.items(), key=lambda x: (-x[1], x[0])))

        def told():
            rows = [(q, i, s) for q, near in best.items() for i, s in heapq.nsmallest(k, near.items(), key=lambda x: (-x[1], x[0]))]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if of != (now := tuple(keys[a].tolist())) and group:
                    take()
                    group = []
                    if len(best) > QUERIES_HELD:
                        yield told()
                of = now
                group.append(batch.slice(a, b - a))
        if group:
            take()
        yield told()

    found = dealt.mapInArrow(rank, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY) -> dict[int, list[int]]:
    """Exact answers on the driver; for tests and measuring recall on tables that fit there."""
    rows = usable(df, id_col, vec_col).orderBy("vec_id").toPandas()
    vectors = np.stack(rows["vec"].to_numpy())
    out = {}
    for at in np.flatnonzero(rows["vec_id"].to_numpy() % query_every == 0):
        scores = exact_cosine(np.broadcast_to(vectors[at], vectors.shape), vectors)
        scores[at] = -np.inf
        out[int(rows["vec_id"][at])] = [int(rows["vec_id"][i]) for i in np.lexsort((rows["vec_id"], -scores))[: min(k, len(rows) - 1)]]
    return out
