"""Similarity joins over posting tables, top-k, multi-view union.

A join sums, for each pair, the products of the weights of its common terms.  What a term costs is the product of its
two posting lists, which bytes do not tell: a few MB of postings may give billions of products.  So no product becomes
a row.  Both sides are dealt out in blocks by their ids; each block of queries meets each block of the corpus in one
task, which adds up a query's scores in one array over the block's documents and hands on only the pairs that reach
the threshold or, with ``k``, each query's best k of the block.  What is shuffled are the postings, once for each block
of the other side, and what is left; no pair is lost.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylink.sources.scratch import written

#: Documents and postings of one side that meet in one task, and products that a task is planned for.
CELL, CELL_POSTINGS, PAIRS_A_TASK = 65_536, 1_000_000, 500_000_000
#: Pairs handed on at a time.
PAIRS_A_BATCH = 100_000
#: Scores are compared to this many digits.
DIGITS = 9
RRF_BASE = 60
MISSING_RANK = 999
UNKNOWN = "UNKNOWN"


def scores(queries: DataFrame, corpus: DataFrame, threshold: float = 0.0, on: tuple[str, ...] = (), strict: bool = False, k: int | None = None, best_of: str = "query_id") -> DataFrame:
    """query_id, candidate_id, score of the pairs that share a term and reach the threshold.

    With ``on``, pairs must agree in these columns; missing values are one bucket of their own, UNKNOWN.  With ``k``,
    pairs that are not among the best k of their query (or candidate, see ``best_of``) may be left out: the caller ranks.
    """
    if best_of == "candidate_id":
        return scores(corpus, queries, threshold, on, strict, k).select(F.col("candidate_id").alias("query_id"), F.col("query_id").alias("candidate_id"), "score")
    pairs = summed([(queries, corpus, 1.0)], threshold, on, strict or not threshold, k)
    return pairs if strict or not threshold else pairs.where(F.round("score", DIGITS) >= threshold)


def combined_scores(name: tuple[DataFrame, DataFrame], address: tuple[DataFrame, DataFrame], threshold: float, k: int, name_weight: float = 0.6) -> DataFrame:
    """``combined`` of two views (postings of queries and corpus), each strictly above the threshold: the best k of each query are among the pairs."""
    return summed([(*name, name_weight), (*address, 1 - name_weight)], threshold, (), True, k)


def summed(views: list[tuple[DataFrame, DataFrame, float]], threshold: float, on: tuple[str, ...], strict: bool, k: int | None) -> DataFrame:
    """query_id, candidate_id, score: the weighted sum of the views (queries, corpus, share) in which a pair passes."""
    spark = views[0][0].sparkSession
    bucket = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in on]
    # A bucket's length goes before it, so that no bucket and term can read like others.
    term = F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in bucket], F.col("term").cast("string"))
    rows = lambda df, name: written(df.select("id", term.alias("term"), F.col("weight").cast("double").alias("weight")).where("term IS NOT NULL AND weight IS NOT NULL"), name)
    sides = [[rows(view[side], name) for view in views] for side, name in enumerate(("asked", "held"))]
    blocks_q, blocks_c = planned(*sides)
    query_type, candidate_type = dict(sides[0][0].dtypes)["id"], dict(sides[1][0].dtypes)["id"]

    def documents(of: list[DataFrame], own: int) -> DataFrame:
        """id, block and, of each view, the terms and weights of a document."""
        union = None
        for v, df in enumerate(of):
            part = df.select("id", F.lit(v).alias("v"), F.struct("term", "weight").alias("p"))
            union = part if union is None else union.unionByName(part)
        lists = union.groupBy("id").agg(*[F.collect_list(F.when(F.col("v") == v, F.col("p"))).alias(f"p{v}") for v in range(len(of))])
        parts = [F.col(f"p{v}.{c}").alias(f"{c}{v}") for v in range(len(of)) for c in ("term", "weight")]
        return lists.select("id", F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias("block"), *parts)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    q = documents(sides[0], blocks_q).select("*", every(blocks_c))
    c = documents(sides[1], blocks_c).select("*", every(blocks_q))
    parts = [x for x in q.columns if x not in ("id", "block", "other")]
    q = q.select((F.col("block") * blocks_c + F.col("other")).alias("cell"), F.lit(0).alias("side"), F.col("id").alias("q"), F.lit(None).cast(candidate_type).alias("c"), *parts)
    c = c.select((F.col("other") * blocks_c + F.col("block")).alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(query_type).alias("q"), F.col("id").alias("c"), *parts)
    dealt = q.unionByName(c).repartitionById(blocks_q * blocks_c, F.col("cell")).sortWithinPartitions("cell", "side", "q", "c")
    shares = [view[2] for view in views]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            yield from block_scores(table, shares, threshold, strict, k)

    return dealt.mapInArrow(run, f"query_id {query_type}, candidate_id {candidate_type}, score double")


def planned(asked: list[DataFrame], held: list[DataFrame]) -> tuple[int, int]:
    """Blocks of the two sides: tasks of bounded work and memory, and as few copies of the postings as they allow."""
    products = 0
    for q, c in zip(asked, held, strict=True):
        count = lambda df, name: df.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias(name))
        products += count(q, "nq").join(count(c, "nc"), "term").agg(F.sum(F.col("nq") * F.col("nc"))).first()[0] or 0
    sizes = []
    for side in (asked, held):
        found = [df.agg(F.count(F.lit(1)), F.approx_count_distinct("id")).first() for df in side]
        sizes.append((max(1, sum(n for n, _ in found)), max(1, max(ids for _, ids in found))))
    (postings_q, rows_q), (postings_c, rows_c) = sizes
    tasks = max(2 * asked[0].sparkSession.sparkContext.defaultParallelism, int(products / PAIRS_A_TASK) + 1)
    least = lambda postings, rows: max(-(-rows // CELL), -(-postings // CELL_POSTINGS))
    blocks_q = max(least(postings_q, rows_q), round((tasks * postings_q / postings_c) ** 0.5), 1)
    return blocks_q, max(least(postings_c, rows_c), -(-tasks // blocks_q))


def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches sorted by it."""
    held, of = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and cell[begin] != of:
                yield pa.Table.from_batches(held)
                held = []
            of = cell[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def lists_of(table: pa.Table, v: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, weights and the document's number of each posting of a view."""
    terms, weights = (table.column(f"{c}{v}").combine_chunks() for c in ("term", "weight"))
    lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return terms.flatten(), weights.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(table.num_rows), lengths)


def block_scores(table: pa.Table, shares: list[float], threshold: float, strict: bool, k: int | None) -> Iterator[pa.RecordBatch]:
    """The passing pairs of one block of queries (side 0) with one of the corpus (side 1), both in the order of their ids."""
    n_q = int(np.count_nonzero(table.column("side").to_numpy() == 0))
    asked, held = table.slice(0, n_q), table.slice(n_q)
    if not n_q or not held.num_rows:
        return
    query_ids, candidate_ids = asked.column("q").combine_chunks(), held.column("c").combine_chunks()
    views = []
    for v in range(len(shares)):
        (terms_q, weights_q, of_q), (terms_c, weights_c, of_c) = lists_of(asked, v), lists_of(held, v)
        codes = pa.concat_arrays([terms_q, terms_c]).dictionary_encode()
        n_terms, codes = len(codes.dictionary), codes.indices.to_numpy()
        codes_q, codes_c = codes[: len(of_q)], codes[len(of_q) :]
        order = np.argsort(codes_c, kind="stable")
        codes_c, of_c, weights_c = codes_c[order], of_c[order], weights_c[order]
        if len(of_c):
            # A term that a document has several times is one posting, of the sum.
            first = np.flatnonzero(np.concatenate([[True], (codes_c[1:] != codes_c[:-1]) | (of_c[1:] != of_c[:-1])]))
            codes_c, of_c, weights_c = codes_c[first], of_c[first], np.add.reduceat(weights_c, first)
        ends = np.cumsum(np.bincount(codes_c, minlength=n_terms))
        begins = np.concatenate([[0], ends[:-1]]) if n_terms else ends
        # Where all products are positive, a pair shares a term if its score is.
        positive = bool((weights_q > 0).all() and (weights_c > 0).all())
        at = np.searchsorted(of_q, np.arange(n_q + 1)).tolist()
        views.append((begins[codes_q].tolist(), ends[codes_q].tolist(), weights_q.tolist(), at, of_c, weights_c, positive))

    def batch(rows: list[int], found: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        of = np.repeat(rows, [len(x) for x in found])
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(of)), candidate_ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(values))], names=["query_id", "candidate_id", "score"])

    score, met = np.zeros(held.num_rows), np.zeros(held.num_rows, bool)
    rows, found, values, n = [], [], [], 0
    for i in range(n_q):
        total = None
        for (begins, ends, weights, at, docs, of_doc, positive), share in zip(views, shares, strict=True):
            score.fill(0)
            tell = threshold < 0 and not positive
            if tell:
                met.fill(False)
            for t in range(at[i], at[i + 1]):
                b, e = begins[t], ends[t]
                if b < e:
                    score[docs[b:e]] += of_doc[b:e] * weights[t]
                    if tell:
                        met[docs[b:e]] = True
            if threshold < 0:
                passes = met if tell else score > 0
                passes = passes & (score > threshold) if strict else passes
            else:
                # Rounding may lift a score to the threshold; the caller rounds.
                passes = score > threshold if strict else score >= threshold - 10.0**-DIGITS
            if len(views) == 1:
                total = score
            else:
                part = np.where(passes, score * share, 0.0)
                total, any_of = (part, passes) if total is None else (total + part, any_of | passes)
        j = np.flatnonzero(passes if len(views) == 1 else any_of)
        value = total[j]
        if k is not None and len(j) > k:
            rounded = np.round(value, DIGITS)
            kth = np.partition(rounded, len(j) - k)[len(j) - k]
            above, equal = np.flatnonzero(rounded > kth), np.flatnonzero(rounded == kth)
            best = np.concatenate([above, equal[: k - len(above)]])
            j, value = j[best], value[best]
        if len(j):
            rows.append(i)
            found.append(j)
            values.append(value)
            n += len(j)
            if n >= PAIRS_A_BATCH:
                yield batch(rows, found, values)
                rows, found, values, n = [], [], [], 0
    if n:
        yield batch(rows, found, values)


def ranked(pairs: DataFrame, by: str = "query_id", other: str = "candidate_id", score: str = "score", rank: str = "rank") -> DataFrame:
    return pairs.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), other)))


def top_k(pairs: DataFrame, k: int, by: str = "query_id", other: str = "candidate_id", score: str = "score") -> DataFrame:
    return ranked(pairs, by, other, score).where(F.col("rank") <= k)


def combined(name_pairs: DataFrame, address_pairs: DataFrame, name_weight: float = 0.6) -> DataFrame:
    """Weighted sum of two views; a pair found in either counts."""
    both = name_pairs.select("query_id", "candidate_id", (F.col("score") * name_weight).alias("score")).unionByName(address_pairs.select("query_id", "candidate_id", (F.col("score") * (1 - name_weight)).alias("score")))
    return both.groupBy("query_id", "candidate_id").agg(F.sum("score").alias("score"))


def reverse_top_k(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Each candidate's k best queries."""
    return top_k(pairs, k, "candidate_id", "query_id")


def rrf(views: dict[str, DataFrame]) -> DataFrame:
    """Union of ranked views: reciprocal-rank score, each view's rank (999 where missing), best, mean and number of views."""
    union = None
    for name, view in views.items():
        part = view.select("query_id", "candidate_id", F.lit(name).alias("view"), "rank")
        union = part if union is None else union.unionByName(part)
    ranks = [F.coalesce(F.min(F.when(F.col("view") == name, F.col("rank"))), F.lit(MISSING_RANK)).alias(f"{name}_rank") for name in views]
    best = [F.sum(1 / (RRF_BASE + F.col("rank"))).alias("rrf_score"), *ranks, F.min("rank").alias("best_rank"), F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("agreement")]
    return ranked(union.groupBy("query_id", "candidate_id").agg(*best), score="rrf_score", rank="rrf_rank")


def candidate_lists(pairs: DataFrame) -> DataFrame:
    """query_id, candidate_ids, scores in rank order."""
    rows = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("r"))
    return rows.select("query_id", F.col("r.candidate_id").alias("candidate_ids"), F.col("r.score").alias("scores"))
