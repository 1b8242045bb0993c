"""Approximate nearest neighbours by vantage-point trees in shards.

Vectors are normalised and dealt in shards of bounded size; each shard is a vantage-point tree over chord distances (a
monotone function of the cosine). Queries descend all trees in blocks: a subtree is skipped if the triangle
inequality, relaxed by ``factor``, shows that it can't hold a nearer vector: |d(q, p) - median| * factor > d_k. A factor of one skips
only what is certain (the result is exact); a larger one skips more. Every shard returns its best of each query, and the best of
those are the result. Distances only prune, with a margin beyond their rounding; what is kept is chosen by the cosine in double precision from the original vectors, so near
ties and proportional vectors are told apart as that measure does.

A vector goes to one shard of about ``SHARD`` vectors, by hash, and each shard's tree is built once: its partition reads the shard's
vectors first, then the queries as a stream, so a task's memory is bounded by a shard and a batch. A query is sent to every shard, so
with a fixed share of queries the work is their number times that of the shards; only pruning inside the trees saves any (little, where vectors are
close to random). The queries are a stated set, not all pairs.

An id is the set of its vectors: rows that repeat both are one, and the nearness of two ids whose rows differ is that of their nearest vectors, so a
query lists an id once. Rows that share an id are found by their counts and only those are made distinct.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as queries nor
as candidates, and neither do rows with a null id; a query meets only vectors of its own length; equal vectors under other ids are ordinary candidates, ties
go to the smaller id, a row's own id is never its neighbour; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SHARD, LEAF = 16_384, 128
FACTOR = 1.25


#: More than the rounding of a product of unit vectors, and of the chord that it gives.
DOT, CHORD = 1e-9, 1e-7
PAIRS = 1 << 16


class Tree:
    """A vantage-point tree over vectors; leaves are blocks of rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.x, self.u, self.leaf = x, unit(x), leaf
        self.repeats = False
        self.rng = np.random.default_rng(seed)
        self.root = self.build(np.arange(len(x)))

    def build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pivot = rows[self.rng.integers(len(rows))]
        d = chord(self.u[rows] @ self.u[pivot])
        half = np.median(d)
        near = d <= half
        if near.all():  # ties: copies of one vector
            return rows
        return pivot, half, self.build(rows[near]), self.build(rows[~near])

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and rows of the k best of each query (rows of -1 where there are fewer), by the exact measure; ties by id."""
        best = np.full((len(q), k), -np.inf)
        where = np.full((len(q), k), -1)
        turned = unit(q)

        def merge(at: np.ndarray, cosines: np.ndarray, rows: np.ndarray) -> None:
            some, at = np.unique(at, return_inverse=True)
            n = np.concatenate([np.repeat(np.arange(len(some)), k), at])
            c, w = np.concatenate([best[some].ravel(), cosines]), np.concatenate([where[some].ravel(), rows])
            n, c, w = n[w >= 0], c[w >= 0], w[w >= 0]
            if self.repeats:  # an id counts once, by its nearest vector
                order = np.lexsort((-c, ids[w], n))
                order = order[np.concatenate([[True], (np.diff(n[order]) != 0) | (np.diff(ids[w[order]]) != 0)])]
                n, c, w = n[order], c[order], w[order]
            order = np.lexsort((ids[w], -c, n))
            n, c, w = n[order], c[order], w[order]
            rank = np.arange(len(n)) - np.searchsorted(n, n)
            top = rank < k
            best[some[n[top]], rank[top]], where[some[n[top]], rank[top]] = c[top], w[top]

        def leaf(rows: np.ndarray, some: np.ndarray) -> None:
            step = max(1, 4_000_000 // max(1, len(rows)))
            for lo in range(0, len(some), step):
                s = some[lo : lo + step]
                near = turned[s] @ self.u[rows].T
                near[own[s][:, None] == ids[rows][None, :]] = -np.inf
                least = best[s, k - 1]
                if not self.repeats and len(rows) > k:
                    least = np.maximum(least, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
                i, r = np.nonzero((near >= least[:, None] - DOT) & (near > -np.inf))
                for at in range(0, len(i), PAIRS):
                    part = slice(at, at + PAIRS)
                    merge(s[i[part]], cosine(q[s[i[part]]], self.x[rows[r[part]]]), rows[r[part]])

        def visit(node, some: np.ndarray) -> None:
            if not len(some):
                return
            if isinstance(node, np.ndarray):
                leaf(node, some)
                return
            pivot, half, near, far = node
            d = chord(turned[some] @ self.u[pivot])
            gap = np.abs(d - half) * factor
            inner = d <= half
            # the promising side first, so that the radius shrinks before the other is judged
            visit(near, some[inner])
            visit(far, some[~inner])
            need = gap <= chord(best[some, k - 1]) + CHORD
            visit(far, some[inner & need])
            visit(near, some[~inner & need])

        visit(self.root, np.arange(len(q)))
        return best, where


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.withColumn(vector, v).where(F.coalesce(finite, F.lit(False)))


class Shard:
    """A shard's vectors by length, each length with its tree."""

    def __init__(self, ids: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.trees = {}
        for dim, (at, x) in vectors.items():
            order = np.argsort(ids[at], kind="stable")
            tree = Tree(scaled(x)[order])
            named = ids[at][order]
            tree.repeats = bool((named[1:] == named[:-1]).any())
            self.trees[dim] = named, tree

    def answer(self, ids: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]], k: int, factor: float):
        """(query, neighbour, cosine) of each query's best here."""
        for dim, (at, q) in vectors.items():
            if dim in self.trees:
                named, tree = self.trees[dim]
                best, where = tree.search(scaled(q), ids[at], named, k, factor)
                i, r = np.nonzero(where >= 0)
                yield ids[at][i], named[where[i, r]], best[i, r]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two (which change no cosine), so that no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (rows, matrix)."""
    size = np.diff(lists.offsets.to_numpy())
    flat, start = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    return {int(n): (at, flat[start[at][:, None] + np.arange(n)]) for n in np.unique(size) for at in [np.flatnonzero(size == n)]}


def search(vectors: DataFrame, queries, k: int = 5, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, key, score: the k nearest found of each row that queries (a condition) picks."""
    rows = usable(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asked")), "v").where("id IS NOT NULL")
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if total["repeated"]:
        twice = counts.where("n > 1").select("id")
        rows = rows.join(twice, "id", "left_anti").unionByName(rows.join(twice, "id", "left_semi").distinct())
    shards = max(1, math.ceil(total["n"] / shard))
    place = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    stored = rows.select("id", "v", F.lit(False).alias("asks"), place.alias("shard"))
    asking = rows.where("asked").select("id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    names = ["query_id", "vec_id", "score"]

    def answers(batches):
        now, held, built = None, [], None
        for b in batches:
            shard_of, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard_of)], strict=True):
                if lo == hi:
                    continue
                if shard_of[lo] != now:
                    now, held, built = shard_of[lo], [], None
                part = b.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append(part)
                    continue
                if built is None and held:
                    every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    built, held = Shard(every.column("id").to_numpy(), by_length(every.column("v"))), []
                if built is not None:
                    for found in built.answer(part.column("id").to_numpy(), by_length(pa.concat_arrays([part.column("v")])), k, factor):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

    dealt = stored.unionByName(asking).repartition("shard").sortWithinPartitions("shard", "asks")
    best = dealt.mapInArrow(answers, "query_id long, vec_id long, score double")
    if total["repeated"]:
        best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, each sum in the order of the components."""
    total = lambda x, y: np.add.reduce(np.ascontiguousarray((x * y).T), axis=0)
    return total(a, b) / np.sqrt(total(a, a) * total(b, b))


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: All pairs of a query and a candidate of its length.
SQL = """
WITH u AS (SELECT DISTINCT vec_id::BIGINT AS id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c != 0)) > 0),
p AS (SELECT q.id AS query_id, c.id AS vec_id, max(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(q.v, lambda z: z * z)) * list_sum(list_transform(c.v, lambda z: z * z)))) AS score
  FROM u q JOIN u c ON q.id % 50 = 0 AND q.id != c.id AND len(q.v) = len(c.v) GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
