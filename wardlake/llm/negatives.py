"""Hard negatives by rotated one-bit codes.

Vectors of integers are rotated (random signs and Hadamard transforms, in three rounds) and kept as one bit a component, with their norm and their alignment: the
cosine a between the rotated vector and its code. For an anchor q, in units of both norms, the rotated vector is a * code + sqrt(1 - a^2) * r with r a unit
vector at right angles to the code. With q' the anchor in a few bits, e the norm of what that loses, and s = <code, q'> from popcounts of bit planes,

    |<x, q> - a * s| <= sqrt(1 - a^2) * sqrt(|q'|^2 - s^2) + e

by Cauchy and Schwarz, for certain. A row is scored in integers only if its interval can still reach what is asked; so the result is exact.

Positives come first, then negatives within bounds that depend on them. In both passes the rows are dealt in shards of about ``SHARD`` by hash, a partition reads a
shard's rows, then the anchors as a stream, and each shard answers with its best few of each anchor; the anchors are a stated set, so every shard meets all of them.
A task's memory is bounded by a shard and a batch.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows that repeat id, label and vector are one; rows with the
anchor's id are none of its others; rows that share an id but differ are anchors (and others) of their own; missing components of the shorter of two vectors count as
zeros; ties go to the smaller id; vectors of norm 2**31 or more raise an error, as scores would not fit into 64 bits; an empty table gives no rows; only the named
columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table

SHARD = 8_192
#: Bits of an anchor's component, anchors compared at once, and rows scored first for a bound.
BITS, BLOCK, SEEDS = 6, 128, 8
#: Of the product of the norms: more than the rounding of any sum here.
SLACK = 1e-9
CODED = "id long, label long, uid long, v binary, code binary, alignment double, norm double"


@functools.cache
def signs(width: int) -> np.ndarray:
    return np.random.default_rng(width).choice([-1.0, 1.0], size=(3, width))


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows turned by one fixed orthogonal map; their length is a power of two."""
    n, width = x.shape
    for sign in signs(width):
        x = x * sign
        h = 1
        while h < width:
            pairs = x.reshape(n, -1, 2, h)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        x = x / math.sqrt(width)
    return x


def padded(x: np.ndarray, width: int) -> np.ndarray:
    """Rows cut, or filled with zeros, to a width."""
    x = x[:, :width]
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def width_of(size: int) -> int:
    return max(64, 1 << max(0, size - 1).bit_length())


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as rows of bytes, alignments and norms of rows of integers."""
    turned = rotate(padded(x.astype(np.float64), width_of(x.shape[1])))
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    aligned = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little"), np.clip(np.divide(aligned, norm, out=np.ones_like(norm), where=norm > 0), 0, 1), norm


class Rows:
    """Rows of one length in a shard."""

    def __init__(self, ids, labels, x, codes, alignment, norm):
        self.ids, self.labels, self.x, self.norm = ids, labels, x, norm
        self.width = width_of(x.shape[1])
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.alignment, self.rest = alignment, np.sqrt(np.maximum(0, 1 - alignment**2))
        self.floats = x.astype(np.float64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper bound of the score of each anchor (row of q) with each row."""
        q = padded(q.astype(np.float64), self.width)
        norm = np.sqrt((q**2).sum(axis=1))
        turned = rotate(q) / np.where(norm > 0, norm, 1)[:, None]
        low, step = turned.min(axis=1), np.ptp(turned, axis=1) / ((1 << BITS) - 1)
        steps = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
        coarse = low[:, None] + step[:, None] * steps
        lost = np.sqrt(((turned - coarse) ** 2).sum(axis=1))
        total = np.zeros((len(q), len(self.ids)))
        for j in range(BITS):
            plane = np.packbits(steps >> j & 1, axis=1, bitorder="little").view(np.uint64)
            shared = np.zeros(total.shape, np.uint16 if self.width < 1 << 16 else np.int64)
            for w in range(plane.shape[1]):
                shared += np.bitwise_count(plane[:, w, None] & self.words[None, :, w])
            total += shared * float(1 << j)
        s = (2 * (low[:, None] * self.ones + step[:, None] * total) - coarse.sum(axis=1)[:, None]) / math.sqrt(self.width)
        half = self.rest * np.sqrt(np.maximum(0, (coarse**2).sum(axis=1)[:, None] - s**2)) + lost[:, None] + SLACK
        scale = norm[:, None] * self.norm
        guess = self.alignment * s
        return guess * scale, (guess - half) * scale, (guess + half) * scale

    def score(self, some: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer products of some rows with one anchor; doubles are exact where no partial sum can leave 53 bits."""
        size = min(len(q), self.x.shape[1])
        q = q[:size]
        if self.norm[some].max(initial=0) * math.sqrt(float((q.astype(np.float64) ** 2).sum())) < 2**52:
            return (self.floats[some, :size] @ q.astype(np.float64)).astype(np.int64)
        return self.x[some, :size] @ q


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


def positives_of(rows: Rows, anchors: dict, at: range, k: int) -> Iterator[tuple]:
    """(anchor's number, id, score) of each anchor's best k rows of its own label."""
    guess, low, high = rows.bounds(anchors["x"][at.start : at.stop])
    for i, a in enumerate(at):
        q = anchors["x"][a]
        fit = np.flatnonzero((rows.labels == anchors["label"][a]) & (rows.ids != anchors["id"][a]))
        if not len(fit):
            continue
        seeds = fit[np.argpartition(-guess[i, fit], min(SEEDS, len(fit)) - 1)[:SEEDS]]
        least = max(kth(low[i, fit], k), kth(rows.score(seeds, q), k))
        some = fit[high[i, fit] >= least]
        scores = rows.score(some, q)
        for j in best(scores, rows.ids[some], k):
            yield a, rows.ids[some[j]], scores[j]


def negatives_of(rows: Rows, anchors: dict, at: range, k: int) -> Iterator[tuple]:
    """(anchor's number, positive's number, id, score) of the best k rows of other labels with low <= score / positive's score <= high, for each positive."""
    guess, low, high = rows.bounds(anchors["x"][at.start : at.stop])
    for i, a in enumerate(at):
        q, asked = anchors["x"][a], anchors["positives"][a]
        fit = np.flatnonzero((rows.labels != anchors["label"][a]) & (rows.ids != anchors["id"][a]))
        wanted = np.zeros(len(fit), bool)
        lo_i, hi_i, guess_i = low[i, fit], high[i, fit], guess[i, fit]
        for least, most in asked:
            may = (hi_i >= least) & (lo_i <= most)
            sure = (lo_i >= least) & (hi_i <= most)
            bar = kth(lo_i[sure], k)
            if may.any():
                inside = np.flatnonzero(may)
                likely = guess_i[inside]
                order = np.argpartition(np.where(likely <= most, -likely, likely), min(SEEDS, len(inside)) - 1)[:SEEDS]
                known = rows.score(fit[inside[order]], q)
                bar = max(bar, kth(known[(known >= least) & (known <= most)], k))
            wanted |= may & (hi_i >= bar)
        some = fit[wanted]
        if not len(some):
            continue
        scores = rows.score(some, q)
        for number, (least, most) in enumerate(asked):
            ok = np.flatnonzero((scores >= least) & (scores <= most))
            for j in ok[best(scores[ok], rows.ids[some[ok]], k)]:
                yield a, number, rows.ids[some[j]], scores[j]


def matrices(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of integers) for each length of the binary vectors of a batch."""
    raw = [x.as_buffer() for x in b.column(column)]
    sizes = np.array([x.size for x in raw])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), "<i8").reshape(len(at), -1)


def numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def shard_rows(batches: list[pa.RecordBatch]) -> list[Rows]:
    b = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    ids, labels, alignment, norm = (numbers(b, c) for c in ("id", "label", "alignment", "norm"))
    out = []
    for at, x in matrices(b, "v"):
        codes = np.frombuffer(b"".join(b.column("code")[i].as_py() for i in at), np.uint8).reshape(len(at), -1)
        out.append(Rows(ids[at], labels[at], x, codes, alignment[at], norm[at]))
    return out


def answers(b: pa.RecordBatch, shard: list[Rows], find: Callable, k: int) -> Iterator[tuple]:
    """What a shard answers to a batch of anchors: (row of the batch, ...)."""
    ids, labels = numbers(b, "id"), numbers(b, "label")
    asked = b.column("positives").to_pylist()
    for at, x in matrices(b, "v"):
        anchors = {"id": ids[at], "label": labels[at], "x": x, "positives": [[(p["least"], p["most"]) for p in asked[i] or []] for i in at]}
        for rows in shard:
            for lo in range(0, len(at), BLOCK):
                for a, *found in find(rows, anchors, range(lo, min(lo + BLOCK, len(at))), k):
                    yield at[a], *found


def in_shards(dealt: DataFrame, find: Callable, k: int, out: str) -> DataFrame:
    """Shards (asks false) that answer the anchors that follow them (asks true): id, uid, then what find gives."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, [], None
        for b in batches:
            shard, asks = numbers(b, "shard"), numbers(b, "asks")
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                if lo == hi:
                    continue
                if shard[lo] != now:
                    now, held, built = shard[lo], [], None
                part = b.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append(part)
                    continue
                if built is None:
                    built, held = shard_rows(held) if held else [], []
                found = list(zip(*answers(part, built, find, k), strict=True))
                if found:
                    at = np.array(found[0])
                    yield pa.RecordBatch.from_arrays([pa.array(numbers(part, "id")[at]), pa.array(numbers(part, "uid")[at]), *(pa.array(np.array(c, np.int64)) for c in found[1:])], names)

    return dealt.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(run, out)


def coded(rows: DataFrame) -> DataFrame:
    """id, label, uid and v (arrays of integers) with v as bytes, code, alignment and norm."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches):
        for b in batches:
            lists = pa.concat_arrays([b.column("v")])
            sizes, start, flat = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1], lists.values.to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = flat[start[at][:, None] + np.arange(n)].astype(np.int64).reshape(len(at), n)
                code, alignment, norm = encode(x)
                vectors = [r.astype("<i8").tobytes() for r in x]
                columns = [b.column(c).take(pa.array(at)) for c in ("id", "label", "uid")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(alignment), pa.array(norm)], names)

    return rows.mapInArrow(run, CODED)


def usable(vectors: DataFrame, key: str, label: str | Column, vector: str, scale: int) -> DataFrame:
    """Distinct id, label and v, an array of the integers floor(scale * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    long = F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0))) >= 2.0**62
    v = F.when(long, F.raise_error(F.lit("a vector's norm is 2**31 or more: its scores would not fit into 64 bits")).cast("array<bigint>")).otherwise(F.transform("x", lambda c: F.floor(c * scale)))
    return rows.select("id", "label", v.alias("v")).distinct()


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition over the column id. low, high: the bounds of negative_score / positive_score, as ratios of integers.
    """
    space = Workspace(vectors.sparkSession)
    index = space.keep(coded(usable(vectors, key, label, vector, scale).withColumn("uid", F.xxhash64("label", "v"))))
    shards = max(1, math.ceil(index.count() / shard))
    numbered = "array<struct<least:bigint,most:bigint>>"
    stored = index.select("*", F.lit(None).cast(numbered).alias("positives"), F.lit(False).alias("asks"), F.pmod(F.xxhash64("id", "uid"), F.lit(shards)).cast("int").alias("shard"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = index.where(anchors)

    near = in_shards(stored.unionByName(asking.select("*", F.lit(None).cast(numbered).alias("positives"), F.lit(True).alias("asks"), everywhere)), positives_of, positives, "id long, uid long, positive_id long, positive_score long")
    order = F.row_number().over(Window.partitionBy("id", "uid").orderBy(F.desc("positive_score"), "positive_id"))
    near = space.keep(near.withColumn("number", order - 1).where(F.col("number") < positives))

    # exact integer bounds of s / p between two ratios: b * s >= a * p and d * s <= c * p
    p, (a, b), (c, d) = F.col("positive_score"), low, high
    least = F.expr(f"CAST(ceil(CAST(positive_score AS DECIMAL(30, 0)) * {a} / {b}) AS BIGINT)")
    most = F.expr(f"CAST(floor(CAST(positive_score AS DECIMAL(30, 0)) * {c} / {d}) AS BIGINT)")
    per = near.groupBy("id", "uid").agg(F.array_sort(F.collect_list(F.struct("number", least.alias("least"), most.alias("most")))).alias("found"))
    per = per.withColumn("positives", F.transform("found", lambda x: F.struct(x["least"].alias("least"), x["most"].alias("most")))).drop("found")
    asking = asking.join(per, ["id", "uid"]).select(*index.columns, "positives", F.lit(True).alias("asks"), everywhere)
    hard = in_shards(stored.unionByName(asking), negatives_of, negatives, "id long, uid long, number long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("id", "uid", "number").orderBy(F.desc("negative_score"), "negative_id"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return hard.join(near, ["id", "uid", "number"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", p, "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


#: All anchors against all rows; vectors of one length.
SQL = """
WITH r AS (SELECT DISTINCT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.id AS a_id, a.label AS a_label, a.v AS a_v, b.id AS b_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id != b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_id, a_label, a_v ORDER BY score DESC, b_id) <= 5),
h AS (SELECT p.a_id AS anchor_id, p.b_id AS positive_id, row_number() OVER (PARTITION BY p.a_id, p.a_label, p.a_v, p.b_id, p.score ORDER BY s.score DESC, s.b_id) AS rank, s.b_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a_id = s.a_id AND p.a_label = s.a_label AND p.a_v = s.a_v AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""
