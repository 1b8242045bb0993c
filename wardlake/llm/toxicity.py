"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic texts (label 1) and unlabelled texts (all
others, whatever their label says). The risk of the unlabelled class is corrected by the class prior and kept from
turning negative, so that toxic texts hidden among the unlabelled ones don't count as clean. The prior is the share of
label 1 among the labelled training rows. Training uses a bounded sample (``MAX_POSITIVE``, ``MAX_UNLABELLED``), drawn by hash;
scoring covers every whole text.

Defined results: a null or empty text has no words and scores by the bias alone; repeated rows are scored one by one;
with no confirmed toxic text the model is the bias of the prior; an empty table gives no rows; a document with several
labels counts as toxic if one of them is 1; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table

BITS = 18
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
HELD_OUT = (4, 2)
STEPS, RATE = 300, 0.05
#: Weight decay for so many texts; fewer texts need more.
DECAY, DECAY_TEXTS = 3e-3, 7_500
BEGINNINGS = (5, 6, 7)
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """Numbers of the distinct words, lower-cased and without punctuation at their edges, and of their beginnings.

    A beginning counts once for each distinct word that has it.
    """
    crc, mask, out = zlib.crc32, (1 << BITS) - 1, []
    for w in {w.strip(".,;:!?#*$%&|<>\"'()") for w in (text or "").lower().split()}:
        out.append(crc(w.encode("utf-8", "surrogatepass")) & mask)
        out += [crc(w[:k].encode("utf-8", "surrogatepass"), 7) & mask for k in BEGINNINGS if len(w) > k]
    return np.array(out, np.int64)


def scale(f: np.ndarray) -> float:
    """Value of each feature of a text: long texts hold many that mean nothing."""
    return 8 / np.sqrt(max(len(f), 20))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of positive and unlabelled training texts, and the class prior.

    Ids are drawn first, by hash; the drawn ones (their number is bounded) are broadcast, so that no text is shuffled.
    """
    n, out = HELD_OUT
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where((crc_mod(F.col("doc_id"), n) != out) & F.col("doc_id").isNotNull())
    trained = docs.where((crc_mod(F.col("doc_id"), n) != out) & F.col("doc_id").isNotNull())
    count = marks.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count("toxic").alias("l")).first()
    total = trained.count()
    prior = count["p"] / count["l"] if count["l"] else 0.5
    million = F.lit(1_000_000)
    share = lambda most, of: int(1_000_000 * min(1.0, most / max(of, 1)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), million)
    positive = marks.where((F.col("toxic") == 1) & (draw < share(MAX_POSITIVE, count["p"]))).select("doc_id", F.lit(True).alias("positive"))
    # what is confirmed toxic is not unlabelled, drawn or not
    candidates = trained.select("doc_id").where(draw < share(MAX_UNLABELLED, total)).distinct()
    unlabelled = candidates.join(marks.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", F.lit(False).alias("positive"))
    drawn = F.broadcast(positive.unionByName(unlabelled))  # some MAX_POSITIVE + MAX_UNLABELLED ids

    def numbers(batches):
        for b in batches:
            yield pd.DataFrame({"positive": b["positive"], "f": [features(t).astype(np.int32).tobytes() for t in b["text"]]})

    rows = trained.select("doc_id", "text").join(drawn, "doc_id").select("text", "positive").mapInPandas(numbers, "positive boolean, f binary").collect()
    rows = sorted((r["positive"], bytes(r["f"])) for r in rows)  # so that the sums, and the model, don't depend on the partitions
    return [np.frombuffer(f, np.int32) for p, f in rows if p], [np.frombuffer(f, np.int32) for p, f in rows if not p], prior


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, row numbers and values of all rows."""
    n = [len(r) for r in rows]
    return np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), n), np.repeat(np.array([scale(r) for r in rows], np.float32), n)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Weights, the bias last, that minimise the non-negative risk under the logistic loss (full batches, Adam).

    Risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]); where the second term is negative its
    gradient is reversed.
    """
    prior = min(max(prior, 1e-3), 0.999)
    size = 1 << BITS
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return w
    (fp, rp, xp), (fu, ru, xu) = _flat(positive), _flat(unlabelled)
    # words of fewer than three sampled texts carry no evidence
    df = np.bincount(fp, minlength=size) + np.bincount(fu, minlength=size)
    live = df >= 3
    np_, nu = len(positive), len(unlabelled)
    decay = DECAY * math.sqrt(DECAY_TEXTS / (np_ + nu))
    fp, rp, xp = (x[live[fp]] for x in (fp, rp, xp))
    fu, ru, xu = (x[live[fu]] for x in (fu, ru, xu))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        zp = np.bincount(rp, w[fp] * xp, np_) + w[-1]
        zu = np.bincount(ru, w[fu] * xu, nu) + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        if negative >= 0:
            gp, gu = prior * (sp - 1) / np_ - prior * sp / np_, su / nu
        else:
            gp, gu = prior * sp / np_, -su / nu
        grad = np.bincount(fp, gp[rp] * xp, size + 1) + np.bincount(fu, gu[ru] * xu, size + 1)
        grad[-1] = gp.sum() + gu.sum()
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score for every row; the weights (2 MB, a fixed size) travel by broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches):
        w = shared.value
        of = lambda f: float(sigmoid(w[f].sum() * scale(f) + w[-1]))
        for b in batches:
            scores = [of(features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(*sample(docs, table(spark, sf_dir, "labels")))
    n, out = HELD_OUT
    return score(docs, weights).select(
        "doc_id", (crc_mod(F.col("doc_id"), n) == out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
