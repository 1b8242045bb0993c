"""Cases that once went wrong: proportional and extreme vectors, words with U+0000, rows that repeat, boilerplate that links with nothing."""

import functools
import glob
import operator
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import lm, neardup, neighbours, substrings


def exact(a, b):
    total = lambda x, y: functools.reduce(operator.add, (p * q for p, q in zip(x, y, strict=True)))
    return total(a, b) / np.sqrt(total(a, a) * total(b, b))


def test_proportional_vectors(spark):
    rng = np.random.default_rng(21)
    v = [x.tolist() for x in rng.normal(size=(500, 12))]
    v[100:400] = [(np.array(v[100]) * (1 + i % 7)).tolist() for i in range(300)]
    v[410:470] = [v[410]] * 60
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.search(df, F.col("vec_id") % 50 == 0, factor=1.0, shard=128).collect()}
    for q in range(0, 500, 50):
        best = sorted((-exact(v[q], v[i]), i) for i in range(500) if i != q)[:5]
        assert [got[q, rank] for rank in range(1, 6)] == [(i, -s) for s, i in best]


@pytest.mark.parametrize("size", [1e200, 1e-200, 1.0])
def test_extreme_components(spark, size):
    rng = np.random.default_rng(22)
    plain = rng.normal(size=(120, 6))
    rows = spark.createDataFrame([(i, (x * size).tolist()) for i, x in enumerate(plain)], "vec_id long, embedding array<double>")
    got = neighbours.search(rows, F.col("vec_id") % 50 == 0, factor=1.0, shard=50).collect()
    assert len(got) == 15
    for r in got:
        assert r["score"] == pytest.approx(exact(plain[r["query_id"]], plain[r["vec_id"]]))


def test_words_with_zero_bytes(spark):
    words = ["a\0b", "\0", "plain", "\0\0x", "y\0"]
    texts = [" ".join(random.Random(i).choices(words, k=12)) for i in range(60)] + ["new\0word", "\0new", "other"]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i]["n_tokens"] == len(t.split(" ")) + 1 and got[i]["score"] < 0 for i, t in enumerate(texts))
    pieces = list(lm.byte_bits([b"a\0b", b"c", b"\0"]))
    assert np.bincount(np.concatenate([w for w, _, _ in pieces])).tolist() == [4 * 8, 2 * 8, 2 * 8]
    bits = np.concatenate([b for _, b, _ in pieces]).reshape(-1, 8)
    assert [int("".join(map(str, row)), 2) for row in bits.tolist()] == [97, 255, 98, 0, 99, 0, 255, 0]


def test_marks_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(None, text)] * 300 + [(1, text)] * 200 + [(2, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    marks = substrings.spans(df.select(F.xxhash64("doc_id", "text").alias("k"), "text")).select(F.size("spans").alias("n")).collect()
    assert len(marks) == 2 and max(r["n"] for r in marks) <= 400
    got = substrings.cut(df).groupBy("doc_id").agg(F.sum("n_removed").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {r["doc_id"]: (r["n"], r["rows"]) for r in got} == {None: (300 * 400, 300), 1: (200 * 400, 200), 2: (0, 1)}


def boilerplate(n, rng):
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    return [f"your order has been shipped {word()} {word()}" for _ in range(n)]


def linked(texts, k=2):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return [root(i) for i in range(len(texts))]


def test_boilerplate_links_as_brute_force(spark, monkeypatch):
    rng = random.Random(23)
    texts = boilerplate(300, rng)
    longer = "dear customer your order number has been shipped today by our partner and will soon arrive at the address given"
    for _ in range(120):  # these link in part, through one another
        w = longer.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
        texts.append(" ".join(w))
    texts += texts[:5]
    for rounds in (neardup.ROUNDS, 1):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        got = {r["doc_id"]: r["component_id"] for r in neardup.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()}
        assert [got[i] for i in range(len(texts))] == linked(texts)


def test_boilerplate_grows_with_its_rows(spark):
    rng = random.Random(24)
    took = []
    for n in (1_000, 8_000):
        df = spark.createDataFrame(list(enumerate(boilerplate(n, rng))), "doc_id long, text string")
        began = time.time()
        assert neardup.find(df, k=2).where("kept").count() == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 20


def test_near_copies_that_do_not_link_hardly_meet(spark, monkeypatch):
    rng = random.Random(25)
    base = [f"w{i}" for i in range(300)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"n{rng.random()}"
        return words

    far = [changed(base, 12) for _ in range(200)]  # some 0.7 alike
    texts = [" ".join(w) for w in far] + [" ".join(changed(w, n)) for w in far[:40] for n in (3, 7)]
    made = []
    met = neardup.by_rare_shingles
    monkeypatch.setattr(neardup, "by_rare_shingles", lambda *a: made.append(met(*a)) or made[-1])
    for rounds in (neardup.ROUNDS, 1):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        got = {r["doc_id"]: r["component_id"] for r in neardup.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()}
        assert [got[i] for i in range(len(texts))] == linked(texts)
        assert made[-1].count() < 10 * len(texts)


def test_successors_take_few_bytes_a_token(spark):
    rng = random.Random(31)
    data = [(i, " ".join(f"w{rng.randint(0, 2_000)}" for _ in range(1_500))) for i in range(200)]
    scores = lm.score(spark.createDataFrame(data, "doc_id long, text string"))
    assert scores.count() == 200
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    newest = max(glob.glob(f"{top}/wardlake-*"), key=os.path.getctime)
    kept = sum(os.path.getsize(f) for f in glob.glob(f"{newest}/**/*.parquet", recursive=True))
    assert kept < 4 * 200 * 1_500  # a context, a successor and a cost for each token would be 20 bytes


def test_blocks_are_told_what_the_table_of_successors_has(spark):
    rng = random.Random(32)
    data = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) or None) for i in range(300)] + [(300, "x1 x2 a b x1 x2 c")]
    rows = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("held_out", F.col("doc_id") % 4 == 1)
    train = rows.where("NOT held_out")
    vocab = lm.vocabulary(lm.count_tokens(train), train.count())
    shared = spark.sparkContext.broadcast(vocab)
    blocks = lm.numbered(rows, shared).cache()
    seen, asked = [], {}
    for r in blocks.collect():
        block = lm.Block(r.asDict())
        every, first = lm.with_ends(block.number, block.lengths)
        pairs = lm.Pairs(vocab, block, every, first)
        asked[r["block"]] = list(zip(pairs.context.view(np.int64).tolist(), vocab.names()[pairs.follows].view(np.int64).tolist(), strict=True))
        assert len(set(asked[r["block"]])) == len(asked[r["block"]])
        for pair, times in zip(asked[r["block"]], pairs.taught.tolist(), strict=True):
            seen += [pair] * times
    # an end and each word but the first two of a text, less what training texts have once
    inside = [[*(t or "").split(), None] for i, t in data if i % 4 != 1]
    assert len(seen) == sum(w is None or w in "abcdefgh" or w in ("x1", "x2") for t in inside for w in t[2:])
    table = lm.successors(spark.createDataFrame(seen, "ctx long, next long"))
    best = {r["ctx"]: r for r in table.collect()}
    replies = lm.foreseen(blocks, shared, 5).collect()
    assert len({r["bucket"] for r in replies}) == 5
    for name, pairs in asked.items():
        got = np.concatenate([lm.unpacked(r["reply"], "u1") for r in sorted(replies, key=lambda r: r["bucket"]) if r["block"] == name]).tolist()
        assert len(got) == len(pairs)
        for reply, (context, follower) in zip(got, pairs, strict=True):
            b = best.get(context)
            assert reply == (min(b["m"], lm.SURE) * 2 + (b["m"] == b["n"]) + 10 * (follower == b["next"]) if b else 0)
    told = spark.createDataFrame(replies).select(F.inline("seen"))
    assert lm.trust(told) == lm.trust(table)
