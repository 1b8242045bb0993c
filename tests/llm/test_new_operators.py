"""Hard negatives, token counts and spelling variants against brute force and the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlake.llm import counting, negatives, spelling

EMBEDDINGS = "vec_id long, embedding array<float>, label int, id string, v string, shard string, asks string"


def mined(rows, anchors=50, k=5, m=3):
    """(anchor, positive, rank, negative, scores) by all pairs, for rows of id, vector, label."""
    kept = {(i, y, tuple(int(np.floor(256 * float(c))) for c in x)) for i, x, y in rows if None not in (i, x, y) and all(c is not None and np.isfinite(c) for c in x)}
    out = []
    for a in [r for r in kept if r[0] % anchors == 0]:
        others = sorted(((-sum(p * q for p, q in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in kept if r[0] != a[0]), key=lambda r: r[:2])
        for p, positive, _ in [r for r in others if r[2] == a[1]][:k]:
            fit = [r for r in others if r[2] != a[1] and 50 * -p <= 100 * -r[0] <= 95 * -p][:m]
            out += [(a[0], positive, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(6, 24))
    rows = [(i, (heads[i % 6] + 0.6 * rng.normal(size=24)).astype(np.float32).tolist(), int(i % 4)) for i in range(400)]
    rows += [(1000 + i, (heads[0] * i / 3).astype(np.float32).tolist(), i % 3) for i in range(7)]  # proportional vectors
    rows += [(2000 + i, rows[50][1], 1 + i % 2) for i in range(30)] * 2  # ties, and repeated rows
    rows += [(50, rows[3][1], 2), (3000, [0.0] * 24, 1), (3050, [], 1), (3100, [1.0, 2.0], 0)]  # a second row of an anchor; zero, empty and short vectors
    rows += [(None, rows[0][1], 1), (3150, None, 1), (3200, rows[0][1], None), (3250, [float("nan")] * 24, 1), (3300, [None] * 24, 1), (3350, [float("inf")] * 24, 1)]
    return rows


@pytest.mark.parametrize("shard", [10_000, 60])
def test_hard_negatives(spark, shard):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in vectors()], EMBEDDINGS).repartition(5)
    got = negatives.mine(df, F.col("id") % 50 == 0, shard=shard).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == mined(vectors())
    assert negatives.mine(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_intervals_hold():
    rng = np.random.default_rng(1)
    for size in (3, 64, 100):
        x, q = rng.integers(-900, 900, (300, size)), rng.integers(-900, 900, (40, size))
        x[0] = 0
        codes, alignment, norm = negatives.encode(x)
        rows = negatives.Rows(np.arange(300), np.zeros(300), x, codes, alignment, norm)
        guess, low, high = rows.bounds(q)
        exact = q @ x.T
        assert (low <= exact).all() and (exact <= high).all() and np.corrcoef(guess.ravel(), exact.ravel())[0, 1] > 0.7
        assert np.allclose(negatives.rotate(np.eye(128)) @ negatives.rotate(np.eye(128)).T, np.eye(128))


def test_long_norms_raise(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="norm"):
        negatives.mine(df, F.col("id") % 50 == 0).collect()


def pieces():
    rng = random.Random(3)
    parts = ["'", "s", "t", "'re", "'ve", "'ll", "l", "d", " ", "  ", "\n", "\t", "a", "th", "ing", "1", "23", "!", "..", "é", "日本", "🙂", "<|endoftext|>", "The", "aaaa", "\x00", "\r\n", " ", "é"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*out, None, "", " ", "a" * 70_000, "ab " * 30_000, "日本語" * 9_000, " " * 5_000, "'" * 4_001, "".join(rng.choice("abcdefgh") for _ in range(20_000))]


@pytest.mark.parametrize("block, chunk", [(1 << 20, 256), (40, 8)])
def test_token_counts_by_the_library(monkeypatch, block, chunk):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(counting, "BLOCK", block)
    monkeypatch.setattr(counting, "CHUNK", chunk)
    texts = pieces()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counting.Counter(path).texts(texts) == want


def test_all_code_points():
    path = public_tokenizers.path("byte_bpe_50k.json")
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    lib, own = Tokenizer.from_file(path), counting.Counter(path)
    for mould in ("a{0}a", "1{0}1", "!{0}!", "\n{0}{0}b"):
        texts = [mould.format(c) for c in every]
        assert own.texts(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_maps_compose():
    rng = np.random.default_rng(4)
    then, _, _ = counting.splitter()
    for kinds in (rng.integers(0, 11, (37, 5)), rng.integers(0, 2, (64, 3)), np.full((9, 1), counting.QUOTE)):
        state, want = counting.START, []
        for row in kinds:
            want.append(state)
            for kind in row:
                state = then[state * 11 + kind]
        assert counting.entries(kinds, then).tolist() == want


def test_token_counts_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "one two", "x"), (None, None, "y"), (1, "one two", "x"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = counting.count_tokens(df, path)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "one two", 2), (None, None, 0), (1, "one two", 2), (3, "", 0)], key=str)
    assert counting.count_tokens(df.where("false"), path).count() == 0


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def grouped(n, ratio=5):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= ratio * n[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    return sorted(((a, form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] else None) for a in n), key=str)


def test_spelling_variants(spark):
    rng = random.Random(5)
    n = {}
    for _ in range(120):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 12)))
        for _ in range(6):
            n[word] = rng.choice([5, 5, 6, 25, 30, 150, 900])
            i, how = rng.randrange(len(word)), rng.randrange(3)
            word = word[:i] + (rng.choice("abcé") if how else "") + word[i + (how < 2) :]
            word = word if len(word) >= 6 else word + "abc"
    long = "".join(rng.choice("ab") for _ in range(80))
    n |= {long: 500, long[:70] + long[71:]: 50, "c" + long: 5, long[:3] + "é" + long[4:]: 9, "a" * 32: 7, "a" * 33: 40, "a" * 34: 7, "b" * 5000: 5, "b" * 4999: 99}
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, key string")
    got = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect()), key=str) == grouped(n)
    assert spelling.variants(df.where("false")).count() == 0


def test_word_counts(spark):
    texts = [(i, f"Straße élégance{i % 2} ÉCOLE×÷ aB-longer LONGER shortw" if i % 5 else None) for i in range(300)] + [(None, "Longer longer"), (7, ""), (7, "x" * 9000)] * 3
    want = {}
    for doc_id, text in texts:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                word = run[:at] + run[at + 1 :] if h % 11 == 0 else run
                want[word] = want.get(word, 0) + 1
            run = ""
    got = spelling.word_counts(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, run string"), drop=11)
    assert dict(map(tuple, got.collect())) == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
