"""Quantiles, forests and what follows from them, by hand and by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import learning


@pytest.mark.parametrize("kind", ["plain", "ties", "heavy", "two", "one", "none", "wide"])
def test_quantiles_by_selection(spark, kind):
    rng = np.random.default_rng(5)
    x = {
        "plain": rng.normal(size=4000),
        "ties": rng.choice([0.0, 1.0, 2.0], size=3000, p=[0.4, 0.4, 0.2]),
        "heavy": np.concatenate([np.zeros(2500), rng.normal(size=40), np.full(900, 7.5)]),
        "two": np.array([1.0, 2.0]),
        "one": np.array([3.5]),
        "none": np.array([]),
        "wide": np.exp(rng.normal(size=3000) * 200),
    }[kind]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "id long, score double").repartition(5)
    shares = [0.0, 0.005, 0.3333, 0.5, 0.8, 0.99, 1.0]
    for most in (100_000, 50):
        got, n = learning.exact_quantiles(df, "score", shares, most)
        assert n == len(x)
        if not n:
            assert got == [None] * len(shares)
            continue
        assert got == pytest.approx([float(np.quantile(x, s)) for s in shares], rel=1e-9)


def vectors(spark, n=3000, width=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[:10] += 8
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(6)


def test_samples_are_the_rows_of_least_hash(spark):
    x, df = vectors(spark)
    drawn = learning.samples(df, "features", "id", 7, 64, 42).toPandas()
    at = {tuple(v): i for i, v in enumerate(x)}
    own = {r["id"]: r["h"] & 0xFFFFFFFFFFFFFFFF for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    names = learning._mixed((np.arange(1, 8, dtype=np.uint64) << np.uint64(20)) ^ np.uint64(42))
    for tree in range(7):
        h = {i: int(learning._mixed(np.array([own[i]], np.uint64) ^ names[tree])[0]) for i in own}
        want = sorted(h, key=h.get)[:64]
        got = drawn[drawn["tree"] == tree].sort_values("h").head(64)
        assert [at[tuple(v)] for v in got["features"]] == want
    assert len(drawn) < 7 * 64 * 3


def test_trees_hold_their_samples(spark):
    x, df = vectors(spark)
    nodes = learning.forest_fit(df, trees=12, sample=64).toPandas()
    assert learning.forest_fit(df.repartition(2), trees=12, sample=64).toPandas().sort_values(["tree", "node"]).reset_index(drop=True).equals(nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    for _, t in nodes.groupby("tree"):
        t = t.set_index("node")
        assert t.loc[0, "n"] == 64
        inner = t[t["feature"] >= 0]
        assert (inner["n"].to_numpy() == t.loc[inner["left"], "n"].to_numpy() + t.loc[inner["right"], "n"].to_numpy()).all()

        def depth(node, d=0, t=t):
            return d if t.loc[node, "feature"] < 0 else max(depth(t.loc[node, "left"], d + 1), depth(t.loc[node, "right"], d + 1))

        assert depth(0) <= 6


def walked(nodes, x):
    """Path lengths of one vector, tree by tree, by hand."""
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    out = []
    for _, t in nodes.groupby("tree"):
        t = t.set_index("node")
        node = depth = 0
        while t.loc[node, "feature"] >= 0:
            node = t.loc[node, "left"] if x[int(t.loc[node, "feature"])] <= t.loc[node, "threshold"] else t.loc[node, "right"]
            depth += 1
        out.append((depth + c(t.loc[node, "n"]), c(t.loc[0, "n"])))
    depth, norm = np.mean(out, axis=0)
    return -(2 ** (-depth / norm))


def test_scores_and_attributions(spark):
    x, df = vectors(spark, 400)
    fitted = learning.forest_fit(df, trees=10, sample=50)
    nodes = fitted.toPandas()
    got = {r["id"]: r for r in learning.forest_score(df, fitted).collect()}
    for i in (0, 5, 50, 399):
        assert got[i]["score"] == pytest.approx(walked(nodes, x[i]))
        assert sum(got[i]["attribution"]) == pytest.approx(got[i]["expected_depth"] - got[i]["depth"])
    assert np.mean([got[i]["score"] for i in range(10)]) < np.mean([got[i]["score"] for i in range(10, 400)])


def test_offset_and_threshold(spark):
    _, df = vectors(spark, 600)
    twice = df.unionByName(df)  # equal vectors count once
    nodes, about = learning.train_forest(twice, trees=20, sample=64)
    parts = learning.split(df.select(F.xxhash64("features").alias("id"), "features"), "id")
    scores = {p: [r["score"] for r in learning.forest_score(parts.where(F.col("part") == p), nodes).collect()] for p in ("train", "calibrate")}
    assert about["n_train"] + about["n_calibrate"] == 600 and abs(about["n_train"] - 420) < 60
    assert about["offset"] == pytest.approx(np.quantile(scores["train"], 0.05))
    assert about["threshold"] == pytest.approx(np.quantile(scores["calibrate"], 0.005) - about["offset"])
    judged = learning.decide(learning.forest_score(df, nodes), about["offset"], about["threshold"]).collect()
    assert 0 < sum(r["anomalous"] for r in judged) < 60
    with pytest.raises(ValueError, match="distinct"):
        learning.train_forest(df.limit(15))


def test_robustness_and_floor(spark):
    rows = [("path", 1, -0.7, -0.5), ("path", 1, -0.6, -0.65), ("path", 1, -0.3, -0.2), ("path", 2, -0.3, -0.1)]
    got = {(r["mutator"], r["intensity"]): r for r in learning.robustness(spark.createDataFrame(rows, "mutator string, intensity int, before double, after double"), -0.55).collect()}
    one = got["path", 1]
    assert (one["detected"], one["escaped"], one["escape_rate"]) == (2, 1, 0.5) and one["median_delta"] == pytest.approx(0.1) and one["max_delta"] == pytest.approx(0.2)
    assert got["path", 2]["escape_rate"] == 0.0
    card = lambda rate, delta: spark.createDataFrame([("path", 1, rate, delta)], "mutator string, intensity int, escape_rate double, median_delta double")
    for rate, delta, passed in ((0.25, 0.2, True), (0.26, 0.2, False), (0.2, 0.31, False)):
        assert learning.floor_check(card(rate, delta), card(0.2, 0.2)).first()["passed"] is passed


def test_grouped_quantiles_by_cell(spark):
    rng = np.random.default_rng(9)
    x = {"a": rng.normal(size=501), "b": rng.choice([0.25, -0.5], 300), "c": np.array([1.5])}
    rows = [(g, float(v), 1 + i % 3) for g, xs in x.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame([*rows, ("a", None, 7)], "g string, x double, n int").repartition(5)
    for share in (0.0, 0.05, 0.5, 1.0):
        got = {r["g"]: r["quantile"] for r in learning.group_quantile(df, ["g"], "x", share, "n").collect()}
        assert got == pytest.approx({g: float(np.quantile(np.repeat(xs, [1 + i % 3 for i in range(len(xs))]), share)) for g, xs in x.items()})
    every = np.concatenate([np.repeat(xs, [1 + i % 3 for i in range(len(xs))]) for xs in x.values()])
    assert learning.group_quantile(df, [], "x", 0.3, "n").first()["quantile"] == pytest.approx(float(np.quantile(every, 0.3)))
    assert learning.group_quantile(df.limit(0), [], "x", 0.3, "n").first()["quantile"] is None


def test_robustness_of_rows_that_stand_for_several(spark):
    schema = "mutator string, intensity int, before double, after double"
    rows = [("path", 1, -0.7, -0.5), ("path", 1, -0.6, -0.65), ("path", 1, -0.3, -0.2), ("path", 2, -0.3, -0.1)]
    many = spark.createDataFrame([r for i, r in enumerate(rows) for _ in range(i + 2)], schema)
    few = spark.createDataFrame([(*r, i + 2) for i, r in enumerate(rows)], schema + ", n long")
    got, want = (sorted(learning.robustness(df, -0.55).collect()) for df in (few, many))
    assert [r[:4] for r in got] == [r[:4] for r in want] and (got[0]["detected"], got[0]["escaped"]) == (5, 2)
    assert [x for r in got for x in r[4:]] == pytest.approx([x for r in want for x in r[4:]])


def test_scores_of_several_columns_are_those_with_attributions(spark):
    x, df = vectors(spark, 300)
    nodes = learning.forest_fit(df, trees=10, sample=50)
    twice = df.unionByName(df).select("id", "features", F.transform("features", lambda v: v / 2).alias("half"))
    got = {r["id"]: r for r in learning.forest_scores(twice, learning.Forest(nodes.toPandas()), ["features", "half"]).collect()}
    whole = {r["id"]: r["score"] for r in learning.forest_score(df, nodes).collect()}
    half = {r["id"]: r["score"] for r in learning.forest_score(twice.select("id", F.col("half").alias("features")), nodes).collect()}
    assert {i: r["features"] for i, r in got.items()} == pytest.approx(whole) and {i: r["half"] for i, r in got.items()} == pytest.approx(half)


def test_vectors_are_made_of_drawn_rows(spark):
    _, df = vectors(spark, 500)
    made = learning.forest_fit(df.select("id", F.struct("features").alias("raw")), "raw", trees=5, sample=32, vector=lambda r: r["features"])
    one, two = (n.toPandas().sort_values(["tree", "node"]).reset_index(drop=True) for n in (made, learning.forest_fit(df, trees=5, sample=32)))
    assert one.equals(two)


def test_blocks_of_which_nothing_is_drawn(spark):
    df = spark.range(20_000, numPartitions=2).select("id", F.array(F.col("id").cast("double")).alias("features"))
    drawn = learning.samples(df, "features", "id", 1, 2, 42).collect()
    assert 0 < len(drawn) < 20 and all(len(r["features"]) == 1 for r in drawn)
    assert learning.forest_fit(df, trees=1, sample=2).count() > 0


def test_training_makes_the_vectors_once(spark):
    _, df = vectors(spark, 300)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    learning.train_forest(df.select("features").mapInArrow(counted, "features array<double>"), trees=5, sample=32)
    assert made.value == 300
