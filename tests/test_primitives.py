"""Boundaries, ties and order of the keyed primitives, by plain Python where there is a rule to compare with."""

import random

import pytest
from pyspark.sql import functions as F

from wardlake.operators import primitives as P
from wardlake.operators import rules

SCHEMA = "event_id long, key string, ts long, v string"


def rows(spark, times, key="a"):
    return spark.createDataFrame([(i, key, t, "x") for i, t in enumerate(times)], SCHEMA)


def by_id(df, column):
    return [r[column] for r in df.orderBy("event_id").collect()]


def test_lower_bound_is_inside(spark):
    df = P.sliding_count(rows(spark, [0, 29, 30, 31]), ["key"], "ts", 30, "event_id")
    assert by_id(df, "n") == [1, 2, 3, 3]


def test_later_peers_do_not_count(spark):
    df = P.sliding_count(rows(spark, [5, 5, 5]), ["key"], "ts", 10, "event_id")
    assert by_id(df, "n") == [1, 2, 3]


def test_a_dropped_row_does_not_slide_the_window(spark):
    df = P.suppress_within(rows(spark, [0, 20, 40, 61]), ["key"], "ts", 30, "event_id")
    assert [r["ts"] for r in df.orderBy("ts").collect()] == [0, 40]


def test_a_repeat_does_not_extend_its_stay(spark):
    data = [(0, "a", 0, "x"), (1, "a", 8, "x"), (2, "a", 9, "y"), (3, "a", 12, "z")]
    df = P.sliding_distinct(spark.createDataFrame(data, SCHEMA), ["key"], "ts", "v", 10, "event_id")
    assert by_id(df, "n") == [1, 1, 2, 2]


def test_anchors_of_random_rows(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("abc"), rng.randrange(60), "x") for i in range(300)]
    got = {r["event_id"]: r["anchor"] for r in P.anchored_window(spark.createDataFrame(data, SCHEMA), ["key"], "ts", 7, "event_id").collect()}
    want, anchor = {}, {}
    for i, k, t, _ in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        if k not in anchor or t - anchor[k] > 7:
            anchor[k] = t
        want[i] = anchor[k]
    assert got == want


@pytest.mark.parametrize("strict, opens", [(True, [True, False, True]), (False, [True, True, False])])
def test_edge_of_an_anchored_window(spark, strict, opens):
    df = P.anchored_window(rows(spark, [0, 10, 11]), ["key"], "ts", 10, "event_id", strict=strict)
    assert by_id(df, "anchor_opens") == opens


def test_empty_table(spark):
    assert P.suppress_within(rows(spark, [1]).where("false"), ["key"], "ts", 5, "event_id").count() == 0


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(10, "a", 5), (11, "a", 1)], "event_id long, key string, ts long")
    right = spark.createDataFrame([(1, "a", 2, "old"), (2, "a", 4, "new"), (3, "a", 6, "later")], "event_id long, key string, ts long, name string")
    got = {r["event_id"]: r["prior_name"] for r in P.latest_before(left, right, ["key"], "ts", "event_id", ["name"]).collect()}
    assert got == {10: "new", 11: None}


def test_unknown_generation_matches(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 2)], "a int, b int").select(P.same_generation(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, False, True]


def test_rule_tables_of_any_size_hold_whole(spark):
    n = 10_500
    definitions = [(f"r{i}", "low", "comm", "equals", f"V{i}") for i in range(n)] + [("both", "high", "Comm", "startswith", "v"), ("both", "high", "cmdline", "contains", "x"), ("null", "low", "comm", "equals", None)]
    table = spark.createDataFrame(definitions, "rule_id string, level string, field string, modifier string, value string")
    ev = spark.createDataFrame([(i, f"v{i}", "aXb" if i % 2 else None) for i in (0, 1, 9_999, 10_000, n - 1, n)], "event_id long, comm string, cmdline string")
    got = sorted((r["event_id"], r["rule_id"]) for r in rules.sigma(ev, table).collect())
    assert got == sorted([(i, f"r{i}") for i in (0, 1, 9_999, 10_000, n - 1)] + [(i, "both") for i in (1, 9_999, n - 1)])
    assert rules.sigma(ev, table.limit(0)).count() == 0
