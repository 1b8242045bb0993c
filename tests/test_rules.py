"""Rules and grouping on small cases: nulls, distances in bytes, open cases that move."""

from pyspark.sql import functions as F

from wardlake.operators import cases, rules


def scans(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, content string, app_name string, scan_result long").withColumn("type", F.lit("script_scan"))
    absent = {c: F.lit(None).cast("string") for c in ("cmdline", "path", "image_path", "comm", "daddr")} | {c: F.lit(None).cast("long") for c in ("flags", "dport")}
    found = rules.detect(df.withColumns(absent), [r.name for r in rules.rules() if r.type == "script_scan"], ("event_id",))
    return sorted((r.event_id, r.rule) for r in found.collect())


def test_scan_without_text_is_judged_by_its_result_alone(spark):
    assert scans(spark, [(1, None, None, 40000), (2, None, None, 1), (3, "", None, None)]) == [(1, "scan_provider_detected")]


def test_cradle_distance_is_in_bytes(spark):
    far = "iwr " + "é" * 148 + "iex "  # 4 + 296 bytes, but a letter stands before the word
    near, over = "iwr " + "€" * 98 + " iex", "iwr " + "€" * 99 + " iex"  # 4 + 294 + 1 and 4 + 297 + 1 bytes
    assert scans(spark, [(1, far, "x", 0), (2, near, "x", 0), (3, over, "x", 0)]) == [(2, "download_cradle")]


def test_manifest_is_no_cradle(spark):
    text = "\n@{ CmdletsToExport = 'Invoke-WebRequest', 'Invoke-Expression' }"
    assert scans(spark, [(1, text, "x", 0), (2, text.replace("@", ""), "x", 0)]) == [(2, "download_cradle")]


def test_request_without_target_or_agent(spark):
    rows = [(1, None, None, None), (2, "/a?x=../y", None, 200), (3, "/wso.php", None, 500), (4, "/", "SQLMAP", None)]
    df = spark.createDataFrame(rows, "id long, target string, agent string, status int")
    got = {r.id: r.h and r.h.asDict() for r in df.select("id", rules.http_signature(F.col("target"), F.col("agent"), F.col("status")).alias("h")).collect()}
    assert got[1] is None and got[3] is None
    assert got[2] == {"signature": "path_traversal", "name": "x", "value": "../y", "scanner": None}
    assert got[4]["scanner"] == "sqlmap"


def attach(spark, detections, known):
    d = spark.createDataFrame([("t", "a", t, e, tech) for e, t, tech in detections], "tenant_id string, agent_id string, ts_us long, event_id long, technique string")
    o = spark.createDataFrame([("t", "a", b, c, s) for c, s, b in known], "tenant_id string, agent_id string, base_technique string, case_id long, case_start long")
    return {r.event_id: (r.case_id, r.opened_by) for r in cases.attach_detections(d, o, 10).collect()}


def test_an_earlier_detection_moves_a_case(spark):
    # 95 joins the case of 100 and moves its start, so 106 is too late for it
    got = attach(spark, [(1, 95, "T1.001"), (2, 105, "T1"), (3, 106, "T1.002"), (4, 96, "T2")], [(7, 100, "T1")])
    assert got == {1: (7, None), 2: (7, None), 3: (None, 3), 4: (None, 4)}


def test_open_cases_are_tried_by_id_and_before_new_ones(spark):
    got = attach(spark, [(1, 80, "T1"), (2, 89, "T1"), (3, 90, "T1")], [(9, 99, "T1"), (8, 100, "T1")])
    assert got == {1: (None, 1), 2: (9, None), 3: (8, None)}


def test_no_open_cases(spark):
    assert attach(spark, [(1, 5, "T1"), (2, 15, "T1"), (3, 16, "T1")], []) == {1: (None, 1), 2: (None, 1), 3: (None, 3)}
