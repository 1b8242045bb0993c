"""Parsers and ingestion on small written samples, and streams against their batch forms."""

import hashlib
import json

from pyspark.sql import functions as F

from wardlake.operators.rules import detect
from wardlake.plans.telemetry import telemetry
from wardlake.sources import ingest, logs
from wardlake.streaming import jobs


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_access_log(spark):
    good = '10.0.0.9 - bob [01/Jan/2026:00:00:00 +0000] "GET /a?x=\\"1\\" HTTP/1.1" 404 - "-" "curl/8"'
    got = logs.parse_access_log(lines(spark, good, '10.0.0.9 - - [x] "GET /cut', "noise")).collect()
    r = next(x for x in got if x["parse_status"] == "ok")
    assert (r["client"], r["user"], r["status"], r["bytes"], r["user_agent"]) == ("10.0.0.9", "bob", 404, None, "curl/8")
    assert sorted(x["parse_status"] for x in got) == ["error", "ok", "truncated"]


def test_mysql_log(spark):
    a = "2026-01-01 [Note] Access denied for user 'o'@'x'@'203.0.113.7' (using password: YES)"
    b = "Access denied for user 'bob'@'localhost' to database 'd'"
    c = "Access denied for user 'eve'@'localhost' (using password: NO)"
    got = [(r["target_user"], r["source_address"], r["used_password"]) for r in logs.parse_mysql_error_log(lines(spark, a, b, c)).collect()]
    assert got == [("o'@'x", "203.0.113.7", True), ("eve", None, False)]


def test_audit_log(spark):
    a = 'type=EXECVE msg=audit(1.2:7): argc=3 a0="sh" a1=2D63 a2="4142"'
    b = "type=SOCKADDR msg=audit(1.2:8): saddr=020001BBCB0071090000000000000000"
    got = {r["record"]: r for r in logs.parse_audit_log(lines(spark, a, b)).collect()}
    assert got["EXECVE"]["argv"] == ["sh", "-c", "4142"] and got["EXECVE"]["serial"] == 7
    assert (got["SOCKADDR"]["address"], got["SOCKADDR"]["port"]) == ("203.0.113.9", 443)


def test_journal_and_unified_log(spark):
    j = [{"_COMM": "sshd", "MESSAGE": "Failed password for invalid user eve from 203.0.113.1 port 1 ssh2"}, {"_COMM": "sudo", "MESSAGE": "bob : TTY=1 ; USER=root ; COMMAND=/bin/ls"}, {"MESSAGE": "Started x.service"}, {"MESSAGE": "?"}]
    got = [(r["kind"], r["target_user"], r["outcome"]) for r in logs.parse_journal(lines(spark, *map(json.dumps, j))).collect()]
    assert got == [("ssh_failed", "eve", "failure"), ("sudo", "root", "privileged_session"), ("unit_started", None, None), (None, None, None)]
    u = [{"process": "tccd", "subsystem": "com.apple.TCC", "eventMessage": "AUTHREQ_RESULT: msgID=3.1, authValue=2"}]
    r = logs.parse_unified_log(lines(spark, *map(json.dumps, u))).first()
    assert (r["kind"], r["message_id"], r["auth_value"]) == ("tcc_result", "3.1", 2)


def test_event_xml(spark, tmp_path):
    one = '<Event><System><EventID>{e}</EventID><Channel>Security</Channel><EventRecordID>5</EventRecordID></System><EventData><Data Name="TargetUserName">bob</Data><Data Name="SubjectUserName">adm</Data><Data Name="IpAddress">-</Data></EventData></Event>'
    (tmp_path / "a.xml").write_text("<Events>" + one.format(e=4625) + one.format(e=4672) + "</Events>")
    got = sorted((r["event_id"], r["kind"], r["user"], r["source_address"]) for r in logs.parse_evtx_xml(spark, str(tmp_path)).collect())
    assert got == [(4625, "logon_failure", "bob", None), (4672, "privileged_session", "adm", None)]


def test_actions_of_tasks(spark):
    cases = {
        "<Exec><Command>a</Command></Exec>": "a",
        "<Exec/><ComHandler/>": None,
        "<Exec id='x'><Command> a </Command><Arguments> -b </Arguments></Exec><ComHandler><ClassId>{1}</ClassId></ComHandler>": "a -b | com:{1}",
        "<ExecutionTimeLimit>P1</ExecutionTimeLimit><SendEmail><Command>no</Command></SendEmail>": None,
        "".join(f"<Exec><Command>c{i}</Command></Exec>" for i in range(40)): " | ".join(f"c{i}" for i in range(32)),
        "": None,
        "<Exec><Command>never closed": None,
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", logs.task_actions(F.col("x")).alias("a"))
    assert {r["x"]: r["a"] for r in df.collect()} == cases
    odd = lines(spark, "no xml", "", "<Event><System><EventID>7045</EventID></System></Event>", "<Event><System>")
    assert logs.parse_event_xml(odd.unionByName(spark.createDataFrame([(None,)], "value string"))).count() == 0


def test_uploads(spark):
    good = json.dumps({"agent_id": "a", "events": [{"type": "exec"}, 5, {"x": 1}]})
    large = json.dumps({"agent_id": "b", "events": [{"type": "exec"}] * 4})
    events, rejected = ingest.explode_batches(spark.createDataFrame([(good,), (large,), ("{",)], "body string"), most=3)
    assert [json.loads(r["event"]) for r in events.collect()] == [{"type": "exec"}] and rejected.count() == 2


def test_time_is_clamped(spark):
    df = spark.createDataFrame([(None, 5_000_000), (-1, 5_000_000), (1_999_999, 5_000_000), (10**18, 5_000_000)], "t long, r long")
    assert [x[0] for x in df.select(ingest.clamp_event_time(F.col("t"), F.col("r"))).collect()] == [5_000_000, 5_000_000, 1_000_000, 5_000_000]


def test_detections_of_both_forms(spark):
    new = json.dumps({"severity": "HIGH", "source": {"engine": "sigma", "rule_id": "r1"}, "techniques": ["T1", "T2"], "events": ["{}", "x"]})
    old = json.dumps({"severity": "low", "source": {"engine": "bayes"}})
    got = [(r["technique"], r["severity"], r["source_id"], r["additional_events"]) for r in ingest.normalise_detections(spark.createDataFrame([(new,), (old,)], "body string")).collect()]
    assert got == [("T1", "high", "r1", ["x"]), ("BAYES", "low", None, None)]


def test_ingest_is_idempotent(spark):
    rows = spark.createDataFrame([("a", "1", "x", 1), ("a", "1", "x", 2), ("a", "1", "y", 3), ("a", None, "x", 4), ("a", None, "x", 5)], "agent_id string, ingest_id string, body string, n long")
    kept, conflicts = ingest.dedup_ingest(rows, ["agent_id", "ingest_id"], "body", ["n"])
    assert sorted(r["n"] for r in kept.collect()) == [1, 4, 5] and [r["n"] for r in conflicts.collect()] == [3]


def test_files_and_corpora(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"abc")
    (tmp_path / "in/b").write_bytes(b"x" * 50)
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in ingest.hash_files(spark, str(tmp_path / "in/*"), 10).collect()}
    assert got == {"a": hashlib.sha256(b"abc").hexdigest(), "b": None}
    samples = spark.createDataFrame([("v1", "b1", t, f"s{t}") for t in (3, 1, 2)] + [("v2", "b2", 1, "z")], "version string, batch_id string, timestamp_ns long, sample string")
    taken, counts = ingest.submit_corpus(samples, spark.createDataFrame([("v1", "collecting"), ("v2", "final")], "version string, status string"))
    assert taken.count() == 3 and counts.first()["samples"] == 3
    m = ingest.export_corpus(taken, "v1", str(tmp_path / "out"))
    assert m.agg(F.sum("samples")).first()[0] == 3
    assert ingest.verify_manifest(m, m).count() == 0


def test_jsonl_capture(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"type":"exec","meta":{"pid":7,"timestamp_ns":5}}\n{"type":"exe\n{"type":"brand_new","meta":{"pid":8}}\n')
    assert sorted((r["type"], r["meta"]["pid"]) for r in ingest.read_events(spark, str(tmp_path)).collect()) == [("brand_new", 8), ("exec", 7)]


def test_streams_give_the_batch_rows(spark, data, tmp_path):
    ev = telemetry(spark, data).orderBy("ts_us").limit(400)
    ev.repartition(3).write.parquet(str(tmp_path / "ev"))
    batch = spark.read.parquet(str(tmp_path / "ev"))
    source = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    jobs.stream_detections(source(), str(tmp_path / "det"), str(tmp_path / "c1")).awaitTermination()
    want = detect(batch)
    got = spark.read.schema(want.schema).json(str(tmp_path / "det"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_event_xml_is_parsed_once(spark):
    rows = logs.parse_event_xml(spark.createDataFrame([("<Event/>",)], "value string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
