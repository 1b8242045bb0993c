"""Queries of the ingestion operators: raw lines are written out of the telemetry by Spark and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest, logs
from .queries import _own_folder, on_ev, register
from .telemetry import of_type, telemetry


def _lines(ev, *parts):
    return ev.select("event_id", F.concat(*parts).alias("value"))


@on_ev("parse_access_log", "SELECT event_id, daddr AS client, CASE WHEN k % 2 = 0 THEN comm END AS \"user\", 'GET ' || path || ' HTTP/1.1' AS request, (200 + k)::INT AS status, CASE WHEN k % 3 != 0 THEN k END AS bytes, CASE WHEN k % 5 = 0 THEN 'truncated' ELSE 'ok' END AS parse_status FROM ev WHERE k % 5 != 0")
def _(ev):
    n = F.col("k").cast("string")
    lines = _lines(ev.where("k % 5 != 0"), F.col("daddr"), F.lit(" - "), F.when(F.col("k") % 2 == 0, F.col("comm")).otherwise("-"), F.lit(' [01/Jan/2026:00:00:00 +0000] "GET '), "path", F.lit(' HTTP/1.1" '), (200 + F.col("k")).cast("string"), F.lit(" "), F.when(F.col("k") % 3 == 0, "-").otherwise(n))
    return logs.parse_access_log(lines).select("event_id", "client", "user", "request", "status", "bytes", "parse_status")


@on_ev("parse_mysql_failed_logins", "SELECT event_id, target_user, CASE WHEN k % 2 = 0 THEN daddr END AS source_address, k % 3 = 0 AS used_password FROM ev WHERE type = 'auth' AND k % 7 != 0")
def _(ev):
    source = F.when(F.col("k") % 2 == 0, F.col("daddr")).otherwise("localhost")
    tail = F.when(F.col("k") % 7 == 0, "to database 'x'").otherwise(F.concat(F.lit("(using password: "), F.when(F.col("k") % 3 == 0, "YES").otherwise("NO"), F.lit(")")))
    lines = _lines(of_type(ev, "auth"), F.lit("[Note] Access denied for user '"), "target_user", F.lit("'@'"), source, F.lit("' "), tail)
    return logs.parse_mysql_error_log(lines).select("event_id", "target_user", "source_address", "used_password")


@on_ev("parse_audit_log", "SELECT event_id, 'EXECVE' AS record, k AS serial, comm || '|' || cmdline AS args FROM ev WHERE type = 'exec'")
def _(ev):
    lines = _lines(of_type(ev, "exec"), F.lit("type=EXECVE msg=audit(1.5:"), F.col("k").cast("string"), F.lit('): argc=2 a0="'), "comm", F.lit('" a1='), F.hex(F.col("cmdline").cast("binary")))
    return logs.parse_audit_log(lines).select("event_id", "record", "serial", F.array_join("argv", "|").alias("args"))


@on_ev("parse_journal", "SELECT event_id, CASE outcome WHEN 'success' THEN 'ssh_accepted' ELSE 'ssh_failed' END AS kind, target_user, daddr AS source_address, outcome FROM ev WHERE type = 'auth'")
def _(ev):
    word = F.when(F.col("outcome") == "success", "Accepted").otherwise("Failed")
    message = F.concat(word, F.lit(" password for "), "target_user", F.lit(" from "), "daddr", F.lit(" port 22 ssh2"))
    lines = of_type(ev, "auth").select("event_id", F.to_json(F.struct(F.lit("sshd").alias("_COMM"), message.alias("MESSAGE"))).alias("value"))
    return logs.parse_journal(lines).select("event_id", "kind", "target_user", "source_address", "outcome")


@on_ev("parse_unified_log", "SELECT event_id, CASE WHEN k % 2 = 0 THEN 'tcc_result' ELSE 'sudo' END AS kind, CASE WHEN k % 2 = 0 THEN (k % 3)::INT END AS auth_value FROM ev")
def _(ev):
    even = F.col("k") % 2 == 0
    message = F.when(even, F.concat(F.lit("AUTHREQ_RESULT: msgID=1, authValue="), (F.col("k") % 3).cast("string"))).otherwise("TTY=1 ; COMMAND=/bin/ls")
    body = F.struct(message.alias("eventMessage"), F.when(even, "tccd").otherwise("sudo").alias("process"), F.when(even, "com.apple.TCC").alias("subsystem"))
    return logs.parse_unified_log(ev.select("event_id", F.to_json(body).alias("value"))).select("event_id", "kind", "auth_value")


#: Events of every kind as XML, with nested definitions of tasks, escaped signs, and what can't be read.
_XML_ID = "CASE k % 12 WHEN 0 THEN 7045 WHEN 1 THEN 4698 WHEN 2 THEN 4702 WHEN 3 THEN 4720 WHEN 4 THEN 4624 WHEN 5 THEN 4625 WHEN 6 THEN 4648 WHEN 7 THEN 4672 WHEN 8 THEN 8004 WHEN 9 THEN 106 WHEN 10 THEN 1 ELSE 8003 END"
_XML_SQL = f"""x AS (SELECT *, {_XML_ID} AS e FROM ev WHERE k % 25 != 24)
SELECT event_id, e::INT AS event_code, CASE e WHEN 7045 THEN 'service' WHEN 4698 THEN 'task' WHEN 4702 THEN 'task' WHEN 106 THEN 'task' WHEN 4720 THEN 'account' WHEN 4624 THEN 'logon' WHEN 4648 THEN 'logon' WHEN 4625 THEN 'logon_failure' WHEN 4672 THEN 'privileged_session' WHEN 1 THEN NULL ELSE 'applocker' END AS kind,
 event_id + 7 AS record_id, CASE WHEN e IN (4698, 4702) THEN ppid WHEN e > 8000 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE ppid END ELSE pid END AS pid,
 CASE WHEN e = 4672 THEN comm WHEN e IN (4624, 4625, 4648, 4720) THEN CASE WHEN k % 3 != 0 THEN target_user END WHEN e > 8000 THEN target_user END AS user, CASE WHEN e = 4672 THEN 'S-sub' WHEN e = 4720 THEN 'S-new' WHEN e IN (4624, 4625, 4648) THEN 'S-tgt' END AS user_sid,
 CASE WHEN e IN (4624, 4625, 4648) AND k % 2 = 1 THEN daddr END AS source_address, CASE WHEN e = 4625 THEN '0xC1/0x' || k::VARCHAR END AS status,
 CASE WHEN e = 7045 THEN 'svc' || k::VARCHAR WHEN e IN (4698, 4702, 106) THEN chr(92) || 'T' || chr(92) || k::VARCHAR WHEN e > 8000 THEN 'EXE' END AS name,
 CASE WHEN e = 7045 THEN image_path WHEN e IN (4698, 4702) THEN CASE k % 5 WHEN 0 THEN '<action unknown>' WHEN 1 THEN 'a.exe' WHEN 2 THEN 'a.exe ' || cmdline || ' | com:{{C}}' ELSE 'com:{{C}} | b.exe -x' END
  WHEN e > 8000 THEN CASE WHEN k % 4 = 0 THEN 'C:' || chr(92) || 'a & b.exe' WHEN k % 4 = 3 THEN 'C:' || chr(92) || 'Windows' || chr(92) || 'System32' || chr(92) || 'x.exe' ELSE '%HOT%' || chr(92) || 'x' END END AS path FROM x"""


def _xml(ev):
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    data = lambda name, value: text(f"<Data Name='{name}'>", value, "</Data>")
    k = F.col("k")
    n = k.cast("string")
    execs = lambda inner: text("<Exec id='A'>", inner, "</Exec>")
    handler = F.lit("<ComHandler><ClassId> {C} </ClassId><Data>x</Data></ComHandler>")
    actions = (
        F.when(k % 5 == 0, text("<Exec/>", execs(F.lit("<Arguments>-x</Arguments>"))))
        .when(k % 5 == 1, execs(F.lit("<Command> a.exe </Command><Arguments> </Arguments>")))
        .when(k % 5 == 2, text(execs(text("<Command>a.exe</Command><Arguments>", F.col("cmdline"), "</Arguments>")), handler))
        .otherwise(text("<ExecutionTimeLimit>P1</ExecutionTimeLimit>", handler, execs(F.lit("<Command>b.exe</Command><Arguments>-x</Arguments>"))))
    )
    task = safe(text("<?xml version='1.0'?><Task><Actions>", actions, "</Actions></Task>"))
    user = F.when(k % 3 == 0, "-").otherwise(F.col("target_user"))
    plain = text(
        data("ServiceName", text("svc", n)), data("ImagePath", text(safe(F.col("image_path")), " ")), data("TaskName", text("\\T\\", n)), data("TaskContent", F.when(F.expr(_XML_ID) == 4698, task).otherwise("")), data("TaskContentNew", F.when(F.expr(_XML_ID) == 4702, task).otherwise("")),
        data("ClientProcessId", F.col("ppid").cast("string")), data("TargetUserName", user), data("SubjectUserName", F.col("comm")), data("SubjectUserSid", F.lit("S-sub")), data("TargetSid", F.lit("S-new")), data("TargetUserSid", F.lit("S-tgt")),
        data("IpAddress", F.when(k % 2 == 1, F.col("daddr")).otherwise("-")), data("Status", F.lit("0xC1")), data("SubStatus", text("0x", n)),
    )
    file = F.when(k % 4 == 0, text("<FilePath>%OSDRIVE%\\x</FilePath><FullFilePath>C:\\a &amp; b.exe</FullFilePath>")).when(k % 4 == 3, text("<FilePath>%System32%\\x.exe</FilePath><FullFilePath></FullFilePath>")).otherwise(text("<FilePath>%HOT%\\x</FilePath>"))
    policy = text("<UserData><RuleAndFileData><PolicyName>EXE</PolicyName><TargetUser>", F.col("target_user"), "</TargetUser><TargetProcessId>", F.when(k % 5 == 0, "?").otherwise(F.col("ppid").cast("string")), "</TargetProcessId>", file, "</RuleAndFileData></UserData>")
    record = F.when(k % 25 == 24, "").otherwise((F.col("event_id") + 7).cast("string"))
    head = text("<Event xmlns='urn:x'><System><Provider Name='p'/><EventID Qualifiers='1'>", F.expr(_XML_ID).cast("string"), "</EventID><EventRecordID>", record, "</EventRecordID><Execution ProcessID='", F.col("pid").cast("string"), "' ThreadID='1'/><Channel>c</Channel></System>")
    return ev.select(F.col("event_id").alias("source_id"), text(head, F.when(F.expr(_XML_ID) > 8000, policy).otherwise(text("<EventData>", plain, "</EventData>")), "</Event>").alias("value"))


@on_ev("parse_windows_event_xml", _XML_SQL.split("\n", 1)[1], _XML_SQL.split("\n", 1)[0])
def _(ev):
    kept = ["kind", "record_id", "pid", "user", "user_sid", "source_address", "status", "name", "path"]
    return logs.parse_event_xml(_xml(ev)).select(F.col("source_id").alias("event_id"), F.col("event_id").alias("event_code"), *kept)


@on_ev("explode_batches", "SELECT agent_id, event_id FROM ev WHERE type != 'auth'")
def _(ev):
    one = F.to_json(F.struct(F.when(F.col("type") != "auth", F.col("type")).alias("type"), "event_id"))
    # events are parsed out of the upload's text again
    uploads = ev.groupBy("agent_id", F.floor(F.col("event_id") / 100).alias("part")).agg(F.concat(F.lit('{"agent_id":"'), F.first("agent_id"), F.lit('","events":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("body")).select("body")
    events, _ = ingest.explode_batches(uploads)
    return events.select("agent_id", F.get_json_object("event", "$.event_id").cast("long").alias("event_id"))


@on_ev("clamp_event_time", "SELECT event_id, CASE WHEN k % 4 = 0 THEN 5000000000 WHEN k % 4 = 1 THEN 5000000000 ELSE k * 1000000 END AS ts_ns FROM ev")
def _(ev):
    ts = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, -F.col("k")).otherwise(F.col("k") * 1_000_000 + 999)
    return ev.select("event_id", ingest.clamp_event_time(ts.cast("long"), F.lit(5_000_000_000)).alias("ts_ns"))


@on_ev("normalise_detections", "SELECT event_id, CASE WHEN k % 2 = 0 THEN technique ELSE 'BAYES' END AS technique, severity, CASE WHEN k % 2 = 0 THEN 'r' || k::VARCHAR END AS source_id FROM ev")
def _(ev):
    even = F.col("k") % 2 == 0
    body = F.to_json(F.struct(F.upper("severity").alias("severity"), F.struct(F.when(even, "sigma").otherwise("bayes").alias("engine"), F.when(even, F.concat(F.lit("r"), F.col("k").cast("string"))).alias("rule_id")).alias("source"), F.when(even, F.array("technique")).alias("techniques")))
    return ingest.normalise_detections(ev.select("event_id", body.alias("body"))).select("event_id", "technique", "severity", "source_id")


@on_ev("idempotent_ingest", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, k ORDER BY ts_us, event_id) AS n FROM ev) WHERE n = 1 OR k % 10 = 0")
def _(ev):
    rows = ev.withColumn("ingest_id", F.when(F.col("k") % 10 != 0, F.col("k")))
    return ingest.dedup_ingest(rows, ["agent_id", "ingest_id"], "comm", ["ts_us", "event_id"])[0].select("event_id")


@on_ev("ingest_conflicts", "SELECT event_id FROM (SELECT *, first_value(type) OVER (PARTITION BY agent_id, k ORDER BY ts_us, event_id) AS f FROM ev) WHERE type != f")
def _(ev):
    return ingest.dedup_ingest(ev.withColumn("ingest_id", F.col("k")), ["agent_id", "ingest_id"], "type", ["ts_us", "event_id"])[1].select("event_id")


@on_ev("corpus_submit", "SELECT 'v' || (k % 4)::VARCHAR AS version, count(*) AS samples FROM ev WHERE k % 4 < 2 GROUP BY ALL")
def _(ev):
    samples = ev.select(F.concat(F.lit("v"), (F.col("k") % 4).cast("string")).alias("version"), F.floor(F.col("event_id") / 500).alias("batch_id"), "event_id")
    versions = ev.sparkSession.createDataFrame([("v0", "collecting"), ("v1", "collecting"), ("v2", "final")], "version string, status string")
    return ingest.submit_corpus(samples, versions)[1]


@on_ev("json_flatten", "SELECT event_id, CASE WHEN type = 'file_open' THEN 'fileopen' ELSE type END AS type, daddr FROM ev WHERE type IN ('exec', 'connect', 'file_open')")
def _(ev):
    raw = ev.select("event_id", F.to_json(F.struct("type", F.when(F.col("k") % 2 == 0, F.col("daddr")).alias("daddr"), F.when(F.col("k") % 2 == 1, F.transform(F.split("daddr", r"\."), lambda x: x.cast("int"))).alias("daddr_v4"))).alias("j"))
    j = raw.withColumn("j", F.from_json("j", "type string, daddr string, daddr_v4 array<int>"))
    kind = F.when(F.col("j.type") == "file_open", "fileopen").otherwise(F.col("j.type"))
    return j.where(F.col("j.type").isin("exec", "connect", "file_open")).select("event_id", kind.alias("type"), F.coalesce("j.daddr", F.array_join("j.daddr_v4", ".")).alias("daddr"))


@on_ev("alert_rows", "SELECT event_id, ts_us * 1000 AS timestamp_ns, technique, 'pid=' || pid::VARCHAR || ' comm=' || comm AS message FROM ev WHERE severity = 'critical'")
def _(ev):
    return ev.where("severity = 'critical'").select("event_id", (F.col("ts_us") * 1000).alias("timestamp_ns"), "technique", F.concat(F.lit("pid="), F.col("pid").cast("string"), F.lit(" comm="), "comm").alias("message"))


@register("hash_files")
def _(spark, d):
    return ingest.hash_files(spark, f"{d}/nation.parquet").select("length", "sha256")


@register("capture_roundtrip")
def _(spark, d):
    from uuid import uuid4

    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    at = f"{folder}/capture-{uuid4().hex}"
    meta = F.struct("pid", "ppid", (F.col("ts_us") * 1000).alias("timestamp_ns"), "comm")
    telemetry(spark, d).select("type", meta.alias("meta"), "image_path", "daddr", "dport").write.json(at)
    return ingest.read_events(spark, at).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("meta.timestamp_ns").alias("first_ns"))
