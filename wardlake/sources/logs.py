"""Raw lines to typed rows. All parsers are projections over a text column, in batch and over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = r'"((?:[^"\\]|\\.)*)"'
ACCESS = rf'^(\S+) \S+ (\S+) \[([^\]]*)\] {_QUOTED} ([0-9]{{3}}) (\S+)(?: {_QUOTED} {_QUOTED})?'


def parse_access_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Common and combined formats: client, user, time, request, status, bytes, referer, user agent; parse_status tells
    ok, truncated (an open quote) or error."""
    part = lambda i: F.nullif(F.regexp_extract(line, ACCESS, i), F.lit(""))
    status = part(5).try_cast("int")
    ok = status.between(100, 599)
    quotes = F.length(F.regexp_replace(line, r'\\.|[^"]', ""))
    return lines.select(
        "*",
        part(1).alias("client"),
        F.nullif(part(2), F.lit("-")).alias("user"),
        part(3).alias("time"),
        part(4).alias("request"),
        status.alias("status"),
        F.nullif(part(6), F.lit("-")).try_cast("long").alias("bytes"),
        part(7).alias("referer"),
        part(8).alias("user_agent"),
        F.when(F.coalesce(ok, F.lit(False)), "ok").when(quotes % 2 == 1, "truncated").otherwise("error").alias("parse_status"),
    )


def parse_mysql_error_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Failed logins: user and source (split at the last '@'), whether a password was used; other lines go."""
    pattern = r"Access denied for user '(.*)'@'([^']*)'(?: \(using password: (YES|NO)\))?"
    rows = lines.where(F.contains(line, F.lit("Access denied for user '")) & ~F.contains(line, F.lit("to database")))
    source = F.regexp_extract(line, pattern, 2)
    is_ip = source.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | source.rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:]*$")
    return rows.where(F.col(line).rlike(pattern)).select(
        "*", F.regexp_extract(line, pattern, 1).alias("target_user"), F.when(is_ip, source).alias("source_address"), (F.regexp_extract(line, pattern, 3) == "YES").alias("used_password"), F.lit("failure").alias("outcome")
    )


def _unhexed(value: Column) -> Column:
    """Quoted values as they are, others from hex where they are hex."""
    plain = F.regexp_extract(value, r'^"(.*)"$', 1)
    return F.when(value.startswith('"'), plain).when(value.rlike("^([0-9A-Fa-f]{2})+$"), F.decode(F.unhex(value), "UTF-8")).otherwise(value)


def parse_audit_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """key=value records: record type, arguments of EXECVE, address and port of SOCKADDR."""
    pairs = F.regexp_extract_all(line, F.lit(r'(\w+=(?:"[^"]*"|\S+))'), F.lit(1))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value"))
    rows = lines.withColumn("__pairs", F.transform(pairs, entry)).withColumn("record", F.regexp_extract(line, r"^type=(\w+)", 1))
    value = lambda name: F.get(F.filter("__pairs", lambda p: p["key"] == name), F.lit(0))["value"]
    argc = F.coalesce(value("argc").try_cast("int"), F.lit(0))
    args = F.filter("__pairs", lambda p: p["key"].rlike("^a[0-9]+$"))
    ordered = F.array_sort(F.transform(args, lambda p: F.struct(F.substring(p["key"], 2, 9).cast("int").alias("i"), p["value"].alias("v"))))
    saddr = value("saddr")
    byte = lambda at: F.conv(F.substring(saddr, at, 2), 16, 10)
    v4 = F.startswith(saddr, F.lit("0200"))
    return rows.select(
        *lines.columns,
        "record",
        F.regexp_extract(line, r"audit\(([0-9.]+):([0-9]+)\)", 2).try_cast("long").alias("serial"),
        F.when((F.col("record") == "EXECVE") & (argc > 0), F.transform(ordered, lambda x: _unhexed(x["v"]))).alias("argv"),
        F.when(v4, F.concat_ws(".", byte(9), byte(11), byte(13), byte(15))).alias("address"),
        F.when(v4, F.conv(F.substring(saddr, 5, 4), 16, 10).cast("int")).alias("port"),
    )


def parse_journal(lines: DataFrame, line: str = "value") -> DataFrame:
    """journald JSON: ssh logins, sudo, unit starts; what is none of them has a null kind."""
    j = F.from_json(line, "MESSAGE string, _COMM string, _PID string, _SYSTEMD_UNIT string, __REALTIME_TIMESTAMP string")
    message, comm = F.col("j.MESSAGE"), F.col("j._COMM")
    ssh = r"^(Accepted|Failed) (\S+) for (?:invalid user )?(\S+) from (\S+)"
    kind = (
        F.when((comm == "sshd") & message.rlike(r"^Accepted "), "ssh_accepted")
        .when((comm == "sshd") & message.rlike(r"^Failed "), "ssh_failed")
        .when((comm == "sudo") & message.rlike("COMMAND="), "sudo")
        .when(message.rlike("^pam_unix.*session opened"), "session")
        .when(message.rlike(r"^Started "), "unit_started")
        .when(message.rlike(r"^Stopped "), "unit_stopped")
        .when(message.rlike(r"^Failed to start "), "unit_failed")
    )
    user = F.nullif(F.when(comm == "sshd", F.regexp_extract(message, ssh, 3)).otherwise(F.regexp_extract(message, r"USER=(\S+)", 1)), F.lit(""))
    return lines.withColumn("j", j).select(
        *lines.columns, (F.col("j.__REALTIME_TIMESTAMP").try_cast("long") * 1000).alias("timestamp_ns"), kind.alias("kind"), user.alias("target_user"), F.nullif(F.regexp_extract(message, ssh, 4), F.lit("")).alias("source_address"),
        F.when((kind == "sudo") & (user == "root"), "privileged_session").when(kind == "ssh_failed", "failure").when(kind.isin("ssh_accepted", "sudo", "session"), "success").alias("outcome"),
    )


def parse_unified_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """macOS log NDJSON: sudo, privacy decisions, code scans."""
    j = F.from_json(line, "eventMessage string, process string, subsystem string, timestamp string")
    message = F.col("j.eventMessage")
    kind = (
        F.when((F.col("j.process") == "sudo") & message.rlike("COMMAND="), "sudo")
        .when((F.col("j.process") == "sudo") & message.rlike("incorrect password"), "sudo_failed")
        .when((F.col("j.subsystem") == "com.apple.TCC") & message.rlike("AUTHREQ_CTX"), "tcc_context")
        .when((F.col("j.subsystem") == "com.apple.TCC") & message.rlike("AUTHREQ_RESULT"), "tcc_result")
        .when(message.rlike("GK (evaluateScanResult|scan complete)"), "gatekeeper_scan")
    )
    return lines.withColumn("j", j).select(*lines.columns, kind.alias("kind"), F.regexp_extract(message, r"msgID=([0-9.]+)", 1).alias("message_id"), F.nullif(F.regexp_extract(message, r"authValue=([0-9]+)", 1), F.lit("")).try_cast("int").alias("auth_value"))


#: Events of each kind; more than so many actions no task has; what stands between them, and for none; variables of paths and what they mean by default.
TASK_CREATED, TASK_UPDATED, TASK_REGISTERED, SERVICE, ACCOUNT = 4698, 4702, 106, 7045, 4720
LOGON, LOGON_FAILED, LOGON_EXPLICIT, PRIVILEGES = 4624, 4625, 4648, 4672
APPLOCKER = [8003, 8004]
TASK_ACTIONS, ACTION_SEPARATOR, ACTION_UNKNOWN = 32, " | ", "<action unknown>"
PATH_VARIABLES = {"%OSDRIVE%": "C:", "%WINDIR%": "C:\\Windows", "%SYSTEM32%": "C:\\Windows\\System32", "%PROGRAMFILES%": "C:\\Program Files"}
EVENT = (
    "System struct<EventID:string, EventRecordID:string, Channel:string, Execution:struct<_ProcessID:string>>, EventData struct<Data:array<struct<_Name:string, _VALUE:string>>>, "
    "UserData struct<RuleAndFileData:struct<PolicyName:string, TargetUser:string, TargetProcessId:string, FilePath:string, FullFilePath:string>>"
)


def task_actions(definition: Column) -> Column:
    """The actions of a task's definition in order: command lines, and com:CLASS for a handler; null if there is none that can be read."""
    element = r"(?s)<(?:Exec|ComHandler)(?:\s[^>]*)?(?:/>|>.*?</(?:Exec|ComHandler)>)"
    inner = lambda x, tag: F.trim(F.regexp_extract(x, f"(?s)<{tag}>(.*?)</{tag}>", 1))

    def action(x: Column) -> Column:
        command, arguments, handler = inner(x, "Command"), inner(x, "Arguments"), inner(x, "ClassId")
        line = F.when(command != "", F.concat_ws(" ", command, F.nullif(arguments, F.lit(""))))
        return F.when(x.rlike(r"^<Exec"), line).otherwise(F.when(handler != "", F.concat(F.lit("com:"), handler)))

    # a tag that closes itself has no body
    found = F.transform(F.regexp_extract_all(definition, F.lit(element), F.lit(0)), lambda x: F.when(~x.rlike(r"(?s)^<[^>]*/>$"), action(x)))
    read = F.slice(F.filter(found, lambda x: x.isNotNull()), 1, TASK_ACTIONS)
    return F.when(F.size(read) > 0, F.array_join(read, ACTION_SEPARATOR))


def expand_path(path: Column) -> Column:
    """A path whose leading variable is replaced by what it means."""
    out = path
    for variable, means in PATH_VARIABLES.items():
        out = F.when(F.startswith(F.upper(path), F.lit(variable)), F.concat(F.lit(means), F.substring(path, len(variable) + 1, 100_000))).otherwise(out)
    return out


def parse_event_xml(rows: DataFrame, block: str = "value") -> DataFrame:
    """Windows events, one XML block a row, with what it tells: kind, record_id, event_id, channel, pid, user, user_sid, subject, source_address, status, name, path.

    Services, tasks (path: the actions of the nested definition, joined), accounts, logons and privileges (user: the account they are about, which for privileges is the subject), and files that a policy would
    block or did (name: the policy, path: expanded). Blocks that can't be read or have no record number are left out; fields that hold nothing or a dash are null.
    """
    # a generator's row, which the optimiser neither pushes a condition through nor repeats: each block is parsed once
    read = F.filter(F.array(F.struct(F.from_xml(block, EVENT).alias("__e"))), lambda x: x["__e"]["System"]["EventRecordID"].try_cast("long").isNotNull())
    e = rows.select("*", F.inline(read))
    field = lambda name: F.get(F.filter("__e.EventData.Data", lambda d: d["_Name"] == name), F.lit(0))["_VALUE"]
    blank = lambda c: F.when(~F.trim(c).isin("", "-"), F.trim(c))
    data = lambda name: blank(field(name))
    rule = lambda name: blank(F.col(f"__e.UserData.RuleAndFileData.{name}"))
    event = F.trim("__e.System.EventID").try_cast("int")
    task, logon = event.isin(TASK_CREATED, TASK_UPDATED, TASK_REGISTERED), event.isin(LOGON, LOGON_FAILED, LOGON_EXPLICIT)
    kind = (
        F.when(event == SERVICE, "service").when(task, "task").when(event == ACCOUNT, "account").when(event.isin(LOGON, LOGON_EXPLICIT), "logon")
        .when(event == LOGON_FAILED, "logon_failure").when(event == PRIVILEGES, "privileged_session").when(event.isin(*APPLOCKER), "applocker")
    )
    definition = F.when(event == TASK_CREATED, field("TaskContent")).when(event == TASK_UPDATED, field("TaskContentNew"))
    pid = F.when(event.isin(TASK_CREATED, TASK_UPDATED), field("ClientProcessId")).when(event.isin(*APPLOCKER), rule("TargetProcessId")).otherwise(F.col("__e.System.Execution._ProcessID"))
    user = F.when(event == PRIVILEGES, data("SubjectUserName")).when(logon | (event == ACCOUNT), data("TargetUserName")).when(event == TASK_REGISTERED, data("UserContext")).when(event.isin(*APPLOCKER), rule("TargetUser"))
    sid = F.when(event == PRIVILEGES, data("SubjectUserSid")).when(event == ACCOUNT, data("TargetSid")).when(logon, data("TargetUserSid"))
    name = F.when(event == SERVICE, data("ServiceName")).when(task, data("TaskName")).when(event.isin(*APPLOCKER), rule("PolicyName"))
    actions = F.when(event.isin(TASK_CREATED, TASK_UPDATED), F.coalesce(task_actions(definition), F.lit(ACTION_UNKNOWN)))
    path = F.when(event == SERVICE, data("ImagePath")).when(task, actions).when(event.isin(*APPLOCKER), expand_path(F.coalesce(rule("FullFilePath"), rule("FilePath"))))
    made = {
        "kind": kind, "event_id": event, "record_id": F.col("__e.System.EventRecordID").try_cast("long"), "channel": F.col("__e.System.Channel"), "pid": F.coalesce(pid.try_cast("long"), F.lit(0).cast("long")), "user": user, "user_sid": sid,
        "subject": data("SubjectUserName"), "source_address": F.when(logon, data("IpAddress")), "status": F.when(event == LOGON_FAILED, F.concat_ws("/", data("Status"), data("SubStatus"))), "name": name, "path": path,
    }
    rest = [c for c in rows.columns if c not in made and c != block]
    return e.select(*rest, *(c.alias(n) for n, c in made.items()))


def parse_evtx_xml(spark: SparkSession, path: str) -> DataFrame:
    """Events of files that hold one block after another, whether on lines of their own or not."""
    return parse_event_xml(spark.read.option("lineSep", "</Event>").text(path).select(F.concat(F.regexp_extract("value", r"(?s)(<Event[\s>].*)", 1), F.lit("</Event>")).alias("value")))
