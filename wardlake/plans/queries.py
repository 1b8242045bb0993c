"""One query per operator, over telemetry that is derived from the given tables, with the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cases, correlation, fleet, joins, learning, primitives, rules, windows
from .telemetry import DAY, EV, of_type, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["tenant_id", "agent_id", "type"]
HOST = ["tenant_id", "agent_id"]


def register(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = make
        if sql is not None:
            SQL[name] = sql
        return make

    return add


def on_ev(name: str, body: str, ctes: str = ""):
    """A query over the telemetry: make(ev) in Spark, body over the CTE `ev` in DuckDB."""

    def add(make):
        register(name, f"WITH RECURSIVE {EV}{', ' + ctes if ctes else ''} {body}")(lambda spark, d: make(telemetry(spark, d)))
        return make

    return add


def greedy(source: str, keys: str, width: int, name: str = "g", op: str = ">") -> str:
    """CTEs that fold `source` into anchored windows by recursion: event_id, anchor, opens."""
    k = [x.strip() for x in keys.split(",")]
    same = " AND ".join(f"o.{x} IS NOT DISTINCT FROM r.{x}" for x in k)
    cols = ", ".join(k)
    return (
        f"{name}_o AS (SELECT event_id, ts_us, {cols}, row_number() OVER (PARTITION BY {cols} ORDER BY ts_us, event_id) AS rn FROM {source}), "
        f"{name} AS (SELECT event_id, {cols}, rn, ts_us AS anchor, true AS opens FROM {name}_o WHERE rn = 1 UNION ALL "
        f"SELECT o.event_id, {', '.join('o.' + x for x in k)}, o.rn, CASE WHEN o.ts_us - r.anchor {op} {width} THEN o.ts_us ELSE r.anchor END, o.ts_us - r.anchor {op} {width} "
        f"FROM {name} r JOIN {name}_o o ON {same} AND o.rn = r.rn + 1)"
    )


def count_in(keys: str, width: int, value: str = "1") -> str:
    """A scalar subquery: the sum over the rows of x that have arrived within width."""
    same = " AND ".join(f"y.{x.strip()} IS NOT DISTINCT FROM x.{x.strip()}" for x in keys.split(","))
    return f"(SELECT coalesce(sum({value}), 0) FROM s y WHERE {same} AND y.ts_us >= x.ts_us - {width} AND (y.ts_us, y.event_id) <= (x.ts_us, x.event_id))::BIGINT"


KEYS = "tenant_id, agent_id, type"

# ---- primitives


@on_ev("sliding_count", f"SELECT event_id, {count_in(KEYS, 3 * DAY)} AS n FROM s x", "s AS MATERIALIZED (SELECT * FROM ev)")
def _(ev):
    return primitives.sliding_count(ev, KEY, "ts_us", 3 * DAY, "event_id").select("event_id", "n")


@on_ev("sliding_sum", f"SELECT event_id, {count_in(KEYS, 3 * DAY, 'y.k')} AS total FROM s x", "s AS MATERIALIZED (SELECT * FROM ev)")
def _(ev):
    return primitives.sliding_sum(ev, KEY, "ts_us", "k", 3 * DAY, "event_id").select("event_id", "total")


@on_ev("sliding_distinct", f"SELECT event_id, {count_in(HOST[0] + ', ' + HOST[1], 4 * DAY, 'CASE WHEN y.opens THEN 1 ELSE 0 END')} AS n FROM s x", greedy("ev", "tenant_id, agent_id, comm", 4 * DAY) + ", s AS MATERIALIZED (SELECT ev.*, g.opens FROM ev JOIN g USING (event_id))")
def _(ev):
    return primitives.sliding_distinct(ev, HOST, "ts_us", "comm", 4 * DAY, "event_id").select("event_id", "n")


@on_ev("anchored_window", "SELECT event_id, anchor FROM g", greedy("ev", KEYS, 2 * DAY))
def _(ev):
    return primitives.anchored_window(ev, KEY, "ts_us", 2 * DAY, "event_id").select("event_id", "anchor")


@on_ev("suppress_within", "SELECT event_id FROM g WHERE opens", greedy("ev", KEYS, 2 * DAY))
def _(ev):
    return primitives.suppress_within(ev, KEY, "ts_us", 2 * DAY, "event_id").select("event_id")


@on_ev("resolve_process_name", """SELECT event_id, CASE WHEN l.g IS NULL OR x.process_generation IS NULL OR l.g = x.process_generation THEN l.c END AS resolved FROM ev x
 LEFT JOIN LATERAL (SELECT y.comm AS c, y.process_generation AS g FROM ev y WHERE y.type = 'exec' AND y.agent_id = x.agent_id AND y.pid = x.pid AND (y.ts_us, y.event_id) <= (x.ts_us, x.event_id) ORDER BY y.ts_us DESC, y.event_id DESC LIMIT 1) l ON true""")
def _(ev):
    return joins.resolve_process(ev).select("event_id", F.col("resolved_comm").alias("resolved"))


# ---- scalar functions: name -> (Spark, DuckDB), over ev

#: Addresses, places (| for a backslash), and children with their parents, that meet every branch, in both engines.
_ADDRESS = "CASE k % 20 WHEN 0 THEN '127.0.0.9' WHEN 1 THEN '0.0.0.0' WHEN 2 THEN '::' WHEN 3 THEN '::1' WHEN 4 THEN '172.15.0.1' WHEN 5 THEN '172.31.255.1' WHEN 6 THEN '192.168.1.1' WHEN 7 THEN 'FE80::1' WHEN 8 THEN 'fd00::2' WHEN 9 THEN 'ff02::fb' WHEN 10 THEN '239.1.2.3' WHEN 11 THEN '255.255.255.255' WHEN 12 THEN '8.8.8.255' WHEN 13 THEN '2001:db8::1' WHEN 14 THEN NULL ELSE daddr END"
_PLACE = "CASE k % 14 WHEN 0 THEN '/usr/bin/x' WHEN 1 THEN '/USR/lib/x' WHEN 2 THEN '/usrx/y' WHEN 3 THEN 'C:|Windows|System32|x.exe' WHEN 4 THEN 'c:|WINDOWS|Temp|x.exe' WHEN 5 THEN 'C:|Windows|Tracing|x' WHEN 6 THEN 'C:|Program Files (x86)|a|x.exe' WHEN 7 THEN 'C:|Users|a|x.exe' WHEN 8 THEN '/Applications/A.app' WHEN 9 THEN '/home/a/bin/x' WHEN 10 THEN NULL WHEN 11 THEN 'C:|WindowsX|y' ELSE '/tmp/x' END"
_CHILD = "CASE k % 8 WHEN 0 THEN 'lsass.exe' WHEN 1 THEN 'Services.EXE' WHEN 2 THEN 'svchost.exe' WHEN 3 THEN 'winlogon.exe' WHEN 4 THEN 'taskhostw.exe' WHEN 5 THEN 'RuntimeBroker.exe' WHEN 6 THEN 'wermgr.exe' ELSE comm END"
_MOTHER = "CASE k % 5 WHEN 0 THEN 'wininit.exe' WHEN 1 THEN 'SERVICES.exe' WHEN 2 THEN 'svchost.exe' WHEN 3 THEN 'smss.exe' ELSE parent_comm END"
#: Texts that meet each pattern, and what looks like one, in both engines.
_SENSITIVE = {
    "tls": "CASE k % 7 WHEN 0 THEN concat('authorization:  Basic ', comm, ' x') WHEN 1 THEN concat('Set-COOKIE: a=', agent_id) WHEN 2 THEN concat('GET https://', comm, ':', agent_id, '@h/p') WHEN 3 THEN concat('/p?token=', comm, '&key=1&monkey=2') WHEN 4 THEN concat('/p?a=1&access_token=', comm) WHEN 5 THEN 'http://h:80/p?tokens=1' ELSE cmdline END",
    "shell": "CASE k % 8 WHEN 0 THEN concat('Export KEY_1=', comm) WHEN 1 THEN concat('mysql --password \"', comm, '\" -h x') WHEN 2 THEN concat('mysql -p', comm, ' db') WHEN 3 THEN concat('aws_session_token=', comm, ' -p x') WHEN 4 THEN concat('curl -u  a:', comm, ' http://x') WHEN 5 THEN 'x--paste a' WHEN 6 THEN 'reexport A=b' ELSE cmdline END",
    "dns": "CASE k % 5 WHEN 0 THEN concat(comm, '.prod.Internal.') WHEN 1 THEN concat(comm, '.corp') WHEN 2 THEN 'corp' WHEN 3 THEN 'local.example.com' ELSE query END",
}


def _redacted(kind: str) -> str:
    out = _SENSITIVE[kind].replace(r'\"', '"')
    for pattern, by in S.REDACTIONS[kind]:
        out = f"regexp_replace({out}, '" + pattern.removeprefix("(?i)").replace("'", "''") + "', '" + by.replace("$", chr(92)) + "', '" + ("gi" if pattern.startswith("(?i)") else "g") + "')"
    return out


SCALARS: dict[str, tuple[Callable[[], object], str]] = {
    "has_write_intent": (lambda: S.has_write_intent(F.col("flags")), "(flags & 3) IN (1, 2) OR (flags & 64) != 0"),
    "shannon_entropy": (lambda: F.round(S.shannon_entropy(F.col("query")), 9), "round((SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER () AS n FROM (SELECT unnest(string_split(query, '')) AS ch) GROUP BY ch)), 9)"),
    "normalise_image_path": (lambda: S.normalise_image_path(F.col("image_path")), "CASE WHEN image_path[2] = ':' THEN lower(image_path) ELSE image_path END"),
    "normalise_domain": (lambda: S.normalise_domain(F.col("query")), "CASE WHEN right(query, 1) = '.' THEN left(lower(query), length(query) - 1) ELSE lower(query) END"),
    "dns_label_split": (lambda: F.concat_ws("|", S.dns_leftmost(F.col("query")), S.dns_parent(F.col("query"))), "split_part(query, '.', 1) || '|' || split_part(query, '.', 2) || '.' || split_part(query, '.', 3)"),
    "base_technique": (lambda: S.base_technique(F.col("technique")), "split_part(technique, '.', 1)"),
    "technique_id": (lambda: S.technique_id(F.concat(F.lit("attack."), F.lower("technique"))), "technique"),
    "split_techniques": (lambda: F.array_join(S.split_techniques(F.concat("technique", F.lit("/T1071"))), ","), "technique || ',T1071'"),
    "severity_rank": (lambda: S.severity_rank(F.col("severity")), "list_position(['low', 'medium', 'high', 'critical'], severity) - 1"),
    "ip_class": (
        lambda: S.ip_class(F.expr(_ADDRESS)),
        f"(SELECT CASE WHEN a IS NULL THEN NULL WHEN a IN ('0.0.0.0', '::') THEN 'unspecified' WHEN a LIKE '127.%' OR a = '::1' THEN 'loopback' WHEN a LIKE '10.%' OR a LIKE '192.168.%' OR regexp_matches(a, '^172[.](1[6-9]|2[0-9]|3[01])[.]') OR regexp_matches(a, '^(fe[89ab]|f[cd])') THEN 'private' WHEN a LIKE '%.255' THEN 'broadcast' WHEN regexp_matches(a, '^(22[4-9]|23[0-9]|2[45][0-9])[.]') OR a LIKE 'ff%' THEN 'multicast' ELSE 'public' END FROM (SELECT lower({_ADDRESS}) AS a))",
    ),
    "trusted_system_path": (
        lambda: S.trusted_system_path(F.replace(F.expr(_PLACE), F.lit("|"), F.lit("\\"))),
        f"(SELECT p IS NULL OR regexp_matches(p, '^/(usr|bin|sbin|lib|opt|system|applications)/') OR regexp_matches(p, '^c:[|]program files( [(]x86[)])?[|]') OR (starts_with(p, 'c:|windows|') AND NOT regexp_matches(p, '^c:[|]windows[|](temp|tasks|tracing)[|]')) FROM (SELECT lower({_PLACE}) AS p))",
    ),
    "expected_parent": (
        lambda: S.expected_parent(F.expr(_CHILD), F.expr(_MOTHER)),
        f"(SELECT m IS NULL OR CASE WHEN c IN ('lsass.exe', 'services.exe') THEN m = 'wininit.exe' WHEN c = 'svchost.exe' THEN m IN ('services.exe', 'svchost.exe') WHEN c = 'winlogon.exe' THEN m = 'smss.exe' WHEN c IN ('taskhostw.exe', 'runtimebroker.exe', 'wermgr.exe') THEN m = 'svchost.exe' ELSE true END FROM (SELECT lower({_CHILD}) AS c, lower({_MOTHER}) AS m))",
    ),
    "ml_cmdline": (lambda: F.replace(S.ml_cmdline(F.when(F.col("k") % 2 == 0, F.split("cmdline", " ")), F.col("cmdline")), F.lit("\0"), F.lit("~")), "CASE WHEN k % 2 = 0 THEN replace(cmdline, ' ', '~') || '~' ELSE cmdline END"),
    "url_normalise": (lambda: S.url_normalise(F.concat(F.lit("/A%2520b%zz?x="), F.col("query"))), "'/a b%zz?x=' || lower(query)"),
    "split_target": (lambda: F.concat_ws("|", S.target_path(F.concat(F.col("path"), F.lit("?a=1&b="), F.col("comm"))), F.get(S.target_params(F.concat(F.col("path"), F.lit("?a=1&b="), F.col("comm"))), F.lit(1))["value"]), "path || '|' || comm"),
    "appended_suffix": (lambda: S.appended_suffix(F.col("path"), F.concat("path", F.when(F.col("k") % 2 == 0, ".locked").otherwise(""))), "CASE WHEN k % 2 = 0 THEN '.locked' END"),
    "redact": (lambda: F.concat_ws("~", *(S.redact(F.expr(_SENSITIVE[kind]), kind) for kind in _SENSITIVE)), "concat_ws('~', " + ", ".join(_redacted(kind) for kind in ("tls", "shell", "dns")) + ")"),
    "pseudonymise_host": (lambda: S.pseudonym(F.col("agent_id")), "left(sha256(agent_id), 12)"),
    "evidence_truncation": (lambda: S.truncated(F.repeat("cmdline", 12)), "CASE WHEN length(repeat(cmdline, 12)) > 200 THEN left(repeat(cmdline, 12), 200) || ' [truncated]' ELSE repeat(cmdline, 12) END"),
}
SCALARS |= {
    "rename_exclusions": (
        lambda: S.rename_spared(F.lit("/m/tmp/a"), F.when(F.col("k") % 3 == 0, "/m/tmp/a.123").when(F.col("k") % 3 == 1, "/m/cur/a:2,S").otherwise("/m/tmp/a.locked"), F.col("comm"), F.lit(True)),
        "k % 3 != 2",
    ),
    "evidence_projection": (
        lambda: S.evidence(F.to_json(F.struct("type", "cmdline", "daddr", F.col("k").alias("hidden")))),
        """'{"type":"' || type || '","cmdline":"' || cmdline || '","daddr":"' || daddr || '"}'""",
    ),
}
for _name, (_make, _duck) in SCALARS.items():
    on_ev(_name, f"SELECT event_id, {_duck} AS v FROM ev")(lambda ev, m=_make: ev.select("event_id", m().alias("v")))


# ---- single-event rules: each over an expression of ev that both sides compute

RULE_SQL: dict[str, tuple[str, str, str, str]] = {
    # rule: (type, technique, severity, condition)
    "base64_decode": ("exec", "'T1059.004'", "medium", "k % 8 = 0"),
    "encoded_powershell": ("exec", "'T1059.001'", "medium", "k % 8 = 1"),
    "recovery_inhibit": ("exec", "'T1490'", "high", "contains(cmdline, 'vssadmin')"),
    "log_clear_exec": ("exec", "CASE WHEN contains(cmdline, 'wevtutil') THEN 'T1070.001' ELSE 'T1070.002' END", "high", "contains(cmdline, 'wevtutil') OR contains(cmdline, 'journalctl')"),
    "service_unusual_outbound": ("connect", "'T1071'", "medium", "comm = 'nginx' AND dport != 443"),
}
for _rule, (_type, _tech, _sev, _cond) in RULE_SQL.items():
    on_ev(f"rule_{_rule}", f"SELECT event_id, '{_rule}' AS rule, {_tech} AS technique, '{_sev}' AS severity FROM ev WHERE type = '{_type}' AND ({_cond})")(
        lambda ev, r=_rule: rules.detect(ev, [r]).select("event_id", "rule", "technique", "severity")
    )

_BITS = {"scheduled_task_created": (rules.TASK_CREATED, "T1053.005", "medium"), "service_installed": (rules.SERVICE_INSTALLED, "T1543.003", "high"), "account_created": (rules.ACCOUNT_CREATED, "T1136.001", "high"), "systemd_unit_started": (rules.UNIT_STARTED, "T1543.002", "medium"), "launch_item_registered": (rules.LAUNCH_ITEM, "T1543.001/T1547.015", "medium")}
for _rule, (_bit, _tech, _sev) in _BITS.items():
    on_ev(f"rule_{_rule}", f"SELECT event_id, '{_rule}' AS rule, '{_tech}' AS technique, '{_sev}' AS severity FROM ev WHERE type = 'file_open' AND k % 5 = 0")(
        lambda ev, r=_rule, b=_bit: rules.detect(ev.withColumn("flags", F.when(F.col("k") % 5 == 0, F.lit(b)).otherwise(0).cast("long")), [r]).select("event_id", "rule", "technique", "severity")
    )


#: Paths of every entry of persistence, and some beside them, in both engines.
_LASTING = "CASE k % 12 WHEN 0 THEN '/home/a/.bashrc' WHEN 1 THEN '/root/.zshrc' WHEN 2 THEN '/etc/profile.d/x.sh' WHEN 3 THEN '/etc/cron.d/x' WHEN 4 THEN '/etc/systemd/system/x.service' WHEN 5 THEN '/Users/a/Library/LaunchAgents/x.plist' WHEN 6 THEN '/Library/LaunchDaemons/x.plist' WHEN 7 THEN '/etc/periodic/daily/x' WHEN 8 THEN '/private/var/at/tabs/root' WHEN 9 THEN '/etc/cron.daily/x' WHEN 10 THEN '/etc/systemd/user/x' ELSE '/home/a/bashrc' END"


@on_ev(
    "rule_persistence_write",
    f"SELECT event_id, 'persistence_write' AS rule, technique, 'high' AS severity FROM (SELECT event_id, CASE WHEN regexp_matches(p, '[.](bash|zsh)rc|/etc/profile[.]d/') THEN 'T1546.004' WHEN contains(p, '/etc/cron.d/') THEN 'T1053.003' WHEN contains(p, '/etc/systemd/system/') THEN 'T1543.002' WHEN regexp_matches(p, '/Library/Launch(Agents|Daemons)/|/etc/periodic/|/var/at/tabs/') THEN 'T1037.004/T1053.003' END AS technique FROM (SELECT event_id, {_LASTING} AS p FROM ev WHERE type = 'file_open' AND ((flags & 3) IN (1, 2) OR (flags & 64) != 0))) WHERE technique IS NOT NULL",
)
def _(ev):
    return rules.detect(ev.withColumn("path", F.expr(_LASTING)), ["persistence_write"]).select("event_id", "rule", "technique", "severity")


@on_ev("rule_scheduled_task_repointed", "SELECT event_id, 'T1053.005' AS technique FROM ev WHERE type = 'file_open' AND k % 5 < 2 AND (k % 5 = 0 OR k % 2 = 0)")
def _(ev):
    flags = F.when(F.col("k") % 5 == 0, rules.TASK_REPOINTED | rules.TASK_ACTION_UNKNOWN).when(F.col("k") % 5 == 1, rules.TASK_REPOINTED).otherwise(0).cast("long")
    return rules.detect(ev.withColumns({"flags": flags, "path": F.when(F.col("k") % 2 == 0, "C:/Users/Public/a.exe").otherwise("/opt/a")}), ["scheduled_task_repointed"]).select("event_id", "technique")


@on_ev("rule_masquerading", "SELECT event_id, 'T1036.005' AS technique FROM ev WHERE type = 'exec' AND k % 4 IN (0, 2)")
def _(ev):
    path = F.when(F.col("k") % 4 == 0, "/tmp/bash").when(F.col("k") % 4 == 1, "/usr/bin/bash").when(F.col("k") % 4 == 2, "D:\\x\\SVCHOST.exe").otherwise("C:\\Windows\\System32\\svchost.exe")
    return rules.detect(ev.withColumn("image_path", path), ["masquerading"]).select("event_id", "technique")


@on_ev("rule_log_file_delete", "SELECT event_id, 'T1070.002' AS technique FROM ev WHERE type = 'file_open' AND k % 6 = 3")
def _(ev):
    return rules.detect(of_type(ev, "file_open").withColumn("type", F.lit("file_delete")), ["log_file_delete"]).select("event_id", "technique")


_CONTAINED = {
    "container": "CASE WHEN k % 4 != 0 THEN concat('c', CAST(k AS STRING)) END",
    "path": "CASE k % 7 WHEN 0 THEN '/proc/12/root/etc/shadow' WHEN 1 THEN '//proc/7//root' WHEN 2 THEN 'proc/1/root/x' WHEN 3 THEN '/proc/self/root/x' WHEN 4 THEN '/proc/12/rootfs' WHEN 5 THEN '/x/proc/12/root' ELSE path END",
}


@on_ev(
    "rule_proc_root_escape",
    "SELECT event_id, 'T1611' AS technique FROM (SELECT event_id, list_filter(string_split(p, '/'), lambda x: x != '') AS s FROM c WHERE type = 'file_open' AND container IS NOT NULL) WHERE s[1] = 'proc' AND try_cast(s[2] AS UBIGINT) IS NOT NULL AND s[3] = 'root'",
    f"c AS (SELECT *, {_CONTAINED['container']} AS container, {_CONTAINED['path']} AS p FROM ev)",
)
def _(ev):
    rows = ev.withColumns({c: F.expr(e) for c, e in _CONTAINED.items()})
    return rules.detect(rows, ["proc_root_escape"]).select("event_id", "technique")


_PRELOAD = {
    "first": "CASE k % 4 WHEN 0 THEN 'LD_PRELOAD' WHEN 1 THEN 'LD_AUDIT' ELSE 'LD_LIBRARY_PATH' END",
    "library": "CASE k % 9 WHEN 0 THEN '/usr/lib/a.so:/tmp/x.so' WHEN 1 THEN 'b.so:/lib64/c.so' WHEN 2 THEN '/usr/libexec/d.so' WHEN 3 THEN '' WHEN 4 THEN 'tmp/e.so' WHEN 5 THEN ':/usr/local/lib/f.so:' WHEN 6 THEN '/opt/v/g.so' WHEN 7 THEN '/dev/shm/h.so' ELSE '/lib/i.so' END",
}


@on_ev(
    "rule_ld_preload_hijack",
    "SELECT event_id FROM (SELECT *, CASE WHEN first != 'LD_LIBRARY_PATH' THEN library WHEN k % 3 = 0 THEN '/tmp/late.so' END AS v FROM c) WHERE len(list_filter(string_split(v, ':'), lambda p: p LIKE '/%' AND NOT regexp_matches(p, '^/(lib|lib64|usr/lib|usr/lib64|usr/local/lib)/'))) > 0",
    f"c AS (SELECT *, {_PRELOAD['first']} AS first, {_PRELOAD['library']} AS library FROM ev WHERE type = 'exec')",
)
def _(ev):
    of = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    late = F.when(F.col("k") % 3 == 0, "LD_PRELOAD").otherwise("PATH")
    env = F.array(of(F.expr(_PRELOAD["first"]), F.expr(_PRELOAD["library"])), of(late, F.lit("/tmp/late.so")))
    return rules.detect(ev.withColumn("env_security", env), ["ld_preload_hijack"]).select("event_id")


@on_ev("rule_security_process_signal", "SELECT event_id, 'T1562.001' AS technique, 'high' AS severity FROM ev WHERE type = 'auth' AND (k % 24 IN (1, 2, 3, 6, 9, 15) OR k % 24 = CASE WHEN k % 5 = 0 THEN 17 ELSE 19 END)")
def _(ev):
    rows = of_type(ev, "auth").withColumns({"type": F.lit("signal"), "signal": (F.col("k") % 24).cast("int"), "os": F.when(F.col("k") % 5 == 0, "macos").otherwise("linux")})
    return rules.detect(rows, ["security_process_signal"]).select("event_id", "technique", "severity")


#: Names and paths with databases, in both engines.
_DATABASE = {
    "comm": "CASE WHEN comm = 'nginx' AND k % 2 = 0 THEN 'mysqld' WHEN comm = 'nginx' THEN 'mariadbd' ELSE comm END",
    "path": "CASE k % 11 WHEN 0 THEN '/tmp' WHEN 1 THEN '/tmp/#sql' WHEN 2 THEN './ibdata1' WHEN 3 THEN '/run/mysqld/x' WHEN 4 THEN '/var/log/mariadb/x' ELSE path END",
}


@on_ev(
    "rule_database_write_outside",
    """SELECT event_id, technique FROM (SELECT x.event_id, 'T1190' AS technique, (SELECT CASE WHEN y.process_generation IS NULL OR x.process_generation IS NULL OR y.process_generation = x.process_generation THEN y.comm END FROM db y WHERE y.type = 'exec' AND y.agent_id = x.agent_id AND y.pid = x.pid AND (y.ts_us, y.event_id) <= (x.ts_us, x.event_id) ORDER BY y.ts_us DESC, y.event_id DESC LIMIT 1) AS named
 FROM db x WHERE type = 'file_open' AND ((flags & 3) IN (1, 2) OR (flags & 64) != 0) AND path LIKE '/%' AND path != '/tmp' AND NOT regexp_matches(path, '^/(var/lib/mysql|var/lib/mariadb|var/log/mysql|var/log/mariadb|run/mysqld|var/run/mysqld|tmp)/')) WHERE named IN ('mysqld', 'mariadbd')""",
    "db AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _DATABASE.items()) + ") FROM ev)",
)
def _(ev):
    rows = joins.resolve_process(ev.withColumns({c: F.expr(e) for c, e in _DATABASE.items()}))
    return rules.detect(rows, ["database_write_outside"]).select("event_id", "technique")


#: Pages as scripts that a scanner is shown: the whole page and a tail that meets each marker, in both engines.
_SCRIPT = {
    "content": """concat(html, CASE page_id % 16 WHEN 0 THEN ' IEX (New-Object Net.WebClient)' WHEN 1 THEN concat(' iwr x', repeat('\u00e9', 147), 'iex') WHEN 2 THEN concat(' iwr x', repeat('\u00e9', 150), ' iex') WHEN 3 THEN concat(' iex ', repeat('z', 400), ' DownloadString(')
 WHEN 4 THEN ' a-iwr | iex' WHEN 5 THEN ' \u00e9iex curl' WHEN 6 THEN ' [Ref].Assembly.GetType(AmsiUtils)' WHEN 7 THEN ' [Reflection.Assembly]::Load([Convert]::FromBase64String(x))' WHEN 8 THEN ' Assembly]::Load(x)' WHEN 9 THEN ' sekurlsa::logonpasswords'
 WHEN 10 THEN ' IWshShell3.Run(powershell -x)' WHEN 11 THEN ' shell(mypowershell)' WHEN 12 THEN ' x.ShellExecute(mshta.exe)' ELSE ' iex; irm' END)""",
    "app_name": "CASE page_id % 3 WHEN 0 THEN 'VBScript' WHEN 1 THEN 'OFFICE_VBA' ELSE 'PowerShell_x' END",
    "scan_result": "CASE page_id % 5 WHEN 0 THEN 32768 WHEN 1 THEN 32767 ELSE 0 END",
}
_SCRIPTS = f"""c AS (SELECT page_id, CASE WHEN page_id % 16 = 14 THEN '  @{{ ModuleVersion ' || t ELSE t END AS content, app_name, scan_result FROM (SELECT page_id, {_SCRIPT['content']} AS t, {_SCRIPT['app_name']} AS app_name, {_SCRIPT['scan_result']} AS scan_result FROM pages)), l AS MATERIALIZED (SELECT page_id, lower(content) AS t, lower(app_name) AS a, scan_result FROM c),
m(kind, m, word) AS (VALUES {', '.join(f"('{k}', '{w}', {q})" for k, q, ws in (('f', False, rules.FETCH), ('f', True, rules.FETCH_WORDS), ('r', False, rules.RUN), ('r', True, rules.RUN_WORDS), ('l', True, rules.LAUNCHED)) for w in ws)}),
o AS MATERIALIZED (SELECT page_id, kind, list_sum(list_transform(p[1:i], lambda x: strlen(x))) + (i - 1) * strlen(m) AS at FROM (SELECT *, unnest(range(1, len(p))) AS i FROM (SELECT page_id, kind, m, word, string_split(t, m) AS p FROM l, m WHERE contains(t, m)))
 WHERE NOT word OR NOT ((i > 1 AND p[i] = '') OR regexp_matches(p[i], '[\\p{{L}}\\p{{N}}_-]$') OR (i + 1 < len(p) AND p[i + 1] = '') OR regexp_matches(p[i + 1], '^[\\p{{L}}\\p{{N}}_-]'))),
cradle AS (SELECT DISTINCT f.page_id FROM o f JOIN o r ON f.page_id = r.page_id AND f.kind = 'f' AND r.kind = 'r' AND abs(f.at - r.at) <= 300 JOIN l ON l.page_id = f.page_id WHERE NOT (regexp_matches(t, '^\\s*@\\{{') AND regexp_matches(t, 'moduleversion|cmdletstoexport|functionstoexport')))"""


def scripts(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", *(F.expr(e).alias(c) for c, e in _SCRIPT.items()))
    content = F.when(F.col("page_id") % 16 == 14, F.concat(F.lit("  @{ ModuleVersion "), "content")).otherwise(F.col("content"))
    return pages.withColumns({"type": F.lit("script_scan"), "content": content, **{c: F.lit(None).cast("string") for c in ("cmdline", "path", "image_path", "comm", "daddr")}, **{c: F.lit(None).cast("long") for c in ("flags", "dport")}})


@register("rule_download_cradle", f"WITH {_SCRIPTS} SELECT page_id FROM cradle")
def _(spark, d):
    return rules.detect(scripts(spark, d), ["download_cradle"], ("page_id",)).select("page_id")


@register(
    "rule_script_scan",
    f"""WITH {_SCRIPTS} SELECT page_id, 'scan_provider_detected' AS rule, 'T1059' AS technique, 'high' AS severity FROM l WHERE scan_result >= 32768
 UNION ALL SELECT page_id, 'scan_tampering', 'T1562.001', 'high' FROM l WHERE regexp_matches(t, 'amsi(utils|initfailed|scanbuffer|context|opensession)')
 UNION ALL SELECT page_id, 'reflective_load', 'T1620', 'high' FROM l WHERE contains(t, 'assembly]::load(') AND regexp_matches(t, 'frombase64string\\(|decompress|gzipstream')
 UNION ALL SELECT page_id, 'credential_module', 'T1003.001', 'high' FROM l WHERE regexp_matches(t, 'invoke-mimikatz|sekurlsa::|lsadump::|kerberos::(golden|ptt)|privilege::debug')
 UNION ALL SELECT page_id, 'script_host_launch', 'T1059.005/T1059.007', 'medium' FROM l WHERE regexp_matches(a, '^(vbscript|jscript|office_vba)') AND regexp_matches(t, 'iwshshell3\\.(run|exec)\\(|shell\\(|\\.shellexecute\\(') AND page_id IN (SELECT page_id FROM o WHERE kind = 'l')""",
)
def _(spark, d):
    names = ["scan_provider_detected", "scan_tampering", "reflective_load", "credential_module", "script_host_launch"]
    return rules.detect(scripts(spark, d), names, ("page_id",))


#: Texts of documents with what a web shell holds, for some; in both engines.
_SCANNED = "CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), ' <?PHP EVAL(Base64_Decode(x)') WHEN doc_id % 7 = 1 THEN concat(text, ' <?php eval(') ELSE text END"


@register("content_signature_scan", f"SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, 'license') THEN 'license' END, CASE WHEN contains(t, '<?php') AND contains(t, 'eval(') AND contains(t, 'base64_decode') THEN 'webshell' END], lambda x: x IS NOT NULL), ',') AS matched FROM (SELECT doc_id, lower({_SCANNED}) AS t FROM documents)")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("text", F.expr(_SCANNED))
    return rules.content_signatures(docs, "text", {"license": ("any", ["license"]), "webshell": ("all", ["<?php", "eval(", "base64_decode"])}).select("doc_id", F.array_join("matched", ",").alias("matched"))


#: Requests that meet every signature and what looks like one, in both engines.
_REQUEST = {
    "target": """CASE k % 17 WHEN 0 THEN '/a?x=1&id=1%20UNION%20/**/SELECT%201' WHEN 1 THEN '/x/..%2f../y' WHEN 2 THEN '/p?c=%252e%252e%252fa' WHEN 3 THEN '/p?cmd=WhoAmI' WHEN 4 THEN '/up/C99.php?q=1' WHEN 5 THEN '/ok?q=1'
 WHEN 6 THEN '/p?a=union&b=select' WHEN 7 THEN '/p?q=a%26cmd%3Did' WHEN 8 THEN '/p?c=system(x)&d=sleep(9)' WHEN 9 THEN '/a/..' WHEN 10 THEN '/p?whoami' WHEN 11 THEN concat('/p?', repeat('n', 80), '=', repeat('v', 150), 'eval(') WHEN 12 THEN '/p?c=curl++http://x' WHEN 13 THEN concat('/p?id=%zz', chr(39), ' or ', chr(39)) WHEN 14 THEN '/wso' ELSE '/id' END""",
    "agent": "CASE k % 4 WHEN 0 THEN 'SQLmap/1.7' WHEN 1 THEN 'Mozilla Nmap Scripting Engine' WHEN 2 THEN NULL ELSE 'curl' END",
    "status": "CASE WHEN k % 3 = 0 THEN 404 ELSE 204 END",
}
_NORMAL = r"trim(regexp_replace(regexp_replace(lower({d}), '/\*\*/', ' ', 'g'), '\s+', ' ', 'g'))"
_DECODED = "url_decode(replace(url_decode(replace({x}, '+', ' ')), '+', ' '))"
_HTTP = f"""q AS MATERIALIZED (SELECT event_id, {_REQUEST['target']} AS target, {_REQUEST['agent']} AS agent, {_REQUEST['status']} AS status FROM ev),
p0 AS (SELECT event_id, i, string_split(string_split(substr(target, instr(target, '?') + 1), '&')[i], '=') AS nv FROM q, range(1, 9) AS r(i) WHERE instr(target, '?') > 0 AND i <= len(string_split(target, '&'))),
p AS (SELECT event_id, i, nv[1] AS name, coalesce(array_to_string(nv[2:], '='), '') AS value FROM p0 WHERE array_to_string(nv, '=') != ''),
v AS (SELECT *, {_NORMAL.format(d=_DECODED.format(x='value'))} AS v FROM p),
w AS (SELECT event_id, status, lower(agent) AS agent, {_NORMAL.format(d=_DECODED.format(x="string_split(target, '?')[1]"))} AS path FROM q),
f AS (SELECT event_id, 1 AS o, i, 'sql_injection' AS signature, left(name, 64) AS name, left(value, 128) AS value, NULL::VARCHAR AS scanner FROM v WHERE len(list_filter([{', '.join("'" + m.replace("'", "''") + "'" for m in rules.SQL_INJECTION)}], lambda m: contains(v, m))) > 0
 UNION ALL SELECT event_id, 2, 0, 'path_traversal', NULL, NULL, NULL FROM w WHERE contains(path, '../') OR contains(path, '..' || chr(92)) OR suffix(path, '/..')
 UNION ALL SELECT event_id, 3, i, 'path_traversal', left(name, 64), left(value, 128), NULL FROM v WHERE contains(v, '../') OR contains(v, '..' || chr(92)) OR suffix(v, '/..')
 UNION ALL SELECT event_id, 4, i, 'webshell_like', left(name, 64), left(value, 128), NULL FROM v WHERE v IN ('id', 'whoami', 'ls', 'pwd', 'ifconfig', 'ipconfig') OR len(list_filter([{', '.join("'" + m + "'" for m in rules.EXECUTION)}], lambda m: contains(v, m))) > 0
 UNION ALL SELECT event_id, 5, 0, 'webshell_like', NULL, NULL, NULL FROM w WHERE status BETWEEN 200 AND 299 AND string_split(list_last(string_split(path, '/')), '.')[1] IN ('c99', 'r57', 'wso', 'b374k', 'alfa', 'webshell', 'china', 'chopper', 'indoxploit')
 UNION ALL SELECT event_id, 6, 0, 'scanner_user_agent', NULL, NULL, CASE WHEN contains(agent, 'sqlmap') THEN 'sqlmap' ELSE 'nmap' END FROM w WHERE contains(agent, 'sqlmap') OR contains(agent, 'nmap scripting engine'))"""


@on_ev("http_signature", "SELECT event_id, signature, name, value, scanner FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o, i) = 1", _HTTP)
def _(ev):
    rows = ev.select("event_id", *(F.expr(e).alias(c) for c, e in _REQUEST.items()))
    found = rows.withColumn("hit", rules.http_signature(F.col("target"), F.col("agent"), F.col("status")))
    return found.where("hit IS NOT NULL").select("event_id", "hit.*")


@on_ev("sigma_match", "SELECT event_id, 'r1' AS rule_id FROM ev WHERE type = 'exec' AND contains(cmdline, '-enc') AND parent_comm = 'winword.exe' UNION ALL SELECT event_id, 'r2' FROM ev WHERE type = 'exec' AND (contains(cmdline, 'vssadmin') OR contains(cmdline, 'wevtutil'))")
def _(ev):
    rows = [("r1", "high", "cmdline", "contains", "-ENC"), ("r1", "high", "parent_comm", "endswith", "word.exe"), ("r2", "high", "cmdline", None, "*vssadmin*"), ("r2", "high", "cmdline", None, "WEVTUTIL*")]
    return rules.sigma(of_type(ev, "exec"), ev.sparkSession.createDataFrame(rows, "rule_id string, level string, field string, modifier string, value string")).select("event_id", "rule_id")


# ---- sliding detections (widths of days, as the derived events are hours apart)


def hot(where: str, keys: str, width: int, at_least: int, columns: str = "") -> str:
    return f"s AS MATERIALIZED (SELECT *{columns} FROM ev WHERE {where}), h AS MATERIALIZED (SELECT * FROM (SELECT x.*, {count_in(keys, width)} AS n FROM s x) WHERE n >= {at_least}), " + greedy("h", keys, width)


_PLAIN = "SELECT event_id FROM g WHERE opens"


#: Windows and other hosts, programs that are let pass in their places and not, brokers among the parents (processes 101 to 103 stand for them), the agent's helpers.
_SPAWN = {
    "comm": "CASE k % 8 WHEN 1 THEN 'SVCHOST.exe' WHEN 2 THEN 'werfault.EXE' WHEN 3 THEN 'RUNTIMEbroker.exe' WHEN 4 THEN 'Wevtutil.exe' ELSE comm END",
    "ppid": "99 + ppid",
    "image_path": r"CASE WHEN k % 8 IN (1, 2, 4) AND k % 3 != 0 THEN 'C:\\Windows\\System32\\x.exe' ELSE image_path END",
    "parent_comm": "CASE WHEN k % 6 = 1 THEN 'services.exe' WHEN k % 6 = 2 THEN 'cmd.exe' ELSE NULL END",
}
_PARENT_PATH = r"CASE WHEN k % 3 = 1 THEN 'C:\\Windows\\System32\\RuntimeBroker.exe' WHEN k % 3 = 2 THEN '/tmp/RuntimeBroker.exe' END"
_SPAWN_CTE = "se AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _SPAWN.items()).replace("\\\\", "\\") + f"), {_PARENT_PATH.replace(chr(92) * 2, chr(92))} AS pp FROM ev), "
_SPAWN_CTE += r"""sp AS (SELECT x.*, lower((SELECT y.comm FROM se y WHERE y.type = 'exec' AND y.agent_id = x.agent_id AND y.pid = x.ppid AND (y.ts_us, y.event_id) <= (x.ts_us, x.event_id) ORDER BY y.ts_us DESC, y.event_id DESC LIMIT 1)) AS parent,
 starts_with(lower(image_path), 'c:\windows\') OR regexp_matches(lower(image_path), '^/(usr|bin|sbin|lib|opt)/') AS placed FROM se x WHERE type = 'exec' AND k % 10 != 9),
sq AS (SELECT * FROM sp WHERE NOT coalesce(lower(comm) IN ('svchost.exe', 'werfault.exe') AND placed AND (lower(comm) != 'svchost.exe' OR parent_comm IS NULL OR parent_comm = 'services.exe'), false)
 AND NOT coalesce(parent = 'runtimebroker.exe' AND (pp IS NULL OR starts_with(lower(pp), 'c:\windows\')), false) AND NOT (lower(comm) = 'wevtutil.exe' AND placed AND ppid = 101)), """.replace("\\\\", "\\")


@on_ev("self_spawn", _PLAIN, _SPAWN_CTE + hot("true", "tenant_id, agent_id, ppid, comm", 20 * DAY, 2).replace("FROM ev", "FROM sq"))
def _(ev):
    rows = ev.withColumns({**{c: F.expr(e) for c, e in _SPAWN.items()}, "parent_image_path": F.expr(_PARENT_PATH)})
    return windows.self_spawn(rows, 20 * DAY, 2, F.col("k") % 10 != 9, F.lit(101)).select("event_id")


#: Network events that meet every exclusion of the beacon: the same expressions in both engines.
_NET = {
    "comm": "CASE WHEN k % 5 = 3 THEN 'Chrome.EXE' ELSE comm END",
    "daddr": "CASE k % 16 WHEN 1 THEN '224.0.0.251' WHEN 2 THEN '10.0.0.255' WHEN 3 THEN '0.0.0.0' WHEN 5 THEN '::' WHEN 7 THEN 'ff02::fb' ELSE daddr END",
    "dport": "CASE WHEN k % 16 IN (3, 5, 7) AND k % 3 < 2 THEN 65535 ELSE dport END",
    "pid": "CASE WHEN k % 16 = 4 THEN 4 ELSE pid END",
}
_NET_CTE = "net AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _NET.items()) + ") FROM ev), "
_SPARED = "(lower(comm) = 'chrome.exe' OR dport = 443 OR (daddr IN ('0.0.0.0', '::') AND dport = 65535) OR daddr LIKE '224.%.%.%' OR daddr LIKE '%.%.%.255')"


def _network(ev):
    return ev.withColumns({c: F.expr(e) for c, e in _NET.items()})


@on_ev("beacon", _PLAIN, _NET_CTE + hot(f"type = 'connect' AND pid != 4 AND NOT {_SPARED}", "tenant_id, agent_id, comm, daddr, dport", 40 * DAY, 2).replace("FROM ev", "FROM net"))
def _(ev):
    return windows.beacon(_network(ev), 40 * DAY, 2).select("event_id")


@on_ev(
    "beacon_flow",
    _PLAIN,
    _NET_CTE
    + f"f AS (SELECT * FROM net WHERE type = 'dns_query' AND NOT {_SPARED}), "
    + greedy("f", "tenant_id, agent_id, comm, daddr, dport, ppid", 20 * DAY, "d")
    + f", s AS MATERIALIZED (SELECT * FROM net WHERE type = 'connect' AND pid != 4 AND NOT {_SPARED} UNION ALL SELECT net.* FROM net JOIN d USING (event_id) WHERE d.opens), "
    + hot("true", "tenant_id, agent_id, comm, daddr, dport", 20 * DAY, 2).split("), ", 1)[1],
)
def _(ev):
    flows = _network(ev).withColumn("type", F.when(F.col("type") == "dns_query", "network_flow").when(F.col("type") == "connect", "connect").otherwise("x")).withColumn("local_port", F.col("ppid"))
    return windows.beacon_flow(flows, 20 * DAY, 2).select("event_id")


@on_ev("scan_spread", _PLAIN, "c AS (SELECT * FROM ev WHERE type = 'connect'), " + greedy("c", "tenant_id, agent_id, pid, dport, daddr", 60 * DAY, "m") + f", s AS MATERIALIZED (SELECT c.*, m.opens FROM c JOIN m USING (event_id)), h AS MATERIALIZED (SELECT * FROM (SELECT x.*, {count_in('tenant_id, agent_id, pid, dport', 60 * DAY, 'CASE WHEN y.opens THEN 1 ELSE 0 END')} AS n FROM s x) WHERE n >= 2), " + greedy("h", "tenant_id, agent_id, pid, dport", 60 * DAY))
def _(ev):
    return windows.scan_spread(ev, 60 * DAY, 2).select("event_id")


@on_ev("auth_bruteforce", _PLAIN, hot("type = 'auth' AND outcome = 'failure'", "tenant_id, agent_id, target_user, daddr", 60 * DAY, 2))
def _(ev):
    return windows.auth_bruteforce(ev, 60 * DAY, 2).select("event_id")


@on_ev("dns_tunnel", _PLAIN, "c AS (SELECT *, lower(split_part(query, '.', 1)) AS label FROM ev WHERE type = 'dns_query'), " + greedy("c", "tenant_id, agent_id, pid, label", 30 * DAY, "m") + f", s AS MATERIALIZED (SELECT c.*, m.opens FROM c JOIN m USING (event_id)), h AS MATERIALIZED (SELECT * FROM (SELECT x.*, {count_in('tenant_id, agent_id, pid', 30 * DAY, 'CASE WHEN y.opens THEN 1 ELSE 0 END')} AS n FROM s x) WHERE n >= 3), " + greedy("h", "tenant_id, agent_id, pid", 30 * DAY))
def _(ev):
    return windows.dns_tunnel(ev.withColumn("query", F.lower("query")), 30 * DAY, 3, long=1, bits=-1.0).select("event_id")


_RENAME = "SELECT event_id, 'pid' AS scope FROM g WHERE opens UNION ALL SELECT event_id, 'ppid' FROM q WHERE opens"


@on_ev("mass_rename", _RENAME, f"s AS MATERIALIZED (SELECT * FROM ev WHERE k % 2 = 0 AND k % 8 NOT IN (4, 6) OR k % 16 = 1), n AS MATERIALIZED (SELECT x.*, {count_in('tenant_id, agent_id, pid', 5 * DAY)} AS n FROM s x), h AS (SELECT * FROM n WHERE n >= 3), " + greedy("h", "tenant_id, agent_id, pid", 5 * DAY) + f", y1 AS MATERIALIZED (SELECT * FROM n WHERE n <= 2 AND ppid > 1), y2 AS MATERIALIZED (SELECT * FROM (SELECT x.*, {count_in('tenant_id, agent_id, ppid', 5 * DAY).replace('FROM s y', 'FROM y1 y')} AS m FROM y1 x) WHERE m >= 3), " + greedy("y2", "tenant_id, agent_id, ppid", 5 * DAY, "q"))
def _(ev):
    # rotated logs, flags of mail and renames that append nothing are spared; temporary folders are not
    kind = "CASE WHEN k % 8 = 4 THEN '/m/cur/1:2,S' WHEN k % 8 = 6 THEN '/home/a/x.txt.1' WHEN k % 2 = 0 THEN '/home/a/x.txt.locked' WHEN k % 16 = 1 THEN '/tmp/x.txt.locked' ELSE '/home/a/x.txt' END"
    rows = ev.withColumns({"old_path": F.expr("CASE WHEN k % 8 = 4 THEN '/m/cur/1' WHEN k % 16 = 1 THEN '/tmp/x.txt' ELSE '/home/a/x.txt' END"), "new_path": F.expr(kind)})
    return windows.mass_rename(rows, 5 * DAY, 3, 2).select("event_id", "scope")


@on_ev("burst_write_volume", _PLAIN, f"s AS MATERIALIZED (SELECT * FROM ev WHERE type IN ('exec', 'connect')), h AS MATERIALIZED (SELECT * FROM (SELECT x.*, {count_in('tenant_id, agent_id, pid', 20 * DAY, chr(67) + 'ASE WHEN y.type = ' + chr(39) + 'exec' + chr(39) + ' THEN 1 ELSE 0 END')} AS r, {count_in('tenant_id, agent_id, pid', 20 * DAY, 'CASE WHEN y.type = ' + chr(39) + 'connect' + chr(39) + ' THEN y.k ELSE 0 END')} AS w FROM s x) WHERE r >= 2 AND w >= 50), " + greedy("h", "tenant_id, agent_id, pid", 20 * DAY))
def _(ev):
    rows = ev.withColumns({"type": F.when(F.col("type") == "exec", "file_rename").when(F.col("type") == "connect", "file_write").otherwise("x"), "bytes": F.col("k")})
    return windows.burst_write(rows, 20 * DAY, 2, 50).select("event_id")


@on_ev("listener_drift", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, daddr, dport ORDER BY ts_us, event_id) AS rn FROM ev WHERE type = 'connect' AND dport != 443) WHERE rn = 1")
def _(ev):
    known = ev.select("dport").where("dport = 443").distinct()
    rows = of_type(ev, "connect").join(known, "dport", "left_anti")
    return windows.first_seen(rows, ["agent_id", "daddr", "dport"]).select("event_id")


@on_ev("unit_first_seen", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, comm ORDER BY ts_us, event_id) AS rn FROM ev WHERE type = 'exec') WHERE rn = 1")
def _(ev):
    return windows.first_seen(of_type(ev, "exec"), ["agent_id", "comm"]).select("event_id")


@on_ev("sensor_silence", f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, since ORDER BY ts_us, event_id) AS rn FROM (SELECT *, max(CASE WHEN moved THEN ts_us END) OVER (PARTITION BY agent_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS since FROM (SELECT *, coalesce(ppid != lag(ppid) OVER (PARTITION BY agent_id ORDER BY ts_us, event_id), true) AS moved FROM ev)) WHERE ts_us - since > {DAY}) WHERE rn = 1")
def _(ev):
    return windows.sensor_silence(ev, ["agent_id"], "ppid", DAY).select("event_id")


_WIN = greedy("ev", "tenant_id, agent_id", 10 * DAY, op=">=")


@on_ev("misparse_watch", "SELECT agent_id, anchor, lines, failures FROM (SELECT *, coalesce(lag(bad) OVER (PARTITION BY agent_id ORDER BY anchor), false) AS was FROM (SELECT *, lines >= 5 AND 2 * failures >= lines AS bad FROM (SELECT g.agent_id, g.anchor, count(*) AS lines, sum((ev.k % 3 != 0)::INT)::BIGINT AS failures FROM g JOIN ev USING (event_id) GROUP BY ALL))) WHERE bad AND NOT was", _WIN)
def _(ev):
    return windows.window_health(ev, HOST, F.col("k") % 3 != 0, 10 * DAY, 5).select("agent_id", "anchor", "lines", "failures")


@on_ev("http_window_summary", "SELECT tenant_id, agent_id, anchor, sum(n)::BIGINT AS requests, sum(c4)::BIGINT AS status_4xx, sum(c5)::BIGINT AS status_5xx, count(*) AS distinct_clients, coalesce(string_agg(daddr || ':' || (c4 + c5)::VARCHAR, ',' ORDER BY r) FILTER (r <= 5 AND c4 + c5 > 0), '') AS top_clients FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, agent_id, anchor ORDER BY c4 + c5 DESC, daddr) AS r FROM (SELECT g.tenant_id, g.agent_id, anchor, daddr, count(*) AS n, count(*) FILTER (k % 3 = 0) AS c4, count(*) FILTER (k % 3 = 1) AS c5 FROM g JOIN ev USING (event_id) GROUP BY ALL)) GROUP BY ALL", _WIN)
def _(ev):
    rows = ev.withColumn("status", F.when(F.col("k") % 3 == 0, 404).when(F.col("k") % 3 == 1, 500).otherwise(200))
    return windows.http_summary(rows, HOST, 10 * DAY, client="daddr")


@register("task_registration_dedup")
def _(spark, d):
    return windows.task_dedup(of_type(telemetry(spark, d), "exec").withColumn("actions", F.col("image_path")), 20 * DAY).select("event_id")


# ---- joins

#: Processes 101 to 103 stand for the parents, which the derived numbers never meet; with office programs, build tools and generations of parents.
_FAMILY = {
    "ppid": "99 + ppid",
    "comm": "CASE WHEN comm = 'sshd' AND k % 2 = 0 THEN 'WinWord.exe' WHEN comm = 'cmd.exe' AND k % 3 = 0 THEN 'MSBuild.exe' WHEN comm = 'curl' AND k % 3 = 0 THEN 'devenv.exe' ELSE comm END",
}
_PARENT_GENERATION = "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 7 ELSE (k + 1) % 2 END"
_FAMILY_CTE = "pe AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _FAMILY.items()) + f"), {_PARENT_GENERATION} AS parent_generation FROM ev), px AS MATERIALIZED (SELECT x.*, lower((SELECT CASE WHEN y.process_generation IS NULL OR x.parent_generation IS NULL OR y.process_generation = x.parent_generation THEN y.comm END FROM pe y WHERE y.type = 'exec' AND y.agent_id = x.agent_id AND y.pid = x.ppid AND (y.ts_us, y.event_id) <= (x.ts_us, x.event_id) ORDER BY y.ts_us DESC, y.event_id DESC LIMIT 1)) AS parent FROM pe x WHERE type = 'exec')"


def parents(ev):
    generation = F.expr(_PARENT_GENERATION).cast("long")
    return ev.withColumns({**{c: F.expr(e) for c, e in _FAMILY.items()}, "parent_process_generation": generation})


@on_ev("service_spawns_shell", "SELECT event_id FROM px WHERE comm = 'bash' AND parent = 'nginx'", _FAMILY_CTE)
def _(ev):
    return joins.service_spawns_shell(parents(ev)).select("event_id")


@on_ev("office_spawns_interpreter", "SELECT event_id FROM px WHERE comm = 'cmd.exe' AND parent = 'winword.exe'", _FAMILY_CTE)
def _(ev):
    return joins.office_spawns_interpreter(parents(ev)).select("event_id")


@on_ev("lolbin_unusual_parent", "SELECT event_id FROM px WHERE comm = 'MSBuild.exe' AND parent NOT IN ('devenv.exe', 'msbuild.exe')", _FAMILY_CTE)
def _(ev):
    return joins.lolbin_unusual_parent(parents(ev)).select("event_id")


def after(first: str, then: str, on: str, width: int) -> str:
    return f"SELECT event_id, first_id FROM (SELECT x.event_id, y.event_id AS first_id, row_number() OVER (PARTITION BY x.event_id ORDER BY y.ts_us DESC, y.event_id DESC) AS rn FROM (SELECT * FROM ev WHERE {then}) x JOIN (SELECT * FROM ev WHERE {first}) y ON {on} AND y.ts_us BETWEEN x.ts_us - {width} AND x.ts_us) WHERE rn = 1"


@on_ev("download_then_exec", after("type = 'file_open' AND comm = 'curl'", "type = 'exec'", "x.agent_id = y.agent_id AND (k_name(y.path) = k_name(x.image_path))".replace("k_name(y.path)", "list_last(string_split(y.image_path, '/'))").replace("k_name(x.image_path)", "list_last(string_split(x.image_path, '/'))").replace("list_last(string_split(y.image_path, '/'))", "lower(list_last(string_split(replace(y.image_path, chr(92), '/'), '/')))").replace("list_last(string_split(x.image_path, '/'))", "lower(list_last(string_split(replace(x.image_path, chr(92), '/'), '/')))"), 30 * DAY))
def _(ev):
    return joins.download_then_exec(ev.withColumn("path", F.col("image_path")), 30 * DAY).select("event_id", "first_id")


@on_ev("quarantine_then_exec", "SELECT first_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY ts_us, event_id) AS r2 FROM (" + after("type = 'file_open'", "type = 'exec'", "x.agent_id = y.agent_id AND x.comm = y.comm", 20 * DAY).replace("SELECT event_id, first_id FROM (SELECT x.event_id,", "SELECT event_id, first_id, ts_us FROM (SELECT x.event_id, x.ts_us,") + ")) WHERE r2 = 1")
def _(ev):
    return joins.first_use_of_mark(of_type(ev, "file_open"), of_type(ev, "exec"), [*HOST, "comm"], 20 * DAY).select("first_id", "event_id")


_NUM = "(SELECT *, row_number() OVER (PARTITION BY agent_id, k ORDER BY ts_us, event_id) AS n FROM ev WHERE type = '{t}')"


@on_ev("tcc_context_join", f"SELECT r.event_id, c.event_id AS context_id FROM {_NUM.format(t='connect')} r LEFT JOIN {_NUM.format(t='exec')} c ON r.agent_id = c.agent_id AND r.k = c.k AND r.n = c.n")
def _(ev):
    met, lone = joins.context_join(of_type(ev, "exec"), of_type(ev, "connect"), ["agent_id", "k"])
    return met.select("event_id", "context_id").unionByName(lone.select("event_id", F.lit(None).cast("long").alias("context_id")))


@on_ev("baseline_clean_execs", "SELECT event_id FROM ev WHERE type = 'exec' AND k % 8 > 4")
def _(ev):
    rows = ev.withColumn("image_path", F.lit("/usr/bin/x"))
    return joins.without_alerts(of_type(rows, "exec"), rules.detect(rows)).select("event_id")


@on_ev("same_generation_join", f"SELECT x.event_id AS a_id, y.event_id AS b_id FROM ev x JOIN ev y ON x.agent_id = y.agent_id AND x.pid = y.pid AND x.type = 'exec' AND y.type = 'connect' AND y.ts_us BETWEEN x.ts_us AND x.ts_us + {5 * DAY} AND (x.process_generation IS NULL OR y.process_generation IS NULL OR x.process_generation = y.process_generation)")
def _(ev):
    return joins.same_process(of_type(ev, "exec"), of_type(ev, "connect"), [*HOST, "pid"], 5 * DAY).select("a_id", "b_id")


# ---- prevalence

OBS = """o AS (SELECT tenant_id, agent_id, ts_us, 'image_path' AS kind, CASE WHEN image_path[2] = ':' THEN lower(image_path) ELSE image_path END AS key FROM ev WHERE type = 'exec'
 UNION ALL SELECT tenant_id, agent_id, ts_us, 'lineage', coalesce(parent_comm, '?') || ' -> ' || CASE WHEN image_path[2] = ':' THEN lower(image_path) ELSE image_path END FROM ev WHERE type = 'exec'
 UNION ALL SELECT tenant_id, agent_id, ts_us, 'domain', rtrim(lower(query), '.') FROM ev WHERE type = 'dns_query'),
f AS (SELECT tenant_id, agent_id, kind, key, min(ts_us) AS first_seen, max(ts_us) AS last_seen, count(*) AS count FROM o GROUP BY ALL),
p AS (SELECT tenant_id, kind, key, count(*) AS host_count, sum(count)::BIGINT AS event_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM f GROUP BY ALL)"""


def folded(ev):
    return fleet.fold_sightings(fleet.observations(ev))


@on_ev("extract_observations", "SELECT * FROM o", OBS)
def _(ev):
    return fleet.observations(ev)


@on_ev("fold_sightings", "SELECT * FROM f", OBS)
def _(ev):
    return folded(ev)


@on_ev("merge_sightings", "SELECT * FROM f", OBS)
def _(ev):
    half = F.col("event_id") % 2 == 0
    return fleet.merge_sightings(folded(ev.where(half)), folded(ev.where(~half)))


@on_ev("prevalence", "SELECT * FROM p", OBS)
def _(ev):
    return fleet.prevalence(folded(ev))


@on_ev("triage_rarest_first", "SELECT tenant_id, kind, key, host_count, row_number() OVER (PARTITION BY tenant_id ORDER BY host_count, kind, key) AS rank FROM p QUALIFY rank <= 200", OBS)
def rarest(ev):
    p = fleet.prevalence(folded(ev))
    seen = p.select("tenant_id", "kind", "key")
    return joins.enrich_prevalence(seen, p.select("tenant_id", "kind", "key", "host_count"), ["tenant_id", "kind", "key"], 200, ["tenant_id"]).select("tenant_id", "kind", "key", "host_count", "rank")


@on_ev("prune_sightings", f"SELECT tenant_id, agent_id, kind, key, last_seen FROM f WHERE last_seen >= (SELECT max(ts_us) FROM ev) - {60 * DAY} QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY last_seen DESC, agent_id, kind, key) <= 300", OBS)
def _(ev):
    now = ev.agg(F.max("ts_us")).first()[0]
    return fleet.prune_sightings(folded(ev), now, 60 * DAY, 300).select("tenant_id", "agent_id", "kind", "key", "last_seen")


@on_ev("common_keys", "SELECT tenant_id, kind, key FROM p WHERE host_count >= 10", OBS)
def _(ev):
    return fleet.common_keys(folded(ev), 10)


@on_ev("k_anonymous_keys", "SELECT key, count(DISTINCT tenant_id) AS tenants, sum(count)::BIGINT AS event_count FROM f WHERE kind = 'domain' GROUP BY key HAVING count(DISTINCT tenant_id) >= 3", OBS)
def _(ev):
    return fleet.k_anonymous(folded(ev), "domain", 3)


@on_ev("rarity_before", "SELECT event_id, (SELECT count(DISTINCT y.agent_id) FROM ev y WHERE y.tenant_id = x.tenant_id AND y.k = x.k AND (y.ts_us, y.event_id) < (x.ts_us, x.event_id)) AS hosts_before FROM ev x")
def _(ev):
    return fleet.rarity_before(ev.withColumns({"kind": F.lit("k"), "key": F.col("k")})).select("event_id", "hosts_before")


# ---- fleet

AGENTS = f"a AS (SELECT tenant_id, agent_id, any_value(ring) AS ring, max(ts_us) AS last_seen FROM ev GROUP BY ALL), now AS (SELECT max(ts_us) AS t FROM ev)"
RM = AGENTS + f""", d AS (SELECT tenant_id, agent_id, count(*) AS d, count(*) FILTER (severity = 'low') AS low FROM ev, now WHERE ts_us > t - {20 * DAY} GROUP BY ALL),
r AS (SELECT tenant_id, ring, count(*) AS total, count(*) FILTER (last_seen < t - {2 * DAY}) AS silent, coalesce(sum(d), 0)::BIGINT AS detections, coalesce(sum(low), 0)::BIGINT AS low_severity FROM a LEFT JOIN d USING (tenant_id, agent_id), now GROUP BY ALL),
m AS (SELECT *, silent / total AS silent_rate, CASE WHEN silent / total > 0.05 THEN 'unhealthy' WHEN silent / total > 0.02 THEN 'degraded' ELSE 'healthy' END AS grade FROM r)"""


def agents(ev):
    return ev.groupBy("tenant_id", "agent_id").agg(F.first("ring").alias("ring"), F.max("ts_us").alias("last_seen"))


def now(ev):
    """The greatest time of the table stands for the clock."""
    return F.lit(ev.agg(F.max("ts_us")).first()[0])


def metrics(ev):
    return fleet.ring_metrics(agents(ev), ev, now(ev), 2 * DAY, 20 * DAY)


@on_ev("ring_metrics", "SELECT * FROM m", RM)
def _(ev):
    return metrics(ev)


#: A fleet in which one tenant's agents fall silent, another's canaries report more that is minor, and a third's report less, in both engines.
_UNEVEN = f"NOT (user_id % 15 = 0 AND ts_us > t - {10 * DAY}) AND NOT (user_id % 3 = 1 AND ring = 'prod' AND severity = 'low') AND NOT (user_id % 3 = 2 AND ring = 'canary' AND severity != 'low' AND ts_us < t - {DAY})"
_UNEVEN_CTE = f"eu AS MATERIALIZED (SELECT ev.* FROM ev, (SELECT max(ts_us) AS t FROM ev) WHERE {_UNEVEN}), "


def uneven(ev):
    return ev.where(F.expr(_UNEVEN.replace("user_id", "CAST(user_id AS BIGINT)").replace(" t ", f" {ev.agg(F.max('ts_us')).first()[0]}L ")))


@on_ev("canary_regression", "SELECT c.tenant_id, CASE WHEN c.silent_rate > 0.05 THEN 'silent_rate' WHEN CASE WHEN p.low_severity > 0 THEN c.low_severity / c.total > 2 * (p.low_severity / p.total) ELSE c.low_severity > 10 END THEN 'low_severity' WHEN c.detections / c.total < 0.8 * (p.detections / p.total) THEN 'detection_drop' END AS reason, c.total AS c_total, p.total AS p_total FROM m c JOIN m p USING (tenant_id) WHERE c.ring = 'canary' AND p.ring = 'prod' AND reason IS NOT NULL", _UNEVEN_CTE + RM.replace("FROM ev", "FROM eu"))
def _(ev):
    return fleet.canary_regression(metrics(uneven(ev)))


@on_ev("auto_case_from_regression", "SELECT tenant_id, 'Canary regression: silent_rate' AS title FROM m WHERE ring = 'canary' AND silent_rate > 0.05", _UNEVEN_CTE + RM.replace("FROM ev", "FROM eu"))
def _(ev):
    return fleet.canary_regression(metrics(uneven(ev))).where("reason = 'silent_rate'").select("tenant_id", F.concat(F.lit("Canary regression: "), "reason").alias("title"))


STATUS = AGENTS + f", b AS (SELECT * FROM ev WHERE type = 'auth' QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY ts_us DESC, event_id DESC) = 1), st AS (SELECT a.tenant_id, a.agent_id, a.ring, CASE WHEN a.last_seen < t - {2 * DAY} THEN 'silent' WHEN b.k IS NULL THEN 'no_beacon' WHEN b.k % 4 = 0 THEN 'degraded' ELSE 'healthy' END AS status FROM a LEFT JOIN b USING (agent_id), now)"


def statuses(ev):
    beacons = of_type(ev, "auth").withColumn("silent_sensor", F.col("k") % 4 == 0)
    return fleet.fleet_status(agents(ev), beacons, now(ev), 2 * DAY)


@on_ev("fleet_status", "SELECT agent_id, status FROM st", STATUS)
def _(ev):
    return statuses(ev).select("agent_id", "status")


@on_ev("latest_beacon", "SELECT agent_id, event_id FROM b", STATUS)
def _(ev):
    return fleet.latest(of_type(ev, "auth"), ["agent_id"], ["ts_us", "event_id"]).select("agent_id", "event_id")


@on_ev("silent_agent_cases", "SELECT tenant_id, agent_id, 'Agent silent: ' || agent_id AS title FROM st WHERE status = 'silent' AND ring != 'broad'", _UNEVEN_CTE + STATUS.replace("FROM ev", "FROM eu"))
def _(ev):
    left = uneven(ev)
    a = agents(left)
    return fleet.silent_agent_cases(a, a.where("ring = 'broad'"), now(left), 2 * DAY)


_REL = "rel AS (SELECT o_custkey % 3 AS t, CASE o_custkey % 4 WHEN 0 THEN 'canary' WHEN 1 THEN 'early' WHEN 2 THEN 'broad' ELSE 'prod' END AS ring, o_orderkey AS version, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'halted' ELSE 'draft' END AS status FROM orders)"


def releases(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    ring = F.get(F.array(*map(F.lit, fleet.RINGS)), (F.col("o_custkey") % 4).cast("int"))
    return o.select((F.col("o_custkey") % 3).alias("tenant_id"), ring.alias("ring"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "halted").otherwise("draft").alias("status"))


@register("served_release", f"WITH {_REL} SELECT t AS tenant_id, ring, max(version) AS version FROM rel WHERE status = 'active' GROUP BY ALL")
def _(spark, d):
    return fleet.served_release(releases(spark, d), "active").select("tenant_id", "ring", "version")


@register("latest_release", f"WITH {_REL} SELECT t AS tenant_id, ring, max(version) AS version, arg_max(status, version) AS status FROM rel GROUP BY ALL")
def _(spark, d):
    return fleet.served_release(releases(spark, d)).select("tenant_id", "ring", "version", "status")


@register("rollback_target", f"WITH {_REL}, c AS (SELECT t, ring, max(version) AS current FROM rel WHERE status IN ('active', 'halted') GROUP BY ALL) SELECT t AS tenant_id, ring, current, max(version) AS target FROM rel JOIN c USING (t, ring) WHERE version < current GROUP BY ALL")
def _(spark, d):
    return fleet.rollback_target(releases(spark, d))


@register("ring_status", f"WITH RECURSIVE {EV}, {STATUS}, {_REL}, x AS (SELECT 'tenant-' || t AS tenant_id, ring, max(version) AS newest, arg_max(status, version) AS rollout, max(version) FILTER (status = 'active') AS served FROM rel GROUP BY ALL), c AS (SELECT tenant_id, ring, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'no_beacon') AS no_beacon, count(*) FILTER (status = 'silent') AS silent FROM st GROUP BY ALL) SELECT tenant_id, ring, newest, rollout, served, coalesce(healthy, 0) AS healthy, coalesce(degraded, 0) AS degraded, coalesce(no_beacon, 0) AS no_beacon, coalesce(silent, 0) AS silent FROM x LEFT JOIN c USING (tenant_id, ring)")
def _(spark, d):
    rel = releases(spark, d).withColumn("tenant_id", F.concat(F.lit("tenant-"), F.col("tenant_id").cast("string")))
    return fleet.ring_status(statuses(telemetry(spark, d)), rel)


@on_ev("correlation_vector", f"SELECT agent_id, pid, max((type = 'exec')::INT) AS spawn, max((type = 'connect')::INT) AS connect, max((type = 'file_open' AND ((flags & 3) IN (1, 2) OR (flags & 64) != 0))::INT) AS filewrite, count(DISTINCT daddr) FILTER (type = 'connect') AS distinct_daddr, count(DISTINCT dport) FILTER (type = 'connect') AS distinct_dport, (max(ts_us) - min(ts_us)) / 1e6 AS span_s, count(*) AS event_count, spawn * connect * filewrite AS full_chain FROM (SELECT *, max(ts_us) OVER (PARTITION BY agent_id, pid) AS l FROM ev) WHERE ts_us >= l - {10 * DAY} GROUP BY agent_id, pid")
def _(ev):
    return fleet.correlation_vector(ev, ["agent_id", "pid"], 10 * DAY)


@on_ev("process_records", "SELECT agent_id, pid, g, event_id FROM (SELECT *, coalesce(process_generation, -1) AS g, row_number() OVER (PARTITION BY agent_id, pid, coalesce(process_generation, -1) ORDER BY ts_us DESC, event_id DESC) AS rn FROM ev WHERE type = 'exec') WHERE rn = 1")
def _(ev):
    rows = of_type(ev, "exec").withColumn("g", F.coalesce("process_generation", F.lit(-1)).cast("long"))
    return fleet.latest(rows, ["agent_id", "pid", "g"], ["ts_us", "event_id"]).select("agent_id", "pid", "g", "event_id")


@on_ev("alert_tally", "SELECT technique, count(*) AS n FROM ev GROUP BY technique")
def _(ev):
    return ev.where("technique IS NOT NULL").groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


@on_ev("technique_coverage", "SELECT CASE split_part(technique, '.', 1) WHEN 'T1059' THEN 'execution' WHEN 'T1486' THEN 'impact' ELSE 'unmapped' END AS tactic, technique, string_agg(DISTINCT comm, ',' ORDER BY comm) AS sources, count(*) AS n FROM ev GROUP BY ALL")
def _(ev):
    tactics = ev.sparkSession.createDataFrame([("T1059", "execution"), ("T1486", "impact")], "technique string, tactic string")
    return fleet.technique_coverage(ev.withColumn("source", F.col("comm")), tactics)


@on_ev("channel_volume_counts", "SELECT type AS channel, count(*) AS n FROM ev GROUP BY type")
def _(ev):
    return ev.groupBy(F.col("type").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@on_ev("dedup_cmdlines", "SELECT DISTINCT agent_id, cmdline FROM ev WHERE type = 'exec'")
def _(ev):
    return of_type(ev, "exec").select("agent_id", "cmdline").dropDuplicates()


@on_ev("combine_corpora", "SELECT cmdline, min(side) AS side FROM (SELECT cmdline, 0 AS side FROM ev WHERE k < 50 UNION ALL SELECT cmdline, 1 FROM ev WHERE k >= 50) GROUP BY cmdline")
def _(ev):
    part = lambda cond, side: ev.where(cond).select("cmdline", F.lit(side).alias("side"))
    return fleet.combine(part("k < 50", 0), part("k >= 50", 1), ["cmdline"])


@on_ev("filter_order_limit", "SELECT event_id, severity FROM ev WHERE severity = 'critical' ORDER BY ts_us DESC, event_id DESC LIMIT 1000")
def _(ev):
    return ev.where("severity = 'critical'").orderBy(F.desc("ts_us"), F.desc("event_id")).limit(1000).select("event_id", "severity")


@on_ev("top_attributions", "SELECT agent_id, event_id, row_number() OVER (PARTITION BY agent_id ORDER BY abs(value) DESC, event_id) AS rank FROM ev QUALIFY rank <= 3")
def _(ev):
    return fleet.top_by_magnitude(ev, ["agent_id"], "value", "event_id", 3).select("agent_id", "event_id", "rank")


@on_ev("retrospective_ioc", "SELECT daddr, count(DISTINCT agent_id) AS hosts, count(*) AS n FROM ev WHERE type = 'connect' AND daddr IN ('203.0.113.9', '203.0.113.11') GROUP BY daddr")
def _(ev):
    ioc = ev.sparkSession.createDataFrame([("203.0.113.9",), ("203.0.113.11",)], "daddr string")
    return of_type(ev, "connect").join(F.broadcast(ioc), "daddr").groupBy("daddr").agg(F.count_distinct("agent_id").alias("hosts"), F.count(F.lit(1)).alias("n"))


@on_ev("hunt_new_matches", f"SELECT event_id FROM ev WHERE contains(cmdline, 'base64') AND ts_us > (SELECT max(ts_us) - {30 * DAY} FROM ev)")
def _(ev):
    hits = ev.where(F.contains("cmdline", F.lit("base64")))
    previous = hits.where(F.col("ts_us") <= now(ev) - 30 * DAY)
    return hits.join(previous.select("event_id"), "event_id", "left_anti").select("event_id")


def edges(ev):
    return of_type(ev, "exec").select(F.coalesce("parent_comm", F.lit("?")).alias("src"), F.col("comm").alias("dst")).union(of_type(ev, "connect").select("comm", "daddr")).distinct()


@on_ev("entity_neighbourhood", "SELECT 'winword.exe' AS seed, node, min(hop) AS hop FROM r GROUP BY node", "e AS MATERIALIZED (SELECT DISTINCT coalesce(parent_comm, '?') AS src, comm AS dst FROM ev WHERE type = 'exec' UNION SELECT comm, daddr FROM ev WHERE type = 'connect'), r AS (SELECT 'winword.exe' AS node, 0 AS hop UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 2)")
def _(ev):
    return fleet.neighbourhood(edges(ev).select("src", "dst").distinct(), ev.sparkSession.createDataFrame([("winword.exe",)], "node string"), 2)


@on_ev("cross_host_entities", "SELECT tenant_id, daddr, count(DISTINCT agent_id) AS hosts FROM ev WHERE type = 'connect' GROUP BY ALL HAVING hosts >= 2")
def _(ev):
    return of_type(ev, "connect").groupBy("tenant_id", "daddr").agg(F.count_distinct("agent_id").alias("hosts")).where("hosts >= 2")


# ---- cases and verdicts

DET = "d AS (SELECT *, split_part(technique, '.', 1) AS base_technique FROM ev), "
_RANK = "(list_position(['low', 'medium', 'high', 'critical'], severity) - 1)"


@on_ev("group_detections", "SELECT event_id, anchor AS case_start FROM g", DET + greedy("d", "tenant_id, agent_id, base_technique", 10 * DAY))
def _(ev):
    return cases.group_detections(ev, 10 * DAY).select("event_id", "case_start")


@on_ev("cases", f"SELECT g.tenant_id, g.agent_id, g.base_technique, anchor AS case_start, count(*) AS detections, max({_RANK})::INT AS rank, g.base_technique || ' activity on ' || g.agent_id AS title, ['low', 'medium', 'high', 'critical'][max({_RANK}) + 1] AS severity, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM g JOIN ev USING (event_id) GROUP BY ALL", DET + greedy("d", "tenant_id, agent_id, base_technique", 10 * DAY))
def _(ev):
    return cases.cases(ev, 10 * DAY).drop("last_seen")


_OPEN = "k % 40 = 0"


@on_ev(
    "group_detections_open_cases",
    "SELECT event_id, CASE WHEN c >= 0 THEN c END AS case_id, CASE WHEN c < 0 THEN -1 - c END AS opened_by FROM ga WHERE rn > 0",
    DET
    + f"""o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, agent_id, base_technique ORDER BY ts_us, event_id) AS rn FROM d WHERE NOT ({_OPEN})),
 s0 AS (SELECT tenant_id, agent_id, base_technique, list({{'c': event_id::BIGINT, 's': ts_us}} ORDER BY event_id) AS l FROM d WHERE {_OPEN} GROUP BY ALL),
 ga AS (SELECT 0::BIGINT AS event_id, tenant_id, agent_id, base_technique, 0::BIGINT AS rn, coalesce(s0.l, []::STRUCT(c BIGINT, s BIGINT)[]) AS l, 0::BIGINT AS c FROM (SELECT DISTINCT tenant_id, agent_id, base_technique FROM o) LEFT JOIN s0 USING (tenant_id, agent_id, base_technique)
 UNION ALL SELECT event_id, tenant_id, agent_id, base_technique, rn, CASE WHEN p IS NULL THEN l || [{{'c': -1 - event_id::BIGINT, 's': ts_us}}] ELSE l[:p - 1] || [{{'c': l[p].c, 's': least(l[p].s, ts_us)}}] || l[p + 1:] END, CASE WHEN p IS NULL THEN -1 - event_id::BIGINT ELSE l[p].c END
 FROM (SELECT o.*, r.l, nullif(list_position(list_transform(r.l, lambda x: abs(x.s - o.ts_us) <= {10 * DAY}), true), 0) AS p FROM ga r JOIN o USING (tenant_id, agent_id, base_technique) WHERE o.rn = r.rn + 1))""",
)
def _(ev):
    known = ev.where(_OPEN).select("tenant_id", "agent_id", S.base_technique(F.col("technique")).alias("base_technique"), F.col("event_id").cast("long").alias("case_id"), F.col("ts_us").alias("case_start"))
    return cases.attach_detections(ev.where(f"NOT ({_OPEN})"), known, 10 * DAY).select("event_id", "case_id", "opened_by")


@on_ev("case_timeline", "SELECT event_id, row_number() OVER (PARTITION BY agent_id, technique ORDER BY ts_us, event_id) AS position FROM ev")
def _(ev):
    return cases.timeline(ev, ["agent_id", "technique"]).select("event_id", "position")


@on_ev("suppress_list", "SELECT event_id FROM ev WHERE NOT (technique = 'T1059' AND comm = 'curl' AND coalesce(process_generation, 0) = 0)")
def _(ev):
    listed = ev.sparkSession.createDataFrame([("curl", "T1059", 0)], "comm string, technique string, process_generation long")
    return cases.suppress(ev, listed, ["comm"]).select("event_id")


@on_ev("grounded_citations", "SELECT event_id FROM ev WHERE k % 3 = 0")
def _(ev):
    cited = ev.select(F.col("agent_id").alias("case_id"), F.col("event_id").alias("detection_id"))
    return cases.grounded(cited, ev.where("k % 3 = 0").select(F.col("agent_id").alias("case_id"), F.col("event_id").alias("detection_id"))).select(F.col("detection_id").alias("event_id"))


@on_ev("narrative_staleness", "SELECT case_id, generated_at, coalesce(u > generated_at, false) AS stale FROM (SELECT agent_id AS case_id, max(ts_us) AS generated_at FROM ev WHERE type = 'exec' GROUP BY ALL) LEFT JOIN (SELECT agent_id AS case_id, max(ts_us) AS u FROM ev WHERE type = 'connect' GROUP BY ALL) USING (case_id)")
def _(ev):
    told = of_type(ev, "exec").select(F.col("agent_id").alias("case_id"), F.col("ts_us").alias("generated_at"))
    return cases.staleness(told, of_type(ev, "connect").select(F.col("agent_id").alias("case_id"), F.col("ts_us").alias("updated_at")))


@on_ev("scenario_replay", "SELECT technique, n, n BETWEEN lo AND lo + tol AS passed FROM (SELECT 'T1486' AS technique, 1 AS lo, 1000000 AS tol UNION ALL SELECT 'T9999', 1, 5) LEFT JOIN (SELECT technique, count(*) AS n FROM ev GROUP BY ALL) USING (technique)".replace("SELECT technique, n, n BETWEEN", "SELECT technique, coalesce(n, 0) AS n, coalesce(n, 0) BETWEEN"))
def _(ev):
    want = ev.sparkSession.createDataFrame([("T1486", 1, 1_000_000), ("T9999", 1, 5)], "technique string, min_count long, tolerance long")
    return joins.scenario_replay(want, ev).select("technique", "n", "passed")


# ---- correlation

_W = 4 * DAY
#: Paths on both sides of what counts as a payload, in both engines.
_WRITTEN = "CASE k % 7 WHEN 0 THEN '/tmp/x' WHEN 1 THEN '/home/a/Downloads/notes.txt' WHEN 2 THEN 'C:/Users/a/setup.JSE' WHEN 3 THEN '/srv/tmp/x.php' WHEN 4 THEN '/opt/lib.jar.txt' WHEN 5 THEN '/srv/www/a.sh' ELSE '/var/tmp/a' END"
_PAYLOAD = r"y.type = 'file_open' AND ((y.flags & 3) IN (1, 2) OR (y.flags & 64) != 0) AND regexp_matches(lower(y.path), '^/(tmp|var/tmp|dev/shm)/|/downloads/|\.(exe|dll|bat|ps1|vbs|hta|cmd|scr|msi|jar|js|jse)$')"


def co(name: str, cond: str, keys: str = "tenant_id, agent_id, pid, gen") -> None:
    has = lambda t: count_in("tenant_id, agent_id, pid, gen", _W, f"({t})::INT") + " > 0"
    e, c, w = has("y.type = 'exec'"), has("y.type = 'connect'"), has(_PAYLOAD)
    ctes = f"s AS MATERIALIZED (SELECT * REPLACE ({_WRITTEN} AS path), coalesce(process_generation, -1) AS gen FROM ev), h AS MATERIALIZED (SELECT event_id, {e} AS e, {c} AS c, {w} AS w, {count_in('tenant_id, agent_id, ppid, comm', _W, '(y.type = ' + chr(39) + 'exec' + chr(39) + ')::INT')} AS ne, {count_in('tenant_id, agent_id, ppid, comm', _W, '(y.type = ' + chr(39) + 'connect' + chr(39) + ')::INT')} AS nc FROM s x)"
    on_ev(name, f"SELECT event_id FROM h WHERE {cond}", ctes)(lambda ev, n=name: correlation.co_occurrence(ev.withColumn("path", F.expr(_WRITTEN)), _W, suppress=False).where(F.col("rule") == n).select("event_id"))


co("spawn_connect", "e AND c AND NOT w")
co("connect_filewrite", "c AND w")
co("spawn_connect_filewrite", "e AND c AND w")
co("respawn_connect", "ne >= 3 AND nc > 0")


@on_ev("assembly_and_smb", f"SELECT event_id, CASE WHEN a AND s THEN 'assembly_smb' WHEN e AND s THEN 'exec_smb' ELSE 'assembly_connect' END AS rule FROM (SELECT event_id, {count_in('tenant_id, agent_id, pid, gen', _W, '(y.type = ' + chr(39) + 'auth' + chr(39) + ')::INT')} > 0 AS a, {count_in('tenant_id, agent_id, pid, gen', _W, '(y.type = ' + chr(39) + 'dns_query' + chr(39) + ')::INT')} > 0 AS s, {count_in('tenant_id, agent_id, pid, gen', _W, '(y.type = ' + chr(39) + 'exec' + chr(39) + ')::INT')} > 0 AS e, {count_in('tenant_id, agent_id, pid, gen', _W, '(y.type = ' + chr(39) + 'connect' + chr(39) + ')::INT')} > 0 AS c FROM s x) WHERE (a AND s) OR (e AND s) OR (a AND c)", "s AS MATERIALIZED (SELECT *, coalesce(process_generation, -1) AS gen FROM ev)")
def _(ev):
    typed = ev.withColumn("type", F.when(F.col("type") == "auth", "assembly_load").when(F.col("type") == "dns_query", "smb_connect").otherwise(F.col("type")))
    found = correlation.co_occurrence(typed, _W, suppress=False).where(F.col("rule").isin("assembly_smb", "exec_smb", "assembly_connect"))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(F.when(F.col("rule") == "assembly_smb", 0).when(F.col("rule") == "exec_smb", 1).otherwise(2)))
    return found.withColumn("n", first).where("n = 1").select("event_id", "rule")


#: Names that are let pass, some of them borrowed, in both engines.
_GATED = {
    "comm": r"CASE k % 9 WHEN 0 THEN 'svchost.exe' WHEN 1 THEN 'C:\\x\\MsMpEng.EXE' WHEN 2 THEN 'conhost.exe' WHEN 3 THEN 'wget' ELSE comm END",
    "image_path": r"CASE WHEN k % 9 IN (0, 2) AND k % 5 != 0 THEN 'C:\\Windows\\System32\\x.exe' WHEN k % 9 = 3 AND k % 2 = 0 THEN '/usr/bin/wget' WHEN k % 9 = 1 AND k % 2 = 0 THEN '' ELSE image_path END",
    "parent_comm": r"CASE WHEN k % 4 = 0 THEN 'C:\\y\\Services.exe' WHEN k % 4 = 1 THEN '' ELSE parent_comm END",
}
_GATED_CTE = (
    "gt AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _GATED.items()).replace("\\\\", "\\") + "), coalesce(process_generation, -1) AS gen FROM ev), "
    + r"""gn AS (SELECT *, lower(list_last(string_split(comm, '\\'))) AS nm, coalesce(nullif(lower(image_path), ''), '/usr/') AS ip, nullif(lower(list_last(string_split(parent_comm, '\\'))), '') AS pc FROM gt),
gm AS (SELECT *, type = 'exec' AND nm IN ('svchost.exe', 'msmpeng.exe', 'conhost.exe', 'wget') AND (NOT (regexp_matches(ip, '^/(usr|bin|sbin|lib|opt)/') OR starts_with(ip, 'c:\windows\') OR starts_with(ip, 'c:\program files')) OR (comm = 'svchost.exe' AND pc IS NOT NULL AND pc NOT IN ('services.exe', 'svchost.exe'))) AS borrows FROM gn),
gl AS (SELECT *, (SELECT {'g': y.process_generation} FROM gm y WHERE y.borrows AND y.agent_id = x.agent_id AND y.pid = x.pid AND (y.ts_us, y.event_id) <= (x.ts_us, x.event_id) ORDER BY y.ts_us DESC, y.event_id DESC LIMIT 1) AS mark FROM gm x),
s AS MATERIALIZED (SELECT *, mark IS NOT NULL AND (mark.g IS NULL OR process_generation IS NULL OR mark.g = process_generation) AS borrowed FROM gl)""".replace("'\\\\'", "chr(92)")
)


_GATE_W = 40 * DAY


def gated(ev):
    return ev.withColumns({c: F.expr(e) for c, e in _GATED.items()})


@on_ev("correlation_gate", _PLAIN, _GATED_CTE + f", h AS MATERIALIZED (SELECT * FROM (SELECT x.*, {count_in('tenant_id, agent_id, ppid, comm', _GATE_W, '(y.type = ' + chr(39) + 'exec' + chr(39) + ')::INT')} AS ne, {count_in('tenant_id, agent_id, ppid, comm', _GATE_W, '(y.type = ' + chr(39) + 'connect' + chr(39) + ')::INT')} AS nc FROM s x) WHERE ne >= 3 AND nc > 0 AND (borrowed OR nm NOT IN ('svchost.exe', 'msmpeng.exe', 'conhost.exe'))), " + greedy("h", "tenant_id, agent_id, pid, gen", _GATE_W))
def _(ev):
    return correlation.co_occurrence(gated(ev), _GATE_W, gate=True).where("rule = 'respawn_connect'").select("event_id")


# ---- learning


#: Command lines and parents that meet every list of the features, in both engines.
_LINE = {
    "line": "concat(image_path, chr(0), cmdline, chr(0), CASE k % 9 WHEN 0 THEN '%TEMP%' WHEN 1 THEN 'nc -l 80 | sh' WHEN 2 THEN '--decode' WHEN 3 THEN 'chmod +x a;(b)' WHEN 4 THEN '> /dev/tcp/x' WHEN 5 THEN '' WHEN 6 THEN '`id` & <$x' WHEN 7 THEN 'a|bash' ELSE '%AppData%' END)",
    "parent": "CASE k % 8 WHEN 0 THEN '/usr/sbin/NGINX' WHEN 1 THEN 'Excel' WHEN 2 THEN '/bin/fish' WHEN 3 THEN 'dotnet' WHEN 4 THEN 'outlook.exe.bak' WHEN 5 THEN 'PWSH' ELSE NULL END",
    "place": "CASE k % 7 WHEN 0 THEN '/System/Library/x' WHEN 1 THEN '/Dev/Shm/x' WHEN 2 THEN image_path WHEN 3 THEN '/usr/local/bin/y' WHEN 4 THEN '%APPDATA%' WHEN 5 THEN '/home/a/x' ELSE NULL END",
}


def _like(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{x.lower()}')" for x in parts) + ")"


_LINES = "l AS (SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in _LINE.items()) + " FROM ev WHERE type = 'exec')"
_CMD_SQL = (
    "length(line) AS cmd_length, list_aggregate(string_split(line, ''), 'entropy') AS cmd_entropy, "
    + " + ".join(f"contains(line, '{x}')::INT" for x in learning.SUSPICIOUS_TOKENS)
    + " AS cmd_suspicious, len(list_filter(string_split(line, chr(0)), lambda t: t != '')) AS cmd_tokens, list_max(list_transform(string_split(line, chr(0)), lambda t: length(t))) AS cmd_longest, "
    + "length(regexp_replace(line, '[^|;&$`()<>]', '', 'g')) AS cmd_meta, length(regexp_replace(line, '[^0-9]', '', 'g')) / length(line) AS cmd_digits, "
    + f"{_like('line', learning.SUSPICIOUS_WIN_PATHS)}::INT AS cmd_suspicious_path, {_like('line', learning.LEGIT_WIN_PATHS)}::INT AS cmd_system_path"
)
_NAME = "coalesce(lower(regexp_extract(parent, '([^/]*)$', 1)), '')"
_LINEAGE_SQL = (
    "(parent IS NOT NULL OR place IS NOT NULL)::INT AS has_parent, "
    + ", ".join(f"({_NAME} IN ({', '.join(map(repr, names))}))::INT AS parent_{c}" for c, names in (("shell", learning.SHELL_COMMS), ("webserver", learning.WEBSERVER_COMMS), ("office", learning.OFFICE_COMMS)))
    + f", coalesce({_like('place', learning.SYSTEM_PATHS)}, false)::INT AS parent_system_path, coalesce({_like('place', learning.SUSPICIOUS_PATHS)}, false)::INT AS parent_suspicious_path"
)


def _lines(ev):
    return of_type(ev, "exec").withColumns({c: F.expr(e) for c, e in _LINE.items()})


@on_ev("cmdline_features", f"SELECT event_id, {_CMD_SQL} FROM l", _LINES)
def _(ev):
    return _lines(ev).select("event_id", *(c.alias(n) for n, c in learning.cmdline_features(F.col("line")).items()))


@on_ev("lineage_features", f"SELECT event_id, {_LINEAGE_SQL} FROM l", _LINES)
def _(ev):
    return _lines(ev).select("event_id", *(c.alias(n) for n, c in learning.lineage_features(F.col("parent"), F.col("place")).items()))


_COMBINED = ["spawn", "connect", "filewrite", "distinct_daddr", "distinct_dport", "full_chain", "span_s", "event_count"]
_VECTOR_SQL = f"cv AS (SELECT agent_id, pid, max((type = 'exec')::INT) AS spawn, max((type = 'connect')::INT) AS connect, max((type = 'file_open' AND ((flags & 3) IN (1, 2) OR (flags & 64) != 0))::INT) AS filewrite, count(DISTINCT daddr) FILTER (type = 'connect') AS distinct_daddr, count(DISTINCT dport) FILTER (type = 'connect') AS distinct_dport, (max(ts_us) - min(ts_us)) / 1e6 AS span_s, count(*) AS event_count, spawn * connect * filewrite AS full_chain FROM (SELECT *, max(ts_us) OVER (PARTITION BY agent_id, pid) AS l FROM ev) WHERE ts_us >= l - {10 * DAY} GROUP BY agent_id, pid)"


@on_ev("combined_features", f"SELECT event_id, {_CMD_SQL}, {_LINEAGE_SQL}, {', '.join(_COMBINED)} FROM l JOIN cv USING (agent_id, pid)", _LINES.replace("SELECT event_id,", "SELECT event_id, agent_id, pid,") + ", " + _VECTOR_SQL)
def combined(ev):
    vec = fleet.correlation_vector(ev, ["agent_id", "pid"], 10 * DAY)
    rows = _lines(ev).join(vec, ["agent_id", "pid"], "left")
    features = learning.cmdline_features(F.col("line")) | learning.lineage_features(F.col("parent"), F.col("place"))
    return rows.select("event_id", *(c.cast("double").alias(n) for n, c in features.items()), *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in _COMBINED))


@register("behavior_model")
def _(spark, d):
    rows = combined(telemetry(spark, d))
    _, about = learning.train_forest(rows.select(F.array(*(c for c in rows.columns if c != "event_id")).alias("features")))
    return spark.createDataFrame([tuple(about.values())], ", ".join(f"{k} {'long' if k.startswith('n_') else 'double'}" for k in about))


@register("train_calibrate_split")
def _(spark, d):
    return learning.split(telemetry(spark, d), "event_id").select("event_id", "part")


@on_ev("llr_calibration", "SELECT feature, bin, ln((pos + 0.5) / (sum(pos) OVER f + 0.5 * count(*) OVER f) / ((neg + 0.5) / (sum(neg) OVER f + 0.5 * count(*) OVER f))) AS llr FROM (SELECT feature, bin, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM (SELECT k % 2 = 0 AS y, 'comm' AS feature, comm AS bin FROM ev UNION ALL SELECT k % 2 = 0, 'type', type FROM ev) GROUP BY ALL) WINDOW f AS (PARTITION BY feature)")
def _(ev):
    return learning.llr(ev.withColumn("y", F.col("k") % 2 == 0), ["comm", "type"], "y").select("feature", "bin", "llr")


@register("malicious_pid_labels", "SELECT DISTINCT 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS pid FROM events")
def _(spark, d):
    text = F.concat(F.lit("alert pid="), F.col("pid").cast("string"), F.lit(" comm="), F.col("comm"))
    return telemetry(spark, d).select(F.explode(F.regexp_extract_all(text, F.lit(r"pid=([0-9]+)"), F.lit(1))).alias("pid")).distinct().select(F.col("pid").cast("long"))


@on_ev("conformal_threshold", "SELECT quantile_cont(value, 0.005) AS threshold, count(value) AS n FROM ev")
def _(ev):
    return learning.conformal_threshold(ev, "value")


@on_ev("feature_bounds", "SELECT 'k' AS feature, min(k) - 0.05::DOUBLE * (max(k) - min(k)) AS lo, max(k) + 0.05::DOUBLE * (max(k) - min(k)) AS hi FROM ev UNION ALL SELECT 'flags', min(flags) - 0.05::DOUBLE * (max(flags) - min(flags)), max(flags) + 0.05::DOUBLE * (max(flags) - min(flags)) FROM ev")
def _(ev):
    return learning.bounds(ev, ["k", "flags"])


@on_ev("gated_score", "SELECT event_id, CASE WHEN k % 7 < 3 THEN 'too_few' WHEN k >= 90 THEN 'out_of_bounds' WHEN value >= 50 THEN 'benign' ELSE 'scored' END AS outcome, CASE WHEN NOT (k % 7 < 3) AND k < 90 AND NOT (value >= 50) THEN value END AS score FROM ev")
def _(ev):
    return ev.select("event_id", learning.gated_score(F.col("k") % 7, F.col("k") < 90, F.col("value"), 50.0).alias("s")).select("event_id", "s.outcome", "s.score")


@on_ev("score_to_llr", "SELECT event_id, greatest(-1.0, least(3.0, -20 * (value / 1000 - 0.05)))::DOUBLE AS llr FROM ev")
def _(ev):
    return ev.select("event_id", learning.score_to_llr(F.col("value") / 1000 - 0.05).alias("llr"))


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@register("isolation_forest_fit")
def _(spark, d):
    return learning.forest_fit(_vectors(spark, d), trees=50)


@register("isolation_forest_score")
def _(spark, d):
    v = _vectors(spark, d)
    return learning.forest_score(v, learning.forest_fit(v, trees=50)).select("id", "depth", "expected_depth", "score")


@register("attribution")
def _(spark, d):
    v = _vectors(spark, d)
    return learning.forest_score(v, learning.forest_fit(v, trees=50)).select("id", F.posexplode("attribution").alias("feature", "contribution"))


@register("mutators")
def _(spark, d):
    return learning.mutate(of_type(telemetry(spark, d), "exec").select(F.col("event_id").alias("id"), "cmdline", "parent_comm"))


def _judged(spark, d, tenant: str | None = None):
    """Mutants' scores before and after by the forest of a tenant's (or all) command lines and parents, and the score that 5 in 100 of those fall below."""
    rows = of_type(telemetry(spark, d), "exec").select("tenant_id", F.col("event_id").alias("id"), "cmdline", "parent_comm")

    def vector(cmd: Column, parent: Column):
        features = learning.cmdline_features(cmd) | learning.lineage_features(parent, F.lit(None).cast("string"))
        return F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in features.values()))

    # what is equal is scored once
    learnt = rows.where(F.col("tenant_id") == tenant) if tenant else rows
    nodes = learning.forest_fit(learnt.select("id", F.struct("cmdline", "parent_comm").alias("features")), trees=50, vector=lambda x: vector(x["cmdline"], x["parent_comm"]))
    forest = learning.Forest(nodes.toPandas())
    lines = learnt.groupBy("cmdline", "parent_comm").agg(F.count(F.lit(1)).alias("n")).select("n", vector(F.col("cmdline"), F.col("parent_comm")).alias("score"))
    threshold = learning.group_quantile(learning.forest_scores(lines, forest, ["score"]), [], "score", 5.0 / 100.0, "n").first()["quantile"]
    mutants = learning.mutate(rows).groupBy("mutator", "intensity", "cmdline", "parent_comm", "new_cmdline", "new_parent").agg(F.count(F.lit(1)).alias("n"))
    both = mutants.select("mutator", "intensity", "n", *(vector(F.col(cmd), F.col(parent)).alias(when) for cmd, parent, when in (("cmdline", "parent_comm", "before"), ("new_cmdline", "new_parent", "after"))))
    scored = learning.forest_scores(both, forest, ["before", "after"])
    at = f"{spark.conf.get('spark.checkpoint.dir', None) or _own_folder(spark)}/judged-{uuid4().hex}"
    scored.write.parquet(at)
    return learning.robustness(spark.read.schema(scored.schema).parquet(at), threshold)


@register("robustness_eval")
def _(spark, d):
    return _judged(spark, d)


@register("global_floor_check")
def _(spark, d):
    return learning.floor_check(_judged(spark, d, "tenant-0"), _judged(spark, d))


@on_ev("dataset_manifest", "SELECT count(*) AS samples FROM ev WHERE type = 'exec'")
def _(ev):
    from uuid import uuid4

    from ..sources import ingest

    at = f"{ev.sparkSession.conf.get('spark.checkpoint.dir', None) or _own_folder(ev.sparkSession)}/corpus-{uuid4().hex}"
    rows = of_type(ev, "exec").select(F.lit("v1").alias("version"), (F.col("ts_us") * 1000).alias("timestamp_ns"), "cmdline")
    return ingest.export_corpus(rows, "v1", at).agg(F.sum("samples").alias("samples"))


def _own_folder(spark: SparkSession) -> str:
    """Where nothing is set, as in tests, a folder of our own; a cluster has none that all would see."""
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="wardlake-"))
    return spark.conf.get("spark.checkpoint.dir")


@on_ev("lake_layout", "SELECT tenant_id, type, count(*) AS n FROM ev GROUP BY ALL")
def _(ev):
    from uuid import uuid4

    from ..sources import ingest

    at = f"{ev.sparkSession.conf.get('spark.checkpoint.dir', None) or _own_folder(ev.sparkSession)}/lake-{uuid4().hex}"
    ingest.write_lake(ev.select("tenant_id", "type", "ts_us", "event_id"), at)
    return ev.sparkSession.read.parquet(at).groupBy("tenant_id", "type").agg(F.count(F.lit(1)).alias("n"))
