"""Single-event detections: all rules of a type in one projection, so that events are read once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

# Names, paths, ports, flags and techniques that the rules go by.
PERSISTENCE = [("T1546.004", ".bashrc"), ("T1546.004", ".zshrc"), ("T1546.004", "/etc/profile.d/"), ("T1053.003", "/etc/cron.d/"), ("T1543.002", "/etc/systemd/system/"), ("T1037.004/T1053.003", "/Library/LaunchAgents/"), ("T1037.004/T1053.003", "/Library/LaunchDaemons/"), ("T1037.004/T1053.003", "/etc/periodic/"), ("T1037.004/T1053.003", "/var/at/tabs/")]
TASK_CREATED, TASK_REPOINTED, TASK_ACTION_UNKNOWN = 0x20000000, 0x00800000, 0x00400000
SERVICE_INSTALLED, ACCOUNT_CREATED, UNIT_STARTED, LAUNCH_ITEM = 0x10000000, 0x08000000, 0x40000000, 0x04000000
TASK_HIJACK = ["\\appdata\\", "\\temp\\", "\\downloads\\", "\\users\\public\\", "\\programdata\\", "%temp%", "%tmp%", "%appdata%", "%localappdata%", "%public%", "%userprofile%", "%programdata%", "cmd.exe", "powershell", "pwsh", "mshta", "wscript", "cscript", "rundll32", "regsvr32"]
DATABASE_COMMS = ["mysqld", "mariadbd"]
DATABASE_PATHS = ["/var/lib/mysql/", "/var/lib/mariadb/", "/var/log/mysql/", "/var/log/mariadb/", "/run/mysqld/", "/var/run/mysqld/", "/tmp/"]
UNIX_BINARIES = {"bash": ["/bin/", "/usr/bin/", "/usr/local/bin/"], "sh": ["/bin/", "/usr/bin/"], "zsh": ["/bin/", "/usr/bin/"], "sshd": ["/usr/sbin/", "/usr/libexec/", "/usr/lib/ssh/", "/usr/lib/openssh/"], "sudo": ["/usr/bin/", "/bin/"], "systemd": ["/usr/lib/systemd/", "/lib/systemd/"], "launchd": ["/sbin/"], "cron": ["/usr/sbin/", "/usr/bin/"], "login": ["/usr/bin/", "/bin/"]}
_SYS32, _WOW64 = "c:\\windows\\system32\\", "c:\\windows\\syswow64\\"
WINDOWS_BINARIES = {"svchost.exe": [_SYS32, _WOW64], "lsass.exe": [_SYS32], "services.exe": [_SYS32], "csrss.exe": [_SYS32], "winlogon.exe": [_SYS32], "smss.exe": [_SYS32], "explorer.exe": ["c:\\windows\\", _WOW64], "powershell.exe": [_SYS32 + "windowspowershell\\", _WOW64 + "windowspowershell\\"], "rundll32.exe": [_SYS32, _WOW64]}
RECOVERY = [["vssadmin", "delete", "shadows"], ["wmic", "shadowcopy", "delete"], ["wbadmin", "delete", "catalog"], ["bcdedit", "recoveryenabled", "no"], ["tmutil", "deletelocalsnapshots"]]
LOG_CLEAR = [("T1070.001", ["wevtutil", "cl"]), ("T1070.001", ["wevtutil", "clear-log"]), ("T1070.001", ["clear-eventlog"]), ("T1070.002", ["log", "erase"]), ("T1070.002", ["journalctl", "--vacuum"])]
LOG_PATHS = [("T1070.002", "/var/log/"), ("T1070.002", "/private/var/log/"), ("T1070.002", "/log/journal/"), ("T1070.001", ".evtx")]
TAMPER_SIGNALS, STOP_SIGNAL, STOP_SIGNAL_MACOS = [1, 2, 3, 6, 9, 15], 19, 17
SERVICES, SERVICE_PREFIXES = ["nginx", "apache2", "httpd", "mysqld", "mariadbd", "postgres"], ["php-fpm"]
SERVICE_PORTS = [80, 443, 8080, 8443, 8000, 3306, 5432, 6379, 11211, 9200, 27017]
LD_TRUSTED = ["/lib/", "/lib64/", "/usr/lib/", "/usr/lib64/", "/usr/local/lib/"]
# What scanned scripts are searched for, in lower case; the short words count as whole words only.
PROVIDER_DETECTED, CRADLE_BYTES = 32768, 300
FETCH = ["downloadstring(", "downloaddata(", "downloadfile(", "net.webclient", "invoke-webrequest", "invoke-restmethod", "start-bitstransfer", "system.net.http.httpclient"]
FETCH_WORDS = ["iwr", "irm", "wget", "curl"]
RUN, RUN_WORDS = ["invoke-expression", "[scriptblock]::create("], ["iex"]
MANIFEST_KEYS = ["moduleversion", "cmdletstoexport", "functionstoexport"]
SCAN_TAMPER = ["amsiutils", "amsiinitfailed", "amsiscanbuffer", "amsicontext", "amsiopensession"]
REFLECTIVE_LOAD, BYTES_IN_MEMORY = ["reflection.assembly]::load(", "assembly]::load("], ["frombase64string(", "decompress", "gzipstream"]
CREDENTIAL_MODULES = ["invoke-mimikatz", "sekurlsa::", "lsadump::", "kerberos::golden", "kerberos::ptt", "privilege::debug"]
SCRIPT_HOSTS = ["vbscript", "jscript", "office_vba"]
LAUNCH_CALLS = ["iwshshell3.run(", "iwshshell3.exec(", "shell(", ".shellexecute("]
LAUNCHED = ["powershell", "pwsh", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin", "wscript", "cscript"]


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    technique: Column
    severity: str
    holds: Column


def contains_all(text: Column, tokens: list[str]) -> Column:
    out = F.lit(True)
    for t in tokens:
        out = out & F.contains(text, F.lit(t))
    return out


def contains_any(text: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(text, F.lit(t))
    return out


def first_of(pairs: list[tuple[str, Column]]) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(None).cast("string")
    for label, holds in reversed(pairs):
        out = F.when(holds, label).otherwise(out)
    return out


def starts_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


def masquerades(path: Column) -> Column:
    """A system binary's name outside its directories."""
    unix = F.startswith(path, F.lit("/"))
    name = F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)
    drive = F.substring(path, 2, 1) == ":"
    out = F.lit(False)
    for table, known, key in ((UNIX_BINARIES, unix, name), (WINDOWS_BINARIES, ~unix & drive, F.lower(name))):
        for binary, dirs in table.items():
            out = out | (known & (key == binary) & ~starts_any(F.lower(path), dirs))
    return out


def preload_hijack(value: Column, trusted: tuple[str, ...] = ()) -> Column:
    """A list of libraries with an absolute path outside the linker's directories and those that the host trusts besides."""
    parts = F.filter(F.split(value, ":"), lambda p: F.startswith(p, F.lit("/")))
    return F.exists(parts, lambda p: ~starts_any(p, [*LD_TRUSTED, *trusted]))


def preloaded(env: Column) -> Column:
    """The value of the first variable of an environment, (name, value) each, that makes the linker load libraries."""
    return F.get(F.filter(env, lambda v: v["name"].isin("LD_PRELOAD", "LD_AUDIT")), F.lit(0))["value"]


_IN_WORD = r"[\p{IsAlphabetic}\p{N}_-]"


def one_of(markers: list[str], words: list[str] = ()) -> str:
    """A pattern of markers anywhere, or of whole words."""
    plain = [re.escape(m) for m in markers]
    return "|".join([*plain, *([f"(?<!{_IN_WORD})(?:{'|'.join(map(re.escape, words))})(?!{_IN_WORD})"] if words else [])])


def by_bytes(text: Column) -> Column:
    """text with each character beyond ASCII written as many times as it has bytes: letters stay letters, so that distances are in bytes."""
    letters = r"[\p{IsAlphabetic}\p{N}]"
    for low, high, n in ((r"\x{80}", r"\x{7FF}", 2), (r"\x{800}", r"\x{FFFF}", 3), (r"\x{10000}", r"\x{10FFFF}", 4)):
        text = F.regexp_replace(text, f"[{low}-{high}&&{letters}]", "\u0100" * n)
        text = F.regexp_replace(text, f"[{low}-{high}&&[^\\p{{IsAlphabetic}}\\p{{N}}]]", "\u00A7" * n)
    return text


def download_cradle(text: Column) -> Column:
    """Something that fetches and something that executes start within so many bytes of each other, in a text that is no module manifest."""
    t = F.lower(text)
    manifest = F.startswith(F.ltrim(F.regexp_replace(t, r"^\s+", "")), F.lit("@{")) & contains_any(t, MANIFEST_KEYS)
    fetch, run = one_of(FETCH, FETCH_WORDS), one_of(RUN, RUN_WORDS)
    gap = f".{{0,{CRADLE_BYTES}}}?"
    near = by_bytes(t).rlike(f"(?s)(?=(?:{fetch})){gap}(?=(?:{run}))|(?=(?:{run})){gap}(?=(?:{fetch}))")
    return ~manifest & near


def rules(c=F.col) -> list[Rule]:
    """Rules over the columns type, cmdline, path, flags, image_path, comm, daddr, dport, those of OPTIONAL, and the name of the process, resolved_comm."""
    cmd, path, flags = c("cmdline"), c("path"), c("flags")
    low = F.lower(cmd)
    bit = lambda n: flags.bitwiseAND(F.lit(n).cast("long")) != 0
    tokens = F.split(low, r"[\s\x00]+")
    persistence = first_of([(t, F.contains(path, F.lit(p))) for t, p in PERSISTENCE])
    clear = first_of([(t, contains_all(low, words)) for t, words in LOG_CLEAR])
    deleted = first_of([(t, F.contains(path, F.lit(p))) for t, p in LOG_PATHS])
    service = c("comm").isin(*SERVICES) | starts_any(c("comm"), SERVICE_PREFIXES)
    hijack = contains_any(F.regexp_replace(F.lower(path), "/", r"\\"), TASK_HIJACK)
    script, low_script = c("content"), F.lower(c("content"))
    lit = F.lit
    return [
        Rule("base64_decode", "exec", lit("T1059.004"), "medium", F.contains(cmd, lit("base64")) & contains_any(cmd, ["-d", "-D", "--decode"])),
        Rule("encoded_powershell", "exec", lit("T1059.001"), "medium", contains_any(low, ["powershell", "pwsh"]) & (F.array_contains(tokens, "-encodedcommand") | F.array_contains(tokens, "-enc"))),
        Rule("persistence_write", "file_open", persistence, "high", persistence.isNotNull() & S.has_write_intent(flags)),
        Rule("proc_root_escape", "file_open", lit("T1611"), "high", c("container").isNotNull() & path.rlike(r"^/*proc/+[0-9]+/+root(/|$)")),
        Rule("scheduled_task_created", "file_open", lit("T1053.005"), "medium", bit(TASK_CREATED)),
        Rule("scheduled_task_repointed", "file_open", lit("T1053.005"), "high", bit(TASK_REPOINTED) & (bit(TASK_ACTION_UNKNOWN) | hijack)),
        Rule("service_installed", "file_open", lit("T1543.003"), "high", bit(SERVICE_INSTALLED)),
        Rule("account_created", "file_open", lit("T1136.001"), "high", bit(ACCOUNT_CREATED)),
        Rule("systemd_unit_started", "file_open", lit("T1543.002"), "medium", bit(UNIT_STARTED)),
        Rule("launch_item_registered", "file_open", lit("T1543.001/T1547.015"), "medium", bit(LAUNCH_ITEM)),
        Rule("masquerading", "exec", lit("T1036.005"), "high", masquerades(c("image_path"))),
        Rule("recovery_inhibit", "exec", lit("T1490"), "high", first_of([("x", contains_all(low, words)) for words in RECOVERY]).isNotNull()),
        Rule("log_clear_exec", "exec", clear, "high", clear.isNotNull()),
        Rule("log_file_delete", "file_delete", deleted, "medium", deleted.isNotNull()),
        Rule("ld_preload_hijack", "exec", lit("T1574.006"), "high", preload_hijack(preloaded(c("env_security")))),
        Rule("database_write_outside", "file_open", lit("T1190"), "high", S.has_write_intent(flags) & F.startswith(path, lit("/")) & (path != "/tmp") & ~starts_any(path, DATABASE_PATHS) & c("resolved_comm").isin(*DATABASE_COMMS)),
        Rule("security_process_signal", "signal", lit("T1562.001"), "high", c("signal").isin(*TAMPER_SIGNALS) | (c("signal") == F.when(c("os") == "macos", STOP_SIGNAL_MACOS).otherwise(STOP_SIGNAL))),
        Rule("scan_provider_detected", "script_scan", lit("T1059"), "high", c("scan_result") >= PROVIDER_DETECTED),
        Rule("download_cradle", "script_scan", lit("T1059.001/T1105"), "high", download_cradle(script)),
        Rule("scan_tampering", "script_scan", lit("T1562.001"), "high", contains_any(low_script, SCAN_TAMPER)),
        Rule("reflective_load", "script_scan", lit("T1620"), "high", contains_any(low_script, REFLECTIVE_LOAD) & contains_any(low_script, BYTES_IN_MEMORY)),
        Rule("credential_module", "script_scan", lit("T1003.001"), "high", contains_any(low_script, CREDENTIAL_MODULES)),
        Rule("script_host_launch", "script_scan", lit("T1059.005/T1059.007"), "medium", starts_any(F.lower(c("app_name")), SCRIPT_HOSTS) & contains_any(low_script, LAUNCH_CALLS) & low_script.rlike(one_of([], LAUNCHED))),
        Rule("service_unusual_outbound", "connect", lit("T1071"), "medium", service & ~S.ip_class(c("daddr")).isin("loopback", "unspecified") & ~c("dport").isin(*SERVICE_PORTS)),
    ]


#: Columns of some sources only; a rule over a column that is absent never holds.
OPTIONAL = {"container": "string", "env_security": "array<struct<name:string,value:string>>", "resolved_comm": "string", "signal": "int", "os": "string", "scan_result": "long", "app_name": "string", "content": "string"}


def detect(ev: DataFrame, only: list[str] | None = None, id_columns: tuple[str, ...] = ("event_id", "tenant_id", "agent_id", "ts_us")) -> DataFrame:
    """A row for each event and rule that holds: ids, rule, technique, severity."""
    at = lambda name: F.lit(None).cast(OPTIONAL[name]) if name in OPTIONAL and name not in ev.columns else F.col(name)
    chosen = [r for r in rules(at) if only is None or r.name in only]
    found = F.filter(
        F.array(*(F.when((F.col("type") == r.type) & F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.technique.alias("technique"), F.lit(r.severity).alias("severity"))) for r in chosen)),
        lambda x: x.isNotNull(),
    )
    return ev.where(F.col("type").isin(*{r.type for r in chosen})).select(*id_columns, F.inline(found))


def content_signatures(docs: DataFrame, text: str, signatures: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """docs with an array of the signatures that match: name -> (all or any, byte strings)."""
    t = F.lower(F.col(text))
    hits = [F.when(contains_all(t, words) if how == "all" else contains_any(t, words), F.lit(name)) for name, (how, words) in signatures.items()]
    return docs.withColumn("matched", F.filter(F.array(*hits), lambda x: x.isNotNull()))


# What the values of request parameters contain, or are; names of web shells; what scanners call themselves, and their names.
SQL_INJECTION = ["union select", "union all select", "' or '", "\" or \"", "' or 1=1", " or 1=1", "'or'1'='1", "sleep(", "benchmark(", "waitfor delay", "information_schema", "xp_cmdshell", "load_file(", "into outfile", "; drop table", "extractvalue(", "updatexml("]
EXECUTION = ["base64_decode(", "eval(", "system(", "passthru(", "shell_exec(", "proc_open(", "cmd.exe", "/bin/sh", "/bin/bash", "wget http", "curl http", "uname -a"]
SHELL_COMMANDS = ["id", "whoami", "ls", "pwd", "ifconfig", "ipconfig"]
WEBSHELL_STEMS = ["c99", "r57", "wso", "b374k", "alfa", "webshell", "china", "chopper", "indoxploit"]
SCANNERS = {"sqlmap": "sqlmap", "nikto": "nikto", "masscan": "masscan", "nmap scripting engine": "nmap", "wpscan": "wpscan", "dirbuster": "dirbuster", "gobuster": "gobuster", "feroxbuster": "feroxbuster", "ffuf": "ffuf", "nuclei": "nuclei", "acunetix": "acunetix", "nessus": "nessus", "openvas": "openvas", "zgrab": "zgrab", "havij": "havij", "w3af": "w3af", "hydra": "hydra"}
NAME_CHARS, VALUE_CHARS = 64, 128


def _climbs(text: Column) -> Column:
    return text.rlike(r"\.\./|\.\.\\|/\.\.$")


def http_signature(target: Column, agent: Column, status: Column) -> Column:
    """The first signature that a request matches, with the parameter that shows it or the scanner's name; else null.

    Parameters are split before they are decoded, so that an encoded separator splits nothing.
    """
    params = F.transform(S.target_params(target), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), S.url_normalise(p["value"]).alias("v")))
    path = S.url_normalise(S.target_path(target))
    stem = F.substring_index(F.substring_index(path, "/", -1), ".", 1)
    first = lambda test: F.get(F.filter(params, lambda p: test(p["v"])), F.lit(0))
    scanner = first_of([(name, F.contains(F.lower(agent), F.lit(word))) for word, name in SCANNERS.items()])

    def found(signature: str, param: Column | None = None, tool: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        name, value = (none, none) if param is None else (F.left(param["name"], F.lit(NAME_CHARS)), F.left(param["value"], F.lit(VALUE_CHARS)))
        return F.struct(F.lit(signature).alias("signature"), name.alias("name"), value.alias("value"), (none if tool is None else tool).alias("scanner"))

    sql, climb = first(lambda v: v.rlike(one_of(SQL_INJECTION))), first(_climbs)
    shell = first(lambda v: v.rlike(one_of(EXECUTION)) | v.isin(*SHELL_COMMANDS))
    return (
        F.when(sql.isNotNull(), found("sql_injection", sql))
        .when(_climbs(path), found("path_traversal"))
        .when(climb.isNotNull(), found("path_traversal", climb))
        .when(shell.isNotNull(), found("webshell_like", shell))
        .when(status.between(200, 299) & stem.isin(*WEBSHELL_STEMS), found("webshell_like"))
        .when(scanner.isNotNull(), found("scanner_user_agent", None, scanner))
    )


GRAM = 4


def _conditions(definitions: DataFrame, keywords: str) -> DataFrame:
    """rule_id, level, group, field, kind (contains, startswith, endswith, equals), literal: values in lower case, their stars turned into kinds."""
    how, v = F.lower(F.coalesce("modifier", F.lit(""))), F.lower("value")
    named = how.isin("contains", "startswith", "endswith")
    first, last = F.startswith(v, F.lit("*")), F.endswith(v, F.lit("*"))
    glob = F.when(first & last, "contains").when(first, "endswith").when(last, "startswith").when(F.col("field").isNull(), "contains").otherwise("equals")
    literal = F.when(named | ~(first | last), v).otherwise(F.regexp_replace(v, r"^\*+|\*+$", ""))
    field = F.lower(F.coalesce("field", F.lit(keywords)))
    group = F.when(F.col("field").isNull(), F.lit("")).otherwise(F.concat_ws("|", field, F.when(named, how)))
    rows = definitions.where("value IS NOT NULL").select("rule_id", "level", group.alias("group"), field.alias("field"), F.when(named, how).otherwise(glob).alias("kind"), literal.alias("literal"))
    return rows.distinct()


def _met(text: Column, kind: Column, literal: Column) -> Column:
    tests = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith, "equals": lambda a, b: a == b}
    return F.coalesce(*(F.when(kind == name, test(text, literal)) for name, test in tests.items()), F.lit(False))


def _grams(text: Column, n: int) -> Column:
    """All pieces of n characters; none of a shorter text."""
    if n == 0:
        return F.array(F.lit(""))
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def sigma(ev: DataFrame, definitions: DataFrame, keywords: str = "cmdline") -> DataFrame:
    """ev's columns with rule_id and level, for each event and rule that holds.

    Rules are rows (rule_id, level, field, modifier, value): AND over the fields with their modifiers, OR over the values of one, case ignored. Without a modifier a star at an end of a value
    stands for anything. Values without a field are keywords, looked for in one column. A field that events lack, or null, matches nothing.

    Rules are found by an inverted index, so their number only matters where they may hold: each rule is represented by the condition with the longest values, each of those values by the piece of
    GRAM characters that is rarest among the events' texts; pieces of the events' distinct texts are joined to those, and the rule is then checked in full on the distinct combinations of texts.
    """
    conds = _conditions(definitions, keywords)
    columns = {c.lower(): c for c in (f.name for f in ev.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)))}
    used = sorted({r["field"] for r in conds.select("field").distinct().where(F.col("field").isin(*columns)).collect()})  # no more than ev has columns
    if not used:
        return ev.withColumns({"rule_id": F.lit(None).cast("string"), "level": F.lit(None).cast("string")}).where("false")
    values = conds.groupBy("rule_id", "level", "group", "field").agg(F.collect_set(F.struct("kind", "literal")).alias("values"), F.min(F.length("literal")).alias("shortest"))
    rules_ = values.groupBy("rule_id", "level").agg(F.collect_list(F.struct("field", "values")).alias("groups"), F.max(F.struct("shortest", "group"))["group"].alias("group"))
    leading = conds.join(rules_.select("rule_id", "level", "group"), ["rule_id", "level", "group"]).where(F.col("field").isin(*used))

    texts = F.struct(*(F.lower(F.col(f"`{columns[f]}`").cast("string")).alias(f) for f in used))
    shaped = ev.withColumn("__texts", texts).withColumn("__shape", F.md5(F.to_json("__texts")))
    shapes = shaped.groupBy("__shape").agg(F.first("__texts").alias("__texts"))
    one = shapes.select("__shape", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"__texts.{f}").alias("text")) for f in used)))).where("text IS NOT NULL")

    literals = leading.select("field", "kind", "literal").distinct()
    lengths = sorted(r[0] for r in literals.select(F.least(F.length("literal"), F.lit(GRAM))).distinct().collect())  # 0 to GRAM
    pieces = one.select("field", "text").distinct().select("field", "text", F.explode(F.array_distinct(F.concat(*(_grams(F.col("text"), n) for n in lengths)))).alias("gram")) if lengths else one.withColumn("gram", F.lit("")).where("false")
    inner = F.when(F.length("literal") < GRAM, F.array("literal")).otherwise(_grams(F.col("literal"), GRAM))
    of_literal = F.when(F.col("kind") == "contains", F.array_distinct(inner)).when(F.col("kind") == "endswith", F.array(F.right("literal", F.lit(GRAM)))).otherwise(F.array(F.left("literal", F.lit(GRAM))))
    offered = literals.select("*", F.explode(of_literal).alias("gram"))
    often = pieces.join(offered.select("field", "gram").distinct(), ["field", "gram"], "left_semi").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    index = offered.join(often, ["field", "gram"], "left").groupBy("field", "kind", "literal").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = pieces.join(index, ["field", "gram"]).where(_met(F.col("text"), F.col("kind"), F.col("literal")))
    found = near.join(leading, ["field", "kind", "literal"]).select("field", "text", "rule_id", "level").distinct()
    found = found.join(one, ["field", "text"]).select("__shape", "rule_id", "level").distinct()

    by_name = F.create_map(*(x for f in used for x in (F.lit(f), F.col(f"__texts.{f}"))))
    holds = F.forall("groups", lambda g: F.exists(g["values"], lambda v: _met(F.element_at(by_name, g["field"]), v["kind"], v["literal"])))
    met = found.join(rules_.select("rule_id", "level", "groups"), ["rule_id", "level"]).join(shapes, "__shape").where(holds).select("__shape", "rule_id", "level")
    return shaped.join(met, "__shape").select(*(f"`{c}`" for c in ev.columns), "rule_id", "level")
