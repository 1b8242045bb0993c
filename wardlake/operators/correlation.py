"""Co-occurrence of a process's events in a window."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import primitives as P
from .windows import HOST, SECOND

#: Names that are let pass, compared in lower case.
IGNORED = [
    "svchost.exe",
    "SearchProtocolHost.exe",
    "MsMpEng.exe",
    "WmiPrvSE.exe",
    "taskhostw.exe",
    "backgroundTaskHost.exe",
    "RuntimeBroker.exe",
    "WindowsPackageManagerServer.exe",
    "SoftLandingTask.exe",
    "msedge.exe",
    "conhost.exe",
    "CrossDeviceServ",
    "SecurityHealthH",
    "System",
    "MoUsoCoreWorker",
    "backgroundTaskH",
    "nordvpn-service",
]
BELIEF_SPARED = ["wget", "chronyd"]
PAYLOAD_ENDINGS = [".exe", ".dll", ".bat", ".ps1", ".vbs", ".hta", ".cmd", ".scr", ".msi", ".jar", ".js", ".jse"]
DROP_PARTS = ["\\temp\\", "\\tmp\\", "\\downloads\\", "\\startup\\", "/downloads/"]
DROP_ROOTS = ["/tmp/", "/var/tmp/", "/dev/shm/"]


def payload_file(path: Column) -> Column:
    """Whether a path names something that runs, or lies where droppers write."""
    p = F.lower(path)
    tests = [*(F.endswith(p, F.lit(x)) for x in PAYLOAD_ENDINGS), *(F.contains(p, F.lit(x)) for x in DROP_PARTS), *(F.startswith(p, F.lit(x)) for x in DROP_ROOTS)]
    return reduce(operator.or_, tests)


def flags(ev: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """For each event, which kinds of events its process has had within width, and how often its entity was started."""
    probe = (S.ip_class(F.col("daddr")) == "unspecified") & (F.col("dport") == 65535)
    kinds = {
        "has_exec": F.col("type") == "exec",
        "has_connect": (F.col("type") == "connect") & ~F.coalesce(probe, F.lit(False)),
        "has_write": (F.col("type") == "file_open") & S.has_write_intent(F.col("flags")) & payload_file(F.col("path")),
        "has_assembly": F.col("type") == "assembly_load",
        "has_smb": F.col("type") == "smb_connect",
    }
    rows = ev.withColumn("__gen", F.coalesce("process_generation", F.lit(-1)))
    keys = [*HOST, "pid", "__gen"]
    for name, test in kinds.items():
        rows = P.sliding_sum(rows, keys, "ts_us", F.coalesce(test, F.lit(False)).cast("long"), width, "event_id", name).withColumn(name, F.col(name) > 0)
    entity = [*HOST, "ppid", "comm"]
    for name in ("exec", "connect"):
        rows = P.sliding_sum(rows, entity, "ts_us", (F.col("type") == name).cast("long"), width, "event_id", f"entity_{name}s")
    return rows.drop("__gen")


def _listed(name: Column, names: list[str]) -> Column:
    return name.isin(*(n.lower() for n in names))


def spared(ev: DataFrame, names: list[str], out: str = "spared") -> DataFrame:
    """ev with whether an event bears a name that is let pass, and its process was never seen to borrow one.

    A process borrows a name of either list if its exec lies outside the system's directories or has another parent than is usual. The last such exec of
    its pid decides, if the generations can be the same.
    """
    base = F.lower(F.substring_index("comm", "\\", -1))
    last = F.substring_index("parent_comm", "\\", -1)
    ordinary = S.trusted_system_path(F.when(F.col("image_path") != "", F.col("image_path"))) & S.expected_parent(F.col("comm"), F.when(last != "", last))
    borrows = (F.col("type") == "exec") & _listed(base, [*IGNORED, *BELIEF_SPARED]) & ~ordinary
    w = Window.partitionBy(*HOST, "pid").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(borrows, F.struct(F.col("process_generation").alias("g"))), ignorenulls=True).over(w)
    rows = ev.withColumn("__mark", mark)
    borrowed = F.col("__mark").isNotNull() & P.same_generation(F.col("__mark.g"), F.col("process_generation"))
    return rows.withColumn(out, F.coalesce(_listed(base, names) & ~borrowed, F.lit(False))).drop("__mark")


def co_occurrence(ev: DataFrame, width: int = 60 * SECOND, suppress: bool = True, gate: bool = False) -> DataFrame:
    """Alerts of what occurs together in a process; a wider combination silences what it contains.

    gate: events of names that are let pass raise nothing, though they count for the others.
    """
    rows = flags(spared(ev, IGNORED, "__spared") if gate else ev, width)
    rows = rows.where("NOT __spared") if gate else rows
    e, c, w, a, s = (F.col(x) for x in ("has_exec", "has_connect", "has_write", "has_assembly", "has_smb"))
    full, smb = e & c & w, a & s
    entry = lambda holds, name, technique, severity: F.when(holds, F.struct(F.lit(name).alias("rule"), F.lit(technique).alias("technique"), F.lit(severity).alias("severity")))
    found = F.array(
        entry(full, "spawn_connect_filewrite", "T1105/T1059/T1071", "high"),
        entry(e & c & ~full, "spawn_connect", "T1059/T1071", "medium"),
        entry(c & w, "connect_filewrite", "T1105", "medium"),
        entry((F.col("entity_execs") >= 3) & (F.col("entity_connects") > 0), "respawn_connect", "T1059/T1071", "medium"),
        entry(smb, "assembly_smb", "T1021.002/T1055", "high"),
        entry(a & c & ~smb, "assembly_connect", "T1055/T1620", "high"),
        entry(e & s & ~smb, "exec_smb", "T1021.002", "medium"),
    )
    hits = rows.select("event_id", *HOST, "pid", F.coalesce("process_generation", F.lit(-1)).alias("generation"), "ts_us", F.inline(F.filter(found, lambda x: x.isNotNull())))
    return P.suppress_within(hits, [*HOST, "pid", "generation", "rule"], "ts_us", width, "event_id") if suppress else hits
