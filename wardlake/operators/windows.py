"""Keyed sliding-window detections, built from the primitives: threshold first, then suppression."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import primitives as P

HOST = ["tenant_id", "agent_id"]
SECOND = 1_000_000
#: Fixed values.
BROWSERS = ["chrome.exe", "firefox.exe", "msedge.exe", "opera.exe", "brave.exe", "iexplore.exe", "vivaldi.exe"]
STANDARD_PORTS = [80, 443, 53, 8080, 8443, 8000, 25, 587, 465, 993, 995, 143, 137, 138, 5353, 5355, 3478]
SELF_SPAWN_PARENTS = ["RuntimeBroker.exe"]
AGENT_HELPERS = ["wevtutil.exe", "auditpol.exe", "logman.exe"]
SELF_SPAWN_NAMES = ["MpCmdRun.exe", "mpcmdrun.exe", "TiWorker.exe", "svchost.exe", "wermgr.exe", "WerFault.exe", "WerFaultSecure.exe", "SecurityHealthH", "SecurityHealthHost.exe"]


def threshold(ev: DataFrame, keys: list[str], width: int, at_least: int, ts: str = "ts_us", order: str = "event_id") -> DataFrame:
    """Rows at which the key's count within width reaches the threshold, at most one a width."""
    keys = [*HOST, *keys]
    hot = P.sliding_count(ev, keys, ts, width, order).where(F.col("n") >= at_least)
    return P.suppress_within(hot, keys, ts, width, order)


def self_spawn(ev: DataFrame, width: int = 30 * SECOND, at_least: int = 3, windows: Column | None = None, own_pid: Column | None = None) -> DataFrame:
    """Execs of one name by one parent, at the threshold, on Windows (windows: which events are; all if not given).

    Not counted: programs of the system that start again as a matter of course, from their own places and by their usual parents; the children of a broker that runs from its
    own place, by the name that the parent's number last had; and the agent's own helpers (own_pid: the agent's process on that host).
    """
    from .joins import with_parent

    named = lambda c, names: F.lower(c).isin(*(n.lower() for n in names))
    trusted = S.trusted_system_path(F.col("image_path"))
    spared = named(F.col("comm"), SELF_SPAWN_NAMES) & trusted & S.expected_parent(F.col("comm"), F.col("parent_comm"))
    parent_path = F.col("parent_image_path") if "parent_image_path" in ev.columns else F.lit(None).cast("string")
    broker = named(F.col("parent"), SELF_SPAWN_PARENTS) & S.trusted_system_path(parent_path)
    helper = named(F.col("comm"), AGENT_HELPERS) & trusted & (F.col("ppid") == own_pid) if own_pid is not None else F.lit(False)
    rows = with_parent(ev).where(F.lit(True) if windows is None else F.coalesce(windows, F.lit(False)))
    quiet = [F.coalesce(x, F.lit(False)) for x in (spared, broker, helper)]
    return threshold(rows.where(~reduce(operator.or_, quiet)).drop("parent"), ["ppid", "comm"], width, at_least)


def beacon_spared() -> Column:
    """Destinations and programs that repeat themselves as a matter of course: browsers, usual ports, address probes, IPv4 multicast and broadcast."""
    probe = F.col("daddr").isin("0.0.0.0", "::") & (F.col("dport") == 65535)
    # a first part of 224 or more, or a last one of 255
    group = F.col("daddr").rlike(r"^(2(2[4-9]|[3-5][0-9])(\.[0-9]{1,3}){3}|[0-9]{1,3}(\.[0-9]{1,3}){2}\.255)$")
    tests = [F.lower("comm").isin(*BROWSERS), F.col("dport").isin(*STANDARD_PORTS), probe, group]
    tests = [F.coalesce(t, F.lit(False)) for t in tests]
    return reduce(operator.or_, tests)


def beacon(ev: DataFrame, width: int = 60 * SECOND, at_least: int = 3) -> DataFrame:
    return threshold(ev.where((F.col("type") == "connect") & (F.col("pid") != 4) & ~beacon_spared()), ["comm", "daddr", "dport"], width, at_least)


def beacon_flow(ev: DataFrame, width: int = 60 * SECOND, at_least: int = 3) -> DataFrame:
    """Connections and polled flows together; a flow counts once per local port and window, whatever its process."""
    key = [*HOST, "comm", "daddr", "dport"]
    rows = ev.where(~beacon_spared())
    flows = P.suppress_within(rows.where("type = 'network_flow'"), [*key, "local_port"], "ts_us", width, "event_id")
    return threshold(rows.where("type = 'connect' AND pid != 4").unionByName(flows), ["comm", "daddr", "dport"], width, at_least)


def spread(ev: DataFrame, keys: list[str], value: str, width: int, at_least: int) -> DataFrame:
    """Rows at which the key has so many distinct values, at most one a width."""
    keys = [*HOST, *keys]
    hot = P.sliding_distinct(ev, keys, "ts_us", value, width, "event_id").where(F.col("n") >= at_least)
    return P.suppress_within(hot, keys, "ts_us", width, "event_id")


def scan_spread(ev: DataFrame, width: int = 10 * SECOND, at_least: int = 20) -> DataFrame:
    return spread(ev.where((F.col("type") == "connect") & (F.col("pid") != 4)), ["pid", "dport"], "daddr", width, at_least)


def auth_bruteforce(ev: DataFrame, width: int = 60 * SECOND, at_least: int = 5) -> DataFrame:
    rows = ev.where("type = 'auth' AND outcome = 'failure'").withColumn("source", F.coalesce("daddr", F.lit("local")))
    return threshold(rows, ["target_user", "source"], width, at_least)


def mass_rename(ev: DataFrame, width: int = 5 * SECOND, at_least: int = 20, child_max: int = 3) -> DataFrame:
    """Renames that append a suffix, counted by pid, then (for short-lived children) by parent; a pid's alert wins."""
    old, new = F.col("old_path"), F.col("new_path")
    rows = ev.where((S.appended_suffix(old, new) != "") & ~S.rename_spared(old, new, F.col("comm"), S.trusted_system_path(F.col("image_path"))))
    counted = P.sliding_count(rows, [*HOST, "pid"], "ts_us", width, "event_id", "by_pid")
    own = P.suppress_within(counted.where(F.col("by_pid") >= at_least), [*HOST, "pid"], "ts_us", width, "event_id").withColumn("scope", F.lit("pid"))
    young = counted.where((F.col("by_pid") <= child_max) & (F.col("ppid") > 1))
    loop = P.sliding_count(young, [*HOST, "ppid"], "ts_us", width, "event_id", "by_parent").where(F.col("by_parent") >= at_least).drop("by_parent")
    parents = P.suppress_within(loop, [*HOST, "ppid"], "ts_us", width, "event_id").withColumn("scope", F.lit("ppid"))
    return own.unionByName(parents)


def burst_write(ev: DataFrame, width: int = 5 * SECOND, renames: int = 20, volume: int = 100 << 20) -> DataFrame:
    """Renames and written bytes of a pid within width, both at their thresholds."""
    keys = [*HOST, "pid"]
    rows = ev.where("type IN ('file_rename', 'file_write')")
    rows = P.sliding_sum(rows, keys, "ts_us", (F.col("type") == "file_rename").cast("long"), width, "event_id", "renames")
    rows = P.sliding_sum(rows, keys, "ts_us", F.when(F.col("type") == "file_write", F.col("bytes")).otherwise(0), width, "event_id", "written")
    return P.suppress_within(rows.where((F.col("renames") >= renames) & (F.col("written") >= volume)), keys, "ts_us", width, "event_id")


def dns_tunnel(ev: DataFrame, width: int = 60 * SECOND, at_least: int = 10, long: int = 30, bits: float = 3.5) -> DataFrame:
    """Many distinct long and random leftmost labels below one parent."""
    label = S.dns_leftmost(F.col("query"))
    rows = ev.where("type = 'dns_query'").withColumns({"label": label, "parent": S.dns_parent(F.col("query"))}).where((F.octet_length("label") > long) & (S.shannon_entropy(F.col("label")) > bits))
    return spread(rows, ["pid", "parent"], "label", width, at_least)


def first_seen(ev: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key that is not in the known set."""
    w = Window.partitionBy(*keys).orderBy("ts_us", "event_id")
    rows = ev.join(known, keys, "left_anti") if known is not None else ev
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sensor_silence(beacons: DataFrame, keys: list[str], counter: str, deadline: int, ts: str = "ts_us", order: str = "event_id") -> DataFrame:
    """Rows at which a counter has not moved for longer than the deadline: the first of each episode."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    moved = beacons.withColumn("__moved", F.coalesce(F.col(counter) != F.lag(counter).over(w), F.lit(True)))
    still = moved.withColumn("since", F.max(F.when(F.col("__moved"), F.col(ts))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    late = still.withColumn("__late", F.col(ts) - F.col("since") > deadline)
    return late.where(F.col("__late")).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "since").orderBy(ts, order))).where("__n = 1").drop("__n", "__late", "__moved")


def silent_spans(beacons: DataFrame, keys: list[str], counter: str, deadline: int, until: int, ts: str = "ts_us", order: str = "event_id") -> DataFrame:
    """Spans in which a counter had not moved for the deadline, whether or not a row tells so: since, told_at (since + deadline), as seen at a time."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    moved = beacons.where(F.col(ts) <= until).withColumn("__was", F.lag(counter).over(w)).withColumn("__n", F.row_number().over(w))
    moved = moved.where((F.col("__n") == 1) | ~F.col(counter).eqNullSafe(F.col("__was")))
    spans = moved.withColumns({"since": F.col(ts), "told_at": F.col(ts) + deadline, "__next": F.lead(ts).over(w)})
    return spans.where(F.coalesce("__next", F.lit(until + 1)) > F.col("told_at")).where(F.col("told_at") <= until).select(*keys, "since", "told_at")


def window_health(lines: DataFrame, keys: list[str], failed: Column, width: int, at_least: int = 10) -> DataFrame:
    """Windows (anchored at a source's first line) with enough lines of which half or more fail; the first of an episode."""
    rows = P.anchored_window(lines.withColumn("__failed", failed.cast("int")), keys, "ts_us", width, "event_id", strict=False)
    per = rows.groupBy(*keys, "anchor").agg(F.count(F.lit(1)).alias("lines"), F.sum("__failed").alias("failures"))
    w = Window.partitionBy(*keys).orderBy("anchor")
    bad = per.withColumn("bad", (F.col("lines") >= at_least) & (2 * F.col("failures") >= F.col("lines"))).withColumn("was", F.coalesce(F.lag("bad").over(w), F.lit(False)))
    return bad.where("bad AND NOT was").drop("bad", "was")


def http_summary(requests: DataFrame, source: list[str], width: int, client: str = "client", status: str = "status", top: int = 5) -> DataFrame:
    """Requests by source and anchored window: counts, distinct clients, clients with most failures."""
    rows = P.anchored_window(requests, source, "ts_us", width, "event_id", strict=False)
    key = [*source, "anchor"]
    by_client = rows.groupBy(*key, client).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status).between(400, 499)).alias("c4"), F.count_if(F.col(status) >= 500).alias("c5"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.col("c4") + F.col("c5")), client))
    entry = F.when((F.col("r") <= top) & (F.col("c4") + F.col("c5") > 0), F.struct("r", F.col(client).alias("client"), (F.col("c4") + F.col("c5")).alias("failures")))
    done = by_client.withColumn("r", rank).groupBy(*key).agg(F.sum("n").alias("requests"), F.sum("c4").alias("status_4xx"), F.sum("c5").alias("status_5xx"), F.count(F.lit(1)).alias("distinct_clients"), F.array_sort(F.collect_list(entry)).alias("t"))
    return done.withColumn("top_clients", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["client"], x["failures"].cast("string"))), ",")).drop("t")


def task_dedup(ev: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """Task registrations less those that repeat the last reported actions within width."""
    from pyspark.sql import types as T

    def step(state, row):
        told, at = state
        t, actions = row["ts_us"], row["actions"]
        repeat = at is not None and abs(t - at) <= width and (actions is None or actions == told)
        return (state if repeat else (actions, t)), (not repeat,)

    out = T.StructType([T.StructField("reported", T.BooleanType())])
    return P.ordered_fold(ev, [*HOST, "comm"], ["ts_us", "event_id"], lambda: (None, None), step, out, ["ts_us", "actions"]).where("reported").drop("reported")
