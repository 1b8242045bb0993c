"""What a process does in the window after each of its events, bins of that, and the belief that its entity is compromised."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import learning
from . import primitives as P
from .correlation import BELIEF_SPARED, IGNORED, spared
from .windows import HOST, SECOND

#: Types of events that are correlated, and parts of paths that are seldom run from in good faith.
CORRELATED = ["exec", "connect", "file_open", "dns_query", "assembly_load", "smb_connect", "udp_send", "network_flow"]
SUSPICIOUS_PARTS = ["appdata", "\\temp\\", "downloads", "desktop", "\\public\\"]
PRIOR, TAU_S, ALERT = -4.6, 300.0, 2.0
FEATURES = ["has_exec", "has_connect", "has_filewrite", "exec_connect_ms", "exec_write_ms", "suspicious_path", "connect_count", "distinct_dports", "dest_is_external"]
#: Log-likelihood ratios of bins; a bin that is not listed says nothing.
RATIOS = {
    "has_connect=1": 1.19,
    "has_connect=0": -0.93,
    "exec_connect_ms=<500": 1.90,
    "exec_connect_ms=<2000": 1.90,
    "exec_connect_ms=>=2000": -0.22,
    "exec_connect_ms=absent": -0.09,
    "suspicious_path=1": 3.60,
    "suspicious_path=0": -0.20,
    "connect_count=0": -0.96,
    "connect_count=1-4": 0.41,
    "connect_count=5-14": 2.22,
    "connect_count=>=15": 0.87,
    "distinct_dports=0-1": 0.02,
    "distinct_dports=2-3": -0.54,
    "dest_is_external=1": 1.23,
    "dest_is_external=0": -0.44,
}


def external(addr: Column) -> Column:
    """Whether an address is none of a private network, the host itself, or nobody; IPv4's groups count, IPv6's don't."""
    kind = S.ip_class(addr)
    return F.coalesce(~(kind.isin("unspecified", "loopback", "private") | ((kind == "multicast") & F.contains(addr, F.lit(":")))), F.lit(False))


def suspicious(path: Column) -> Column:
    low = F.lower(path)
    hit = F.lit(False)
    for part in SUSPICIOUS_PARTS:
        hit = hit | F.contains(low, F.lit(part))
    return F.coalesce(hit, F.lit(False))


def _marked(ev: DataFrame) -> DataFrame:
    """Correlated events with what the vector reads: kind (1 exec, 2 connect, 3 write, else 0), __port, __out, __odd."""
    kind = F.when(F.col("type") == "exec", 1).when(F.col("type") == "connect", 2).when((F.col("type") == "file_open") & S.has_write_intent(F.col("flags")), 3).otherwise(0)
    return ev.where(F.col("type").isin(*CORRELATED)).withColumns({"__kind": kind, "__port": F.col("dport").cast("long"), "__out": external(F.col("daddr")), "__odd": suspicious(F.col("image_path"))})


class View:
    """What one generation of a process has in the window."""

    def __init__(self):
        self.rows = 0
        self.firsts = {1: deque(), 2: deque(), 3: deque()}  # kind -> (number, ts, odd)
        self.ports, self.outside = Counter(), 0

    def add(self, number, ts, kind, port, out, odd):
        self.rows += 1
        if kind:
            self.firsts[kind].append((number, ts, odd))
        if kind == 2:
            self.ports[port] += 1
            self.outside += out

    def drop(self, kind, port, out):
        self.rows -= 1
        if kind:
            self.firsts[kind].popleft()
        if kind == 2:
            self.ports[port] -= 1
            if not self.ports[port]:
                del self.ports[port]
            self.outside -= out


def _process(width: int) -> Callable[[], Callable]:
    def start():
        window, views, number = deque(), {}, 0

        def step(ts, generation, kind, port, out, odd):
            nonlocal number
            while window and window[0][0] < ts - width:
                _, g, *what = window.popleft()
                views[g].drop(*what)
                if not views[g].rows:
                    del views[g]
            window.append((ts, generation, kind, port, out))
            number += 1
            views.setdefault(generation, View()).add(number, ts, kind, port, out, odd)
            # a known generation meets itself and the unknown; an unknown one meets all
            seen = list(views.values()) if generation is None else [v for v in (views.get(generation), views.get(None)) if v]
            first = {k: min((v.firsts[k][0] for v in seen if v.firsts[k]), default=None) for k in (1, 2, 3)}
            connects = sum(len(v.firsts[2]) for v in seen)
            ports = len(seen[0].ports) if len(seen) == 1 else len(set().union(*(v.ports for v in seen)))
            delay = lambda k: max(0, first[k][1] - first[1][1]) / 1000 if first[1] and first[k] else 0.0
            flags = [float(first[k] is not None) for k in (1, 2, 3)]
            return (*flags, delay(2), delay(3), float(bool(first[1] and first[1][2])), float(connects), float(ports), float(any(v.outside for v in seen)))

        return step

    return start


def vectors(ev: DataFrame, width: int = 60 * SECOND, keep: list[str] | None = None) -> DataFrame:
    """Each correlated event with its process's vector over the events in [ts - width, ts] that have arrived.

    A process is its pid and generation; an unknown generation matches any. Delays are in milliseconds, from the first exec of the window to its first connection or write, 0 where one is
    lacking or came before; the path is that of the window's first exec. keep: the columns of ev to return (all).
    """
    reads = ["ts_us", "process_generation", "__kind", "__port", "__out", "__odd"]
    out = ", ".join(f"{f} double" for f in FEATURES)
    return P.keyed_fold(_marked(ev), [*HOST, "pid"], ["ts_us", "event_id"], reads, _process(width), out, ev.columns if keep is None else keep)


def window_vectors(ev: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """A vector for each window of a pid, anchored at its first exec, connection or write: what the ratios are calibrated on."""
    rows = P.anchored_window(_marked(ev).where("type IN ('exec', 'connect', 'file_open')"), [*HOST, "pid"], "ts_us", width, "event_id")
    first = lambda kind: F.min(F.when(F.col("__kind") == kind, F.struct("ts_us", "event_id", "__odd")))
    connect = F.col("__kind") == 2
    per = rows.groupBy(*HOST, "pid", "anchor").agg(*(first(k).alias(f"f{k}") for k in (1, 2, 3)), F.count_if(connect).alias("n"), F.count_distinct(F.when(connect, F.col("__port"))).alias("ports"), F.coalesce(F.max(F.when(connect, F.col("__out"))), F.lit(False)).alias("out"))
    has = lambda k: F.col(f"f{k}").isNotNull()
    delay = lambda k: F.when(has(1) & has(k), F.greatest(F.lit(0), F.col(f"f{k}.ts_us") - F.col("f1.ts_us")) / 1000.0).otherwise(0.0)
    made = [has(1), has(2), has(3), delay(2), delay(3), F.coalesce("f1.__odd", F.lit(False)), F.col("n"), F.col("ports"), F.col("out")]
    return per.select(*HOST, "pid", "anchor", *(c.cast("double").alias(f) for f, c in zip(FEATURES, made, strict=True)))


def bins() -> dict[str, Column]:
    """The bin of each feature, by name."""
    flag = lambda f: F.when(F.col(f) > 0.5, "1").otherwise("0")
    c = F.col
    return {f: flag(f) for f in ("has_exec", "has_connect", "has_filewrite", "suspicious_path", "dest_is_external")} | {
        "exec_connect_ms": F.when(c("exec_connect_ms") == 0, "absent").when(c("exec_connect_ms") < 500, "<500").when(c("exec_connect_ms") < 2000, "<2000").otherwise(">=2000"),
        "exec_write_ms": F.when(c("exec_write_ms") == 0, "absent").when(c("exec_write_ms") < 500, "<500").otherwise(">=500"),
        "connect_count": F.when(c("connect_count") == 0, "0").when(c("connect_count") < 5, "1-4").when(c("connect_count") < 15, "5-14").otherwise(">=15"),
        "distinct_dports": F.when(c("distinct_dports") <= 1, "0-1").when(c("distinct_dports") <= 3, "2-3").otherwise(">=4"),
    }


def evidence(ratios: dict[str, float] | None = None) -> Column:
    """The sum of the ratios of a vector's bins."""
    ratios = RATIOS if ratios is None else ratios
    table = F.create_map(*(F.lit(x) for pair in ratios.items() for x in pair))
    total = F.lit(0.0)
    for feature, bin_of in bins().items():
        total = total + F.coalesce(F.element_at(table, F.concat(F.lit(f"{feature}="), bin_of)), F.lit(0.0))
    return total


def calibrate(windows: DataFrame, label: str) -> DataFrame:
    """feature, bin, pos, neg, llr: ratios of the bins of labelled window vectors."""
    return learning.llr(windows.select(label, *(b.alias(f) for f, b in bins().items())), FEATURES, label)


def ratios_of(table: DataFrame) -> dict[str, float]:
    """A calibrated table as ratios; there are as many rows as bins, some thirty whatever the data."""
    return {f"{r['feature']}={r['bin']}": float(r["llr"]) for r in table.select("feature", "bin", "llr").collect()}


def with_entity(ev: DataFrame) -> DataFrame:
    """Events with the entity that their process's last exec names (parent, name, the parent's generation), if its generation is compatible; else the process itself."""
    named = F.when((F.col("type") == "exec") & (F.col("ppid") != 0), F.struct("process_generation", "ppid", "comm", "parent_process_generation"))
    last = F.last(named, ignorenulls=True).over(Window.partitionBy(*HOST, "pid").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = ev.withColumn("__named", last)
    known = F.col("__named").isNotNull() & P.same_generation(F.col("__named.process_generation"), F.col("process_generation"))
    pick = lambda field, own: F.when(known, F.col(f"__named.{field}")).otherwise(F.col(own))
    return rows.withColumns({"entity_ppid": pick("ppid", "pid"), "entity_comm": pick("comm", "comm"), "entity_generation": pick("parent_process_generation", "process_generation")}).drop("__named")


def _entity(prior: float, tau_s: float, threshold: float) -> Callable[[], Callable]:
    def start():
        level, at, stamp, alerted = prior, None, None, False

        def step(ts, generation, gain, heard, extra):
            nonlocal level, at, stamp, alerted
            if stamp is not None and generation is not None and stamp != generation:  # another parent under the same number
                level, at, stamp, alerted = prior, None, None, False
            stamp = generation if stamp is None else stamp
            if at is not None:
                level += (prior - level) * (1 - math.exp(-max(0, ts - at) / 1e6 / tau_s))
            level, at = level + gain, ts
            told, raised = level, False
            if heard:
                raised = level > threshold and not alerted
                alerted = level > threshold
            level += extra or 0.0  # a model's word comes after the event's own
            return told, raised

        return step

    return start


def beliefs(ev: DataFrame, width: int = 60 * SECOND, ratios: dict[str, float] | None = None, prior: float = PRIOR, tau_s: float = TAU_S, threshold: float = ALERT, model: str | None = None) -> DataFrame:
    """Each correlated event with its entity, the evidence of its process's window, the entity's log-odds after it (belief), and whether that raises an alert.

    Log-odds decay towards the prior and gain the evidence. A parent of another known generation starts anew. One alert is raised when the threshold is crossed, the next after the
    belief was heard at or below it; events under names that are let pass are not heard. model: a column of further evidence, which counts from the next event on.
    """
    rows = with_entity(spared(ev, [*IGNORED, *BELIEF_SPARED], "__quiet"))
    rows = rows.withColumns({"heard": ~F.col("__quiet"), "__extra": (F.col(model) if model else F.lit(None)).cast("double")})
    kept = ["event_id", *HOST, "pid", "ts_us", "entity_ppid", "entity_comm", "entity_generation", "heard", "__extra"]
    rows = vectors(rows, width, kept).withColumn("evidence", evidence(ratios))
    keys = [*HOST, "entity_ppid", "entity_comm"]
    out = P.keyed_fold(rows, keys, ["ts_us", "event_id"], ["ts_us", "entity_generation", "evidence", "heard", "__extra"], _entity(prior, tau_s, threshold), "belief double, raised boolean", [c for c in kept if c != "__extra"] + ["evidence"])
    return out


def belief_alerts(rows: DataFrame) -> DataFrame:
    """Rows of beliefs() that raise an alert."""
    return rows.where("raised")
