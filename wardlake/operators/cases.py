"""Grouping of detections into cases, and fusion of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from . import primitives as P

MINUTE = 60_000_000
CASE_KEY = ["tenant_id", "agent_id", "base_technique"]


def group_detections(detections: DataFrame, width: int = 30 * MINUTE) -> DataFrame:
    """Detections with the start of their case: same agent and base technique, within width of the case's first."""
    rows = detections.withColumn("base_technique", S.base_technique(F.col("technique")))
    return P.anchored_window(rows, CASE_KEY, "ts_us", width, "event_id", out="case_start").drop("case_start_opens")


def attach_detections(detections: DataFrame, open_cases: DataFrame, width: int = 30 * MINUTE) -> DataFrame:
    """event_id and the case that each detection joins: case_id of an open one, or null and opened_by, the detection that opens a new one.

    open_cases: tenant_id, agent_id, base_technique, case_id, case_start. A detection joins the first case of its key (open ones by id, then new ones as they
    were opened) whose earliest detection is at most width away, before or after; a case that takes in an earlier one starts there from then on.
    An open case is met at case_start - width and forgotten when time has passed it, so the state is what lies within width.
    """
    rows = detections.select("tenant_id", "agent_id", S.base_technique(F.col("technique")).alias("base_technique"), F.col("ts_us").alias("at"), F.lit(1).alias("kind"), "event_id", F.lit(None).cast("long").alias("start"))
    seeds = open_cases.select("tenant_id", "agent_id", "base_technique", (F.col("case_start") - width).alias("at"), F.lit(0).alias("kind"), F.col("case_id").alias("event_id"), F.col("case_start").alias("start"))

    def step(state, row):
        # state: [is new, number, start] in the order in which cases are tried
        t = row["at"]
        if row["kind"] == 0:
            kept = sorted([*state, [False, row["event_id"], row["start"]]], key=lambda c: (c[0], 0 if c[0] else c[1]))
            return kept, (None, None)
        kept = [c for c in state if t - c[2] <= width]
        for case in kept:
            if abs(t - case[2]) <= width:
                case[2] = min(case[2], t)
                return kept, ((None, case[1]) if case[0] else (case[1], None))
        return [*kept, [True, row["event_id"], t]], (None, row["event_id"])

    made = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("opened_by", T.LongType())])
    folded = P.ordered_fold(rows.unionByName(seeds), CASE_KEY, ["at", "kind", "event_id"], list, step, made, ["at", "kind", "event_id", "start"])
    return folded.where("kind = 1").select("event_id", *CASE_KEY, "case_id", "opened_by")


def cases(detections: DataFrame, width: int = 30 * MINUTE) -> DataFrame:
    """A row per case: title, severity (the greatest), extent."""
    grouped = group_detections(detections, width)
    rank = S.severity_rank(F.col("severity"))
    out = grouped.groupBy(*CASE_KEY, "case_start").agg(F.count(F.lit(1)).alias("detections"), F.max("ts_us").alias("last_seen"), F.max(rank).alias("rank"), F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"))
    return out.withColumns({"title": F.concat("base_technique", F.lit(" activity on "), "agent_id"), "severity": F.coalesce(F.get(F.array(*map(F.lit, S.SEVERITIES)), F.when(F.col("rank") >= 0, F.col("rank"))), F.lit("unknown"))})


EVIDENCE = 16


def fuse(alerts: DataFrame, entity: list[str], width: int = 30_000_000, generation: str = "parent_process_generation", evidence: int = EVIDENCE) -> DataFrame:
    """Alerts that are told, each with its entity's verdict: max_rank, max_score, techniques and sources (oldest first), evidence (ids of the last alerts, oldest first).

    An alert is told if its technique is new to the entity or comes back later than width after its window's first, or if it raises severity (above low, at first) or score (any, at
    first). A known generation that differs from the last known one is another parent under the same number: the entity starts anew. As generations are only compared with the
    last known one, those stretches are a running count, and the rest are windows within a stretch; only the reopening of a technique's window is a pass in order.
    """
    order = ["ts_us", "event_id"]
    whole = Window.partitionBy(*entity).orderBy(*order)
    known = F.last(generation, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    rows = alerts.withColumn("__other", F.coalesce(F.col(generation) != known, F.lit(False)).cast("long"))
    rows = rows.withColumn("stretch", F.sum("__other").over(whole.rowsBetween(Window.unboundedPreceding, 0))).drop("__other")
    key = [*entity, "stretch"]
    rows = P.anchored_window(rows.withColumn("rank", S.severity_rank(F.col("severity"))), [*key, "technique"], "ts_us", width, "event_id", out="__a", deal=entity)
    new = lambda c: F.when(F.row_number().over(Window.partitionBy(*key, c).orderBy(*order)) == 1, F.col(c))
    rows = rows.withColumns({"__t": new("technique"), "__s": new("source")})
    w = Window.partitionBy(*key).orderBy(*order)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    higher = F.col("rank") > F.greatest(F.lit(0), F.coalesce(F.max("rank").over(before), F.lit(0)))
    best = F.max("score").over(before)
    rows = rows.withColumns({
        "raised": higher | F.coalesce(F.col("score") > best, F.col("score").isNotNull()),
        "max_rank": F.greatest(F.lit(0), F.max("rank").over(so_far)),
        "max_score": F.max("score").over(so_far),
        "techniques": F.collect_list("__t").over(so_far),
        "sources": F.collect_list("__s").over(so_far),
        "evidence": F.collect_list("event_id").over(w.rowsBetween(1 - evidence, 0)),
    })
    return rows.where("__a_opens OR raised").drop("__a", "__a_opens", "__t", "__s", "rank", "raised")


def suppress(alerts: DataFrame, listed: DataFrame, entity: list[str]) -> DataFrame:
    """Alerts whose entity and technique are not on a list; an unknown generation matches any."""
    gen = P.same_generation(F.col("a.process_generation"), F.col("l.process_generation"))
    on = gen
    for k in [*entity, "technique"]:
        on = on & (F.col(f"a.{k}") == F.col(f"l.{k}"))
    return alerts.alias("a").join(listed.alias("l"), on, "left_anti")


def escalations(verdicts: DataFrame, gate: str = "high") -> DataFrame:
    return verdicts.where(F.col("max_rank") >= S.SEVERITIES.index(gate))


def timeline(detections: DataFrame, keys: list[str]) -> DataFrame:
    """A case's detections in order of time, numbered."""
    return detections.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("ts_us", "event_id")))


def grounded(citations: DataFrame, members: DataFrame) -> DataFrame:
    """Citations whose detection is on the case."""
    return citations.join(members.select("case_id", "detection_id"), ["case_id", "detection_id"], "left_semi")


def staleness(narratives: DataFrame, detections: DataFrame) -> DataFrame:
    """The latest narrative of each case and whether a detection changed after it."""
    last = narratives.groupBy("case_id").agg(F.max("generated_at").alias("generated_at"))
    changed = detections.groupBy("case_id").agg(F.max("updated_at").alias("updated_at"))
    return last.join(changed, "case_id", "left").select("case_id", "generated_at", F.coalesce(F.col("updated_at") > F.col("generated_at"), F.lit(False)).alias("stale"))
