"""Fleet aggregates and rankings: prevalence, rings, health, releases, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

MINUTE = 60_000_000
DAY = 1440 * MINUTE


def observations(ev: DataFrame) -> DataFrame:
    """tenant, agent, kind, key, ts of what events show: image paths, parent-child pairs, domains, hashes."""
    fits = lambda k: F.length(k).between(1, 1024)
    image = S.normalise_image_path(F.col("image_path"))
    kinds = [
        F.when(F.col("type") == "exec", F.struct(F.lit("image_path").alias("kind"), image.alias("key"))),
        F.when(F.col("type") == "exec", F.struct(F.lit("lineage").alias("kind"), F.concat(F.coalesce("parent_comm", F.lit("?")), F.lit(" -> "), F.coalesce(image, "comm")).alias("key"))),
        F.when(F.col("type") == "dns_query", F.struct(F.lit("domain").alias("kind"), S.normalise_domain(F.col("query")).alias("key"))),
    ]
    if "sha256" in ev.columns:
        kinds.append(F.when((F.col("type") == "exec") & F.col("sha256").rlike("^[0-9a-f]{64}$"), F.struct(F.lit("sha256").alias("kind"), F.col("sha256").alias("key"))))
    return ev.where(F.col("type").isin("exec", "dns_query")).select("tenant_id", "agent_id", "ts_us", F.inline(F.filter(F.array(*kinds), lambda x: x.isNotNull()))).where(fits(F.col("key")))


SIGHTING = ["tenant_id", "agent_id", "kind", "key"]


def fold_sightings(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*SIGHTING).agg(F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"), F.count(F.lit(1)).alias("count"))


def merge_sightings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Least, greatest and sum by key; the order of merges does not matter."""
    return old.unionByName(new).groupBy(*SIGHTING).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"))


def prevalence(sightings: DataFrame) -> DataFrame:
    """A sighting is one agent's, so rows count hosts."""
    return sightings.groupBy("tenant_id", "kind", "key").agg(F.count(F.lit(1)).alias("host_count"), F.sum("count").alias("event_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def prune_sightings(sightings: DataFrame, now: int, keep_us: int = 180 * DAY, most: int = 5_000_000) -> DataFrame:
    """Recent sightings, the newest so many of each tenant."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc("last_seen"), "agent_id", "kind", "key")
    return sightings.where(F.col("last_seen") >= now - keep_us).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def common_keys(sightings: DataFrame, hosts: int) -> DataFrame:
    return prevalence(sightings).where(F.col("host_count") >= hosts).select("tenant_id", "kind", "key")


def k_anonymous(sightings: DataFrame, kind: str, tenants: int) -> DataFrame:
    """Keys of a kind that enough tenants share, with nothing that tells which."""
    return sightings.where(F.col("kind") == kind).groupBy("key").agg(F.count_distinct("tenant_id").alias("tenants"), F.sum("count").alias("event_count")).where(F.col("tenants") >= tenants)


def rarity_before(obs: DataFrame) -> DataFrame:
    """At each observation, how many hosts of the tenant had shown the key before."""
    first = Window.partitionBy("tenant_id", "kind", "key", "agent_id").orderBy("ts_us", "event_id")
    key = Window.partitionBy("tenant_id", "kind", "key").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return obs.withColumn("__new", (F.row_number().over(first) == 1).cast("long")).withColumn("hosts_before", F.coalesce(F.sum("__new").over(key), F.lit(0))).drop("__new")


def ring_metrics(agents: DataFrame, detections: DataFrame, now: Column, silent_us: int = 5 * MINUTE, recent_us: int = DAY) -> DataFrame:
    """By tenant and ring: agents, silent ones, recent detections, grade. agents: tenant, agent, ring, last_seen."""
    recent = detections.where(F.col("ts_us") > now - recent_us).groupBy("tenant_id", "agent_id").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("severity") == "low").alias("low"))
    silent = F.col("last_seen") < now - silent_us
    out = agents.join(recent, ["tenant_id", "agent_id"], "left").groupBy("tenant_id", "ring").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(silent).alias("silent"), F.coalesce(F.sum("d"), F.lit(0)).alias("detections"), F.coalesce(F.sum("low"), F.lit(0)).alias("low_severity")
    )
    rate = F.col("silent") / F.col("total")
    return out.withColumns({"silent_rate": rate, "grade": F.when(rate > 0.05, "unhealthy").when(rate > 0.02, "degraded").otherwise("healthy")})


def canary_regression(metrics: DataFrame, canary: str = "canary", against: str = "prod") -> DataFrame:
    """Tenants whose canary ring does worse, with the first reason."""
    c = metrics.where(F.col("ring") == canary).select("tenant_id", *(F.col(x).alias(f"c_{x}") for x in ("total", "silent_rate", "detections", "low_severity")))
    p = metrics.where(F.col("ring") == against).select("tenant_id", *(F.col(x).alias(f"p_{x}") for x in ("total", "detections", "low_severity")))
    low_c, low_p = F.col("c_low_severity") / F.col("c_total"), F.col("p_low_severity") / F.col("p_total")
    per_c, per_p = F.col("c_detections") / F.col("c_total"), F.col("p_detections") / F.col("p_total")
    reason = F.when(F.col("c_silent_rate") > 0.05, "silent_rate").when(F.when(F.col("p_low_severity") > 0, low_c > 2 * low_p).otherwise(F.col("c_low_severity") > 10), "low_severity").when(per_c < 0.8 * per_p, "detection_drop")
    return c.join(p, "tenant_id").where((F.col("c_total") > 0) & (F.col("p_total") > 0)).withColumn("reason", reason).where(F.col("reason").isNotNull()).select("tenant_id", "reason", "c_total", "p_total")


def fleet_status(agents: DataFrame, beacons: DataFrame, now: Column, silent_us: int = 5 * MINUTE) -> DataFrame:
    """Each agent's status by its latest beacon (beacons: tenant, agent, ts, silent_sensor); worst first by rank."""
    last = latest(beacons, ["tenant_id", "agent_id"], ["ts_us", "event_id"])
    rows = agents.join(last.select("tenant_id", "agent_id", "silent_sensor"), ["tenant_id", "agent_id"], "left")
    status = F.when(F.col("last_seen") < now - silent_us, "silent").when(F.col("silent_sensor").isNull(), "no_beacon").when(F.col("silent_sensor"), "degraded").otherwise("healthy")
    rank = F.when(F.col("status") == "silent", 0).when(F.col("status") == "no_beacon", 1).when(F.col("status") == "degraded", 2).otherwise(3)
    return rows.withColumn("status", status).withColumn("rank", rank)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


RINGS = ("canary", "early", "broad", "prod")


def ring_status(statuses: DataFrame, releases: DataFrame) -> DataFrame:
    """By tenant and ring: newest release, its state, the version served, and agents by status; all rings listed."""
    tenants = releases.select("tenant_id").union(statuses.select("tenant_id")).distinct()
    rings = tenants.select("tenant_id", F.explode(F.array(*map(F.lit, RINGS))).alias("ring"))
    rel = releases.groupBy("tenant_id", "ring").agg(F.max("version").alias("newest"), F.max_by("status", "version").alias("rollout"), F.max(F.when(F.col("status") == "active", F.col("version"))).alias("served"))
    counts = statuses.groupBy("tenant_id", "ring").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "degraded", "no_beacon", "silent")))
    return rings.join(rel, ["tenant_id", "ring"], "left").join(counts, ["tenant_id", "ring"], "left").na.fill(0, ["healthy", "degraded", "no_beacon", "silent"])


def served_release(releases: DataFrame, status: str | None = None) -> DataFrame:
    rows = releases.where(F.col("status") == status) if status else releases
    return latest(rows, ["tenant_id", "ring"], ["version"])


def rollback_target(releases: DataFrame) -> DataFrame:
    """The newest version below the current one (active or halted)."""
    current = releases.where(F.col("status").isin("active", "halted")).groupBy("tenant_id", "ring").agg(F.max("version").alias("current"))
    return releases.join(current, ["tenant_id", "ring"]).where(F.col("version") < F.col("current")).groupBy("tenant_id", "ring").agg(F.max("current").alias("current"), F.max("version").alias("target"))


def silent_agent_cases(agents: DataFrame, open_cases: DataFrame, now: Column, silent_us: int = 5 * MINUTE) -> DataFrame:
    return agents.where(F.col("last_seen") < now - silent_us).join(open_cases.select("tenant_id", "agent_id"), ["tenant_id", "agent_id"], "left_anti").select("tenant_id", "agent_id", F.concat(F.lit("Agent silent: "), F.col("agent_id")).alias("title"))


def correlation_vector(ev: DataFrame, keys: list[str], width: int = MINUTE) -> DataFrame:
    """Of each process's last window: what it did, to how many addresses and ports, how long."""
    last = F.max("ts_us").over(Window.partitionBy(*keys))
    rows = ev.withColumn("__last", last).where(F.col("ts_us") >= F.col("__last") - width)
    net = F.col("type").isin("connect", "network_flow")
    has = lambda *t: F.max(F.col("type").isin(*t).cast("int"))
    out = rows.groupBy(*keys).agg(has("exec").alias("spawn"), has("connect", "network_flow").alias("connect"), F.max(((F.col("type") == "file_open") & S.has_write_intent(F.col("flags"))).cast("int")).alias("filewrite"), F.count_distinct(F.when(net, F.col("daddr"))).alias("distinct_daddr"), F.count_distinct(F.when(net, F.col("dport"))).alias("distinct_dport"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("span_s"), F.count(F.lit(1)).alias("event_count"))
    return out.withColumn("full_chain", F.col("spawn") * F.col("connect") * F.col("filewrite"))


def technique_coverage(detections: DataFrame, tactics: DataFrame) -> DataFrame:
    """By tactic and technique: sources that cover it; what maps to no tactic is listed as such."""
    d = detections.select(F.explode(F.split("technique", "/")).alias("technique"), "source").withColumn("base", S.base_technique(F.col("technique")))
    rows = d.join(F.broadcast(tactics.select(F.col("technique").alias("base"), "tactic")), "base", "left")
    return rows.groupBy(F.coalesce("tactic", F.lit("unmapped")).alias("tactic"), "technique").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


def top_by_magnitude(df: DataFrame, group: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k largest by absolute value."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.abs(F.col(value))), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def combine(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both, without repeats; the first side's rows win."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("__side", *[c for c in first.columns if c not in keys])
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__side")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): what an entity reaches in so many steps, by repeated joins; edges: src, dst."""
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = reached
    for hop in range(1, hops + 1):
        front = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hop")).distinct().join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        reached = reached.unionByName(front)
    return reached
