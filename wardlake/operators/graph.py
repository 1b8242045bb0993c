"""The graph of entities over all hosts: what events tie together, and what hangs together by that."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def edges(ev: DataFrame) -> DataFrame:
    """tenant_id, agent_id, kind, src, dst: who spawned, wrote, connected to, logged in to what, and which files are the same by their hash.

    Names of processes and files are a host's own; addresses, identities and hashes are the fleet's (a tenant's). An event whose entity is unknown gives no edge; columns that events lack
    (sha256, target_user) are unknown.
    """
    at = lambda c: F.col(c) if c in ev.columns else F.lit(None).cast("string")
    own = lambda kind, name: F.when(name != "", F.concat_ws(":", F.lit(kind), F.col("agent_id"), name))
    shared = lambda kind, name: F.when(name != "", F.concat_ws(":", F.lit(kind), name))
    process, image = own("process", F.col("comm")), own("file", S.normalise_image_path(F.col("image_path")))
    is_ = lambda *types: F.col("type").isin(*types)
    edge = lambda test, kind, src, dst: F.when(test & src.isNotNull() & dst.isNotNull(), F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst")))
    found = F.array(
        edge(is_("exec"), "spawned", own("process", F.col("parent_comm")), process),
        edge(is_("file_open") & S.has_write_intent(F.col("flags")), "wrote", process, own("file", F.col("path"))),
        edge(is_("connect", "network_flow", "smb_connect"), "connected", process, shared("address", F.col("daddr"))),
        edge(is_("auth") & (at("outcome") == "success"), "logged_in", shared("identity", at("target_user")), F.concat(F.lit("host:"), F.col("agent_id"))),
        edge(is_("exec") & at("sha256").isNotNull(), "same_hash", image, shared("hash", at("sha256"))),
    )
    return ev.select("tenant_id", "agent_id", F.inline(F.filter(found, lambda x: x.isNotNull()))).distinct()


def across_hosts(graph: DataFrame, most_hosts: int | None = None) -> DataFrame:
    """Edges as pairs a, b of one tenant; an entity that more than so many hosts show ties nothing together (common services, default accounts)."""
    ends = graph.select("tenant_id", "agent_id", F.explode(F.array("src", "dst")).alias("node"))
    pairs = graph.select("tenant_id", F.col("src").alias("a"), F.col("dst").alias("b")).where("a != b").distinct()
    if most_hosts is None:
        return pairs
    common = ends.distinct().groupBy("tenant_id", "node").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") > most_hosts).select("tenant_id", "node")
    for side in ("a", "b"):
        pairs = pairs.join(common.withColumnRenamed("node", side), ["tenant_id", side], "left_anti")
    return pairs


def components(pairs: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """keys, node, component: the least node that each one of a pair reaches, within its keys.

    Stars in turn: every node hands its larger neighbours the least node it sees, then its smaller ones; edges thus turn into stars around the least nodes in a number of rounds
    that grows with the logarithm of the graph's size. Each round is a table in a folder that driver and executors share; the minimum of a node is summed up before it is joined, so no group is held whole.
    """
    spark, top = pairs.sparkSession, f"{folder.rstrip('/')}/components-{uuid.uuid4().hex}"
    count = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        df.write.parquet(f"{top}/{count}")
        return spark.read.schema(df.schema).parquet(f"{top}/{count}")

    def pair(x: Column, y: Column) -> tuple[Column, Column]:
        return F.greatest(x, y).alias("u"), F.least(x, y).alias("v")

    def handed(now: DataFrame, small: bool) -> DataFrame:
        """Neighbours of each u joined to the least node of u's star: the larger ones of all (large star), or the smaller ones and u itself (small star)."""
        both = now if small else now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        met = both.join(least, [*keys, "u"])
        out = met.where("v != m").select(*keys, F.col("v").alias("x"), "m") if small else met.where("v > u").select(*keys, F.col("v").alias("x"), "m")
        if small:
            out = out.unionByName(least.select(*keys, F.col("u").alias("x"), "m"))
        return out.select(*keys, *pair(F.col("x"), F.col("m"))).where("u != v").distinct()

    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
    now = keep(pairs.select(*keys, *pair(F.col("a"), F.col("b"))).where("u != v").distinct())
    seen = mark(now)
    while True:
        now = keep(handed(keep(handed(now, False)), True))
        if (then := mark(now)) == seen:
            break
        seen = then
    roots = now.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def entity_components(ev: DataFrame, folder: str, most_hosts: int | None = None) -> DataFrame:
    """tenant_id, node, component for every entity that has an edge to another."""
    graph = edges(ev)
    at = f"{folder.rstrip('/')}/edges-{uuid.uuid4().hex}"
    graph.write.parquet(at)  # read by pairs and by what is common
    return components(across_hosts(ev.sparkSession.read.schema(graph.schema).parquet(at), most_hosts), folder, ["tenant_id"])


def spread_over_hosts(ev: DataFrame, folder: str, at_least: int = 2, most_hosts: int | None = None) -> DataFrame:
    """Components that reach so many hosts: tenant_id, component, hosts, entities."""
    named = entity_components(ev, folder, most_hosts)
    hosts = F.when(F.substring_index("node", ":", 1).isin("process", "file", "host"), F.get(F.split("node", ":"), F.lit(1)))
    return named.groupBy("tenant_id", "component").agg(F.count_distinct(hosts).alias("hosts"), F.count(F.lit(1)).alias("entities")).where(F.col("hosts") >= at_least)
