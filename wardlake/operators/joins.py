"""Lineage, temporal, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import primitives as P
from .windows import HOST, SECOND

#: Fixed values.
SHELLS = ["sh", "bash", "dash", "zsh", "ash"]
SERVICES = ["nginx", "apache2", "httpd", "mysqld", "mariadbd", "postgres"]
OFFICE = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "acrord32.exe", "acrobat.exe", "foxit.exe", "iexplore.exe"]
INTERPRETERS = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "certutil.exe", "regsvr32.exe", "rundll32.exe", "bitsadmin.exe", "wmic.exe", "msiexec.exe"]
LOLBINS = ["aspnet_compiler.exe", "aspnet_compiler", "msbuild.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "ieexec.exe", "msdeploy.exe", "dfsvc.exe", "cmstp.exe", "wab.exe", "odbcconf.exe"]
LOLBIN_PARENTS = ["devenv.exe", "msbuild.exe", "dotnet.exe", "nuget.exe"]
DOWNLOADERS = ["curl", "wget", "curl.exe", "wget.exe", "certutil.exe"]


def resolve_process(ev: DataFrame, pid: str = "pid", out: str = "resolved_comm") -> DataFrame:
    """Events with the name of the last exec of that pid at or before them, if its generation is compatible."""
    execs = ev.where("type = 'exec'").select(*HOST, F.col("pid").alias("__pid"), "ts_us", "event_id", F.col("comm").alias("c"), F.col("process_generation").alias("g"))
    rows = ev.withColumn("__pid", F.col(pid))
    found = P.latest_before(rows, execs, [*HOST, "__pid"], "ts_us", "event_id", ["c", "g"])
    of = {"pid": "process_generation", "ppid": "parent_process_generation"}[pid]
    fits = P.same_generation(F.col(of) if of in ev.columns else F.lit(None).cast("long"), F.col("prior_g"))
    return found.withColumn(out, F.when(fits, F.col("prior_c"))).drop("__pid", "prior_c", "prior_g")


def with_parent(ev: DataFrame) -> DataFrame:
    """Execs with the resolved name of their parent."""
    return resolve_process(ev, "ppid", "parent").where("type = 'exec'")


def service_spawns_shell(ev: DataFrame) -> DataFrame:
    return with_parent(ev).where(F.col("comm").isin(*SHELLS) & (F.col("parent").isin(*SERVICES) | F.startswith("parent", F.lit("php-fpm"))))


def office_spawns_interpreter(ev: DataFrame) -> DataFrame:
    return with_parent(ev).where(F.lower("comm").isin(*INTERPRETERS) & F.lower("parent").isin(*OFFICE))


def lolbin_unusual_parent(ev: DataFrame) -> DataFrame:
    return with_parent(ev).where(F.lower("comm").isin(*LOLBINS) & F.lower("parent").isNotNull() & ~F.lower("parent").isin(*LOLBIN_PARENTS))


def within_after(first: DataFrame, then: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Each row of then with the latest row of first, of the same key, at most width before it: first_id, first_ts.

    Bucketed by width, so that a key's history is met in two buckets only.
    """
    a = first.select(*keys, F.col("ts_us").alias("first_ts"), F.col("event_id").alias("first_id")).withColumn("__b", F.explode(F.array(F.floor(F.col("first_ts") / width), F.floor(F.col("first_ts") / width) + 1)))
    b = then.withColumn("__b", F.floor(F.col("ts_us") / width))
    near = b.join(a, [*keys, "__b"]).where((F.col("first_ts") <= F.col("ts_us")) & (F.col("ts_us") - F.col("first_ts") <= width))
    w = Window.partitionBy("event_id").orderBy(F.desc("first_ts"), F.desc("first_id"))
    return near.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__b")


def download_then_exec(ev: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """A downloader's write, then an exec of a file of that name."""
    name = lambda p: F.lower(F.regexp_extract(p, r"([^/\\]*)$", 1))
    writes = ev.where((F.col("type") == "file_open") & F.col("comm").isin(*DOWNLOADERS)).withColumn("file", name(F.col("path")))
    return within_after(writes, ev.where("type = 'exec'").withColumn("file", name(F.col("image_path"))), [*HOST, "file"], width)


def first_use_of_mark(marks: DataFrame, uses: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Marked files that are then used within width: each mark's first use."""
    near = within_after(marks, uses, keys, width)
    w = Window.partitionBy("first_id").orderBy("ts_us", "event_id")
    return near.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def context_join(contexts: DataFrame, results: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Contexts and results met one to one, in order, by message; and the results that met none."""
    numbered = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("ts_us", "event_id")))
    c = numbered(contexts).select(*key, "__n", F.col("event_id").alias("context_id"))
    r = numbered(results)
    return r.join(c, [*key, "__n"]).drop("__n"), r.join(c, [*key, "__n"], "left_anti").drop("__n")


def without_alerts(execs: DataFrame, alerts: DataFrame) -> DataFrame:
    return execs.join(alerts.select("event_id").distinct(), "event_id", "left_anti")


def same_process(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of one process within width after: equal pid, generations equal or unknown."""
    left = a.select(*keys, F.col("event_id").alias("a_id"), F.col("ts_us").alias("a_ts"), F.col("process_generation").alias("ga"))
    left = left.withColumn("__b", F.explode(F.array(F.floor(F.col("a_ts") / width), F.floor(F.col("a_ts") / width) + 1)))
    right = b.select(*keys, F.col("event_id").alias("b_id"), F.col("ts_us").alias("b_ts"), F.col("process_generation").alias("gb"), F.floor(F.col("ts_us") / width).alias("__b"))
    return left.join(right, [*keys, "__b"]).where((F.col("b_ts") - F.col("a_ts")).between(0, width) & P.same_generation(F.col("ga"), F.col("gb"))).drop("__b")


def enrich_prevalence(observed: DataFrame, prevalence: DataFrame, keys: list[str], most: int = 200, per: list[str] | None = None) -> DataFrame:
    """Observations with their host counts, rarest first, at most so many a group; absent ones were never seen."""
    joined = observed.join(prevalence, keys, "left").withColumn("host_count", F.coalesce("host_count", F.lit(0)))
    w = Window.partitionBy(*(per or [])).orderBy("host_count", *keys)
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def scenario_replay(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected counts a technique against those seen: passed if min <= n <= min + tolerance."""
    n = observed.where(F.col("technique").isNotNull()).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    rows = expected.join(n, "technique", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("passed", F.col("n").between(F.col("min_count"), F.col("min_count") + F.col("tolerance")))
