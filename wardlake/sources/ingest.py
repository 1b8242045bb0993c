"""Captures, uploads, corpora and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = """type string, meta struct<pid:bigint, ppid:bigint, user:struct<os:string, uid:bigint, gid:bigint, sid:string, integrity_level:string>,
 timestamp_ns:bigint, comm:string, container:struct<id:string, image:string, name:string>, process_generation:decimal(20,0), parent_process_generation:decimal(20,0)>,
 image_path string, cmdline string, argv array<string>, parent_comm string, parent_image_path string, sha256 string, daddr string, dport bigint, local_port bigint,
 protocol string, bytes_sent bigint, bytes_received bigint, query string, qtype string, status string, path string, flags bigint, fd bigint, bytes_requested bigint, old_path string, new_path string,
 outcome string, kind string, target_user string, source_address string, signal bigint, target_pid bigint, method string, signature string, _corrupt string"""


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the fixed schema; unknown types keep their envelope, torn lines go."""
    rows = spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL AND type IS NOT NULL").drop("_corrupt")


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL AND type IS NOT NULL").drop("_corrupt")


def explode_batches(uploads: DataFrame, body: str = "body", most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Events of uploads (agent_id, JSON text of each), and the uploads that are too large or not readable."""
    parsed = F.from_json(body, "agent_id string, events array<string>")
    rows = uploads.withColumn("__b", parsed)
    good = F.coalesce(F.size("__b.events").between(0, most), F.lit(False))
    kind = F.get_json_object("event", "$.type")
    events = rows.where(good).select(*uploads.columns, F.col("__b.agent_id").alias("agent_id"), F.explode("__b.events").alias("event"))
    return events.where(kind.isNotNull() & F.col("event").startswith("{")), rows.where(~good).drop("__b")


def clamp_event_time(ts_ns: Column, received_ns: Column, ahead_ns: int = 86_400_000_000_000) -> Column:
    """The event's time in whole milliseconds; the receipt's where it is missing, not positive or a day ahead."""
    bad = ts_ns.isNull() | (ts_ns <= 0) | (ts_ns > received_ns + ahead_ns)
    t = F.when(bad, received_ns).otherwise(ts_ns)
    return t - F.pmod(t, F.lit(1_000_000))


def normalise_detections(raw: DataFrame, body: str = "body") -> DataFrame:
    """Both wire forms as stored rows: technique, severity, first event, the rest, identity of the source."""
    j = F.from_json(body, "severity string, title string, technique string, source struct<engine:string, rule_id:string, model_id:string, case_id:string>, score double, techniques array<string>, events array<string>, event string")
    rows = raw.withColumn("__d", j)
    d = lambda p: F.col(f"__d.{p}")
    return rows.select(
        *raw.columns,
        F.coalesce(F.get(d("techniques"), F.lit(0)), d("technique"), F.upper(d("source.engine"))).alias("technique"),
        F.lower(d("severity")).alias("severity"),
        F.coalesce(F.get(d("events"), F.lit(0)), d("event"), F.lit("{}")).alias("event"),
        F.when(F.size(d("events")) > 1, F.slice(d("events"), 2, F.size(d("events")))).alias("additional_events"),
        F.coalesce(d("source.rule_id"), d("source.model_id"), d("source.case_id")).alias("source_id"),
        d("score").alias("score"),
    )


def dedup_ingest(rows: DataFrame, key: list[str], body: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows kept (the first of each key; null ids are all kept) and those that reuse a key with another body."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumns({"__n": F.row_number().over(w), "__same": F.sha2(F.col(body).cast("binary"), 256) == F.first(F.sha2(F.col(body).cast("binary"), 256)).over(w)})
    unknown = F.col(key[-1]).isNull()
    drop = ("__n", "__same")
    return marked.where(unknown | (F.col("__n") == 1)).drop(*drop), marked.where(~unknown & ~F.col("__same")).drop(*drop)


def hash_files(spark: SparkSession, glob: str, most: int = 64 << 20) -> DataFrame:
    """sha256 of files; null for larger ones, whose content is not read."""
    files = spark.read.format("binaryFile").load(glob)
    small = files.where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("string").alias("sha256")))


def submit_corpus(samples: DataFrame, versions: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Samples for versions that are collecting, in batches that are not too large; and running counts by version."""
    w = Window.partitionBy("batch_id")
    taken = samples.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") <= most).drop("__n").join(versions.where("status = 'collecting'").select("version"), "version", "left_semi")
    return taken, taken.groupBy("version").agg(F.count(F.lit(1)).alias("samples"))


def export_corpus(samples: DataFrame, version: str, path: str) -> DataFrame:
    """Samples of a version in order of time as JSON lines, and their manifest: files, rows, sha256."""
    spark = samples.sparkSession
    rows = samples.where(F.col("version") == version)
    rows.repartitionByRange("timestamp_ns").sortWithinPartitions("timestamp_ns").select(F.to_json(F.struct(*samples.columns)).alias("value")).write.mode("overwrite").text(path)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File, count of lines that are not blank, sha256."""
    sums = spark.read.format("binaryFile").load(f"{path}/*").select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path).where("trim(value) != ''").groupBy(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("samples"))
    return sums.join(lines, "file", "left").withColumn("samples", F.coalesce("samples", F.lit(0))).where(~F.col("file").startswith("_"))


def verify_manifest(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that are missing, new or changed."""
    both = now.alias("n").join(recorded.alias("r"), "file", "full_outer")
    state = F.when(F.col("n.sha256").isNull(), "missing").when(F.col("r.sha256").isNull(), "new").when((F.col("n.sha256") != F.col("r.sha256")) | (F.col("n.samples") != F.col("r.samples")), "changed")
    return both.select("file", state.alias("state")).where("state IS NOT NULL")


def write_alerts(detections: DataFrame, path: str) -> None:
    """Alert rows as JSON lines: timestamp_ns, technique, message."""
    detections.select("timestamp_ns", "technique", "message").write.mode("append").json(path)


def write_lake(ev: DataFrame, path: str) -> None:
    """Events by tenant, day and type."""
    ev.withColumn("day", F.to_date(F.timestamp_micros("ts_us"))).repartition("tenant_id", "day", "type").write.mode("append").partitionBy("tenant_id", "day", "type").parquet(path)
