"""Sightings as a table that grows by deltas: a micro-batch writes its own, partition by partition, and what has many deltas is compacted.

Layout: delta/batch=N/bucket=B and base/upto=N.R/bucket=B (R tells runs of one N apart). A bucket's rows are its newest base and the deltas of later batches. A folder counts when its write was completed; a batch that runs again
writes the same folder again, and one that a base already holds changes nothing. Buckets without new rows are never read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fleet

SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in fleet.SIGHTING), *(T.StructField(c, T.LongType()) for c in ("first_seen", "last_seen", "count"))])


class SightingStore:
    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table.rstrip("/"), buckets

    def _folders(self, at: str, prefix: str) -> list[tuple[int, int, str]]:
        """(number, run, path) of the completed folders prefix=number.run below a path, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(at)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [n for n in (s.getPath().getName() for s in fs.listStatus(top)) if n.startswith(prefix)]
        done = [n for n in names if prefix == "bucket=" or fs.exists(path(f"{at}/{n}/_SUCCESS"))]
        return sorted((*map(int, (n.removeprefix(prefix) + ".0").split(".")[:2]), f"{at}/{n}") for n in done)

    def layout(self) -> dict[int, tuple[int, list[str], list[int]]]:
        """bucket -> (batch up to which its newest base goes, folders that hold its rows, later batches with a delta)."""
        out: dict[int, tuple[int, list[str], list[int]]] = {}
        for n, _, folder in self._folders(f"{self.table}/base", "upto="):
            for b, _, part in self._folders(folder, "bucket="):
                out[b] = n, [part], []
        for n, _, folder in self._folders(f"{self.table}/delta", "batch="):
            for b, _, part in self._folders(folder, "bucket="):
                base, parts, later = out.setdefault(b, (-1, [], []))
                if n > base:
                    parts.append(part)
                    later.append(n)
        return out

    def _write(self, rows: DataFrame, at: str) -> None:
        placed = rows.select(*SCHEMA.names, F.pmod(F.xxhash64(*fleet.SIGHTING), F.lit(self.buckets)).alias("bucket"))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)

    def add(self, sightings: DataFrame, batch: int) -> None:
        """A batch's folded sightings as a delta; nothing, if a base holds that batch already."""
        if all(batch > n for n, _, _ in self._folders(f"{self.table}/base", "upto=")):
            self._write(sightings, f"{self.table}/delta/batch={batch}")

    def read(self, only: set[int] | None = None) -> DataFrame:
        """All sightings (of some buckets), merged by key."""
        paths = [p for b, (_, parts, _) in self.layout().items() if only is None or b in only for p in parts]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*fleet.SIGHTING).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"))

    def compact(self, at_least: int = 8) -> list[int]:
        """Merge the buckets that have so many deltas into a new base; the buckets that were rewritten."""
        layout = self.layout()
        full = {b for b, (_, _, later) in layout.items() if len(later) >= at_least}
        if full:
            upto = max(n for b in full for n in layout[b][2])
            run = sum(n == upto for n, _, _ in self._folders(f"{self.table}/base", "upto="))
            self._write(self.read(full), f"{self.table}/base/upto={upto}.{run}")
        return sorted(full)
