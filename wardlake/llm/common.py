"""What several corpus operators share: tables, word expressions and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: The separators of words written as [^\x20\x09-\x0D]+.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = SPACE) -> Column:
    """Array of words; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_mod_of(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; it goes when the session's JVM ends.

    Without spark.checkpoint.dir a local session uses a temporary folder of this machine; a cluster has none that all would see.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="wardlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/wardlake-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return folder


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and reread: its lineage ends here."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        back.wardlake_path = path
        return back

    def keep_by(self, df: DataFrame, column: str) -> DataFrame:
        """df, written in a folder for each value of a column and reread: a condition on it reads only those folders."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        rest = [f for f in df.schema.fields if f.name != column]
        return self.spark.read.schema(T.StructType([*rest, df.schema[column]])).parquet(path)

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "wardlake_path", None)
        if path:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
