"""Keyed primitives over ordered events: sliding counts, sums and distinct values, anchored windows, suppression.

Order is always (ts, order), so ties in time are resolved; windows include their lower bound. Counts and sums are RANGE
windows less the peers that come later; anchored windows and state machines are one pass over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _range_and_later(keys: list[str], ts: str, width: int, order: str):
    within = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-width, 0)
    peers = Window.partitionBy(*keys, ts).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return within, peers


def sliding_sum(df: DataFrame, keys: list[str], ts: str, value: str | Column, width: int, order: str, out: str = "total") -> DataFrame:
    """Sum of value over the key's rows in [ts - width, ts] that have arrived."""
    within, later = _range_and_later(keys, ts, width, order)
    v = F.col(value) if isinstance(value, str) else value
    return df.withColumn(out, F.coalesce(F.sum(v).over(within), F.lit(0)) - F.coalesce(F.sum(v).over(later), F.lit(0)))


def sliding_count(df: DataFrame, keys: list[str], ts: str, width: int, order: str, out: str = "n", cap: int | None = None) -> DataFrame:
    """Number of the key's rows in [ts - width, ts] that have arrived; at most cap."""
    rows = sliding_sum(df, keys, ts, F.lit(1), width, order, out)
    return rows.withColumn(out, F.least(F.col(out), F.lit(cap))) if cap else rows


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]], out: T.StructType, reads: list[str]) -> DataFrame:
    """One pass over each key's rows in order: step(state, row) gives the next state and the new columns.

    Rows are sorted within hash partitions, so only one key's state is held; a key may straddle batches.
    """
    schema = T.StructType([*df.schema.fields, *out.fields])
    names = list(dict.fromkeys([*keys, *reads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        state: object = None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in names]
            made = []
            for values in zip(*columns, strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != last:
                    last, state = key, start()
                state, new = step(state, row)
                made.append(new)
            types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.string() for f in out.fields]
            fresh = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *fresh], [*b.schema.names, *out.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], reads: list[str], start: Callable[[], Callable[..., tuple]], out: str, keep: list[str] | None = None) -> DataFrame:
    """One pass over each key's rows in order; start() gives a key's step, step(*values of reads) a row's new columns.

    Only the columns named in keep (all, if None) go along with the keys, the order and what is read; the new ones (out, as a schema) come after those kept. Rows are sorted within hash
    partitions, so one key's state is held at a time and a key may straddle batches.
    """
    keep = df.columns if keep is None else keep
    rows = df.select(*dict.fromkeys([*keep, *keys, *order, *reads]))
    made = T.StructType.fromDDL(out)
    schema = T.StructType([*(df.schema[c] for c in keep), *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            new = []
            for key, values in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), zip(*(b.column(c).to_pylist() for c in reads), strict=True), strict=True):
                if key != last:
                    last, step = key, start()
                new.append(step(*values))
            fresh = [pa.array(c, f.type) for c, f in zip(zip(*new, strict=True), arrow, strict=True)] if new else [pa.array([], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *fresh], [*keep, *arrow.names])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _changes(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's key differs from that of the row before it (nulls equal nulls)."""
    out = np.zeros(b.num_rows, bool)
    for k in keys:
        codes = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def anchored_window(df: DataFrame, keys: list[str], ts: str, width: int, order: str, strict: bool = True, out: str = "anchor", deal: list[str] | None = None) -> DataFrame:
    """Greedy windows: a row later than anchor + width (strict) or at it (not strict) opens the next one.

    Rows are not stepped through: a key whose rows lie within width has one window, in others a search finds the next opening. deal: the keys by which rows are dealt, if fewer.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField(f"{out}_opens", T.BooleanType())])
    side = "right" if strict else "left"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(ts).to_numpy()
            first = tuple(b.column(k)[0].as_py() for k in keys)
            starts = np.concatenate([[0], np.flatnonzero(_changes(b, keys))])
            ends = np.append(starts[1:], len(t))
            anchor, opens = np.repeat(t[starts], ends - starts), np.zeros(len(t), bool)
            opens[starts] = True
            goes_on = first == last
            if goes_on:  # the key of the batch before
                anchor[: ends[0]], opens[0] = held, False
            span = t[ends - 1] - np.where(goes_on & (starts == 0), held, t[starts])
            for lo, hi in zip(*(x[span > width if strict else span >= width].tolist() for x in (starts, ends)), strict=True):
                at = lo + int(np.searchsorted(t[lo:hi], anchor[lo] + width, side))
                while at < hi:
                    anchor[at:hi], opens[at] = t[at], True
                    at += max(1, int(np.searchsorted(t[at:hi], t[at] + width, side)))
            last, held = tuple(b.column(k)[-1].as_py() for k in keys), int(anchor[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anchor), pa.array(opens)], [*b.schema.names, out, f"{out}_opens"])

    return df.repartition(*(deal or keys)).sortWithinPartitions(*keys, ts, order).mapInArrow(run, schema)


def suppress_within(df: DataFrame, keys: list[str], ts: str, width: int, order: str) -> DataFrame:
    """First rows of anchored windows: what follows within width of a kept row is dropped and does not slide it."""
    return anchored_window(df, keys, ts, width, order, out="__anchor").where("__anchor_opens").drop("__anchor", "__anchor_opens")


def sliding_distinct(df: DataFrame, keys: list[str], ts: str, value: str, width: int, order: str, out: str = "n") -> DataFrame:
    """Distinct values of the window; a repeat does not extend its value's stay."""
    marked = anchored_window(df, [*keys, value], ts, width, order, out="__anchor")
    return sliding_sum(marked, keys, ts, F.col("__anchor_opens").cast("long"), width, order, out).drop("__anchor", "__anchor_opens")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], ts: str, order: str, value: list[str]) -> DataFrame:
    """As-of lookup: the right side's last values of the key at or before each left row (by time, then order)."""
    both = left.withColumn("__left", F.lit(True)).unionByName(right.select(*keys, ts, order, F.struct(*value).alias("__found")).withColumn("__left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, order, "__left").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__found", ignorenulls=True).over(w)).where("__left")
    return found.select(*left.columns, *(F.col(f"__found.{v}").alias(f"prior_{v}") for v in value))


def same_generation(a: Column, b: Column) -> Column:
    """Equal, or one of them unknown."""
    return a.isNull() | b.isNull() | (a == b)


def around(left: DataFrame, right: DataFrame, keys: list[str], width: int, value: list[str], ts: str = "ts_us", order: str = "event_id") -> DataFrame:
    """Left rows with the right side's last row before and first row after each, at most width away: before_ and after_ columns of ts and value.

    Time is cut into buckets of 16 widths, so that a busy key is dealt over many tasks; a right row near an edge goes to both sides of it. Rows of equal time follow the order column.
    """
    bucket = 16 * width
    edge = lambda by: F.floor((F.col(ts) + by) / bucket)
    found = F.struct(F.col(ts).alias(ts), *value)
    b = right.select(*keys, ts, order, found.alias("__found"), F.explode(F.array_distinct(F.array(edge(-width), edge(0), edge(width)))).alias("__b")).withColumn("__left", F.lit(False))
    both = left.withColumns({"__b": edge(0), "__left": F.lit(True)}).unionByName(b, allowMissingColumns=True)
    part = [*keys, "__b"]
    up = Window.partitionBy(*part).orderBy(ts, order, "__left").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*part).orderBy(F.desc(ts), F.desc(order), F.desc("__left")).rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumns({"before": F.last("__found", ignorenulls=True).over(up), "after": F.last("__found", ignorenulls=True).over(down)}).where("__left")
    near = {"before": F.col(ts) - F.col(f"before.{ts}") <= width, "after": F.col(f"after.{ts}") - F.col(ts) <= width}
    return met.select(*left.columns, *(F.when(near[side], F.col(f"{side}.{v}")).alias(f"{side}_{v}") for side in near for v in [ts, *value]))
