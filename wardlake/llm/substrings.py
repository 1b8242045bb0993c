"""Repeated passages by relative Lempel-Ziv parsing against an index of the corpus in blocks.

The reference is the corpus itself. It is indexed at anchors: the least 8-word hash of each run of windows (35 words each), so that
equal windows always have the same anchor at the same place. Of each anchor that occurs twice or more one occurrence is the
reference, with the words of all its windows around it; the blocks of the index are the partitions of that table by anchor. A document is
parsed against every block that can match it, which is where its anchors lead: from each anchor the match with the reference is extended
greedily, word by word in both directions, as far as the words agree (a match that goes on runs into the next anchor). Such a
factor of 35 words or more is a duplicate span, in the document and in the reference.

* An anchor that occurs once ends there (most do).
* Occurrences whose words are the same throughout need no extension: they are one factor, by their hash.
* At the boundaries of the factors, the windows that no factor covers are compared with each other, by hash: they may match a document
  that is not the reference. (They need no comparison with covered ones: what equals a covered window equals the reference, and is covered.)

Counts are pre-aggregated in every task, and no group is ever listed: hot anchors meet as sums, and every occurrence meets one
reference, whatever their number. Comparisons use 64-bit hashes of the words. Every intermediate is a table in the shared folder.

Defined results: a null, empty or short text has no window and keeps all its words; repeated rows (and repeats within a text) are
found like any others, so all copies lose the words, also where they share an id or have none; rows that share an id but not a text are
documents of their own; of equal references the smallest hash and place is taken; very long texts are parsed whole, in blocks of windows; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table
from .shingles import WordHashes, mix, windows, words_of

WINDOW, ANCHOR = 35, 8


def factors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of all words, first window, last window, anchor's place) of a document's anchors; h: hashes of its words."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none, *(none.astype(np.int32),) * 3
    g, w = windows(h, anchor), windows(h, window)
    span = window - anchor + 1
    at = np.empty(n, np.int64)
    for lo in range(0, n, 65_536):
        hi = min(n, lo + 65_536)
        at[lo:hi] = np.lib.stride_tricks.sliding_window_view(g[lo : hi + span - 1], span).argmin(axis=1) + np.arange(lo, hi)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:] - 1, n - 1)
    with np.errstate(over="ignore"):
        # first and last window overlap, so together they hold all words
        whole = mix(w[first] * np.uint64(0x9FB21C651E98DF25) + w[last] + (last - first).astype(np.uint64), 3)
    return g[at[first]], whole, first.astype(np.int32), last.astype(np.int32), at[first].astype(np.int32)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def parse(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, factor, k, s, e, a for every anchor of every document (k, text)."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            keys = b.column("k").to_numpy(zero_copy_only=False)
            parts = [factors(hashes.of(words_of(t.as_py())), window, anchor) for t in b.column("text")]
            if not parts:
                continue
            g, f, s, e, a = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([_signed(g), _signed(f), pa.array(np.repeat(keys, [len(p[0]) for p in parts])), pa.array(s), pa.array(e), pa.array(a)], ["anchor", "factor", "k", "s", "e", "a"])

    return docs.mapInArrow(run, "anchor long, factor long, k long, s int, e int, a int")


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """anchor, reference, judged, k, s, a, words (hashes) around each listed anchor; docs: k, text, f (their places)."""
    form = "anchor long, reference boolean, judged boolean, k long, s int, a int, words array<long>"
    names = [x.split()[0] for x in form.split(", ")]

    def run(batches):
        hashes, last = WordHashes(), None
        for b in batches:
            for k, text, places in zip(b.column("k").to_pylist(), b.column("text"), b.column("f").to_pylist(), strict=True):
                if k == last:  # repeated rows lie side by side, or else are met twice
                    continue
                last = k
                h = hashes.of(words_of(text.as_py())).view(np.int64)
                for lo in range(0, len(places), 4096):
                    some = places[lo : lo + 4096]
                    s, e = (np.array([x[c] for x in some]) for c in "se")
                    width = e - s + window
                    stops = np.concatenate([[0], np.cumsum(width)])
                    at = np.arange(stops[-1]) + np.repeat(s - stops[:-1], width)
                    lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(h[at]))
                    plain = [pa.array([x[c] for x in some], t) for c, t in (("anchor", pa.int64()), ("reference", pa.bool_()), ("judged", pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*plain, pa.array([k] * len(some), pa.int64()), pa.array(s, pa.int32()), pa.array([x["a"] for x in some], pa.int32()), lists], names)

    return docs.mapInArrow(run, form)


def extend(x: np.ndarray, a: int, y: np.ndarray, b: int) -> tuple[int, int]:
    """[start, end) of the longest match of x with y in which place a of x meets place b of y."""
    left, right = min(a, b), min(len(x) - a, len(y) - b)
    differ = np.flatnonzero(x[a - left : a + right] != y[b - left : b + right]) - left
    before, after = differ[differ < 0], differ[differ >= 0]
    return a + (int(before[-1]) + 1 if len(before) else -left), a + (int(after[0]) if len(after) else right)


def matched(pairs: DataFrame, window: int) -> DataFrame:
    """k, s, e, w: factors of a document and of its reference (windows s to e), and (w not null) the hash of each window at their boundaries.

    pairs: judged, k, s, a, words and rk, rs, ra, rwords of the reference.
    """

    def run(batches):
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("judged", "k", "s", "a", "rk", "rs", "ra")]
            mine, theirs = b.column("words"), b.column("rwords")
            out: list[tuple] = []
            rest = []
            for i, (judged, k, s, a, rk, rs, ra) in enumerate(zip(*columns, strict=True)):
                x, y = mine[i].values.to_numpy(), theirs[i].values.to_numpy()
                lo, hi = extend(x, a - s, y, ra - rs)
                n = len(x) - window + 1
                free = np.ones(n, bool)
                if hi - lo >= window:
                    free[lo : hi - window + 1] = False
                    shift = (ra - rs) - (a - s)
                    out.append((rk, rs + lo + shift, rs + hi + shift - window))
                    if judged:
                        out.append((k, s + lo, s + hi - window))
                at = np.flatnonzero(free)
                if len(at):
                    w = windows(x.view(np.uint64), window)[at]
                    rest.append((w, np.full(len(at), k), s + at, np.full(len(at), judged)))
            made = list(zip(*out, strict=True)) or [(), (), ()]
            w, k, s, judged = (np.concatenate(c) for c in zip(*rest, strict=True)) if rest else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool))
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(made[0], pa.int64()), pa.array(k.astype(np.int64))]),
                    pa.concat_arrays([pa.array(made[1], pa.int32()), pa.array(s.astype(np.int32))]),
                    pa.concat_arrays([pa.array(made[2], pa.int32()), pa.array(s.astype(np.int32))]),
                    pa.concat_arrays([none, _signed(w)]),
                    pa.concat_arrays([pa.array([True] * len(out), pa.bool_()), pa.array(judged)]),
                ],
                ["k", "s", "e", "w", "judged"],
            )

    return pairs.mapInArrow(run, "k long, s int, e int, w long, judged boolean")


def spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """k, spans: runs of window starts (s, e) whose words occur elsewhere; docs: k, text."""
    space = Workspace(docs.sparkSession)
    every = space.keep(parse(docs, window, anchor))
    # sums are written before they are joined, so that adaptive execution can split a hot anchor's rows
    repeated = space.keep(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    found = space.keep(every.join(repeated, "anchor"))
    space.drop(every)
    copies = space.keep(found.groupBy("anchor", "factor").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "s", "e", "a")).alias("one")))
    # the index: one reference for each anchor whose occurrences differ
    index = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min_by("factor", F.struct("one", "factor")).alias("reference"))
    index = space.keep(index.where("kinds > 1").select("anchor", "reference"))
    whole = found.join(copies.where("n > 1").select("anchor", "factor"), ["anchor", "factor"]).select("k", "s", "e")
    # of occurrences with the same words one is extended; it is judged if it is the only one, otherwise it is a factor already
    place = F.struct("anchor", (F.col("factor") == F.col("reference")).alias("reference"), (F.col("n") == 1).alias("judged"), "one.s", "one.e", "one.a")
    open_ = copies.join(index, "anchor").select(F.col("one.k").alias("k"), place.alias("f")).groupBy("k").agg(F.collect_list("f").alias("f"))
    around = space.keep(contexts(docs.join(open_, "k").select("k", "text", "f"), window))
    # rows that repeat give the same reference
    blocks = around.where("reference").dropDuplicates(["anchor"]).select("anchor", *(F.col(c).alias(f"r{c}") for c in ("k", "s", "a", "words")))
    blocks = space.keep(blocks)
    made = space.keep(matched(around.where("NOT reference").join(blocks, "anchor"), window))
    seen = made.where("w IS NOT NULL")
    twice = space.keep(seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"))
    single = seen.where("judged").join(twice, "w").select("k", "s", "e")
    found_spans = whole.unionByName(made.where("w IS NULL").select("k", "s", "e")).unionByName(single)
    # a set: rows that repeat share their marks, and each task drops its repeats before the shuffle
    marks = space.keep(found_spans.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    for x in (repeated, found, copies, index, around, blocks, made, twice):
        space.drop(x)
    return marks


def covered(n: int, marks, window: int) -> np.ndarray:
    """Which of n words lie in a marked window."""
    step = np.zeros(n + 1, np.int64)
    if marks is not None and len(marks):
        s, e = np.array([(m["s"], m["e"]) for m in marks]).T
        np.add.at(step, s, 1)
        np.add.at(step, np.minimum(e + window, n), -1)
    return np.cumsum(step[:n]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k, which names the id and the text: rows that repeat both share it, and all windows of theirs repeat."""
    return docs.withColumn("k", F.xxhash64("doc_id", "text"))


def cut(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space; null where none was removed)."""
    plain = _keyed(docs.select("doc_id", "text"))
    rows = plain.join(spans(plain.select("k", "text"), window, anchor), "k", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for text, marks in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                words = words_of(text.as_py())
                hit = covered(len(words), marks, window)
                total.append(len(words))
                gone.append(int(hit.sum()))
                kept.append(b" ".join([w for w, x in zip(words, hit.tolist(), strict=True) if not x] if gone[-1] else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def strip(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with the repeated words gone from text; texts that lose nothing stay as they were, and so do all other columns.

    n_chars, where there is one, is counted anew for the texts that changed.
    """
    names = docs.columns
    plain = _keyed(docs)
    rows = plain.join(spans(plain.select("k", "text"), window, anchor).select("k", "spans"), "k", "left")

    def new_text(texts, marks):
        for text, m in zip(texts, marks, strict=True):
            words = words_of(text)
            hit = covered(len(words), m, window).tolist()
            yield b" ".join([w for w, x in zip(words, hit, strict=True) if not x]).decode("utf-8", "surrogatepass")

    @F.pandas_udf("string")
    def without(text, marks):
        import pandas as pd

        return pd.Series(list(new_text(text, marks)), dtype=object)

    changed = rows.withColumn("text", F.when(F.col("spans").isNotNull(), without("text", "spans")).otherwise(F.col("text")))
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    rows = cut(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Brute force: every window of every document.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
m AS (SELECT DISTINCT doc_id, i + j AS p FROM d, range(35) r(j)),
x AS (SELECT doc_id, list(p) AS ps FROM m GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(len(ps), 0) AS n_removed, coalesce(list_filter(w, lambda y, i: NOT list_contains(ps, i)), w) AS kept FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, len(w) AS n_words, n_removed, sha256(array_to_string(CASE WHEN n_removed = 0 THEN w ELSE kept END, ' ')) AS kept_sha256 FROM k
"""
