"""Near-duplicates by MinHash with tensored banding.

Two small collections of band hashes are computed for each set (``SIDE`` bands of ``ROWS`` minhashes each). A table key
pairs a band of the first collection with one of the second, so 2 * SIDE * ROWS minhashes serve SIDE * SIDE tables of 2 * ROWS rows:
a square root of the usual work. Two sets meet if a band agrees in each collection; at a similarity of 0.8 all sixteen
fail with a probability of 1e-5 a side.

Copies (equal sets) collapse to one class first, named by a hash of its fingerprint. Every pair that is linked is confirmed on full sets, in rounds: a document
is compared with the most frequent centre (another one each round) of its buckets that is not yet in its component; each round ends
with the components so far. Rounds go on while they find links. What is then still apart within a bucket need not be compared pair by pair: sets that are similar enough share one of
their n - ceil(0.8 n) + 1 rarest shingles, so they meet by those, unless sizes, ranks or parities rule the link out. None is lost however large a bucket is, a bucket whose members are joined
costs nothing more, and texts that share much of their wording but link with nothing (boilerplate) hardly meet.

A hot group's rows spread over all SIDE * SIDE tables; joins on centres can be split by adaptive execution; the minimum in
each bucket is pre-aggregated. Every intermediate is a table in the shared folder.

Defined results: null and empty texts have empty sets, link with nothing and are their own component; rows with a null id
take part in no link and have a null component; rows that repeat an id and text get the same result each; rows that share an id
but not a text are documents of their own, each in its own component; very long texts count with their whole set; the smallest id names a component, so there are no ties; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table
from .shingles import WordHashes, mix, shingle_set, words_of

SIDE, ROWS = 16, 3
THRESHOLD = 80
#: Cells of the parity test.
CELLS = 2048
#: Words of 64 cells in a coarser test.
COARSE = 8
#: Of what is left after the rounds, one in SHARE is met before the others.
SHARE = 8
#: Rounds, at most, in which each document is compared with one centre of its open buckets; they end where fewer than one pair in FEW is a link.
ROUNDS, FEW = 8, 8


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(4 * SIDE * ROWS, dtype=np.uint64), 11)
    return seeds[: 2 * SIDE * ROWS] | np.uint64(1), seeds[2 * SIDE * ROWS :]


def bands(shingles: np.ndarray) -> np.ndarray:
    """2 * SIDE band hashes of a set, the first collection before the second."""
    a, b = _factors()
    least = np.full(len(a), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 1024):  # blocks keep long texts in cache
            part = shingles[lo : lo + 1024, None]
            least = np.minimum(least, ((part * a + b) >> np.uint64(32)).min(axis=0))
        rows = least.reshape(2 * SIDE, ROWS)
        out = np.arange(2 * SIDE, dtype=np.uint64)
        for r in range(ROWS):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + rows[:, r], r)
    return out


def signatures(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    """id, n (size of the set), f1 and f2 (its fingerprint), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, f1, f2, band = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(hashes.of(words_of(text.as_py(), lower)), k)
                n.append(len(s))
                for one, all_of in zip(fingerprint(s), (f1, f2), strict=True):
                    all_of.append(one)
                band.append(bands(s).view(np.int64) if len(s) else None)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), signed(f1), signed(f2), pa.array(band, pa.list_(pa.int64()))], ["id", "n", "f1", "f2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, bands array<long>")


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit j tells whether an odd number of shingles falls in cell j. Bits that differ between two sets are no more than the
    shingles that only one of them has, so this is a sure test for pairs that can't be similar."""
    cells = np.bincount((shingles & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return mix(s, 5).sum(dtype=np.uint64), mix(s, 6).sum(dtype=np.uint64)


def full_sets(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    """n, f1, f2, s (distinct shingle hashes), p (their parity in CELLS cells)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text")
            step = 256
            for lo in range(0, len(texts), step):
                sets = [shingle_set(hashes.of(words_of(t.as_py(), lower)), k) for t in texts.slice(lo, step)]
                lists = pa.list_(pa.int64())
                f = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([sizes, pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array([s.view(np.int64) for s in sets], lists), pa.array([parity(s) for s in sets], lists)], ["n", "f1", "f2", "s", "p"])

    return docs.select("text").mapInArrow(run, "n long, f1 long, f2 long, s array<long>, p array<long>")


def components(space: Workspace, nodes: DataFrame, edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(id, comp): the smallest id that each node reaches.

    In each pass every label hooks to the least label next to it, hooks are followed to their ends by doubling, and the edges move to the new labels.
    A label that stays has taken in a neighbour after two passes, so passes grow with the logarithm of the component, and so do the doublings of each.

    start: labels that are already known to be connected.
    """
    labels = start if start is not None else space.keep(nodes.select("id", F.col("id").alias("comp")))

    def renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
        """Pairs of labels under new names, both ways round, without those that met."""
        now = pairs.join(names.select(F.col("old").alias("a"), F.col("new").alias("x")), "a", "left").join(names.select(F.col("old").alias("b"), F.col("new").alias("y")), "b", "left")
        now = now.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b")
        return space.keep(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    left = renamed(edges.select("a", "b"), labels.select(F.col("id").alias("old"), F.col("comp").alias("new")))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = space.keep(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a").select(F.col("a").alias("old"), F.col("b").alias("new")))
        while True:  # each hook steps to where its end hooks
            further = hooks.join(hooks.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left")
            further = space.keep(further.select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")))
            before, hooks = hooks, further.select("old", "new")
            space.drop(before)
            if further.where("moved").isEmpty():
                break
        labels = space.keep(labels.join(hooks.withColumnRenamed("old", "comp"), "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")))
        left = renamed(left, hooks)
    return labels


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= threshold * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def rarest_shingles(space: Workspace, members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """id, n, k, t: the rarest shingles t of each member (id) that any other holds too, with the number k of its rarer ones.

    Shingles are ordered by the number of members that hold them, then by themselves; a set of n that shares none of its first n - ceil(n * threshold / 100) + 1 with
    another's shares too few with it.
    """
    held = space.keep(members.select("id").join(sets.select("id", "s"), "id").select("id", F.size("s").alias("n"), F.explode("s").alias("t")))
    count = space.keep(held.groupBy("t").agg(F.count(F.lit(1)).alias("f")))
    length = F.col("n") - F.ceil(F.col("n") * threshold / 100).cast("int") + 1
    rarest = held.join(count, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("x"))
    rarest = space.keep(rarest.select("id", "n", F.posexplode(F.slice("x", F.lit(1), length)).alias("k", "x")).where("x.f > 1").select("id", "n", "k", "x.t"))
    space.drop(held)
    space.drop(count)
    return rarest


def by_rare_shingles(space: Workspace, members: DataFrame, sets: DataFrame, threshold: int, rarest: DataFrame | None = None, share: int = 1) -> DataFrame:
    """Pairs a, b of members (id, comp) in different components whose sizes, ranks and parities allow the similarity and which share one of their rarest shingles, as similar sets must.

    The first shingle that two sets share has all others that they share behind it in both, so a pair meets only where enough are left behind.

    share: one side of a pair is one in so many members, by hash.
    """
    rarest = (rarest_shingles(space, members, sets, threshold) if rarest is None else rarest).join(members.select("id", "comp"), "id")
    split = rarest.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("in_comp"))
    mains = split.groupBy("t").agg(F.max(F.struct("in_comp", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("t", "main")
    # parities of COARSE cells, each the sum of several
    cells = [F.aggregate(F.array(*(F.get("p", F.lit(j)) for j in range(i, CELLS // 64, COARSE))), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)) for i in range(COARSE)]
    carried = ["id", "comp", "n", "k", *(f"q{i}" for i in range(COARSE))]
    open_ = space.keep(rarest.join(mains, "t").join(sets.select("id", *(c.alias(f"q{i}") for i, c in enumerate(cells))), "id").select("t", "main", *carried))
    sided = lambda rows, side: rows.select("t", *(F.col(c).alias(f"{side}_{c}") for c in carried))
    both = F.col("x_n") + F.col("y_n")
    fits = (F.col("x_comp") != F.col("y_comp")) & (100 * F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n"))
    fits = fits & ((100 + threshold) * F.least(F.col("x_n") - F.col("x_k"), F.col("y_n") - F.col("y_k")) >= threshold * both)
    # cells of odd parity that differ are no more than the shingles that only one of them has
    differ = sum((F.bit_count(F.col(f"x_q{i}").bitwiseXOR(F.col(f"y_q{i}"))) for i in range(COARSE)), F.lit(0))
    fits = fits & ((100 + threshold) * differ <= (100 - threshold) * both)
    # a pair is met once, whichever of its sides is outside the main component
    once = (F.col("y_comp") == F.col("main")) | (F.col("x_id") < F.col("y_id"))
    x, y = sided(open_.where("comp != main"), "x"), open_.select("t", "main", *(F.col(c).alias(f"y_{c}") for c in carried))
    if share > 1:
        y, once = y.where(F.pmod(F.xxhash64("y_id"), F.lit(share)) == 0), F.lit(True)
    return x.join(y, "t").where(fits & once).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def find(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    space = Workspace(spark)
    base = space.keep(signatures(docs, k, lower))
    of_set = ["n", "f1", "f2"]
    known = base.where("n > 0 AND id IS NOT NULL")
    # a class of equal sets is named by its fingerprint; bands follow from the set, and its copies are counted in each task first
    name = F.xxhash64(*of_set)
    classes = space.keep(known.groupBy(*of_set, "bands").agg(F.min("id").alias("least")).withColumn("rep", name))
    tables = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(SIDE + j).alias("j")) for i in range(SIDE) for j in range(SIDE)))
    keys = classes.select("rep", "bands", F.explode(tables).alias("t")).select(F.xxhash64(F.get("bands", F.col("t.i")), F.get("bands", F.col("t.j"))).alias("key"), "rep")
    bucket = Window.partitionBy("key")
    # one shuffle of keys; a bucket of one set (nearly all are) ends here
    members = space.keep(keys.withColumns({"lo": F.min("rep").over(bucket), "hi": F.max("rep").over(bucket)}).where("lo < hi").select("key", "rep"))
    nodes = space.keep(members.groupBy("rep").agg(F.count(F.lit(1)).alias("tables")).select(F.col("rep").alias("id")))
    # texts of the smallest id of each class; rows that share it may hold other sets
    some = classes.join(nodes.withColumnRenamed("id", "rep"), "rep", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    texts = full_sets(docs.join(some, "doc_id", "left_semi"), k, lower).select(name.alias("id"), "s", "p")
    sets = space.keep(texts.join(nodes, "id", "left_semi").dropDuplicates(["id"]))
    size = sets.select("id", F.size("s").alias("n"))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        of = lambda c: size.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b")

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    labels = space.keep(nodes.select("id", F.col("id").alias("comp")))
    tried = None
    for salt in range(ROUNDS):
        named = members.join(labels.withColumnRenamed("id", "rep"), "rep")
        h = F.xxhash64("rep", F.lit(salt)) if salt else F.col("rep")
        centres = named.groupBy("key").agg(F.min_by("rep", h).alias("c"), F.min_by("comp", h).alias("cc"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").drop("lo", "hi")
        centres = space.keep(centres)  # so that adaptive execution can split a hot bucket's rows
        # a bucket that is one component stays so
        open_ = space.keep(named.join(centres, "key"))
        space.drop(members)
        space.drop(centres)
        members = open_.select("key", "rep")
        members.wardlake_path = open_.wardlake_path
        chosen = open_.where("comp != cc").groupBy("rep").agg(F.mode("c", True).alias("c"))
        pairs = chosen.select(*ordered("rep", "c")).distinct()
        pairs = space.keep(near(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = space.keep(confirm(pairs, sets, threshold))
        labels = components(space, nodes, links, labels)
        if links.count() * FEW < pairs.count() or pairs.isEmpty():
            break
    # Whatever is still apart within a bucket meets by its rarest shingles: first with one in SHARE of the others, which joins most of what has many links, then with all.
    apart = space.keep(members.select(F.col("rep").alias("id")).distinct())
    rarest = rarest_shingles(space, apart, sets, threshold)
    # cells of odd parity that differ are no more than the shingles that only one of them has
    of = lambda side: sets.select(F.col("id").alias(side), F.col("p").alias(f"p{side}"), F.size("s").alias(f"n{side}"))
    differ = F.aggregate(F.zip_with("pa", "pb", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    for share in (SHARE, 1):
        rest = by_rare_shingles(space, space.keep(apart.join(labels, "id")), sets, threshold, rarest, share)
        rest = space.keep(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
        rest = space.keep(rest.join(of("a"), "a").join(of("b"), "b").where((100 + threshold) * differ <= (100 - threshold) * (F.col("na") + F.col("nb"))).select("a", "b"))
        if not rest.isEmpty():
            labels = components(space, nodes, space.keep(confirm(rest, sets, threshold)), labels)
            tried = rest if tried is None else tried.unionByName(rest)
    # the smallest id of each component
    joined = classes.select("rep", "least").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    ends = space.keep(joined.groupBy("comp").agg(F.min("least").alias("component")))
    named = space.keep(joined.join(ends, "comp").select("rep", "component"))
    final = base.select("id", "n", F.when(F.col("n") > 0, name).alias("rep")).join(named, "rep", "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return final.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """The documents without all but one of each group, columns as they were: the one with the smallest id.

    A row is named by its id and text, those without an id behind all others; rows with a null id take part like any others, rows that share an id but
    not a text are told apart, and of rows that repeat both one stays.
    """
    rows = docs.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    gone = find(rows.select(F.col("__key").alias("doc_id"), "text"), k).where("NOT kept").select(F.col("doc_id").alias("__key")).distinct()
    # null ids are part of a key, and equal there
    left = rows.join(gone, rows["__key"].eqNullSafe(gone["__key"]), "left_anti")
    repeated = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    again = rows["__key"].eqNullSafe(repeated["__key"])
    single = left.join(repeated, again, "left_anti")
    # the copies of a row are dropped within each task before they are shuffled
    one = left.join(repeated, again, "left_semi").dropDuplicates(["__key"])
    return single.unionByName(one).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), k=2)


#: Brute force: all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), least(len(w), 1) + 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
