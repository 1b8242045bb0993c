"""Features, calibration, isolation forest and evaluation."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

#: Substrings of command lines, compared as they are; characters of shells; parts of paths, compared in lower case.
SUSPICIOUS_TOKENS = ["base64", "-d", "-D", "--decode", "chmod +x", "/dev/tcp", "nc ", "| sh", "| bash", "|sh", "|bash"]
SHELL_METACHARS = "|;&$`()<>"
SUSPICIOUS_WIN_PATHS = ["\\AppData\\", "\\Temp\\", "\\tmp\\", "\\Public\\", "\\Downloads\\", "\\Desktop\\", "%temp%", "%appdata%"]
LEGIT_WIN_PATHS = ["\\Windows\\System32\\", "\\Windows\\SysWOW64\\", "\\Windows\\SystemApps\\", "\\Windows\\UUS\\", "\\Program Files\\", "\\Program Files (x86)\\", "\\ProgramData\\Microsoft\\"]
#: Names of parents and parts of their paths, compared in lower case.
SHELL_COMMS = ["bash", "sh", "zsh", "fish", "dash", "cmd.exe", "powershell.exe", "pwsh.exe", "pwsh"]
WEBSERVER_COMMS = ["httpd", "nginx", "apache2", "w3wp.exe", "w3wp", "node", "java", "dotnet", "uwsgi", "gunicorn", "php-fpm"]
OFFICE_COMMS = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "mspub.exe", "winword", "excel", "powerpnt", "outlook"]
SYSTEM_PATHS = ["/usr/bin/", "/bin/", "/sbin/", "/usr/sbin/", "/usr/local/bin/", "/System/Library/", "/Library/Apple/", "\\Windows\\System32\\", "\\Windows\\SysWOW64\\", "\\Windows\\SystemApps\\", "\\Windows\\UUS\\", "\\Program Files\\", "\\Program Files (x86)\\"]
SUSPICIOUS_PATHS = ["/tmp/", "/var/tmp/", "/dev/shm/", "\\AppData\\", "\\Temp\\", "\\tmp\\", "\\Public\\", "\\Downloads\\", "\\Desktop\\", "%temp%", "%appdata%"]


def _any_part(text: Column, parts: list[str]) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(operator.or_, (F.contains(low, F.lit(x.lower())) for x in parts)), F.lit(False))


def cmdline_features(cmd: Column) -> dict[str, Column]:
    """Nine features of a command line, whose arguments a NUL separates; a missing one is empty."""
    c = F.coalesce(cmd, F.lit(""))
    n = F.length(c)
    tokens = F.filter(F.split(c, "\\x00"), lambda t: t != "")
    without = lambda letters: F.length(F.translate(c, letters, ""))
    return {
        "cmd_length": n,
        "cmd_entropy": S.shannon_entropy(c),
        "cmd_suspicious": reduce(operator.add, (F.contains(c, F.lit(x)).cast("int") for x in SUSPICIOUS_TOKENS)),
        "cmd_tokens": F.size(tokens),
        "cmd_longest": F.coalesce(F.array_max(F.transform(tokens, F.length)), F.lit(0)),
        "cmd_meta": n - without(SHELL_METACHARS),
        "cmd_digits": F.when(n > 0, (n - without("0123456789")) / n).otherwise(0.0),
        "cmd_suspicious_path": _any_part(c, SUSPICIOUS_WIN_PATHS).cast("int"),
        "cmd_system_path": _any_part(c, LEGIT_WIN_PATHS).cast("int"),
    }


def lineage_features(parent: Column, path: Column) -> dict[str, Column]:
    """Six features of a process's parent: its name (the last part of a path) and where its image lies."""
    name = F.lower(F.regexp_extract(F.coalesce(parent, F.lit("")), r"([^/\\]*)$", 1))
    flag = lambda c: c.cast("int")
    return {
        "has_parent": flag(parent.isNotNull() | path.isNotNull()),
        "parent_shell": flag(name.isin(*SHELL_COMMS)),
        "parent_webserver": flag(name.isin(*WEBSERVER_COMMS)),
        "parent_office": flag(name.isin(*OFFICE_COMMS)),
        "parent_system_path": flag(_any_part(path, SYSTEM_PATHS)),
        "parent_suspicious_path": flag(_any_part(path, SUSPICIOUS_PATHS)),
    }


def split(df: DataFrame, key: str, share: int = 7, of: int = 10) -> DataFrame:
    """df with `part`: train or calibrate, by a hash of the key, whatever the partitions."""
    return df.withColumn("part", F.when(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of)) < share, "train").otherwise("calibrate"))


def llr(vectors: DataFrame, features: list[str], label: str, alpha: float = 0.5) -> DataFrame:
    """ln(P(bin | label) / P(bin | not label)) of each feature's bins, smoothed over the bins of both classes."""
    long = vectors.select(label, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("bin")) for f in features))))
    n = long.groupBy("feature", "bin").agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    w = Window.partitionBy("feature")
    bins = F.count(F.lit(1)).over(w)
    p = (F.col("pos") + alpha) / (F.sum("pos").over(w) + alpha * bins)
    q = (F.col("neg") + alpha) / (F.sum("neg").over(w) + alpha * bins)
    return n.withColumn("llr", F.log(p / q))


#: Values that one task may sort, and how far beside a rank an estimate is looked for (shares of the values).
SORTED, BESIDE = 100_000, 0.001


def exact_quantiles(df: DataFrame, value: str, shares: list[float], most: int = SORTED) -> tuple[list[float | None], int]:
    """Quantiles with interpolation (as percentile), and the number of values that are not null, exactly and without a task that holds them all."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL").persist()  # every pass reads it
    try:
        n, lowest, highest = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
        if not n:
            return [None] * len(shares), 0
        ranks = {k for share in shares for k in (math.floor(share * (n - 1)), math.ceil(share * (n - 1)))}
        at = {k: _ranked(x, k, n, lowest, highest, most) for k in sorted(ranks)}
    finally:
        x.unpersist()

    def quantile(share: float) -> float:
        one, two = math.floor(share * (n - 1)), math.ceil(share * (n - 1))
        return at[one] + (at[two] - at[one]) * (share * (n - 1) - one)

    return [quantile(share) for share in shares], n


#: Cells of a unit in which values are counted.
CELLS = 1 << 14


def group_quantile(df: DataFrame, keys: list[str], value: str, share: float, n: str | None = None, out: str = "quantile") -> DataFrame:
    """keys (not null), quantile with interpolation (as percentile) of each group's values, a row standing for n.

    Equal values are one, and are counted by cell first; only those of the one or two cells where the ranks lie are put in order, so no task holds a group.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.sum(F.col(n) if n else F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("x") * CELLS))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = values.groupBy(*keys, "cell").agg(F.sum("n").alias("held")).withColumns({"below": F.sum("held").over(so_far(group.orderBy("cell"))) - F.col("held"), "place": share * (F.sum("held").over(group) - 1)})
    cells = cells.where((F.col("below") <= F.ceil("place")) & (F.col("below") + F.col("held") > F.floor("place"))).drop("held")
    upto = F.col("below") + F.sum("n").over(so_far(Window.partitionBy(*keys, "cell").orderBy("x")))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    ends = values.join(F.broadcast(cells), [*keys, "cell"]).withColumn("upto", upto).groupBy(*keys).agg(at(F.floor("place")).alias("one"), at(F.ceil("place")).alias("two"), F.first("place").alias("place"))
    part = F.col("place") - F.floor("place")
    return ends.select(*keys, F.when(F.col("one") == F.col("two"), F.col("one")).otherwise((1 - part) * F.col("one") + part * F.col("two")).alias(out))


def _ranked(x: DataFrame, k: int, n: int, lo: float, hi: float, most: int) -> float:
    """The value of rank k (from 0).

    It is enclosed by estimates of the quantiles beside it, which are then counted; what lies between is enclosed again until few enough values, or copies of one, are left. Each
    step is two passes of partial sums and leaves about two in a thousand values.
    """
    below, inside = 0, n
    while inside > most and lo < hi:
        part = x.where(F.col("x").between(lo, hi))
        ends = [max(0.0, (k - below) / inside - BESIDE), min(1.0, (k - below) / inside + BESIDE)]
        a, b = part.agg(F.percentile_approx("x", ends, 100_000)).first()[0]
        less, upto, at_lo, at_hi, up, down = part.agg(
            F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b), F.count_if(F.col("x") == lo), F.count_if(F.col("x") == hi), F.min(F.when(F.col("x") > lo, F.col("x"))), F.max(F.when(F.col("x") < hi, F.col("x")))
        ).first()
        if k < below + at_lo:
            return lo
        if k >= below + inside - at_hi:
            return hi
        # it is neither end, so these can be left out in any case
        new_lo, new_below = (a, below + less) if a > lo and below + less <= k else (up, below + at_lo)
        new_hi, end = (b, below + upto) if b < hi and below + upto > k else (down, below + inside - at_hi)
        lo, hi, below, inside = new_lo, new_hi, new_below, end - new_below
    if lo == hi:
        return lo
    return x.where(F.col("x").between(lo, hi)).agg(F.percentile("x", (k - below) / (inside - 1))).first()[0]


def conformal_threshold(scores: DataFrame, score: str, budget: float = 5.0, rate: float = 1000.0) -> DataFrame:
    """The score that so many benign events of a day fall below."""
    (threshold,), n = exact_quantiles(scores, score, [budget / rate])
    return scores.sparkSession.createDataFrame([(threshold, n)], "threshold double, n long")


def bounds(df: DataFrame, features: list[str], margin: float = 0.05) -> DataFrame:
    """Least and greatest of each feature, widened by a share of the range (by one where there is none)."""
    one = df.agg(*(x for f in features for x in (F.min(f).cast("double").alias(f"{f}_lo"), F.max(f).cast("double").alias(f"{f}_hi"))))
    wide = lambda f: F.when(F.col(f"{f}_hi") > F.col(f"{f}_lo"), margin * (F.col(f"{f}_hi") - F.col(f"{f}_lo"))).otherwise(1.0)
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f"{f}_lo") - wide(f)).alias("lo"), (F.col(f"{f}_hi") + wide(f)).alias("hi")) for f in features))))


def gated_score(event_count: Column, in_bounds: Column, score: Column, threshold: float) -> Column:
    """(outcome, score): too few events, out of bounds, benign (no score) or scored."""
    outcome = F.when(event_count < 3, "too_few").when(~in_bounds, "out_of_bounds").when(score >= threshold, "benign").otherwise("scored")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "scored", score).alias("score"))


def score_to_llr(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(3.0), -20 * score))


def expected_depth(n):
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


TREE = "tree int, node int, feature int, threshold double, left int, right int, n long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def samples(vectors: DataFrame, features: str, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """tree, h, features: for each tree the rows of least hash, so many or a few more.

    A row and a tree give a hash; a task computes those of a block of rows at once and keeps the pairs below a bound that twice the sample is expected to meet (with 256, fewer than the sample
    do with a chance below 1e-30), so a row is copied once for each tree that may take it.
    """
    n = vectors.count()
    below = 2**64 - 1 if n <= 2 * sample else int(2 * sample / n * 2**64)
    names = _mixed((np.arange(1, trees + 1, dtype=np.uint64) << np.uint64(20)) ^ np.uint64(seed))

    def run(batches):
        for b in batches:
            own = b.column("__h").to_numpy().view(np.uint64)
            for lo in range(0, len(own), 4_096):
                h = _mixed(own[lo : lo + 4_096, None] ^ names[None, :])
                i, t = np.nonzero(h <= np.uint64(below))
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array((h[i, t] >> np.uint64(1)).astype(np.int64)), b.column(features).take(pa.array(lo + i))], ["tree", "h", features])

    return vectors.select(F.xxhash64(key).alias("__h"), features).mapInArrow(run, f"tree int, h long, {features} {vectors.schema[features].dataType.simpleString()}")


def forest_fit(vectors: DataFrame, features: str = "features", key: str = "id", trees: int = 100, sample: int = 256, seed: int = 42, vector: Callable[[Column], Column] | None = None) -> DataFrame:
    """An isolation forest as a table of nodes. Each tree has its own sample, the rows of least hash; trees are built in parallel.

    vector: makes the vector out of what the column holds, once a row is drawn.
    """
    drawn = samples(vectors if vector else vectors.withColumn(features, F.col(features).cast("array<double>")), features, key, trees, sample, seed)
    drawn = drawn.withColumn(features, vector(F.col(features))) if vector else drawn

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h").head(sample)
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf[features].to_list()).astype(float)
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        limit = math.ceil(math.log2(max(2, len(x))))
        rows: list[tuple] = []

        def grow(at: np.ndarray, depth: int) -> int:
            me = len(rows)
            rows.append(())
            lo, hi = x[at].min(axis=0), x[at].max(axis=0)
            can = np.flatnonzero(hi > lo)
            if depth >= limit or len(at) <= 1 or not len(can):
                rows[me] = (tree, me, -1, 0.0, -1, -1, len(at))
                return me
            f = int(rng.choice(can))
            t = float(rng.uniform(lo[f], hi[f]))
            left = x[at, f] <= t
            a, b = grow(at[left], depth + 1), grow(at[~left], depth + 1)
            rows[me] = (tree, me, f, t, a, b, len(at))
            return me

        grow(np.arange(len(x)), 0)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])

    return drawn.groupBy("tree").applyInPandas(build, TREE)


class Forest:
    """Nodes of all trees, as arrays; its size is trees times twice the sample, whatever the data."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
            f, thr, left, right, n = (t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "n"))
            depth, value = np.zeros(len(t)), np.zeros(len(t))
            for i in range(len(t)):
                if f[i] >= 0:
                    depth[left[i]] = depth[right[i]] = depth[i] + 1
            for i in range(len(t) - 1, -1, -1):  # expected path length below and including each node
                value[i] = depth[i] + expected_depth(n[i]) if f[i] < 0 else (n[left[i]] * value[left[i]] + n[right[i]] * value[right[i]]) / n[i]
            self.trees.append((f, thr, left, right, value, int(n[0])))
        self.norm = float(np.mean([expected_depth(t[5]) for t in self.trees])) if self.trees else 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The anomaly score of each row (-2^(-depth/c))."""
        total = np.zeros(len(x))
        for f, thr, left, right, value, _ in self.trees:
            at = np.zeros(len(x), int)
            live = np.flatnonzero(f[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = np.where(x[live, f[node]] <= thr[node], left[node], right[node])
                live = live[f[at[live]] >= 0]
            total += value[at]
        return -np.exp2(-(total / max(1, len(self.trees))) / self.norm)

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean path length of each row, the mean expected one, and each feature's share of the difference."""
        total, expected, parts = np.zeros(len(x)), 0.0, np.zeros_like(x, dtype=float)
        for f, thr, left, right, value, _ in self.trees:
            at = np.zeros(len(x), int)
            live = f[at] >= 0
            while live.any():
                i = np.flatnonzero(live)
                node = at[i]
                nxt = np.where(x[i, f[node]] <= thr[node], left[node], right[node])
                np.add.at(parts, (i, f[node]), value[node] - value[nxt])
                at[i] = nxt
                live = f[at] >= 0
            total += value[at]
            expected += value[0]
        k = max(1, len(self.trees))
        return total / k, np.full(len(x), expected / k), parts / k


def forest_score(vectors: DataFrame, nodes: DataFrame, features: str = "features", key: str = "id") -> DataFrame:
    """key, depth, expected depth, anomaly score (-2^(-depth/c)) and each feature's attribution.

    Attributions sum to the expected depth less the depth.
    """
    forest = vectors.sparkSession.sparkContext.broadcast(Forest(nodes.toPandas()))  # trees are of bounded size
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.stack(b[features].to_list()).astype(float) if len(b) else np.zeros((0, 1))
            depth, expected, parts = forest.value.walk(x)
            yield pd.DataFrame({key: b[key], "depth": depth, "expected_depth": expected, "score": -np.exp2(-depth / forest.value.norm), "attribution": pd.Series(list(parts), dtype=object)})

    return vectors.select(key, features).mapInPandas(run, f"{key} {kind}, depth double, expected_depth double, score double, attribution array<double>")


def forest_scores(vectors: DataFrame, forest: Forest, features: list[str]) -> DataFrame:
    """vectors with the anomaly score of each of those columns in its place, without attributions; vectors of a task's batch that are equal are walked through once."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def scores(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.float64())
        x, which = np.unique(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), axis=0, return_inverse=True)
        return pa.array(shared.value.scores(x)[which.ravel()])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([scores(c) if n in features else c for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    rows = vectors.withColumns({f: F.col(f).cast("array<double>") for f in features})
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in features else f for f in rows.schema.fields]))


#: Fewer distinct vectors support no split and no threshold.
LEAST_VECTORS = 20


def train_forest(vectors: DataFrame, features: str = "features", trees: int = 100, sample: int = 256, contamination: float = 0.05, budget: float = 5.0, rate: float = 1000.0, seed: int = 42) -> tuple[DataFrame, dict]:
    """Nodes of a forest, and what goes with it: n_train, n_calibrate, offset, threshold.

    Equal vectors count once. Seven in ten (by hash) are learnt from; the offset is the score that a share (contamination) of them falls below, and the threshold the decision (score less offset) that so many
    of a day's benign rows, as the others show them, fall below.
    """
    distinct = vectors.select(F.col(features).cast("array<double>").alias("features")).distinct().withColumn("id", F.xxhash64("features"))
    parts = split(distinct, "id").persist()  # counted, drawn from and scored
    try:
        train, rest = (parts.where(F.col("part") == part).select("id", "features") for part in ("train", "calibrate"))
        n_train, n_rest = train.count(), rest.count()
        if n_train + n_rest < LEAST_VECTORS:
            raise ValueError(f"only {n_train + n_rest} distinct vectors, {LEAST_VECTORS} are needed")
        nodes = forest_fit(train, trees=trees, sample=sample, seed=seed).toPandas()  # of bounded size; grown once
        forest = Forest(nodes)
        (offset,), _ = exact_quantiles(forest_scores(train.select("features"), forest, ["features"]), "features", [contamination])
        (low,), _ = exact_quantiles(forest_scores(rest.select("features"), forest, ["features"]), "features", [budget / rate])
    finally:
        parts.unpersist()
    return vectors.sparkSession.createDataFrame(nodes, TREE), {"n_train": n_train, "n_calibrate": n_rest, "offset": offset, "threshold": low - offset}


def decide(scored: DataFrame, offset: float, threshold: float) -> DataFrame:
    """Scores with decision (score less offset: negative for outliers) and anomalous (at or below the threshold)."""
    return scored.withColumn("decision", F.col("score") - offset).withColumn("anomalous", F.col("decision") <= threshold)


def mutate(rows: DataFrame, cmd: str = "cmdline", key: str = "id", intensities: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Each row under each mutator and intensity: path substitution, argument reorder, fake parent, lineage removed.

    What is chosen follows from a hash of the row, the mutator and the intensity.
    """
    parts = F.split(cmd, " ")
    h = lambda m: F.xxhash64(F.col(key).cast("string"), F.lit(m), F.col("intensity"))
    turned = F.concat(F.slice(parts, 1, 1), F.transform(F.array_sort(F.transform(F.slice(parts, 2, F.size(parts)), lambda x, i: F.struct(F.xxhash64(x, i, h("reorder")).alias("h"), x.alias("x")))), lambda s: s["x"]))
    made = F.array(
        F.struct(F.lit("path").alias("mutator"), F.regexp_replace(cmd, r"(/usr)?/s?bin/", "/opt/x/").alias("new_cmdline"), F.col("parent_comm").alias("new_parent")),
        F.struct(F.lit("reorder").alias("mutator"), F.array_join(turned, " ").alias("new_cmdline"), F.col("parent_comm").alias("new_parent")),
        F.struct(F.lit("fake_parent").alias("mutator"), F.col(cmd).alias("new_cmdline"), F.get(F.array(F.lit("explorer.exe"), F.lit("systemd"), F.lit("launchd")), F.pmod(h("parent"), F.lit(3)).cast("int")).alias("new_parent")),
        F.struct(F.lit("no_lineage").alias("mutator"), F.col(cmd).alias("new_cmdline"), F.lit(None).cast("string").alias("new_parent")),
    )
    return rows.withColumn("intensity", F.explode(F.array(*map(F.lit, intensities)))).select("*", F.inline(made))


def robustness(scored: DataFrame, threshold: float) -> DataFrame:
    """By mutator and intensity: detections that escape, and how scores move. scored: mutator, intensity, before, after and, where a row stands for several, n."""
    keys = ["mutator", "intensity"]
    rows = (scored if "n" in scored.columns else scored.withColumn("n", F.lit(1))).withColumn("delta", F.col("after") - F.col("before"))
    detected = F.col("before") <= threshold
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    sums = rows.groupBy(*keys).agg(count(detected).alias("detected"), count(detected & (F.col("after") > threshold)).alias("escaped"), F.max("delta").alias("max_delta"))
    rate = F.when(F.col("detected") > 0, F.col("escaped") / F.col("detected")).otherwise(0.0)
    return sums.join(group_quantile(rows, keys, "delta", 0.5, "n", "median_delta"), keys).select(*keys, "detected", "escaped", "median_delta", "max_delta", rate.alias("escape_rate"))


def floor_check(site: DataFrame, overall: DataFrame, rate: float = 0.05, delta: float = 0.10) -> DataFrame:
    """Whether a site's model is not much worse than the global one, by mutator and intensity."""
    g = overall.select("mutator", "intensity", F.col("escape_rate").alias("g_rate"), F.col("median_delta").alias("g_delta"))
    return site.join(g, ["mutator", "intensity"]).withColumn("passed", (F.col("escape_rate") <= F.col("g_rate") + rate) & (F.col("median_delta") <= F.col("g_delta") + delta))
