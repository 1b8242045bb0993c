"""Secret scan: three fixed patterns, and two character Markov models for the rest.

The models give the log-likelihood of a token as a random string and as an ordinary identifier; a token whose
log-likelihood ratio per character is high is a span of kind ``random``. Their samples are labelled by the patterns:
values that a pattern caught are random strings, all other identifier-like words are ordinary. The sample is bounded
(``SAMPLE_DOCS``); the tables have one entry for each pair of character classes, a fixed size.

Positions come from marking: a pattern's matches are enclosed in a control character (texts are first freed of it,
without changing any length), the text is split there, and the lengths of the parts add up to starts and ends.

Defined results: a null or empty text has no spans; very long texts with any number of matches are scanned whole; repeated rows are scanned one by one; spans that tie in start are
listed in the order of their kinds; an empty table trains a flat model and returns no rows; columns beside the key and
the text are ignored, but ``redact`` returns them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

#: The patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: What the models look at: long words that mix letters and digits, or cases, are candidates.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9_]{6,}"
MARK = "\x01"
SAMPLE_DOCS = 20_000
#: Log-likelihood ratio per character from which a token counts as random.
THRESHOLD = 0.6
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
STEP = 256


def running(values: Column, combine, start: Column) -> Column:
    """For each value, what those before it combine to; in blocks, so that no array grows with every value of a very long one."""

    def over(v: Column) -> Column:
        grown = lambda items, of: F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), of(x)))))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda b: F.slice(v, b * STEP + 1, F.lit(STEP)))
        inside = F.transform(blocks, lambda block: grown(block, lambda x: x))

        def joined(parts: Column) -> Column:
            carried = F.slice(grown(parts, lambda part: F.element_at(part, -1)), F.lit(1), F.size(parts))
            return F.flatten(F.zip_with(parts, carried, lambda part, c: F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda x: combine(c, x))))

        return F.when(F.size(v) > 0, let(inside, joined)).otherwise(F.slice(v, 1, 0))

    return let(values, over)


def _spans(text: Column, pattern: str, kind: str, ok, can: Column | None = None) -> Column:
    """Array of (start, kind number, end, value) of the matches that ok() accepts; text has no MARK. can: whether there may be any."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def listed(p: Column) -> Column:
        starts = running(F.transform(p, lambda x: F.length(x)), lambda a, b: a + b, F.lit(0))

        def spans(at: Column) -> Column:
            every = F.transform(p, lambda x, i: F.struct(F.get(at, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("value")))
            return F.filter(every, lambda x, i: (i % 2 == 1) & ok(x["value"]))

        return F.when(F.size(p) > 1, let(starts, spans)).otherwise(none)

    found = let(parts, listed)
    return found if can is None else F.when(can, found).otherwise(none)


def _base(text: Column) -> dict[str, Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_VALUE
    return {
        "assign": _spans(text, ASSIGN, "assign", value, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))),
        # a run matches from its first possible start to its end, so asking for the length in the pattern is the same
        "access": _spans(text, rf"{ACCESS[:-1]}{{{MIN_ACCESS - 4},}}", "access", lambda m: F.lit(True), F.contains(text, F.lit("AKIA"))),
        "hex": _spans(text, rf"{HEX[:-1]}{{{MIN_HEX},}}", "hex", lambda m: F.lit(True)),
    }


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit("\x02"))


def _pairs(word: Column) -> Column:
    """Numbers of the character pairs of a word."""
    codes = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return let(codes, lambda k: F.transform(F.slice(k, 2, F.size(k)), lambda b, i: F.get(k, i) * SIZE + b))


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios (random over ordinary) by pair of characters."""
    n = docs.count()
    body = docs.select(F.col(text).alias("t"))
    if n > sample_docs:
        share = int(1_000_000 * sample_docs / n)
        body = body.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share)
    t = _clean(F.col("t"))
    base = _base(t)
    caught = F.concat(
        F.transform(base["assign"], lambda s: F.regexp_extract(s["value"], ASSIGN, 2)), F.transform(base["access"], lambda s: s["value"]), F.transform(base["hex"], lambda s: s["value"])
    )
    ordinary = F.array_distinct(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    labelled = body.select(F.explode(let(caught, lambda c: F.concat(F.transform(c, lambda v: F.struct(v.alias("v"), F.lit(1).alias("random"))), F.transform(F.array_except(ordinary, c), lambda v: F.struct(v.alias("v"), F.lit(0).alias("random")))))).alias("s"))
    # every distinct word counts once, so that frequent words do not make the model of identifiers
    counts = labelled.select("s.v", "s.random").distinct().select("random", F.explode(_pairs(F.col("v"))).alias("pair")).groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    random, other = [0.0] * SIZE * SIZE, [0.0] * SIZE * SIZE
    for row in counts.collect():  # at most SIZE * SIZE rows
        random[row["pair"]], other[row["pair"]] = float(row["r"]), float(row["o"])
    # what ordinary words never show leans on how rare its second character is in them
    single = [sum(other[b::SIZE]) for b in range(SIZE)]
    rare = [(x + 0.5) / (sum(single) + 0.5 * SIZE) for x in single]
    out = []
    for a in range(SIZE):
        at = slice(a * SIZE, (a + 1) * SIZE)
        sr, so = sum(random[at]), sum(other[at])
        for r, o, u in zip(random[at], other[at], rare, strict=True):
            # hex values dominate what patterns catch: half of the random model is a uniform one over the alphabet
            p = 0.5 / SIZE + 0.5 * (r + 1) / (sr + SIZE)
            out.append(math.log(p) - math.log((o + 4 * u) / (so + 4)))
    return out


def _ratio(token: Column, model: list[float]) -> Column:
    ratios = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")  # folded into a literal
    return let(_pairs(token), lambda p: F.aggregate(F.transform(p, lambda i: F.get(ratios, i)), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(p), F.lit(1)))


def with_spans(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD, out: str = "found") -> DataFrame:
    """docs with a struct column of the spans: assign, access, hex, random (arrays of (start, kind, end, value))."""
    t = _clean(F.col(text))
    mixed = lambda v: F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Za-z]"))
    base = _base(t)
    extra = _spans(t, TOKEN, "random", lambda v: mixed(v) & (_ratio(v, model) >= threshold))
    fields = F.struct(*(base[k].alias(k) for k in KINDS[:3]), extra.alias("random"))
    # a token that goes beyond what a pattern caught of it is a span of its own
    free = lambda s, x: ~F.exists(F.concat(s["assign"], s["access"], s["hex"]), lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    return docs.withColumn(out, let(fields, lambda s: F.struct(*(s[k].alias(k) for k in KINDS[:3]), F.filter(s["random"], lambda x: free(s, x)).alias("random"))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = with_spans(docs.select(key, text), model, text)
    base = F.concat("found.assign", "found.access", "found.hex")
    return rows.select(
        key,
        *(F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, F.col("found.random"))).alias("spans"),
    )


def redact(docs: DataFrame, model: list[float], text: str = "text", by: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced; other texts, and all other columns, stay as they were."""
    names = docs.columns
    rows = with_spans(docs, model, text, out="__found")
    every = F.array_sort(F.concat(*(F.col("__found")[k] for k in KINDS)))
    body = F.col(text)

    def pieces(spans: Column) -> Column:
        # spans that overlap make one hole: only what starts behind all ends so far opens another
        ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        cut = F.zip_with(spans, ends, lambda x, e: F.when(x["start"] >= e, F.array(F.substring(body, e + 1, x["start"] - e), F.lit(by))).otherwise(F.array().cast("array<string>")))
        rest = F.substring(body, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(body))
        return F.array_join(F.concat(F.flatten(cut), F.array(rest)), "")

    done = let(every, pieces)
    return rows.withColumn(text, F.when(F.size(every) > 0, done).otherwise(body)).select(*(F.col(f"`{c}`") for c in names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs))
