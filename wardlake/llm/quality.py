"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger holds its measurements and one failure bit a rule. Policies are versioned
masks over those bits, so changing a policy, or asking what a rule costs (an ablation), reads the ledger only.

Defined results: a null or empty text has no words and fails ``base_short``; repeated rows are judged one by one; ties do not
arise (all rules are per document); an empty table gives an empty ledger; other columns are ignored unless named in
``keep``. Everything is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: name -> (bit, failure condition over the measurements)
RULES = {
    "base_short": (1, "n_words < 50"),
    "base_repeats": (2, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (4, "10 * n_symbols > 3 * n_words"),
    "dup_lines": (8, "10 * n_dup_lines > 4 * n_lines"),
    "short_words": (16, "2 * word_chars < 5 * n_words"),
    "long_words": (32, "word_chars > 15 * n_words"),
}
BASE = ("base_short", "base_repeats")
#: Versions of the policy: the rules that each applies.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "dup_lines"),
    "v2": (*BASE, "symbols", "dup_lines", "short_words", "long_words"),
}
POSITION_BITS = 30


def mask(rules) -> int:
    return sum(RULES[r][0] for r in rules)


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows sort by 34 bits of hash with the position in the low 30 bits, as plain longs; neighbours that share the
    hash are candidates, and only those few compare their words.
    """
    n = F.size(words)
    at = lambda i: F.get(words, i)
    keys = F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.shiftleft(F.xxhash64(w, at(i + 1), at(i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")),
        )
    )
    top = lambda k: F.shiftright(k, POSITION_BITS)

    def neighbours(sorted_array: Column, same) -> Column:
        return F.filter(
            sorted_array,
            lambda k, i: ((i > 0) & same(k, F.get(sorted_array, i - 1))) | F.coalesce(same(k, F.get(sorted_array, i + 1)), F.lit(False)),
        )

    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    candidates = let(keys, lambda s: F.transform(neighbours(s, lambda a, b: top(a) == top(b)), lambda k: k.bitwiseAND(low).cast("int")))
    checked = let(
        F.sort_array(F.transform(candidates, lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i")))),
        lambda s: F.sort_array(F.transform(neighbours(s, lambda a, b: a["g"] == b["g"]), lambda x: x["i"])),
    )
    covered = let(checked, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(n < 4, F.lit(0)).otherwise(covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``m``: the measurements that all rules share."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")

    def all_of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    return docs.withColumn("m", let(words, all_of))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, measurements and ``failures`` (a bit for each failed rule)."""
    m = measure(docs.select(key, text, *keep), text).select(
        key, *keep, *(F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")), F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.lines.n").alias("n_lines")
    )
    bits = sum((F.when(F.expr(test), F.lit(bit)).otherwise(F.lit(0)) for bit, test in RULES.values()), F.lit(0))
    return m.withColumn("failures", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    fails = lambda rules: F.col("failures").bitwiseAND(F.lit(mask(rules))) != 0
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE) & ~fails(POLICIES[version]))


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail the rule, and those that only this rule rejects."""
    parts = []
    for version, rules in POLICIES.items():
        for rule in rules:
            parts.append((version, rule, RULES[rule][0], mask(rules)))
    failed = F.col("failures")
    sums = [x for i, (_, _, bit, all_bits) in enumerate(parts) for x in (F.sum((failed.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f{i}"), F.sum((failed.bitwiseAND(F.lit(all_bits)) == bit).cast("long")).alias(f"o{i}"))]
    one = rows.agg(*sums)
    entries = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o{i}"), F.lit(0)).alias("n_only_this")) for i, (v, r, _, _) in enumerate(parts)))
    return one.select(F.inline(entries))


def filter_docs(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that the policy keeps, all columns as they were."""
    names = docs.columns
    fields = tuple(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))
    # names of the caller's columns may clash with the measurements, so they travel under numbers
    plain = docs.select(*fields)
    text = f"c{names.index('text')}"
    rows = apply_policy(ledger(plain, key=text, text=text, keep=tuple(f"c{i}" for i in range(len(names)) if f"c{i}" != text)), version)
    return rows.where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows by DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 4 * n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words) AS kept FROM b
"""
