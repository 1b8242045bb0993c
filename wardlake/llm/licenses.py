"""License scan by diagonal voting.

All rolling word 2-grams of all documents are joined, by hash and then by the words themselves, to the places of a small
fixed set of templates. A match votes for the diagonal (word position minus template position); neighbouring diagonals
of one template merge into a span when they overlap or nearly touch. A span is verified by the words themselves (the join compares them), by how
many distinct template places it covers, and by its length: no more words than the template would have if the uncovered share were added. A short
phrase must be covered whole, on one diagonal.

The template table is a literal (its size does not depend on the documents), so it is broadcast; only the few matches are
shuffled, after partial aggregation on their diagonals.

Defined results: a null or empty text has no words, no places and empty label strings; repeated rows (same id, same
text) are scanned once and give a row each; very long texts are scanned whole, their votes counted a diagonal at a time; rows that share an id but not a text are scanned apart; a null id is a key like any other; an empty
table gives no rows; columns beside the key and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase -> label; a phrase counts only whole.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label -> opening words of well-known notices; a part of them is enough.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0"],
    "gpl-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
COVER = 0.8
SLACK = 3


def template_grams(spark: SparkSession) -> DataFrame:
    """(hash, a, b, tpl, tpos): every 2-gram of every template; tpl below len(PHRASES) are phrases."""
    texts = [*PHRASES, *(t for ts in TEMPLATES.values() for t in ts)]
    rows = [(i, p, w[p], w[p + 1]) for i, t in enumerate(texts) for w in [t.split()] for p in range(len(w) - 1)]
    places = F.array(*(F.struct(F.lit(i).alias("tpl"), F.lit(p).alias("tpos"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, p, a, b in rows))
    return spark.range(1).select(F.inline(places)).withColumn("hash", F.xxhash64("a", "b"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", cover: float = COVER, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """(documents: id, text_hash, n_words), (spans: id, text_hash, label, base, first, last, score)."""
    spark = docs.sparkSession
    texts = [*PHRASES, *(t for ts in TEMPLATES.values() for t in ts)]
    labels = [*PHRASES.values(), *(label for label, ts in TEMPLATES.items() for _ in ts)]
    # (phrase?, label, number of 2-grams) by template number; fixed size
    facts = F.array(*(F.struct(F.lit(i < len(PHRASES)).alias("base"), F.lit(labels[i]).alias("label"), F.lit(len(t.split()) - 1).alias("grams")) for i, t in enumerate(texts)))
    w = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        words_of(ascii_lower(F.col(text)), SEPARATORS).alias("w"),
    )
    heads = w.select("id", "text_hash", F.size("w").cast("long").alias("n_words"))
    grams = w.select(
        "id",
        "text_hash",
        F.posexplode(
            F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(F.col("w"), i + 1).alias("b")))
        ).alias("pos", "g"),
    )
    grams = grams.select("id", "text_hash", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.xxhash64("g.a", "g.b").alias("hash"))
    places = F.broadcast(template_grams(spark))
    hits = grams.join(places, ["hash", "a", "b"]).withColumn("diag", F.col("pos") - F.col("tpos"))
    # a place of a phrase or template and of one document votes once, however often the row is repeated
    votes = hits.groupBy("id", "text_hash", "tpl", "diag").agg(F.collect_set("tpos").alias("at")).withColumn("fact", F.element_at(facts, F.col("tpl") + 1))
    by = Window.partitionBy("id", "text_hash", "tpl").orderBy("diag")
    end = F.col("diag") + F.array_max("at") + 1
    start = F.col("diag") + F.array_min("at")
    votes = votes.withColumns({"start": start, "end": end, "reach": F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), "last_diag": F.lag("diag").over(by)})
    fresh = F.col("fact.base") | F.col("last_diag").isNull() | (F.col("diag") - F.col("last_diag") > slack) | (F.col("start") > F.col("reach") + slack)
    merged = (
        votes.withColumn("span", F.sum(fresh.cast("int")).over(by))
        .groupBy("id", "text_hash", "tpl", "span")
        .agg(F.first("fact").alias("fact"), F.min("start").alias("first"), F.max("end").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hit"))
    )
    need = F.when(F.col("fact.base"), F.col("fact.grams")).otherwise(F.ceil(F.col("fact.grams") * cover))
    fits = F.col("last") - F.col("first") <= F.ceil(F.col("fact.grams") / F.lit(cover)) + slack
    spans = merged.where((F.col("hit") >= need) & fits).select(
        "id", "text_hash", F.col("fact.label").alias("label"), F.col("fact.base").alias("base"), "first", "last", (F.col("hit") / F.col("fact.grams")).alias("score")
    )
    return heads, spans


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: counts and labels."""
    heads, spans = scan(docs, key, text)
    rows = heads.withColumn("span", F.lit(None).cast("struct<label:string,base:boolean,first:int,last:int,score:double>")).unionByName(
        spans.select("id", "text_hash", F.lit(None).cast("long").alias("n_words"), F.struct("label", "base", "first", "last", "score").alias("span"))
    )
    base = F.col("span.base")
    label = F.col("span.label")
    out = rows.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("span.first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("span.first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.coalesce(F.max("span.score"), F.lit(0.0)).alias("score"),
        F.count("n_words").alias("copies"),
    )
    results = [c for c in out.columns if c not in ("id", "text_hash", "copies")]
    return out.select(F.col("id").alias(key), *results, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Brute force: every template laid at every word of every text on every diagonal."""
    texts = [*PHRASES, *(t for ts in TEMPLATES.values() for t in ts)]
    labels = [*PHRASES.values(), *(label for label, ts in TEMPLATES.items() for _ in ts)]
    values = ", ".join(f"({i}, '{labels[i]}', {str(i < len(PHRASES)).lower()}, {p}, '{w[p]}', '{w[p + 1]}', {len(w) - 1})" for i, t in enumerate(texts) for w in [t.split()] for p in range(len(w) - 1))
    return rf"""
WITH t(tpl, label, base, tpos, a, b, grams) AS (VALUES {values}),
w AS (SELECT doc_id, hash(text) AS h, count(*) AS copies, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents GROUP BY doc_id, text),
g AS (SELECT doc_id, h, i AS pos, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT doc_id, h, w, unnest(range(0, len(w) - 1)) AS i FROM w)),
v AS (SELECT doc_id, h, tpl, label, base, grams, pos - tpos AS diag, list(DISTINCT tpos) AS ats, min(pos) AS s, max(pos) + 1 AS e FROM g JOIN t USING (a, b) GROUP BY ALL),
o AS (SELECT *, lag(diag) OVER q AS ld, max(e) OVER (PARTITION BY doc_id, h, tpl ORDER BY diag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WINDOW q AS (PARTITION BY doc_id, h, tpl ORDER BY diag)),
n AS (SELECT *, sum(CASE WHEN base OR ld IS NULL OR diag - ld > {SLACK} OR s > reach + {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, h, tpl ORDER BY diag) AS span FROM o),
m AS (SELECT doc_id, h, tpl, label, base, grams, span, min(s) AS s, max(e) - min(s) AS length, len(list_distinct(flatten(list(ats)))) AS hit FROM n GROUP BY ALL),
k AS (SELECT * FROM m WHERE hit >= CASE WHEN base THEN grams ELSE ceil(grams * {COVER}::DOUBLE) END AND length <= ceil(grams / {COVER}::DOUBLE) + {SLACK}),
z AS (SELECT w.doc_id, any_value(len(w)) AS n_words, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(hit / grams), 0.0) AS score,
  unnest(range(any_value(copies))) AS copy
FROM w LEFT JOIN k ON w.doc_id IS NOT DISTINCT FROM k.doc_id AND w.h IS NOT DISTINCT FROM k.h GROUP BY w.doc_id, w.h)
SELECT * EXCLUDE (copy) FROM z
"""


SQL = _sql()
