"""Groups of spelling variants: words one edit apart, found by walking a trie held as a table of edges.

Words are counted over all texts. A node of the trie is a prefix, named by a hash that goes on from its parent's; the table has a row for each node with the letters that
go out of it. A state is (word, position, node, edits). States without an edit are the word's own prefixes, so they are listed; those with one make up the frontier, which
is joined to the edges level by level: the next letter of the word must go out of the node. A state without an edit branches into another letter (a replacement)
or skips the word's own (a deletion; the insertions are the deletions of the longer word). States that reach the word's end are one-edit states; where their node ends a
word, the two words are near, which is checked on the words themselves.

There are two tries, of the words and of the words reversed. An edit in the second half of a word is sought in the first, one in the first half in the second. So states branch
only below half a word, where few letters go out of a node, and no level has a node that all states share. Of two letters only the smaller is replaced: the pair is found once.
Words of more than ``LONG`` code points have paths of two edges, a half and the rest, and the edit lies in the latter.

Frontiers are written to the shared folder level by level; nothing but numbers of levels comes to the driver, and nothing is broadcast on purpose.

Defined results: null and empty texts have no words; a null id counts as an empty text in the hash that decides on a deletion; repeated rows count as often as they occur;
equal counts go to the word that is first in code-point order; no words give no rows; only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, table

LONG = 32
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, drop: int | None = None, least_chars: int = 6, least: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of the lower-cased runs of letters with enough code points and occurrences.

    drop: where it divides the checksum of a run and its document, the run loses one code point, at the checksum modulo its length.
    """
    # a shorter run can't give a longer word
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run")).select("d", ascii_lower(F.col("run")).alias("run"))
    if drop:
        h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
        at = F.pmod(h, F.length("run")).cast("int")
        rows = rows.select(F.when(F.pmod(h, F.lit(drop)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run")).alias("run"))
        rows = rows.where(F.length("run") >= least_chars)
    return rows.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter(key: Column, at: Column) -> Column:
    """The letter of a key at a position from 0; an empty text beyond its end."""
    return F.substring(key, at + 1, F.lit(1))


def paths(words: DataFrame) -> DataFrame:
    """key, size, reversed, and path: the hashes of the key's prefixes, of 0 letters and more, for both tries."""
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("word").alias("key")), F.struct(F.lit(True).alias("reversed"), F.reverse("word").alias("key")))).alias("x")).select("x.*")
    sized = both.withColumn("size", F.length("key"))
    letters = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: letter(F.col("key"), i))
    path = F.aggregate(letters, F.array(F.xxhash64("reversed")), lambda done, c: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), c))))
    return sized.withColumn("path", path)


def half(size: Column, reverse: Column) -> Column:
    """The first position at which a trie looks for an edit in a key of that size."""
    return F.when(reverse, F.ceil(size / 2)).otherwise(F.floor(size / 2)).cast("int")


def near_short(space: Workspace, words: DataFrame) -> DataFrame:
    """Pairs a, b of words one edit apart, of at most LONG code points."""
    tries = space.keep(paths(words))
    last = tries.agg(F.max("size"), F.min("size")).first()
    none = words.select(F.col("word").alias("a"), F.col("word").alias("b")).where("false")
    if last[0] is None:
        return none
    below = F.explode(F.sequence(F.greatest(F.floor((F.col("size") - 1) / 2).cast("int"), F.lit(0)), F.col("size") - 1)).alias("depth")
    out = tries.select("key", "path", below).select("depth", F.element_at("path", F.col("depth") + 1).alias("node"), letter(F.col("key"), F.col("depth")).alias("c"))
    edges = out.groupBy("depth", "node").agg(F.sort_array(F.collect_set("c")).alias("out"))
    edges = space.keep_by(edges.repartition("depth", "node"), "depth")
    own = tries.select("key", "size", "path", F.explode(F.sequence(half(F.col("size"), F.col("reversed")), F.col("size") - 1)).alias("depth"))
    own = space.keep_by(own.select("key", "size", "depth", F.element_at("path", F.col("depth") + 1).alias("node")).repartition("depth", "node"), "depth")

    frontier, finished = None, []
    for depth in range(last[1] // 2, last[0]):
        level = F.col("depth") == depth
        mine = own.where(level)
        finished.append(mine.where(F.col("size") == depth + 1).select("key", "node"))  # the last letter is deleted
        states = mine.select("key", "size", F.lit(depth).alias("at"), "node", F.lit(0).alias("edits"))
        if frontier is not None:
            finished.append(frontier.where("at = size").select("key", "node"))
            states = states.unionByName(frontier.where("at < size").withColumn("edits", F.lit(1)))
        here, after = letter(F.col("key"), F.col("at")), letter(F.col("key"), F.col("at") + 1)
        step = lambda c, by: F.struct((F.col("at") + by).alias("at"), F.xxhash64("node", c).alias("node"))
        goes = lambda c: F.array_contains("out", c)
        nothing = F.array().cast("array<struct<at:int,node:bigint>>")
        # of equal letters in a row the last is deleted
        deleted = F.when((after != "") & (after != here) & goes(after), F.array(step(after, 2))).otherwise(nothing)
        replaced = F.transform(F.filter("out", lambda c: c > here), lambda c: step(c, 1))
        matched = F.when(goes(here), F.array(step(here, 1))).otherwise(nothing)
        met = states.join(edges.where(level).select("node", "out"), "node")
        found = met.select("key", "size", F.explode(F.when(F.col("edits") == 0, F.concat(replaced, deleted)).otherwise(matched)).alias("x"))
        frontier = space.keep(found.select("key", "size", "x.at", "x.node"))
    finished.append(frontier.where("at = size").select("key", "node"))

    ends = tries.select(F.element_at("path", -1).alias("node"), "reversed", F.when(F.col("reversed"), F.reverse("key")).otherwise(F.col("key")).alias("b"))
    pairs = reduce(DataFrame.unionByName, finished).join(ends, "node")
    return pairs.select(F.when(F.col("reversed"), F.reverse("key")).otherwise(F.col("key")).alias("a"), "b").where(F.levenshtein("a", "b", 1) == 1)


def near_long(words: DataFrame) -> DataFrame:
    """Pairs a, b of words one edit apart, where the longer has more than LONG code points."""
    sized = words.select("word", F.length("word").alias("size"))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("word").alias("key")), F.struct(F.lit(True).alias("reversed"), F.reverse("word").alias("key")))).alias("x")
    keyed = lambda rows: rows.select("word", "longer", sides).select("word", "longer", "x.reversed", F.xxhash64(F.left("x.key", half(F.col("longer"), F.col("x.reversed")))).alias("node"))
    a = keyed(sized.where(F.col("size") > LONG).withColumn("longer", F.col("size"))).withColumnRenamed("word", "a")
    b = keyed(sized.where(F.col("size") >= LONG).withColumn("longer", F.explode(F.array("size", F.col("size") + 1)))).withColumnRenamed("word", "b")
    return a.join(b, ["longer", "reversed", "node"]).select("a", "b").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))


def roots(space: Workspace, links: DataFrame) -> DataFrame:
    """word and root: the end of each chain of links (word to form), by doubling; counts rise along a chain, so there is no ring."""
    now = space.keep(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = space.keep(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for rows of word (distinct) and n.

    form: the near word with the greatest n, if that is at least ratio times the word's own.
    """
    space = Workspace(words.sparkSession)
    words = space.keep(words.select("word", "n"))
    found = near_short(space, words.where(F.length("word") <= LONG)).unionByName(near_long(words))
    pairs = space.keep(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("most"))
    rows = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    good = -F.col("most.less") >= ratio * F.col("n")
    rows = space.keep(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("most.b")).alias("form"), F.when(good, -F.col("most.less")).alias("form_n")))
    ends = roots(space, rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), drop=199))


#: One ASCII character for each letter from À to ÿ, as the distance below is one of bytes.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[: len(_WIDE)]
#: Checksums byte by byte, all pairs of words by edit distance, chains by recursion.
SQL = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM runs, tab WHERE length(run) >= 6),
made AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, count(*) AS n, length(word) AS l, translate(word, '{_WIDE}', '{_NARROW}') AS s FROM made WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
p AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM w a JOIN w b ON a.l - b.l BETWEEN -1 AND 1 AND a.word != b.word AND (a.word[1:3] = b.word[1:3] OR a.word[-3:] = b.word[-3:]) AND levenshtein(a.s, b.s) = 1),
f AS MATERIALIZED (SELECT word, count(*) AS n_near, min_by(other, (-m, other)) AS best, max(m) AS m FROM p GROUP BY word),
r AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at, form AS next FROM r UNION ALL SELECT c.word, r.word, r.form FROM c JOIN r ON r.word = c.next)
SELECT word, form, c.at AS root, n, n_near, form_n FROM r JOIN c USING (word) WHERE c.next IS NULL
"""
