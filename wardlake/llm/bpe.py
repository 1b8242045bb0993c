"""Byte-level BPE encoding and decoding by DuckDB queries in each task.

A text falls into chunks at single spaces; each chunk's words (the matches of the tokenizer's pattern) are encoded once
a task. Encoding is a recursive query: rows of (word, position, token) join the merge table, every word contracts
its leftmost pair of least rank, and words without a mergeable pair leave with their tokens in order. Decoding joins the
ids of whole texts to the vocabulary and aggregates their bytes in order.

Words of more than ``LONG`` bytes (texts without blanks) are first cut where no token of the vocabulary could lie across: every merge makes a token
of the vocabulary, so none crosses such a place and both sides are independent. What is still long contracts all pairs of its least
rank at once, from the left, as far as that is the same as one after another: until the first new token that makes a pair of lower rank with its
neighbour. Where none does, the rounds are bounded by the vocabulary, not by the word's length.

The chunk table of a task is bounded (``CACHE`` chunks; it is emptied when full), rows are taken in blocks of bounded
size, and the ranks are a file of fixed size that each worker reads once.

Defined results: a null text is an empty one and has no tokens; a very long text is a block of its own; repeated rows are encoded one by one; equal ranks are
contracted from the left; an empty table gives no rows; only the named columns are read; lone surrogates can't occur in
Spark strings.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

CACHE = 1_200_000
BLOCK_CHARS = 4_000_000
#: A step unrolls the unfinished words to a row per token position, joins the merge table, and contracts in every word
#: the leftmost pair of least rank; `best` holds the rank above 32 bits of position. A word keeps its latest row only.
MERGE = """
WITH RECURSIVE step(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM fresh
  UNION
  SELECT word, toks[1:(best & 4294967295) - 1] || [(best >> 32)::INTEGER] || toks[(best & 4294967295) + 2:]
  FROM (
    SELECT p.word, min((m.made::BIGINT << 32) + p.pos) AS best
    FROM (SELECT word, unnest(toks[:len(toks) - 1]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS pos FROM step WHERE len(toks) > 1) p
    JOIN merges m USING (a, b)
    GROUP BY p.word
  ) JOIN step USING (word)
)
SELECT word, toks FROM step ORDER BY word
"""
#: The same for long words, with all pairs of the least rank: from the left, every other one in a run of pairs that overlap (h, c), up to the
#: first one beside which a pair of lower rank comes up (n, s); there the next round goes on.
MERGE_LONG = """
WITH RECURSIVE step(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM fresh
  UNION
  (WITH p AS (SELECT word, unnest(toks) AS a, unnest(toks[2:] || [NULL]) AS b, unnest(range(1, len(toks) + 1)) AS pos FROM step WHERE len(toks) > 1),
  r AS (SELECT p.word, p.pos, m.made FROM p JOIN merges m USING (a, b)),
  h AS (SELECT *, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS island FROM r JOIN (SELECT word, min(made) AS made FROM r GROUP BY word) USING (word, made)),
  c AS (SELECT word, pos, made FROM (SELECT *, row_number() OVER (PARTITION BY word, island ORDER BY pos) AS k FROM h) WHERE k % 2 = 1),
  n AS (SELECT c.word, c.pos, c.made, CASE WHEN l.pos IS NULL THEN x.a ELSE c.made END AS x, y.a AS y FROM c
    LEFT JOIN c l ON l.word = c.word AND l.pos = c.pos - 2 LEFT JOIN p x ON x.word = c.word AND x.pos = c.pos - 1 LEFT JOIN p y ON y.word = c.word AND y.pos = c.pos + 2),
  s AS (SELECT n.word, min(n.pos) AS stop FROM n LEFT JOIN merges u ON u.a = n.x AND u.b = n.made LEFT JOIN merges v ON v.a = n.made AND v.b = n.y WHERE least(u.made, v.made) < n.made GROUP BY n.word),
  d AS (SELECT c.* FROM c LEFT JOIN s USING (word) WHERE stop IS NULL OR pos <= stop),
  e AS (SELECT word, pos, made FROM d UNION ALL SELECT word, pos + 1, -1 FROM d)
  SELECT word, list(coalesce(e.made, p.a) ORDER BY pos) AS toks FROM p LEFT JOIN e USING (word, pos) WHERE e.made IS DISTINCT FROM -1 AND word IN (SELECT word FROM d) GROUP BY word)
)
SELECT word, toks FROM step ORDER BY word
"""
LONG = 64


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], dict[bytes, int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    names = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        names[rank] = token
    return names, ranks


@functools.cache
def database(path: str):
    """A DuckDB connection of this worker with the merge table and the vocabulary."""
    import duckdb

    names, ranks = vocabulary(path)
    a, b, made = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                a.append(left), b.append(right), made.append(rank)
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB"})
    # the token that a pair makes is its rank
    merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "made": pa.array(made, pa.int32())})
    db.register("merges_", merges)
    db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
    # a byte is written as the character of that number, so that any bytes are text
    db.register("vocab_", pa.table({"id": pa.array(range(len(names)), pa.int32()), "piece": [t.decode("latin-1") for t in names]}))
    db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_")
    return db


@functools.cache
def beginnings(path: str) -> frozenset[bytes]:
    """Every beginning of every token."""
    return frozenset(token[:n] for token in vocabulary(path)[1] for n in range(1, len(token) + 1))


def independent(word: bytes, path: str) -> list[bytes]:
    """The word, cut wherever no token of the vocabulary that occurs in it lies across."""
    begins, ranks = beginnings(path), vocabulary(path)[1]
    out, start, reach = [], 0, 0
    for i in range(len(word)):
        if i and reach <= i:
            out.append(word[start:i])
            start = i
        end, last = i + 1, i + 1
        while end <= len(word) and (piece := word[i:end]) in begins:
            if piece in ranks:
                last = end
            end += 1
        reach = max(reach, last)
    return [*out, word[start:]]


@functools.cache
def encoder_of(path: str, pattern: str) -> Encoder:
    """The worker's own encoder: tasks that run in it one after another share what it has seen."""
    return Encoder(path, pattern)


class Encoder:
    """Encodes texts; holds the ids of the chunks that it has seen."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.path, self.db, self.find = path, database(path), regex.compile(pattern).findall
        self.wide = regex.compile(r"\s\s").search
        self.ranks = vocabulary(path)[1]
        self.decimal = [str(i) for i in range(len(vocabulary(path)[0]))].__getitem__
        self.bytes = [self.ranks[bytes([i])] for i in range(256)]
        self.chunks: dict[str, bytes] = {}

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as little-endian 32-bit numbers; a word of the vocabulary is one token."""
        plain = {w: w.encode() for w in words}
        parts = {w: independent(x, self.path) for w, x in plain.items() if len(x) > LONG}
        ids = self.merged(sorted({*(x for w, x in plain.items() if w not in parts), *(x for p in parts.values() for x in p)}))
        return {w: b"".join([ids[x] for x in parts[w]]) if w in parts else ids[plain[w]] for w in words}

    def merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {w: r.to_bytes(4, "little") for w in words if (r := self.ranks.get(w)) is not None}
        rest = [w for w in words if w not in out]
        for form, some in ((MERGE, [w for w in rest if len(w) <= LONG]), (MERGE_LONG, [w for w in rest if len(w) > LONG])):
            if some:
                start = [[self.bytes[b] for b in w] for w in some]
                self.db.register("fresh", pa.table({"word": pa.array(range(len(some)), pa.int32()), "toks": pa.array(start, pa.list_(pa.int32()))}))
                done = self.db.sql(form).to_arrow_table().column("toks").combine_chunks()
                self.db.unregister("fresh")
                ends, flat = done.offsets.to_numpy(), done.values.to_numpy().astype("<u4")
                out |= {w: flat[ends[i] : ends[i + 1]].tobytes() for i, w in enumerate(some)}
        return out

    def split(self, text: str) -> list[str]:
        """Chunks that the pattern never crosses: at single spaces before a word, or the whole text."""
        if self.wide(text) or text[-1:].isspace():
            return [text]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.split(t) for t in texts]
        fresh = {c for p in parts for c in p} - self.chunks.keys()
        matched = {c: self.find(c) for c in fresh}
        ids = self.words(sorted({w for m in matched.values() for w in m}))
        if len(self.chunks) + len(fresh) > CACHE:
            self.chunks = {}
            again = {c for p in parts for c in p} - fresh
            if again:
                more = {c: self.find(c) for c in again}
                ids |= self.words(sorted({w for m in more.values() for w in m} - ids.keys()))
                matched |= more
        # whole texts that don't split are not worth keeping
        now = {c: b"".join(ids[w] for w in m) for c, m in matched.items()}
        long = {c: now.pop(c) for c in [c for c in now if len(c) > 64]}
        self.chunks |= now
        return [np.frombuffer(b"".join([long[c] if len(c) > 64 else self.chunks[c] for c in p]), "<u4") for p in parts]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        n = [len(x) for x in ids]
        if not sum(n):
            return [b""] * len(ids)
        flat = np.concatenate(ids).astype(np.int32)
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), n), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        rows = self.db.execute("SELECT doc, string_agg(piece, '' ORDER BY pos) FROM tokens JOIN vocab USING (id) GROUP BY doc").fetchall()
        self.db.unregister("tokens")
        out = [b""] * len(ids)
        for doc, text in rows:
            out[doc] = text.encode("latin-1")
        return out


def blocks(texts: list[str], most: int = BLOCK_CHARS):
    """Ranges of rows of bounded length (a longer text is a block of its own)."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """doc_id and ids with decoded text, or (digest) their counts and sha256 sums, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(path, pattern)
        for b in batches:
            texts, keys = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id")
            for lo, hi in blocks(texts):
                ids = encoder.encode(texts[lo:hi])
                back = encoder.decode(ids)
                key = keys.slice(lo, hi - lo)
                if digest:
                    sums = [hashlib.sha256(",".join(map(encoder.decimal, x.tolist())).encode()).hexdigest() for x in ids]
                    counts = pa.array([len(x) for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([key, counts, pa.array(sums, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([key, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
