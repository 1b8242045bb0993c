"""Order-preserving packing by dynamic programming.

The tokens of a partition's documents form one stream, in row order, each document closed by an end id. Window cuts may
lie at the ends of documents (free), at the ends of sentences (a small penalty) and, where neither comes for a while, inside
a sentence (a larger one). The cuts minimise padding plus penalties:

    f(j) = penalty(j) + min over i, p(j) - p(i) <= W, of f(i) + W - (p(j) - p(i))

The minimum of f(i) + p(i) over the sliding window comes from a monotone queue, so each candidate is handled once. A window
whose length is a power of two needs no padding; those transitions are looked up beside the queue.

The stream is solved block by block; the last window of a block goes on into the next, so memory is bounded by the block and the
longest document. Sequence ids hold the partition's number above 40 bits; a task that is run again gives the same rows.

Defined results: a null text is an empty one, its document is the end id alone; the name of a special token within a text is that token's id; repeated rows are packed one by one (their
pieces share the id); among equal costs the later cut wins; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table

WINDOW = 1024
END = 0
SENTENCE, INSIDE = 2.0, 24.0
#: Without an end of a sentence for so many tokens, cuts inside are candidates, so many tokens apart.
STRIDE = 64
BLOCK = 1 << 18
CACHE = 400_000
OUT = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Tokenizer:
    """Ids of whole texts; chunks between single spaces are encoded once, and kept in a bounded table.

    The ids are those of the tokenizers library for the file, without special tokens added. They are computed from the file's own
    table of merges, as ranks (several times faster); names of special tokens that occur in a text become their ids, as in that library.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in form["model"]["vocab"].items() if all(c in letters for c in token)}
        special = {x["content"]: x["id"] for x in form["added_tokens"]}
        for token in special:
            ranks.pop(token.encode(), None)
        names = {i: t for t, i in ranks.items()}
        self.ends = np.array([names.get(i, b"").rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") for i in range(max([*names, *special.values()]) + 1)])
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).search if special else lambda t: None
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain, self.ordinary = functools.partial(own.encode, allowed_special="all"), own.encode_ordinary
        self.wide = regex.compile(r"\s\s").search
        self.chunks: dict[str, bytes] = {}

    def chunk(self, c: str) -> bytes:
        ids = array("I", self.ordinary(c)).tobytes()
        if len(c) <= 64:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[c] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text or self.wide(text) or text[-1].isspace() or text[0] == " " or self.special(text):
            return np.array(self.plain(text), "<u4") if text else np.zeros(0, "<u4")
        first, *rest = text.split(" ")
        seen, make = self.chunks.get, self.chunk
        return np.frombuffer(b"".join([seen(first) or make(first), *[seen(c) or make(c) for c in [" " + x for x in rest]]]), "<u4")


def cuts(ends: np.ndarray, sentences: np.ndarray, total: int, window: int = WINDOW) -> list[int]:
    """Positions of the best cuts of a stream of so many tokens (0 and the total included).

    ends: positions after documents; sentences: positions after sentences.
    """
    p = np.unique(np.concatenate([[0], ends, sentences, [total]])).astype(np.int64)
    gaps = np.diff(p)
    if (wide := np.flatnonzero(gaps > STRIDE)).size:
        p = np.unique(np.concatenate([p, *(np.arange(p[i] + STRIDE, p[i + 1], STRIDE) for i in wide)]))
    penalty = np.full(len(p), INSIDE)
    penalty[np.searchsorted(p, sentences)] = SENTENCE
    penalty[np.searchsorted(p, ends)] = 0
    penalty[0] = penalty[-1] = 0
    exact: dict[int, list[int]] = {}
    for k in range(window.bit_length() - 1):
        want = p - (1 << k)
        i = np.searchsorted(p, want)
        for j in np.flatnonzero(p[np.minimum(i, len(p) - 1)] == want).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    place, price = p.tolist(), penalty.tolist()
    f, back, queue = [0.0], [-1], deque([(0.0, 0)])  # the queue: f(i) + p(i), i; rising in both
    for j in range(1, len(place)):
        at = place[j]
        while at - place[queue[0][1]] > window:
            queue.popleft()
        best, i = queue[0]
        best += window - at
        for e in exact.get(j, ()):
            if f[e] < best:
                best, i = f[e], e
        best += price[j]
        f.append(best)
        back.append(i)
        key = best + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(place) - 1
    while j >= 0:
        out.append(place[j])
        j = back[j]
    return out[::-1]


class Stream:
    """Documents in, rows of pieces out."""

    def __init__(self, ends: np.ndarray, first_id: int, window: int):
        self.table, self.next, self.window = ends, first_id, window
        self.held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, tokens before, tokens of the document, tokens
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(END)).astype("<u4")
        self.held.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Rows of the windows that are settled; unless it is the last block, the final window stays."""
        if not self.held:
            return []
        stream = np.concatenate([x[3] for x in self.held])
        ends = np.cumsum([len(x[3]) for x in self.held])
        at = cuts(ends, np.flatnonzero(self.table[stream]) + 1, len(stream), self.window)
        stop = at[-1] if last or len(at) < 3 else at[-2]
        rows, k, done = [], 0, 0  # k: document, done: tokens of it that are out
        for lo, hi in zip(at, at[1:], strict=False):
            if hi > stop:
                break
            offset = 0
            while offset < hi - lo:
                doc_id, before, of, ids = self.held[k]
                n = min(len(ids) - done, hi - lo - offset)
                rows.append((doc_id, before + done, n, zlib.crc32(ids[done : done + n].tobytes()), of, self.next, offset))
                offset, done = offset + n, done + n
                if done == len(ids):
                    k, done = k + 1, 0
            self.next += 1
        rest = self.held[k:]
        if rest and done:
            doc_id, before, of, ids = rest[0]
            rest[0] = (doc_id, before + done, of, ids[done:])
        self.held, self.size = rest, sum(len(x[3]) for x in rest)
        return rows


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row per piece of a document in a sequence."""
    schema = OUT.format(docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        tok, kind = tokenizer(path), None
        out = Stream(tok.ends, TaskContext.get().partitionId() << 40, window)

        def rows(last: bool):
            columns = list(zip(*out.pack(last), strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                out.add(doc_id, tok.encode(text.as_py() or ""))
                if out.size >= BLOCK:
                    yield from rows(False)
        yield from rows(True)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
