"""Language-model scoring by logistic context mixing.

Tokens are words and one end a text. A token is coded in bits along a Huffman tree of the frequent tokens; others are escapes.
Each bit is predicted from three contexts: the place in the tree, that place with a hash of the previous token, and with a hash of
the last very common token. The predictions are mixed in the logistic domain with weights that a gate chooses by how much each
context has seen; a last table refines the result by confidence. Counts, weights and the table are learnt online over every
training text: a task predicts each piece of its texts from what it has seen before, corrects its weights and then counts the piece.
Counts and cells of the table are summed over the tasks, weights averaged by the bits behind them. Scoring itself changes nothing,
so a text's score does not depend on its neighbours or on the partitions.

After an escape, a word of the training texts costs its share of all rare words, by its own count (distributed, joined); what rare
words there are stands for the unknown ones (Witten-Bell), which are then spelled by the bits of their bytes. Those are mixed in the
same way, from up to ORDERS bytes before, learnt from each distinct training word once, at every size of the corpus.

Before a token with two predecessors in its text, one more bit says whether the most frequent successor of that context
follows; the counts are of every context of two tokens of every training text under a 64-bit key, lie in buckets of contexts whose number grows with the corpus, and are never shipped whole (rare words are not foreseen).
Texts go as blocks of token numbers; a block asks each bucket for its distinct pairs of context and successor, once each, and gets a byte a pair back. A training text meets only what has been seen at least twice, itself included. How far to trust
the counts is learnt from how often they were right when each training occurrence was left out.

Sizes: words seen once are rare; at most 2**TOP_BITS tokens are frequent (they hold at least that share of all tokens, so the bound is
proven). Bits are counted in 2**SLOT_BITS slots for each hashed context and 2**BYTE_BITS for the bytes, whatever the corpus: more contexts
share slots as it grows. These tables are shipped to the tasks, with the counts of the 2**LISTED_BITS most frequent words, which saves
their lookup; all other counts of words, and successors, stay distributed and are joined.

Defined results: a null or empty text is one end; repeated rows are scored one by one (and counted each time in training), also where
rows share an id but not a text; very long texts are taken whole, as blocks of their own; equal counts are ordered by hash; an empty table gives
no rows; without training texts every token is an escape; a null id counts as an empty text in the split; only the named columns are read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, table
from .shingles import MANY, mix

HELD_OUT = (5, 1)
TOP_BITS, SLOT_BITS = 17, 19
#: Words whose counts are shipped; size classes of counts.
LISTED_BITS, STEPS_A_DOUBLING = 20, 64
COMMON = 64
BLOCK, BLOCK_BYTES = 8_000, 8_000_000
ESCAPE, END = 0, 1  # numbers of the two tokens that every model has
#: Contexts of a byte: one to five bytes before it; slots of their bits.
ORDERS, BYTE_BITS = 5, 21
GATES = 6
#: Mixed logits lie within REACH; REFINE cells of half a unit; the final table has FINE steps a unit.
REACH, REFINE, FINE = 15, 61, 64
#: Bits that are learnt at a time: from the least to the most, a quarter of what came before in between.
LEAST, MOST = 256, 8_192
#: Units of a weight where it is summed; slots in a row of what is summed.
UNIT, ROW = 1 << 10, 1024
LOW = 2**32 - 1
#: Line feeds close words with a zero byte; zero bytes within words become 255, which UTF-8 doesn't use.
CLOSED = bytes.maketrans(b"\0\n", b"\xff\0")
#: Successor counts are told apart up to SURE.
SURE = 4
#: Tokens a bucket of successors, on average.
BUCKET = 1 << 21


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, node, bit): token t's code is bit[start[t]:start[t+1]], met at those inner nodes."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up = np.zeros(2 * n - 1, np.int64)
    side = np.zeros(2 * n - 1, np.int8)
    for made in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = made
        side[j] = 1
        heapq.heappush(heap, (a + b, made))
    depth = np.zeros(2 * n - 1, np.int64)
    for x in range(2 * n - 3, -1, -1):
        depth[x] = depth[up[x]] + 1
    start = np.concatenate([[0], np.cumsum(depth[:n])])
    node, bit = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.int8)
    at, where = np.arange(n), start[1:] - 1
    while (live := at < 2 * n - 2).any():
        at, where = at[live], where[live]
        node[where], bit[where] = up[at] - n, side[at]
        at, where = up[at], where - 1
    return start, node, bit


class Vocabulary:
    """Frequent tokens, their tree, and what the base formula needs; small enough to ship.

    Numbers of tokens: ESCAPE (not listed), END, then the words of the tree, then the other listed ones, which are escapes to the tree.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int, total: int, distinct: int, texts: int):
        order = np.lexsort((hashes, counts < least))
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct, self.texts = total, distinct, texts
        self._numbers: TokenNumbers | None = None
        self.tree = int((counts >= least).sum())
        in_tree = self.counts[: self.tree]
        self.rare, self.rare_kinds = total - texts - int(in_tree.sum()), distinct - (texts > 0) - self.tree
        self.start, self.node, self.bit = huffman(np.concatenate([[max(1, self.rare), max(1, texts)], in_tree]))
        self.width = np.diff(self.start).astype(np.int32)
        self.start = self.start.astype(np.int32)
        self.node_slot = (mix(self.node.astype(np.uint64), 4) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        by_count = np.lexsort((self.hashes[: self.tree], -in_tree.astype(np.int64)))
        self.common = np.zeros(self.tree + 2, bool)
        self.common[by_count[:COMMON] + 2] = True
        # a slot is the exclusive or of a hash of the context and one of the node
        every = np.arange(self.tree + 2, dtype=np.uint64)
        self.by_previous, self.by_common = ((mix(every, salt) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) for salt in (1, 2))
        # by token number: base cost, and the cost after an escape as far as it is known
        self.mass = math.log10(max(1, self.rare + self.rare_kinds))
        self.low = np.concatenate([[self.log_base(0.0), self.log_base(float(texts))], self.log_base(self.counts.astype(np.float64))])
        self.own = np.concatenate([np.zeros(self.tree + 2), np.log10(self.counts[self.tree :]) - self.mass])

    def log_base(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def names(self) -> np.ndarray:
        """A 64-bit name of each number."""
        return np.concatenate([np.zeros(2, np.uint64), self.hashes])

    def numbers(self) -> TokenNumbers:
        """The worker's own table: tasks that run in it one after another share what it has seen."""
        if self._numbers is None:
            self._numbers = TokenNumbers(self.hashes, self.tree)
        return self._numbers

    def __getstate__(self):
        return self.__dict__ | {"_numbers": None}

    def before(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token before each, and the last common one; first: where texts begin."""
        prev = np.concatenate([[END], ids[:-1]])
        prev[first] = END
        mark = np.where(self.common[prev], np.arange(len(ids)), 0)
        mark[first] = first
        return prev, prev[np.maximum.accumulate(mark)]

    def events(self, ids: np.ndarray, prev: np.ndarray, common: np.ndarray):
        """Bits of tokens: (node, bit, slot by previous token, slot by last common token)."""
        n = len(ids)
        width = self.width[ids]
        begins = np.cumsum(width, dtype=np.int32) - width
        where = np.arange(begins[-1] + width[-1] if n else 0, dtype=np.int32)
        where += np.repeat(self.start[ids] - begins, width)
        nodes = self.node_slot[where]
        return self.node[where], self.bit[where], np.repeat(self.by_previous[prev], width) ^ nodes, np.repeat(self.by_common[common], width) ^ nodes


class TokenNumbers:
    """Token numbers of words by their hashes; unlisted ones are ESCAPE."""

    def __init__(self, hashes: np.ndarray, tree: int):
        self.tree = tree
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], (order + 2).astype(np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), ESCAPE, np.int32)
        at = np.minimum(self.sorted.searchsorted(hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], ESCAPE).astype(np.int32)

    def coded(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers as the tree knows them."""
        return np.where(numbers > self.tree + 1, ESCAPE, numbers)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ranges(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes sum to no more than most (a larger row is a range of its own)."""
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def tokens(texts: pa.Array):
    """(first row, last row, words of each text, the distinct words, which of them each word is) for blocks of bounded size."""
    texts = pc.fill_null(texts, "")
    for lo, hi in ranges(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK_BYTES):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
        flat = lists.flatten()
        some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at the ends of a text leave empty pieces
        ends = np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        named = flat.filter(pa.array(some)).dictionary_encode()
        yield lo, hi, np.diff(ends), named.dictionary.cast(pa.binary()).to_pylist(), named.indices.to_numpy(zero_copy_only=False)


def with_ends(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers with an end after each text, and where texts begin."""
    stops = np.cumsum(lengths)
    out = np.insert(ids, stops, END)
    return out, np.concatenate([[0], (stops + np.arange(1, len(lengths) + 1))[:-1]]).astype(np.int64)


def byte_bits(words: list[bytes]):
    """Pieces of (word index, bit, slots by order) for the bits of words' bytes and of the zero byte that closes each.

    Words hold no line feed, which therefore divides them, and no byte 255, which stands for their own zero bytes.
    """
    body = np.frombuffer((b"\n".join(words) + b"\n").translate(CLOSED), np.uint8).astype(np.uint64)
    close = body == 0
    word = np.cumsum(close) - close
    begin = np.concatenate([[0], np.flatnonzero(close)[:-1] + 1])
    inside = np.arange(len(body)) - begin[word]
    shift = np.arange(8, dtype=np.uint64)
    for lo in range(0, len(body), 2_048):
        part = slice(lo, lo + 2_048)
        own, at = body[part], np.arange(lo, min(lo + 2_048, len(body)))
        bit = ((own[:, None] >> (np.uint64(7) - shift)) & np.uint64(1)).astype(np.int8).ravel()
        place = (own[:, None] >> (np.uint64(8) - shift)) | (np.uint64(1) << shift)  # the bits before, led by a one
        slots, key = [], np.zeros(len(own), np.uint64)
        with np.errstate(over="ignore"):
            place = place * np.uint64(0xD6E8FEB86659FD93)
            for k in range(1, ORDERS + 1):
                key = (key + np.where(inside[part] >= k, body[at - k] + np.uint64(2), np.uint64(1))) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
                x = (place ^ (key + np.uint64(k))[:, None]) * np.uint64(0x9E3779B97F4A7C15)
                slots.append((((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BYTE_BITS)).astype(np.int32).ravel())
        yield np.repeat(word[part], 8), bit, slots


# ---- blocks of texts as numbers


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes: how many, then their first bytes, their second bytes and so on, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(body: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(body[:8], "little"), np.dtype(kind).itemsize
    flat = pa.decompress(body[8:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).ravel()


class Block:
    """Texts of one block: words and training or not by text, numbers of words, hashes of the unlisted ones (if asked for)."""

    def __init__(self, row: dict):
        self.lengths, self.held = unpacked(row["lengths"], "<i8"), unpacked(row["held"], "u1").astype(bool)
        self.number = unpacked(row["number"], "<i4")
        self.hashes = unpacked(row["hashes"], "<u8") if "hashes" in row else None


def numbered(rows: DataFrame, shared) -> DataFrame:
    """A row for each block of texts: texts are cut into words and looked up once, for learning, successors and scores.

    block: number of its first text; doc_id, n_bytes: by text; words: unlisted ones, null in training texts.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        numbers = shared.value.numbers()
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            held_out = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            for lo, hi, lengths, words, which in tokens(b.column("text")):
                hashes, held = hashed(words), held_out[lo:hi]
                number = numbers.of(hashes)[which]
                some = which[number == ESCAPE]
                spelt = np.repeat(held, lengths)[number == ESCAPE]
                named = [words[i] if s else None for i, s in zip(some.tolist(), spelt.tolist(), strict=True)]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = [pa.array([row]), pa.array([int(lengths.sum()) + hi - lo]), one(b.column("doc_id").slice(lo, hi - lo)), one(size.slice(lo, hi - lo)), *(pa.array([planes(x)], pa.binary()) for x in (lengths.astype("<i8"), held.view("u1"), number.astype("<i4"), hashes[some])), one(pa.array(named, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n_tokens", "doc_id", "n_bytes", "lengths", "held", "number", "hashes", "words"])
                row += hi - lo

    return rows.mapInArrow(run, f"block long, n_tokens long, doc_id array<{kind}>, n_bytes array<long>, lengths binary, held binary, number binary, hashes binary, words array<binary>")


# ---- counting


def count_tokens(train: DataFrame) -> DataFrame:
    """(h, word, c) over all training texts, ends not included."""

    def out(held: Counter):
        words = list(held)
        return pa.RecordBatch.from_arrays([_signed(hashed(words)), pa.array(words, pa.binary()), pa.array(list(held.values()), pa.int64())], ["h", "word", "c"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for _, _, _, words, which in tokens(b.column("text")):
                held.update(dict(zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True)))
                if len(held) > MANY:
                    yield out(held)
                    held.clear()
        yield out(held)

    return train.select("text").mapInArrow(run, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """The 2**LISTED_BITS most frequent words (fewer by those that share the size class of the count at the limit)."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    size = F.floor(F.log2("c") * STEPS_A_DOUBLING)
    classes = sorted(((r["size"], r["words"]) for r in counts.where("c > 1").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    lowest, held = math.inf, 0
    for at, words in classes:  # some 50 * STEPS_A_DOUBLING, whatever the corpus
        held += words
        if held > 1 << LISTED_BITS:
            break
        lowest = at
    top = counts.where((F.col("c") > 1) & (size >= F.lit(float(lowest)))).select("h", "c").toArrow()
    least = max(2, math.ceil(n / (1 << TOP_BITS)))  # so no more than 2**TOP_BITS words reach it
    return Vocabulary(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), least, n + texts, v + (texts > 0), texts)


# ---- mixing


#: Confidence by number of bits seen.
SEEN = 2_048
CONFIDENCE = np.minimum(np.log2(1 + np.arange(SEEN)) / 2, GATES - 1).astype(np.int8)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logit of pairs of counts."""
    x = n1.astype(np.float32)
    x += np.float32(0.3)
    x /= n0.astype(np.float32) + np.float32(0.3)
    return np.log(x, out=x)


def confidence(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return CONFIDENCE.take(np.minimum(n0 + n1, SEEN - 1))


def mixed(weights: np.ndarray, x, g) -> np.ndarray:
    w = np.ascontiguousarray(weights.T, np.float32)
    z = w[-1].take(g)
    for i, xi in enumerate(x):
        z += w[i].take(g) * xi
    return np.clip(z, -REACH, REACH, out=z)


def first_weights(inputs: int) -> np.ndarray:
    return np.tile(np.array([1.1 / inputs] * inputs + [0.0]), (GATES * GATES, 1))


class Learner:
    """What a task learns online: counts by slot, weights by gate, cells of the refining table. The gate is set by the last two inputs."""

    def __init__(self, slots: int, inputs: int):
        self.seen = np.zeros(slots, np.int64)  # zeros in the lower half, ones in the upper: one place in memory for both
        self.weights = first_weights(inputs)
        self.behind = np.zeros(GATES * GATES, np.int64)
        self.cell = np.zeros(2 * REFINE, np.int64)
        self.steps = self.total = 0

    def take(self, where: list[np.ndarray], bit: np.ndarray) -> None:
        lo = 0
        while lo < len(bit):
            hi = lo + min(MOST, max(LEAST, self.total // 4))
            self.step([w[lo:hi] for w in where], bit[lo:hi])
            lo = hi

    def step(self, where, bit) -> None:
        x, gates = [], []
        for w in where:
            pair = self.seen.take(w).view("<i4").reshape(-1, 2)
            x.append(stretched(pair[:, 0], pair[:, 1]))
            if len(x) > len(where) - 2:
                gates.append(confidence(pair[:, 0], pair[:, 1]))
        g = (gates[0] * np.int8(GATES) + gates[1]).astype(np.intp)
        z = mixed(self.weights, x, g)
        error = bit - 1 / (1 + np.exp(-z))
        z *= 2
        z += REFINE // 2 + 0.5
        bucket = z.astype(np.int32)
        self.cell += np.bincount(bucket * 2 + bit, minlength=2 * REFINE)
        count = np.bincount(g, minlength=GATES * GATES)
        rate = 0.4 / math.sqrt(1 + self.steps / 200) / np.maximum(count, 32)
        for i, xi in enumerate(x):
            self.weights[:, i] += rate * np.bincount(g, error * xi, GATES * GATES)
        self.weights[:, -1] += rate * 0.5 * np.bincount(g, error, GATES * GATES)
        self.behind += count
        one = np.where(bit > 0, LOW + 1, 1)
        for w in where:
            np.add.at(self.seen, w, one)
        self.steps += 1
        self.total += len(bit)

    def batches(self):
        """(row, body): counts, then weights (the bits behind them, their product in UNITs), then cells, ROW slots at a time."""
        products = np.rint(self.weights * self.behind[:, None] * UNIT).astype(np.int64).ravel()
        n0 = np.concatenate([self.seen & LOW, np.repeat(self.behind, self.weights.shape[1]), self.cell[::2]])
        n1 = np.concatenate([self.seen >> 32, products, self.cell[1::2]])
        yield from packed({lo // ROW: np.stack([n0[lo : lo + ROW], n1[lo : lo + ROW]]) for lo in range(0, len(n0), ROW)})


def packed(rows: dict[int, np.ndarray]):
    """(row, body) of those pairs of count arrays that hold anything."""
    some = [(i, x) for i, x in rows.items() if x.any()]
    for lo in range(0, len(some), 500):
        part = some[lo : lo + 500]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for _, x in part], pa.binary())], ["row", "body"])


def learnt(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """The sums of what tasks learnt, by row; a fixed size, whatever the number of tasks."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, body in zip(b.column("row").to_pylist(), b.column("body"), strict=True):
                x = np.frombuffer(zlib.decompress(body.as_py()), "<i8").reshape(2, -1)
                sums[i] = sums[i] + x if i in sums else x
        yield from packed(sums)

    form = "row int, body binary"
    out = rows.mapInArrow(run, form).repartition("row").mapInArrow(total, form).toArrow()
    return {i: np.frombuffer(zlib.decompress(x.as_py()), "<i8").reshape(2, -1) for i, x in zip(out.column("row").to_pylist(), out.column("body"), strict=True)}


class Mixer:
    """Logits and confidence of slots, weights by gate, and losses by mixed logit."""

    def __init__(self, slots: int, inputs: int, sums: dict[int, np.ndarray]):
        width = GATES * GATES * (inputs + 1)
        n0, n1 = np.zeros(slots + width + REFINE, np.int64), np.zeros(slots + width + REFINE, np.int64)
        for i, (a, b) in sums.items():
            n0[i * ROW : i * ROW + len(a)], n1[i * ROW : i * ROW + len(b)] = a, b
        self.stretch, self.gate = stretched(n0[:slots], n1[:slots]), confidence(n0[:slots], n1[:slots])
        behind, products = (n[slots : slots + width].reshape(-1, inputs + 1) for n in (n0, n1))
        self.learnt_bits = int(behind[:, 0].sum())
        self.weights = np.where(behind > 0, products / UNIT / np.maximum(behind, 1), first_weights(inputs))
        zeros, ones = n0[slots + width :], n1[slots + width :]
        centre = (np.arange(REFINE) - REFINE // 2) / 2
        prior = 1 / (1 + np.exp(-centre))
        refined = np.log((ones + 50 * prior) / (zeros + 50 * (1 - prior)))
        # the last step by table: log-probability of a zero and a one for each mixed logit, in steps of 1 / FINE
        z = np.interp(np.arange(-REACH * FINE, REACH * FINE + 1) / FINE, centre, refined)
        self.losses = np.concatenate([-np.logaddexp(0, z), -np.logaddexp(0, -z)]).astype(np.float32)

    def bits(self, where, bit) -> np.ndarray:
        """Natural log-probability of each bit."""
        out = np.empty(len(bit), np.float32)
        for lo in range(0, len(bit), MOST):  # pieces that stay in cache
            part = slice(lo, lo + MOST)
            w = [x[part] for x in where]
            g = (self.gate.take(w[-2]) * np.int8(GATES) + self.gate.take(w[-1])).astype(np.intp)
            z = mixed(self.weights, [self.stretch.take(x) for x in w], g)
            z *= FINE
            z += REACH * FINE + 0.5
            out[part] = self.losses.take(z.astype(np.int32) + bit[part] * np.int32(2 * REACH * FINE + 1))
        return out


def _places(v: Vocabulary, ids: np.ndarray, prev: np.ndarray, common: np.ndarray):
    node, bit, a, c = v.events(ids, prev, common)
    size = 1 << SLOT_BITS
    return [node + 2 * size, a, c + size], bit


def _slots(v: Vocabulary) -> int:
    return 2 * (1 << SLOT_BITS) + v.tree + 2


def token_mixer(train: DataFrame, vocab: Vocabulary, shared) -> Mixer:
    """What all texts of a table teach."""
    rows = train.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"))
    return block_mixer(numbered(rows, shared), vocab, shared)


def block_mixer(blocks: DataFrame, vocab: Vocabulary, shared) -> Mixer:
    """What the training texts of blocks teach."""

    def run(batches):
        v = shared.value
        numbers, learner = v.numbers(), Learner(_slots(v), 3)
        for b in batches:
            for block in map(Block, b.to_pylist()):
                number, taught = numbers.coded(block.number), ~block.held
                number, lengths = number[np.repeat(taught, block.lengths)], block.lengths[taught]
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for lo, hi in ranges(lengths, BLOCK):
                    ids, first = with_ends(number[ends[lo] : ends[hi]], lengths[lo:hi])
                    learner.take(*_places(v, ids, *v.before(ids, first)))
        yield from learner.batches()

    return Mixer(_slots(vocab), 3, learnt(blocks.select("lengths", "held", "number"), run))


def byte_mixer(counts: DataFrame) -> Mixer:
    """Spelling, learnt from each distinct word."""

    def run(batches):
        learner = Learner(1 << BYTE_BITS, ORDERS)
        for b in batches:
            for _, bit, slots in byte_bits(b.column("word").to_pylist()) if len(b) else ():
                learner.take(slots, bit)
        yield from learner.batches()

    return Mixer(1 << BYTE_BITS, ORDERS, learnt(counts.select("word"), run))


def spelled(words: list[bytes], model: Mixer) -> np.ndarray:
    """log10 of each word's spelling."""
    out = np.zeros(len(words))
    for word, bit, slots in byte_bits(words) if words else ():
        out += np.bincount(word, model.bits(slots, bit), len(words))
    return out / math.log(10)


# ---- successors


def contexts(keys: np.ndarray, first: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of tokens behind two others of their text, those contexts).

    keys: a 64-bit name of each token, first: where texts begin, coded: which tokens the tree holds (others are not foreseen).
    """
    if len(keys) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        context = mix(keys[1:-1] * np.uint64(0x9FB21C651E98DF25) + keys[:-2], 21)
    begins = np.zeros(len(keys), bool)
    begins[first] = True
    at = np.flatnonzero(~begins[2:] & ~begins[1:-1] & coded[2:])
    return at + 2, context[at]


def successors(seen: DataFrame) -> DataFrame:
    """ctx, n, m, next: how often each context was seen, and its most frequent successor with its count; seen: ctx, next."""
    pairs = seen.groupBy("ctx", "next").agg(F.count(F.lit(1)).alias("c"))
    best = pairs.groupBy("ctx").agg(F.sum("c").alias("n"), F.max(F.struct("c", "next")).alias("top"))
    return best.select("ctx", "n", F.col("top.c").alias("m"), F.col("top.next").alias("next"))


def _level(m, n):
    """How sure a context is: its best count up to SURE, and whether others were seen."""
    return (F.least(m, F.lit(SURE)) * 2 + (m == n).cast("int")).cast("int")


def trust(table: DataFrame) -> dict[tuple[bool, int], float]:
    """Chance that the table is right, for training texts and (each occurrence left out) for others, by level; a fixed size.

    A row of the table stands for as many contexts as its column times says, if it has one.
    """
    m, n = F.col("m"), F.col("n")
    times = F.col("times") if "times" in table.columns else F.lit(1)
    entry = lambda held, level, hit, of: F.struct(F.lit(held).alias("held"), level.alias("level"), (hit * times).alias("hit"), (of * times).alias("of"))
    zero = F.lit(0).cast("long")
    rows = table.select(F.inline(F.array(entry(False, _level(m, n), m, n), entry(True, _level(m - 1, n - 1), m, m), entry(True, _level(m, n - 1), zero, n - m))))
    sums = rows.where("of > 0").groupBy("held", "level").agg(F.sum("hit").alias("hit"), F.sum("of").alias("of")).collect()
    return {(r["held"], r["level"]): (r["hit"] + 0.5) / (r["of"] + 1) for r in sums}


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


class Pairs:
    """The distinct pairs of a context and its successor in a block, ordered by context; taught: how often in training texts.

    place: where in the block foreseen tokens stand, pair: which pair each is.
    """

    def __init__(self, v: Vocabulary, block: Block, every: np.ndarray, first: np.ndarray):
        escapes = every == ESCAPE
        keys = v.names()[every]
        keys[escapes] = block.hashes
        self.place, context = contexts(keys, first, (every > ESCAPE) & (every <= v.tree + 1))
        follows = every[self.place]
        low = np.uint64((1 << 24) - 1)  # the lowest bits tell a context's successors apart
        with np.errstate(over="ignore"):
            key = context & ~low | (context + follows.astype(np.uint64) * np.uint64(0x9E3779B1)) & low
        order = np.argsort(key)
        new = changes(context[order]) | changes(follows[order])
        if (new & ~changes(key[order])).any():  # contexts that share all their other bits
            order = np.lexsort((follows, context))
            new = changes(context[order]) | changes(follows[order])
        context, follows = context[order], follows[order]
        rank = np.cumsum(new) - 1
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = rank
        self.context, self.follows = context[new], follows[new]
        taught = np.repeat(~block.held, block.lengths + 1)[self.place]
        self.taught = np.bincount(self.pair[taught], minlength=len(self.context))

    def stops(self, buckets: int) -> np.ndarray:
        """Where each bucket's pairs begin and end; buckets are ranges of the upper halves of contexts."""
        bucket = ((self.context >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return bucket.searchsorted(np.arange(buckets + 1, dtype=np.uint64))


def best_successors(context: np.ndarray, follows: np.ndarray, count: np.ndarray, names: np.ndarray):
    """(n, m, hit, n by context, m by context): how often a pair's context was taught, how often its most frequent successor, and
    whether the pair has that one (of equal counts the largest name); pairs may repeat."""
    order = np.argsort(context, kind="stable")
    order = order[np.argsort(np.cumsum(changes(context[order])) << 32 | follows[order], kind="stable")]
    c, x, times = context[order], follows[order], count[order]
    other = changes(c)
    new = other | changes(x)
    start = np.flatnonzero(new)
    times, x, of = np.add.reduceat(times, start), names[x[start]].view(np.int64), (np.cumsum(other) - 1)[start]
    heads = np.flatnonzero(other[start])
    n, m = np.add.reduceat(times, heads), np.maximum.reduceat(times, heads)
    top = np.maximum.reduceat(np.where(times == m[of], x, np.iinfo(np.int64).min), heads)
    pair, out = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
    pair[order] = np.cumsum(new) - 1
    out = of[pair]
    return n[out], m[out], (x == top[of])[pair], n, m


def foreseen(blocks: DataFrame, shared, buckets: int) -> DataFrame:
    """(block, bucket, reply, seen): what the table of successors says of each pair of a block, in the order of its Pairs.

    A block sends its distinct pairs to the buckets of their contexts, so that a frequent one is sent once a block. A reply is the
    pair's level (0: its context is in no training text), and 10 more if it is the one foreseen; seen: how many contexts have which m and n.
    """

    def send(batches):
        v = shared.value
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                pairs = Pairs(v, block, *with_ends(block.number, block.lengths))
                stops = pairs.stops(buckets).tolist()
                for i, (lo, hi) in enumerate(itertools.pairwise(stops)):
                    if lo < hi:
                        steps = np.diff(pairs.context[lo:hi], prepend=np.uint64(0))
                        body = [planes(x) for x in (steps, pairs.follows[lo:hi].astype("<i4"), pairs.taught[lo:hi].astype("<i4"))]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in body)], ["bucket", "block", "steps", "follows", "taught"])

    def answer(sent: pa.Table) -> pa.Table:
        column = lambda name, kind: [unpacked(x, kind) for x in sent.column(name).to_pylist()]
        context = [np.cumsum(x, dtype=np.uint64) for x in column("steps", "<u8")]
        sizes = [len(x) for x in context]
        follows, taught = np.concatenate(column("follows", "<i4")), np.concatenate(column("taught", "<i4")).astype(np.int64)
        n, m, hit, of_n, of_m = best_successors(np.concatenate(context), follows, taught, shared.value.names())
        level = np.where(n > 0, np.minimum(m, SURE) * 2 + (m == n) + 10 * hit, 0).astype("u1")
        base = int(of_m.max()) + 1
        kinds, times = np.unique((of_n * base + of_m)[of_n > 0], return_counts=True)
        seen = [[{"m": k % base, "n": k // base, "times": t} for k, t in zip(kinds.tolist(), times.tolist(), strict=True)]] + [[]] * (len(sizes) - 1)
        reply = [planes(x) for x in np.split(level, np.cumsum(sizes)[:-1])]
        return pa.table([sent.column("block"), sent.column("bucket"), pa.array(reply, pa.binary()), pa.array(seen, pa.list_(pa.struct({"m": pa.int64(), "n": pa.int64(), "times": pa.int64()})))], ["block", "bucket", "reply", "seen"])

    pairs = blocks.select("block", "lengths", "held", "number", "hashes").mapInArrow(send, "bucket int, block long, steps binary, follows binary, taught binary")
    return pairs.groupBy("bucket").applyInArrow(answer, "block long, bucket int, reply binary, seen array<struct<m:long,n:long,times:long>>")


# ---- scoring


def costs(v: Vocabulary, model: Mixer, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of each token's bits; what depends on the same three tokens is computed once."""
    prev, common = v.before(ids, first)
    some, which = np.unique((common.astype(np.int64) << 40) | (prev.astype(np.int64) << 20) | ids, return_inverse=True)
    each, mask = np.empty(len(some)), (1 << 20) - 1
    for lo in range(0, len(some), BLOCK):
        part = some[lo : lo + BLOCK]
        own = part & mask
        width = v.width[own]
        each[lo : lo + BLOCK] = np.add.reduceat(model.bits(*_places(v, own, (part >> 20) & mask, part >> 40)), np.cumsum(width) - width, dtype=np.float64)
    return each[which] / math.log(10)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row."""
    spark = docs.sparkSession
    space = Workspace(spark)
    sc = spark.sparkContext
    m, out = HELD_OUT
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), m) == out).alias("held_out"))
    train = rows.where("NOT held_out")
    texts = train.count()
    counts = space.keep(count_tokens(train))
    vocab = vocabulary(counts, texts)
    shared = sc.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = space.keep(numbered(rows, shared))
    model = sc.broadcast(block_mixer(blocks, vocab, shared))
    letters = sc.broadcast(byte_mixer(counts))
    buckets = 1 + (blocks.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET
    replies = space.keep(foreseen(blocks, shared, buckets))
    right = trust(replies.select(F.inline("seen")))
    chances = np.array([[right.get((held, level), 0.5) for level in range(2 * SURE + 2)] for held in (False, True)])

    def scored(texts_: pa.Table, told: pa.Table) -> pa.Table:
        v = shared.value
        row = texts_.to_pylist()[0]
        block = Block(row)
        lengths, held, n = block.lengths, block.held, len(block.lengths)
        every, first = with_ends(block.number, lengths)
        ids = v.numbers().coded(every)
        each = costs(v, model.value, ids, first)
        text = np.repeat(np.arange(n), lengths + 1)
        known = np.bincount(text, (every > END) | ((every == END) & (v.texts > 0)), n).astype(np.int64)
        low, high = np.bincount(text, v.low[every], n), np.bincount(text, each + v.own[every], n)
        pairs = Pairs(v, block, every, first)
        if len(pairs.place):
            told = told.sort_by("bucket")
            reply = np.concatenate([unpacked(x, "u1") for x in told.column("reply").to_pylist()])[pairs.pair]
            where = text[pairs.place]
            level, hit, other = reply % 10, reply >= 10, held[where]
            met = (level > 0) & (other | (level >= 4))  # texts that taught it must have been seen twice, themselves included
            chance = chances[other.astype(int), level]
            high += np.bincount(where, np.where(met, np.where(hit, np.log10(chance) - each[pairs.place], np.log10(1 - chance)), 0.0), n)
        # unlisted words, by hash; those of held-out texts may have to be spelled
        rare = pa.StructArray.from_arrays([_signed(block.hashes), pa.array(row["words"], pa.binary())], ["h", "word"])
        stops = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[every == ESCAPE], minlength=n))]), pa.int32())
        ids_ = texts_.column("doc_id").combine_chunks().flatten()
        return pa.table([pa.array(row["block"] + np.arange(n)), ids_, pa.array(held), pa.array(row["n_bytes"], pa.int64()), pa.array(lengths + 1), pa.array(known), pa.array(low), pa.array(high), pa.ListArray.from_arrays(stops, rare)], RESULT)

    form = f"row long, doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, known long, low double, score double, rare array<struct<h:long,word:binary>>"
    result = space.keep(blocks.groupBy("block").cogroup(replies.select("block", "bucket", "reply").groupBy("block")).applyInArrow(scored, form))
    space.drop(blocks)
    space.drop(replies)

    def spelling(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(spelled(b.column("word").to_pylist(), letters.value))], ["h", "own"])

    # what a word costs after an escape: its share of the rare ones, or that of the unknown ones and its spelling
    mass = vocab.mass
    words = result.where("held_out").select(F.inline("rare")).distinct().join(counts.select("h"), "h", "left_anti")
    novel = space.keep(words.mapInArrow(spelling, "h long, own double"))
    listed = counts.select("h", "c", (F.log10("c") - mass).alias("own")).unionByName(novel.select("h", F.lit(0).cast("long").alias("c"), (F.col("own") + math.log10(max(1, vocab.rare_kinds)) - mass).alias("own")))
    escaped = result.select("row", F.inline("rare")).select("row", "h").join(listed, "h")
    escaped = escaped.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("found"), F.sum(F.log10(F.col("c") + 0.5) - math.log10(0.5)).alias("gain"), F.sum("own").alias("own"))

    joined = result.drop("rare").join(escaped, "row", "left")
    total = F.col("score") + F.coalesce("own", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("low") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


RESULT = ["row", "doc_id", "held_out", "n_bytes", "n_tokens", "known", "low", "score", "rare"]


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
