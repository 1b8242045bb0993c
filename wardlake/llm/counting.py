"""Token counts by finite-state transducers.

Two machines are compiled from a byte-level BPE file. Neither tokenises: their transitions say how many tokens come out.

The first splits text into words as the file's pattern does. It reads classes of characters, has eleven states, and its transitions say whether a word starts at
the character read, or at the one before (the pattern looks one character ahead, and two letters into a contraction). A block of texts is cut into chunks of equal
length, all chunks are read at once from every state, which gives a map from state to state for each, and the maps are composed by a parallel prefix scan; so
each chunk's true state of entry is known and all chunks are read once more, at once, for the marks.

The second reads the bytes of a word. A sequence of tokens is what BPE gives if and only if each two neighbours in it are what BPE gives for their bytes, and a prefix of
a word has just one such sequence. A state is therefore, for each beginning from which a token may still grow: the place in the tree of tokens, the last token
before it, and its count of tokens less the present one. A transition says by how much the count changes, which may be downwards. States and transitions are
compiled when a text first needs them, and both they and the counts of words are kept in bounded tables.

Everything is one narrow pass: no shuffle, one block and its words in memory.

Defined results: a null or empty text has no bytes and no tokens; the name of a special token within a text is one token, as in the library's plain call; a very long text
is read in pieces, each from the start of the last word that was open; repeated rows are counted one by one, a null id stays null; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .packing import byte_letters

LIMIT = 1024
#: Characters of a block and of a chunk.
BLOCK, CHUNK = 1 << 20, 256
#: Words and transitions that are kept.
WORDS, MOVES, SHORT = 400_000, 1_000_000, 64

SPACE, BLANK, QUOTE, DIGIT, OTHER, LETTER, ONE, RV, ELL, EH, END = range(11)
START, LETTERS, DIGITS, OTHERS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, QUOTED, QUOTED_RV, QUOTED_ELL = range(11)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m[0]]] = kind
    out[[ord(c) for c in "stmd"]] = ONE
    out[[ord("r"), ord("v")]] = RV
    out[ord("l")], out[ord("e")], out[ord("'")], out[ord(" ")] = ELL, EH, QUOTE, SPACE
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, whether a word starts here, and whether one starts a character before, for state * 11 + class."""
    letters = (LETTER, ONE, RV, ELL, EH)
    fresh = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: QUOTED, DIGIT: DIGITS, OTHER: OTHERS, END: START} | dict.fromkeys(letters, LETTERS)
    after_space = {SPACE: RUN_SPACE, BLANK: RUN_BLANK, QUOTE: OTHERS, DIGIT: DIGITS, OTHER: OTHERS} | dict.fromkeys(letters, LETTERS)
    # what goes on with the open word, by state; any other class starts a word
    goes_on = {
        START: {},
        LETTERS: dict.fromkeys(letters, LETTERS),
        DIGITS: {DIGIT: DIGITS},
        OTHERS: {OTHER: OTHERS, QUOTE: OTHERS},
        ONE_SPACE: after_space,
        ONE_BLANK: {SPACE: RUN_SPACE, BLANK: RUN_BLANK},
        RUN_SPACE: {SPACE: RUN_SPACE, BLANK: RUN_BLANK},
        RUN_BLANK: {SPACE: RUN_SPACE, BLANK: RUN_BLANK},
        QUOTED: {ONE: START, RV: QUOTED_RV, ELL: QUOTED_ELL, OTHER: OTHERS, QUOTE: OTHERS},
        QUOTED_RV: {EH: START},
        QUOTED_ELL: {ELL: START},
    }
    # states whose last character starts a word of its own unless the class goes on: as which state it then stands
    splits = {RUN_SPACE: ONE_SPACE, RUN_BLANK: ONE_BLANK, QUOTED_RV: LETTERS, QUOTED_ELL: LETTERS}
    n = len(goes_on)
    then, here, before = np.zeros(n * n, np.uint8), np.zeros(n * n, bool), np.zeros(n * n, bool)
    for state in range(n):
        for kind in range(n):
            at, i = state, state * n + kind
            blank_at_end = kind == END and state in (RUN_SPACE, RUN_BLANK)
            if kind not in goes_on[at] and at in splits and not blank_at_end:
                before[i], at = True, splits[at]
            here[i] = kind not in goes_on[at]
            then[i] = goes_on[at].get(kind, fresh[kind])
    return then, here, before


def entries(kinds: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The state in which each chunk (row of classes) is entered, the first one at START."""
    n = len(kinds)
    maps = np.broadcast_to(np.arange(11, dtype=np.uint8), (n, 11)).copy()
    for c in range(kinds.shape[1]):
        maps = then.take(maps.astype(np.int16) * 11 + kinds[:, c, None])
        if (maps == maps[:, :1]).all():  # every map is constant: one state stands for all
            state = maps[:, 0]
            for rest in range(c + 1, kinds.shape[1]):
                state = then.take(state.astype(np.int16) * 11 + kinds[:, rest])
            maps = np.broadcast_to(state[:, None], (n, 11))
            break
    step = 1
    while step < n:  # after each round a map covers twice as many chunks
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    return np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)


def starts(kinds: np.ndarray) -> np.ndarray:
    """Where words start in a block of classes."""
    then, here, before = splitter()
    size = len(kinds)
    rows = np.concatenate([kinds, np.full(-size % CHUNK, END, np.uint8)]).reshape(-1, CHUNK)
    state = entries(rows, then)
    columns = np.ascontiguousarray(rows.T)
    moves = np.empty(columns.shape, np.uint8)
    for c, kind in enumerate(columns):
        move = state * 11 + kind
        moves[c] = move
        state = then.take(move)
    moves = moves.T.reshape(-1)
    marks = here.take(moves)
    marks[:-1] |= before.take(moves[1:])
    return np.flatnonzero(marks[:size])


class Counter:
    """Counts of tokens by the vocabulary and merges of a file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        self.special = [x["content"] for x in form["added_tokens"]]
        named = {t: i for t, i in form["model"]["vocab"].items() if t not in self.special}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in named.items()}
        self.single = [named[c] for _, c in sorted(byte_letters().items())]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in form["model"]["merges"]]
        self.merges = {(named[a], named[b]): (rank, named[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.child: dict[int, int] = {}  # place * 256 + byte -> place
        self.token, self.grows = [-1], [False]
        for i, token in self.bytes.items():
            at = 0
            for b in token:
                self.grows[at] = True
                at = self.child.setdefault(at << 8 | b, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
                    self.grows.append(False)
            self.token[at] = i
        #: token -> rank of its merge and its two parts; a byte has none
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in self.merges.items()} | {i: (-1, i, i) for i in self.single}
        self.whole: dict[int, bool] = {}
        self.words: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def merged(self, word: bytes) -> list[int]:
        """BPE of a few bytes, merge by merge."""
        ids = [self.single[b] for b in word]
        while True:
            found = min((self.merges[p] for p in zip(ids, ids[1:], strict=False) if p in self.merges), default=None)
            if found is None:
                return ids
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merges.get((ids[i], ids[i + 1])) == found:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def alone(self, token: int) -> bool:
        """Whether BPE makes this one token of its bytes."""
        if token not in self.whole:
            self.whole[token] = self.merged(self.bytes[token]) == [token]
        return self.whole[token]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether BPE makes these two tokens of their bytes.

        Merging is undone, the latest merge first: the token that ends at the border, or the one that begins there, falls into its two parts. The two that meet at the border must
        never have been the next to merge: their rank has to lie beyond that of the merge that came in its stead. Among equal ranks the left pair merges first.
        """
        if not self.alone(token) or last < 0:
            return self.alone(token)
        a, b, merges, made = last, token, self.merges, self.made
        limit = float("inf")
        while True:
            found = merges.get((a, b))
            if found is not None and found[0] < limit:
                return False
            (rank_a, _, right), (rank_b, left, _) = made[a], made[b]
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, a = rank_a, right
            else:
                limit, b = rank_b + 0.5, left

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte: next state, change of the count."""
        grown, found = [], None
        for place, last, count in self.states[state]:
            at = self.child.get(place << 8 | byte)
            if at is None:
                continue
            if found is None and self.token[at] >= 0 and self.may_follow(last, self.token[at]):
                found = self.token[at], count + 1
            if self.grows[at]:
                grown.append((at, last, count))
        token, change = found
        key = (*((at, last, count - change) for at, last, count in grown), (0, token, 0))
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        self.moves[state << 8 | byte] = number, change
        return number, change

    def count(self, word: bytes) -> int:
        if len(self.moves) >= MOVES:
            self.reset()
        state, n, get = 0, 0, self.moves.get
        for b in word:
            state, change = get(state << 8 | b) or self.compiled(state, b)
            n += change
        return n

    def word(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= SHORT:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = n
        return n

    def block(self, parts: list[str], open_end: bool) -> tuple[np.ndarray, str]:
        """Tokens of each part; if the last is open, its last word isn't counted but given back."""
        text = "\n".join([*parts, ""])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kinds = classes()[points]
        kinds[ends] = END
        at, stop, tail = starts(kinds), len(text), ""
        if open_end:
            # what follows may still put a start at the last character, so the word before that is the open one
            stop = int(at[at < ends[-1] - 1][-1])
            tail, at = text[stop : int(ends[-1])], at[at < stop]
        place = np.arange(len(text) + 1) if len(raw := text.encode("utf-8", "surrogatepass")) == len(text) else np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        offsets = place[np.append(at, stop)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        seen, make = self.words.get, self.word
        of = np.array([seen(w) or make(w) for w in words.dictionary.to_pylist()], np.int64)
        counts = of[words.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        counts[np.isin(at, ends, assume_unique=True)] = 0  # the ends themselves
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(np.concatenate([[0], total[np.searchsorted(at, ends, "right")]])), tail

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out, parts, owner, size = [0] * len(texts), [], [], 0

        def flush(open_end: bool = False) -> str:
            nonlocal parts, owner, size
            tail = ""
            if parts:
                counts, tail = self.block(parts, open_end)
                for i, n in zip(owner, counts.tolist(), strict=True):
                    out[i] += n
            parts, owner, size = [], [], 0
            return tail

        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = [text]
            for name in self.special:
                if name in text:
                    pieces = [x for p in pieces for x in p.split(name)]
            out[i] += len(pieces) - 1
            for piece in pieces:
                at, held = 0, ""
                while len(piece) - at > BLOCK:
                    flush()
                    # an open word that is long is read on with as much again, so that a word of any length is read in a few rounds
                    step = max(BLOCK, len(held))
                    parts, owner = [held + piece[at : at + step]], [i]
                    at += step
                    held = flush(open_end=True)
                parts.append(held + piece[at:])
                owner.append(i)
                size += len(parts[-1])
                if size >= BLOCK:
                    flush()
        flush()
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of a text, by the tokenizer file at a path that all executors can read."""
    schema = docs.drop(out).schema.add(out, "long")
    keep = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(path)
        for b in batches:
            n = made.texts(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, out])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = count_tokens(docs.withColumn("n_bytes", F.octet_length("text").cast("long")), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
