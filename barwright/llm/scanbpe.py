"""Byte-level BPE by vectorised pre-tokenisation (operator 13).

No regular expression runs over the texts. The code points of a slice of texts stand in one array; a table of classes and
what follows each apostrophe and white space give one of a few symbols to each place. A symbol is a transition function
over the states of an automaton, the functions that can arise by composing them are few and numbered, and a table holds
the composition of any two. Composition is associative, so that a scan over blocks gives the state before each place and
with it the places where pieces begin. The pieces are slices of the texts' own bytes: Arrow numbers the distinct ones,
each is merged once by the ranks (and remembered), and Arrow puts their ids together. Decoding concatenates the
vocabulary's strings; each token's offset in the text's bytes is kept.

Which code points are letters, digits or white space is asked of the tiktoken library when a worker starts, so that the
classes are those of its version of Unicode.

A null text is empty; an empty text has no ids. A special token's string in a text is ordinary text. A text of any length
is one step. Rows stay one to one, also repeated ones; an empty table gives no rows; columns other than the id and the
text aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import Memory
from .common import as_text, slices

#: Pieces that a worker remembers, in each of two generations.
PIECES = 400_000
#: Bytes up to which a piece is merged without a queue; stands for no rank.
SMALL, NONE = 40, 1 << 31
# Symbols: letter, digit, other, apostrophe before s t m d, apostrophe before re ve ll, white space before more of it or
# the text's end, a space before something else, other white space before something else. The first of a text counts START more.
LETTER, DIGIT, OTHER, SHORT, LONG, INNER, SPACE, BREAK, START = range(9)
# States: the next one begins a piece; within letters, digits, others; after a space that belongs to what follows; within
# white space; one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


def step(symbol: int, state: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins at it."""
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (FRESH if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, AFTER_SPACE)
    if symbol in (OTHER, SHORT, LONG):
        if symbol == OTHER or state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == INNER:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == SPACE else FRESH), True


class Scan:
    """The functions that symbols and their compositions give, and the scan over them."""

    def __init__(self):
        one = [tuple(step(c, s)[0] for s in range(8)) for c in range(START)]
        symbols = [*one, *((f[FRESH],) * 8 for f in one)]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *symbols]))}
        todo = list(known)
        while todo:  # all that compositions give
            f = todo.pop()
            for g in symbols:
                if (h := tuple(g[s] for s in f)) not in known:
                    known[h] = len(known)
                    todo.append(h)
        self.n = len(known)
        every = list(known)
        self.of_symbol = np.array([known[f] for f in symbols], np.uint8)
        self.after = np.array([known[tuple(g[s] for s in f)] for f in every for g in every], np.uint8)  # f, then g
        self.state = np.array([f[FRESH] for f in every], np.uint8)
        self.begins = np.array([step(c, s)[1] for c in range(START) for s in range(8)] + [True] * 8 * START)

    def compose(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self.after[f.astype(np.intp) * self.n + g]

    def prefixes(self, f: np.ndarray) -> np.ndarray:
        """Of each place, the composition of the functions up to it: blocks side by side, then the blocks' totals, then both."""
        if len(f) <= 64:
            out = f.copy()
            for i in range(1, len(f)):
                out[i] = self.after[int(out[i - 1]) * self.n + int(f[i])]
            return out
        width = int(len(f) ** 0.5)
        rows = -(-len(f) // width)
        grid = np.zeros(rows * width, np.uint8)  # 0 is the identity
        grid[: len(f)] = f
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        for k in range(1, width):
            grid[k] = self.compose(grid[k - 1], grid[k])
        before = np.concatenate(([0], self.prefixes(grid[-1])[:-1])).astype(np.uint8)
        return self.compose(np.broadcast_to(before, grid.shape), grid).T.reshape(-1)[: len(f)]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        states = self.state[self.prefixes(self.of_symbol[symbols])]
        before = np.concatenate(([FRESH], states[:-1]))
        return np.flatnonzero(self.begins[symbols.astype(np.intp) * 8 + before])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def classes() -> np.ndarray:
    """LETTER, DIGIT, INNER (white space) or OTHER for each code point, as the tiktoken library has them."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", INNER)):
        # Text outside the matches gives no ids: what comes back are the characters of the class.
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[code_points(bytes(found).decode())] = kind
    return out


def symbols_of(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each place of some texts written one after another; first: where the non-empty texts begin."""
    out = kinds[points]
    last = np.append(first[1:], len(points)) - 1
    white = out == INNER
    ends = white.copy()
    ends[:-1] &= ~white[1:]
    ends[last] = False
    out[ends] = np.where(points[ends] == 32, SPACE, BREAK)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        text_end = last[np.searchsorted(first, marks, side="right") - 1]
        follow = [np.where(marks + k <= text_end, points[np.minimum(marks + k, len(points) - 1)], 0) for k in (1, 2)]
        out[marks[np.isin(follow[0], [ord(c) for c in "stmd"])]] = SHORT
        pair = follow[0].astype(np.int64) << 32 | follow[1]
        out[marks[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    out[first] += START
    return out


class ScanBPE:
    """A vocabulary of ranks in a tiktoken file."""

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        strings = {i: s for s, i in self.ranks.items()}
        self.vocabulary = pa.array([strings.get(i, b"") for i in range(max(strings) + 1)], pa.large_binary())
        self.lengths = pc.binary_length(self.vocabulary).to_numpy()
        self.said = pa.array([b"%d," % i for i in range(len(self.vocabulary))], pa.large_binary())
        self.kinds, self.scan, self.memory = classes(), Scan(), Memory(PIECES)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: of all neighbours the pair of least rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= SMALL:  # the least of a few ranks is found faster than a queue is kept
            at, get = list(range(n + 1)), ranks.get
            current = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
            while (least := min(current, default=NONE)) < NONE:
                i = current.index(least)
                del at[i + 1], current[i]
                if i < len(current):
                    current[i] = get(piece[at[i] : at[i + 2]], NONE)
                if i:
                    current[i - 1] = get(piece[at[i - 1] : at[i + 1]], NONE)
            return [ranks[piece[a:b]] for a, b in pairwise(at)]
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # by a part's first byte; a part that is gone ends at 0
        current = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of a part with the next
        queue = [(r << 32) + i for i, r in enumerate(current) if r >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if not end[i] or current[i] != rank:
                continue  # stale: one of the two was merged since
            j = end[i]
            end[i], end[j] = end[j], 0
            if (k := end[i]) < n:
                left[k] = i
            for a in (i, left[i]):
                if a >= 0:
                    b = end[a]
                    current[a] = ranks.get(piece[a : end[b]], -1) if b < n else -1
                    if current[a] >= 0:
                        heappush(queue, (current[a] << 32) + a)
        return [ranks[piece[i:e]] for i, e in enumerate(end) if e]

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of all texts as slices of their bytes, each text's first piece (and the end), and each text's first byte (and the end)."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(data)[bounds[0] : bounds[-1]] if data else memoryview(b"")
        bounds = bounds - bounds[0]
        if not len(raw):
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64), bounds
        points = code_points(str(raw, "utf-8"))
        at = None
        if len(points) == len(raw):
            first = bounds[:-1]
        else:
            at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
            first = np.searchsorted(at, bounds[:-1])
        first = first[bounds[1:] > bounds[:-1]]
        starts = self.scan.starts(symbols_of(points, self.kinds, first))
        starts = starts if at is None else at[starts]
        ends = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        return pieces, np.searchsorted(starts, bounds), bounds

    def encode_many(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's first place among them (and the end)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        pieces, own, _ = self.pieces(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = self.memory.all(distinct)
        missing = {p: array("I", self.merge(p)).tobytes() for p, x in zip(distinct, found, strict=True) if x is None}
        self.memory.add(missing)
        found = [missing[p] if x is None else x for p, x in zip(distinct, found, strict=True)]
        data, ends = together(pa.array(found, pa.large_binary()), coded.indices.to_numpy())
        return np.frombuffer(data, "<u4"), ends[own] // 4

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins in its text, and the end: with them any run of ids is decoded to its own place."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray) -> memoryview:
        """The vocabulary's strings, put together in order."""
        return together(self.vocabulary, ids)[0]

    def decimal(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids in decimal, a comma after each, and where each begins (and the end)."""
        return together(self.said, ids)


def together(strings: pa.Array, places: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The strings at some places, put together in order, and where each begins (and the end)."""
    if not len(places):
        return memoryview(b""), np.zeros(1, np.int64)
    joined = strings.take(pa.array(np.asarray(places, np.int64)))
    _, offsets, data = joined.buffers()
    ends = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return memoryview(data)[ends[0] : ends[-1]], ends - ends[0]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


_loaded: dict = {}


def loaded(path: str) -> ScanBPE:
    """One coder for each file and worker."""
    if path not in _loaded:
        _loaded[path] = ScanBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each row's id and text encoded and decoded again: the id column, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids, offsets (the byte at which each token begins in the text) and decoded."""
    path = path or default_ranks()
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<long>, decoded string" * keep_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in slices(batches):
            ids, own = coder.encode_many(as_text(batch.column("text")))
            (said, places), at, back = coder.decimal(ids), coder.offsets(ids), coder.decode(ids)
            bounds = list(zip(own[:-1].tolist(), own[1:].tolist(), strict=True))
            texts = [back[at[a] : at[b]] for a, b in bounds]
            columns = [
                batch.column("id"),
                pa.array(np.diff(own), pa.int64()),
                pa.array([hashlib.sha256(said[places[a] : places[b] - 1] if b > a else b"").hexdigest() for a, b in bounds], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [
                    pa.array([ids[a:b] for a, b in bounds], pa.list_(pa.int32())),
                    pa.array([at[a:b] - at[a] for a, b in bounds], pa.list_(pa.int64())),
                    pa.array([str(x, "utf-8") for x in texts], pa.string()),
                ]
                names += ["ids", "offsets", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(rows, schema)
