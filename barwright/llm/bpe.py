"""Byte-level BPE encoding and decoding (operator 5).

Encoding: a text is cut into pieces by the vocabulary's pattern; the symbols of a piece stand in a doubly linked list,
a priority queue holds the merges between neighbours by rank and position, and entries whose symbols have changed since
they were pushed are skipped. Decoding concatenates the vocabulary's strings.

Pieces repeat, so each worker keeps the ids of pieces it has met in two generations of bounded size. A null text is
empty; an empty text has no ids. A special token's string in a text is that token, as in the tokenizers library.
A very long text is encoded whole. Rows stay one to one, repeated ones too; an empty table gives no rows. Columns other
than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import as_text, slices

#: Entries of one generation of a worker's memory of pieces and of words, about 220 bytes each; a memory has two generations.
PIECES, WORDS = 200_000, 50_000
#: Letters after an apostrophe are pieces of their own in this pattern; the classes below are tested against the library.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^ \na-zA-Z0-9]+|[ \n]+(?![^ \n])|[ \n]+")
#: Stands for no symbol: with any other, no pair that merges.
GONE = -(1 << 60)
#: Code points below this are compared with the library's classes when a worker starts.
COMPARED = 0x3100


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memory:
    """A dict of bounded size: two generations, the older of which is dropped when the younger is full."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def all(self, keys: list) -> list:
        young, old = self.young, self.old
        return [young.get(k) or old.get(k) for k in keys]

    def add(self, new: dict) -> None:
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
        self.young |= dict(islice(new.items(), self.most))


class Classes:
    """Which characters are letters, digits and white space to the library; asked of it once for each character."""

    def __init__(self, pre_tokenize: Callable[[str], list]):
        self.ask, self.known = pre_tokenize, {}
        odd = "".join(re.escape(chr(c)) for c in range(COMPARED) if self.of(chr(c)) != self.fast(chr(c)))
        self.unusual = re.compile(f"[{odd}\U00003100-\U0010ffff]")

    @staticmethod
    def fast(ch: str) -> str:
        return "s" if re.match(r"\s", ch) else "L" if re.match(r"[^\W\d_]", ch) else "N" if re.match(r"\d", ch) else "o"

    def of(self, ch: str) -> str:
        if ch not in self.known:
            one = lambda s: len(self.ask(s)) == 1
            self.known[ch] = "L" if one("a" + ch) else "N" if one("1" + ch) else "o" if one("!" + ch) else "s"
        return self.known[ch]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text by the library's pattern."""
        if not self.unusual.search(text):
            return FAST.findall(text)
        # Each unusual character is replaced by a plain one of its class, so that one pattern serves all of Unicode.
        like = {"L": "a", "N": "0", "o": "!", "s": "\n"}
        same = "".join(ch if ch == "'" or ch == " " or ch.isascii() and ch.isalnum() else like[self.of(ch)] for ch in text)
        return [text[m.start() : m.end()] for m in PLAIN.finditer(same)]


class ByteBPE:
    """A byte-level BPE vocabulary from a tokenizers file."""

    most = PIECES, WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        # The printable stand-ins of the 256 byte values, in this kind of file.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        stand_in = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        byte_of = {ch: b for b, ch in stand_in.items()}
        vocab = model["vocab"]
        self.first = [vocab[stand_in[b]] for b in range(256)]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.shown = {b: ch for b, ch in stand_in.items()}
        self.strings = {i: bytes(byte_of[ch] for ch in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(self.strings) + 1
        self.vocabulary = pa.array([self.strings.get(i, b"") for i in range(self.size)], pa.large_binary())
        # From a pair of symbols to the merge's rank (from 1) and its new symbol.
        self.merges = {vocab[a] * self.size + vocab[b]: ((rank + 1) << 24) + vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.classes = Classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.unusual = self.classes.unusual
        self.memory, self.words = map(Memory, self.most)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. A queue's entry is one integer: rank, new symbol and position."""
        symbol = [*[self.first[b] for b in piece], GONE]
        n, size, merges = len(piece), self.size, self.merges
        left, right = list(range(-1, n)), list(range(1, n + 2))
        queue = [(found << 32) + i for i in range(n - 1) if (found := merges.get(symbol[i] * size + symbol[i + 1]))]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, found = entry & 0xFFFFFFFF, entry >> 32
            j = right[i]
            if merges.get(symbol[i] * size + symbol[j]) != found:
                continue  # stale: one of its symbols was merged since
            symbol[i] = new = found & 0xFFFFFF
            symbol[j] = GONE
            right[i] = k = right[j]
            left[k] = i
            if found := merges.get(new * size + symbol[k]):
                heappush(queue, (found << 32) + i)
            if (h := left[i]) >= 0 and (found := merges.get(symbol[h] * size + new)):
                heappush(queue, (found << 32) + h)
        return [s for s in symbol if s >= 0]

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        pack, merge = self.pack, self.merge
        return [pack(merge(p.encode())) for p in pieces]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, four bytes each; those not remembered are encoded, each once."""
        out = self.memory.all(pieces)
        if None in out:
            missing = list(dict.fromkeys(p for p, x in zip(pieces, out, strict=True) if x is None))
            new = dict(zip(missing, self.new_pieces(missing), strict=True))
            out = [new[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
            self.memory.add(new)
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words with a space before it. A word is not empty, holds no space and begins with no white space."""
        out = self.words.all(words)
        missing = [w for w, x in zip(words, out, strict=True) if x is None]
        if missing:
            # One pass of the pattern over all of them; a word ends with the piece that ends where the next one's space is.
            pieces = FAST.findall(" " + " ".join(missing))
            ids, parts, new = self.of_pieces(pieces), [], []
            ends, at = accumulate(len(w) + 1 for w in missing), 0
            end = next(ends)
            for piece, x in zip(pieces, ids, strict=True):
                parts.append(x)
                at += len(piece)
                if at >= end:
                    new.append(parts[0] if len(parts) == 1 else b"".join(parts))
                    parts, end = [], next(ends, 0)
            self.words.add(dict(zip(missing, new, strict=True)))
            found = iter(new)
            out = [next(found) if x is None else x for x in out]
        return out

    def encode_many(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A piece holds no space but at its start or in a run of white space, so that a space before anything but white
        space starts a piece: texts without other spaces are cut there. Arrow numbers their distinct words, each of which
        is encoded once, and puts the words' ids together again.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        out: list = []
        for text in texts.to_pylist():
            plain = not (self.cut.search(text) or self.unusual.search(text) or LOOSE.search(text))
            out.append(None if plain else self.of_any(text))
        at = [i for i, x in enumerate(out) if x is None]
        if at:
            lists = pc.split_pattern(texts.take(pa.array(at)), " ")
            ends, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            # A text's first word has no space before it, may be empty and may begin with white space: it is encoded by itself.
            inner = np.ones(len(words), bool)
            inner[ends[:-1]] = False
            heads, coded = words.filter(pa.array(~inner)).to_pylist(), words.filter(pa.array(inner)).dictionary_encode()
            codes = np.empty(len(words), np.int64)
            codes[inner] = coded.indices.to_numpy()
            codes[~inner] = np.arange(len(heads)) + len(coded.dictionary)
            known = self.of_words(coded.dictionary.to_pylist())
            every = [*known, *(b"".join(self.of_pieces(FAST.findall(x))) for x in heads)]
            joined = pa.array(every, pa.large_binary()).take(pa.array(codes))
            _, offsets, data = joined.buffers()
            bounds = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1][ends].tolist()
            data = memoryview(data) if data else b""
            for i, start, end in zip(at, bounds[:-1], bounds[1:], strict=True):
                out[i] = bytes(data[start:end])
        return out

    def of_any(self, text: str) -> bytes:
        """The ids of a text that may hold special tokens and any characters."""
        out, at = [], 0
        for m in [*self.cut.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                out += self.of_pieces(self.classes.pieces(part))
            if m:
                out.append(self.special[m[0]].to_bytes(4, "little"))
                at = m.end()
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode_many(self, packed: list[bytes]) -> list[str]:
        """The texts of lists of packed ids: the vocabulary's strings, put together in order."""
        joined = self.vocabulary.take(pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int64)))
        _, offsets, data = joined.buffers()
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)))
        bounds = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1][ends].tolist()
        data = memoryview(data) if data else b""
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many([self.pack(ids)])[0]


#: A space before white space or at the end.
LOOSE = re.compile(r" (?=\s|\Z)")


class LibraryBPE(ByteBPE):
    """The same, with the ids of each new piece given by the tokenizers library's model."""

    most = PIECES, 200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        shown, tokenize = self.shown, self.library.model.tokenize
        # Of plain characters only the space has a stand-in of its own.
        like = [p.replace(" ", shown[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(shown) for p in pieces]
        return [self.pack([t.id for t in tokenize(p)]) for p in like]


_loaded: dict = {}


def loaded(path: str, kind: type = ByteBPE) -> ByteBPE:
    """One coder for each file and worker."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Each row's id and text encoded and decoded again.

    Returns the id column, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (array<int>) and decoded.
    A null text gives no ids and an empty decoded text. Rows are kept one to one, also repeated ones; other columns are
    not read.
    """
    path = path or default_path()
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in slices(batches):
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            every = coder.encode_many(as_text(batch.column("text")))
            for packed, back in zip(every, coder.decode_many(every), strict=True):
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(np.frombuffer(packed, "<u4"))
                    texts.append(back)
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(rows, schema)
