"""Spelling variants by pivotal grams (operator 12).

Words are maximal runs of letters, ASCII capitals made small. They are counted over the whole texts inside the tasks and
then by Spark. Two words are near where one inserted, deleted or replaced code point parts them. To find such pairs each
word's bigrams are ordered by the number of words that hold them, rarest first; the first three (and those equal to the
third) are its prefix, and two of them that share no place, of the least total weight by dynamic programming, are its
pivots. One edit breaks one of two disjoint grams at most: of two near words, that whose prefix ends no later in the order
has a pivot in the other's prefix. One edit can't stand on both sides of that gram, either: the gram has the same place
from the words' beginning and what stands before it is equal, or the same place from the end and what follows is equal.
So pivots meet prefixes by gram and the equal side (a place limit of zero, and less to compare); pairs are then verified by
edit distance. A word's form is its near word of largest count, if that is `ratio` times its own; roots follow the forms,
two steps at a time, written to the shared folder between the steps. No join sends a side through the driver.

A null text has no words and a null doc_id reads as an empty string in the deletion rule; an empty table gives no rows;
texts and words of any length are taken whole. Repeated rows count each time. Columns but doc_id and text aren't read,
whatever their names. Ties for a form go to the least word in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, slices

#: Words of more bytes take their checksums one by one; distinct words that a task gathers before it hands them on.
TABLED, GATHERED = 48, 200_000


class Checksums:
    """crc32 of a prefix and a word, put together from their own: appending is linear in the prefix's, so tables by the word's length serve."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def table(self, length: int) -> np.ndarray:
        if length not in self.tables:
            zeros = bytes(length)
            none = zlib.crc32(zeros)
            self.tables[length] = np.array([[zlib.crc32(zeros, v << 8 * k) ^ none for v in range(256)] for k in range(4)], np.uint32)
        return self.tables[length]

    def appended(self, prefix: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
        """The checksums of prefixes, each with its word of `length` bytes after it."""
        t = self.table(length)
        out = words.copy()
        for k in range(4):
            out ^= t[k][(prefix >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def word_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of letters (A-Z made small, a-z, U+00C0 to U+00FF) of all texts, and the text that each is of."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(memoryview(data)[bounds[0] : bounds[-1]] if data else b"", np.uint8).copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    bounds = bounds - bounds[0]
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4")
    at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)))
    letter = np.concatenate(([False], ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points <= 0xFF)), [False]))
    edge = letter[1:] != letter[:-1]  # before each place, and at the end
    cut = np.searchsorted(at, bounds)  # a word also ends where its text does
    both = letter[cut] & letter[cut + 1]
    starts, ends = np.flatnonzero(edge & letter[1:]), np.flatnonzero(edge & letter[:-1])
    if both.any():
        more = np.unique(cut[both])
        starts, ends = np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
    # Arrow's arrays have no gaps: words and what is between them alternate, and the words are taken.
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = at[starts], at[ends], len(raw)
    every = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    return every.take(pa.array(np.arange(0, len(every), 2))), np.searchsorted(bounds, at[starts], side="right") - 1


def words_of(texts: pa.Array, ids: list, sums: Checksums, divisor: int, least_chars: int) -> Counter:
    """The words of some texts with their counts, some of them shortened by the rule of the checksum."""
    found, doc = word_runs(texts)
    if not len(found):
        return Counter()
    coded = found.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    raw = [w.encode() for w in words]
    own = np.array([zlib.crc32(w) for w in raw], np.uint32)
    size = np.array([len(w) for w in raw])
    chars = np.array([len(w) for w in words])
    head = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    times, short = np.zeros(len(words), np.int64), []
    at = np.flatnonzero((chars >= least_chars)[codes])
    at = at[np.argsort(size[codes[at]], kind="stable")]
    bounds = np.flatnonzero(np.diff(size[codes[at]], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        some = at[a:b]
        c, length = codes[some], int(size[codes[some[0]]])
        if length <= TABLED:
            h = sums.appended(head[doc[some]], own[c], length)
        else:
            h = np.array([zlib.crc32(raw[w], int(x)) for w, x in zip(c, head[doc[some]], strict=True)], np.uint32)
        hit = h % divisor == 0
        times += np.bincount(c[~hit], minlength=len(words))
        short += zip(c[hit].tolist(), (h[hit] % chars[c[hit]]).tolist(), strict=True)
    out = Counter({words[i]: n for i, n in zip(np.flatnonzero(times).tolist(), times[times > 0].tolist(), strict=True)})
    for (i, p), n in Counter(short).items():
        if chars[i] > least_chars:
            out[words[i][:p] + words[i][p + 1 :]] += n
    return out


def vocabulary(docs: DataFrame, divisor: int = 31, least_chars: int = 7, least_n: int = 2) -> DataFrame:
    """The distinct words of all texts with their counts: word, n."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, found = Checksums(), Counter()
        for batch in slices(batches):
            found.update(words_of(as_text(batch.column("text")), batch.column("doc_id").to_pylist(), sums, divisor, least_chars))
            if len(found) > GATHERED:
                yield as_batch(found)
                found = Counter()
        yield as_batch(found)

    def as_batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def grams_of(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def gram_order(words: DataFrame) -> dict[str, int]:
    """The places of the bigrams by the number of words that hold them, rarest first. Their number is bounded by the alphabet's square."""
    grams = words.mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: k for k, r in enumerate(grams.orderBy("n", "gram").toLocalIterator())}


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            found.update(set(grams_of(word)))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])


def prefix_of(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """The (order, place) of the three rarest grams of a word, and of all equal to the third."""
    every = sorted((order[g], i) for i, g in enumerate(grams_of(word)))
    last = every[min(2, len(every) - 1)][0]
    return [x for x in every if x[0] <= last]


def pivots_of(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two grams of a prefix that share no place, of the least total weight (their order).

    By place: the best single gram that ends before a gram begins is carried along, and the best pair so far is kept. The
    three first places of a prefix differ, so that the outer two never share one.
    """
    by_place = sorted((i, o) for o, i in prefix)
    best_one, best_two, ready = [None] * (len(by_place) + 1), None, 0
    for k, (i, o) in enumerate(by_place):
        while by_place[ready][0] + 2 <= i:
            one = (by_place[ready][1], by_place[ready][0])
            best_one[ready + 1] = min(x for x in (best_one[ready], one) if x is not None)
            ready += 1
        if (before := best_one[ready]) is not None and (best_two is None or before[0] + o < best_two[0]):
            best_two = (before[0] + o, before, (o, i))
    return [best_two[1], best_two[2]]


def near_words(words: DataFrame) -> DataFrame:
    """Each word (of four code points or more) with each near word and that one's count: word, other, other_n."""
    order = words.sparkSession.sparkContext.broadcast(gram_order(words))  # two of an alphabet of some ninety letters
    names = ["key", "pivot", "last", "letters", "word", "n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        place, hashed = order.value, xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, kinds, lasts, letters, at = [], [], [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                prefix = prefix_of(word, place)
                signature = 0
                for ch in word:
                    signature |= 1 << (ord(ch) & 63)
                both = set(pivots_of(prefix))
                for o, i in prefix:
                    # The gram with all that stands before it, and the gram with all that follows it.
                    for side in (word[: i + 2].encode(), b"\0" + word[i:].encode()):
                        key = hashed(side)
                        for pivot in (False, True) if (o, i) in both else (False,):
                            keys.append(key)
                            kinds.append(pivot)
                            lasts.append(prefix[-1][0])
                            letters.append(signature)
                            at.append(k)
            take = pa.array(at, pa.int64())
            arrays = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(kinds, pa.bool_()), pa.array(lasts, pa.int32()), pa.array(np.array(letters, np.uint64).view(np.int64)), batch.column("word").take(take), batch.column("n").take(take)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    keyed = words.mapInArrow(rows, "key long, pivot boolean, last int, letters long, word string, n long")
    # Merged, whatever size the planner takes them to be: the words' compressed files say little of it, and keys are several times as many.
    a, b = keyed.where("pivot").alias("a").hint("merge"), keyed.where("NOT pivot").alias("b")
    close = (F.col("a.last") <= F.col("b.last")) & (F.abs(F.char_length("a.word") - F.char_length("b.word")) <= 1) & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") != F.col("b.word")) & close & (F.levenshtein("a.word", "b.word", 1) == 1))
    both = F.array(*[F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n")) for x, y in ("ab", "ba")])
    return met.select(F.explode(both).alias("x")).select("x.*").distinct()


def variants(docs: DataFrame, divisor: int = 31, least_chars: int = 7, least_n: int = 2, ratio: int = 10) -> DataFrame:
    """Of each word: word, n, n_near, form, form_n, root (see above)."""
    if least_chars < 4:
        raise ValueError("words of fewer than four code points have no three grams")
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.table(vocabulary(docs, divisor, least_chars, least_n), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    formed = F.col("other_n") >= ratio * F.col("n")
    found = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n"))
    found = scratch.table(found, "forms")
    # A form has `ratio` times the count of what it stands for, so that chains are short and end; a step doubles what is followed.
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        links = scratch.table(links, "roots")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(onward.hint("merge"), "root", "left")
        if stepped.where("next IS NOT NULL").isEmpty():
            break
        links = stepped.select("word", F.coalesce("next", "root").alias("root"))
    return found.join(links.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
