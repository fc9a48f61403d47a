"""Near duplicates by order min-hash and banded alignment (operator 2).

A text is its sequence of words. Its k-mers (three words; all words of a shorter text) are labelled with their occurrence
in the text. For each of BANDS hash orders the PICKED least labelled k-mers are taken and put back in text order: texts
with the same ordered picks of a band and lengths within a factor of about two are candidates. Texts of fewer than SHORT
words also have a key for each sequence that is left when up to 20 % of their words go: any two of them that may be linked
share one. A pair is linked when its word edit distance, found by alignment within a band of diagonals, is at most 20 % of
the longer text (similarity 0.8). Classes are the connected components of links.

The members of a key are held against two leaders, its least and its greatest row, never all against all. Where a key has
four rows or more and a member fails against a leader, the member goes on to another pass with a fixed number of new keys:
sketches of the k-mers that none of the leaders it failed against has (what made them meet, such as a passage that many
texts share, is gone), and sketches of all its k-mers with twice as many picks as in the pass before. Rows of a pass are
in proportion to the texts in it, whatever the sizes of groups; it ends when nothing fails in keys of four or more, and
there is no cap on members or passes.

What keys and leaders leave out is found exactly, between different classes alone: two linked texts have so many labelled
k-mers in common that several are among the rarest of both (by the number of texts that have them). Pairs that share so
many of their rarest are aligned. Where such a k-mer is in more than COMMON texts of several classes, its texts meet by
their rarest words instead, in the same way; short texts by the keys of all that is left of them. No link between
different texts of 12 words or more depends on chance, and shorter ones share a key as above.

Two texts of shingle similarity J share a band with a chance of about J*J. Where 20 % of the words are substituted at
random, J is about 0.34, and all bands part 0.2 % of such pairs; at fewer substitutions, fewer. Where every fifth word is
substituted, the worst case, J is 0.25, and 5 % are parted. README has the share measured; the step before finds these pairs too.

Null and empty texts have no words: they are copies of each other. Repeated rows are copies. Very long texts are aligned
whole. An empty table gives no rows. doc_id may be null or
repeated: a class is named by its least doc_id (null if it has none). Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_text, mixed, partitions, slices, unused, word_hashes

K, BANDS, PICKED, SIMILARITY = 3, 48, 2, 0.8
#: Texts of fewer words have keys for all that is left without up to 20 % of them: 106 keys at most.
SHORT = 15
#: A key that more texts have is not held against itself: its texts meet by their rarest words.
COMMON = 256
#: Keys of a part, about.
GROUP = 1 << 20

_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)
ROLL = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LENGTHS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64)


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of one text, each mixed with its occurrence."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * ROLL[i]
    out = mixed(out)
    in_order = np.sort(out)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if len(twice):  # only these are put in order with their places
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, out), len(twice) - 1)] == out)
        at = at[np.argsort(out[at], kind="stable")]
        place = np.arange(len(at))
        first = np.concatenate(([True], out[at][1:] != out[at][:-1]))
        occurrence = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
        out[at] = np.where(occurrence > 0, mixed(out[at] + occurrence * ROLL[63]), out[at])
    return out


def sketch(found: np.ndarray, picked: int = PICKED) -> np.ndarray:
    """The key of each band: its least labelled k-mers in text order. `found`: the labelled k-mers of a text, in order."""
    picked = min(picked, len(found))
    if not picked:
        return np.zeros(0, np.uint64)
    out = np.full(BANDS, picked, np.uint64)
    step = max(1, (1 << 16) // len(found))
    for a in range(0, BANDS, step):
        values = (found[None, :] ^ OFFSETS[a : a + step, None]) * FACTORS[a : a + step, None]
        if picked <= 3:
            rows, least = np.arange(len(values)), []
            for _ in range(picked):
                least.append(values.argmin(1))
                values[rows, least[-1]] = np.uint64(2**64 - 1)
            picks = np.sort(np.stack(least), axis=0)
        else:
            picks = np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1).T
        for at in picks:
            out[a : a + step] = mixed(out[a : a + step] * ROLL[62] + found[at])
    return mixed(out ^ OFFSETS)


def by_length(keys: np.ndarray, n: int) -> np.ndarray:
    """The keys mixed with the text's class of length (powers of two), and with the next class where a linked text may be in it."""
    c = n.bit_length()
    own = (c, c + 1) if 5 * n >= 4 << c else (c,)
    return np.concatenate([mixed(keys ^ LENGTHS[x]) for x in own])


@cache
def _left(n: int, size: int) -> np.ndarray:
    """The places of all sequences of `size` words of n."""
    return np.array(list(combinations(range(n), size)), np.int64).reshape(-1, size)


def shortened(words: np.ndarray) -> np.ndarray:
    """The keys of a short text: of each sequence that is left without some of its words, as many as two linked texts may differ by."""
    n = len(words)
    if not 0 < n < SHORT:
        return np.zeros(0, np.uint64)
    sizes = range(n - int((1 - SIMILARITY) * n + 1e-9), n + 1)
    return np.unique(np.concatenate([mixed((words[_left(n, k)] * ROLL[:k]).sum(1, dtype=np.uint64) ^ ROLL[61 - k]) for k in sizes]))


def first_keys(words: np.ndarray) -> np.ndarray:
    """The keys of the first pass; texts without words share one."""
    words = words.astype(np.uint64)
    return np.concatenate((by_length(sketch(kmers(words)), len(words)), shortened(words))) if len(words) else ROLL[:1]


def later_keys(found: np.ndarray, alive: np.ndarray, n_words: int, number: int) -> np.ndarray:
    """The keys of pass `number` (1 for the second): of the k-mers that the leaders lack, and of all."""
    parts = [sketch(found[alive], PICKED << (number - 1)), sketch(found, PICKED << number)]
    return np.concatenate([by_length(mixed(p + ROLL[j]), n_words) for j, p in enumerate(parts)])


def shared_least(n: int, k: int) -> int:
    """How many labelled k-mers a text of n words has in common at least with any linked text that isn't shorter."""
    up = -(-n // 5) * 5  # the share of words that may differ is highest at whole fifths
    return min(m - k + 1 - k * (m // 5) for m in (n, up))


def shared_rare(n: int, k: int) -> int:
    """How many of them are among the rarest of both."""
    return min(8 + n // 32, shared_least(n, k))


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common start and end."""
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[:n] != b[:n])
    a, b = (a[odd[0] :], b[odd[0] :]) if len(odd) else (a[n:], b[n:])
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    n = odd[0] if len(odd) else n
    return a[: len(a) - n], b[: len(b) - n]


def unmatched(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words of the one, as often as they stand there, that the other lacks."""
    values, counts = np.unique(np.concatenate((a, b)), return_inverse=True)
    less = np.bincount(counts[: len(a)], minlength=len(values)) - np.bincount(counts[len(a) :], minlength=len(values))
    return int(max(less[less > 0].sum(), -less[less < 0].sum()))


def aligned(a: list[int], b: list[int], limit: int) -> int:
    """The edit distance of two sequences, or -1 beyond the limit, by bit-parallel alignment within a band of diagonals.

    A column of the band is two whole numbers of 2 * width + 1 bits: where a cell is one more, and where it is one less,
    than the cell above it. Bit t of column j stands for row j - width + t, so that a diagonal is a bit. The distance is
    exact wherever it is at most the width, which grows until the distance fits or the limit is reached. Costs along a
    diagonal never fall, which ends hopeless pairs early.
    """
    apart = len(a) - len(b)
    width = min(limit, max(32, 2 * abs(apart)))
    while abs(apart) <= limit:
        whole, own, zero = (1 << 2 * width + 1) - 1, 1 << width + apart, (0, 0)
        places: dict[int, tuple[int, int]] = {}  # of a word: the band's rows that hold it, as of a column
        for i, word in enumerate(a[:width]):
            places[word] = places.get(word, zero)[0] | 1 << i + width, 0
        more, less, cost = whole >> width << width, 0, max(apart, 0)
        for j, word in enumerate(b):
            if j + width < len(a):
                rows, at = places.get(a[j + width], zero)
                places[a[j + width]] = rows >> j - at | 1 << 2 * width, j
            rows, at = places.get(word, zero)
            same = rows >> j - at
            straight = ((((same & more) + more) ^ more) | same | less) & whole
            right_more, right_less = less | (whole & ~(straight | more)), straight & more
            if not straight & own:
                cost += 1
                if cost > width:
                    break
            straight >>= 1
            more, less = right_less | (whole & ~(straight | right_more)), straight & right_more
        if cost <= width:
            return cost
        if width >= limit:
            break
        width = min(limit, 4 * width)
    return -1


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The word edit distance, or -1 beyond the limit."""
    if abs(len(a) - len(b)) > limit:
        return -1
    a, b = trimmed(a, b)
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= limit else -1
    return aligned(a.tolist(), b.tolist(), limit) if unmatched(a, b) <= limit else -1


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 less the edit distance as a share of the longer text, or -1 below SIMILARITY."""
    longer = max(len(a), len(b))
    d = distance(a, b, int((1 - SIMILARITY) * longer + 1e-9))
    return -1.0 if d < 0 else 1 - d / max(longer, 1)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's doc_id, text_hash, id and first (the id of the task's first row with the same words), and of the first ones words and keys."""
    import xxhash

    seen: dict[bytes, int] = {}
    for batch in slices(batches):
        hashes, offsets = word_hashes(as_text(batch.column("text")))
        first, words, keys = [], [], []
        for id_, a, b in zip(batch.column("id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
            own = hashes[a:b].astype("<u4")
            first.append(seen.setdefault(xxhash.xxh3_128_digest(own.tobytes()), id_))
            new = first[-1] == id_
            words.append(own.tobytes() if new else None)
            keys.append(first_keys(own).view(np.int64) if new else None)
        arrays = [pa.array(first, pa.int64()), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "id")), *arrays], ["doc_id", "text_hash", "id", "first", "words", "keys"])


class _Going:
    """A text that failed against leaders of a pass: which of its k-mers none of them has."""

    def __init__(self, id_: int, words: np.ndarray, alive: bytes | None):
        self.id, self.words, self.found = id_, words, kmers(words.astype(np.uint64))
        self.alive = np.ones(len(self.found), bool) if alive is None else np.unpackbits(np.frombuffer(alive, np.uint8), count=len(self.found)).astype(bool)

    def fail(self, leader: np.ndarray) -> None:
        self.alive &= ~np.isin(self.found, kmers(leader.astype(np.uint64)))


def _checked(number: int):
    """Rows (id, leader, open, tried, wa, alive, wb), those of an id together, to links and to the texts that go on to pass `number`. What was tried has failed."""
    names = ["id", "leader", "similarity", "keys", "words", "alive"]

    def batch(links: list[tuple], going: list[_Going]) -> pa.RecordBatch:
        ids, leaders, found = ([x[k] for x in links] for k in range(3))
        no, none = [None] * len(going), [None] * len(links)
        keys = [later_keys(g.found, g.alive, len(g.words), number).view(np.int64) for g in going]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids + [g.id for g in going], pa.int64()), pa.array(leaders + no, pa.int64()), pa.array(found + no, pa.float64()), pa.array(none + keys, pa.list_(pa.int64())),
                pa.array(none + [g.words.tobytes() for g in going], pa.binary()), pa.array(none + [np.packbits(g.alive).tobytes() for g in going], pa.binary()),
            ],
            names,
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Going | None = None
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                links, going = [], []
                part = whole.slice(k, 512)
                for id_, leader, is_open, tried, wa, alive, wb in zip(*(part.column(c).to_pylist() for c in ("id", "leader", "open", "tried", "wa", "alive", "wb")), strict=True):
                    a, b = np.frombuffer(wa, "<u4"), np.frombuffer(wb, "<u4")
                    found = -1.0 if tried else similarity(a, b)
                    if found >= 0:
                        links.append((id_, leader, found))
                    elif is_open:
                        if last is None or last.id != id_:
                            going += [last] if last else []
                            last = _Going(id_, a, alive)
                        last.fail(b)
                yield batch(links, going)
        yield batch([], [last] if last else [])

    return rows


def _pairs(active: DataFrame, scratch: Scratch) -> DataFrame:
    """Of texts (id, keys): each member of a key with its leaders, whether the member is still to be held against others of the key, and
    whether the leader is the one that it shares most keys with."""
    keyed = active.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = scratch.table(shared, "shared")
    middle = (F.col("id") != F.col("low")) & (F.col("id") != F.col("high"))
    leaders = F.when(middle, F.array("low", "high")).when(F.col("id") == F.col("high"), F.array("low")).otherwise(F.array().cast("array<bigint>"))
    met = keyed.join(shared, "key").select("id", F.explode(leaders).alias("leader"), (middle & (F.col("n") >= 4)).alias("open"))
    met = met.groupBy("id", "leader").agg(F.max("open").alias("open"), F.struct(F.count(F.lit(1)), -F.col("leader")).alias("order"))
    pairs = scratch.table(met.select("id", "leader", "open", (F.col("order") == F.max("order").over(Window.partitionBy("id"))).alias("most")), "pairs")
    scratch.drop(shared)
    return pairs


def _aligned(pairs: DataFrame, active: DataFrame, scratch: Scratch, number: int) -> DataFrame:
    """Pairs (id, leader, open, tried) of texts (id, words, alive), checked."""
    # Both sides are the same exchange of the texts by id, so that words are dealt out once; merged at every size.
    texts = active.select("id", "words", "alive").hint("merge")
    met = pairs.join(texts.alias("b"), F.col("leader") == F.col("b.id")).select(pairs["id"], "leader", "open", "tried", F.col("b.words").alias("wb"), F.col("b.alive").alias("alive_b"))
    met = met.alias("p").join(texts.alias("a"), F.col("p.id") == F.col("a.id")).select("p.*", F.col("a.words").alias("wa"), F.col("a.alive").alias("alive")).sortWithinPartitions("id")
    return scratch.table(met.mapInArrow(_checked(number), "id long, leader long, similarity double, keys array<long>, words binary, alive binary"), "checked")


def _apart(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """The pairs (id, leader, and more) of which no class has both."""
    a, b = (member.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("id", "leader"))
    met = pairs.join(a, "id", "left").join(b, "leader", "left")
    return met.where(F.coalesce("root_id", "id") != F.coalesce("root_leader", "leader")).select(pairs.columns)


def _links(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The rows (doc_id, text_hash, id, first), the firsts (id, words, alive), and tables of links (a, b) between firsts or from classes' roots to them.

    In the first pass each text is held against the leader that it shares most keys with, and the classes that these links
    make are found. Pairs inside a class need no alignment, there and in the passes that follow.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("id"))
    made = scratch.table(source.mapInArrow(_first, "doc_id long, text_hash long, id long, first long, words binary, keys array<long>"), "first")
    firsts = made.where("keys IS NOT NULL").select("id", "words", "keys", F.lit(None).cast("binary").alias("alive"))
    active, pairs, number = firsts, _pairs(firsts, scratch), 1
    checked = _aligned(pairs.where("most").select("id", "leader", F.lit(False).alias("open"), F.lit(False).alias("tried")), active, scratch, number)
    member = scratch.table(components(checked.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")), scratch), "member")
    scratch.drop(checked)
    links = [member.select(F.col("root").alias("a"), F.col("node").alias("b"))]
    while number == 1 or not active.isEmpty():
        pairs = pairs if number == 1 else _pairs(active, scratch)
        apart = _apart(pairs.select("id", "leader", "open", (F.col("most") & (number == 1)).alias("tried")).where("open OR NOT tried"), member)
        checked = _aligned(scratch.table(apart, "apart"), active, scratch, number)
        links.append(scratch.table(checked.where("similarity IS NOT NULL").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")), "links"))
        going = scratch.table(checked.where("keys IS NOT NULL").select("id", "words", "keys", "alive").dropDuplicates(["id"]), "going")
        scratch.drop_all_but(made, member, going, *links)
        active, number = going, number + 1
    scratch.drop(active)
    return made.select("doc_id", "text_hash", "id", "first"), firsts.select("id", "words", "alive"), links


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up, byte by byte: all lowest bytes, then all second ones, as many as the largest has."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    """The n numbers that _narrow was given."""
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<i8").ravel()


def _dealt(k: int, parts: int):
    """Texts (id, root, words) to their k-mers (and the keys of short texts), dealt into parts: of each batch and part the keys' low halves, ids and roots."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, of, roots = [np.zeros(0, np.uint64)], [], batch.column("root").to_numpy()
            for words in batch.column("words").to_pylist():
                own = np.frombuffer(words, "<u4").astype(np.uint64)
                short = shortened(own) if k > 1 else own[:0]
                for found, first in ((kmers(own, k) if len(own) >= 4 * SHORT // 5 else own[:0], 0), (short, parts)):
                    part = (found >> np.uint64(40)) % np.uint64(parts) + np.uint64(first)
                    keys.append(part << np.uint64(32) | found & np.uint64(2**32 - 1))
                of.append(len(keys[-2]) + len(keys[-1]))
            keys, of = np.concatenate(keys), np.repeat(np.arange(len(of)), np.array(of, np.int64))
            part = (keys >> np.uint64(32)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            low, part, ids, roots = keys[by].astype("<u4"), part[by], batch.column("id").to_numpy()[of[by]], roots[of[by]]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            cuts = list(zip(starts, np.append(starts[1:], len(part)), strict=True))
            arrays = [[low[a:b].tobytes() for a, b in cuts], [_narrow(ids[a:b]) for a, b in cuts], [_narrow(ids[a:b] ^ roots[a:b]) for a, b in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.array(x, pa.binary()) for x in arrays)], ["part", "low", "ids", "roots"])

    return rows


def _repeated(table: pa.Table) -> pa.Table:
    """The keys of a part that texts of two classes or more have, with their texts and how many these are."""
    low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
    ids, roots = (np.concatenate([_widened(x, len(n)) for x, n in zip(table.column(c).to_pylist(), low, strict=True)]) for c in ("ids", "roots"))
    low = np.concatenate(low)
    by = np.argsort(low)
    low, ids, roots = low[by], ids[by], (ids ^ roots)[by]
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.append(starts, len(low)))
    kept = np.repeat(np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts), size)
    size = np.repeat(size, size)[kept].astype(np.int64)
    return pa.table({"key": low[kept].astype(np.int64) | table.column("part")[0].as_py() << 32, "id": ids[kept], "size": size})


def _shared(n: F.Column, k: int) -> tuple[F.Column, F.Column]:
    """shared_least and shared_rare of a column."""
    least = F.least(*(m - k + 1 - k * F.floor(m / 5) for m in (n, F.ceil(n / 5) * 5)))
    return least, F.least(8 + F.floor(n / 32), least)


def _unmet(texts: DataFrame, roots: DataFrame, k: int, parts: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (id, leader) of texts of different classes that may be linked, and the ids of texts that share a rare key with more than `most`.

    roots: of each text that is asked for id, n (its words) and root (its class). A text's keys that no other class has are
    put first: where these are too many, it has no link. Of the others as many stay as the rarest ones may still be.
    """
    asked = texts.join(roots.select("id", "root"), "id").select("id", "root", "words")
    dealt = asked.mapInArrow(_dealt(k, parts), "part long, low binary, ids binary, roots binary")
    found = scratch.table(dealt.groupBy("part").applyInArrow(_repeated, "key long, id long, size long"), "repeated")
    short, own, same = F.col("key") >= parts << 32, Window.partitionBy("id", "short"), Window.partitionBy("key")
    least, rare = _shared(F.col("n"), k)
    ranked = found.join(roots, "id").withColumn("short", short).withColumns({"place": F.row_number().over(own.orderBy("size", "key")), "repeated": F.count(F.lit(1)).over(own)})
    met = ranked.where(F.col("short") | (F.col("place") <= F.col("repeated") + rare - least))
    met = met.withColumns({"low": F.min("root").over(same), "high": F.max("root").over(same)}).where("low < high")
    met = met.withColumns({"main": F.mode("root").over(same), "met": F.count(F.lit(1)).over(same)})
    met = scratch.table(met.select("key", "id", "n", "root", "main", "met", "short", F.ceil(F.col("met") / COMMON).cast("int").alias("cuts")), "met")
    many = ~F.col("short") & (F.col("met") > most)
    # Of two classes one at least isn't the key's largest: its texts are held against all. A large key is cut into as many tasks.
    a = met.where(~many & (F.col("root") != F.col("main"))).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).alias("a")
    b = met.where(~many).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).alias("b")
    apart = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))
    near = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cut") == F.col("b.cut")) & apart & near)
    need = F.when(F.col("a.short"), 1).otherwise(_shared(F.least("a.n", "b.n"), k)[1])
    pairs = both.select(F.least("a.id", "b.id").alias("leader"), F.greatest("a.id", "b.id").alias("id"), need.cast("int").alias("need"))
    pairs = pairs.groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need")
    pairs = scratch.table(pairs.select("id", "leader"), "unmet")
    others = scratch.table(met.where(many).select("id").distinct(), "many")
    scratch.drop(found, met)
    return pairs, others


def _rest(texts: DataFrame, member: DataFrame, scratch: Scratch) -> DataFrame:
    """All links between different classes: pairs (a, b) of their roots.

    Two linked texts have so many k-mers in common that some are among the rarest of both; where such a k-mer is common,
    so many words that some are among the rarest words. Short texts have the keys of all that is left of them.
    """
    roots = texts.select("id", F.floor(F.length("words") / 4).cast("int").alias("n"), F.xxhash64("words").alias("hash")).join(member.withColumnRenamed("node", "id"), "id", "left")
    roots = roots.withColumn("root", F.coalesce("root", "id")).groupBy("root", "hash").agg(F.min("id").alias("id"), F.min("n").alias("n"))  # copies once
    roots = scratch.table(roots.select("id", "n", "root"), "roots")
    texts = texts.where("length(words) > 0")
    words = roots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(4 * partitions(texts.sparkSession), words // GROUP)
    pairs, many = _unmet(texts, roots, K, parts, COMMON, scratch)
    alike, _ = _unmet(texts.join(many, "id", "left_semi"), roots, 1, parts, 2**62, scratch)
    pairs = scratch.table(pairs.union(alike).distinct().withColumns({"open": F.lit(False), "tried": F.lit(False)}), "pairs")
    found = _aligned(pairs, texts, scratch, 1).where("similarity IS NOT NULL")
    a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(r)) for c, r in (("id", "a"), ("leader", "b")))
    return scratch.table(found.join(a, "id").join(b, "leader").select("a", "b"), "rest")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The connected components of edges (a, b): node and root (the least of its component).

    Alternates the large-star and the small-star step until no edge changes; each step's edges are written, so that the
    lineage stays short and a lost executor costs a step at most.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    own = scratch.table(edges.select("a", "b").where("a != b").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())

    before = mark(own)
    while before[0]:
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b").where("a != b").distinct()
        large = scratch.table(large, "edges")
        scratch.drop(own)
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        root = down.groupBy("u").agg(F.min("v").alias("root"))
        small = down.join(root, "u").select(F.explode(F.array(F.struct("root", F.col("v").alias("b")), F.struct("root", F.col("u").alias("b")))).alias("e"))
        own = scratch.table(small.select(F.col("e.root").alias("a"), F.col("e.b").alias("b")).where("a != b").distinct(), "edges")
        scratch.drop(large)
        now = mark(own)
        if now == before:
            break
        before = now
    members = own.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return members.union(own.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _rooted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each row doc_id, text_hash and root: the id that its class alone has."""
    rows, texts, links = _links(docs, scratch)
    edges = rows.where("first != id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    for part in links:
        edges = edges.union(part)
    member = components(edges, scratch)
    joined = components(_rest(texts, member, scratch), scratch).select(F.col("node").alias("root"), F.col("root").alias("least"))
    found = rows.join(member.withColumnRenamed("node", "id"), "id", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "id"))
    found = found.join(joined, "root", "left").select("doc_id", "text_hash", F.coalesce("least", "root").alias("root"), (F.col("linked") | F.col("least").isNotNull()).alias("linked"))
    out = scratch.table(found, "rooted")
    scratch.drop_all_but(out)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, class_id (the least doc_id of its class), text_hash. Where a doc_id is repeated, several classes may have it."""
    rooted = _rooted(docs, Scratch(docs.sparkSession, "near"))
    name = rooted.where("linked").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = rooted.where("linked").join(name, "root").select("doc_id", "class_id", "text_hash")
    return named.union(rooted.where("NOT linked").select("doc_id", F.col("doc_id").alias("class_id"), "text_hash"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns: that of the least doc_id (of the same doc_id, the least text hash).

    Rows without doc_id stay only in classes without any doc_id. Of rows with the same doc_id and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rooted = _rooted(docs, scratch)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first")
    winners = scratch.table(rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")), "winners")
    unique = rooted.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    scratch.drop(rooted)
    id_, hash_, own = unused(docs, 3)
    marked = docs.withColumn(own, F.xxhash64("text"))
    winners = winners.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    out = marked.join(winners, marked["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)), "left_semi")
    return (out if unique else out.dropDuplicates(["doc_id", own])).drop(own)
