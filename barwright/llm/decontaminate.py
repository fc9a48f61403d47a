"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment (operator 3).

Words are lower-cased and lose punctuation at their ends. The n-grams (N words) of the test items are seeds. Where a seed of
an item meets a document, the passage around is aligned with the item, and the alignment's score as a share of the item's
own decides: SCORE tells a copy, edited or partial, from a chance phrase. A first pass counts the documents that hold each
seed. Of an item's passages in a document the one with the rarest seed is aligned first; one that commoner seeds lead to is
aligned only where it holds enough of the item's words to reach SCORE and what is found already. So rarity decides the order and spares
alignments, but no seed is left out for being common, or the number of copies would decide whether they are found.

The items are taken in blocks of bounded size (BLOCK_CHARS), and each block's seeds go to all tasks; a benchmark beyond
one block takes a pass over the corpus for each block. Documents are never shuffled.

Null and empty texts and items have no words and match nothing; an item of fewer than N words has one seed, all of it.
Rows stay one to one with their matches; repeated rows repeat them. Ties of score go to the earlier passage. A very long
text is read whole, its meetings with seeds in parts. Without documents or items there are no matches, and no document
goes. Columns other than doc_id, item_id and text aren't read; clean_documents passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_text, mixed, runs, slices

N, SCORE = 3, 0.6
#: Characters of test items that go to the tasks at once.
BLOCK_CHARS = 8_000_000
#: Meetings of a seed with a place that are held at once; a text with more takes the items in parts.
MEETINGS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»¿¡“”‘’…–—"
_FACTORS = np.random.default_rng(7).integers(0, 2**63, N + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all texts, and the offsets of each text's words."""
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = [w.lower().strip(PUNCTUATION) for w in coded.dictionary.to_pylist()]
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))
    code = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), offsets - offsets[0]
    full = real[code]
    return known[code[full]], np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]


def ngrams(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of the n-grams of every text; a shorter text with words is an n-gram of its own length."""
    doc = runs(offsets)
    length = np.diff(offsets)
    out = np.zeros(len(words), np.uint64)
    for i in range(N):
        if len(words) > i:
            out[: len(words) - i] += words[i:] * _FACTORS[i]
    place = np.arange(len(words)) - offsets[doc]
    fits = place + N <= length[doc]
    short = np.flatnonzero((length > 0) & (length < N))
    at = offsets[:-1][short]
    whole = np.zeros(len(short), np.uint64)
    for i in range(N - 1):
        has = length[short] > i
        whole[has] += words[at[has] + i] * _FACTORS[i]
    out[at] = whole + length[short].astype(np.uint64) * _FACTORS[N]
    fits[at] = True
    keep = np.flatnonzero(fits)
    return mixed(out[keep]), doc[keep], place[keep]


@dataclass
class Items:
    """The items of a block: their words, and the seeds by hash with the items and places they stand for."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each seed, in item and place; one more for the end
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list) -> Items:
        words, offsets = plain_words(as_text(pa.array(texts, pa.string())))
        hashes, item, place = ngrams(words, offsets)
        order = np.lexsort((place, item, hashes))
        seeds, first = np.unique(hashes[order], return_index=True)
        own = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return cls(ids, own, seeds, np.append(first, len(order)), item[order], place[order])

    def prefilter(self) -> np.ndarray:
        """A fixed table of bits that all seeds set, to pass over most n-grams of a document at once."""
        out = np.zeros(1 << 22, bool)
        out[(self.seeds & np.uint64(len(out) - 1)).astype(np.int64)] = True
        return out


def found_in(items: Items, few: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are seeds: their index, and the seed's."""
    at = np.flatnonzero(few[(hashes & np.uint64(len(few) - 1)).astype(np.int64)])
    if not len(at) or not len(items.seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seed = np.minimum(np.searchsorted(items.seeds, hashes[at]), len(items.seeds) - 1)
    same = items.seeds[seed] == hashes[at]
    return at[same], seed[same]


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The best local score of each (item, passage), and the end of the passage's aligned part."""
    best, end = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        group = [order[at]]
        while at + len(group) < len(order) and (len(group) + 1) * (len(pairs[order[at + len(group)]][1]) + 1) <= 200_000:
            group.append(order[at + len(group)])
        at += len(group)
        rows, columns = max(len(pairs[i][0]) for i in group), max(len(pairs[i][1]) for i in group)
        a, b = np.zeros((len(group), rows), np.uint64), np.ones((len(group), columns), np.uint64)  # 0 and 1: no words
        for k, i in enumerate(group):
            a[k, : len(pairs[i][0])], b[k, : len(pairs[i][1])] = pairs[i]
        h, gaps = np.zeros((len(group), columns + 1), np.int32), -GAP * np.arange(columns + 1, dtype=np.int32)
        top, where = np.zeros(len(group), np.int32), np.zeros(len(group), np.int64)
        for r in range(rows):
            new = np.maximum(h + GAP, 0)
            np.maximum(new[:, 1:], h[:, :-1] + np.where(a[:, r, None] == b, MATCH, MISMATCH), out=new[:, 1:])
            h = np.maximum.accumulate(new + gaps, axis=1) - gaps
            place = h.argmax(1)
            value = h[np.arange(len(group)), place]
            where = np.where(value > top, place, where)
            top = np.maximum(top, value)
        best[group], end[group] = top, where
    return best, end


def reach(item: np.ndarray, passage: np.ndarray) -> float:
    """The share that no alignment passes: it matches no more words than those of the item that the passage holds."""
    return np.isin(item, passage).sum() / len(item)


def met(items: Items, seed: np.ndarray, hit: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each meeting of a seed with a place, as entry of the items and hit; of the items of one part only, where there are more meetings than are held."""
    entries, at = [], []
    counts = np.diff(items.first)[seed]
    for some in np.split(np.arange(len(seed)), np.flatnonzero(np.diff(np.cumsum(counts) // MEETINGS)) + 1):
        n = counts[some]
        entry = np.repeat(items.first[seed[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = items.item[entry] % parts == part
        entries.append(entry[own])
        at.append(np.repeat(hit[some], n)[own])
    return np.concatenate(entries), np.concatenate(at)


def held_seeds(items: Items, few: np.ndarray, texts: pa.Array) -> np.ndarray:
    """How many of the texts hold each seed."""
    hashes, docs, _ = ngrams(*plain_words(texts))
    hit, seed = found_in(items, few, hashes)
    once = np.unique(docs[hit].astype(np.int64) * len(items.seeds) + seed)
    return np.bincount(once % max(1, len(items.seeds)), minlength=len(items.seeds))


def counted(docs: DataFrame, items: Items) -> np.ndarray:
    """How many documents of the corpus hold each seed: a number for each seed of the block, added up in tasks first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, n = items.prefilter(), np.zeros(len(items.seeds), np.int64)
        for batch in slices(batches):
            n += held_seeds(items, few, as_text(batch.column("text")))
        seen = np.flatnonzero(n)
        for k in range(0, len(seen), 100_000):
            part = seen[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["seed", "n"])

    out = np.zeros(len(items.seeds), np.int64)
    got = docs.select("text").mapInArrow(rows, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # a row a seed of the block
    out[got.column("seed").to_numpy()] = got.column("n").to_numpy()
    return out


def matches(items: Items, few: np.ndarray, texts: pa.Array, held: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The (text, item) pairs whose best passage reaches SCORE: text, item, score, and the passage's words from start to end.

    With `held` (documents that hold each seed) the passage of the rarest seed comes first, and others only if they may be better.
    """
    words, offsets = plain_words(texts)
    hashes, docs, places = ngrams(words, offsets)
    hits, seeds = found_in(items, few, hashes)
    sizes, length = np.array([len(w) for w in items.words], np.int64), np.diff(offsets)
    meetings = np.diff(items.first)[seeds]
    first = np.flatnonzero(np.diff(docs[hits], prepend=-1))
    turn = (np.cumsum(meetings) - meetings)[first] // MEETINGS
    cuts = np.append(first[np.flatnonzero(np.diff(turn, prepend=-1))], len(hits))
    best: dict = {}
    parts_of = [1 + int(meetings[x:y].sum()) // (2 * MEETINGS) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    for x, y, part, parts in [(cuts[k], cuts[k + 1], part, n) for k, n in enumerate(parts_of) for part in range(n)]:
        entry, hit = met(items, seeds[x:y], hits[x:y], part, parts)
        doc, item = docs[hit], items.item[entry]
        size, low = sizes[item], places[hit] - items.place[entry]
        spare = size // 4 + 2
        low, high = np.maximum(low - spare, 0), np.minimum(low + size + spare, length[doc])
        order = np.lexsort((low, item, doc))
        rare = np.zeros(len(doc), np.int64) if held is None else held[np.searchsorted(items.first, entry, "right") - 1][order]
        doc, item, low, high = doc[order], item[order], low[order], high[order]
        names, last = [], []
        for d, i, a, b, r in zip(doc.tolist(), item.tolist(), low.tolist(), high.tolist(), rare.tolist(), strict=True):
            if last and last[:2] == [d, i] and a <= last[3]:
                last[3], last[4] = max(last[3], b), min(last[4], r)
            else:
                names.append(last := [d, i, a, b, r])
        passage = lambda n: words[offsets[n[0]] + n[2] : offsets[n[0]] + n[3]]
        names = [(*n, most) for n in names if (most := reach(items.words[n[1]], passage(n))) >= SCORE - 1e-9]
        firsts, others = names, []
        if held is not None:
            names.sort(key=lambda n: (n[0], n[1], n[4], n[2]))
            new = [k == 0 or names[k][:2] != names[k - 1][:2] for k in range(len(names))]
            firsts, others = [n for n, x in zip(names, new, strict=True) if x], [n for n, x in zip(names, new, strict=True) if not x]
        for turn in (firsts, others):
            some = [n for n in turn if n[5] >= best.get(n[:2], (0,))[0] - 1e-9]
            score, end = smith_waterman([(items.words[n[1]], passage(n)) for n in some])
            for (d, i, a, *_), s, e in zip(some, score.tolist(), end.tolist(), strict=True):
                share = s / (MATCH * len(items.words[i]))
                before = best.get((d, i), (0, 0))
                if share >= SCORE and (share, -a) > (before[0], -before[1]):
                    best[d, i] = (share, a, a + e)
    # The start of the best alignment is the end of the best one backwards from its end.
    back = [(items.words[i][::-1], words[offsets[d] + a : offsets[d] + e][::-1]) for (d, i), (_, a, e) in best.items()]
    _, length_of = smith_waterman(back)
    best = {k: (share, e - n, e) for (k, (share, _, e)), n in zip(best.items(), length_of.tolist(), strict=True)}
    return {
        "text": np.array([k[0] for k in best], np.int64), "item": np.array([k[1] for k in best], np.int64), "score": np.array([v[0] for v in best.values()], float),
        "start": np.array([v[1] for v in best.values()], np.int64), "end": np.array([v[2] for v in best.values()], np.int64),
    }


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items with their seeds, in blocks of bounded size."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("text != ''")
    whole = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-whole // BLOCK_CHARS)
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        block = Items.of([r.item_id for r in got], [r.text for r in got])
        if len(block.seeds):
            yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold an item: doc_id, item_id, score and the passage's words from start_word to end_word."""
    spark, source = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    kind = dict(benchmark.dtypes)["item_id"]
    out = None
    for block in blocks(benchmark):
        held = counted(source, block)

        def rows(batches: Iterator[pa.RecordBatch], block: Items = block, held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            few = block.prefilter()
            for batch in slices(batches):
                m = matches(block, few, as_text(batch.column("text")), held)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(m["text"])), "item_id": [block.ids[i] for i in m["item"]], "score": m["score"],
                        "start_word": m["start"], "end_word": m["end"],
                    },
                    pa.schema([("doc_id", pa.int64()), ("item_id", item_type), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]),
                )

        item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
        part = source.mapInArrow(rows, f"doc_id long, item_id {kind}, score double, start_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id long, item_id {kind}, score double, start_word long, end_word long")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Any passage that reaches SCORE decides, so none comes first and seeds aren't counted."""
    out, schema = docs, docs.schema
    for block in blocks(benchmark):

        def rows(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            few = block.prefilter()
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[matches(block, few, as_text(batch.column("text")))["text"]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(rows, schema)
    return out
