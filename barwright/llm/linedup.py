"""Line dedup by a sharded minimal perfect hash (operator 9).

A line's key is the line without white space (the six ASCII characters) at its ends and with A-Z in lower case. The
128-bit digests of all keys are counted, once a document, by a grouping with partial sums. The digests met in as many
documents as the limit says are dealt into shards (the others need no slot, and there are far more of them); each shard is indexed by a minimal perfect hash (levels of bit arrays: a key that
is alone at its bit stays, the others go to the next level), which gives each key a slot of a fingerprint array and a
count array. Documents then probe the arrays and drop the lines whose count reaches the limit; lines are not joined.

A key below the limit has no slot: a probe of it meets another key's slot, where the fingerprint (64 bits apart from
the 64 that are hashed) doesn't agree, and it counts as 1. Where the index is larger than a worker keeps, texts are probed
in large slices, so that a shard is read once for many texts.

Null or empty text: one empty line, which has no key and stays. Repeated rows are documents of their own. An empty
table gives an empty index. Columns that aren't needed pass through unread, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SPACES, Scratch, as_text, mixed, new_folder, runs, slices

#: Keys of a shard, about; bits of a level for each of its keys; levels before what is left is listed.
SHARD_KEYS, GAMMA, LEVELS = 500_000, 2, 40
#: Bytes of shards that a worker keeps loaded.
KEPT_BYTES = 96 << 20
#: Bytes of a shard for each of its keys, about; bytes of text that are probed at once where the index isn't kept whole.
KEY_BYTES, PROBED_BYTES = 13, 32 << 20


class PerfectHash:
    """A minimal perfect hash of 64-bit keys with a fingerprint and a count for each."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, rest: np.ndarray):
        self.levels, self.prints, self.counts, self.rest = levels, prints, counts, rest
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        base, self.ranks = 0, []
        for x in ones:
            self.ranks.append(base + np.concatenate(([0], np.cumsum(x)[:-1])) if len(x) else np.zeros(0, np.int64))
            base += int(x.sum())
        self.placed = base

    @staticmethod
    def seeded(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mixed(keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(keys))
        while len(left) and len(levels) < LEVELS:
            words = -(-GAMMA * len(left) // 64)
            at = cls.seeded(keys[left], len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        made = cls(levels, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.sort(keys[left]))
        slot = made.slots(keys)
        # Keys that no level parts (equal 64 bits) share the listed slot of their first; there the greater count is kept.
        size = made.placed + len(made.rest)
        made.prints, made.counts = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
        order = np.argsort(counts, kind="stable")
        made.prints[slot[order]], made.counts[slot[order]] = prints[order], counts[order]
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that isn't of the set, -1 or any slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = self.seeded(keys[left], level, len(bits) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            out[left[hit]] = ranks[w] + np.bitwise_count(bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.placed + at[same]
        return out

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key; 1 where the fingerprint says that it has no slot."""
        if not len(self.counts):
            return np.ones(len(keys), np.int64)
        slot = self.slots(keys)
        found = (slot >= 0) & (self.prints[slot] == prints)
        return np.where(found, self.counts[slot], 1).astype(np.int64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        out.write(struct.pack("<QQQ", len(self.levels), len(self.counts), len(self.rest)))
        out.write(np.array([len(x) for x in self.levels], "<u8").tobytes())
        for x in [*self.levels, self.rest, self.prints, self.counts]:
            out.write(x.tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n, size, rest = struct.unpack_from("<QQQ", data)
        at = 24 + 8 * n
        arrays = []
        for kind, count in [*(("<u8", int(x)) for x in np.frombuffer(data, "<u8", n, 24)), ("<u8", rest), ("<u8", size), ("<u4", size)]:
            arrays.append(np.frombuffer(data, kind, count, at))
            at += arrays[-1].nbytes
        return cls(arrays[:n], arrays[n + 1], arrays[n + 2], arrays[n])


class Shards:
    """The shards of an index, loaded when first probed, the least used dropped beyond KEPT_BYTES."""

    def __init__(self, folder: str, n: int):
        from pyarrow import fs

        self.store, self.where = fs.FileSystem.from_uri(folder)
        self.n, self.kept, self.bytes = n, OrderedDict(), 0

    def of(self, shard: int) -> PerfectHash:
        if shard not in self.kept:
            with self.store.open_input_stream(f"{self.where}/{shard:06d}.mph") as source:
                data = source.read()
            self.kept[shard] = (PerfectHash.load(data), len(data))
            self.bytes += len(data)
            while self.bytes > KEPT_BYTES and len(self.kept) > 1:
                self.bytes -= self.kept.popitem(last=False)[1][1]
        self.kept.move_to_end(shard)
        return self.kept[shard][0]

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), np.int64)
        if not self.n:
            return out
        shard = keys % np.uint64(self.n)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                out[part] = self.of(int(shard[part[0]])).count(keys[part], prints[part])
        return out


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines; the offsets of each text's lines; the code points of each line's key and the two halves of its digest."""
    import xxhash

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    coded = pc.ascii_lower(pc.ascii_trim(lines, SPACES)).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in coded.dictionary.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if not len(digests):
        return lines, offsets - offsets[0], np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return lines, offsets - offsets[0], length[code], digests[code, 0], digests[code, 1]


def build_index(docs: DataFrame, least_docs: int = 2, least_chars: int = 1) -> tuple[str, int]:
    """Counts the documents of each key and writes the index of those in `least_docs` or more; returns its folder and number of shards."""
    spark = docs.sparkSession

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, offsets, length, a, b = keys_of(as_text(batch.column("text")))
            doc, keep = runs(offsets), length >= least_chars
            order = np.lexsort((b, a, doc))
            order = order[keep[order]]
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(doc[order]) != 0) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            one = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(a[one].view(np.int64)), pa.array(b[one].view(np.int64))], ["a", "b"])

    counted = docs.select("text").mapInArrow(digests, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    scratch = Scratch(spark, "line")
    counted = scratch.table(counted, "counts")
    keys = counted.count()
    folder, n = new_folder(spark, "line-index"), -(-keys // SHARD_KEYS)

    def build(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(folder)
        shard = group.column("shard")[0].as_py()
        a, b, count = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
        data = PerfectHash.build(a.view(np.uint64), b.view(np.uint64), np.minimum(count, 2**32 - 1).astype(np.uint32)).dump()
        store.create_dir(where)
        spare = f"{where}/_{shard:06d}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(spare) as out:
            out.write(data)
        store.move(spare, f"{where}/{shard:06d}.mph")
        return pa.table({"shard": pa.array([shard], pa.int32())})

    if n:
        # The shard of a digest's first half, taken as unsigned.
        shard = F.pmod(F.pmod("a", F.lit(n)) + F.when(F.col("a") < 0, F.lit(2**64 % n)).otherwise(F.lit(0)), F.lit(n)).cast("int")
        written = counted.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int").count()
        if written < n:  # a shard without keys has no file
            have = {r.shard for r in counted.select(shard.alias("shard")).distinct().collect()}
            raise RuntimeError(f"shards without keys: {sorted(set(range(n)) - have)[:5]}")
    scratch.drop(counted)
    return folder, n


def probed_bytes(n: int) -> int:
    """Bytes of text that are probed at once against n shards."""
    return SLICE_BYTES if n * SHARD_KEYS * KEY_BYTES <= KEPT_BYTES else PROBED_BYTES


def _probed(folder: str, n: int, least_docs: int, least_chars: int):
    """A function from texts to the lines kept of each: (texts, lines each, lines dropped each)."""
    shards = Shards(folder, n)

    def of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        lines, offsets, length, a, b = keys_of(texts)
        drop = (length >= least_chars) & (shards.count(a, b) >= least_docs)
        dropped = np.diff(np.concatenate(([0], np.cumsum(drop)))[offsets])
        kept = lines.filter(pa.array(~drop)).to_pylist()
        ends = np.cumsum(np.diff(offsets) - dropped)
        return ["\n".join(kept[e - k : e]) for e, k in zip(ends.tolist(), (np.diff(offsets) - dropped).tolist(), strict=True)], np.diff(offsets), dropped

    return of


def line_report(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, with_text: bool = False) -> DataFrame:
    """Of each row: doc_id, n_lines, n_dropped, kept_sha256 (with_text: also kept_text)."""
    folder, n = build_index(docs, least_docs, least_chars)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _probed(folder, n, least_docs, least_chars)
        for batch in slices(batches, probed_bytes(n)):
            kept, lines, dropped = probe(as_text(batch.column("text")))
            out = {"doc_id": batch.column("doc_id"), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in kept]}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": kept} if with_text else {}))

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def drop_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """The rows of docs with the common lines gone from text (and n_chars, where there is such a column, counted anew).

    A text that loses no line stays as it is, null included.
    """
    folder, n = build_index(docs, least_docs, least_chars)
    names, schema = docs.columns, docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _probed(folder, n, least_docs, least_chars)
        for batch in slices(batches, probed_bytes(n)):
            kept, _, dropped = probe(as_text(batch.column("text")))
            text = pc.if_else(pa.array(dropped > 0), pa.array(kept, pa.string()), pc.cast(batch.column("text"), pa.string()))
            arrays = dict(zip(names, batch.columns, strict=True)) | {"text": text}
            if "n_chars" in arrays:
                arrays["n_chars"] = pc.if_else(pa.array(dropped > 0), pc.cast(pc.utf8_length(text), batch.column("n_chars").type), batch.column("n_chars"))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return docs.mapInArrow(rows, schema)
