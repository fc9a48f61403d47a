"""Removal of long repeated byte strings by sorted suffixes (operator 6).

Every byte covered by a WIDTH-byte string that also starts elsewhere (other document or the same) goes.

1. A window is a WIDTH-byte string; its anchor is the K-byte gram in it of least hash, the first of equal ones. Equal
   windows have equal anchors. Each run of windows around one anchor is a segment; the anchors' runs are counted over the corpus.
2. Segments whose anchor has two runs or more are kept (a fixed-size bitmap tells them; what it lets through in error
   costs time only). Equal segments are grouped, with partial sums: where two are equal, all their windows are repeated.
3. The distinct segments are dealt by anchor, and the suffixes in them sorted deep-shallow: multikey quicksort over
   eight-byte characters to a shallow depth, then blind tries for groups with a longer common prefix. Neighbours with a
   common prefix of WIDTH bytes are repeated windows. An anchor with more than HOT distinct segments would be one large
   group: its windows are dealt singly, by content, and grouped with partial sums instead.
4. The repeated ranges meet the documents again by doc_id and text hash, and the bytes between them are kept.

A null text is empty; texts under WIDTH bytes lose nothing; repeated rows are copies of each other. Removed ranges are
byte offsets of the text as it was. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, bitmap, bits_for_keys, in_bitmap, mixed, slices, table, with_spans
from .quality import bytes_of

WIDTH, K = 200, 100
#: Bytes of the shallow sort; windows handled at a time; distinct segments of an anchor that one task takes.
SHALLOW, PIECE, HOT = 32, 1 << 20, 2_000

#: The bits that hold a place within a piece.
LOW = np.uint64((1 << 21) - 1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1][:n]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1))
    full[: len(x)] = x
    cut = full.reshape(-1, w)
    ahead = np.minimum.accumulate(cut, axis=1).ravel()
    back = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of windows around one anchor: document, first and last window (places in data), and anchor."""
    for at in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
        part = data[at : at + PIECE + WIDTH - 1]
        grams = rolling(part, K)
        # The least hash of a window, and of equal ones the first: the place stands in the low bits.
        least = sliding_least((grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), WIDTH - K + 1)
        anchor = grams[(least & LOW).astype(np.int64)]
        place = np.arange(at, at + len(anchor))
        doc = np.searchsorted(offsets, place, side="right") - 1
        inside = place + WIDTH <= offsets[doc + 1]
        starts = np.ones(len(anchor), bool)
        starts[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(starts & inside)
        stop = np.append(np.flatnonzero(starts), len(anchor))
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        # A run's windows that reach into the next document don't count.
        last = np.minimum(last, offsets[doc[first] + 1] - WIDTH - at)
        yield doc[first], place[first], at + last, anchor[first]


def utf8(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return bytes_of(as_text(batch.column("text")))


class BlindTrie:
    """Strings of equal length in a trie that stores, for each branch, its depth and the byte that tells the children apart.

    A string is put in by going down blind, along the bytes at the branches; comparing it with one leaf below finds where
    it truly parts, and the branch is set there.
    """

    def __init__(self, first: int, text: bytes):
        self.root: list = [None, first]  # a leaf; a branch is [depth, {byte: node}]
        self.texts = {first: text}
        self.same: dict[int, list[int]] = {first: []}  # further strings equal to a leaf's

    def put(self, name: int, text: bytes) -> None:
        node, path = self.root, []
        while node[0] is not None:
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        leaf = node[1]
        other = self.texts[leaf]
        if other == text:
            self.same[leaf].append(name)
            return
        a, b = np.frombuffer(other, np.uint8), np.frombuffer(text, np.uint8)
        depth = int(np.argmax(a != b))
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        self.texts[name], self.same[name] = text, []
        if node[0] == depth:
            node[1][text[depth]] = [None, name]
            return
        branch = [depth, {other[depth]: node, text[depth]: [None, name]}]
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and the length of each one's common prefix with the one before (-1 at the first)."""
        names, common, stack, depth = [], [], [(self.root, -1)], -1
        while stack:
            node, lcp = stack.pop()
            if node[0] is None:
                whole = len(self.texts[node[1]])
                names += [node[1], *self.same[node[1]]]
                common += [lcp, *[whole] * len(self.same[node[1]])]
            else:
                depth = node[0]
                children = [node[1][b] for b in sorted(node[1])]
                stack += [(c, depth) for c in reversed(children[1:])] + [(children[0], lcp)]
        return names, common


def deep_shallow(data: np.ndarray, starts: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of `width` bytes at `starts`, and each one's common prefix with the one before.

    Shallow: multikey quicksort, a level at a time for all groups together: each group is sorted by its next eight bytes,
    and only strings equal in them go on to the next level. Deep: a blind trie for each group that is still tied.
    Common prefixes are exact where they are of `shallow` bytes or more, and 0 elsewhere.
    """
    n = len(starts)
    order, common = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # of each place in order; places of a group are together
    active = np.arange(n)  # places in order that are in a group of two or more
    for depth in range(0, min(shallow, width - 7), 8):
        if not len(active):
            return order, common
        own = order[active]
        char = np.zeros(len(own), np.uint64)
        for k in range(8):
            char = (char << np.uint64(8)) | data[starts[own] + depth + k]
        by = np.lexsort((char, group[active]))
        order[active] = own[by]
        char, g = char[by], group[active]
        new = np.ones(len(active), bool)
        new[1:] = (char[1:] != char[:-1]) | (g[1:] != g[:-1])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    bounds = np.flatnonzero(np.diff(group[active])) + 1 if len(active) else np.zeros(0, int)
    raw = data.tobytes()
    for places in np.split(active, bounds):
        if not len(places):
            continue
        names = order[places].tolist()
        trie = BlindTrie(names[0], raw[starts[names[0]] : starts[names[0]] + width])
        for name in names[1:]:
            trie.put(name, raw[starts[name] : starts[name] + width])
        order[places], own = trie.ordered()
        common[places[1:]] = own[1:]
    return order, common


def repeated_windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at each place where a window starts, inside one segment, that also starts at another place."""
    n = len(data) - WIDTH + 1
    out = np.zeros(max(len(data), 0), bool)
    if n <= 0:
        return out
    prints = rolling(data, WIDTH)
    place = np.arange(n)
    inside = place + WIDTH <= offsets[np.searchsorted(offsets, place, side="right")]
    place = place[inside]
    # Windows whose fingerprint is alone differ from all others; only the rest are sorted.
    order = np.argsort(prints[place], kind="stable")
    same = prints[place][order][1:] == prints[place][order][:-1]
    tied = np.append(same, False) | np.insert(same, 0, False)
    starts = np.sort(place[order[tied]])
    order, common = deep_shallow(data, starts, WIDTH)
    hit = np.flatnonzero(common >= WIDTH)
    out[starts[order[hit]]] = True
    out[starts[order[hit - 1]]] = True
    return out


def ranges(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of true flags inside the parts between offsets: part, first place in it, last place in it."""
    at = np.flatnonzero(flags)
    part = np.searchsorted(offsets, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(part) > 0)
    end = np.append(new[1:], True)[: len(at)]
    first, last = at[new], at[end]
    return part[new], first - offsets[part[new]], last - offsets[part[new]]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """The repeated windows' ranges: doc_id, text_hash, first, last (byte places where repeated windows start)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            for _, _, _, anchor in runs_of(*utf8(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    counted = source.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    counted = table(counted.where("n > 1").select("anchor"), "anchors")
    few = bitmap(counted, "anchor", bits_for_keys(counted.count()))
    sent = spark.sparkContext.broadcast(few)  # of bounded size

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = sent.value
        for batch in slices(batches, 2 << 20):
            data, offsets = utf8(batch)
            raw = data.tobytes()
            for doc, first, last, anchor in runs_of(data, offsets):
                hit = np.flatnonzero(in_bitmap(known, anchor))
                doc, first, last = doc[hit], first[hit], last[hit]
                parts = [raw[a : b + WIDTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                digests = [xxhash.xxh3_128_digest(p) for p in parts]
                seen: set = set()
                for k, d in enumerate(digests):  # the bytes of equal segments go once a piece
                    if d in seen:
                        parts[k] = None
                    seen.add(d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), batch.column("text_hash").take(pa.array(doc)), pa.array(anchor[hit].view(np.int64)), pa.array(digests, pa.binary()), pa.array(first - offsets[doc], pa.int64()), pa.array(last - first, pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "text_hash", "anchor", "segment", "first", "more", "bytes"],
                )

    found = source.mapInArrow(segments, "doc_id long, text_hash long, anchor long, segment binary, first long, more long, bytes binary")
    found = table(found, "segments")
    hot = found.groupBy("anchor", "segment").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = table(hot.select("anchor"), "hot-anchors")
    distinct = found.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.first("bytes", ignorenulls=True).alias("bytes"))
    any_hot = not hot.isEmpty()

    kept = distinct.join(hot, "anchor", "left_anti") if any_hot else distinct
    dealt = kept.repartition("anchor").sortWithinPartitions("anchor")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_anchor(batches):
            data = np.frombuffer(b"".join(whole.column("bytes").to_pylist()), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in whole.column("bytes").to_pylist()]))).astype(np.int64)
            flags = repeated_windows(data, offsets)
            many = np.flatnonzero(whole.column("copies").to_numpy(zero_copy_only=False) > 1)
            for k in many:
                flags[offsets[k] : offsets[k + 1] - WIDTH + 1] = True
            part, first, last = ranges(flags, offsets)
            yield pa.RecordBatch.from_arrays([whole.column("segment").take(pa.array(part)), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["segment", "low", "high"])

    spans = dealt.mapInArrow(sort, "segment binary, low long, high long")
    if any_hot:

        def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for segment, copies, text in zip(*(batch.column(c).to_pylist() for c in ("segment", "copies", "bytes")), strict=True):
                    n = len(text) - WIDTH + 1
                    digests = [xxhash.xxh3_128_digest(text[k : k + WIDTH]) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * n, pa.binary()), pa.array(np.arange(n)), pa.array(digests, pa.binary()), pa.array([copies] * n, pa.int64())], ["segment", "low", "window", "copies"])

        windows = distinct.join(hot, "anchor", "left_semi").mapInArrow(singly, "segment binary, low long, window binary, copies long")
        windows = table(windows, "hot-windows")
        again = table(windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window"), "hot-repeats")
        spans = spans.unionByName(windows.join(again, "window").select("segment", "low", F.col("low").alias("high")))
    spans = table(spans, "repeated-spans")
    # `segment` is a digest of all its bytes, so it alone joins; ranges are moved to the documents' own places.
    return found.drop("bytes").join(spans, "segment").select("doc_id", "text_hash", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("last"))


def by_anchor(batches: Iterator[pa.RecordBatch], least: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Batches cut only between anchors; the input is sorted by anchor."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(b.num_rows for b in rest) < least:
            continue
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        anchor = whole.column("anchor").to_numpy()
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        if not len(cuts):
            continue
        at = 0
        while at < cuts[-1]:
            end = int(cuts[min(np.searchsorted(cuts, at + least), len(cuts) - 1)])
            yield whole.slice(at, end - at)
            at = end
        rest = [whole.slice(at)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def cut(text: bytes, firsts: list[int], lasts: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the bytes of the windows that start in the ranges, and the maximal removed runs (start, end)."""
    removed: list[list[int]] = []
    for a, b in sorted(zip(firsts, lasts, strict=True)):
        if removed and a <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], b + WIDTH)
        else:
            removed.append([a, b + WIDTH])
    out, at = [], 0
    for a, b in removed:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), [(a, b) for a, b in removed]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Of each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: also kept bytes and the removed runs)."""
    both = with_spans(docs, repeated_ranges(docs), ["first", "last"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")}
            for text, firsts, lasts in zip(*(batch.column(c).to_pylist() for c in ("text", "first", "last")), strict=True):
                raw = (text or "").encode()
                kept, removed = cut(raw, firsts or [], lasts or [])
                for c, v in zip(out, (len(raw), len(raw) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in removed]), strict=True):
                    out[c].append(v)
            arrays = [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays += [pa.array(out["kept"], pa.binary()), pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start: long, end: long>>" * with_text
    return both.mapInArrow(rows, schema)
