"""Substring dedup by hashed lines or paragraphs (operator 7).

A text is cut into units: lines, paragraphs (parted by blank lines) or, where passages begin and end inside lines,
sentences (lines cut further after . ! or ? before white space). A unit is normalised (lower case, its words parted by one
space) and hashed; units of fewer than LEAST_WORDS words aren't judged, for a heading or a closing formula isn't a
passage. Digests are grouped over the corpus with partial sums; the occurrence of least rank stays (by doc_id, then text
hash, then place; a null doc_id comes last), and the others are removed from their texts. Removed spans are code points
of the text as it was, from start to end. White space is the six ASCII characters.

A null or empty text has no units; all units of a very long one are judged; an empty table gives no rows. Rows that share doc_id and text count as one document and get the same result.
Only digests met twice or more come back to the documents, through a bitmap of bounded size. Columns other than doc_id
and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bits_for_keys, in_bitmap, slices, table, with_spans

LEAST_WORDS = 12
UNITS = {
    "paragraph": re.compile(r"[^ \t-\r](?:(?!\n[ \t]*\n).)*", re.S),
    "line": re.compile(r"[^\n]*[^ \t-\r][^\n]*"),
    "sentence": re.compile(r"[^ \t-\r](?:(?![.!?][ \t-\r])[^\n])*[.!?]?"),
}
WORD = re.compile(r"[^ \t-\r]+")


def units_of(text: str, unit: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """Start, end and digest of the units that are judged."""
    import xxhash

    out = []
    for m in UNITS[unit].finditer(text):
        words = WORD.findall(m[0].lower())
        if len(words) >= least_words:
            out.append((m.start(), m.end(), xxhash.xxh3_128_digest(" ".join(words).encode())))
    return out


def repeated_units(docs: DataFrame, unit: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """The units to remove: doc_id, text_hash, start, end."""
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))

    def rows(known) -> object:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                at, start, end, digests, times = [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    own = units_of(text or "", unit, least_words)
                    seen: dict = {}
                    for a, b, d in own:
                        seen[d] = seen.get(d, 0) + 1
                        if known is not None:
                            at.append(i)
                            start.append(a)
                            end.append(b)
                            digests.append(d)
                            times.append(seen[d])
                    if known is None:  # once a document where they are only counted
                        at += [i] * len(seen)
                        digests += seen
                        times += seen.values()
                halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64) if digests else np.zeros((0, 2), np.uint64)
                keep = np.arange(len(at)) if known is None else np.flatnonzero(in_bitmap(known.value, halves[:, 0]))
                take = pa.array(np.array(at, np.int64)[keep])
                arrays = [batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(halves[keep, 0].view(np.int64) if len(keep) else [], pa.int64()), pa.array(halves[keep, 1].copy().view(np.int64) if len(keep) else [], pa.int64())]
                arrays.append(pa.array(np.array(times, np.int64)[keep]))
                if known is not None:
                    arrays += [pa.array(np.array(x, np.int64)[keep]) for x in (start, end)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "a", "b", "times", "start", "end"][: len(arrays)])

        return of

    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    counted = source.mapInArrow(rows(None), "doc_id long, text_hash long, a long, b long, times long").groupBy("a", "b")
    counted = counted.agg(F.sum("times").alias("n"), F.min(rank).alias("first")).where("n > 1")
    counted = table(counted.select("a", "b", "first.doc_id", "first.text_hash").toDF("a", "b", "first_id", "first_hash"), "units")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(counted, "a", bits_for_keys(counted.count())))  # of bounded size
    found = source.mapInArrow(rows(known), "doc_id long, text_hash long, a long, b long, times long, start long, end long")
    joined = found.join(counted, ["a", "b"])
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("text_hash").eqNullSafe(F.col("first_hash"))
    return joined.where((F.col("times") > 1) | ~own).select("doc_id", "text_hash", "start", "end")


def remove_units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, with_text: bool = False) -> DataFrame:
    """Of each row: doc_id, n_units, n_removed, removed_chars, spans, kept_sha256 (with_text: also kept_text).

    n_units counts all units, also those too short to judge.
    """
    both = with_spans(docs, repeated_units(docs, unit, least_words), ["start", "end"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {c: [] for c in ("n_units", "n_removed", "removed_chars", "spans", "kept_sha256", "kept_text")}
            for text, start, end in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end")), strict=True):
                spans, parts, at = sorted(set(zip(start or [], end or [], strict=True))), [], 0
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                kept = "".join([*parts, (text or "")[at:]])
                own = (sum(1 for _ in UNITS[unit].finditer(text or "")), len(spans), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept.encode()).hexdigest(), kept)
                for c, v in zip(out, own, strict=True):
                    out[c].append(v)
            arrays = [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_units", "n_removed", "removed_chars")), pa.array(out["spans"], kind), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_units", "n_removed", "removed_chars", "spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(out["kept_text"], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_units long, n_removed long, removed_chars long, spans array<struct<start: long, end: long>>, kept_sha256 string" + ", kept_text string" * with_text
    return both.mapInArrow(rows, schema)
