"""Token ids in files of fixed-width bit fields (operator 10).

A shard holds the ids of a run of documents, each id in the least bits that hold the vocabulary:

    magic "FWBITS01";
    the blocks: fields packed from the low bit up, each block of whole bytes;
    byte offset of each block, and one more for the end: unsigned 64-bit;
    first id of each document, and one more for the end: unsigned 64-bit; the documents' ids: signed 64-bit;
    magic; width, ids of a block, ids, documents: four little-endian unsigned 64-bit integers.

Every block but the last has the same size and its offset is stored, so that any range of ids is read and unpacked with
numpy alone. A shard is written from front to back, a block in memory at a time, and read a block at a time.

Documents are dealt by ranges of doc_id and text hash, in ascending order. A range is written to one shard or more: a
shard that has SHARD_IDS ids is closed and the next begins, so that no file outgrows what a task can hold or read, however
large the table. A shard is written under a name of its own and then renamed, so that a task that runs again replaces its
shards whole. A null doc_id comes first; rows that share a doc_id are ordered by the hash of their texts; a null text is
empty (its only id is the end id). Other columns are not read. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LibraryBPE, default_path, loaded
from .common import as_text, new_folder, partitions, slices, table

MAGIC, HEAD, BLOCK_IDS, SHARD_IDS = b"FWBITS01", struct.Struct("<8sQQQQ"), 1 << 15, 1 << 26
#: Stands for a null doc_id in a shard.
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    """The least bits that hold ids below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes a shard to a file object from front to back; close() ends it."""

    def __init__(self, out, width: int, block: int = BLOCK_IDS):
        self.out, self.width, self.block = out, width, block
        self.starts, self.names, self.offsets = [0], [], []
        self.rest, self.waiting, self.at = [], 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            every = np.concatenate(self.rest)
            for k in range(0, len(every) - self.block + 1, self.block):
                self._write(every[k : k + self.block])
            self.rest = [every[len(every) // self.block * self.block :]]
            self.waiting = len(self.rest[0])

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.rest))
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(self.names, "<i8").tobytes())
        self.out.write(HEAD.pack(MAGIC, self.width, self.block, self.starts[-1], len(self.names)))


class Reader:
    """Random access to the ids of a shard: a file of pyarrow's file systems, or its bytes."""

    def __init__(self, source):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.file.size()
        magic, self.width, self.block, self.n_ids, self.n_docs = HEAD.unpack(self.read(size - HEAD.size, size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        end, n_blocks = size - HEAD.size, -(-self.n_ids // self.block)
        first = end - 8 * (2 * self.n_docs + n_blocks + 2)
        self.offsets, self.starts, self.names = np.split(np.frombuffer(self.read(first, end), "<u8"), [n_blocks + 1, n_blocks + self.n_docs + 2])
        self.names = self.names.view("<i8")

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from position start to end: only the blocks that hold them are unpacked."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        low = int(self.offsets[first])
        data = memoryview(self.read(low, int(self.offsets[last + 1])))
        out = [unpack(data[int(self.offsets[b]) - low : int(self.offsets[b + 1]) - low], self.width, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 2, shards: int | None = None, shard_ids: int = SHARD_IDS, width: int | None = None) -> DataFrame:
    """Encodes the documents and writes the shards to a folder; returns part, piece, n_ids and start (ids of all shards before).

    An id takes `width` bits, by default the least that hold the vocabulary. The write runs once, here; what it returns is a small table with a row for each shard.
    """
    spark, path = docs.sparkSession, path or default_path()
    order = ("doc_id", "text_hash")
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(folder)
        context, coder = TaskContext.get(), loaded(path, LibraryBPE)
        part, bits = context.partitionId(), width or bits_for(coder.size)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        sizes, writer, out = [], None, None

        def spare(piece: int) -> str:
            return f"{where}/_{part:06d}-{piece:06d}-{context.taskAttemptId()}"

        for batch in slices(batches):
            names = [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
            for name, ids in zip(names, coder.encode_many(as_text(batch.column("text"))), strict=True):
                if not writer:
                    store.create_dir(where)
                    out = store.open_output_stream(spare(len(sizes)))
                    writer = Writer(out, bits)
                writer.add(name, np.frombuffer(ids + end, "<u4"))
                if writer.starts[-1] >= shard_ids:
                    sizes.append(writer.starts[-1])
                    writer.close()
                    out.close()
                    writer = None
        if writer:
            sizes.append(writer.starts[-1])
            writer.close()
            out.close()
        for piece in range(len(sizes)):
            store.move(spare(piece), shard_at(where, part, piece))
        yield pa.RecordBatch.from_pydict({"part": [part] * len(sizes), "piece": range(len(sizes)), "n_ids": sizes}, pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("n_ids", pa.int64())]))

    made = table(dealt.mapInArrow(rows, "part int, piece int, n_ids long"), "token-manifest")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def shard_at(where: str, part: int, piece: int) -> str:
    return f"{where}/{part:06d}-{piece:06d}.fwb"


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of a folder of shards: doc_id, start, n_tokens, ids_crc32 (with_ids: also ids)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, piece, start in zip(*(batch.column(c).to_pylist() for c in ("part", "piece", "start")), strict=True):
                with store.open_input_file(shard_at(where, part, piece)) as source:
                    reader = Reader(source)
                    for k in range(0, reader.n_docs, 1024):
                        some = range(k, min(k + 1024, reader.n_docs))
                        first = int(reader.starts[k])
                        every = reader.ids(first, int(reader.starts[some[-1] + 1])).astype("<u4", copy=False)
                        starts = reader.starts[k : k + len(some) + 1].astype(np.int64)
                        ids = [every[a - first : b - first] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                        names = reader.names[k : k + len(some)]
                        out = {
                            "doc_id": pa.array(names, pa.int64(), mask=names == NO_ID),
                            "start": pa.array(starts[:-1] + start, pa.int64()),
                            "n_tokens": pa.array(np.diff(starts), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array(ids, pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # A row a shard: one task for each few of them.
    return manifest.repartition(partitions(spark), "part", "piece").mapInArrow(rows, schema)


def token_files(docs: DataFrame, path: str | None = None, end_id: int | None = 2, with_ids: bool = False, shard_ids: int = SHARD_IDS, width: int | None = None) -> DataFrame:
    """Writes the documents' ids to shards in the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "token-ids")
    return read_ids(docs.sparkSession, folder, write_ids(docs, folder, path, end_id, shard_ids=shard_ids, width=width), with_ids)
