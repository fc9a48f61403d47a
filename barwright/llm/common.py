"""What the text operators share: reading, tables in the shared folder, Arrow slices, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\v\f\r"
#: An odd factor of string_hashes.
HASH = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that one step inside a task holds at a time; a single longer text is a step of its own.
SLICE_BYTES = 4 << 20
#: Settings while a table is written: a query's shuffle files go when it ends (else they stay until the driver collects its
#: garbage), and batches between the JVM and Python stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage ends, and a lost executor costs nothing."""
    path, conf = path or new_folder(df.sparkSession, name), df.sparkSession.conf
    before = {k: conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, by Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The tables of one operator in the shared folder. One goes as soon as all that was made of it is written itself."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.made = spark, name, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, f"{self.name}-{name}")
        self.made.append((table(df, name, path), path))
        return self.made[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        for _, path in (x for x in self.made if any(x[0] is t for t in tables)):
            remove(self.spark, path)
        self.made = [x for x in self.made if not any(x[0] is t for t in tables)]

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, _ in self.made if not any(t is x for x in tables)))


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of the rows has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_bw{k}" for k in range(len(taken) + n)) if c not in taken][:n]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key() -> list:
    """Columns that tell documents apart even where doc_id is null or repeated."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def as_text(column: pa.Array) -> pa.Array:
    """Strings with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.cast(column, pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column text of a slice holds at most `most` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The low bits of a long column's values as a bitmap of a fixed number of bits, which bounds what reaches the driver."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_bitmap(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys have their bit set."""
    at = (keys & np.uint64(8 * len(known) - 1)).astype(np.int64)
    return ((known[at >> 3] >> (at & 7)) & 1).astype(bool)


def bits_for_keys(keys: int, least: int = 1 << 24, most: int = 1 << 31) -> int:
    """16 bits for each key, as a power of two from 2 MB to 256 MB. Keys let through in error cost time, not results."""
    return min(max(least, 1 << int(16 * keys).bit_length()), most)


def with_spans(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's doc_id and text with the lists of the spans' columns, met by doc_id and text hash (null without any)."""
    lists = spans.groupBy("doc_id", "text_hash").agg(*[F.collect_list(c).alias(c) for c in columns])
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *columns)
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return source.join(lists, source["doc_id"].eqNullSafe(lists["_id"]) & (source["text_hash"] == lists["_hash"]), "left").select("doc_id", "text", *columns)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings' bytes: eight bytes at a time are mixed in, for all strings at once; long ones by themselves."""
    import xxhash

    strings = pc.cast(strings, pa.large_string())
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int64, n + 1, 8 * strings.offset)
    size = np.diff(ends)
    data = np.zeros(ends[-1] - ends[0] + 8, np.uint8)  # the last eight bytes of any string can be read
    data[:-8] = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    eights = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
    out, starts, at = mixed(size.astype(np.uint64)), ends[:-1] - ends[0], np.flatnonzero((size > 0) & (size <= 64))
    for k in range(0, 64, 8):
        at = at[size[at] > k]
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        out[at] = mixed(out[at] * HASH + (eights[starts[at] + k] << (np.uint64(64) - 8 * left)))
    for i in np.flatnonzero(size > 64):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the offsets of each text's words.

    Words are runs of bytes other than SPACES. Hashes are of the words' bytes, so they agree between tasks.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    known = string_hashes(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate(([0], np.cumsum(full)))
    return (known[codes[full]] if len(known) else np.zeros(0, np.uint64)), kept[offsets]


def runs(offsets: np.ndarray) -> np.ndarray:
    """The index of the list that each flat element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def hex_of(spark_binary: str) -> F.Column:
    return F.lower(F.hex(spark_binary))
