"""A keyed panel store over Parquet: upsert, read, delete, coverage.

A dataset's rows lie in parts by year of the date and bucket of the ticker (its CRC-32 modulo the number of buckets), in
order of ticker and date. Parts are never changed: a write puts the parts that it touches, whole, into a folder of its own,
and then a manifest that names the folder of each part. The manifest is written beside and renamed, so that a write is seen
whole or not at all: one that is lost before the rename leaves the store as it was. Folders that neither the newest manifest nor the
one before names are deleted after a write.

The number of buckets follows the size: where the parts of a year would hold more than `part_rows` rows on average, the next
write doubles the buckets and deals all rows anew. A store of FEW_PARTS parts doubles them only where parts hold more than
PART_ROWS rows: a part is a file and a line of the manifest, and with small parts their number would follow the rows. A key is one date and one ticker, so that a ticker has 366 rows a
part at most, however often its rows come.

An upsert replaces whole rows: the new rows of a key win over the old, of new rows with one key the last wins (by the columns in
`order`; without them by the frame's own order, which only a sorted frame has). A column that the new rows lack becomes null
for them, a new column is added. A write may name a stream and its batch: the manifest keeps the last batch of each stream,
and a batch that comes again is passed over, so that a replayed stream writes each batch once. One writer at a time: a second
one fails at the rename. A dataset that isn't there reads as an empty table.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.params import has_columns, period
from ..operators.xsection import last_of_key
from .registry import DATASETS

#: Rows of a part; parts up to which a smaller number of rows is kept to.
PART_ROWS, FEW_PARTS = 2_000_000, 2_048


def bucket(n: int) -> Column:
    return (F.crc32(F.coalesce(F.col("ticker").cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def bucket_of(ticker: str, n: int) -> int:
    return zlib.crc32(ticker.encode()) % n


def part() -> Column:
    """The year of a row; rows without a date are in year 0."""
    return F.coalesce(F.year("date"), F.lit(0))


class PanelStore:
    def __init__(self, spark: SparkSession, folder: str, part_rows: int = PART_ROWS):
        self.spark, self.folder, self.part_rows = spark, folder.rstrip("/"), part_rows

    # Files

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        fs, at = self._fs(), self._path(*names)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _manifests(self, dataset: str) -> list[str]:
        return [n for n in self._names(dataset, "manifests") if n.endswith(".json")]

    def _load(self, dataset: str, name: str) -> dict:
        source = self._fs().open(self._path(dataset, "manifests", name))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _manifest(self, dataset: str) -> dict | None:
        """version, schema, buckets, parts (year/bucket: folder and rows) and batches (of each stream the last)."""
        names = self._manifests(dataset)
        return self._load(dataset, names[-1]) if names else None

    def _commit(self, dataset: str, manifest: dict) -> None:
        """Makes a manifest the newest, by a rename; then drops what no manifest but the last two names."""
        fs, name = self._fs(), f"{manifest['version']:012d}.json"
        spare, at = self._path(dataset, "manifests", f"_{uuid.uuid4().hex}"), self._path(dataset, "manifests", name)
        out = fs.create(spare, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(spare, at):
            raise RuntimeError(f"another writer has made version {manifest['version']} of {dataset}")
        names = self._manifests(dataset)
        named = {p["folder"] for n in names[-2:] for p in self._load(dataset, n)["parts"].values()}
        for folder in self._names(dataset, "data"):
            if folder not in named:
                fs.delete(self._path(dataset, "data", folder), True)
        for n in names[:-2]:
            fs.delete(self._path(dataset, "manifests", n), False)

    # Rows

    def _rows(self, dataset: str, manifest: dict, parts: list[str] | None = None) -> DataFrame:
        """The rows of some parts (default: all), by the manifest's schema."""
        schema = StructType.fromJson(manifest["schema"])
        keys = list(manifest["parts"]) if parts is None else [p for p in parts if p in manifest["parts"]]
        if not keys:
            return self.spark.createDataFrame([], schema)
        where = [f"{self.folder}/{dataset}/data/{manifest['parts'][k]['folder']}/_year={k.split('/')[0]}/_bucket={k.split('/')[1]}" for k in keys]
        return self.spark.read.schema(schema).parquet(*where)

    def _write(self, dataset: str, rows: DataFrame, n: int) -> dict[str, dict]:
        """Puts the rows into a folder of their own; returns its parts."""
        folder = uuid.uuid4().hex
        at = f"{self.folder}/{dataset}/data/{folder}"
        dealt = rows.withColumn("_year", part()).withColumn("_bucket", bucket(n)).repartition("_year", "_bucket").sortWithinPartitions("_year", "_bucket", "ticker", "date")
        dealt.write.partitionBy("_year", "_bucket").parquet(at)
        kinds = "_year int, _bucket int"
        counts = self.spark.read.schema(kinds).parquet(at).groupBy("_year", "_bucket").count() if self._names(dataset, "data", folder) else None
        return {f"{r._year}/{r._bucket}": {"folder": folder, "rows": r["count"]} for r in (counts.collect() if counts is not None else [])}  # a row a part

    def _next(self, dataset: str, old: dict | None, schema: StructType, buckets: int, parts: dict, batch: tuple[str, int] | None = None) -> None:
        batches = {**(old["batches"] if old else {}), **({batch[0]: batch[1]} if batch else {})}
        version = old["version"] + 1 if old else 1
        self._commit(dataset, {"version": version, "schema": schema.jsonValue(), "buckets": buckets, "parts": parts, "batches": batches})

    def _merged(self, old: dict | None, new: StructType) -> StructType:
        """The old schema with the new columns after it."""
        out = StructType.fromJson(old["schema"]) if old else StructType()
        return StructType([*out.fields, *[f for f in new.fields if f.name not in out.fieldNames()]])

    def _known(self, dataset: str, old: dict | None, rows: DataFrame) -> DataFrame:
        """Of a registered dataset's rows the columns that it or the table has, typed: others go, and those that the rows lack are null."""
        if dataset not in DATASETS:
            return rows
        own, have = DATASETS[dataset].schema, set(rows.columns)
        kept = [f for f in (StructType.fromJson(old["schema"]).fields if old else []) if f.name not in own.fieldNames()]
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in [*own.fields, *kept]])

    def upsert(self, dataset: str, rows: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Puts the rows in by (date, ticker). Returns how many keys were put; 0 for a batch that is in already.

        New columns are added to the table, but to a registered dataset's only its own; of its rows other columns are left out.
        """
        has_columns(rows.columns, ["date", "ticker"])
        old = self._manifest(dataset)
        if old and batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        if order is None:
            rows, order = rows.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
        new = self._known(dataset, old, last_of_key(rows, ["date", "ticker"], order).drop("_row"))
        schema, n = self._merged(old, new.schema), old["buckets"] if old else 1
        spare = f"{self.folder}/{dataset}/spare-{uuid.uuid4().hex}"
        new.write.parquet(spare)
        new = self.spark.read.schema(new.schema).parquet(spare)
        try:
            put = new.count()
            parts, years = dict(old["parts"]) if old else {}, max(1, new.select(part()).distinct().count())
            years, rows = max(years, len({k.split("/")[0] for k in parts})), sum(p["rows"] for p in parts.values()) + put
            while rows / (n * years) > (self.part_rows if 2 * n * years <= FEW_PARTS else max(self.part_rows, PART_ROWS)):
                n *= 2
            touched = None  # all parts, where rows are dealt anew
            if old and n == old["buckets"]:
                touched = [f"{r[0]}/{r[1]}" for r in new.select(part(), bucket(n)).distinct().collect()]  # a row a part
            if put:
                both = new.withColumn("_new", F.lit(1))
                if old:
                    both = self._rows(dataset, old, touched).withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
                made = self._write(dataset, last_of_key(both, ["date", "ticker"], ["_new"]).select(*schema.fieldNames()), n)
                parts = made if touched is None else {**parts, **made}
            if put or batch or not old:
                self._next(dataset, old, schema, n, parts, batch)
        finally:
            self._fs().delete(self._path(dataset, spare.rsplit("/", 1)[1]), True)
        return put

    def tables(self) -> list[str]:
        """The datasets of the store, by name."""
        return [n for n in self._names() if (self._manifest(n) or {}).get("parts")]

    def read(self, dataset: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, confirmed_only: bool = True) -> DataFrame:
        """The rows by ticker and date (parts chosen by the manifest, both pushed down), without provisional ones; an empty table without the dataset."""
        if start and end:
            period(start, end)
        manifest = self._manifest(dataset)
        if manifest is None:
            kinds = DATASETS[dataset].schema if dataset in DATASETS else "date date, ticker string"
            return self.spark.createDataFrame([], kinds)
        buckets = None if tickers is None else {bucket_of(t, manifest["buckets"]) for t in tickers}
        first, last = (int(d[:4]) if d else None for d in (start, end))
        inside = lambda year, b: (buckets is None or b in buckets) and (first is None or year >= first) and (last is None or year <= last)
        out = self._rows(dataset, manifest, [k for k in manifest["parts"] if inside(*map(int, k.split("/")))])
        if tickers is not None:
            out = out.where(F.col("ticker").isin(*tickers))
        if start:
            out = out.where(F.col("date") >= F.lit(start).cast("date"))
        if end:
            out = out.where(F.col("date") <= F.lit(end).cast("date"))
        if confirmed_only and "is_provisional" in out.columns:
            out = out.where(~F.coalesce("is_provisional", F.lit(False)))
        return out

    def delete(self, dataset: str, tickers: list[str] | None = None) -> int:
        """Drops all rows, or those of some tickers; an empty list deletes nothing. Returns the rows dropped."""
        old = self._manifest(dataset)
        if old is None or tickers == []:
            return 0
        buckets = None if tickers is None else {bucket_of(t, old["buckets"]) for t in tickers}
        touched = [k for k in old["parts"] if buckets is None or int(k.split("/")[1]) in buckets]
        own = self._rows(dataset, old, touched)
        gone = F.lit(True) if tickers is None else F.coalesce(reduce(lambda a, t: a | (F.col("ticker") == t), tickers, F.lit(False)), F.lit(False))
        n = own.where(gone).count()
        if n:
            made = {} if tickers is None else self._write(dataset, own.where(~gone), old["buckets"])
            left = {k: p for k, p in old["parts"].items() if k not in touched}
            self._next(dataset, old, StructType.fromJson(old["schema"]), old["buckets"], {**left, **made})
        return n

    def coverage(self, dataset: str) -> DataFrame:
        return self.read(dataset, confirmed_only=False).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
