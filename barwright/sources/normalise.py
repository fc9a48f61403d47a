"""Raw text records to the typed, stamped rows of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.xsection import last_of_key
from .registry import TYPES, Dataset, kind


def parsed(text: Column, kind: str) -> Column:
    if kind == "date":
        return scalar.day(text)
    if kind == "text":
        return F.nullif(F.trim(text), F.lit(""))
    x = scalar.number(text)
    return scalar.whole(x) if kind == "long" else x


def normalised(raw: DataFrame, dataset: Dataset, ticker: Column, collected_at: Column, seq: str, source: str) -> DataFrame:
    """Rows of the dataset's schema: fields parsed, missing raw fields null, stamps set.

    Rows without a date, or without the close that makes them an observation, go; of rows with one key the last by `seq`
    stays. A row is provisional if it was collected before it could be known.
    """
    own = set(raw.columns)
    fields = [(parsed(F.col(r), kind(c)) if r in own else F.lit(None).cast(TYPES[kind(c)])).alias(c) for r, c in dataset.columns.items()]
    out = raw.select(*fields, (scalar.padded(ticker, dataset.digits) if dataset.digits else ticker).alias("ticker"), collected_at.cast("timestamp_ntz").alias("collected_at"), F.col(seq).alias("_seq"))
    anchors = [c for c in ("close", "index_close") if c in out.columns]
    out = out.where(F.col("date").isNotNull() & F.coalesce(*anchors).isNotNull())
    out_at = dataset.release
    basis = scalar.availability_basis(F.col("date"), F.col(out_at.since)) if out_at.since else F.col("date")
    out = out.withColumn("source", F.lit(source)).withColumn("data_available_at", scalar.available_at(basis, out_at.days, out_at.hour))
    out = out.withColumn("is_provisional", F.col("collected_at") < F.col("data_available_at"))
    return last_of_key(out, ["date", "ticker"], ["_seq"]).select(*dataset.schema.fieldNames())


def records(bodies: DataFrame, body: str, output: str, dataset: Dataset) -> DataFrame:
    """The records of JSON answers: an array, or a single object, under `output`; broken bodies give none."""
    schema = dataset.raw_schema.simpleString()
    many = F.from_json(F.get_json_object(body, f"$.{output}"), f"array<{schema}>")
    each = bodies.withColumn("_at", F.monotonically_increasing_id()).select("*", F.posexplode(many).alias("_n", "_r")).where("_r IS NOT NULL")
    return each.select(*[c for c in bodies.columns if c != body], F.struct("_at", "_n").alias("_seq"), "_r.*")
