"""Merkle fixity audit of WARC replicas (operator 4).

Records are serialised as WARC/1.0 and hashed. Records in order of id are dealt into leaves of 64 ids; a leaf's digest
covers its records' digests and lengths in order, that is their offsets within the leaf; a node above covers the digests
and sizes of up to 16 nodes below, that is ordered offset ranges of the archive, up to one root. An audit compares
the roots of two replicas and goes down only where digests differ, to the records of the leaves that differ. Offsets are
summed on the way down, from the sizes of the nodes before, so no pass over all records puts them in one task.

Records without an id can't be placed and are left out. Records that share an id are told apart by digest and counted; a
record whose count differs is damaged too. Null URLs and bodies are empty. Of equal or empty replicas the audit is
empty. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Ids of a leaf and nodes below a node, as powers of two: shifts keep ids of 64 bits whole.
LEAF_BITS, FANOUT_BITS = 6, 4


def serialised(pages: DataFrame, record_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as WARC resource records: record_id and record."""
    text = F.coalesce(F.col(body), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col(record_id).cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("long").alias("record_id"), F.concat(head, text, F.lit("\r\n\r\n")).alias("record"))


def hashed(records: DataFrame) -> DataFrame:
    """record_id, digest, length and how often that record stands in the archive."""
    return records.select("record_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length")).groupBy("record_id", "digest", "length").agg(F.count(F.lit(1)).alias("copies"))


def _node(df: DataFrame, place: Column, order: list[str], said: Column, size: Column) -> DataFrame:
    """One node for each place: its digest over what its members say, in order, and its size."""
    member = F.struct(*order, said.alias("said"))
    return df.groupBy(place.alias("place")).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["said"]), "\n"), 256).alias("digest"), F.sum(size).alias("size")
    )


def tree(records: DataFrame, first_leaf: int, levels: int) -> DataFrame:
    """All nodes of an archive's tree: level (0: leaves), place, digest, size. Each level is made of the one below."""
    said = F.concat_ws(" ", "record_id", "digest", "length", "copies")
    level = _node(records, F.shiftright("record_id", LEAF_BITS) - first_leaf, ["record_id", "digest"], said, F.col("length") * F.col("copies"))
    level = table(level, "merkle")
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels + 1):
        level = table(_node(level, F.shiftright("place", FANOUT_BITS), ["place"], F.concat_ws(" ", "place", "digest", "size"), F.col("size")), "merkle")
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Where a replica (record_id, record) differs from the original.

    Returns record_id, status (corrupt, missing, extra), offset and length in the original (-1 for extra ones; of records
    that share an id, the first's), and both digests (the least, of such; empty where there is no record).
    """
    spark = original.sparkSession
    a, b = table(hashed(original), "records"), table(hashed(replica), "records")
    low, high = a.select("record_id").union(b.select("record_id")).agg(F.min(F.shiftright("record_id", LEAF_BITS)), F.max(F.shiftright("record_id", LEAF_BITS))).first()
    if low is None:
        return spark.createDataFrame([], "record_id long, status string, offset long, length long, digest string, replica_digest string")
    levels, n = 0, high - low + 1
    while n > 1:
        levels, n = levels + 1, -(-n >> FANOUT_BITS)
    ta, tb = table(tree(a, low, levels), "trees"), table(tree(b, low, levels), "trees")

    # The root's place and offset are 0; each step holds the children of differing nodes against each other.
    open_ = spark.range(1).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("offset"))
    parent = F.shiftright("place", FANOUT_BITS)
    for k in range(levels, -1, -1):
        nodes_a, nodes_b = (t.where(F.col("level") == k).select("place", "digest", "size") for t in (ta, tb))
        if k < levels:
            above = open_.select(F.col("place").alias("parent"), F.col("offset").alias("base"))
            before = Window.partitionBy("parent").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
            nodes_a = nodes_a.withColumn("parent", parent).join(above, "parent").withColumn("offset", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)))
            nodes_b = nodes_b.withColumn("parent", parent).join(above.select("parent"), "parent")
        else:
            nodes_a = nodes_a.withColumn("offset", F.lit(0).cast("long"))
        both = nodes_a.select("place", "digest", "offset").join(nodes_b.select("place", F.col("digest").alias("other")), "place", "full")
        open_ = table(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("place", "offset"), "differing")
        if open_.isEmpty():
            break
    leaf = F.shiftright("record_id", LEAF_BITS) - low
    before = Window.partitionBy("place").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    mine = a.withColumn("place", leaf).join(open_, "place").withColumn("at", F.col("offset") + F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)))
    said = F.sort_array(F.collect_list(F.struct("digest", "copies"))).alias("said")
    mine = mine.groupBy("record_id").agg(said, F.min(F.struct("at", "length")).alias("first"))
    theirs = b.withColumn("place", leaf).join(open_.select("place"), "place").groupBy("record_id").agg(said).withColumnRenamed("said", "others")
    both = mine.join(theirs, "record_id", "full").where(~F.col("said").eqNullSafe(F.col("others")))
    return both.select(
        "record_id", F.when(F.col("said").isNull(), "extra").when(F.col("others").isNull(), "missing").otherwise("corrupt").alias("status"),
        F.coalesce("first.at", F.lit(-1)).alias("offset"), F.coalesce("first.length", F.lit(-1)).alias("length"),
        F.coalesce(F.get("said", F.lit(0))["digest"], F.lit("")).alias("digest"), F.coalesce(F.get("others", F.lit(0))["digest"], F.lit("")).alias("replica_digest"),
    )
