"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` as the session names it, else the checkpoint folder set on the context, else, in a local
    session only, a folder in the warehouse.  Never a machine-local folder on a cluster: without a name that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stage").rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_only(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Just the key, the text (null: empty) and the columns of ``carry``, whatever else the input carries."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, picked by a hash of ``key``: the same rows each time, from all over."""
    share = 1 << 20 if rows >= total else max(1, int(rows / total * (1 << 20)))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 20)) < share)


def unequal_bytes(a: Column, b: Column) -> Column:
    """How many bytes differ between two arrays of longs of one length."""

    def differ(x, y):
        v = x.bitwiseXOR(y)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x0303030303030303))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x0101010101010101))
        return F.bit_count(v)

    return F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has about ``most`` bytes in each (a longer row stands alone)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """The rows' UTF-8 as they are; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def smallest_label(links: DataFrame, name: str = "labels") -> DataFrame:
    """Connected components: (node, label), label the smallest node reachable, for nodes with a link to another.

    ``links`` has long columns a, b.  Alternating large-star and small-star steps on edges (child, parent):
    each joins the edges with a per-node minimum (a partial aggregate), so no neighbour list is ever gathered
    and a hub is split by the planner's skew handling.  Every round is staged in the shared folder.
    """
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    while True:
        # large star: every node hands its larger neighbours the smallest node it knows (itself included)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node hands its smaller neighbours (and itself) the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").filter("u <> v").distinct()
        )
        new = stage(small, name)
        # done when every node has one parent and no parent has a parent
        many = new.groupBy("u").count().filter("count > 1").limit(1).count()
        if not many and not new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        edges = new
