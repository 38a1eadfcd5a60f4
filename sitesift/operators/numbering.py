"""Row numbering inside groups that may be hot (WIN-2 at scale).

``row_number() over (partition by g order by o)`` sorts a whole group in one
task.  Here the rows are range-partitioned by ``(g, o)``, so a hot group is
split over many tasks; each task numbers its slice, and a small table of
per-slice counts gives every slice its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def number_within(df: DataFrame, group: str, order: str, out: str = "position") -> DataFrame:
    """Add ``out`` = 1-based rank of ``order`` inside ``group`` (ties broken by ``order`` only, values unique)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range bounds come from a sample; both sides below must see the same ones, so the slices are fixed first
    r = cut_lineage(df.repartitionByRange(n, group, order).withColumn("_slice", F.spark_partition_id()))
    local = r.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_slice", group).orderBy(order))
    )
    counts = r.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select(group, "_slice", "_off")
    return (
        local.join(offsets, [group, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_off")).cast("int"))
        .drop("_slice", "_local", "_off")
    )
