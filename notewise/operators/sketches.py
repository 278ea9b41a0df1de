"""Stored sketches of distinct subjects: one row a landed batch, merged without a rescan.

The reference merges partial sets, chunk by chunk, on one machine; totals over many landed batches would
need all subjects again. A batch is summarised once, when it lands, by two mergeable sketches per group:
HyperLogLog for counts and theta for counts of intersections and differences. Both are built in tasks and
combined before the shuffle, take some kilobytes whatever the batch holds, and merging them is the same as
sketching all rows (exactly so: the sketch of the union), so new batches update totals from the small table.

Relative standard errors: HyperLogLog 1.04 / sqrt(2^lg_k) times at most 1.1 (lg_k = 14: 0.9%), theta about
1 / sqrt(2^lg_k) of the union's size for an intersection or difference (lg_k = 14: 0.8%).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.session import scratch_path

LG_K = 14


def sketch_batch(df: DataFrame, batch_id: str, subject_col: str = "subject_id", group_cols: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """batch_id, group columns, n_rows, hll, theta of one batch; null subjects don't count."""
    subject = F.col(subject_col).cast("string")
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(subject, lg_k).alias("hll"),
        F.theta_sketch_agg(subject, lg_k).alias("theta")).select(F.lit(str(batch_id)).alias("batch_id"), *group_cols, "n_rows", "hll", "theta")


def land_sketch(df: DataFrame, batch_id: str, path: str | None = None, subject_col: str = "subject_id", group_cols: Sequence[str] = (),
                lg_k: int = LG_K) -> DataFrame:
    """Write a batch's sketches under its id (landing it again replaces them) and read all batches'."""
    spark: SparkSession = df.sparkSession
    path = path or scratch_path(spark, "sketches")
    row = sketch_batch(df, batch_id, subject_col, group_cols, lg_k)
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row.schema if f.name != "batch_id")
    return spark.read.schema(f"{kinds}, batch_id string").parquet(path)


def count_subjects(sketches: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """group columns, n_rows, n_subjects (estimated) over all batches of the table."""
    return sketches.groupBy(*group_cols).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_subjects"))


def compare_subjects(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: subjects of either table of sketches, of both, of left but not right, and of right but not left (estimated)."""
    a = left.agg(F.theta_union_agg("theta").alias("a")).scalar()
    b = right.agg(F.theta_union_agg("theta").alias("b")).scalar()
    both = left.sparkSession.range(1).select(a.alias("a"), b.alias("b"))

    def size(sketch):
        return F.theta_sketch_estimate(sketch)
    return both.select(size(F.theta_union("a", "b")).alias("n_either"), size(F.theta_intersection("a", "b")).alias("n_both"),
                       size(F.theta_difference("a", "b")).alias("n_left_only"), size(F.theta_difference("b", "a")).alias("n_right_only"))
