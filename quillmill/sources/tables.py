"""Keyed tables that are written again in part: an upsert replaces only the folders that its keys fall into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import settle

BUCKETS = 64
SINCE = "since"  # the order of the values in `first`


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table without its own two columns, or None before anything was written."""
    try:
        return spark.read.parquet(path).drop("bucket", SINCE)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(path: str, rows: DataFrame, keys: Sequence[str], order: str, first: Sequence[str] = (), buckets: int = BUCKETS) -> None:
    """Put rows into the keyed table at path: one row a key stays, with the values of its largest order, but for the columns
    in `first`, which keep the values of the smallest one (what is set when a row is made and not again).

    Only buckets that hold a key of rows are read and written: merged into a scratch table first, then put in the place of
    the old folders by one dynamic overwrite, so a job that dies before that leaves the table as it was, and the same
    rows put in again change nothing. Values are merged in part before their shuffle, so a hot key is one row a task.
    """
    spark = rows.sparkSession
    placed = rows.withColumns({"bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), SINCE: F.col(order)})
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        old = None
    if old is not None:
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # BUCKETS at most
        placed = old.where(F.col("bucket").isin(touched)).select(placed.columns).union(placed)
    last = [c for c in rows.columns if c not in keys and c not in first]
    values = [F.max_by(F.struct(*last), F.struct(order, *[c for c in last if c != order])).alias("_last")]
    values += [F.min_by(F.struct(SINCE, *first), F.struct(SINCE, *first)).alias("_first")]
    merged = placed.groupBy("bucket", *keys).agg(*values).select("bucket", *keys, "_last.*", "_first.*")
    settle(merged.select(*rows.columns, SINCE, "bucket"), "upsert").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
