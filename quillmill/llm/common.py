"""What the corpus operators share: scratch tables in the shared folder, guarded broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks, the only characters that part words in the contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where a local session leaves it unset one of
    our own; on a cluster that is an error, since executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "scratch") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting df (settled, narrow): beyond max_rows Spark joins by shuffle instead."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def let(value: Column, body) -> Column:
    """Bind value once within a column expression: body gets a reference to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of text; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for undirected edges (a, b) of any orderable type: label is the smallest node reachable.

    Minimum labels travel along edges and labels are short-cut by a self-join in each round, so the number of
    rounds is about the logarithm of the longest path. Each round is settled; nothing reaches the driver but a count.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels_next = settle(step.join(hop, step.label == hop.via, "left").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("old")).alias("moved")), "labels")
        done = labels_next.where("moved").isEmpty()
        labels = labels_next.select("node", "label")
        if done:
            return labels
