"""Sharding by a two-pass external shuffle. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BUCKET_BYTES, BLOCK = 8 << 20, 1000


def _bases(sizes: DataFrame) -> DataFrame:
    """(_bucket, _base): prefix sums of (_bucket, _n), in two levels: no task sees more than BLOCK buckets, or a row for
    each BLOCK of them."""
    blocked = sizes.withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    whole = blocked.groupBy("_block").agg(F.sum("_n").alias("_m"))
    above = whole.select("_block", (F.sum("_m").over(Window.orderBy("_block")) - F.col("_m")).alias("_before"))
    inner = F.sum("_n").over(Window.partitionBy("_block").orderBy("_bucket")) - F.col("_n")
    return blocked.withColumn("_inner", inner).join(above, "_block").select("_bucket", (F.col("_before") + F.col("_inner")).alias("_base"))


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs plus `shard` and `slot`, in a random order dealt to shards whose counts differ by one at most.

    Pass one scatters the rows by a seeded hash of each row's number, id and text into buckets of about bucket_bytes
    (their number grows with the input, so a bucket always fits in memory); pass two shuffles each bucket (`shuffle()` is a
    Fisher-Yates shuffle) from a fixed starting order and writes it. A row's place is its bucket's base (prefix sum of the
    counts written) plus its place in the bucket; place mod n_shards is the shard, place div n_shards the gapless slot.
    Null ids and texts hash like any value; repeated rows differ by their number, so however many there are they spread
    over the buckets, and each gets a place of its own; a text longer than a bucket makes its bucket longer; an empty
    table gives an empty result; input columns named shard or slot are replaced. Bases come from the buckets as written,
    so a task that runs again leaves no gap.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(64))).first()[0] or 0
    n_buckets = max(1, -(-int(total) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), "_number", F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}"))
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.monotonically_increasing_id().alias("_number"))
    scattered = numbered.select(F.struct(key.alias("h"), F.col("_number").alias("n"), F.col("_row").alias("row")).alias("x")).withColumn("_bucket", F.pmod("x.h", F.lit(n_buckets)))
    packed = scattered.groupBy("_bucket").agg(F.collect_list("x").alias("xs"))
    shuffled = packed.select("_bucket", F.posexplode(F.shuffle(F.sort_array("xs"), F.lit(seed))).alias("_i", "x")).select("_bucket", "_i", "x.row")
    written = settle(shuffled, "buckets")
    bases = _bases(written.groupBy("_bucket").agg(F.count("*").alias("_n")))
    place = F.col("_base") + F.col("_i")
    return written.join(bases, "_bucket").select("row.*", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
