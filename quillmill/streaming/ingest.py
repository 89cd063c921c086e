"""Incremental ingest: each batch of new files is deduplicated, chunked, embedded and appended; a replay changes nothing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.ingest import append_chunks, content_hash
from ..operators.near_rows import embed, hashed_ngrams
from ..sources.files import settle

CHUNKS = "tenant_id string, source_id string, content_hash string, content string, heading string, ord long, vector array<double>, batch_id long"
FILES = "tenant_id string, source_id string, sha256 string, status string, n_chunks long, duplicate_of string, batch_id long"


def ingest_batch(batch: DataFrame, batch_id: int, table: str, encoder: Callable[[list[str]], np.ndarray] = hashed_ngrams) -> None:
    """Add the files (tenant_id, source_id, content) of a batch to the Parquet tables table/chunks and table/files.

    A file whose tenant has a file of equal content already, ready or earlier in the batch, is noted as its duplicate and
    adds no chunks; a chunk that the tenant's source has already is not added again. A file without a chunk is an error.
    Both tables are written under the batch's own folder, replaced whole when the batch runs again.
    """
    spark = batch.sparkSession
    files, chunks = f"{table}/files", f"{table}/chunks"
    earlier = lambda path, schema: spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    known = earlier(files, FILES).where(F.col("batch_id") != batch_id)
    old = earlier(chunks, CHUNKS).where(F.col("batch_id") != batch_id)
    rows = batch.select("tenant_id", "source_id", F.coalesce("content", F.lit("")).alias("content")).withColumn("sha256", F.sha2("content", 256))
    have = known.where(F.col("status").isin("ready", "partial")).groupBy("tenant_id", "sha256").agg(F.min("source_id").alias("earlier"))
    first = rows.groupBy("tenant_id", "sha256").agg(F.min("source_id").alias("first"))
    judged = rows.join(have, ["tenant_id", "sha256"], "left").join(first, ["tenant_id", "sha256"])
    judged = settle(judged.withColumn("duplicate_of", F.coalesce("earlier", F.when(F.col("first") != F.col("source_id"), F.col("first")))), "judged")
    cut = chunk_documents(judged.where("duplicate_of IS NULL").select(F.struct("tenant_id", "source_id").alias("doc_id"), F.col("content").alias("text")))
    named = cut.select("doc_id.*", "content", "heading", F.col("chunk_index").cast("long").alias("ord")).withColumn("content_hash", content_hash(F.col("tenant_id"), F.col("source_id"), F.col("content")))
    new = settle(embed(append_chunks(named, old), F.col("content"), encoder).withColumn("batch_id", F.lit(batch_id).cast("long")), "new")
    new.select(*[c.split()[0] for c in CHUNKS.split(", ")]).write.mode("overwrite").parquet(f"{chunks}/batch={batch_id}")
    counts = named.groupBy("tenant_id", "source_id").agg(F.count("*").alias("n_chunks"))
    done = judged.join(counts, ["tenant_id", "source_id"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("n_chunks") == 0, "error").otherwise("ready")
    done.withColumn("status", status).withColumn("batch_id", F.lit(batch_id).cast("long")).select(*[c.split()[0] for c in FILES.split(", ")]).write.mode("overwrite").parquet(f"{files}/batch={batch_id}")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest_stream(files: DataFrame, table: str, checkpoint: str, encoder: Callable[[list[str]], np.ndarray] = hashed_ngrams):
    """A started query that ingests arriving files (tenant_id, source_id, content) and ends when all there are have been."""
    return files.writeStream.foreachBatch(lambda batch, i: ingest_batch(batch, i, table, encoder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
