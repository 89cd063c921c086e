"""Chunk tables and source registries: idempotent append, upload dedup, lifecycle, catalogue, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_hash(tenant, source, content):
    return F.sha2(F.concat_ws("|", tenant, source, content), 256)


def append_chunks(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows of new that are really inserted: first of each (tenant_id, content_hash) in `ord`, none that exists.
    Rows without a hash are exempt from uniqueness."""
    first = F.row_number().over(Window.partitionBy("tenant_id", "content_hash").orderBy("ord"))
    hashed = new.where("content_hash IS NOT NULL").join(existing.select("tenant_id", "content_hash"), ["tenant_id", "content_hash"], "left_anti")
    return hashed.withColumn("place", first).where("place = 1").drop("place").unionByName(new.where("content_hash IS NULL"))


def match_uploads(incoming: DataFrame, files: DataFrame) -> DataFrame:
    """incoming with duplicate_of: the least id of a ready or partial file of the same tenant and content, or null."""
    ready = files.where(F.col("status").isin("ready", "partial")).groupBy("tenant_id", "sha256").agg(F.min("id").alias("duplicate_of"))
    return incoming.join(ready, ["tenant_id", "sha256"], "left")


def active_sources(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Ids that are enabled and ready or partial; a requested list can only narrow them (an empty list leaves none)."""
    active = files.where(F.col("status").isin("ready", "partial") & F.col("enabled")).select("tenant_id", "id")
    return active if requested is None else active.join(requested.select("id"), "id", "left_semi").select("tenant_id", "id")


def corpus_version(files: DataFrame) -> DataFrame:
    """(tenant_id, version): sha256 over id:enabled of ready and partial files in id order, and their number."""
    own = files.where(F.col("status").isin("ready", "partial")).select("tenant_id", "id", F.concat_ws(":", F.col("id").cast("string"), F.col("enabled").cast("string")).alias("part"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: x["part"]), "|")
    return own.groupBy("tenant_id").agg(F.sha2(F.concat(parts, F.lit("|n="), F.count("*").cast("string")), 256).alias("version"))


def source_catalogue(files: DataFrame) -> DataFrame:
    """Per tenant: files, ready or partial files, chunks and the newest file."""
    ready = F.col("status").isin("ready", "partial")
    return files.groupBy("tenant_id").agg(F.count("*").alias("n_files"), F.count(F.when(ready, 1)).alias("n_ready"), F.sum(F.when(ready, F.col("n_chunks")).otherwise(0)).alias("n_chunks"), F.max_by("id", F.struct("created_at", "id")).alias("newest"))


def delete_source(chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks left, deleted chunk count of each source that had any)."""
    return chunks.join(ids, "source_id", "left_anti"), chunks.join(ids, "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("deleted"))


def apply_status_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest valid status of each job, rejected events): ready needs a url, error a message."""
    ok = F.coalesce(~((F.col("status") == "ready") & F.col("url").isNull()) & ~((F.col("status") == "error") & F.col("message").isNull()), F.lit(False))
    last = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.where(ok).withColumn("place", last).where("place = 1").drop("place"), events.where(~ok)


def reap_orphans(files: DataFrame, tenant) -> DataFrame:
    """files, those of the tenant that still wait or run turned to error."""
    lost = (F.col("tenant_id") == tenant) & F.col("status").isin("pending", "processing")
    return files.withColumn("message", F.when(lost, "interrupted by restart").otherwise(F.col("message"))).withColumn("status", F.when(lost, "error").otherwise(F.col("status")))


def classify_domains(corpus: DataFrame) -> DataFrame:
    """(domain, scope_class): generalization only if all its documents are of that scope, else client."""
    return corpus.groupBy("domain").agg(F.when(F.min(F.col("scope") == "generalization"), "generalization").otherwise("client").alias("scope_class"))


def job_queue(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """jobs (id, status, created_at) with place: oldest first within a status, newest first when none is asked for (ties by
    id). The place is a rank within each day and the days before it, so no task sorts all jobs."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    down = status is None
    rows = rows.withColumn("_day", F.to_date("created_at"))
    per_day = rows.groupBy("_day").agg(F.count("*").alias("_n"))
    order = F.desc("_day") if down else F.asc("_day")
    before = per_day.select(F.col("_day").alias("_d"), (F.sum("_n").over(Window.orderBy(order)) - F.col("_n")).alias("_before"))
    inner = Window.partitionBy("_day").orderBy(F.desc("created_at") if down else F.asc("created_at"), F.asc("id"))
    return rows.withColumn("_i", F.row_number().over(inner)).join(before, F.col("_day").eqNullSafe(F.col("_d"))).select(*jobs.columns, (F.col("_before") + F.col("_i")).alias("place"))


def toggle_source(files: DataFrame, ids: DataFrame, enabled: bool) -> DataFrame:
    """files with `enabled` set for the sources in ids (id); others stay as they are, and ids that no file has do nothing."""
    wanted = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return files.join(wanted, "id", "left").withColumn("enabled", F.when(F.col("_hit"), F.lit(enabled)).otherwise(F.col("enabled"))).drop("_hit").select(files.columns)
