"""Corpus, training-row, index and progress files, read and written by Spark's own sources."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = "row_id long, component string, messages array<struct<role: string, content: string>>"
MAX_CONTENT = 3000


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a local session makes a
    folder of its own; on a cluster there is no folder that all could read, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "scratch") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs only a reread."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, root: str, max_content: int = MAX_CONTENT) -> DataFrame:
    """(path, content, scope, domain) of every .md and .txt below root: content trimmed, then cut; blank files dropped;
    the first two folders below root are scope and domain, 'unknown' where missing."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    below = F.split(F.expr(f"substring(_path, {len(base) + 2})"), "/")
    rows = files.select(path.alias("_path"), F.btrim("value", F.lit(" \t\n\x0b\f\r")).alias("content")).where("content <> ''")
    folder = lambda i: F.when(F.size(below) > i + 1, F.url_decode(F.replace(F.get(below, F.lit(i)), F.lit("+"), F.lit("%2B")))).otherwise("unknown")
    return rows.select(F.col("_path").alias("path"), F.substring("content", 1, max_content).alias("content"), folder(0).alias("scope"), folder(1).alias("domain"))


def write_dataset(rows: DataFrame, path: str, stats: DataFrame | None = None, stats_path: str | None = None) -> None:
    """JSON lines of rows, one folder for each value of `split`, and stats (one row a component) as one JSON file beside;
    what was there before is replaced."""
    rows.write.mode("overwrite").partitionBy("split").json(path)
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(stats_path or f"{path.rstrip('/')}-stats")


def read_rows(spark: SparkSession, paths: list[str], schema: str = ROW_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the parsed JSON lines of all paths with `shard` (the path's place in the list), and the lines that
    do not parse, such as a truncated last one. Blank lines count as neither."""
    parts = [spark.read.text(p).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.union(p)
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.where("r._bad IS NULL").select("r.*", "shard").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value", "shard")


def read_rows_strict(spark: SparkSession, paths: list[str], schema: str = ROW_SCHEMA) -> DataFrame:
    """The same lines, but one that does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def write_index(index: DataFrame, path: str, mode: str = "append") -> None:
    index.write.mode(mode).option("sep", ";").option("header", True).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The corpus index (path, title, rights_status, domain, scope), `;` between fields."""
    return spark.read.schema("path string, title string, rights_status string, domain string, scope string").option("sep", ";").option("header", True).csv(path)


def read_progress(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(n, ts) of a progress sidecar of {n, ts} lines, ts in epoch seconds; batch or stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("n long, ts double").json(path).select("n", F.timestamp_millis(F.round(F.col("ts") * 1000).cast("long")).alias("ts"))


MAX_ROWS = 5000


def _markdown(stem: str, text: str, max_rows: int) -> str:
    head = text[:2048]
    mark = max(",;\t|", key=lambda d: (head.count(d), d == ","))
    lines = [f"# {stem}"]
    for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=mark if mark in head else ",")):
        if not any(cell.strip() for cell in row):
            continue
        if i >= max_rows:
            lines.append(f"[... remaining rows omitted after {max_rows} ...]")
            break
        lines.append("| " + " | ".join(cell.strip().replace("|", "\\|") for cell in row) + " |")
    return "\n".join(lines)


def csv_to_markdown(spark: SparkSession, path: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(file, markdown) of every .csv below path: a heading of the file's stem, then each row that is not blank as a table
    line. The delimiter is the most frequent of , ; tab | in the file's head; a byte-order mark goes; from row max_rows on
    (blank ones counted) one line says that the rest is left out. An empty file is its heading alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)

    def run(batches):
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            done = [_markdown(n.rsplit("/", 1)[-1].rsplit(".", 1)[0], (t or b"").decode("utf-8-sig", "replace"), max_rows) for n, t in zip(names, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["file", "markdown"])

    return files.select("path", "content").mapInArrow(run, "file string, markdown string")
