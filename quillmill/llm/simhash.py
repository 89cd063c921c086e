"""SimHash near-duplicates: fingerprints, deletion-variant index, verified links, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle

SEED, SHINGLE, MAX_DISTANCE, MAX_BUCKET = 42, 3, 2, 256
#: Fingerprints to a task when their index rows are made: each becomes about 66 rows, so this keeps a task near 100 MB.
TASK_FINGERPRINTS = 20_000


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text over its n-word shingles (XXH64, seed 42), repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= n:
        shingles = [b" ".join(words)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: -n])]
        shingles = [joined[s:e] for s, e in zip(starts, ends[n - 1 :], strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for block in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[block : block + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row: fp is the fingerprint as a signed long; null or blank text has 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def variants(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Index rows (fp, key, side) of each fingerprint: for each of its distance//2+1 segments the segment whole, and
    once more for every bit of it with that bit a wildcard (side: the bit's value; -1 for the whole segment)."""
    parts = distance // 2 + 1
    width = -(-64 // parts)
    n = width + 1
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(parts * n - 1))).alias("k"))
    rows = rows.select("fp", F.floor(F.col("k") / n).cast("int").alias("part"), (F.col("k") % n).cast("int").alias("bit"))
    seg = F.expr(f"shiftrightunsigned(fp, part * {width}) & {(1 << width) - 1}L") if width < 64 else F.col("fp")
    rows = rows.withColumn("seg", seg).where(f"part * {width} + bit < 64 OR bit = {width}")
    masked = F.expr(f"CASE WHEN bit = {width} THEN seg ELSE seg & ~shiftleft(1L, bit) END")
    return rows.select("fp", masked.alias("value"), F.expr(f"part * {n} + bit").cast("short").alias("slot"), F.expr(f"CASE WHEN bit = {width} THEN -1 ELSE shiftright(seg, bit) & 1 END").cast("byte").alias("side"))


def links(fps: DataFrame, distance: int = MAX_DISTANCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of all links at `distance` bits or fewer.

    Fingerprints that share a variant are joined and verified: equal segments meet once, under the whole segment,
    and segments that differ in one bit meet once, under that bit. Keys with more than max_bucket fingerprints would
    emit too many pairs; all their members go through an exact other way instead: every mask of `distance` bits of
    the whole fingerprint is a key, and each member is tied to the smallest member of each of its keys. All joins are told
    to merge: Spark sizes exploded index rows as the fingerprints they come from and would broadcast millions.
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    rows = variants(fps, distance)
    keys = rows.groupBy("slot", "value").agg(F.count("*").alias("size"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    keys = keys.where("size > 1 AND (lo < 0 OR lo <> hi)").select("slot", "value", "size")
    members = settle(rows.join(keys.hint("merge"), ["slot", "value"]), "variants")
    small = members.where(F.col("size") <= max_bucket)
    a, b = small.alias("a"), small.where("side <> 0").alias("b")
    same = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.value") == F.col("b.value"))
    meet = ((F.col("a.side") == 0) & (F.col("b.side") == 1)) | ((F.col("a.side") == -1) & (F.col("b.side") == -1) & (F.col("a.fp") < F.col("b.fp")))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    edges = a.where("side < 1").join(b.hint("merge"), same & meet & close).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))
    hot = members.where(F.col("size") > max_bucket).select("fp").distinct()
    if not hot.isEmpty():
        masks = F.array(*[F.lit(np.uint64(sum(1 << i for i in c)).astype(np.int64).item()) for c in combinations(range(64), distance)])
        wild = hot.select("fp", F.posexplode(masks).alias("m", "mask")).select("fp", "m", F.expr("fp & ~mask").alias("rest"))
        hubs = wild.groupBy("m", "rest").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
        edges = edges.union(wild.join(hubs.hint("merge"), ["m", "rest"]).where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    return edges.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id reachable over links of `distance` bits.

    Equal fingerprints form one node. Null text counts as empty (fingerprint 0, linked like any other); repeated ids
    keep their rows; null ids never become a component's id unless it has no other; an empty table gives no rows.
    """
    rows = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    # fingerprints are 8 bytes, so adaptive execution would put millions in one task; the index rows need many
    spread = nodes.select("fp").repartition(-(-nodes.count() // TASK_FINGERPRINTS) or 1)
    labels = components(settle(links(spread, distance), "links"))
    known = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    lows = known.groupBy("label").agg(F.min("low").alias("component_id"))
    final = known.join(lows, "label").select("fp", "component_id")
    return rows.join(final, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
