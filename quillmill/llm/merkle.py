"""Merkle manifest of a table: leaves get their places from bitmap ranks, slot arrays reduce the levels, proofs fold back.

A group's leaves ascend by id. Nobody sorts them: the ids of a group are a bitmap of 64-bit words (only words with a bit
exist), a directory holds the popcounts before each word, and a leaf's place is that base plus the popcount of the lower
bits of its own word. Places are keys: every BLOCK consecutive leaves meet in one small task as an array by slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

FANOUT, DEPTH = 8, 3
BLOCK = FANOUT**DEPTH  # nodes to a task's slot array: three levels are reduced at once
STEP = 20  # bits of a directory's level: no running sum is over more than 2^20 rows
NO_ID = -(1 << 57) - 1  # the word of null ids, before that of the smallest one
NODE = "g string, rank long, n long, digest binary"


def field_text(value: Column) -> Column:
    """'-' for null, else UTF-8 byte count, ':', value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]), 256)


def _digest(nodes: Sequence[bytes]) -> bytes:
    return sha256(b"".join(nodes).hex().encode()).digest()


def _depth(n: int) -> int:
    """Levels that a block reduces: all DEPTH while the group has more blocks, else until one node is left."""
    d = 0
    while d < DEPTH and FANOUT**d < n:
        d += 1
    return d


def _levels(table: pa.Table) -> list[list[bytes]]:
    """The block's nodes by slot, and the levels above them."""
    slots: list[bytes] = [b""] * table.num_rows
    for rank, digest in zip(table["rank"].to_pylist(), table["digest"].to_pylist(), strict=True):
        slots[rank % BLOCK] = digest
    levels = [slots]
    for _ in range(_depth(table["n"][0].as_py())):
        below = levels[-1]
        levels.append([_digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _proof(levels: list[list[bytes]], slot: int) -> bytes:
    """For each level: place in the run, number of siblings, the siblings from left to right."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % FANOUT
        run = nodes[first : first + FANOUT]
        place = slot - first
        out += [bytes((place, len(run) - 1)), *run[:place], *run[place + 1 :]]
        slot //= FANOUT
    return b"".join(out)


def fold(leaf: bytes, proof: bytes) -> tuple[bytes, bytes]:
    """(the root that leaf and proof give, digest of all siblings in order)."""
    at, siblings = 0, []
    while at < len(proof):
        place, count = proof[at], proof[at + 1]
        run = [proof[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(count)]
        siblings += run
        leaf = _digest([*run[:place], leaf, *run[place:]])
        at += 2 + 32 * count
    return leaf, _digest(siblings)


def _climb(table: pa.Table) -> pa.Table:
    n = table["n"][0].as_py()
    row = (table["g"][0].as_py(), table["rank"][0].as_py() // BLOCK, -(-n // BLOCK), _levels(table)[-1][0])
    return pa.table([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g", "rank", "n", "digest"])


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes with their proofs: what lies in the block, then the block's own proof."""
    levels, rest = _levels(nodes), above["proof"][0].as_py()
    proofs = [_proof(levels, rank % BLOCK) + rest for rank in nodes["rank"].to_pylist()]
    given = [pa.array([above[c][0].as_py()] * nodes.num_rows, pa.binary()) for c in ("subroot", "root")]
    out = nodes.drop_columns(["_block"])
    for name, column in (("proof", pa.array(proofs, pa.binary())), ("subroot", given[0]), ("root", given[1])):
        out = out.append_column(name, column)
    return out


def _blocked(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn("_block", block)


def _tree(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes (g, rank, n, digest), then the tables of block roots above them, down to one node a group."""
    tables = [nodes]
    while True:
        below = _blocked(tables[-1].select("g", "rank", "n", "digest"), F.shiftright("rank", 9))
        tables.append(settle(below.groupBy("g", "_block").applyInArrow(_climb, NODE), "nodes"))
        if most <= BLOCK:
            return tables
        most = -(-most // BLOCK)


def _proofs(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest table with proof, subroot and root, from top (g, proof, subroot, root): one block row for each block."""
    above = top.withColumn("rank", F.lit(0).cast("long"))
    for nodes in reversed(tables[:-1]):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", proof binary, subroot binary, root binary"
        own = _blocked(nodes, F.shiftright("rank", 9)).groupBy("g", "_block")
        above = own.cogroup(above.select("g", F.col("rank").alias("_block"), "proof", "subroot", "root").groupBy("g", "_block")).applyInArrow(_descend, schema)
    return above


def _directory(words: DataFrame) -> DataFrame:
    """words (g, word, bits, held) with base, the rows of the group in smaller words, and n, all rows of the group."""

    def before(*keys: str, order: str) -> Column:
        return F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    low = words.withColumn("s1", F.shiftright("word", STEP))
    mid = low.groupBy("g", "s1").agg(F.sum("held").alias("held")).withColumn("s2", F.shiftright("s1", STEP))
    top = mid.groupBy("g", "s2").agg(F.sum("held").alias("held"))
    top = top.select("g", "s2", before("g", order="s2").alias("b2"), F.sum("held").over(Window.partitionBy("g")).alias("n"))
    mid = mid.withColumn("b1", before("g", "s2", order="s1")).join(top, ["g", "s2"]).select("g", "s1", (F.col("b1") + F.col("b2")).alias("b1"), "n")
    low = low.withColumn("b0", before("g", "s1", order="word")).join(mid, ["g", "s1"])
    return low.select("g", "word", "bits", "held", (F.col("b0") + F.col("b1")).alias("base"), "n")


def _places(leaves: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, int]:
    """leaves (g, id, leaf, *carry) with rank in the group and n, and the largest n."""
    keyed = leaves.withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(NO_ID))).withColumn("bit", F.coalesce(F.expr("cast(id & 63 as int)"), F.lit(0)))
    words = settle(keyed.groupBy("g", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("held")), "words")
    index = settle(_directory(words), "directory")
    most = index.agg(F.max("n")).first()[0] or 0
    crowded = F.col("held") > F.bit_count("bits")
    found, keep = keyed.join(index, ["g", "word"]), ["g", "rank", "n", "id", "leaf", *carry]
    placed = found.where(~crowded).withColumn("rank", F.col("base") + F.expr("bit_count(bits & ~shiftleft(-1L, bit))")).select(keep)
    if not index.where(crowded).isEmpty():
        # repeated ids: their rows ascend by leaf, equal rows are counted and dealt out again
        same = found.where(crowded).groupBy("g", "word", "bit", "base", "n", "id", "leaf", *carry).agg(F.count("*").alias("copies")).withColumn("head", F.substring("leaf", 1, 4))
        run = lambda what, keys, order: F.coalesce(F.sum(what).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        heads = same.groupBy("g", "word", "bit", "head").agg(F.sum("copies").alias("held"))
        heads = heads.select("g", "word", "bit", "head", run("held", ["g", "word"], ["bit", "head"]).alias("lower"))
        inner = same.withColumn("inner", run("copies", ["g", "word", "bit", "head"], ["leaf", *carry])).join(heads, ["g", "word", "bit", "head"])
        dealt = inner.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        placed = placed.union(dealt.withColumn("rank", F.col("base") + F.col("lower") + F.col("inner") + F.col("k")).select(keep))
    return placed, most


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, *carry) for each row: leaf, subroot and root are hex, proof is what fold() takes.

    A leaf is the digest of the named fields, null as '-'. Within a group leaves ascend by id, null first; rows that
    share an id ascend by leaf, and equal rows each have a place of their own. Groups ascend bytewise, null first; an
    empty text is a field of length 0. carry: further text columns of the row, by name, that come out beside its proof.
    Other columns of docs are not returned. An empty table gives no rows. Ids are integers.
    """
    carried = carry or {}
    names = [f"c{i}" for i in range(len(carried))]
    key = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    rows = docs.select(key.alias("g"), F.col(id_col).cast("long").alias("id"), F.unhex(leaf_digest([F.col(c) for c in fields])).alias("leaf"), *[c.alias(n) for n, c in zip(names, carried.values(), strict=True)])
    placed, most = _places(settle(rows, "leaves"), names)
    leaves = settle(placed.withColumnRenamed("leaf", "digest"), "placed")
    tables = _tree(leaves, most)
    # one row a group from here: the groups' roots are ordered in one task
    subroots = tables[-1].select("g", "digest")
    groups = subroots.count()
    ordered = settle(subroots.select(F.lit("").alias("g"), (F.row_number().over(Window.orderBy("g")) - 1).cast("long").alias("rank"), F.lit(groups).cast("long").alias("n"), "digest", F.col("g").alias("name")), "subroots")
    upper = _tree(ordered, groups)
    whole = _proofs(upper, upper[-1].select("g", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root")))
    top = settle(whole.select(F.col("name").alias("g"), "proof", F.col("digest").alias("subroot"), "root"), "tops")
    text = lambda c: F.lower(F.hex(c))
    return _proofs(tables, top).select(F.col("id").alias(id_col), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof", *[F.col(n).alias(name) for n, name in zip(names, carried, strict=True)])


def fold_proofs(rows: DataFrame, leaf_col: str) -> DataFrame:
    """rows with proof_sha256, the digest of all siblings, and folded_root, the root that leaf_col (hex) and proof give."""

    def run(batches):
        for b in batches:
            got = [fold(bytes.fromhex(leaf), proof) for leaf, proof in zip(b.column(leaf_col).to_pylist(), b.column("proof").to_pylist(), strict=True)]
            out = b.append_column("proof_sha256", pa.array([p.hex() for _, p in got], pa.string()))
            yield out.append_column("folded_root", pa.array([r.hex() for r, _ in got], pa.string()))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", proof_sha256 string, folded_root string")
