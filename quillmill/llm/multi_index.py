"""Approximate nearest neighbours by largest inner product: an inverted multi-index over two vector halves.

Each half has its own centroids, so K centroids a half make K * K cells. A query walks the cells by the sum of its two
centroid distances (a heap over the two sorted lists) until it has met a share of all vectors; how large that share
must be is measured, on trial vectors whose true neighbours are found by comparing them with every row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

K, RECALL = 20, 0.95
#: What the centroids are fitted on: so many vectors at most, and so many bytes of them; and what the share is measured on.
SAMPLE, SAMPLE_BYTES, TRIALS = 16_384, 32 << 20, 256
MAX_CENTROIDS, ROUNDS = 256, 12
#: Vectors, and about how many queries, that meet in one task's block; queries scored at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 50_000, 64
FAN_IN, MAX_TASKS = 64, 16_384


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _far(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, but for the rows' own lengths, which are the same for all centroids."""
    return (centroids**2).sum(1) - 2 * rows @ centroids.T


def _fit(rows: np.ndarray, k: int) -> np.ndarray:
    """k means by Lloyd's rounds from evenly spread distinct rows; fewer where there are fewer distinct rows."""
    distinct = np.unique(rows, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _far(rows, centroids).argmin(1)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.stack([np.bincount(nearest, c, len(centroids)) for c in rows.T], 1) if rows.shape[1] else np.zeros_like(centroids)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


class MultiIndex:
    """Centroids of the halves, the sizes of the cells, and the share of all vectors that a query meets.

    Inner products become distances by one more coordinate, sqrt(longest^2 - length^2) for a vector and 0 for a query: then
    the nearest vector is the one of largest inner product, also where lengths differ.
    """

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.cut, self.longest = sample.shape[1] // 2, longest
        self.centroids = [_fit(half, k) for half in self._halves(sample)]
        self.shape = tuple(len(c) for c in self.centroids)
        self.sizes, self.share = np.zeros(self.shape, np.int64), 1.0

    def _halves(self, rows: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        extra = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.longest - (rows**2).sum(1), 0))
        return rows[:, : self.cut], np.hstack([rows[:, self.cut :], extra[:, None]])

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = (_far(half, c).argmin(1) for half, c in zip(self._halves(rows), self.centroids, strict=True))
        return i, j

    def distances(self, queries: np.ndarray) -> list[np.ndarray]:
        return [_far(half, c) for half, c in zip(self._halves(queries, True), self.centroids, strict=True)]

    def walk(self, first: np.ndarray, second: np.ndarray, need: float) -> Iterator[tuple[int, int]]:
        """Cells (i, j) by the sum of the query's distances, until those walked hold `need` vectors."""
        oi, oj = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        di, dj, oi, oj, sizes = first[oi].tolist(), second[oj].tolist(), oi.tolist(), oj.tolist(), self.sizes
        taken = [0] * len(oi)  # cells walked of each row of the sorted lists; they are walked from left to right
        heap, met = [(di[0] + dj[0], 0, 0)], 0
        while heap and met < need:
            _, a, b = heapq.heappop(heap)
            taken[a] = b + 1
            if size := sizes[oi[a], oj[b]]:
                met += int(size)
                yield oi[a], oj[b]
            # a cell enters when both cells before it have been walked
            if a + 1 < len(oi) and taken[a + 1] == b:
                heapq.heappush(heap, (di[a + 1] + dj[b], a + 1, b))
            if b + 1 < len(oj) and (a == 0 or taken[a - 1] > b + 1):
                heapq.heappush(heap, (di[a] + dj[b + 1], a, b + 1))


def _best(scores: np.ndarray, rows: np.ndarray, query: np.ndarray, ids: list[list[int]], m: int, slack: float) -> list[tuple[float, int]]:
    """The m best (-score, id), ties to smaller ids: candidates by a matrix product, whose last bits depend on the rows'
    places, then scored again one by one. ids: of each row, ascending."""
    if len(scores) > m:
        near = np.flatnonzero(scores >= max(np.partition(scores, -m)[-m] - slack, -1e300))
    else:
        near = np.flatnonzero(scores > -np.inf)
    exact = (rows[near] * query).sum(1) + 0.0
    order = np.lexsort(([ids[x][0] for x in near.tolist()], -exact))[:m]
    return sorted((-float(exact[o]), i) for o in order.tolist() for i in ids[near[o]])[:m]


def _scan(m: int):
    """Over rows (i, b, q, kind, gid, vector, list, j) sorted so that a block's vectors come before its queries: the best m of
    the block for each of its queries. list is a vector's ids, or the second centroids that a query walks."""

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if tuple(keys[lo, :3]) != key:
                    key, held, block = tuple(keys[lo, :3]), [], None
                part = batch.slice(lo, hi - lo)
                if keys[lo, 3] == 0:
                    held.append((_matrix(part.column("vector")), part.column("list").to_pylist(), np.asarray(part.column("j"), np.int64)))
                    continue
                if not held:
                    continue
                if block is None:
                    block = np.vstack([h[0] for h in held]), [x for h in held for x in h[1]], np.concatenate([h[2] for h in held])
                    long = float(np.sqrt((block[0] ** 2).sum(1).max()))
                rows, ids, js = block
                starts = np.flatnonzero(np.r_[True, js[1:] != js[:-1]]).tolist()
                runs = list(zip(js[starts].tolist(), starts, [*starts[1:], len(js)], strict=True))
                for at in range(0, part.num_rows, AT_ONCE):
                    few = part.slice(at, AT_ONCE)
                    queries, walked = _matrix(few.column("vector")), [set(x) for x in few.column("list").to_pylist()]
                    scores = np.full((len(queries), len(rows)), -np.inf)
                    for j, s, e in runs:
                        on = [x for x, w in enumerate(walked) if j in w]
                        if on:
                            scores[on, s:e] = queries[on] @ rows[s:e].T
                    tops = [_best(scores[x], rows, queries[x], ids, m, 1e-12 * long * float(np.sqrt((queries[x] ** 2).sum()))) for x in range(len(queries))]
                    tops = [[{"neg": s, "id": i} for s, i in t] for t in tops]
                    yield pa.RecordBatch.from_arrays([few.column("gid"), few.column("block"), pa.array(tops, pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())])))], ["gid", "block", "top"])

    return run


def _merged(tops: DataFrame, blocks: int, m: int) -> DataFrame:
    """(gid, top) of the best m over all blocks: FAN_IN blocks are merged at a time, so no row grows with their number."""
    while True:
        blocks = -(-blocks // FAN_IN)
        joined = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, m).alias("top")
        tops = tops.withColumn("block", F.expr(f"cast(floor(block / {FAN_IN}) as int)")).groupBy("gid", "block").agg(joined)
        if blocks <= 1:
            return tops.select("gid", "top")


def _trial_neighbours(cells: DataFrame, trials: np.ndarray, gids: list[int], k: int) -> list[tuple[int, int, int]]:
    """(trial, i, j) of the k nearest other vectors of each trial, by comparing it with all: at most TRIALS * k rows."""

    def run(batches):
        best = [np.zeros((len(trials), 0))] * 3
        for b in batches:
            gid, i, j = (np.asarray(b.column(c)) for c in ("gid", "i", "j"))
            scores = trials @ _matrix(b.column("vector")).T
            scores[np.asarray(gids)[:, None] == gid[None, :]] = -np.inf
            whole = [np.hstack([best[0], scores]), *(np.hstack([old, np.broadcast_to(x, scores.shape)]) for old, x in zip(best[1:], (i, j), strict=True))]
            order = np.argsort(-whole[0], axis=1, kind="stable")[:, :k]
            best = [np.take_along_axis(x, order, 1) for x in whole]
        t = np.broadcast_to(np.arange(len(trials))[:, None], best[0].shape)
        ok = best[0] > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(t[ok]), pa.array(best[0][ok]), pa.array(best[1][ok].astype(np.int64)), pa.array(best[2][ok].astype(np.int64))], ["t", "score", "i", "j"])

    found = cells.select("gid", "vector", "i", "j").mapInArrow(run, "t long, score double, i long, j long")
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "i", "j"))
    return [(r.t, r.i, r.j) for r in found.withColumn("place", place).where(F.col("place") <= k).select("t", "i", "j").collect()]


def build_index(vectors: DataFrame, k: int = K, recall: float = RECALL) -> tuple[MultiIndex, DataFrame, np.ndarray]:
    """(index, cells, share of trials that walk into each first centroid): every row of vectors (gid, vector, ids) with its
    cell (i, j). The centroids are fitted on a sample by hash; the walked share is the smallest that held `recall` of the
    trials' true neighbours."""
    count, longest, dim = vectors.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("vector"))).first()
    bound = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    drawn = vectors.select("gid", "vector").orderBy(F.xxhash64("vector"), "gid").limit(bound).collect()
    sample = np.array([r.vector for r in drawn])
    centroids = min(MAX_CENTROIDS, 2 ** round(np.log2(2 * count**0.25)))
    index = MultiIndex(sample, longest, centroids)

    def place(batches):
        for b in batches:
            i, j = index.cells(_matrix(b.column("vector")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], [*b.schema.names, "i", "j"])

    cells = settle(vectors.mapInArrow(place, "gid long, vector array<double>, ids array<long>, i int, j int"), "cells")
    for r in cells.groupBy("i", "j").agg(F.count("*").alias("n")).collect():  # one row a cell, MAX_CENTROIDS^2 at most
        index.sizes[r.i, r.j] = r.n
    trials = sample[:TRIALS]
    first, second = index.distances(trials)
    sums, shares = first[:, :, None] + second[:, None, :], []
    for t, i, j in _trial_neighbours(cells, trials, [r.gid for r in drawn[:TRIALS]], k):
        shares.append(index.sizes[sums[t] <= sums[t, i, j]].sum() / count)
    if shares:
        index.share = float(np.quantile(shares, recall, method="higher"))
    visits = np.zeros(index.shape[0])
    for t in range(len(trials)):
        visits[list({i for i, _ in index.walk(first[t], second[t], index.share * count)})] += 1 / len(trials)
    return index, cells, visits


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each row where is_query, nearest first, ties to smaller ids.

    Rows without an id or a usable vector take no part, nor do vectors of another length than most have. Rows that share
    an id are one vector (the least). Equal vectors are searched and found as one, with their k + 1 smallest ids: more can
    be in nobody's answer. A query walks at least k + 1 vectors, so small tables give all their rows; an empty one none.
    Other columns are not returned.
    """
    m = k + 1
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    valid = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    once = settle(valid.groupBy("id", F.size("vector").alias("dim")).agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")), "vectors")
    spark, schema = rows.sparkSession, "query_id long, rank int, id long, score double"
    usual = once.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    once = once.where(F.col("dim") == usual.dim).drop("dim")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    groups = once.select("id", "vector").withColumn("place", place).where(F.col("place") <= m).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = settle(groups.select(F.monotonically_increasing_id().alias("gid"), "vector", "ids"), "groups")
    index, cells, visits = build_index(groups, k, recall)
    asked = settle(once.where("asks").select("id", "vector").join(groups.select("gid", "vector"), "vector").select(F.col("id").alias("query_id"), "gid"), "asked")
    queries = cells.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "vector")
    total, count = int(index.sizes.sum()), asked.count()
    need = max(index.share * total, m)
    parts = [max(1, -(-int(n) // BLOCK)) for n in index.sizes.sum(1)]
    copies = [max(1, -(-int(v * count) // QUERY_BLOCK)) for v in visits]
    first_block = np.concatenate([[0], np.cumsum(parts)]).tolist()

    def walk(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                vectors, gids = _matrix(b.column("vector")), b.column("gid").to_pylist()
                first, second = index.distances(vectors)
                keys, source, lists = [], [], []
                for x, gid in enumerate(gids):
                    walked: dict[int, list[int]] = {}
                    for i, j in index.walk(first[x], second[x], need):
                        walked.setdefault(i, []).append(j)
                    for i, js in walked.items():
                        for part in range(parts[i]):
                            keys.append((i, part, gid % copies[i], 1, gid, -1, first_block[i] + part))
                            source.append(x)
                            lists.append(js)
                cols = list(zip(*keys, strict=True))
                named = {"i": pa.array(cols[0], pa.int32()), "b": pa.array(cols[1], pa.int32()), "q": pa.array(cols[2], pa.int32()), "kind": pa.array(cols[3], pa.int32()), "gid": pa.array(cols[4], pa.int64()), "vector": _lists(vectors[source]), "list": pa.array(lists, pa.list_(pa.int64())), "j": pa.array(cols[5], pa.int32()), "block": pa.array(cols[6], pa.int32())}
                yield pa.RecordBatch.from_arrays(list(named.values()), list(named))

    shape = "i int, b int, q int, kind int, gid long, vector array<double>, list array<long>, j int, block int"
    asking = queries.repartition(spark.sparkContext.defaultParallelism if count < QUERY_BLOCK else -(-count // (QUERY_BLOCK // 8)), "gid").mapInArrow(walk, shape)
    lookup = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("i") + 1)
    held = cells.select("i", F.pmod(F.xxhash64("gid"), lookup(parts)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), lookup(copies) - 1)).alias("q"), F.lit(0).alias("kind"), "gid", "vector", F.col("ids").alias("list"), "j", F.lit(-1).alias("block"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, sum(p * c for p, c in zip(parts, copies, strict=True))))
    met = held.union(asking).repartition(tasks, "i", "b", "q").sortWithinPartitions("i", "b", "q", "kind", "j")
    tops = met.mapInArrow(_scan(m), "gid long, block int, top array<struct<neg: double, id: long>>")
    answers = settle(_merged(tops, first_block[-1], m), "answers")
    mine = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked.join(answers, "gid").select("query_id", F.posexplode(mine).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.neg") + F.lit(0.0)).alias("score"))
