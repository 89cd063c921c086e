"""op11 to op13 against brute-force versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import fill_middle, merkle, multi_index
from quillmill.llm.queries import queries

from ..harness import compare

Q = queries()


def table(spark, folder, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Sorted lists, level by level, with every leaf's proof folded again."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(tree, at, node, siblings):
        for nodes in tree[:-1]:
            first = at // 8 * 8
            run = nodes[first : first + 8]
            siblings += run[: at - first] + run[at - first + 1 :]
            node = sha(*run[: at - first], node, *run[at - first + 1 :])
            at //= 8
        return node

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in names}
    trees = {g: levels([leaf(r) for r in order[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(order[g]):
            probe = r
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                probe = r | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])}
            siblings = []
            folded = climb(top, k, climb(trees[g], at, leaf(probe), siblings), siblings)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], sha(*siblings), folded, folded == top[-1][0]))
    return out


def assert_manifest(spark, folder):
    got = [tuple(r) for r in Q["op11_merkle_manifest"](spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    want = plain_manifest(table(spark, folder))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_manifest(spark, docs_dir):
    got = assert_manifest(spark, docs_dir)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 513, None: 9}, {"a": 4097, "b": 8, "é": 65, "B": 512}, {f"g{i}": 1 + i % 3 for i in range(75)}])
def test_manifest_shapes(spark, tmp_path, sizes):
    """One leaf, one more than a block, several rounds, many groups; ids far apart and negative."""
    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 62), 1 << 62) if rng.random() < 0.3 else rng.randrange(-500, 9000), f"Text {g} {i}", g, "s", i) for g, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert_manifest(spark, str(tmp_path))


def test_manifest_repeats(spark, tmp_path):
    """Hundreds of rows that share an id or have none, half of them equal, with a clashing extra column."""
    rows = [(7 if i % 3 else None, f"T {i % 60}", "en" if i % 5 else None, None, i % 2) for i in range(900)] + [(i, "Other", "en", "s", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.withColumn("rank", F.lit("x")).withColumn("word", F.lit(1)).withColumn("g", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    assert_manifest(spark, str(tmp_path))


def test_manifest_ranks_without_sorting_rows(spark):
    """A million consecutive and scattered ids in one group: the places are 0 to n - 1 in the order of the ids."""
    ids = spark.range(0, 300_000).select((F.col("id") * F.when(F.col("id") % 2 == 0, 1).otherwise(40_000_003)).alias("id"))
    leaves = ids.select(F.lit("1a").alias("g"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    placed, most = merkle._places(leaves, [])
    got = placed.orderBy("rank").select("rank", "id").toPandas()
    assert most == 300_000 and (got["rank"].to_numpy() == np.arange(300_000)).all() and got["id"].is_monotonic_increasing


def test_fold_rejects_any_change():
    nodes = [bytes([i]) * 32 for i in range(20)]
    proof = bytes((2, 7)) + b"".join(nodes[:7])
    root, _ = merkle.fold(nodes[9], proof)
    assert merkle.fold(nodes[8], proof)[0] != root and merkle.fold(nodes[9], proof[:-1] + b"x")[0] != root


def test_middle(spark, docs_dir):
    assert compare(spark, docs_dir, Q["op12_fill_in_middle"], __import__("quillmill.llm.oracles").llm.oracles.ORACLES["op12_fill_in_middle"]) > 0


def test_middle_forms():
    rng = random.Random(8)
    seen = set()
    for doc in range(3000):
        text = "".join(rng.choices(["a", "é", "\n", "\r\n", "<", "P>", "<P", "S>", "<S", "M>", "<M", "😀", "\n\n"], k=rng.randrange(0, 14))).encode()
        out, form, n, prefix, middle = fill_middle.transform(text, doc)
        assert fill_middle.restore(out, form) == text
        assert n == len(__import__("re").findall(rb"[^\n]*\n|[^\n]+", text))
        if form == "plain":
            assert out == text and (not text or any(s in text for s in fill_middle.SENTINELS))
        else:
            p, m, s = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
            assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
        seen.add((form, n > 2))
    assert len(seen) == 6
    assert fill_middle.transform(b"a\nb\n", 1, rate=0)[1] == "plain"


def test_middle_long_and_null(spark):
    rows = [(1, "line\n" * 400_000), (None, None), (None, "a\nb\nc"), (2, "no line end"), (2, "no line end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("form", F.lit(2)).withColumn("t", F.lit(3))
    got = fill_middle.restore_texts(fill_middle.fill_in_middle(docs)).collect()
    assert sorted(((r.doc_id, r.restored) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def brute(rows, k=20):
    """{query: [(vec_id, score)]} over usable vectors, ties to smaller ids."""
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    sizes = [len(v) for v in ok.values()]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), -s)) if sizes else 0
    ids = sorted(i for i in ok if len(ok[i]) == dim)
    m = np.array([ok[i] for i in ids], np.float64)
    out = {}
    for at, i in enumerate(ids):
        if i % 20 == 0:
            s = (m * m[at]).sum(1)
            s[at] = -np.inf
            order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[i] = [(ids[o], float(s[o])) for o in order]
    return out


def recall(spark, folder, least):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, folder, "embeddings")]
    want, got = brute(rows), {}
    vectors = dict(rows)
    for r in Q["op13_nearest_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == {q for q, x in want.items() if x}
    for q, found in got.items():
        assert len(found) == len(want[q]) and q not in {i for i, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - np.dot(np.array(vectors[q], float), np.array(vectors[i], float))) < 1e-9 for i, s in found)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    share = hits / max(1, sum(map(len, want.values())))
    assert share >= least, share
    return share


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_neighbour_recall(spark, sf):
    recall(spark, f"/root/testdata/sf{sf}", 0.9)


def save(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("gid", F.lit("x")).withColumn("id", F.lit(1)).repartition(3).write.parquet(f"{folder}/embeddings.parquet")


def test_neighbours_odd_rows(spark, tmp_path):
    """Nulls, zeros, non-finite values, another length, a repeated row, ties by thousands, few candidates."""
    f32 = lambda *v: [float(np.float32(x)) for x in v]
    odd = [(20, None), (40, f32(0, 0, 0)), (60, [1.0, None, 2.0]), (80, f32(1, float("nan"), 0)), (100, f32(1, float("inf"), 0)), (120, []), (None, f32(1, 2, 3)), (140, f32(1, 2)), (160, f32(1, 2, 3)), (160, f32(1, 2, 3))]
    save(spark, str(tmp_path), odd + [(i, f32(1, 0, 0)) for i in range(1000, 1400)] + [(i, f32(-0.0, i % 7, 1)) for i in range(2000, 2300)])
    recall(spark, str(tmp_path), 0.9)
    save(spark, f"{tmp_path}/few", odd + [(3, f32(5, 5, 5)), (0, f32(-1, 2, 0))])
    assert recall(spark, f"{tmp_path}/few", 1.0) == 1.0
    save(spark, f"{tmp_path}/one", [(0, f32(1))])
    assert Q["op13_nearest_neighbours"](spark, f"{tmp_path}/one").count() == 0
    save(spark, f"{tmp_path}/flat", [(i, f32(i + 1)) for i in range(100)])
    assert recall(spark, f"{tmp_path}/flat", 0.9) >= 0.9


def test_neighbours_lengths_and_blocks(spark, tmp_path, monkeypatch):
    """Vectors of very different lengths, and blocks and copies of queries small enough that all of them are split."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    v = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.standard_normal((3000, 16))) * rng.uniform(0.5, 3, (3000, 1))
    save(spark, str(tmp_path), [(i, [float(x) for x in r]) for i, r in enumerate(v)])
    recall(spark, str(tmp_path), 0.9)
    for name, value in (("BLOCK", 50), ("QUERY_BLOCK", 20), ("FAN_IN", 3), ("AT_ONCE", 5)):
        monkeypatch.setattr(multi_index, name, value)
    recall(spark, str(tmp_path), 0.9)


def test_walk_is_in_order_of_the_summed_distance():
    rng = np.random.default_rng(1)
    index = multi_index.MultiIndex(rng.standard_normal((200, 6)), 40.0, 5)
    index.sizes = rng.integers(0, 4, index.shape)
    first, second = (d[0] for d in index.distances(rng.standard_normal((1, 6))))
    walked = [first[i] + second[j] for i, j in index.walk(first, second, np.inf)]
    assert walked == sorted(walked) and len(walked) == (index.sizes > 0).sum()
    assert list(index.walk(first, second, 1)) == [next(index.walk(first, second, np.inf))]
