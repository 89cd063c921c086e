"""Removal of repeated byte strings by a distributed, sampled suffix array.

Two equal windows of LENGTH bytes choose the same anchor in them: the K-gram of least hash (a minimiser), at the same
offset. So only anchor suffixes are sorted, about one in eighty, and no repeat is missed:

1. Each anchor stands for the run of windows that chose it. (seed, context) - hashes of the anchor's K bytes and of all
   bytes of its run - are counted over all documents, so groups of copies and common passages collapse to one row with
   its count before anything else.
2. One occurrence of each context that is repeated, or whose seed has several contexts, is fetched; these suffixes are
   range-partitioned by their leading bytes with sampled splitters (repartitionByRange) and sorted by multikey quicksort
   within buckets. A suffix that stands for several occurrences is repeated whole, one that stands for a single one where
   a neighbour in the order shares LENGTH bytes. Equal leading bytes never part (buckets are closed where they change),
   so comparing across bucket boundaries finds nothing more. A seed with over MAX_CONTEXTS contexts would make a bucket
   of its own that large; it is cut by window content instead, exactly, and counted with partial aggregation.
3. Repeated windows go back to every occurrence of their context by a join; each text then drops what they cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

LENGTH, K, BLOCK, BUCKET_BYTES, MAX_CONTEXTS = 200, 40, 1 << 20, 2 << 20, 50_000
_M = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_UP = _powers(BLOCK + 2 * LENGTH, _M)
_DOWN = _powers(BLOCK + 2 * LENGTH, pow(_M, -1, 1 << 64))


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run in a block of at most BLOCK + 2*LENGTH bytes.

    ends: for each byte, where its document ends in the block; windows that would cross it do not exist.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[buf] * _UP[:n])])
    grams = (sums[K:] - sums[:-K]) * _DOWN[: n - K + 1]
    grams = (grams ^ (grams >> np.uint64(32))) * _MIX
    bits = np.uint64(22)
    low = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equals wins
    width, have = LENGTH - K + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    starts = np.flatnonzero(ends[: len(low)] - np.arange(len(low)) >= LENGTH)
    if not len(starts):
        return none, none, none
    at = (low[starts] & np.uint64((1 << 22) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return at[new], starts[new], starts[last]


def text_blocks(texts: list[bytes]):
    """(buffer, document ends, [(document, offset in it, place in the buffer, bytes)]) of bounded size: short texts are
    packed together, long ones are cut so that every window lies in exactly one block."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for lo in range(0, len(t) - LENGTH + 1, BLOCK):
            piece = t[lo : lo + BLOCK + LENGTH - 1]
            if size + len(piece) > BLOCK + LENGTH and parts:
                yield _packed(parts)
                parts, size = [], 0
            parts.append((i, lo, piece))
            size += len(piece)
    if parts:
        yield _packed(parts)


def _packed(parts):
    sizes = np.array([len(p[2]) for p in parts])
    stops = np.cumsum(sizes)
    raw = b"".join(p[2] for p in parts)
    return raw, np.repeat(stops, sizes), [(i, lo, int(e - s)) for (i, lo, _), e, s in zip(parts, stops, sizes, strict=True)]


def text_anchors(texts: list[bytes]):
    """(document number, first window, windows, anchor offset, seed, context) of every run of the texts, by blocks."""
    digest = xxhash.xxh3_64_intdigest
    for raw, ends, parts in text_blocks(texts):
        a, first, last = anchors(np.frombuffer(raw, np.uint8), ends)
        if not len(a):
            continue
        which = np.searchsorted(np.array([p[2] for p in parts]), first, "right") - 1
        docs = np.array([p[0] for p in parts])[which]
        shift = np.array([p[1] - p[2] for p in parts])[which]
        seeds = np.array([digest(raw[x : x + K]) for x in a.tolist()], np.uint64)
        contexts = np.array([digest(raw[f : z + LENGTH], x - f) for x, f, z in zip(a.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
        yield docs, first + shift, last - first + 1, a - first, seeds.view(np.int64), contexts.view(np.int64)


def repeated(buf: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Mask of the windows (LENGTH bytes of buf from each of at) that equal another one of their group.

    Multikey quicksort with eight-byte symbols: in each round the ties that a further symbol parts are sorted by it,
    ties that agree pass on unsorted, and windows left alone drop out.
    """
    mask = np.zeros(len(at), bool)
    words = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
    act = np.argsort(group, kind="stable")
    cls = group[act]
    for depth in range(-1, LENGTH // 8):
        if depth < 0:
            new = np.concatenate([[True], cls[1:] != cls[:-1]])
        else:
            word = words[at[act] + 8 * depth].astype(np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
            mixed = np.minimum.reduceat(word, edge) != np.maximum.reduceat(word, edge)
            if mixed.any():
                some = np.flatnonzero(np.repeat(mixed, np.diff(np.append(edge, len(cls)))))
                order = some[np.lexsort((word[some], cls[some]))]
                act[some], word[some] = act[order], word[order]
            new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (word[1:] != word[:-1])])
        cls = np.cumsum(new) - 1
        keep = np.bincount(cls)[cls] > 1
        act, cls = act[keep], cls[keep]
        if not len(act):
            return mask
    mask[act] = True
    return mask


def ranges_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _keys(text: str):
    """Two hashes of a text, and one of the row: rows that repeat id and text share it."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(11), text).alias("k2"), F.xxhash64(F.lit(13), "id", text).alias("k3")]


_RUNS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("k3", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("seed", pa.int64()), ("ctx", pa.int64()), ("times", pa.int64())])


def _anchor_rows(rows: DataFrame, collapse: bool) -> DataFrame:
    """Runs of all texts; with collapse equal contexts of a block become one row that counts them."""

    def run(batches):
        for b in batches:
            k1, k2, k3 = (b.column(i).to_numpy() for i in (0, 1, 2))
            for docs, first, n, off, seed, ctx in text_anchors(b.column(3).to_pylist()):
                times = np.ones(len(docs), np.int64)
                if collapse:
                    order = np.lexsort((ctx, seed))
                    new = np.flatnonzero(np.concatenate([[True], (seed[order][1:] != seed[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])]))
                    times, pick = np.diff(np.append(new, len(order))), order[new]
                    docs, first, n, off, seed, ctx = (x[pick] for x in (docs, first, n, off, seed, ctx))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[docs], k2[docs], k3[docs], first, n.astype(np.int32), off.astype(np.int32), seed, ctx, times)], schema=_RUNS)

    return rows.select("k1", "k2", "k3", "t").mapInArrow(run, "k1 long, k2 long, k3 long, first long, n int, off int, seed long, ctx long, times long")


def _cut_contexts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(lead, seed, ctx, off, times, hot, body): one occurrence of each wanted context, cut from its own row (k3), so that the
    copies of a text are not cut again."""
    lists = wanted.groupBy("k3").agg(F.collect_list(F.struct("first", "n", "off", "seed", "ctx", "times", "hot")).alias("cuts"))

    def cut(batches):
        for b in batches:
            out = []
            for text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c in cuts:
                    body = text[c["first"] : c["first"] + c["n"] + LENGTH - 1]
                    if xxhash.xxh3_64_intdigest(body, c["off"]) == c["ctx"] % (1 << 64):
                        out.append((body[c["off"] : c["off"] + K], c["seed"], c["ctx"], c["off"], c["times"], c["hot"], body))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], ["lead", "seed", "ctx", "off", "times", "hot", "body"])

    return rows.join(lists, "k3").select("t", "cuts").mapInArrow(cut, "lead binary, seed long, ctx long, off int, times long, hot boolean, body binary")


_FOUND = pa.schema([("seed", pa.int64()), ("ctx", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _sort_buckets(cuts: DataFrame) -> DataFrame:
    """(seed, ctx, lo, hi): runs of repeated windows in the contexts, from locally sorted buckets."""

    def solve(held):
        seen, kept = set(), []
        for r in held:
            if (r[1], r[2]) not in seen:
                seen.add((r[1], r[2]))
                kept.append(r)
        counts = np.array([len(r[6]) - LENGTH + 1 for r in kept])
        places = np.concatenate([[0], np.cumsum([len(r[6]) for r in kept])])[:-1]
        owner = np.repeat(np.arange(len(kept)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        leads: dict[tuple, int] = {}
        lead = np.array([leads.setdefault((r[0], r[1]), len(leads)) for r in kept])
        offsets = np.array([r[3] for r in kept])
        mask = repeated(np.frombuffer(b"".join(r[6] for r in kept), np.uint8), places[owner] + within, lead[owner] * (LENGTH + 1) + offsets[owner] - within)
        stops = np.cumsum(counts)
        out = [(r[1], r[2], a, z) for r, s, c in zip(kept, stops, counts, strict=True) for a, z in (ranges_of(mask[s - c : s]) if r[4] == 1 else [(0, int(c) - 1)])]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t.type) for i, t in enumerate(_FOUND)], schema=_FOUND)

    def sort(batches):
        held, size = [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if held and size > BUCKET_BYTES and r[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield solve(held)

    ordered = cuts.repartitionByRange(F.col("lead")).sortWithinPartitions("lead", "seed")
    return ordered.mapInArrow(sort, "seed long, ctx long, lo int, hi int")


def _count_windows(cuts: DataFrame) -> DataFrame:
    """As _sort_buckets, for seeds with too many contexts for one bucket: windows are counted by offset and two hashes."""

    def explode(batches):
        for b in batches:
            cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in ("seed", "ctx", "off", "body")]
            for seed, ctx, off, body in zip(*cols, strict=True):
                m = len(body) - LENGTH + 1
                wins = [body[i : i + LENGTH] for i in range(m)]
                yield pa.RecordBatch.from_pydict({"seed": [seed] * m, "ctx": [ctx] * m, "i": list(range(m)), "d": [off - i for i in range(m)], "h1": [xxhash.xxh3_64_intdigest(w) >> 1 for w in wins], "h2": [xxhash.xxh64_intdigest(w) >> 1 for w in wins]})

    wins = cuts.dropDuplicates(["seed", "ctx"]).mapInArrow(explode, "seed long, ctx long, i long, d long, h1 long, h2 long")
    twice = wins.groupBy("seed", "d", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    hit = wins.join(twice, ["seed", "d", "h1", "h2"])
    return hit.select("seed", "ctx", F.col("i").cast("int").alias("lo"), F.col("i").cast("int").alias("hi"))


def repeated_spans(rows: DataFrame, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(k1, k2, spans): for each text with repeats its spans [start, end) of repeated bytes, unsorted and overlapping."""
    runs = _anchor_rows(rows, collapse=True).repartition("seed")
    grouped = runs.groupBy("seed", "ctx").agg(F.sum("times").alias("times"), *[F.first(c).alias(c) for c in ("k3", "first", "n", "off")])
    by_seed = Window.partitionBy("seed")
    grouped = grouped.withColumn("all_times", F.sum("times").over(by_seed)).withColumn("contexts", F.count("*").over(by_seed)).where("all_times > 1")
    grouped = settle(grouped.withColumn("hot", F.col("contexts") > max_contexts), "contexts")
    cuts = _cut_contexts(grouped, rows.select("k3", "t"))  # all of them are repeated or have others of their seed beside
    found = _sort_buckets(cuts.where("NOT hot"))
    if not grouped.where("hot").isEmpty():
        whole = grouped.where("hot AND times > 1").select("seed", "ctx", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
        found = found.union(whole).union(_count_windows(cuts.where("hot")))
    found = settle(found, "repeats")
    places = _anchor_rows(rows, collapse=False).select("k1", "k2", "first", "seed", "ctx")
    spans = places.join(found, ["seed", "ctx"]).select("k1", "k2", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") + LENGTH).alias("end"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row: spans are the maximal removed runs of bytes, kept the bytes left.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same or another row; strings
    never cross rows and are judged on the input. Null text counts as empty and keeps nothing; texts under LENGTH bytes
    stay whole; repeated rows are each other's copies; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    rows = rows.select("id", "t", *_keys("t"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeated_spans(rows, max_contexts)
    joined = rows.join(spans, ["k1", "k2"], "left").select("id", "t", "spans")

    def drop(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sizes, runs, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for a, z in sorted((s["start"], s["end"]) for s in found or []):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], z)
                        else:
                            merged.append([a, z])
                    pieces, last = [], 0
                    for a, z in merged:
                        pieces.append(text[last:a])
                        last = z
                    sizes.append(len(text))
                    runs.append([{"start": a, "end": z} for a, z in merged])
                    kept.append(b"".join([*pieces, text[last:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(drop, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
