"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text."""

from __future__ import annotations

import functools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

WINDOW = 10
#: An automaton holds so many windows and bytes of them at most; a larger benchmark is cut into slices with one each.
MAX_WINDOWS, MAX_BYTES = 200_000, 64 << 20
#: Everything but ASCII letters, digits and non-ASCII bytes parts words.
_SPACED = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text with A-Z lower-cased."""
    return (text or b"").lower().translate(_SPACED).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of `size` consecutive words; fewer words, but not none, are one window."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class WindowScanner:
    """The automaton over word numbers: a word that no window has is 0, so it ends every partial match."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.items = list(windows.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, w in enumerate(windows):
            self.automaton.add_word(tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w), (k, len(w)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first, last) ranges of hit words and the ids of the items hit."""
        if self.empty or not words:
            return [], set()
        number, ranges, items = self.numbers.get, [], set()
        for end, (k, n) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            items.update(self.items[k])
            ranges.append((end - n + 1, end))
        return merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of inclusive ranges, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets (end exclusive) in the original text of the sorted hit word ranges."""
    found = list(_WORD.finditer(text.lower()))
    out, at, points = [], 0, 0

    def place(byte: int) -> int:
        nonlocal at, points
        at, points = byte, points + len(text[at:byte].decode())
        return points

    for a, b in hits:
        first = place(found[a].start())
        out.append((first, place(found[b].end())))
    return out


_SCANNERS: dict[str, WindowScanner] = {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, spans) for each row of docs.

    A document word inside any occurrence of a benchmark window (10 consecutive normalised words; a shorter item is one
    window) is hit; spans are the merged hits as code-point offsets in the original text, items the sorted ids (as
    strings) of the items whose windows occur. One automaton is sent to the workers; where the benchmark has over
    max_windows windows or MAX_BYTES of them (both counted first) it is cut by hash into slices that keep to them, and
    all texts are scanned once for each slice, so a worker holds one automaton at a time; the hits alone are
    written and merged. Null texts have no words, very long ones are scanned whole, items
    without words match nothing, repeated items count once, a null item id is ignored, repeated rows repeat their result
    and an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def cut(batches):
        for b in batches:
            ids, wins = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if item is not None:
                    found = dict.fromkeys(b" ".join(w) for w in windows_of(split_words(text)))
                    ids += [item] * len(found)
                    wins += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], ["item", "win"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("t"))
    index = settle(items.mapInArrow(cut, "item string, win binary").distinct(), "windows")
    size, weight = index.agg(F.count("*"), F.sum(F.octet_length("win"))).first()
    slices = max(1, -(-size // max_windows), -(-(weight or 0) // MAX_BYTES))

    def shipped(part: DataFrame):
        table: dict[tuple[bytes, ...], list[str]] = {}
        for r in part.toLocalIterator():  # about max_windows rows, counted above
            table.setdefault(tuple(bytes(r.win).split(b" ")), []).append(r.item)
        return spark.sparkContext.broadcast(table), uuid.uuid4().hex

    if slices == 1:
        windows, name = shipped(index)

        def scan_all(batches):
            scanner = _scanner(windows, name)
            for b in batches:
                split = [split_words(text) for text in b.column(1).to_pylist()]
                got = [scanner.scan(words) for words in split]
                spans = [original_spans(t, g[0]) if g[0] else [] for t, g in zip(b.column(1).to_pylist(), got, strict=True)]
                yield _finished(b.column(0), [len(w) for w in split], [_placed(g[0], s) for g, s in zip(got, spans, strict=True)], [g[1] for g in got], id_col)

        return rows.mapInArrow(scan_all, f"`{id_col}` {kind}, {_OUT}")

    def count(batches):
        for b in batches:
            sizes = [len(split_words(text)) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["id", "text", "n_words"])

    counted = rows.mapInArrow(count, f"id {kind}, text binary, n_words bigint")
    numbered = settle(counted.withColumn("place", F.monotonically_increasing_id()), "texts")
    hits = []
    for k in range(slices):
        windows, name = shipped(index.where(F.pmod(F.xxhash64("win"), F.lit(slices)) == k))

        def scan(batches, windows=windows, name=name):
            scanner = _scanner(windows, name)
            for b in batches:
                places, ranges, items = [], [], []
                for place, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found, met = scanner.scan(split_words(text))
                    if found:
                        places.append(place)
                        ranges.append(_placed(found, original_spans(text, found)))
                        items.append(sorted(met))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(ranges, _RANGES), pa.array(items, pa.list_(pa.string()))], ["place", "at", "items"])

        hits.append(settle(numbered.select("place", "text").mapInArrow(scan, "place bigint, at array<struct<first:int,last:int,start:int,end:int>>, items array<string>"), "hits"))
        windows.unpersist()
    found = functools.reduce(DataFrame.union, hits).groupBy("place").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batches):
        for b in batches:
            yield _finished(b.column(0), b.column(1).to_pylist(), [at or [] for at in b.column(2).to_pylist()], [i or [] for i in b.column(3).to_pylist()], id_col)

    return numbered.select("id", "n_words", "place").join(found, "place", "left").select("id", "n_words", "at", "items").mapInArrow(finish, f"`{id_col}` {kind}, {_OUT}")


def _scanner(windows, name: str) -> WindowScanner:
    """The automaton of broadcast windows, made once for each worker and held until another is needed."""
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = WindowScanner(windows.value)
    return _SCANNERS[name]


def _placed(ranges: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Hit word ranges with their code-point spans."""
    return [{"first": a, "last": z, "start": s, "end": e} for (a, z), (s, e) in zip(ranges, spans, strict=True)]


_NAMES = ("n_words", "n_hit", "n_items", "items", "spans")
_RANGES = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
_OUT = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _finished(ids: pa.Array, sizes: list[int], ranges: list, items: list, id_col: str) -> pa.RecordBatch:
    """The result's columns from the hit ranges of each text, with their spans, and the items hit."""
    out = []
    for n, at, hit in zip(sizes, ranges, items, strict=True):
        hits = merge([(r["first"], r["last"]) for r in at])
        starts, ends = {}, {}  # of several ranges that begin or end at a word, the code point is the same
        for r in at:
            starts[r["first"]], ends[r["last"]] = r["start"], r["end"]
        out.append((n, sum(z - a + 1 for a, z in hits), len(set(hit)), sorted(set(hit)), [{"start": starts[a], "end": ends[z]} for a, z in hits]))
    return pa.RecordBatch.from_arrays([ids, *(pa.array([o[i] for o in out], t) for i, t in enumerate(_ARROW))], [id_col, *_NAMES])
