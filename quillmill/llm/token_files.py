"""Token-ID output: flat unsigned integer files with 64-bit document offsets, written in id order and read by memory map."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

END_ID, MAX_CACHE, NULL_ID = 2, 500_000, -(1 << 63)
#: Bytes of text to a file where the caller names no number of files: about half of it in ids.
FILE_BYTES = 256 << 20
#: Texts on which a tokenizer must agree with the word-wise encoding before any is encoded.
PROBES = ["The cat, THE dog.\tIt's  3.5% of\nÉtés, naïve x1. end", "a,b c., (d) \"e.\" ... f,. Straße ΣΑΣ", " lead and trail \r\n", "<|endoftext|> <b> don't 12,345.67 co-op"]
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """tokenizers' encoding of whole texts, by words: neither its normaliser nor its pre-tokeniser joins text across blanks."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        with open(path) as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix") or None
        self.closes = np.zeros(size, bool)  # ids that end a word
        if suffix:
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        want = [self._whole(t) for t in PROBES]
        if [x[: -len(self.end)] for x in self.encode_all(PROBES)] != want:
            raise ValueError("needs a tokenizer that parts words at blanks, and full stops and commas from letters, and lower-cases ASCII")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Encode parts into the cache. Those of ASCII letters are one pre-token each and go together in one text, told
        apart by the ids that end a word; others are encoded one by one."""
        plain = [p for p in parts if p.isascii() and p.isalpha()] if self.closes.any() else []
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                raise ValueError("a word of ASCII letters is not one pre-token")
            data, cuts = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
            for p, x, y in zip(some, [0, *cuts], cuts, strict=False):
                self.cache[p] = data[x:y]
        others = list(parts.difference(plain))
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.cache[p] = np.array(e.ids, self.dtype).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, in the file's integers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        met = set().union(*split)
        missing = met.difference(self.cache)
        if len(self.cache) + len(missing) > MAX_CACHE:
            self.cache, self.old = {"": b""}, self.cache  # what is met again comes back from the old one
            missing = met
        back = [w for w in missing if w in self.old]
        self.cache.update((w, self.old[w]) for w in back)
        # full stops and commas after a letter are a pre-token of their own, and ASCII letters only lose their case
        parts = {}
        for w in missing.difference(self.cache):
            bare = w.rstrip(".,")
            core = bare if bare[-1:].isalpha() else w
            parts[w] = (core.lower() if core.isascii() and "<" not in core else core, w[len(core) :])
        self._learn({p for pair in parts.values() for p in pair if p not in self.cache})
        cache = self.cache
        for w, (core, tail) in parts.items():
            cache[w] = cache[core] + cache[tail]
        known = cache.__getitem__
        return [b"".join([*map(known, words), self.end]) for words in split]


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _store(uri: str):
    """The file system of a folder and the folder's path in it (file, hdfs, s3, gs ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def _mapped(uri: str, name: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the store is local, else read whole (files are of bounded size)."""
    from pyarrow import fs

    store, folder = _store(uri)
    path = f"{folder}/{name}"
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> DataFrame:
    """Encode every text, write `part-NNNNN.bin/.idx/.doc` in ascending id order, and return the manifest.

    .bin: all ids, each document's followed by end_id (16 bits where the vocabulary allows, else 32). .idx: 64-bit start
    of each document in its file, and the file's length last. .doc: 64-bit document ids (NULL_ID stands for null).
    Manifest (part, n_docs, n_tokens, base, base_docs), one row for each file: base is the prefix sum of the files before.
    Null ids come first, ties are ordered by text; null text is the end id alone; very long texts are written whole; an
    empty table writes nothing. n_files: by default one for each FILE_BYTES of text, so that files stay of bounded size.
    Each file is written under a temporary name and renamed, so a task that runs again or twice leaves one whole file.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    if n_files is None:
        total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t")).repartitionByRange(n_files, "id", "tie").sortWithinPartitions("id", "tie", "t")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        worker, (store, top) = encoder(path, end_id), _store(folder)
        store.create_dir(top, recursive=True)
        name, own = f"{top}/part-{part:05d}", f"{top}/_{part:05d}-{TaskContext.get().taskAttemptId()}"
        starts, total = [0], 0
        with store.open_output_stream(f"{own}.bin") as ids, store.open_output_stream(f"{own}.doc") as keys:
            for b in batches:
                keys.write(np.array([NULL_ID if x is None else x for x in b.column(0).to_pylist()], "<i8").tobytes())
                for lo in range(0, b.num_rows, 500):
                    for data in worker.encode_all(b.column(1).slice(lo, 500).to_pylist()):
                        ids.write(data)
                        total += len(data) // worker.dtype.itemsize
                        starts.append(total)
        with store.open_output_stream(f"{own}.idx") as offsets:
            offsets.write(np.array(starts, "<i8").tobytes())
        for kind in ("bin", "doc", "idx"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(starts) - 1], "n_tokens": [total], "width": [worker.dtype.itemsize]}, schema=pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int64())]))

    # one row for each file comes back, however large the files are
    files = sorted(tuple(r) for r in rows.select("id", "t").mapInArrow(write, "part long, n_docs long, n_tokens long, width long").collect())
    manifest, base, base_docs = [], 0, 0
    for part, n_docs, n_tokens, width in files:
        if n_docs:
            manifest.append((part, n_docs, n_tokens, width, base, base_docs))
        base, base_docs = base + n_tokens, base_docs + n_docs
    return spark.createDataFrame(manifest, "part long, n_docs long, n_tokens long, width long, base long, base_docs long")


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) for each document in the files: start counts the ids of all documents before it, ids
    are little-endian unsigned 32-bit integers."""
    n = max(1, manifest.count())

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                name = f"part-{r['part']:05d}"
                ids, at, keys = _mapped(folder, f"{name}.bin", f"<u{r['width']}"), _mapped(folder, f"{name}.idx", "<i8"), _mapped(folder, f"{name}.doc", "<i8")
                for lo in range(0, r["n_docs"], 500):
                    hi = min(lo + 500, r["n_docs"])
                    own = keys[lo:hi]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(at[lo:hi] + r["base"], pa.int64()), pa.array(np.diff(at[lo : hi + 1]), pa.int64()),
                        pa.array([ids[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(lo, hi)], pa.binary()),
                    ], [id_col, "start", "n_tokens", "ids"])

    return manifest.repartition(n, "part").mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids binary")


def encode_to_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write docs as token files (in the shared folder unless one is given) and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **options), folder, options.get("id_col", "doc_id"))
