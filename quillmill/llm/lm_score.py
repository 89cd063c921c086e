"""Language-model scoring: an add-one unigram base over all training tokens, and a causal self-attention model in numpy.

The model (lm_model) reads subword ids (byte-level BPE, by word) in overlapping windows; it is fitted on every window of
every training document. Beside it stands a memory of the corpus: texts are cut into chunks by their content, and a chunk
that followed the same ids in other training documents shares the probability with the model's own. A training document
never remembers itself, so training and held-out documents are scored alike.
"""

from __future__ import annotations

import base64
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .lm_model import RATE, TOP, Attention, Counts, chunks_over, count_tables, rows_of, token_logs, windows_over

ROUNDS, PIECE, TEXT_BYTES = 4, 300_000, 6 << 20
_BLANKS = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: So many of the most frequent words are sent to the workers; the others are joined.
FREQUENT, MAX_CACHE, HELD_OUT = 150_000, 300_000, (7, 2)
_ENCODERS: dict[str, Subwords] = {}


class Subwords:
    """Subword ids of lower-cased words, each word encoded once per worker while the cache holds it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1  # also stands before a text
        self.size = self.end + 1
        if self.size > 1 << 16:
            raise ValueError("needs ids of 16 bits")
        self.leads = np.zeros(self.size, bool)  # ids that begin with a blank
        self.leads[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.edge = np.uint16(self.end).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Put words into the cache. They are encoded together: in their text each begins with the only blank of it, and so
        does its first id. Those with a blank of Unicode inside, which the pattern may join to their neighbours, go one by one."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if words[i].isascii() or t.split() == [t]]
        alone = set(range(len(words))).difference(plain)
        for lo in range(0, len(plain), 5000):
            some = plain[lo : lo + 5000]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join([texts[i] for i in some])), np.uint16)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(some):
                alone.update(plain[lo:])  # a vocabulary that joins or parts words at blanks
                break
            data, cuts = ids.tobytes(), [*(2 * starts).tolist(), 2 * len(ids)]
            for i, x, y in zip(some, cuts, cuts[1:], strict=False):
                self.cache[words[i]] = data[x:y]
        for i in alone:
            self.cache[words[i]] = np.array(self.encoding.encode_ordinary(" " + texts[i]), np.uint16).tobytes()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of different words end to end, how many each has). The cache has two halves of MAX_CACHE / 2 words: when one is
        full it becomes the older one, from which words that are met again move on."""
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > MAX_CACHE // 2:
            self.cache, self.older, missing = {}, self.cache, words
        if self.older:
            held = {w: x for w, x in zip(missing, map(self.older.get, missing), strict=True) if x is not None}
            self.cache.update(held)
            missing = [w for w in missing if w not in held]
        self.learn(missing)
        found = [self.cache[w] for w in words]
        return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int32, len(found)) // 2


def subwords(path: str, pattern: str) -> Subwords:
    if path not in _ENCODERS:
        _ENCODERS[path] = Subwords(path, pattern)
    return _ENCODERS[path]


def default_subwords() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Words(NamedTuple):
    """Words of many texts: the different ones, and which of them stands at each place of each text."""

    known: pa.Array  # different words
    codes: np.ndarray  # their numbers, place by place
    text: np.ndarray  # the text of each place


def words_of(texts: list[bytes | None]) -> Words:
    """Words of UTF-8 texts with A-Z lower-cased, parted at ASCII blanks."""
    parts = pc.split_pattern(pa.array([(t or b"").lower().translate(_BLANKS) for t in texts], pa.large_binary()), pattern=" ")
    coded = parts.flatten().dictionary_encode()
    codes, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts), dtype=np.int32), parts.value_lengths().to_numpy())
    empty = pc.index(coded.dictionary, pa.scalar(b"", pa.large_binary())).as_py()
    if empty >= 0:
        some = codes != empty
        codes, text = codes[some], text[some]
    return Words(coded.dictionary, codes, text)


def slices(texts: list[bytes | None]):
    """(first, end) of runs of texts of about TEXT_BYTES."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= TEXT_BYTES or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def sequences_of(words: Words, n: int, worker: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """(ids of n texts end to end, each with the end id before and after it, and their lengths)."""
    pool, sizes = worker.of(words.known.to_pylist())
    # a slice has far fewer than 2^31 ids, so 32 bits do for places
    per = sizes[words.codes]
    first = np.cumsum(per, dtype=np.int32) - per
    place = np.arange(per.sum(), dtype=np.int32)
    place += np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[words.codes] - first, per)
    lengths = np.bincount(words.text, per, n).astype(np.int64) + 2
    out = np.full(lengths.sum(), worker.end, np.uint16)
    inner = np.ones(len(out), bool)
    ends = np.cumsum(lengths)
    inner[ends - 1] = inner[ends - lengths] = False
    out[inner] = pool[place]
    return out, lengths


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % HELD_OUT[0] == HELD_OUT[1]


def _batches(ids: list[bytes], piece: int = PIECE):
    """(first row, ids end to end, lengths) of runs of rows with about `piece` ids: memory is bounded but for one long text."""
    lo, size = 0, 0
    for i, x in enumerate(ids):
        if size and size + len(x) // 2 > piece:
            yield lo, np.frombuffer(b"".join(ids[lo:i]), np.uint16).astype(np.int32), np.array([len(x) // 2 for x in ids[lo:i]])
            lo, size = i, 0
        size += len(x) // 2
    if lo < len(ids):
        yield lo, np.frombuffer(b"".join(ids[lo:]), np.uint16).astype(np.int32), np.array([len(x) // 2 for x in ids[lo:]])


_GATHERED = ["id", "k1", "k2", "rid", "held_out", "ids", "word", "sub", "n"]


def gather(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of three kinds: (id, k1, k2, rid, held_out, ids) of every document, and word counts (word, n) and subword
    counts (sub, n) of the training documents."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        worker = subwords(path, pattern)
        for b in batches:
            types = [*(b.column(i).type for i in range(4)), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

            def emitted(size, types=types, **given):
                return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, t)) for c, t in zip(_GATHERED, types, strict=True)], _GATHERED)

            texts = b.column(4).to_pylist()
            held = np.array([is_held_out(x) for x in b.column(0).to_pylist()], bool)
            counts = np.zeros(worker.size, np.int64)
            for lo, hi in slices(texts):
                words = words_of(texts[lo:hi])
                flat, lengths = sequences_of(words, hi - lo, worker)
                taught = ~held[lo:hi]
                ends = np.cumsum(lengths)
                lesson = np.repeat(taught, lengths)
                lesson[ends - lengths] = False  # the first id of a text is not predicted
                counts += np.bincount(flat[lesson], minlength=worker.size)
                seqs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield emitted(hi - lo, **{c: b.column(i).slice(lo, hi - lo) for i, c in enumerate(_GATHERED[:4])}, held_out=pa.array(held[lo:hi]), ids=seqs)
                n = np.bincount(words.codes[taught[words.text]], minlength=len(words.known))
                some = np.flatnonzero(n)
                yield emitted(len(some) + 1, word=pa.concat_arrays([words.known.take(pa.array(some)).cast(pa.binary()), pa.array([b""], pa.binary())]), n=pa.array(np.append(n[some], taught.sum())))
            some = np.flatnonzero(counts)
            yield emitted(len(some), sub=pa.array(some, pa.int32()), n=pa.array(counts[some]))

    numbered = rows.select("id", "k1", "k2", F.monotonically_increasing_id().alias("rid"), "t")
    return numbered.mapInArrow(run, f"id {kind}, k1 long, k2 long, rid long, held_out boolean, ids binary, word binary, sub int, n long")


def pair_counts(training: DataFrame, row_of: np.ndarray) -> np.ndarray:
    """How often each row of the tables is followed by each other (TOP x TOP) in the training sequences."""
    spark = training.sparkSession
    sent = spark.sparkContext.broadcast(row_of)

    def count(batches):
        total = np.zeros(TOP * TOP, np.int64)
        for b in batches:
            for _, flat, lengths in _batches(b.column(0).to_pylist(), 4 * PIECE):  # each run costs a pass over the whole table
                rows = sent.value[flat]
                inner = np.ones(len(rows), bool)
                inner[np.cumsum(lengths) - lengths] = False
                total += np.bincount((rows[:-1] * np.int32(TOP) + rows[1:])[inner[1:]], minlength=TOP * TOP)
        total = total.reshape(TOP, TOP)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[i].tobytes() for i in some], pa.binary())], ["row", "pairs"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}  # TOP rows at most
        for b in batches:
            for row, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(pairs, np.int64)
                sums[row] = sums[row] + own if row in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "pairs"])

    counted = training.select("ids").mapInArrow(count, "row long, pairs binary").repartition("row").mapInArrow(add, "row long, pairs binary")
    out = np.zeros((TOP, TOP), np.int64)
    for r in counted.toLocalIterator():  # TOP rows at most
        out[r.row] = np.frombuffer(r.pairs, np.int64)
    return out


def train(training: DataFrame, tables: Counts, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Attention, int]:
    """The model fitted on every window of the training sequences, and how many windows it saw.

    Documents are dealt to the rounds by their key, so each window is fitted once; in a round every task runs Adam from
    the shared weights over its part (tasks grow with the table), and the weights are averaged by the windows seen.
    Averages of averages are made in tasks, so the driver gets few rows. Without windows the start weights stay.
    """
    spark = training.sparkSession
    model, seen = Attention(), 0
    names = sorted(model.w)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((model.w, tables, rate / (1 + k)))

        def fit(batches, sent=sent, k=k):
            weights, own_tables, own_rate = sent.value
            own, n, state = Attention(dict(weights)), 0, {}
            for b in batches:
                for _, flat, lengths in _batches(b.column(0).to_pylist()):
                    windows = windows_over(lengths, 0)
                    own.fit(own_tables.row_of[flat], windows, own_tables, state, own_rate, seed=k)
                    n += len(windows.at)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "w": pa.array([np.concatenate([own.w[x].ravel() for x in names]).astype("<f8").tobytes()], pa.binary())})

        def mean(batches):
            n, total = 0, 0.0
            for b in batches:
                for m, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n, total = n + m, total + m * np.frombuffer(w, "<f8")
            if n:
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "w": pa.array([(total / n).tobytes()], pa.binary())})

        part = training.where(F.pmod("k1", F.lit(rounds)) == k).select("ids")
        fitted = part.mapInArrow(fit, "n long, w binary").repartition(8).mapInArrow(mean, "n long, w binary")
        got = [(r.n, np.frombuffer(r.w, "<f8")) for r in fitted.collect()]  # one row for each of 8 tasks
        if not got:
            continue
        seen += sum(n for n, _ in got)
        flat, at, weights = sum(n * w for n, w in got) / sum(n for n, _ in got), 0, {}
        for x in names:
            size = model.w[x].size
            weights[x] = flat[at : at + size].reshape(model.w[x].shape).astype(np.float32)
            at += size
        model = Attention(weights)
    return model, seen


def model_scores(sequences: DataFrame, model: Attention, tables: Counts) -> DataFrame:
    """(id, k1, k2, score): the model's log10 probability of each sequence, every id but the first scored once."""
    kind = sequences.schema["id"].dataType.simpleString()
    sent = sequences.sparkSession.sparkContext.broadcast((model.w, tables))

    def run(batches):
        weights, own_tables = sent.value
        own_model = Attention(weights)
        heads = own_model.heads(own_tables)
        for b in batches:
            for lo, flat, lengths in _batches(b.column(3).to_pylist()):
                summed = np.concatenate([[0.0], np.cumsum(token_logs(own_model, own_tables, heads, flat, lengths), dtype=np.float64)])
                ends = np.cumsum(np.maximum(lengths - 1, 0))
                part = b.slice(lo, len(lengths))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(summed[ends] - summed[ends - np.maximum(lengths - 1, 0)])], ["id", "k1", "k2", "score"])

    return sequences.select("id", "k1", "k2", "ids").mapInArrow(run, f"id {kind}, k1 long, k2 long, score double")


def chunk_scores(sequences: DataFrame, model: Attention, tables: Counts) -> DataFrame:
    """(rid, key, pair, own, p) for each chunk of each sequence: p is the model's log10 probability of the chunk. own is how
    many different chunks stand under its key in its document if that is a training document, negative for all but the
    first of equal chunks, and 0 if nothing is to be learned. A chunk without a whole key before it gets one of its own."""
    sent = sequences.sparkSession.sparkContext.broadcast((model.w, tables))

    def run(batches):
        weights, own_tables = sent.value
        own_model = Attention(weights)
        heads = own_model.heads(own_tables)
        for b in batches:
            for lo, flat, lengths in _batches(b.column(2).to_pylist()):
                logs = token_logs(own_model, own_tables, heads, flat, lengths)
                c = chunks_over(flat, lengths)
                rid, held = b.column(0).slice(lo, len(lengths)).to_numpy()[c.own], np.array(b.column(1).slice(lo, len(lengths)).to_pylist(), bool)[c.own]
                with np.errstate(over="ignore"):
                    alone = rid * np.int64(0x9E3779B97F4A7C1) + c.start
                key, pair = np.where(c.keyed, c.key, alone), np.where(c.keyed, c.pair, alone)
                order = np.lexsort((pair, key, c.own))
                new_key = np.ones(len(order), bool)
                new_key[1:] = (key[order][1:] != key[order][:-1]) | (c.own[order][1:] != c.own[order][:-1])
                first = new_key.copy()
                first[1:] |= pair[order][1:] != pair[order][:-1]
                run_of = np.cumsum(new_key) - 1
                own = np.zeros(len(order), np.int32)
                own[order] = np.bincount(run_of, first)[run_of] * np.where(first, 1, -1)
                own[held | ~c.keyed] = 0
                sums = np.add.reduceat(logs.astype(np.float64), c.start)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid, key, pair, own, sums.astype(np.float32))], ["rid", "key", "pair", "own", "p"])

    return sequences.select("rid", "held_out", "ids").mapInArrow(run, "rid long, key long, pair long, own int, p float")


def remembered(chunks: DataFrame) -> DataFrame:
    """(rid, score): a chunk's probability is (c + P) / (C + 1), where P is the model's, C counts the (document, chunk)
    pairs under its key in other training documents, and c those with this chunk; the sum of their logarithms."""
    taught = chunks.where("own > 0")
    pairs = taught.groupBy("pair").agg(F.count("*").cast("int").alias("c"))
    keys = taught.groupBy("key").agg(F.count("*").cast("int").alias("all"))
    met = chunks.join(pairs, "pair", "left").select("rid", "key", "own", "p", (F.coalesce("c", F.lit(0)) - F.when(F.col("own") != 0, 1).otherwise(0)).alias("c")).join(keys, "key", "left")
    others = F.greatest(F.coalesce("all", F.lit(0)) - F.abs("own"), F.lit(0))
    log = F.when(F.col("c") > 0, F.log10(F.col("c") + F.pow(F.lit(10.0), F.col("p")))).otherwise(F.col("p")) - F.log10(others + 1)
    return met.groupBy("rid").agg(F.sum(log).alias("score"))


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """Counts of the most frequent words, FREQUENT at most: a histogram of the counts' logarithms gives the least count."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"))
    least, have = None, 0
    for r in sorted(steps.collect(), reverse=True):  # at most 8 rows for each bit of a count
        have += r.n
        if have > FREQUENT:
            break
        least = r.step
    if least is None:
        return {}
    return {bytes(r.word): r.c for r in counts.where(F.floor(F.log2("c") * 8) >= least).collect()}


_BASE = ["id", "k1", "k2", "held_out", "word", "n", "copies", "tokens", "sums"]


def base_rows(rows: DataFrame, common: dict[bytes, int]) -> DataFrame:
    """What the base needs of each document: one row with the sums over its frequent words, and a row for each other
    word, which meets its count in a join."""
    kind = rows.schema["id"].dataType.simpleString()
    words_sent = rows.sparkSession.sparkContext.broadcast(common)

    def measure(batches):
        end_known, end = bool(words_sent.value[b""]), math.log10(words_sent.value[b""] + 1)
        known = pa.array(words_sent.value.keys(), pa.large_binary())
        all_logs = np.log10(np.fromiter(words_sent.value.values(), np.float64, len(known)) + 1)
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in slices(texts):
                n = hi - lo
                words = words_of(texts[lo:hi])
                at = pc.fill_null(pc.index_in(words.known, value_set=known), -1).to_numpy()
                logs = np.where(at < 0, -1.0, all_logs[at])
                per = logs[words.codes] if len(logs) else np.zeros(0)
                common = per >= 0
                own, tokens = np.bincount(words.text[common], minlength=n) + end_known, np.bincount(words.text, minlength=n) + 1
                sums = np.bincount(words.text[common], per[common], n) + end
                # each other word of a text once, with how often it stands there
                rare, times = np.unique(words.text[~common].astype(np.int64) * max(1, len(logs)) + words.codes[~common], return_counts=True)
                text, code = rare // max(1, len(logs)), rare % max(1, len(logs))
                held = np.array([is_held_out(x) for x in b.column(0).slice(lo, n).to_pylist()], bool)
                # no word has a blank: the row of a document meets none
                alone = pa.array([b" " + key.to_bytes(8, "little", signed=True) for key in b.column(1).slice(lo, n).to_pylist()], pa.binary())
                part = b.select([0, 1, 2]).slice(lo, n)
                one = pa.array(np.ones(n, np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held), alone, pa.array(own), one, pa.array(tokens), pa.array(sums)], _BASE)
                nothing = [pa.nulls(len(rare), t) for t in (pa.int64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(text)).columns, pa.array(held[text]), words.known.take(pa.array(code)).cast(pa.binary()), pa.array(times), *nothing], _BASE)

    return rows.mapInArrow(measure, f"id {kind}, k1 long, k2 long, held_out boolean, word binary, n long, copies long, tokens long, sums double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", subword_path: str | None = None, pattern: str | None = None, memory: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, and with memory memory_score.

    Documents whose crc32(id as text) mod 7 is 2 are held out; all others give the counts and the training windows. score is
    the log10 probability of the text by the attention model alone. memory_score lets a memory of the chunks of the
    other training documents correct it (remembered()): it tells what occurs elsewhere, which a model this small cannot.
    Null text counts as empty (its end token alone is scored); a null id is the empty text for the crc; repeated rows
    repeat their result and count each time in training, so they remember each other; very long texts are scored whole,
    window by window; without training documents the base is uniform over nothing (log10 of 1) and the model keeps its
    start weights; an empty table gives no rows.
    """
    path, pattern = (subword_path, pattern) if subword_path else default_subwords()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(11), "t").alias("k2"), "t")
    gathered = settle(gather(rows, path, pattern), "gathered")
    counts = settle(gathered.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, floor = total or 0, math.log10((total or 0) + distinct + 1)
    common = frequent_words(counts)
    end_count = counts.where(F.col("word") == F.lit(b"")).select("c").first()
    common[b""] = end_count[0] if end_count else 0
    sizes = np.zeros(subwords(path, pattern).size, np.int64)
    for r in gathered.where("sub IS NOT NULL").groupBy("sub").agg(F.sum("n").alias("n")).collect():  # at most a row for each id of the vocabulary
        sizes[r["sub"]] = r.n
    sequences = gathered.where("ids IS NOT NULL").select("id", "k1", "k2", "rid", "held_out", "ids")
    training = sequences.where("NOT held_out").select("k1", "ids")
    tables = count_tables(sizes, pair_counts(training, rows_of(sizes)))
    model, _ = train(training, tables)
    scores = model_scores(sequences, model, tables).withColumn("memory_score", F.lit(None).cast("double"))
    if memory:
        met_again = remembered(settle(chunk_scores(sequences, model, tables), "chunks")).withColumnRenamed("score", "memory_score")
        scores = scores.union(sequences.select("id", "k1", "k2", "rid").join(met_again, "rid").select("id", "k1", "k2", F.lit(None).cast("double"), "memory_score"))

    met = base_rows(rows, common).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = F.col("copies").isNotNull()
    based = met.select("id", "k1", "k2", "held_out", "copies", "tokens", F.when(whole | (F.col("c") > 0), F.col("n")).otherwise(0).alias("known"), F.when(whole, F.col("sums")).otherwise(F.col("n") * F.log10(F.col("c") + 1)).alias("sums"))
    none = lambda kind: F.lit(None).cast(kind)
    scored = scores.select("id", "k1", "k2", none("boolean").alias("held_out"), none("long").alias("copies"), none("long").alias("tokens"), none("long").alias("known"), none("double").alias("sums"), "score", "memory_score")
    # equal rows share a key: they add up to `copies` times the same figures, and come out as often as they went in
    per_row = based.withColumns({"score": none("double"), "memory_score": none("double")}).unionByName(scored).groupBy("id", "k1", "k2").agg(
        F.max("held_out").alias("held_out"), F.sum("copies").alias("copies"), F.max("tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("sums").alias("sums"), F.sum("score").alias("score"), F.sum("memory_score").alias("memory_score"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per_row.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") / F.col("copies") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
        *([(F.col("memory_score") / F.col("copies")).alias("memory_score")] if memory else []),
    )
