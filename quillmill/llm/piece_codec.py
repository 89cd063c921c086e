"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback, checked against the library."""

from __future__ import annotations

import os
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_CACHE, SHORT, BLOCK = 300_000, 40, 4096
_NONE, _PAD = np.int32(1 << 30), np.int32(-1)
_CODECS: dict[str, PieceCodec] = {}


class PairTable:
    """Merged symbol of a pair of symbols, by open addressing: one vector of lookups costs a few array reads."""

    def __init__(self, merges: dict[tuple[int, int], int]):
        self.bits = max(10, (8 * len(merges)).bit_length())
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 1
        for (left, right), merged in merges.items():
            key = left << 32 | right
            at, probes = int(self._slot(np.array([key], np.int64))[0]), 1
            while self.keys[at] >= 0:
                at, probes = (at + 1) & ((1 << self.bits) - 1), probes + 1
            self.keys[at], self.values[at], self.probes = key, merged, max(self.probes, probes)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, -1 for none; negative symbols are in no pair."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        found = np.where(self.keys[at] == key, self.values[at], -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            where = (at[open_] + step) & ((1 << self.bits) - 1)
            hit = self.keys[where] == key[open_]
            found[open_[hit]] = self.values[where[hit]]
            open_ = open_[~hit & (self.keys[where] >= 0)]
        return found


class PieceCodec:
    """Tables of one model file and the agenda over adjacent symbol pairs."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.plain = [p.replace(MARK, " ") if p in self.ids else "" for p in self.pieces]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) or any(sp.is_unused(i) for i in range(n)) or len(self.byte_ids) != 256 or not inner <= self.ids.keys():
            raise ValueError("needs a merge vocabulary with byte fallback, in which no piece spans words and every character of a piece is one")
        # punctuation that no piece has after anything but its like (or a word's mark) begins a part of its own
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False) if a != MARK}
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        while late := {b for a, b in pairs if b in marks and a not in marks}:
            marks -= late
        odd = "".join(sorted(marks))
        first, rest = f"[{re.escape(odd)}]", f"[^{MARK}\n{re.escape(odd)}]"
        if not odd:
            first, rest = "(?!)", f"[^{MARK}\n]"
        line = "\n" not in inner
        whole = f"{MARK}*(?:{rest}+|{first}+{rest}*)|{MARK}+"
        self.chunks = re.compile(f"\n|{whole}" if line else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.alone = re.compile(f"{MARK}[^{MARK}\n{re.escape(odd)}]+").fullmatch
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        # the agenda in blocks: symbols are ids, ordered by rank; a character that is no piece is minus its code point less 2
        order = np.full(n, _NONE, np.int32)
        order[sorted(normal, key=lambda i: self.rank[self.pieces[i]])] = np.arange(len(normal))
        self.order = np.append(order, _NONE)  # -1, no symbol, reads the last
        self.of_char = -np.arange(0x110000, dtype=np.int32) - 2
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.table = PairTable({(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids})
        printable = "".join(map(chr, range(32, 127)))
        probe = " ".join([printable, printable[::-1], *(f"a{x}{y} b{x}{x}1{y}{y}c" for x in "-.>,'\"(/é" for y in printable), "  two  \n\n lines\t"])
        got = np.frombuffer(self.encode_all([probe])[0][0], "<u4").tolist()
        if got != sp.encode(probe, add_bos=True, add_eos=True):
            raise ValueError("texts cannot be parted as this codec does")

    def agenda(self, chunk: str) -> list[int]:
        """Ids of a chunk: the best-scoring adjacent pair merges first, the leftmost among equals, until none is a piece."""
        out: list[int] = []
        for s in self._long(chunk):
            known = self.ids.get(s)
            out += [known] if known is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    def agendas(self, chunks: list[str]) -> list[bytes]:
        """agenda() of many short chunks as little-endian uint32 ids, a block at a time."""
        out: list[bytes] = [b""] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        for lo in range(0, len(order), BLOCK):
            some = order[lo : lo + BLOCK]
            rows, lengths, flat = self._block([chunks[i] for i in some])
            ends = np.cumsum(lengths)
            odd = np.minimum.reduceat(flat, ends - lengths) < 0
            data = flat.astype("<u4").tobytes()
            for r, a, z in zip(rows.tolist(), (4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True):
                out[some[r]] = data[a:z]
            for k in np.flatnonzero(odd).tolist():  # characters that are no piece are written by their bytes
                own = flat[ends[k] - lengths[k] : ends[k]].tolist()
                out[some[rows[k]]] = np.array([i for s in own for i in ([s] if s >= 0 else [self.byte_ids[b] for b in chr(-s - 2).encode()])], "<u4").tobytes()
        return out

    def _block(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk numbers, symbols of each, all symbols): in each round every chunk merges its best pair, until it has none."""
        sizes = np.array([len(c) for c in chunks])
        width = int(sizes.max())
        sym = np.full((len(chunks), width), _PAD, np.int32)
        sym[np.arange(width) < sizes[:, None]] = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(len(chunks))
        pair = self.table.get(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(chunks), -1)
        rank = self.order[pair]
        while len(rows):
            if pair.shape[1]:
                best = rank.argmin(1)
                live = rank[np.arange(len(rows)), best] != _NONE
            else:
                best, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            if not live.all():
                done.append((rows[~live], sym[~live]))
                rows, sym, pair, rank, best = rows[live], sym[live], pair[live], rank[live], best[live]
                if not len(rows):
                    break
            at, cols = np.arange(len(rows)), np.arange(sym.shape[1] - 1)
            sym[at, best] = pair[at, best]
            sym = np.take_along_axis(sym, cols + (cols > best[:, None]), 1)
            cols = cols[:-1]
            shifted = cols + (cols >= best[:, None])
            pair, rank = np.take_along_axis(pair, shifted, 1), np.take_along_axis(rank, shifted, 1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < pair.shape[1]))
                where = side[ok]
                pair[ok, where] = self.table.get(sym[ok, where], sym[ok, where + 1])
                rank[ok, where] = self.order[pair[ok, where]]
        held = [s != _PAD for _, s in done]
        return np.concatenate([r for r, _ in done]), np.concatenate([h.sum(1) for h in held]), np.concatenate([s[h] for (_, s), h in zip(done, held, strict=True)])

    def _long(self, chunk: str) -> list[str]:
        """The agenda as a heap; entries whose pair has merged meanwhile are passed over."""
        rank, n = self.rank, len(chunk)
        sym, nxt, prv = list(chunk), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := chunk[i : i + 2]) in rank]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            j = nxt[i]
            if j < 0 or not sym[i] or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, ""
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                if (q := p + sym[k]) in rank:
                    heappush(heap, (rank[q], i, q))
            h = prv[i]
            if h >= 0 and (q := sym[h] + p) in rank:
                heappush(heap, (rank[q], h, q))
        return [s for s in sym if s]

    def text_of(self, ids: list[int]) -> str:
        """Text of ids, marks turned to spaces; byte pieces are read as UTF-8 and control ids have no text."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i >= 0 and self.pieces[i] in self.ids:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def learn(self, chunks: set[str]) -> None:
        """Add chunks to the cache, each checked against the library: a difference ends the job."""
        if len(self.cache) + len(chunks) > MAX_CACHE:
            self.cache, self.old = {}, self.cache  # what is met again comes back from the old one
        new = []
        for c in chunks:
            known = self.old.get(c)
            if known is None:
                new.append(c)
            else:
                self.cache[c] = known
        short = [c for c in new if len(c) <= SHORT]
        found = dict(zip(short, self.agendas(short), strict=True))
        found |= {c: np.array(self.agenda(c), "<u4").tobytes() for c in new if len(c) > SHORT}
        self._check(new, found)
        for c, ids in found.items():
            self.cache[c] = (ids, self.text_of(np.frombuffer(ids, "<u4").tolist()))

    def _check(self, chunks: list[str], found: dict[str, bytes]) -> None:
        """Words with one mark before them are compared in common texts, whose parts no piece spans; the others one by one
        (after a line end a chunk stands without the mark that begins a text; a mark alone cannot be told from that one)."""
        plain = [c for c in chunks if self.alone(c)]
        groups = [plain[lo : lo + 200] for lo in range(0, len(plain), 200)]
        others = [c for c in chunks if not self.alone(c) and c != MARK]
        texts = ["".join(g)[1:].replace(MARK, " ") for g in groups] + [c[1:] if c[0] == MARK else "\n" + c for c in others]
        got = self.library.encode(texts, num_threads=1) if texts else []
        for g, ids in zip(groups, got, strict=False):
            if b"".join([found[c] for c in g]) != np.array(ids, "<u4").tobytes():
                raise ValueError(f"differs from the library on one of {g!r}")
        for c, ids in zip(others, got[len(groups) :], strict=True):
            if found[c] != np.array(ids if c[0] == MARK else ids[2:], "<u4").tobytes():
                raise ValueError(f"differs from the library on {c!r}")

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(little-endian uint32 ids with begin and end, decoded text) for each text."""
        bos, eos = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        parts = [self.chunks(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        met = set().union(*parts)
        missing = met.difference(self.cache)
        if len(missing) + len(self.cache) > MAX_CACHE:
            missing = met  # the cache is about to be put aside
        self.learn(missing)
        out, known = [], self.cache.__getitem__
        for own in parts:
            got = list(map(known, own))
            decoded = "".join([g[1] for g in got])
            out.append((b"".join([bos, *[g[0] for g in got], eos]), decoded[1:] if decoded[:1] == " " else decoded))
        return out


def codec(path: str) -> PieceCodec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for each row: ids as little-endian unsigned 32-bit integers with begin and end, and the text
    that they decode to.

    Texts are parted where no piece of the vocabulary can span (before a word mark, around line ends), each distinct
    part is merged once per worker and checked against the library, and its ids are reused. Null text counts as empty
    (begin and end alone, decoded to the empty string); rows are independent, so repeated rows repeat their result and
    an empty table gives none. model_path: the file on every executor; by default that of the public_tokenizers package.
    """

    def run(batches):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        worker = codec(model_path or default_model())
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = worker.encode_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], [id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")
