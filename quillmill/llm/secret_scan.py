"""Secret scans: a worklist of decoded layers, each rescanned, with spans mapped to the original text."""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html as entities
import itertools
import lzma
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
#: The first three alternatives take a sign that opens escapes and is itself encoded many times over (%2525.., \\u005cu005c..,
#: &amp;amp;..) in one step, so that long chains stay cheap. Of a per cent sign the last layer but one is still seen.
ESCAPE = re.compile(r"(?P<deep>%(?:25)+(?=25[0-9A-Fa-f]{2}))|(?P<slash>\\(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC])+(?=[uUx]))|(?P<and>&(?:amp;|#0{0,5}38;|#[xX]0{0,4}26;)+(?=#|amp;|quot;|lt;|gt;|apos;|equals;|colon;))|(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<utf16>(?:\\u[0-9A-Fa-f]{4})+)|\\U(?P<wide>[0-9A-Fa-f]{8})|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|(?P<bytes>(?:\\x[0-9A-Fa-f]{2})+)|(?P<entity>&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|amp|lt|gt|apos|equals|colon);)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_BLOB = re.compile(r"(?:[0-9a-fA-F]{2}){12,}")
#: Base64 or hex wrapped in lines (line ends as such or written as \\n); only the last line may be short.
LINE_END = r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*"
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}" + LINE_END + r")+[A-Za-z0-9+/_-]+={0,2}")
WRAP = re.compile(LINE_END)
#: A decompressed layer up to this size is one text; a larger one is read as a stream of overlapping pieces of PIECE.
MAX_LAYER, PIECE, PIECE_OVERLAP, MAX_CHAIN = 16 << 20, 4 << 20, 4096, 100
ASCII_TEXT = bytes([9, 10, 13, *range(32, 127)])
CONTROLS = [chr(i) for i in range(32) if chr(i) not in "\t\n\r"]
#: No secret and no further layer is shorter than this, so shorter readable stretches need no scan.
LEAST_STRETCH = 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the three kinds, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out)


def _unescaped(m: re.Match) -> str:
    kind, found = m.lastgroup, m[m.lastgroup]
    if kind in ("deep", "slash", "and"):
        return m[0][0]
    if kind == "url":
        return bytes.fromhex(found.replace("%", "")).decode("utf-8", "replace")
    if kind == "utf16":
        return bytes.fromhex(found.replace("\\u", "")).decode("utf-16-be", "replace")
    if kind in ("wide", "braced"):
        code = int(found, 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    if kind == "bytes":
        return bytes.fromhex(found.replace("\\x", "")).decode("utf-8", "replace")
    return entities.unescape(found)


def escaped_layer(text: str, at: list[tuple[int, int]] | tuple[int, int] | None) -> tuple[str, list[tuple[int, int]] | tuple[int, int]] | None:
    """text with its URL, Unicode and character escapes decoded once, and the original span of each character."""
    found = list(ESCAPE.finditer(text))
    if not found:
        return None
    if isinstance(at, tuple):  # every character stands for the same span
        return ESCAPE.sub(_unescaped, text), at
    where = at if at is not None else [(i, i + 1) for i in range(len(text))]
    out, spans, last = [], [], 0
    for m in found:
        out.append(text[last : m.start()])
        spans += where[last : m.start()]
        piece = _unescaped(m)
        out.append(piece)
        spans += [(where[m.start()][0], where[m.end() - 1][1])] * len(piece)
        last = m.end()
    out.append(text[last:])
    spans += where[last:]
    return "".join(out), spans


def _inflate(chunks, make):
    """Decompressed chunks of PIECE bytes at most, over all members of a stream."""
    d = make()
    for data in chunks:
        while True:
            out = d.decompress(data, PIECE)
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data, make()
                if not data:
                    break
            elif hasattr(d, "unconsumed_tail"):
                data = d.unconsumed_tail
                if not data and len(out) < PIECE:
                    break
            elif d.needs_input:
                break
            else:
                data = b""


class _Source:
    """Chunks as a file to read from."""

    def __init__(self, chunks):
        self.chunks, self.rest = chunks, b""

    def read(self, n: int = -1) -> bytes:
        if not self.rest:
            self.rest = next(self.chunks, b"")
        n = len(self.rest) if n < 0 else n
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _zstd(chunks):
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(_Source(chunks), read_across_frames=True)
    while out := reader.read(PIECE):
        yield out


def _until_damaged(chunks):
    try:
        yield from chunks
    except Exception as e:  # noqa: BLE001  damaged data of any codec ends its layer
        if not isinstance(e, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)) and type(e).__name__ != "ZstdError":
            raise


def unpacked(head: bytes, chunks):
    """The decompressed chunks of chunks (gzip, zlib, bzip2, xz, zstd), by their first bytes; None if they are none of them."""
    if head[:2] == b"\x1f\x8b":
        found = _inflate(chunks, lambda: zlib.decompressobj(31))
    elif head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        found = _inflate(chunks, zlib.decompressobj)
    elif head[:3] == b"BZh":
        found = _inflate(chunks, bz2.BZ2Decompressor)
    elif head[:6] == b"\xfd7zXZ\x00":
        found = _inflate(chunks, lzma.LZMADecompressor)
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        found = _zstd(chunks)
    else:
        return None
    return _until_damaged(found)


def wide(data: bytes) -> str | None:
    """The codec of data if it looks like UTF-16: by its mark, or as most places of one parity in its head are zero."""
    head = data[:256]
    if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return "utf-16"
    half = len(head) // 2
    if half < LEAST_STRETCH // 2 or 0 not in head:
        return None
    even, odd = head[: 2 * half : 2].count(0), head[1 : 2 * half : 2].count(0)
    return "utf-16-le" if odd * 2 > half and even * 8 < half else "utf-16-be" if even * 2 > half and odd * 8 < half else None


def readable(data: bytes) -> str | None:
    """data as text (UTF-8, a single-byte encoding or UTF-16) if hardly a character is a control or no character at all."""
    return readable_text(data.decode(wide(data) or "utf-8", "replace"))


def readable_text(text: str) -> str | None:
    """text unless over a twentieth of it are controls or over a fifth were not readable; bytes beyond ASCII of a
    single-byte encoding are among these, and no secret holds one."""
    odd = sum(map(text.count, CONTROLS))
    return text if text and odd * 20 <= len(text) and text.count("\ufffd") * 5 <= len(text) else None


def raw_deflate(data: bytes) -> bool:
    """Whether data is one whole deflate stream without a header, of readable text or of data compressed with one (judged by
    its first 64 KiB). Two such streams directly inside each other are not looked for."""
    if not data or data[0] & 6 == 6:
        return False
    stream, most = zlib.decompressobj(-15), 1 << 16
    try:
        out = stream.decompress(data, most)
    except zlib.error:
        return False
    whole = stream.eof and not stream.unused_data
    return len(out) >= LEAST_STRETCH and (whole or len(out) == most) and (readable(out) is not None or unpacked(out[:6], iter(())) is not None)


def text_pieces(chunks, cut: list[int]):
    """Texts of about PIECE characters that together cover a large layer. They overlap and part at blanks, so what lies
    at a border is whole in one of them; a longer run without blanks, or wrapped lines at a border, are counted in cut."""
    decoder, hold, fresh = None, "", 0
    for chunk in chunks:
        decoder = decoder or codecs.getincrementaldecoder(wide(chunk) or "utf-8")("replace")
        new = decoder.decode(chunk)
        hold, fresh = hold + new, fresh + len(new)
        if len(hold) < PIECE:
            continue
        at = hold.rfind(" ", len(hold) // 2)
        if at < 0:
            at = hold.rfind("\n", len(hold) // 2)
            cut[0] += at < 0 or re.search(r"[A-Za-z0-9+/_-]{16}\s*\Z", hold[max(0, at - 32) : at]) is not None
        at = len(hold) if at < 0 else at
        yield hold[:at]
        hold, fresh = hold[max(0, at - PIECE_OVERLAP) :], len(hold) - at
    if fresh:
        yield hold


def opened(data: bytes, cut: list[int]):
    """The texts that data holds, after every step of compression. Steps of up to MAX_LAYER bytes are taken whole, however
    many they are, until data repeats itself; a larger step goes on as a stream."""
    met = set()
    while True:
        digest = hashlib.sha1(data).digest()
        inner = unpacked(data[:6], iter([data])) if digest not in met else None
        if inner is None and digest not in met and raw_deflate(data):
            inner = _until_damaged(_inflate(iter([data]), lambda: zlib.decompressobj(-15)))
        met.add(digest)
        if inner is None:
            break
        parts, size = [], 0
        for chunk in inner:
            parts.append(chunk)
            size += len(chunk)
            if size > MAX_LAYER:
                break
        if not parts:
            break
        if size <= MAX_LAYER:
            data = b"".join(parts)
            continue
        stream = itertools.chain(parts, inner)
        for _ in range(MAX_CHAIN):
            head = b""
            while len(head) < 6 and (chunk := next(stream, b"")):
                head += chunk
            stream = itertools.chain([head], stream)
            deeper = unpacked(head[:6], stream)
            if deeper is None:
                yield from filter(None, map(readable_text, text_pieces(stream, cut)))
                return
            stream = deeper
        cut[0] += 1
        return
    body = readable(data)
    if body is not None:
        yield body


def stretches(data: bytes, starts: list[int]):
    """(first byte, end byte, bytes) of what may hold a layer: data from each of the sorted starts on, if compressed,
    and each longest readable stretch that begins at one of them (all that follows, if it is UTF-16 or, but for a tenth
    at most, ASCII). Deflate without a header shows no mark, so it is looked for at the first byte alone."""
    view, done = memoryview(data), 0
    for at in starts:
        if len(data) - at < LEAST_STRETCH:
            break
        if unpacked(data[at : at + 6], iter(())) is not None or (at == 0 and raw_deflate(data)):
            yield at, len(data), data[at:]
        if at < done:
            continue
        if wide(data[at : at + 256]):
            done = len(data)
            yield at, done, data[at:]
            continue
        try:
            codecs.utf_8_decode(view[at:], "strict", True)
            done = len(data)
        except UnicodeDecodeError as e:
            done = at + e.start
            if len(data[at:].translate(None, ASCII_TEXT)) * 10 <= len(data) - at:
                done = len(data)
        if done - at >= LEAST_STRETCH:
            yield at, done, data[at:done]


def _runs(text: str):
    """(text, original place of each character or None, base) of each base64 run: as it stands, and joined over line ends."""
    for m in BASE64.finditer(text):
        yield m[0], None, m.start()
    if "\n" in text or "\r" in text or "\\n" in text:
        for m in WRAPPED.finditer(text):
            places, last = [], m.start()
            for w in WRAP.finditer(text, m.start(), m.end()):
                places += range(last, w.start())
                last = w.end()
            places += range(last, m.end())
            yield "".join([text[i] for i in places]), places, 0


def blobs(text: str):
    """(start, end, bytes) of the base64 and hex runs of text that may hold text, compressed or not.

    A run may have words of a path or a name before it, so decoding begins at the run's start and after each of / _ -,
    and, as four alignments cover them all, costs at most four passes; a stretch ends where it stops being text.
    """
    for whole, places, base in _runs(text):
        run = whole.rstrip("=")
        if run.isdigit() or (run.isalpha() and (run.islower() or run[1:].islower())):
            continue
        begins = [0, *(m.end() for m in re.finditer("[/_-]", run))]
        plain = run.replace("-", "+").replace("_", "/")
        for shift in {b % 4 for b in begins}:
            part = plain[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            for a, z, found in stretches(data, [(b - shift) // 4 * 3 for b in begins if b % 4 == shift]):
                first = shift + a // 3 * 4
                end = len(whole) if z == len(data) else min(len(run), shift + -(-z * 4 // 3))
                yield (base + first, base + end, found) if places is None else (places[first], places[end - 1] + 1, found)
        if places is not None and (hexed := HEX_BLOB.fullmatch(run)):
            yield places[0], places[-1] + 1, bytes.fromhex(hexed[0])
    for m in HEX_BLOB.finditer(text):
        yield m.start(), m.end(), bytes.fromhex(m[0])


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, all spans, borders in large layers where a run was cut) of a text, as sorted (start, end, kind number) in code points.

    Worklist to fixpoint: each layer is scanned; its escapes decoded give one further layer (character spans kept),
    each base64 or hex run that decodes to text or to compressed text gives another (mapped to the whole run). A layer
    already seen at the same place is not opened again, so cycles end.
    """
    base = base_spans(text)
    found, cut = set(base), [0]
    seen = {(hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest(), None)}

    def place(where, a: int, b: int) -> tuple[int, int]:
        if where is None:
            return a, b
        return (where[a][0], where[b - 1][1]) if isinstance(where, list) else where

    def inside(layer, where):
        if "%" in layer or "\\" in layer or "&" in layer:
            more = escaped_layer(layer, where)
            if more:
                yield more
        for a, b, data in blobs(layer):
            span = place(where, a, b)
            for body in opened(data, cut):
                yield body, span

    # the layers still to come out of each open layer; one is read at a time, so a large layer is never held whole
    work = [inside(text, None)]
    while work:
        layer, where = next(work[-1], (None, None))
        if layer is None:
            work.pop()
            continue
        key = (hashlib.sha1(layer.encode("utf-8", "surrogatepass")).digest(), (where[0], where[-1]) if isinstance(where, list) and where else None if isinstance(where, list) else where)
        if key in seen:
            continue
        seen.add(key)
        found.update((*place(where, a, b), k) for a, b, k in base_spans(layer))
        work.append(inside(layer, where))
    return base, sorted(found), cut[0]


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id, base, spans, cut_layers) for each row, and with redact also `redacted`: the text with every span masked.

    base and spans are arrays of (kind, start, end) in code points, end exclusive; spans holds the base spans and those
    found in decoded layers (UTF-8, single-byte or UTF-16), mapped to the original text. A sign that opens escapes and is
    encoded many times over is decoded at once, so of the layers between only the last is scanned. A layer over MAX_LAYER
    bytes is read in overlapping pieces; cut_layers counts the runs that a border of these may have parted. Null text counts as empty and has no spans; repeated rows
    repeat their result; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def structs(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [scan(t or "") for t in texts]
            arrays = [b.column(0), pa.array([structs(g[0]) for g in got], span), pa.array([structs(g[1]) for g in got], span), pa.array([g[2] for g in got], pa.int32())]
            names = [id_col, "base", "spans", "cut_layers"]
            if redact:
                arrays.append(pa.array([t if t is None else mask(t, g[1]) for t, g in zip(texts, got, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names)

    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, base {spans}, spans {spans}, cut_layers int" + (", redacted string" if redact else ""))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each maximal run of spans replaced by [SECRET]."""
    out, last = [], 0
    for a, b, _ in sorted(spans):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], "[SECRET]"]
        last = b
    return "".join([*out, text[last:]])
