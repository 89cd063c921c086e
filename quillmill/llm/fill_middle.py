"""Fill-in-middle rows by block rotation in place, and the exact way back."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED, RATE, SPM_RATE = 7, 100, 50


def _rotate(buf: bytearray, start: int, mid: int, end: int) -> None:
    """Exchange buf[start:mid] and buf[mid:end]: reverse both together, then each."""
    for a, b in ((start, end), (start, start + end - mid), (start + end - mid, end)):
        buf[a:b] = buf[a:b][::-1]


def _line_ends(buf: bytes) -> list[int]:
    """Where the units [^\\n]*\\n|[^\\n]+ end; in UTF-8 a line feed is never part of another character."""
    ends, at = [], buf.find(b"\n")
    while at >= 0:
        ends.append(at + 1)
        at = buf.find(b"\n", at + 1)
    if buf and (not ends or ends[-1] < len(buf)):
        ends.append(len(buf))
    return ends


def transform(text: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units, bytes of the prefix, bytes of the middle); the last two are None for the plain form."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = [0, *_line_ends(text)]
    n = len(ends) - 1
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return text, "plain", n, None, None
    low, high = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    buf = bytearray(text)
    for at, sentinel in ((high, SUFFIX), (low, MIDDLE), (0, PREFIX)):  # from the end, so that the cuts stay where they are
        buf[at:at] = sentinel
    middle, suffix = low + len(PREFIX), high + len(PREFIX) + len(MIDDLE)
    _rotate(buf, middle, suffix, len(buf))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    if form == "spm":
        _rotate(buf, 0, middle, middle + len(buf) - suffix)
    return bytes(buf), form, n, low, high - low


def restore(output: bytes, form: str) -> bytes:
    """The text that transform() turned into output: the rotations inverted, last first, and the sentinels taken out."""
    if form == "plain":
        return output
    buf = bytearray(output)
    middle = buf.index(MIDDLE)
    if form == "spm":
        _rotate(buf, 0, buf.index(PREFIX), middle)  # the prefix first again
    suffix = buf.index(SUFFIX)
    _rotate(buf, suffix, middle, len(buf))  # and the middle before the suffix
    middle, suffix = suffix, suffix + len(buf) - middle
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buf[at : at + len(sentinel)]
    return bytes(buf)


def _characters(data: bytes) -> int:
    return len(data.decode())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row: the text cut at two of its line ends and put in the
    order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each part after its sentinel.

    The cuts and the form depend on the seed and the id alone (a null id counts as an empty one), so repeated ids are cut
    alike and repeated rows come out alike. A null text counts as empty. Empty texts, texts that hold a sentinel and
    those above the rate stay as they are (plain, with null counts). Other columns are not returned.
    """

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or b""
                out, form, n, prefix, middle = transform(text, doc, seed, rate, spm_rate)
                counts = (None, None) if prefix is None else (_characters(text[:prefix]), _characters(text[prefix : prefix + middle]))
                rows.append((n, form, *counts, out))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    done = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restore_texts(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """rows with `restored`, the text that fill_in_middle() was given (empty for null), from output and form alone."""

    @F.arrow_udf("string")
    def back(output: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([restore(o.encode(), f).decode() for o, f in zip(output.to_pylist(), form.to_pylist(), strict=True)], pa.string())

    return rows.withColumn("restored", back(F.col(output_col), F.col(form_col)))
