"""Fill-in-middle transformation over a distinct-text index with Elias-Fano boundary lists.

Identical texts are grouped once: by a 128-bit hash to find which can repeat at all, then by the text itself. A group's
entry is the list of its line ends in code points, in Elias-Fano form: the low bits of each end packed, the high bits as a
run-length in unary, so a text of n lines and m code points takes about n * (2 + log2(m / n)) bits and any end is read
without the others. The entries are joined back to the documents by hash, the texts compared once more, and each
document's seeded cut is two selections from its list. A text whose hash occurs once needs no group: its entry is
computed where the text lies. Which hashes repeat is told by a bitmap of ``bitmap_bits`` bits, the only thing that is broadcast; a place that two hashes
share only sends a text through the group that didn't need it.

Null texts are empty; an empty text has no line and stays plain. Very long texts are cut whole. Rows are independent: repeated rows
give repeated results, and rows that repeat an id get one seed and each its own text. A null id is the seed of an empty id. Empty tables give no rows; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.textkit import small_batches

MARKS = ("<P>", "<S>", "<M>")
_BITMAP = 1 << 15


class EliasFano:
    """A rising list of numbers below ``universe`` + 1; ``select`` reads one of them."""

    def __init__(self, n: int, shift: int, low: bytes, high: bytes):
        self.n, self.shift, self.low, self.high = n, shift, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"")
        values = values.astype(np.int64)
        shift = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = np.zeros((int(values[-1]) >> shift) + n, np.uint8)
        high[(values >> shift) + np.arange(n)] = 1
        low = (values[:, None] >> np.arange(shift)) & 1
        return cls(n, shift, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        counts = np.cumsum(np.bitwise_count(np.frombuffer(self.high, np.uint8)), dtype=np.int64)
        byte = int(np.searchsorted(counts, i, "right"))
        left, bits, at = i - (int(counts[byte - 1]) if byte else 0), self.high[byte], 0
        while True:
            if bits >> at & 1:
                if not left:
                    break
                left -= 1
            at += 1
        first, last = i * self.shift, (i + 1) * self.shift
        piece = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little") >> (first & 7)
        return (8 * byte + at - i) << self.shift | piece & ((1 << self.shift) - 1)

    def end(self, units: int) -> int:
        """Where the first ``units`` units end; none end at 0."""
        return self.select(units - 1) if units else 0


def line_ends(text: str) -> np.ndarray:
    """The end of each unit ``[^\\n]*\\n|[^\\n]+`` in code points."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.append(ends, len(text)) if text and text[-1] != "\n" else ends


def seeds(doc_id: object, seed: int) -> tuple[int, ...]:
    """h1 to h4: four 8-digit groups of the sha256 of the seed, a colon and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, ends: EliasFano, doc_id: object, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[str, str, int | None, int | None]:
    """The output, its form (plain, psm or spm), and the lengths of prefix and middle."""
    h1, h2, h3, h4 = seeds(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return text, "plain", None, None
    low, high = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
    first, last = ends.end(low), ends.end(high)
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", first, last - first
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", first, last - first


def restore(output: str, form: str) -> str:
    """The text that ``transform`` was given."""
    if form == "plain":
        return output
    one, _, rest = output[3:].partition("<P>" if form == "spm" else "<S>")
    two, _, middle = rest.partition("<M>")
    return two + middle + one if form == "spm" else one + middle + two


_ENTRY = "lines int, shift int, low binary, high binary"
_OUT = "n long, form string, output string, prefix_chars long, middle_chars long"
_OUT_TYPES = [pa.int64(), pa.string(), pa.large_string(), pa.int64(), pa.int64()]


def _repeating(keyed: DataFrame, bitmap_bits: int) -> tuple[DataFrame, Column]:
    """Blocks of a bitmap with a bit for each hash that two rows have, and the condition that a row's bit is set."""
    place = F.pmod(F.col("h1"), F.lit(bitmap_bits))
    block, bit = F.floor(place / _BITMAP).cast("int"), place % _BITMAP
    twice = keyed.groupBy("h1", "h2").count().where("count > 1")
    blocks = twice.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(h1, 8) as int))")) > 0, F.lit(False))
    return keyed.join(F.broadcast(blocks), block == F.col("block"), "left"), is_set


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, bitmap_bits: int = 1 << 26) -> DataFrame:
    """Per row: the id, ``n`` lines, ``form``, ``output``, ``prefix_chars`` and ``middle_chars``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    marked, repeats = _repeating(keyed, bitmap_bits)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            lists = [EliasFano.of(line_ends(t)) for t in batch.column("text").to_pylist()]
            more = [pa.array([x.n for x in lists], pa.int32()), pa.array([x.shift for x in lists], pa.int32()), pa.array([x.low for x in lists], pa.binary()), pa.array([x.high for x in lists], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lines", "shift", "low", "high"])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if "lines" in batch.schema.names:
                lists = [EliasFano(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lines", "shift", "low", "high")), strict=True)]
            else:
                lists = [EliasFano.of(line_ends(t)) for t in texts]
            found = [transform(t, e, i, seed, rate, spm) for i, t, e in zip(ids, texts, lists, strict=True)]
            columns = [[e.n for e in lists], [f for _, f, _, _ in found], [o for o, _, _, _ in found], [p for _, _, p, _ in found], [m for _, _, _, m in found]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _OUT_TYPES, strict=True))], ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    out = f"doc_id {kind}, {_OUT}"
    once = marked.where(~repeats).select("doc_id", "text").mapInArrow(cuts, out)
    several = marked.where(repeats).select("doc_id", "text", "h1", "h2")
    # The group's key is the whole text; a text that holds a third of all rows leaves each task once.
    groups = several.groupBy("text").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    index = groups.mapInArrow(entries, f"text string, h1 long, h2 long, {_ENTRY}").withColumnRenamed("text", "entry_text")
    members = several.join(index, ["h1", "h2"]).where("text = entry_text")
    return once.unionByName(members.select("doc_id", "text", "lines", "shift", "low", "high").mapInArrow(cuts, out))


def restored(rows: DataFrame, name: str = "restored") -> DataFrame:
    """The rows of ``fill_in_middle`` with the exact text rebuilt from ``output`` and ``form`` alone."""
    body = F.substring("output", F.lit(4), F.length("output"))
    a, b = F.locate("<P>", body), F.locate("<S>", body)
    cut = F.when(F.col("form") == "spm", a).otherwise(b)
    one = F.substring(body, F.lit(1), cut - 1)
    rest = F.substring(body, cut + 3, F.length(body))
    mark = F.locate("<M>", rest)
    two, middle = F.substring(rest, F.lit(1), mark - 1), F.substring(rest, mark + 3, F.length(rest))
    whole = F.when(F.col("form") == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
    return rows.withColumn(name, F.when(F.col("form") == "plain", F.col("output")).otherwise(whole))


def middle_digest(rows: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
