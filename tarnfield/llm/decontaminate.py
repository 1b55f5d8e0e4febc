"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are cut into words (lower-cased runs of letters, digits and bytes above ASCII) and rewritten with one space
around each word, so that a window of words is a byte string to search for. Patterns are sorted into classes by length.
In each class a table, indexed by the hash of a block of bytes, tells how far the search may jump; where it may not,
the patterns that end in such a block are taken from a bucket, checked by their first bytes and then compared whole.
A chunk of text is searched by many readers abreast, each in its own stretch, as NumPy vectors.

Null texts have no words. An item with fewer words than a window is one window; an item without words or without an id
takes no part. Items that repeat an id count once. Repeated documents give repeated results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.graph import cut
from tarnfield.llm.textkit import LOWER, byte_set, chunked, find_words, give_back, text_bytes

WORD_BYTES = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SPACE = 0x20
_STRETCH = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def spaced_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rewritten text of all rows, where each word begins in it, and each row's first word.

    A row is a space and then each word and a space; two spaces stand between rows, so no pattern crosses them.
    """
    starts, ends, rows = find_words(data, edges, WORD_BYTES)
    sizes = ends - starts
    row_of = np.repeat(np.arange(len(edges) - 1), np.diff(rows))
    extra = np.arange(1, len(starts) + 1) + row_of
    before = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()) + len(starts) + len(edges) + 7, _SPACE, np.uint8)
    source = data[WORD_BYTES[data]]
    out[np.arange(len(source)) + np.repeat(extra, sizes)] = LOWER[source]
    return out, before + extra, rows


def _eight_bytes(text: np.ndarray) -> np.ndarray:
    """A view with the eight bytes from each place on, as one number."""
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))


class PatternClass:
    """The shift table, suffix buckets and patterns of one length class."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.least = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        self.bits = int(np.clip(np.ceil(np.log2(len(patterns) * m + 1)) + 3, 12, 22))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for end in range(b, m + 1):
            slots = self._slots(self._pack(heads[:, end - b : end]))
            np.minimum.at(self.shift, slots, m - end)
        slots = self._slots(self._pack(heads[:, m - b :]))
        order = np.argsort(slots, kind="stable")
        self.patterns = [patterns[i] for i in order]
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.first = self._pack(heads[order][:, :b])
        self.slots = slots[order]

    @staticmethod
    def _pack(blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), np.uint64)
        for i in range(blocks.shape[1]):
            out |= blocks[:, i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def _slots(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and ids of every pattern that occurs in the first ``size`` bytes; eight more bytes follow them."""
        m, b, wide, raw = self.least, self.block, _eight_bytes(text), text.tobytes()
        at = np.arange(m, size + 1, _STRETCH)
        limit = np.minimum(at + _STRETCH, size + 1)
        halts = []
        while len(at):
            slots = self._slots(wide[at - b] & self.mask)
            jump = self.shift[slots]
            stop = jump == 0
            if stop.any():
                halts.append((at[stop] - m, slots[stop]))
            at = at + np.maximum(jump, 1)
            going = at < limit
            if not going.all():
                at, limit = at[going], limit[going]
        if not halts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, slots = (np.concatenate(x) for x in zip(*halts, strict=True))
        low, high = np.searchsorted(self.slots, slots), np.searchsorted(self.slots, slots, "right")
        many = high - low
        places = np.repeat(places, many)
        which = np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        near = (wide[places] & self.mask) == self.first[which]
        places, which = places[near], which[near]
        same = np.fromiter((raw.startswith(self.patterns[j], i) for i, j in zip(places.tolist(), which.tolist(), strict=True)), bool, len(places))
        return places[same], self.ids[which[same]]


class WindowSearch:
    """All windows of a block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        found: dict[bytes, set[int]] = defaultdict(set)
        self.items = sorted({k for k, _ in items})
        number = {k: i for i, k in enumerate(self.items)}
        for key, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = find_words(raw, np.array([0, len(raw)]), WORD_BYTES)
            low = LOWER[raw].tobytes()
            words = [low[s:e] for s, e in zip(starts, ends, strict=True)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found[b" " + b" ".join(words[i : i + window]) + b" "].add(number[key])
        patterns = sorted(found)
        self.lengths = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.owners = [sorted(found[p]) for p in patterns]
        classes: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(patterns):
            classes[len(p).bit_length()].append(i)
        self.classes = [PatternClass([patterns[i] for i in own], own) for _, own in sorted(classes.items())]

    def hits(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: its number of words, the merged ranges of hit words, and the items that occur."""
        data, bounds = text_bytes(column)
        for first, last in chunked(bounds):
            text, begins, rows = spaced_words(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            found = [c.search(text, len(text) - 7) for c in self.classes]
            places = np.concatenate([p for p, _ in found] or [np.zeros(0, np.int64)])
            which = np.concatenate([w for _, w in found] or [np.zeros(0, np.int64)])
            words = np.searchsorted(begins, places + 1)
            docs = np.searchsorted(rows, words, "right") - 1
            order = np.lexsort((words, docs))
            cuts = np.searchsorted(docs[order], np.arange(last - first + 1))
            for i in range(last - first):
                own = order[cuts[i] : cuts[i + 1]]
                n = int(rows[i + 1] - rows[i])
                if not len(own):
                    yield n, [], []
                    continue
                begin = words[own] - rows[i]
                yield n, merged(zip(begin.tolist(), (begin + self.lengths[which[own]]).tolist(), strict=True)), sorted({self.items[k] for w in set(which[own].tolist()) for k in self.owners[w]})


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items as broadcast searches of about ``block_bytes`` of text each, so that no broadcast grows with the table; and whether it is the last."""
    items = benchmark.select(F.col(item_id).cast("string").alias("_id"), F.col(text).alias("_text")).where("_id is not null and _text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    context = benchmark.sparkSession.sparkContext
    for i in range(parts):
        rows = items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)) == i).collect()
        yield context.broadcast(WindowSearch([(r["_id"], r["_text"]) for r in rows], window)), i == parts - 1


_RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row: the id, ``n_words``, ``spans`` (hit words as ranges, end exclusive) and ``items`` (ids as sorted strings).

    A benchmark of more than ``block_bytes`` is searched block by block, in as many passes over the rows; what a pass found
    is written to the shared folder, and its block given up, before the next.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = "doc_id {}, n_words long, spans array<struct<first:int,last:int>>, items array<string>".format(kind)
    for i, (block, final) in enumerate(_blocks(benchmark, item_id, item_text, window, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], block=block, final=final, started=i > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text")
                found = list(block.value.hits(texts))
                if started:
                    before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                    found = [(n, merged([*((x["first"], x["last"]) for x in old), *spans]), sorted({*items, *had})) for (n, spans, items), (old, had) in zip(found, before, strict=True)]
                columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array([n for n, _, _ in found], pa.int64()), "spans": pa.array([[{"first": a, "last": b} for a, b in spans] for _, spans, _ in found], _RANGES), "items": pa.array([items for _, _, items in found], pa.list_(pa.string()))}
                if not final:
                    columns["text"] = texts
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        rows = rows.mapInArrow(run, out if final else f"{out}, text string")
        if not final:
            rows = cut(rows)
            block.destroy()
    return rows


def contamination_digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows, with all their columns, in which no window of the benchmark occurs."""
    at = docs.columns.index(text)
    for block, final in _blocks(benchmark, item_id, item_text, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                yield batch.filter(pa.array([not spans for _, spans, _ in block.value.hits(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not final:
            docs = cut(docs)
            block.destroy()
    return docs
