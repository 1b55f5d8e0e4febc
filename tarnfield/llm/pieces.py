"""SentencePiece encoding and decoding with exact N-best segmentations.

The pieces come from a model file; nothing is trained. That file ranks its pieces but holds no probabilities, so a piece of
rank r (from 0) gets the Zipf cost ``log(r + 2.7)`` plus a constant, a byte piece one fixed higher cost, all as whole
micro-nats, so that sums are exact and ties are real. A character without a piece of its own is spelt in byte pieces.

A text, with one space put before it, falls into segments that no piece of the model crosses: spaces with the word behind
them, line feeds, and literal U+2581 signs, which are spelt in bytes so that decoding gives back every text exactly. Each
segment is a lattice. A forward Viterbi pass gives the least two costs to every place, and an A-star search from the end,
with the least costs as its heuristic, delivers segmentations in order of cost. The N best of a whole text are merged from
the segments: only those N - 1 places that lose least by a second choice can differ from the first choice, so the search
runs for those alone and the merge is exact.

Null and empty texts have no pieces and one segmentation. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.textkit import fresh_names, give_back, small_batches

_SPACE_SIGN = "▁"
#: From fine to coarse: spaces with a run of letters, of digits or of other signs behind them; or with any run.
_SEGMENTS = (re.compile(r" *[^\W\d_²³¹¼½¾]+| *\d+| *(?:[^\w \n▁]|[_²³¹¼½¾])+| +|\n|▁|\w"), re.compile(" *[^ \n▁]+| +|\n|▁"))
#: Segments remembered in each of two generations, and their greatest length.
_MEMO, _MEMO_LENGTH = 200_000, 40
#: Words of 32 bits before the pieces of a remembered segment: its cost and the loss by the second choice.
_HEAD = np.arange(4)
#: Pieces decoded at once.
_DECODE_BLOCK = 200_000
#: Micro-nats of a byte piece.
_BYTE_COST = 14_000_000


class PieceModel:
    """Piece numbers and costs, as a tree of characters; cheap to send, the tree is built where it is used."""

    def __init__(self, pieces: list[str], is_byte: list[bool], usable: list[bool]):
        self.pieces, self.is_byte, self.usable = pieces, is_byte, usable
        self._tree: dict | None = None

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in n], [model.is_byte(i) for i in n], [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in n])

    def __getstate__(self):
        return {"pieces": self.pieces, "is_byte": self.is_byte, "usable": self.usable, "_tree": None}

    @property
    def tree(self) -> dict:
        if self._tree is None:
            self._build()
        return self._tree

    def _build(self) -> None:
        tree: dict = {}
        self.bytes_of, self.byte_ids = [b""] * len(self.pieces), {}
        rank = 0
        scale = math.log(sum(1 / (r + 2.7) for r in range(len(self.pieces))))
        for i, piece in enumerate(self.pieces):
            if self.is_byte[i]:
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_ids[value] = bytes([value]), i
            elif self.usable[i]:
                node, cost = tree, round(1e6 * (math.log(rank + 2.7) + scale))
                for at, c in enumerate(piece, 1):
                    found = node.get(c)
                    if found is None or at == len(piece):
                        # A node is its children, and the cost and number of the piece that ends there, if one does.
                        found = node[c] = (found[0] if found else {}, cost if at == len(piece) else 0, i if at == len(piece) else -1)
                    node = found[0]
                self.bytes_of[i] = piece.replace(_SPACE_SIGN, " ").encode()
                rank += 1
        whole = [p.replace(_SPACE_SIGN, " ") for i, p in enumerate(self.pieces) if self.usable[i] and not self.is_byte[i]]
        self._segment = next((r for r in _SEGMENTS if all(r.fullmatch(p) for p in whole)), re.compile(r"(?s)▁|[^▁]+"))
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._searched: dict[tuple[str, int], list] = {}
        self.longest = max(map(len, whole), default=1)
        self._sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self._places = np.cumsum(self._sizes) - self._sizes
        self._flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._tree = tree

    def _spelt(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in (" " if c == _SPACE_SIGN else c).encode())

    def _costs(self, segment: str) -> tuple[list, list, list]:
        """For each place the least and second least cost from the start, and the last piece of the least."""
        root, longest = self.tree, self.longest
        text = segment.replace(" ", _SPACE_SIGN)
        size = len(text)
        least, second, last = [math.inf] * (size + 1), [math.inf] * (size + 1), [None] * (size + 1)
        least[0] = 0
        for i, start in enumerate(text):
            one, two, j = least[i], second[i], i + 1
            found = root.get(start)
            if found is None or found[2] < 0:
                ids = self._spelt(start)
                total, gap = one + _BYTE_COST * len(ids), two + _BYTE_COST * len(ids)
                if total < least[j]:
                    second[j] = least[j] if least[j] < gap else gap
                    least[j], last[j] = total, (i, ids)
                elif total < second[j]:
                    second[j] = total
                if found is None:
                    continue
                rest = text[j : i + longest]
                node = found[0]
            else:
                rest = text[j : i + longest]
                node, cost, piece = found
                total = one + cost
                if total < least[j]:
                    second[j] = least[j] if least[j] < two + cost else two + cost
                    least[j], last[j] = total, (i, piece)
                elif total < second[j]:
                    second[j] = total
            for c in rest:
                found = node.get(c)
                if found is None:
                    break
                j += 1
                node, cost, piece = found
                if piece >= 0:
                    total = one + cost
                    if total < least[j]:
                        second[j] = least[j] if least[j] < two + cost else two + cost
                        least[j], last[j] = total, (i, piece)
                    elif total < second[j]:
                        second[j] = total
        return least, second, last

    def _edges_into(self, segment: str) -> list[list]:
        """For each place the pieces that end there, as (start, cost, piece)."""
        root = self.tree
        text = segment.replace(" ", _SPACE_SIGN)
        into: list[list] = [[] for _ in range(len(text) + 1)]
        for i in range(len(text)):
            node, single = root, False
            for j in range(i, len(text)):
                found = node.get(text[j])
                if found is None:
                    break
                node, cost, piece = found
                if piece >= 0:
                    into[j + 1].append((i, cost, piece))
                    single = single or j == i
            if not single:
                ids = self._spelt(text[i])
                into[i + 1].append((i, _BYTE_COST * len(ids), ids))
        return into

    def segment_best(self, segment: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` least (cost, pieces) of one segment in order; equal costs: the longer last piece first."""
        if segment == _SPACE_SIGN:
            ids = self._literal()
            return [(_BYTE_COST * len(ids), ids)]
        least, into = self._costs(segment)[0], self._edges_into(segment)
        out: list[tuple[int, tuple[int, ...]]] = []
        size = len(segment)
        heap: list[tuple] = [(least[size], size, 0, 0, None)]
        number = 0
        while heap:
            total, place, _, behind, path = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while path is not None:
                    piece, path = path
                    ids.extend(piece if isinstance(piece, tuple) else (piece,))
                out.append((total, tuple(ids)))
                if len(out) == n:
                    break
                continue
            for start, cost, piece in into[place]:
                number += 1
                heapq.heappush(heap, (behind + cost + least[start], start, number, behind + cost, (piece, path)))
        return out

    def _literal(self) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in _SPACE_SIGN.encode())

    def segments(self, text: str) -> list[str]:
        self.tree  # noqa: B018
        return self._segment.findall(" " + text) if text else []

    def _first(self, segment: str) -> tuple[bytes, int, float]:
        """Of a segment: the first choice as 32-bit numbers, its cost, and the loss by the second choice."""
        if segment == _SPACE_SIGN:
            ids = self._literal()
            return struct.pack(f"{len(ids)}i", *ids), _BYTE_COST * len(ids), math.inf
        least, second, last = self._costs(segment)
        place, back = len(segment), []
        while place:
            place, piece = last[place]
            back.append(piece)
        ids = [x for piece in reversed(back) for x in (piece if isinstance(piece, tuple) else (piece,))]
        return struct.pack(f"{len(ids)}i", *ids), least[-1], second[-1] - least[-1]

    def _entry(self, segment: str) -> bytes:
        """Cost, loss and first choice of a segment in one string of bytes, as it is remembered."""
        entry = self._older.get(segment)
        if entry is None:
            ids, cost, loss = self._first(segment)
            entry = struct.pack("qd", cost, loss) + ids
        if len(segment) <= _MEMO_LENGTH:
            if len(self._memo) >= _MEMO:
                self._older = dict(self._memo)
                self._memo.clear()
            self._memo[segment] = entry
        return entry

    def encode(self, text: str | None, n: int = 3) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
        """The best pieces, and for each of the ``n`` best the cost and what it changes: (first, last, pieces instead)."""
        segments = self.segments(text or "")
        entries = list(map(self._memo.get, segments)) if segments else []
        if None in entries:
            fresh = self._entry
            entries = [e or fresh(s) for e, s in zip(entries, segments, strict=True)]
        if not entries:
            return np.zeros(0, np.int32), [(0, [])]
        flat = np.frombuffer(b"".join(entries), np.int32)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        heads = (np.cumsum(sizes) - sizes)[:, None] + _HEAD
        own = np.ones(len(flat), bool)
        own[heads] = False
        ids, heads = flat[own], flat[heads]
        total = int(heads[:, :2].copy().view(np.int64).sum())
        if n <= 1:
            return ids, [(total, [])]
        sizes -= len(_HEAD)
        choices: list[tuple[int, list[tuple[int, int]]]] = [(total, [])]
        losses = heads[:, 2:].copy().view(np.float64).ravel()
        open_places = np.argsort(losses, kind="stable")[: n - 1] if len(losses) < 4 * n else np.sort(np.argpartition(losses, n - 1)[: n - 1])
        options = {}
        for i in open_places.tolist():
            if losses[i] == math.inf:
                continue
            options[i] = best = self._options(segments[i], n)
            merged = [(cost + option[0] - best[0][0], change + [(i, k)] if k else change) for cost, change in choices for k, option in enumerate(best)]
            choices = sorted(merged, key=lambda x: (x[0], sorted(x[1])))[:n]
        at = {i: int(sizes[:i].sum()) for i in options}
        return ids, [(cost, [(at[i], at[i] + int(sizes[i]), options[i][k][1]) for i, k in sorted(change)]) for cost, change in choices]

    def _options(self, segment: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        found = self._searched.get((segment, n))
        if found is None:
            found = self.segment_best(segment, n)
            if len(segment) <= _MEMO_LENGTH:
                if len(self._searched) >= _MEMO // 10:
                    self._searched.clear()
                self._searched[segment, n] = found
        return found

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces without the space put before the text; gathered from one table, block by block."""
        self.tree  # noqa: B018
        out = []
        for first in range(0, len(ids), _DECODE_BLOCK):
            own = ids[first : first + _DECODE_BLOCK]
            sizes = self._sizes[own]
            before = np.cumsum(sizes) - sizes
            out.append(self._flat[np.arange(int(sizes.sum())) + np.repeat(self._places[own] - before, sizes)].tobytes())
        return b"".join(out).removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces; bytes that are no UTF-8 become U+FFFD."""
        return self.decoded_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def apply_changes(ids: list[int], changes: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The pieces of a further choice."""
    out, last = [], 0
    for first, end, new in changes:
        out += [*ids[last:first], *new]
        last = end
    return out + list(ids[last:])


_CHOICES = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("changes", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = "n_pieces int, ids array<int>, best array<struct<score:double,n_pieces:int,changes:array<struct<first:int,last:int,ids:array<int>>>>>, round_trip boolean"


def encode_texts(docs: DataFrame, model: PieceModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", n: int = 3) -> DataFrame:
    """Per row: the ``keep`` columns, the best pieces, the ``n`` best segmentations by falling score, and whether decoding
    the best gives back the text (null as empty). ``best`` tells each by what it changes in the first.

    A kept column with the name of a result has underscores put before its own.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    names = fresh_names(["n_pieces", "ids", "best", "round_trip"], *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        pieces = frozen.value
        for batch in small_batches(batches):
            ids, best, sizes, good = [], [], [0], []
            for value in batch.column(len(keep)).to_pylist():
                own, choices = pieces.encode(value, n)
                ids.append(own)
                sizes.append(sizes[-1] + len(own))
                best.append([{"score": -cost / 1e6, "n_pieces": len(own) + sum(len(x) - (b - a) for a, b, x in changes), "changes": [{"first": a, "last": b, "ids": list(x)} for a, b, x in changes]} for cost, changes in choices])
                good.append(pieces.decoded_bytes(own) == (value or "").encode())
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(np.diff(sizes), pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32())), pa.array(best, _CHOICES), pa.array(good, pa.bool_())],
                [*names, "n_pieces", "ids", "best", "round_trip"],
            )

    kinds = ", ".join(f"`{name}` {docs.schema[c].dataType.simpleString()}" for name, c in zip(names, keep, strict=True))
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(fresh_names(list(keep), "text")[0])).mapInArrow(run, f"{kinds}, {SCHEMA}")


def decode_ids(rows: DataFrame, model: PieceModel, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their pieces as last column, in place of a column of that name; null where the pieces are null."""
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() != text.lower() or c == ids))
    if text.lower() == ids.lower():
        raise ValueError("the text needs another name than the pieces")
    frozen = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [None if x is None else frozen.value.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def public_model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
