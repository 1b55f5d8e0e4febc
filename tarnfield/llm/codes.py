"""Vector code compression: product quantisation by filtering Lloyd, in exact integers.

Components become floor(1024 * x), and vectors are cut into equal consecutive parts. Every partition deals its vectors to chunks of at most
``chunk_rows`` and builds one kd-tree for each part position of a chunk: a balanced tree by medians of the widest component,
each node with the bounding box, the sum and the count of its points. The trees are written once, to the shared folder.
A round sends all entries down each tree: an entry leaves a node when every corner of the node's box is
nearer to another entry (or as near, with a lower index), and a node with one entry left is assigned as a whole by its cached
sum and count. Only the points of leaves that keep several entries are compared one by one. Sums and counts are
added in the task, then by a shuffle; the driver holds the entries of the code books and nothing that grows with the table.

Rows whose vector is null, empty or of a length that the number of parts doesn't divide, that holds null or non-finite
components, or that is of another length than the kept vector of the smallest id, are dropped. Equal distances go to the lower index, so
results depend on nothing but the rows. Fewer kept rows than entries give smaller code books; repeated ids start the books in order of their components,
null ids come last. An empty table gives no rows. Distances are exact: as 64-bit floats where these hold them, as Python's integers beyond;
an error that doesn't fit 64 bits is null, and components beyond 10^34 after scaling count as 10^34. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.graph import cut, shared_folder

_SUM = pa.decimal128(38, 0)
_LONG = 1 << 63
Books = list[np.ndarray]


def to_integers(rows: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component: 32 bits where they are enough, Python's integers otherwise."""
    scaled = np.clip(np.floor(rows * 1024.0), -1e34, 1e34)
    if not scaled.size or np.abs(scaled).max() < 2**31:
        return scaled.astype(np.int32)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(rows.shape)


def _exact_type(largest: int, width: int) -> type:
    """float64 if squared distances of components up to ``largest`` are exact in it, object otherwise."""
    return np.float64 if width * (2 * largest + 1) ** 2 < 2**52 else object


class KdTree:
    """A balanced tree over the rows of ``points``: level d has 2^d nodes, each a range of ``order`` with its box, sum and count."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        n = len(points)
        self.points, self.order = points, np.arange(n)
        self.bounds = [np.array([0, n])]
        depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
        for _ in range(depth):
            bounds = self.bounds[-1]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = points[self.order[a:b]]
                wide = int(np.argmax(own.max(0) - own.min(0)))
                self.order[a:b] = self.order[a:b][np.argsort(own[:, wide], kind="stable")]
            self.bounds.append(np.sort(np.concatenate((bounds, (bounds[:-1] + bounds[1:]) // 2))))
        own = points[self.order]
        self.low, self.high = ([f.reduceat(own, b[:-1], axis=0) for b in self.bounds] for f in (np.minimum, np.maximum))
        wide = object if points.dtype == object else np.int64
        self.sums = [np.add.reduceat(own.astype(wide), b[:-1], axis=0) for b in self.bounds]
        self.largest = int(np.abs(points).max()) if points.size else 0

    def filtered(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, int]]:
        """(entry or entries, level, first, last): whole nodes as (entry, level, node, -1), and what is left as (entries of the points, -1, first, last)."""
        kind = _exact_type(max(self.largest, int(np.abs(book).max())), book.shape[1])
        book, nodes = book.astype(kind), np.zeros(1, np.int64)
        left = np.ones((1, len(book)), bool)
        last = len(self.bounds) - 1
        for level in range(last + 1):
            left = self._prune(book, left, self.low[level][nodes].astype(kind), self.high[level][nodes].astype(kind))
            alone = left.sum(1) == 1
            for node, entry in zip(nodes[alone].tolist(), left[alone].argmax(1).tolist(), strict=True):
                yield entry, level, node, -1
            nodes, left = nodes[~alone], left[~alone]
            if not len(nodes):
                return
            if level < last:
                nodes, left = np.concatenate((2 * nodes, 2 * nodes + 1)), np.concatenate((left, left))
        for node, mine in zip(nodes.tolist(), left, strict=True):
            a, b = self.bounds[-1][node], self.bounds[-1][node + 1]
            open_entries = np.flatnonzero(mine)
            yield open_entries[_distances(self.points[self.order[a:b]].astype(kind), book[open_entries]).argmin(1)], -1, a, b

    @staticmethod
    def _prune(book: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``left`` without the entries that some entry, that nearest to the middle of the box, beats in the whole box."""
        left = left.copy()
        middle = np.where(left, _distances(low + high, 2 * book), np.inf)
        best = middle.argmin(1)
        node, entry = np.nonzero(left)
        mine, other = book[entry], book[best[node]]
        away = mine - other
        # The corner of the box that lies farthest towards the entry: if it is no nearer to it there, it is nowhere.
        corner = np.where(away > 0, high[node], low[node])
        gap = (away * (mine + other - 2 * corner)).sum(1)
        beaten = (gap > 0) | ((gap == 0) & (best[node] < entry))
        beaten &= entry != best[node]
        left[node[beaten], entry[beaten]] = False
        return left

    def assign(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, ties to the lower index."""
        out = np.empty(len(self.points), np.int64)
        for entry, level, a, b in self.filtered(book):
            if level >= 0:
                a, b = self.bounds[level][a], self.bounds[level][a + 1]
            out[self.order[a:b]] = entry
        return out

    def gather(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Adds the sums and counts of the points of each entry to ``sums`` and ``counts``."""
        for entry, level, a, b in self.filtered(book):
            if level >= 0:
                sums[entry] += self.sums[level][a]
                counts[entry] += int(self.bounds[level][a + 1] - self.bounds[level][a])
            else:
                np.add.at(sums, entry, self.points[self.order[a:b]])
                np.add.at(counts, entry, 1)


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, exact for the types that ``_exact_type`` gives."""
    return (points * points).sum(1)[:, None] - 2 * (points @ book.T) + (book * book).sum(1)[None, :]


def usable(table: DataFrame, vec_id: str, vector: str, label: str, parts: int) -> DataFrame:
    """(id, v, label) of the rows that take part; ``v`` in 64-bit floats."""
    rows = table.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)).where(good)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("n")).first()
    return rows.where(F.size("v") == (first["n"] if first else 0))


def plant(rows: DataFrame, parts: int, chunk_rows: int = 4096) -> DataFrame:
    """The forest: a row for each chunk with its ids, labels and one tree for each part, written to the shared folder."""
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, chunk_rows):
                piece = batch.slice(first, chunk_rows)
                points = to_integers(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1))
                trees = pickle.dumps([KdTree(part) for part in np.split(points, parts, axis=1)], protocol=5)
                own = [pa.array([piece.column(c).to_pylist()], pa.list_(piece.column(c).type)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([trees], pa.binary())], ["ids", "labels", "trees"])

    folder = f"{shared_folder(rows.sparkSession)}/trees-{uuid.uuid4().hex}"
    rows.select("id", "v", "label").mapInArrow(run, f"ids array<{ids}>, labels array<{labels}>, trees binary").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def refine(forest: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the floor of its points' mean; one without points stays."""
    frozen = forest.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = frozen.value
        sums, counts = [np.zeros(b.shape, object) for b in now], [np.zeros(len(b), np.int64) for b in now]
        for batch in batches:
            for packed in batch.column(0):
                for part, tree in enumerate(pickle.loads(packed.as_py())):
                    own = np.zeros(now[part].shape, object if tree.points.dtype == object else np.int64)
                    tree.gather(now[part], own, counts[part])
                    sums[part] += own.astype(object)
        for part, (total, n) in enumerate(zip(sums, counts, strict=True)):
            entry, place = (x.ravel() for x in np.indices(total.shape))
            used = n[entry] > 0
            columns = [np.full(int(used.sum()), part), entry[used], place[used]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([int(x) for x in total.ravel()[used]], _SUM), pa.array(n[entry[used]], pa.int64())], ["part", "entry", "place", "total", "n"])

    # At most as many rows as the books have components.
    rows = forest.select("trees").mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    new = [book.astype(object) for book in books]
    for r in rows:
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new


def encode(forest: DataFrame, books: Books) -> DataFrame:
    """(id, label, code, error) of every vector in the forest."""
    ids, labels = (forest.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    frozen = forest.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                codes, error = [], 0
                for tree, book in zip(pickle.loads(batch.column("trees")[at].as_py()), frozen.value, strict=True):
                    code = tree.assign(book)
                    gap = tree.points.astype(object if _exact_type(tree.largest, book.shape[1]) is object else np.int64) - book[code]
                    codes.append(code)
                    error = error + (gap * gap).sum(1)
                text = ["".join(f"{x:02x}" for x in row) for row in np.stack(codes, 1).tolist()]
                errors = [int(e) if e < _LONG else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(c)[at].values for c in ("ids", "labels")] + [pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return forest.mapInArrow(run, f"id {ids}, label {labels}, code string, error long")


def books_digest(books: Books) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Books]:
    """The coded rows (id, label, code, error) and the code books: ``entries`` of each part, 256 at most."""
    rows = usable(table, vec_id, vector, label, parts)
    start = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()], np.float64)
    books = [b.astype(object) for b in np.split(to_integers(start), parts, axis=1)] if len(start) else []
    forest = plant(rows, parts)
    for _ in range(rounds if books else 0):
        books = refine(forest, books)
    return encode(forest, books), books


def codes_query(table: DataFrame) -> DataFrame:
    coded, books = compress_vectors(table)
    coded = cut(coded)
    sums = coded.groupBy(F.col("label").alias("own_label")).agg(F.try_sum("error").alias("label_error"))
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("own_label")))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
