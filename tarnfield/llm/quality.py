"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are hashed indicators of word one- and two-grams (lower case), of word-shape one- to three-grams (runs of
upper, lower, digit and each punctuation byte) and of which neighbouring words are equal; one more tells the order of
magnitude of the word count. Indicators are scaled by the log ratio of the classes' smoothed feature shares, and a
linear hinge-loss model is fitted to them by dual coordinate descent. Null and empty texts get the score of the bare
length feature. With no labelled row, or rows of one class only, every score is the class share (0.5 if there is none).
A score of just 0.5 counts as label 1. Rows are independent, so repeated rows give repeated scores; an empty table gives no
rows, very long texts are read whole, and columns but the named ones are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.textkit import LOWER, SPACES, bounded_sample, chain, chunked, find_words, fold_rule, prefix_sums, span_hash, text_bytes

BITS = 18
_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[48:58], _SHAPES[65:91], _SHAPES[97:123], _SHAPES[128:] = 48, 65, 97, 97


def indicator_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a column, the distinct hashed features."""
    data, bounds = text_bytes(column)
    for first, last in chunked(bounds):
        part = data[bounds[first] : bounds[last]]
        edges = bounds[first : last + 1] - bounds[first]
        starts, ends, rows = find_words(part, edges, ~SPACES)
        words = span_hash(prefix_sums(LOWER[part]), starts, ends)
        # Shapes: drop a byte that repeats the class of the byte before it in the word.
        classes = _SHAPES[part]
        keep = np.ones(len(part), bool)
        keep[1:] = classes[1:] != classes[:-1]
        keep[starts] = True
        rank = np.concatenate(([0], np.cumsum(keep)))
        shapes = span_hash(prefix_sums(classes[keep]), rank[starts], rank[ends])
        same = np.zeros(len(words), np.uint64)
        same[1:] = words[1:] == words[:-1]
        # A text's first word has none before it.
        same[rows[:-1][rows[:-1] < len(words)]] = 0
        step = lambda x, k: np.concatenate((x[k:], np.zeros(min(k, len(x)), np.uint64)))
        one, two, three = shapes, step(shapes, 1), step(shapes, 2)
        grams = ((1, chain(words, seed=11)), (2, chain(words, step(words, 1), seed=12)), (1, chain(one, seed=13)), (2, chain(one, two, seed=14)), (3, chain(one, two, three, seed=15)), (3, chain(same, step(same, 1), step(same, 2), seed=16)))
        grams = [(k, (g >> np.uint64(64 - BITS)).astype(np.int32)) for k, g in grams]
        for i in range(last - first):
            low, high = rows[i], rows[i + 1]
            size = chain(np.array([int(high - low).bit_length()], np.uint64), seed=17) >> np.uint64(64 - BITS)
            yield np.concatenate([g[low : max(low, high - k + 1)] for k, g in grams] + [size.astype(np.int32)])


class SupportVectors:
    """Weights of the hashed indicators, a bias, and the slope and offset that turn a margin into a score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def fit_nbsvm(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1, epochs: int = 12, smooth: float = 1.0, blend: float = 0.9, seed: int = 3) -> SupportVectors:
    """``rows``: distinct features of each example. Dual coordinate descent on the L1 hinge loss, in a seeded order."""
    size = 1 << BITS
    if len(rows) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.5
        return SupportVectors(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    counts = np.full((2, size), smooth)
    for features, label in zip(rows, labels, strict=True):
        counts[int(label), features] += 1
    shares = counts / (np.array([(labels == 0).sum(), (labels == 1).sum()]) + 2 * smooth)[:, None]
    ratio = np.log(shares[1] / shares[0])
    y = np.where(labels == 1, 1.0, -1.0)
    caps = cost * len(y) / (2 * np.array([(labels == 0).sum(), (labels == 1).sum()]))[labels.astype(int)]
    values = [ratio[f] / np.sqrt(len(f)) for f in rows]
    norms = np.array([v @ v for v in values]) + 1.0
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), caps[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y[i]
                weights[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
    mean = np.abs(weights[weights != 0]).mean() if weights.any() else 0.0
    weights = (1 - blend) * mean + blend * weights if blend < 1 else weights
    margins = np.array([weights[f] @ v for f, v in zip(rows, values, strict=True)]) + bias
    slope, offset = _calibrate(margins, labels)
    return SupportVectors((weights * ratio).astype(np.float32), bias, slope, offset)


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([(margins * (p - labels)).sum() + 1e-2 * a, (p - labels).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-2, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
    return max(a, 1e-3), b


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 6000) -> SupportVectors:
    """Learns from at most ``sample_rows`` rows of ``labels`` (half for each class, if there are as many), by hash of the id.

    The bound holds the fit to seconds at any table size; scoring reads every row. An id with both labels counts as 0, and
    of an id with several texts the smallest is learned from, once.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    sample = bounded_sample(known.where("_label = 0"), "_id", sample_rows // 2).unionByName(bounded_sample(known.where("_label = 1"), "_id", sample_rows // 2))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    got = rows.select("_label", "_text").mapInArrow(_features, "label int, features binary").collect()
    got = sorted((int(r["label"]), bytes(r["features"])) for r in got)
    return fit_nbsvm([np.frombuffer(b, np.int32) for _, b in got], np.array([k for k, _ in got]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(x).tobytes() for x in indicator_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["label", "features"])


def score_quality(docs: DataFrame, model: SupportVectors, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and ``score`` (0 to 1, higher: label 1 likelier). Only the id and the text are read."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scorer(rows, model, 1), f"doc_id {kind}, score double").select("doc_id", "score")


def keep_good(docs: DataFrame, model: SupportVectors, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), frozen.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def _scores(column: pa.Array, model: SupportVectors) -> np.ndarray:
    seen, margins = np.zeros(1 << BITS, bool), []
    for features in indicator_rows(column):
        seen[features] = True
        distinct = np.flatnonzero(seen) if len(features) > 20_000 else np.unique(features)
        seen[features] = False
        margins.append(model.weights[distinct].sum(dtype=np.float64) / np.sqrt(len(distinct)) + model.bias)
    return model.score(np.array(margins))


def _scorer(docs: DataFrame, model: SupportVectors, at: int):
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(at), frozen.value), pa.float64())], ["doc_id", "score"])

    return run


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = fold_rule("doc_id", 3, 1)
    model = fit_quality(docs, labels.where(~held))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
