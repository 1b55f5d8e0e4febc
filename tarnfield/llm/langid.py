"""Language identification: known words by per-language log frequency, unseen ones by shorter and shorter n-grams.

A word of the learned vocabulary scores by its relative frequency in each language. Any other word is read from
left to right by the longest known character n-gram at each place, from ``MAX_ORDER`` characters down to one, and
the steps' log frequencies are averaged and lowered by a fixed back-off cost. Texts that are null or have no letter
are ``und`` with score 0; so is everything if no labelled row exists. Of languages with equal sums the first by name wins.
Rows are independent, so repeated rows give repeated results (in training they count as often as they stand there); an
empty table gives no rows, very long texts are read whole, and columns but the named ones are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.textkit import fold_rule, small_batches

MAX_ORDER = 4
_WORD = re.compile(r"[^\W\d_]+")
#: Unseen words remembered by each worker.
_MEMO = 200_000
#: Values of a hash by which rows and words are drawn, and units of an n-gram's weight in one.
_HASHES = 1 << 30
_UNIT = 1 << 20


class WordFirstModel:
    """Log frequencies of words and character n-grams by language."""

    def __init__(self, counts: dict[str, dict[str, int]], weights: dict[str, dict[str, float]], backoff: float = 2.0):
        """``counts``: language to word to number of times; ``weights``: language to n-gram of marked words to its weight."""
        self.langs = sorted(counts)
        self.backoff = backoff
        totals = {k: sum(v.values()) for k, v in counts.items()}
        vocab = sorted({w for v in counts.values() for w in v})
        self.words = {w: i for i, w in enumerate(vocab)}
        self.table = np.array([[math.log((counts[k].get(w, 0) + 0.05) / (totals[k] + 0.05 * len(vocab))) for k in self.langs] for w in vocab], np.float32).reshape(len(vocab), len(self.langs))
        self.grams: list[dict[str, int]] = [{}]
        self.gram_tables = [np.zeros((0, len(self.langs)), np.float32)]
        for order in range(1, MAX_ORDER + 1):
            known = {g: i for i, g in enumerate(sorted({g for v in weights.values() for g in v if len(g) == order}))}
            table = np.zeros((len(known), len(self.langs)))
            for i, k in enumerate(self.langs):
                for g, n in weights.get(k, {}).items():
                    if len(g) == order:
                        table[known[g], i] = n
            self.grams.append(known)
            self.gram_tables.append(np.log((table + 0.05) / (table.sum(axis=0) + 0.05 * max(1, len(known)))).astype(np.float32))

    def unseen(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        out, steps, at = np.zeros(len(self.langs), np.float32), 0, 0
        while at < len(marked):
            for order in range(min(MAX_ORDER, len(marked) - at), 0, -1):
                found = self.grams[order].get(marked[at : at + order])
                if found is not None:
                    out += self.gram_tables[order][found] - self.backoff * (MAX_ORDER - order)
                    break
            steps += 1
            at += max(1, order - 1)
        return out / max(1, steps)


class _Memo(dict):
    """Word to row of the score table; unseen words are added until the memo is full and then dropped together."""

    def __init__(self, model: WordFirstModel):
        super().__init__(model.words)
        self.model, self.kept = model, len(model.words)
        self.table = np.zeros((self.kept + _MEMO, len(model.langs)), np.float32)
        self.table[: self.kept] = model.table

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.table[at] = self.model.unseen(word)
        return at

    def room(self, n: int) -> None:
        if len(self) + n > len(self.table):
            self.clear()
            self.update(self.model.words)
            if n > _MEMO:
                self.table = np.vstack([self.model.table, np.zeros((n, self.table.shape[1]), np.float32)])


def fit_language(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 8000, vocabulary: int = 60_000) -> WordFirstModel:
    """Learns from about ``sample_rows`` rows of each language of ``train`` (ids and languages), all rows of a smaller one, by hash of the id.

    Each language keeps its ``vocabulary`` most frequent words; n-grams are counted over all words of the sample. Both bounds
    hold for each language, so the model grows with the number of languages and not with the table; prediction reads every row.
    """
    spark = docs.sparkSession
    labels = train.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")).where("_id is not null and _lang is not null")
    sizes = labels.groupBy("_lang").count().collect()
    below = [(r["_lang"], min(_HASHES, -(-_HASHES * sample_rows // r["count"]))) for r in sizes]
    ids = labels.join(F.broadcast(spark.createDataFrame(below, "_lang string, _below long")), "_lang").where(F.pmod(F.xxhash64("_id"), F.lit(_HASHES)) < F.col("_below"))
    ids = ids.select("_id", "_lang").dropDuplicates()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).join(F.broadcast(ids), ["_id", "_lang"], "left_semi")
    counts = texts.where("_text is not null").select("_lang", "_text").mapInArrow(_count_words, "lang string, word string, n long")
    sums = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    # The least count of a kept word in each language, and the share of the words with just that count that are kept, by hash.
    least: dict[str, tuple[int, int]] = {}
    room = {r["_lang"]: vocabulary for r in sizes}
    for r in sorted(sums.groupBy("lang", "n").count().collect(), key=lambda r: (r["lang"], -r["n"])):
        if room[r["lang"]] > 0:
            least[r["lang"]] = r["n"], min(_HASHES, _HASHES * room[r["lang"]] // r["count"])
            room[r["lang"]] -= r["count"]
    kept = sums.join(F.broadcast(spark.createDataFrame([(k, *v) for k, v in least.items()], "lang string, _least long, _below long")), "lang")
    kept = kept.where((F.col("n") > F.col("_least")) | (F.col("n") == F.col("_least")) & (F.pmod(F.xxhash64("word"), F.lit(_HASHES)) < F.col("_below")))
    learned: dict[str, dict[str, int]] = {r["_lang"]: {} for r in sizes}
    for k, w, n in zip(*(c.to_pylist() for c in kept.select("lang", "word", "n").toArrow().columns), strict=True):
        learned[k][w] = n
    weights: dict[str, dict[str, float]] = {}
    grams = sums.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for k, g, n in zip(*(c.to_pylist() for c in grams.toArrow().columns), strict=True):
        weights.setdefault(k, {})[g] = n / _UNIT
    sums.unpersist()
    return WordFirstModel(learned, weights)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of marked words; a word counts by the logarithm of its times, in whole units so that any order of adding is the same."""
    seen: dict[tuple[str, str], int] = {}
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marked, weight = f"^{word}$", round(math.log1p(n) * _UNIT)
            for order in range(1, MAX_ORDER + 1):
                for j in range(len(marked) - order + 1):
                    key = lang, marked[j : j + order]
                    seen[key] = seen.get(key, 0) + weight
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([g for _, g in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.update((lang, w) for w in _WORD.findall(text.lower()))
        langs, words = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def score_text(text: str | None, memo: _Memo, langs: list[str]) -> tuple[str, float]:
    words = _WORD.findall(text.lower()) if text else []
    if not langs or not words or not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    memo.room(len(words))
    total = memo.table[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
    scaled = (total - total.max()) / math.sqrt(len(words))
    odds = np.exp(scaled)
    best = int(total.argmax())
    return langs[best], float(odds[best] / odds.sum())


def predict_language(docs: DataFrame, model: WordFirstModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred`` and ``score`` (0 to 1). Only the id and the text are read."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(frozen.value)
        for batch in small_batches(batches):
            found = [score_text(t, memo, frozen.value.langs) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    held = fold_rule("doc_id", 3, 1)
    model = fit_language(docs, docs.where(~held))
    return predict_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
