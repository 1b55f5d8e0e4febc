"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words, their openings of four and six letters, and openings shared by several words of a text. A text's vector has
all its terms: idf is that of the indexed examples, so a term of no example has a known frequency, 0, and counts in the
vector's length like any other. Examples lie in blocks, sorted by their most frequent terms, and each frequent term keeps its
largest weight in each block. Queries come in batches: the postings of the other terms give their share of every cosine, and
with the best of it in a block and those maxima every block is bounded for every query. The few best blocks are worked out
first, and then all others whose bound reaches the k-th best cosine so far, so the neighbours are exactly those of a full comparison. A neighbour's vote counts by the squared cosine of the same two texts with terms that speak for a label
raised, by 1 + chi2 / 5 if their chi-square is significant, and by how many labelled rows of its class it stands for: chi-square decides who
is heard among the nearest, not who is near. Votes are turned into a probability by an isotonic curve learned on the examples
themselves, each left out of its own vote.

Null and empty texts, and texts that share no term with an example, get the share of label 1 among examples without a term,
0 if there are none. With no labelled row the score is 0. Rows are independent, so repeated rows give repeated results and an empty
table gives none; very long texts are read whole. Equal cosines go to the smaller id. Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.textkit import bounded_sample, fold_rule, small_batches

_WORD = re.compile(r"[^\W\d_]+")
_IS_WORD = re.compile(r"[^\W\d_]").match
#: Every other ASCII character becomes a space.
_ASCII = {i: " " for i in range(128) if not _IS_WORD(chr(i))}
#: Texts with more kinds of other characters are cut by the pattern.
_MOST_SIGNS = 64
#: Judged texts remembered.
_MEMO = 10_000
#: Queries that are searched at once.
BATCH = 64
#: Blocks that are read before the bound of the others is looked at.
_AHEAD = 6
#: A term that one row in so many has lies in an array of all rows, for the most frequent ``_MOST_DENSE``; the rest in postings.
_DENSE = 64
_MOST_DENSE = 1024
Vector = tuple[Sequence[int], Sequence[float]]


def openings(word: str) -> tuple[str, ...]:
    return tuple(word[:n] + "*" for n in (4, 6) if len(word) >= n)


def words_of(text: str | None) -> list[str]:
    """The matches of ``_WORD`` in the lower-cased text; most texts have few kinds of other characters, each put out at once."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(_ASCII).split()
    signs = [c for c in set(text) if not _IS_WORD(c)]
    if len(signs) > _MOST_SIGNS:
        return _WORD.findall(text)
    for c in signs:
        text = text.replace(c, " ")
    return text.split()


def text_terms(text: str | None) -> Counter:
    """Words by times; openings by distinct words; and an opening of two, of three or more distinct words once more each."""
    out = Counter(words_of(text))
    opened = Counter(o for word in out for o in openings(word))
    for opening, n in opened.items():
        out[opening] = n
        for level in range(2, min(n, 3) + 1):
            out[f"{opening}{level}"] = 1
    return out


class Terms:
    """The terms of the examples with their idf and factors, and text to vectors of unit length."""

    def __init__(self, terms: list[str], examples: int, frequency: Sequence[int], factor: Sequence[float]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((1 + examples) / (1 + np.asarray(frequency, np.float64))) + 1
        self.factor = np.asarray(factor, np.float64)
        #: Of a term that no example has.
        self.other = math.log(1 + examples) + 1
        self._set_openings()

    def _set_openings(self) -> None:
        # By opening of an example, without its star: the numbers of it and its levels, -1 for none.
        number = self.number.get
        known = [t for t in self.number if t[-1] == "*"]
        self._place = place = {t[:-1]: i for i, t in enumerate(known)}
        self._levels = np.array([(number(t), number(t + "2", -1), number(t + "3", -1)) for t in known], np.int64).reshape(-1, 3)
        # By number of a word: the rows of its openings in that table, -1 for none.
        self._opened = np.array([(place.get(t[:4], -1), place.get(t[:6], -1) if len(t) > 5 else -1) if len(t) > 3 and "*" not in t else (-1, -1) for t in self.number], np.int64).reshape(-1, 2)

    def numbered(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and times of the text's terms, as ``text_terms`` has them; those of no example count on from the examples' own."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0)
        found = Counter(words_of(text))
        words = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
        # An opening that no example has is one of unknown words only.
        new = [w for w, i in zip(found, words.tolist(), strict=True) if i < 0]
        opened = Counter([w[:4] for w in new if len(w) > 3] + [w[:6] for w in new if len(w) > 5])
        places = np.fromiter(map(self._place.get, opened, repeat(-1)), np.int64, len(opened))
        met = np.fromiter(opened.values(), np.int64, len(opened))
        known = places >= 0
        places, times = np.unique(np.concatenate((self._opened[words[words >= 0]].ravel(), np.repeat(places[known], met[known]))), return_counts=True)
        levels, times = self._levels[places[places >= 0]], times[places >= 0]
        met = met[~known]
        others = np.concatenate((met, np.ones(np.count_nonzero(met > 1) + np.count_nonzero(met > 2))))
        two, three = levels[times > 1, 1], levels[times > 2, 2]
        at = np.concatenate((words, levels[:, 0], two, three, np.full(len(others), -1)))
        other = at < 0
        at[other] = len(self.number) + np.arange(np.count_nonzero(other))
        return at, np.concatenate((np.fromiter(found.values(), np.float64, len(found)), times, np.ones(len(two) + len(three)), others))

    def vectors(self, text: str | None) -> tuple[Vector, Vector]:
        """The text's plain vector of unit length on the terms of the examples, and what the factors add.

        Lengths are over all terms. The second has the terms with a factor, each weight times sqrt(factor^2 - 1), and is
        divided by the length with factors; its first entry, under -1, is the ratio of the plain length to that.
        """
        at, times = self.numbered(text)
        weight = 1 + np.log(times)
        mine = at < len(self.number)
        rest = float((weight[~mine] ** 2).sum()) * self.other**2
        at, weight = at[mine], weight[mine]
        order = np.argsort(at)
        at, weight = at[order], weight[order] * self.idf[at[order]]
        length = math.sqrt(float((weight * weight).sum()) + rest) or 1.0
        more = self.factor[at] > 1
        raised = weight[more] * np.sqrt(self.factor[at[more]] ** 2 - 1)
        long = math.sqrt(length * length + float((raised * raised).sum()))
        return (at, weight / length), (np.append(-1, at[more]), np.append(length, raised) / long)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._set_openings()


def _entries(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the keys lie, one key after the other, and the number of entries of each."""
    begin = first[keys]
    sizes = first[keys + 1] - begin
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


class BlockMaxIndex:
    """Unit vectors in blocks of rows: postings, and for the most frequent terms an array of all rows with each block's largest weights.

    ``pairs`` and ``scored`` count the pairs of query and block met so far and those of them that were worked out.
    """

    def __init__(self, vectors: list[Vector], terms: int, block: int = 64):
        rows = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        term = np.concatenate([np.asarray(v[0], np.int64) for v in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([np.asarray(v[1], np.float64) for v in vectors] or [np.zeros(0)])
        # Rows with the same frequent terms (texts of one language) come together, so that blocks differ in their bounds.
        often = np.bincount(term, minlength=terms)
        common = [tuple(sorted((-int(often[t]), int(t)) for t in v[0])[:3]) for v in vectors]
        self.rows = np.array(sorted(range(len(vectors)), key=lambda i: (common[i], i)), np.int64)
        self.block, self.blocks, self.terms = block, -(-len(vectors) // block), terms
        self.pairs = self.scored = 0
        self.place_of = np.empty(len(vectors), np.int64)
        self.place_of[self.rows] = np.arange(len(vectors))
        place = self.place_of[rows]
        often = np.where(often * _DENSE >= max(len(vectors), _DENSE), often, 0)
        many = np.sort(np.argsort(-often, kind="stable")[: min(_MOST_DENSE, np.count_nonzero(often))])
        self.dense_row = np.full(terms, -1, np.int64)
        self.dense_row[many] = np.arange(len(many))
        heavy = self.dense_row[term] >= 0
        self.dense = np.zeros((self.blocks, block, len(many)))
        self.dense[place[heavy] // block, place[heavy] % block, self.dense_row[term[heavy]]] = weight[heavy]
        self.dense_most = self.dense.max(axis=1)
        term, place, weight = term[~heavy], place[~heavy], weight[~heavy]
        order = np.lexsort((place, term))
        self.places, self.weights = place[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))

    def nearest(self, query: Vector, k: int, without: int = -1) -> list[tuple[float, int]]:
        return self.nearest_many([query], k, [without])[0]

    def nearest_many(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Of each query: (cosine, row) of the k nearest with a cosine above zero, nearest first, ties to the smaller row."""
        n = len(queries)
        if not self.blocks:
            return [[] for _ in queries]
        dense = np.zeros((n, self.dense.shape[2]))
        shares = np.empty((n, self.blocks, self.block))
        for i, (terms, weights) in enumerate(queries):
            shares[i] = self._share(np.asarray(terms, np.int64), np.asarray(weights, np.float64), dense[i])
        bound = shares.max(axis=2) + dense @ self.dense_most.T
        own = np.full(n, -1) if without is None else np.array([self.place_of[row] if row >= 0 else -1 for row in without])
        scores = np.zeros(shares.shape)
        first = np.argpartition(bound, -_AHEAD, axis=1)[:, -_AHEAD:] if self.blocks > _AHEAD else np.tile(np.arange(self.blocks), (n, 1))
        ahead = np.zeros(bound.shape, bool)
        np.put_along_axis(ahead, first, True, axis=1)
        ahead &= bound > 0
        self._score(scores, ahead, shares, dense, own)
        met = np.take_along_axis(scores, first[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(met, -k, axis=1)[:, [-k]] if met.shape[1] >= k else np.zeros((n, 1))
        rest = (bound > 0) & ~ahead & (bound >= least - 1e-9)
        self._score(scores, rest, shares, dense, own)
        self.pairs, self.scored = self.pairs + n * self.blocks, self.scored + int(ahead.sum() + rest.sum())
        return [self._best(row, k, low) for row, low in zip(scores.reshape(n, -1), least[:, 0], strict=True)]

    def _share(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """What the terms with postings add to the cosine of each row; fills in the query's weights of the others."""
        at = self.dense_row[terms]
        rare = at < 0
        dense[at[~rare]] = weights[~rare]
        at, sizes = _entries(self.first, terms[rare])
        return np.bincount(self.places[at], np.repeat(weights[rare], sizes) * self.weights[at], self.blocks * self.block).reshape(self.blocks, self.block)

    def _score(self, scores: np.ndarray, wanted: np.ndarray, shares: np.ndarray, dense: np.ndarray, own: np.ndarray) -> None:
        """Fills in the cosines, to twelve decimals, of the wanted pairs of query and block; that of a query's own place is 0."""
        for b in np.flatnonzero(wanted.any(0)):
            some = np.flatnonzero(wanted[:, b])
            scores[some, b] = np.round(shares[some, b] + dense[some] @ self.dense[b].T, 12)
        inside = np.flatnonzero(own >= 0)
        scores.reshape(len(own), -1)[inside, own[inside]] = 0

    def _best(self, scores: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        at = np.flatnonzero(scores >= max(least, 1e-12))
        rows, found = self.rows[at], scores[at]
        order = np.lexsort((rows, -found))[:k]
        return list(zip(found[order].tolist(), rows[order].tolist(), strict=True))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step curve nearest to y over x, as points to interpolate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        if pools and pools[-1][0] == a:
            pools[-1] = [a, (pools[-1][1] * pools[-1][2] + b * w) / (pools[-1][2] + w), pools[-1][2] + w, pools[-1][3]]
        else:
            pools.append([a, b, w, a])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            right, left = pools.pop(), pools.pop()
            w = left[2] + right[2]
            pools.append([right[0], (left[1] * left[2] + right[1] * right[2]) / w, w, left[3]])
    points = [(p[3], p[1]) for p in pools] + [(p[0], p[1]) for p in pools]
    points.sort()
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


class ToxicityModel:
    def __init__(self, terms: Terms, examples: list[tuple[object, int, Vector, Vector]], class_weight: tuple[float, float], k: int):
        """``examples``: id, label, plain and raised vector. ``class_weight``: labelled rows that an example of either class stands for."""
        bare = [(label, class_weight[label]) for _, label, v, _ in examples if not len(v[0])]
        total = sum(w for _, w in bare)
        self.bare = sum(label * w for label, w in bare) / total if total else 0.0
        self.terms, self.k = terms, k
        kept = sorted(((i, label, v, r) for i, label, v, r in examples if len(v[0])), key=lambda x: x[:2])
        self.ids, self.labels = [i for i, *_ in kept], np.array([label for _, label, *_ in kept], np.int64)
        self.weights = np.array([class_weight[label] for label in self.labels.tolist()])
        everyone = sum(class_weight[label] for _, label, *_ in examples)
        self.prior = sum(class_weight[label] for _, label, *_ in examples if label) / everyone if everyone else 0.0
        self.index = BlockMaxIndex([v for _, _, v, _ in kept], len(terms.number))
        # What factors add, row by row, to be read for neighbours only.
        self.ratio = np.array([r[1][0] for *_, r in kept])
        # Terms with a factor have numbers of their own, so that a text's are looked up in a short array.
        self.short = np.cumsum(terms.factor > 1) - 1
        self.raised = [(self.short[np.asarray(r[0][1:], np.int64)], np.asarray(r[1][1:], np.float64)) for *_, r in kept]
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        if kept:
            votes = []
            for first in range(0, len(kept), BATCH):
                some = kept[first : first + BATCH]
                near = self.index.nearest_many([v for _, _, v, _ in some], k, list(range(first, first + len(some))))
                votes += [self._vote(r, n) for (*_, r), n in zip(some, near, strict=True)]
            self.curve = isotonic(np.array(votes), self.labels.astype(float), self.weights)
        self._memo: dict[bytes, tuple[float, list]] = {}

    def _vote(self, raised: Vector, near: list[tuple[float, int]]) -> float:
        """The share of label 1 among the neighbours, each by the square of its cosine with factors."""
        least = 0.05 * float(self.weights.mean())
        rows = np.array([i for _, i in near], np.int64)
        if not len(rows):
            return self.prior
        mine = np.zeros(self.short[-1] + 1 if len(self.short) else 0)
        mine[self.short[raised[0][1:]]] = raised[1][1:]
        both = [mine[at] @ weights for at, weights in map(self.raised.__getitem__, rows.tolist())]
        close = np.array([s for s, _ in near]) * raised[1][0] * self.ratio[rows] + np.array(both)
        shares = np.round(close, 12) ** 2 * self.weights[rows]
        return (float(shares[self.labels[rows] == 1].sum()) + least * self.prior) / (float(shares.sum()) + least)

    def judge_many(self, texts: list[str | None]) -> list[tuple[float, list[tuple[object, float, int]]]]:
        """Of each text: the score, and the nearest three examples as (id, cosine, label). Equal texts are judged once."""
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self._memo) > _MEMO:
            self._memo.clear()
        new = {key: t for key, t in zip(keys, texts, strict=True) if key not in self._memo}
        todo = [(key, *self.terms.vectors(t)) for key, t in new.items()]
        search = [x for x in todo if len(x[1][0])] if self.ids else []
        near = dict(zip((key for key, _, _ in search), self.index.nearest_many([v for _, v, _ in search], self.k), strict=True)) if search else {}
        for key, _, raised in todo:
            own = near.get(key)
            score = float(np.interp(self._vote(raised, own), *self.curve)) if own else self.bare
            self._memo[key] = score, [(self.ids[i], s, int(self.labels[i])) for s, i in (own or [])[:3]]
        return [self._memo[key] for key in keys]

    def judge(self, text: str | None) -> tuple[float, list[tuple[object, float, int]]]:
        return self.judge_many([text])[0]


def label_factors(rows: Iterable[tuple[int, Iterable[str]]]) -> tuple[list[str], list[int], list[float]]:
    """All terms of the rows, the rows that have each, and its factor: 1 + chi2 / 5 by chi-square against the label, 1 where that is below 3.841.

    With one degree of freedom a term without a bearing on the label exceeds that once in twenty.
    """
    sizes, with_term = [0, 0], (Counter(), Counter())
    for label, terms in rows:
        sizes[label] += 1
        with_term[label].update(set(terms))
    zeros, ones = sizes
    terms = sorted(with_term[0].keys() | with_term[1].keys())
    held, factors = [], []
    for term in terms:
        a, b = with_term[1].get(term, 0), with_term[0].get(term, 0)
        c, d = ones - a, zeros - b
        held.append(a + b)
        chi2 = (zeros + ones) * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * (a + c) * (b + d))
        factors.append(1 + chi2 / 5 if chi2 >= 3.841 else 1.0)
    return terms, held, factors


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 4000, k: int = 50) -> ToxicityModel:
    """Learns from at most ``sample_rows`` labelled rows, half of each class, by hash of the id.

    An id with both labels counts as toxic, and of an id with several texts the smallest is learned from, once.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    sample = bounded_sample(known.where("_label = 0"), "_id", sample_rows // 2).unionByName(bounded_sample(known.where("_label = 1"), "_id", sample_rows // 2))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.groupBy("_id").agg(F.first("_label").alias("_label"), F.min("_text").alias("_text"))
    got = sorted((r["_id"], r["_label"], r["_text"]) for r in rows.collect())
    terms = Terms(*(lambda t, held, f: (t, len(got), held, f))(*label_factors((label, text_terms(text)) for _, label, text in got)))
    ones = sum(label for _, label, _ in got)
    weight = (sizes.get(0, 0) / max(1, len(got) - ones), sizes.get(1, 0) / max(1, ones))
    return ToxicityModel(terms, [(i, label, *terms.vectors(text)) for i, label, text in got], weight, k)


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``score`` (0 to 1) and ``evidence``, the nearest examples. Only the id and the text are read."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH):
            found = frozen.value.judge_many(batch.column(1).to_pylist())
            near = [[{"doc_id": i, "similarity": s, "label": label} for i, s, label in e] for _, e in found]
            evidence = pa.list_(pa.struct([("doc_id", batch.column(0).type), ("similarity", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(near, evidence)], ["doc_id", "score", "evidence"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},similarity:double,label:int>>")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = fold_rule("doc_id", 4, 2)
    model = fit_toxicity(docs, labels.where(~held))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
