"""The language and quality models worked out a second time by plain loops over small tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnfield.llm import langid, quality
from tarnfield.llm.textkit import fold_rule

SF = "/root/testdata/sf0.001"


def plain_language(train, texts):
    """(language, score) of each text: word frequencies first, then the longest known n-gram at each place."""
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {}
    for lang, text in train:
        counts.setdefault(lang, Counter()).update(words(text or ""))
    vocab = set().union(*counts.values())
    weights = {k: Counter() for k in counts}
    for lang, own in counts.items():
        for word, n in own.items():
            marked = f"^{word}$"
            for order in (1, 2, 3, 4):
                for j in range(len(marked) - order + 1):
                    weights[lang][marked[j : j + order]] += math.log1p(n)
    known = {order: {g for v in weights.values() for g in v if len(g) == order} for order in (1, 2, 3, 4)}
    sums = {(k, order): sum(n for g, n in weights[k].items() if len(g) == order) for k in counts for order in (1, 2, 3, 4)}

    def one(word, lang):
        if word in vocab:
            return math.log((counts[lang][word] + 0.05) / (counts[lang].total() + 0.05 * len(vocab)))
        marked, out, steps, at = f"^{word}$", 0.0, 0, 0
        while at < len(marked):
            order = next((o for o in (4, 3, 2, 1) if at + o <= len(marked) and marked[at : at + o] in known[o]), 0)
            if order:
                share = (weights[lang][marked[at : at + order]] + 0.05) / (sums[lang, order] + 0.05 * len(known[order]))
                out += math.log(share) - 2.0 * (4 - order)
            steps, at = steps + 1, at + max(1, order - 1)
        return out / steps

    found = []
    for text in texts:
        mine = words(text or "")
        if not mine:
            found.append(("und", 0.0))
            continue
        totals = {k: sum(one(w, k) for w in mine) for k in sorted(counts)}
        best = max(totals, key=totals.get)
        found.append((best, 1 / sum(math.exp((v - totals[best]) / math.sqrt(len(mine))) for v in totals.values())))
    return found


def test_language_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate((None, "", "12 34", "zzqx ŵŵŵ word", "日本 xyzzyx"))], docs.schema)
    docs = docs.unionByName(extra)
    rows = docs.withColumn("held", fold_rule("doc_id", 3, 1)).collect()
    want = plain_language([(r.lang, r.text) for r in rows if not r.held and r.lang is not None], [r.text for r in rows])
    got = {r.doc_id: r for r in langid.language_query(docs).collect()}
    assert len(got) == len(rows)
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id].lang_pred == lang, (r.doc_id, lang)
        assert got[r.doc_id].score == pytest.approx(score, abs=2e-4)


def plain_nbsvm(rows, labels, cost=0.1, epochs=12, seed=3, blend=0.9):
    """Margins of the examples: ratios of smoothed shares, then single steps on the dual, one coordinate at a time."""
    n = [sum(1 for y in labels if y == k) for k in (0, 1)]
    seen = [Counter(f for r, y in zip(rows, labels, strict=True) if y == k for f in r) for k in (0, 1)]
    ratio = lambda f: math.log((seen[1][f] + 1) / (n[1] + 2)) - math.log((seen[0][f] + 1) / (n[0] + 2))
    values = [{f: ratio(f) / math.sqrt(len(r)) for f in r} for r in rows]
    weights, bias, alpha = Counter(), 0.0, [0.0] * len(rows)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            sign = 1 if labels[i] else -1
            slope = sign * (sum(weights[f] * v for f, v in values[i].items()) + bias) - 1
            cap = cost * len(rows) / (2 * n[labels[i]])
            new = min(max(alpha[i] - slope / (sum(v * v for v in values[i].values()) + 1), 0.0), cap)
            for f, v in values[i].items():
                weights[f] += (new - alpha[i]) * sign * v
            bias += (new - alpha[i]) * sign
            alpha[i] = new
    used = [abs(w) for w in weights.values() if w]
    mean = sum(used) / len(used)
    return [sum(((1 - blend) * mean + blend * weights[f]) * v for f, v in own.items()) + bias for own in values]


def test_quality_fit_against_plain_loops():
    rng = np.random.default_rng(5)
    labels = [int(x) for x in rng.integers(0, 2, 60)]
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12)) + (25 if y else 0)).astype(np.int32) for y in labels]
    model = quality.fit_nbsvm(rows, np.array(labels))
    want = plain_nbsvm([r.tolist() for r in rows], labels)
    got = [float(model.weights[r].sum(dtype=np.float64) / math.sqrt(len(r)) + model.bias) for r in rows]
    assert got == pytest.approx(want, abs=1e-5)
    assert all((a > b) == (c > d) for a, b, c, d in zip(got, got[1:], model.score(np.array(got)), model.score(np.array(got))[1:], strict=False))


def plain_features(text):
    """The indicators of a text by name: words, their shapes, whether a word repeats the one before it, and the size."""
    words = [w.lower() for w in re.split(rb"[\x09-\x0d\x20]+", text.encode()) if w]
    shapes = []
    for raw in (w for w in re.split(rb"[\x09-\x0d\x20]+", text.encode()) if w):
        classes = [int(quality._SHAPES[b]) for b in raw]
        shapes.append(tuple(c for i, c in enumerate(classes) if i == 0 or c != classes[i - 1]))
    same = [i > 0 and w == words[i - 1] for i, w in enumerate(words)]
    grams = lambda name, x, k: {(name, *x[i : i + k]) for i in range(len(x) - k + 1)}
    out = grams("w1", words, 1) | grams("w2", words, 2) | grams("s1", shapes, 1) | grams("s2", shapes, 2) | grams("s3", shapes, 3) | grams("same", same, 3)
    return out | {("size", len(words).bit_length())}


TEXTS = ["", "one", "One two  two\tthree", "three three one", "a1 b2 c3 C3", "x", "x y z x y z", "Zoë naïve café", "two two two two", "one\n\ntwo, three. FOUR", "three"]


def test_quality_features_against_plain_sets():
    got = [set(x.tolist()) for x in quality.indicator_rows(pa.array(TEXTS))]
    want = [plain_features(t) for t in TEXTS]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(TEXTS)):
        assert [len(got[i] & x) for x in got] == [len(want[i] & x) for x in want], TEXTS[i]


def test_quality_features_do_not_depend_on_the_text_before():
    alone = [set(next(iter(quality.indicator_rows(pa.array([t])))).tolist()) for t in TEXTS]
    for order in (TEXTS, TEXTS[::-1], [t for t in TEXTS for _ in (0, 1)]):
        together = [set(x.tolist()) for x in quality.indicator_rows(pa.array(order))]
        assert together == [alone[TEXTS.index(t)] for t in order]
