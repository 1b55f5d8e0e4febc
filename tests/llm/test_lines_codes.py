"""Line dedup, fill-in-middle and vector codes against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfield.llm import codes, fim, linededup

SPACES = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_by_hand(rows, min_docs, min_chars):
    held = collections.defaultdict(set)
    key = lambda line: line.strip(SPACES).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    rnd = random.Random(batches)
    lines = [" Some LineÉ of words ", "some lineÉ of words", "SOME LINEé of words\r", "short", "", "  ", "the common line of the hot source", "x" * 300] + [f"line number {i}" for i in range(30)]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    rows += [(200 + i, "the common line of the hot source\n\x0bthe COMMON line of the hot source") for i in range(40)]
    rows += [(7, rows[3][1]), rows[5], rows[5], (None, rows[2][1]), (None, None), (300, None), (301, ""), (302, "\n"), (303, "long " * 20_000 + "\n" + "the common line of the hot source")]
    frame = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n_lines int, gone string, ROW int")
    got = linededup.dedup_lines(frame, min_docs=3, min_chars=8, batches=batches, fanout=fanout)
    assert got.columns == [*frame.columns, "_n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.text, r._n_lines, r.n_dropped) for r in got.collect()), key=repr)
    assert found == sorted(dedup_by_hand(rows, 3, 8), key=repr)
    assert any(r[3] for r in found)


def test_line_dedup_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(frame).count() == 0
    assert linededup.line_digest(frame).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_runs_are_disjoint_sorted_levels_and_merge_without_a_shuffle(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path), fanout=2, buckets=3)
    rnd, want = random.Random(1), collections.Counter()
    for batch in range(7):
        own = rnd.sample(range(50), 20)
        want.update(own)
        runs.add(spark.createDataFrame([(h, -h, 1, batch) for h in own], "h1 long, h2 long, docs long, last long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    held = [r.h1 for name in runs.runs() for r in spark.table(name).collect()]
    assert sorted(held) == sorted(want)
    assert {r.h1: r.docs for r in runs.totals().collect()} == want
    plan = runs._without(spark.table(runs.runs()[0]), runs.runs()[1])._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()
    assert not [p for p in tmp_path.iterdir() if any(p.iterdir())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60, unique=True))
def test_elias_fano_reads_every_number(values):
    values = sorted(values)
    packed = fim.EliasFano.of(np.array(values))
    assert [packed.select(i) for i in range(len(values))] == values
    assert len(packed.high) + len(packed.low) <= 2 + len(values) * (2 + max(0, math.log2(max(1, values[-1] / len(values))))) / 4


def cut_by_hand(i, text, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text):
        return i, len(units), "plain", text or "", None, None
    if h4 % 100 < 50:
        return i, len(units), "spm", f"<S>{z}<P>{x}<M>{y}", len(x), len(y)
    return i, len(units), "psm", f"<P>{x}<S>{z}<M>{y}", len(x), len(y)


@pytest.mark.parametrize("bits", [8, 1 << 20])
def test_fill_in_middle_equals_brute_force(spark, bits):
    rnd = random.Random(5)
    line = lambda: "".join(rnd.choice("ab é\U0001f600<>PSM") for _ in range(rnd.randint(0, 9)))
    texts = ["\n".join(line() for _ in range(rnd.randint(0, 20))) for _ in range(80)]
    texts += ["hot\ntext\nénd"] * 60 + [None, "", "\n", "\n\n\n", "no end", "one <M> mark", "a\r\nb c", "y" * 100_000 + "\n" + "z" * 50, *(["two\ncopies"] * 2)]
    rows = [*enumerate(texts), (3, texts[9]), (None, "null\nid"), (None, None), (4, texts[4])]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, form string, H1 int")
    got = fim.fill_in_middle(frame, bitmap_bits=bits)
    found = [(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in got.collect()]
    assert sorted(found, key=repr) == sorted((cut_by_hand(*r) for r in rows), key=repr)
    assert {f for _, _, f, _, _, _ in found} == {"plain", "spm", "psm"}
    assert sorted(fim.restore(o, f) for _, _, f, o, _, _ in found) == sorted(t or "" for _, t in rows)
    assert sorted(r.restored for r in fim.restored(got).collect()) == sorted(t or "" for _, t in rows)


def test_fill_in_middle_rates_and_no_rows(spark):
    frame = spark.createDataFrame([(i, "a\nb\nc") for i in range(300)], "doc_id long, text string")
    forms = collections.Counter(r.form for r in fim.fill_in_middle(frame, rate=40, spm=100).collect())
    assert set(forms) == {"plain", "spm"} and 80 < forms["spm"] < 160
    assert fim.middle_digest(fim.fill_in_middle(frame.limit(0))).count() == 0


def lloyd_by_hand(rows, parts, entries, rounds):
    size = collections.Counter()
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v, lab in kept:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), lab])
        size[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, c, e, size[lab], digest) for i, c, e, lab in out]


@pytest.mark.parametrize("scale", [0.02, 1.0, 3e5])
def test_vector_codes_equal_brute_force(spark, scale):
    rnd = random.Random(3)
    # Few values, so that distances tie; with clusters, so that whole nodes are assigned.
    centres = [[rnd.choice([-2.0, 0.0, 3.0]) for _ in range(8)] for _ in range(6)]
    rows = [(i, [scale * (c + rnd.choice([-0.01, 0.0, 0.003])) for c in rnd.choice(centres)], rnd.choice([None, 1, 2, 2, 2])) for i in range(400)]
    rows += [(401, None, 1), (402, [], 1), (403, [1.0] * 7, 1), (404, [1.0] * 4, 2), (405, [1.0, None] * 4, 1), (406, [float("nan")] * 8, 1), (407, [float("inf")] * 8, None), (5, [0.25] * 8, 9), (None, [scale] * 8, 2), rows[9]]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, code string, ID int")
    coded, books = codes.compress_vectors(frame, entries=16)
    sums = collections.Counter()
    for r in coded.collect():
        sums[r.label] += r.error
    found = [(r.id, r.code, r.error, sums[r.label], codes.books_digest(books)) for r in coded.collect()]
    assert sorted(found, key=repr) == sorted(lloyd_by_hand(rows, 4, 16, 4), key=repr)
    if scale == 1.0:
        assert sorted(map(tuple, codes.codes_query(frame).collect()), key=repr) == sorted(lloyd_by_hand(rows, 4, 256, 4), key=repr)


def test_boxes_assign_whole_subtrees_and_points_of_either_kind_alike():
    rnd = np.random.default_rng(1)
    points = np.concatenate([rnd.integers(-5, 5, (500, 4)) + c for c in (-900, 0, 900)]).astype(np.int32)
    book = np.array([[-900] * 4, [0] * 4, [0] * 4, [900] * 4, [901] * 4], object)
    tree = codes.KdTree(points)
    whole = sum(int(tree.bounds[level][a + 1] - tree.bounds[level][a]) for _, level, a, _ in tree.filtered(book) if level >= 0)
    assert whole > 900
    brute = ((points[:, None, :].astype(np.int64) - book[None].astype(np.int64)) ** 2).sum(2).argmin(1)
    assert tree.assign(book).tolist() == brute.tolist()
    huge = codes.KdTree(points.astype(object) * 10**12)
    assert huge.assign(book * 10**12).tolist() == brute.tolist()


def test_vector_codes_of_nothing_and_of_giants(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.codes_query(frame).count() == 0
    giants = spark.createDataFrame([(i, [1e300 * (i % 3), 0.0, 1.0, 2.0], 1) for i in range(20)], "vec_id long, embedding array<double>, label int")
    assert {r.error for r in codes.codes_query(giants).collect()} == {0}
