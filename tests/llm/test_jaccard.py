import collections
import random
import re

import duckdb
import pyarrow as pa
import pytest

from tarnfield.llm import jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = {}
    for key, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
        sets[key] = frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def sample(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(5):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 150))]
        for _ in range(rnd.choice([1, 3, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                words += passage
            if rnd.random() < 0.1:
                words = passage + words[: rnd.randint(0, 20)]
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows + [(2000 + i, t) for i, t in enumerate(("", None, "A", "a", "a b", "A  B", "a b c", "A\tb\nC"))]


@pytest.mark.parametrize(("seed", "size", "percent"), [(0, 3, 90), (1, 5, 80)])
def test_components_equal_brute_force(spark, seed, size, percent):
    rows = sample(seed)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, n string, k1 int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (7, None), (7, None), (None, "a b c d"), (9, "x y z")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 9)]
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.keep_first(docs).collect())
    assert kept == {(3, "a b c d"): 1, (7, None): 1, (None, "a b c d"): 1, (9, "x y z"): 1}


def test_an_id_with_several_texts_is_one_node(spark):
    rows = [(5, "a b c d e"), (5, "p q r s t"), (3, "p q r s t"), (9, "a b c d e"), (9, ""), (11, ""), (4, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect())
    expected = [(3, 3, 3), (4, 1, 4), (5, 3, 3), (5, 3, 3), (9, 0, 3), (9, 3, 3), (11, 0, 11)]
    assert got == expected
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(con.sql(queries.OP7_SQL).fetchall()) == expected


def test_clashing_names_and_repeated_rows_keep_one_row(spark):
    rows = [(5, "a b c d", 1, 1, 1, 1), (5, "a b c d", 2, 2, 2, 2), (7, "a b c d", 3, 3, 3, 3), (8, "q r s", 4, 4, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, id int, again int, `row` int, component_id int")
    kept = [jaccard.keep_first(part).collect() for part in (docs, docs.repartition(5, "again"))]
    assert kept[0][0].asDict().keys() == {"doc_id", "text", "id", "again", "row", "component_id"}
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    assert sorted(r.doc_id for r in kept[0]) == [5, 8]


def test_a_passage_in_many_unlike_documents_makes_no_pairs(spark):
    """Rare shingles come first, so a passage of 60 words in 300 documents is in no document's first entries."""
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rnd.randrange(10**6)}" for _ in range(60)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, size=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)
    keyed = docs.mapInArrow(jaccard._keys(5), "doc_id long, k1 long, k2 long, n long")
    assert jaccard.linkable_ids(docs, keyed.groupBy().sum("n").first()[0], 5, 80).count() == 0


def test_copies_of_one_text_with_edits_of_their_own(spark):
    """Each is near the original, most pairs are not near each other: the star finds the group through the original."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        words = list(base)
        for at in rnd.sample(range(0, 200, 7), 4):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, size=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)


def test_small_groups_are_linked_by_the_product(spark, monkeypatch):
    """With the product off, groups of a few near copies fall apart: no other step finds them."""
    rnd = random.Random(9)
    rows = []
    for group in range(20):
        base = [f"g{group}w{i}" for i in range(150)]
        for copy in range(rnd.randint(2, 6)):
            words = list(base)
            words[rnd.randrange(150)] = f"own{group}x{copy}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, size=5, percent=80).collect()} == want
    assert len({c for _, c in want.values()}) == 20
    whole = jaccard.product_pairs
    monkeypatch.setattr(jaccard, "product_pairs", lambda entries, percent: whole(entries.limit(0), percent))
    assert len({r.component_id for r in jaccard.jaccard_classes(docs, size=5, percent=80).collect()}) == len(rows)
