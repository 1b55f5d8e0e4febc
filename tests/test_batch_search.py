import random
import re

import pytest

from tarnfield.operators import lexical


def test_batch_search_equals_brute_force(spark):
    rnd = random.Random(4)
    common, rare = ["the", "of", "and", "to", "in"], [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.sample(common, rnd.randint(0, 5)) + rnd.choices(rare, k=n))
    pages = [(i, text(rnd.randint(0, 12))) for i in range(300)] + [(500, None), (501, ""), (502, pages_text := text(9)), (503, pages_text)]
    queries = [(i, text(rnd.randint(0, 8))) for i in range(60)] + [(100, None), (101, "nowhere found"), (102, "the"), (103, pages_text), (104, "the the of nowhere")]
    frame, asked = spark.createDataFrame(pages, "page_id long, text string"), spark.createDataFrame(queries, "query_id long, query_text string")
    for limit in (1, 5, 1000):
        want = set()
        for q, query in queries:
            words = set((query or "").split())
            scored = [(len(words & set((t or "").split())), p) for p, t in pages]
            best = sorted(((-m, p) for m, p in scored if m), key=lambda x: x)[:limit]
            want |= {(q, p, -m, i + 1) for i, (m, p) in enumerate(best)}
        got = {(r.query_id, r.page_id, r.matches, r["rank"]) for r in lexical.batch_search(frame, asked, limit=limit).collect()}
        assert got == want


def test_batch_search_splits_what_a_task_reads_and_sums_repeated_pages(spark):
    """A task counts and ranks the pairs of a sixteenth of what a task of the input reads."""
    frame = spark.createDataFrame([(i, f"the w{i % 7}") for i in range(200)] + [(3, "the w3 of")], "page_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "the of")], "query_id long, query_text string")
    found = lexical.batch_search(frame, asked, limit=2)
    assert [(r.page_id, r.matches, r["rank"]) for r in found.orderBy("rank").collect()] == [(3, 3, 1), (0, 1, 2)]
    parts = lexical.PARTS * 3
    assert re.search(rf"hashpartitioning\(page_id#\d+L?, {parts}\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("most", [0, 1, 100])
def test_posting_sizes_count_repeated_pages_once(spark, most, monkeypatch):
    """No distinct count unless ids repeat; equal whether repeated ids are told apart, are too many, or lie in other rows."""
    rows = [(1, "a b"), (1, "b c"), (2, "a"), (3, None), (None, "a z"), (4, "c"), (4, "c"), (5, "c")]
    want = {("a", 2, 1, 2), ("b", 1, 1, 1), ("c", 3, 1, 5), ("z", 0, None, None)}
    monkeypatch.setattr(lexical, "MAX_REPEATED", most)
    frame = spark.createDataFrame(rows, "page_id long, text string")
    sizes = lexical.posting_sizes(frame, fields=("text",))
    assert {(r.feature, r.n_pages, r.first_page, r.last_page) for r in sizes.collect()} == want
    alone = lexical.posting_sizes(frame.where("page_id in (2, 3, 5)"), fields=("text",))
    assert not re.search(r"keys=\[[^]]*page_id", alone._jdf.queryExecution().executedPlan().toString())
