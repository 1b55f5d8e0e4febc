import collections
import random
import re

import pyarrow as pa

from tarnfield.llm import decontaminate
from tarnfield.llm.decontaminate import WindowSearch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))


def brute(texts, items, size):
    windows = collections.defaultdict(set)
    for key, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i : i + size])].add(key)
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for n in set(map(len, windows)):
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        yield len(words), len(hit), sorted(found)


def test_search_equals_brute_force():
    rnd = random.Random(2)
    vocabulary = ["a", "the", "Of", "é", "x1", "wörter", "dog", "B"]
    text = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(rnd.choice([1, 2, 3, 6, 12, 30]))) for i in range(40)] + [("e", ""), ("n", None), ("p", "...")]
    texts = [text(rnd.randint(0, 80)) for _ in range(200)] + ["", None, "x" * 5000, " ".join(items[5][1] for _ in range(50)), *(t for _, t in items)]
    for size in (3, 10):
        search = WindowSearch(items, size)
        got = [(n, sum(b - a for a, b in spans), found) for n, spans, found in search.hits(pa.array(texts, pa.string()))]
        assert got == list(brute(texts, items, size))


def test_blocks_of_the_benchmark_give_the_same(spark):
    items = [(i, f"alpha beta {i} gamma delta epsilon zeta eta theta iota kappa {i}") for i in range(30)]
    docs = [(i, f"start alpha beta {i} gamma delta epsilon zeta eta theta iota kappa {i} end", 3) for i in range(0, 60, 3)] + [(100, None, 1), (100, None, 1), (101, "", 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans int")
    bench = spark.createDataFrame([*items, (None, "alpha"), (99, None)], "item_id long, text string")
    one = decontaminate.contamination_digest(decontaminate.find_contamination(frame, bench)).collect()
    many = decontaminate.contamination_digest(decontaminate.find_contamination(frame, bench, block_bytes=300)).collect()
    assert sorted(one) == sorted(many)
    assert sum(r.contaminated for r in one) == 10
    kept = decontaminate.drop_contaminated(frame, bench, block_bytes=300)
    assert kept.columns == frame.columns
    assert kept.count() == len(docs) - 10
    assert decontaminate.find_contamination(frame, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.find_contamination(frame.limit(0), bench).count() == 0
