import itertools
import random
import tracemalloc

import pytest

from tarnfield.llm import pieces
from tarnfield.llm.pieces import PieceModel, apply_changes


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(pieces.public_model_path())


def every_segmentation(model, text):
    if not text:
        yield 0, ()
        return
    node, single = model.tree, False
    for j, c in enumerate(text):
        found = node.get(c)
        if found is None:
            break
        node, cost, piece = found
        if piece >= 0:
            single = single or j == 0
            for rest, ids in every_segmentation(model, text[j + 1 :]):
                yield cost + rest, (piece, *ids)
    if not single:
        spelt = (" " if text[0] == "▁" else text[0]).encode()
        for rest, ids in every_segmentation(model, text[1:]):
            yield 14_000_000 * len(spelt) + rest, (*(model.byte_ids[b] for b in spelt), *ids)


@pytest.mark.parametrize("word", ["hello", " the", "thntt", "é日x", "aaaaaaa", " ingly", "  ", "², x"])
def test_segment_search_equals_full_enumeration(model, word):
    expected = sorted(every_segmentation(model, word.replace(" ", "▁")))
    got = model.segment_best(word, 6)
    assert [c for c, _ in got] == [c for c, _ in expected[:6]]
    assert set(got) <= set(expected)
    ids, cost, loss = model._first(word)
    assert cost == got[0][0]
    assert loss == (got[1][0] - cost if len(got) > 1 else float("inf"))


def test_text_search_equals_full_product(model):
    text = "the in on"
    parts = [list(every_segmentation(model, s.replace(" ", "▁"))) for s in model.segments(text)]
    expected = sorted(sum(c for c, _ in x) for x in itertools.product(*parts))[:7]
    assert [c for c, _ in model.encode(text, 7)[1]] == expected


def test_round_trip_of_all_choices(model):
    rnd = random.Random(4)
    signs = "ab ▁\n\t é日😀.,#0²_\x00ABthe"
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        ids, choices = model.encode(text, 4)
        costs = [c for c, _ in choices]
        assert costs == sorted(costs)
        seen = set()
        for _, change in choices:
            full = apply_changes(ids.tolist(), change)
            assert model.decode(full) == text
            seen.add(tuple(full))
        assert len(seen) == len(choices)


def test_every_piece_lies_in_one_segment(model):
    model.tree  # noqa: B018
    for i, piece in enumerate(model.pieces):
        if model.usable[i] and not model.is_byte[i]:
            assert model._segment.fullmatch(piece.replace("▁", " "))


def test_long_word_with_many_ties(model):
    assert len(model.segment_best("a" * 20000, 3)) == 3


def test_rows(spark, model):
    rows = [(1, "The the", "x"), (2, None, "y"), (3, "", "z"), (1, "The the", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_pieces, tuple(r.ids), r.round_trip, len(r.best)) for r in pieces.encode_texts(docs, model).collect()}
    assert {(2, 0, (), True, 1), (3, 0, (), True, 1)} < got
    assert len(got) == 3
    assert pieces.encode_texts(docs.limit(0), model).count() == 0
    back = pieces.decode_ids(pieces.encode_texts(docs, model).select("doc_id", "ids"), model)
    assert {r.text for r in back.collect()} == {"The the", ""}


def test_remembered_segments_are_small(model):
    """Both generations of remembered segments, when full, take a small part of a task's memory."""
    fresh = PieceModel(model.pieces, model.is_byte, model.usable)
    assert fresh.encode("the")[0].tolist() == model.encode("the")[0].tolist()
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("aeinorst") for _ in range(9)) for _ in range(20_000))
    tracemalloc.start()
    fresh.encode(text, 1)
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(fresh._memo) > 19_000
    assert 2 * pieces._MEMO * grown / len(fresh._memo) < 120e6
