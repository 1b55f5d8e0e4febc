import json

import pytest
from pyspark.sql import functions as F

from tarnfield.functions import text as T


def one(spark, column, *values):
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in frame.select(column(F.col("x"))).collect()]


def test_round6_is_half_up_on_the_binary_value(spark):
    row = spark.range(1).select(T.round6(F.lit(0.38095249999999997)).alias("a"), T.round6(F.lit(1 / 3)).alias("b"), T.round6(F.lit(1.0)).alias("c")).first()
    assert tuple(row) == (0.380953, 0.333333, 1.0)


def test_tokens(spark):
    got = one(spark, lambda x: T.tokens(x, normalized=False), "Café USEState42 인증 인증", "Cafe\u0301", "", "--")
    assert got == [["café", "usestate42", "인증", "인증"], ["café"], [], []]


def test_hangul_grams(spark):
    words = lambda x: T.tokens(x)
    assert one(spark, lambda x: T.hangul_grams(words(x), 2), "한글검색", "한글 검색", "한a글", "abc") == [["검색", "글검", "한글"], ["검색", "한글"], [], []]
    assert one(spark, lambda x: T.hangul_grams(words(x), 3), "한글검색", "한글") == [["글검색", "한글검"], []]


def test_jamo_clusters(spark):
    assert T.hangul_clusters("한글검") == [["한", "글", "검"]]
    assert T.hangul_clusters("\u1112\u1161\u11ab\u1100\u1173\u11af") == [["\u1112\u1161\u11ab", "\u1100\u1173\u11af"]]
    assert T.hangul_clusters("한a글") == [["한"], ["글"]]
    assert one(spark, lambda x: T.jamo_grams(F.array(x), 2), "한글검색") == [["검색", "글검", "한글"]]


def test_utf16(spark):
    assert one(spark, T.utf16_length, "😀a", "한", "") == [3, 1, 0]
    assert one(spark, lambda x: T.utf16_head(x, 2), "a😀b", "abc", "a") == ["a\ufffd", "ab", "a"]


def test_bodies(spark):
    assert one(spark, T.plain_body, "a\r\nb\r\n\n", " \n\t", None) == ["a\nb", None, None]
    frame = spark.createDataFrame([("x" * 12,), ("y" * 9 + "\n\nzz",), ("ok",), ("",)], "x string")
    got = [tuple(r[0]) for r in frame.select(T.bounded_body(F.col("x"), 10)).collect()]
    assert got == [("x" * 10, True, 12, True), ("y" * 9, True, 13, False), ("ok", False, 2, True), (None, None, None, None)] or got[:3] == [("x" * 10, True, 12, True), ("y" * 9, True, 13, False), ("ok", False, 2, True)]


@pytest.mark.parametrize(("value", "expected"), [
    ("2024-02-29T10:00:00Z", "2024-02-29T10:00:00.000Z"), ("2023-02-29T10:00:00Z", None), ("2024-01-01T00:30:00.12345+01:00", "2023-12-31T23:30:00.123Z"), ("2024-01-01T24:00:00Z", None),
    ("2024-01-01T00:00:00+14:00", "2023-12-31T10:00:00.000Z"), ("2024-01-01T00:00:00+14:01", None), ("2024-01-01 00:00:00Z", None), ("2024-01-01T00:00:00", None), ("", None), (None, None),
])
def test_instants(spark, value, expected):
    assert one(spark, T.instant, value) == [expected]


def test_entropy(spark):
    assert one(spark, T.shannon_entropy, "aaaa", "abab", "abcdefghijklmnopqrstuvwxyz01") == [0.0, 1.0, pytest.approx(4.807355, abs=1e-6)]


def test_safe_text_and_references(spark):
    assert one(spark, lambda x: T.safe_text(x, 5), "ok", "", "toolong", "a\x07", None, "a\nb") == [True, False, False, False, False, False]
    assert one(spark, lambda x: T.safe_text(x, 5, lines=True), "a\nb") == [True]
    assert one(spark, T.safe_reference, "a/b.md", "/a", "a//b", "../a", "C:\\x", "http://x") == [True, False, False, False, False, False]
    assert one(spark, T.page_id_like, "a-b/c1", "a", "A/b", "a/b\n", None) == [True, False, False, False, False]


def test_json_and_percent(spark):
    assert one(spark, T.canonical_json, '{"b": [2, 1], "a": "é"}', "{", "NaN") == ['{"a":"é","b":[2,1]}', None, None]
    assert one(spark, lambda x: T.canonical_json(x, 2), '{"b":1}') == [json.dumps({"b": 1}, indent=2) + "\n"]
    assert one(spark, T.percent_encoded, "a b/~é()") == ["a%20b%2F~%C3%A9()"]


def test_rendering(spark):
    frame = spark.createDataFrame([(["x", "y"], {"b": "2", "a": "1"})], "l array<string>, m map<string,string>")
    row = frame.select(T.bullets(F.col("l")), T.record_line(F.col("m")), T.document_text(F.lit("T"), T.section("S", F.lit("b")), T.section("E", F.lit("")))).first()
    assert tuple(row) == ("- x\n- y", "a: 1; b: 2", "# T\n\n## S\n\nb")


def test_code_unit_order(spark):
    rows = ["￿", "\U0001f600", "a", "", "", "ab"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rows], "x string").orderBy(T.code_unit_order(F.col("x"))).collect()]
    assert got == sorted(rows, key=lambda x: x.encode("utf-16-be"))
