import hashlib
import json

from pyspark.sql import functions as F

from tarnfield.functions.text import canonical_digest


def test_order_does_not_count(spark):
    value = {"b": [3, 1, [2, {"y": None, "x": [True, False]}], "é"], "a": {"z": [], "k": {}}, "n": 1.0}
    same = '{"n": 1, "a": {"k": {}, "z": []}, "b": ["é", [{"x": [false, true], "y": null}, 2], 1, 3]}'
    texts = [json.dumps(value), same, json.dumps(value | {"n": 2}), json.dumps(value | {"b": value["b"] * 2}), "[]", '["\U0001f600", "～"]', '["～", "\U0001f600"]', "{", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = [r.d for r in frame.select("n", canonical_digest(F.col("t")).alias("d")).orderBy("n").collect()]
    assert got[0] == got[1] and len({got[0], got[2], got[3], got[4]}) == 4
    text = '{\n  "a": {\n    "k": {},\n    "z": []\n  },\n  "b": [\n    "é",\n    1,\n    3,\n    [\n      2,\n      {\n        "x": [\n          false,\n          true\n        ],\n        "y": null\n      }\n    ]\n  ],\n  "n": 1\n}\n'
    assert got[0] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    # Astral characters come before the last of the basic plane, as by UTF-16 units.
    assert got[5] == got[6] == "sha256:" + hashlib.sha256('[\n  "\U0001f600",\n  "～"\n]\n'.encode()).hexdigest()
    assert got[7:] == [None, None, None]


def test_only_digests_leave_the_batch(spark):
    """The rendered text is hashed where it is made: no SHA-256 after the batch, which would need all its texts."""
    frame = spark.createDataFrame([('{"a": [2, 1]}',)], "t string").select(canonical_digest(F.col("t")).alias("d"))
    assert "sha2" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert frame.first().d == "sha256:" + hashlib.sha256(b'{\n  "a": [\n    1,\n    2\n  ]\n}\n').hexdigest()
