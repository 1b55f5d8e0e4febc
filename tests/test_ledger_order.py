import random

from pyspark.sql import functions as F

from tarnfield.operators import history, ordering
from tarnfield.sources import artifacts


def by_hand(rows, keyed):
    last, out = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (str(r[0]) if keyed else "", r[1])):
        n, before = last.get(k if keyed else 0, (0, None))
        last[k if keyed else 0] = n + 1, v
        out[o] = n + 1, before
    return out


def test_ranges_hand_over_numbers_and_values(spark):
    rnd = random.Random(1)
    # One key holds a third of the rows and so spans several ranges; some keys have one row.
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}", i * 3, f"v{i}") for i in range(2000)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, o long, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in (None, ["k"]):
            found = ordering.sequenced(frame.repartition(7), ["o"], "v", keys)
            plan = found._jdf.queryExecution().toString()
            assert "SinglePartition" not in plan
            assert {r.o: (r.place, r.before) for r in found.collect()} == by_hand(rows, keys)
            assert found.columns == ["k", "o", "v", "place", "before"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordering.sequenced(frame.limit(0), ["o"], "v").count() == 0


def test_chain_without_a_scope(spark):
    lines = [f"line {i}" for i in range(300)]
    digest = lambda x: spark.sql(f"select sha2('{x}', 256)").first()[0]
    frame = spark.range(300).select((F.col("id") + 1).alias("seq"), F.concat(F.lit("line "), "id").alias("line")).withColumn("prev_sha256", F.when(F.col("seq") > 1, F.sha2(F.concat(F.lit("line "), F.col("seq") - 2), 256)))
    assert history.chain_check(frame).where("not chain_ok").count() == 0
    changed = frame.withColumn("line", F.when(F.col("seq") == 100, F.lit("other")).otherwise(F.col("line")))
    assert [r.seq for r in history.chain_check(changed).where("not chain_ok").collect()] == [101]
    gap = frame.where("seq <> 200")
    assert history.chain_check(gap).where("chain_ok").count() == 199
    twice = frame.unionByName(frame.where("seq = 50"))
    assert min(r.seq for r in history.chain_check(twice).where("not chain_ok").collect()) == 50
    assert len(lines) == 300 and digest("line 0") == frame.where("seq = 2").first().prev_sha256


def test_references_to_any_earlier_row(spark):
    kind = {"a": "gate.what.approved", "r": "gate.what.revoked", "+": "scope.added", "-": "scope.removed", "n": "note"}
    rows = [(1, "x", "a", None), (2, "y", "a", None), (3, "x", "+", 1), (4, "x", "r", 1), (5, "x", "r", 3), (6, "x", "a", 4), (7, "y", "-", 3), (8, "y", "-", 9), (9, "y", "-", 77), (10, "y", "n", 1), (11, "y", "r", 9), (12, None, "r", 2), (13, "x", "a", 13)]
    frame = spark.createDataFrame([(s, x, kind[k], b) for s, x, k, b in rows], "seq long, scope_ref string, type string, prev_seq long")
    got = {r.seq: r.reference for r in history.references(frame).collect()}
    assert got == {1: "none", 2: "none", 3: "ok", 4: "superseded", 5: "superseded", 6: "inactive", 7: "other-scope", 8: "not-earlier", 9: "missing", 10: "ok", 11: "ok", 12: "other-scope", 13: "not-earlier"}
    assert history.references(frame.limit(0)).count() == 0


def test_registry_rows_out_of_order(spark):
    registry = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "b"), (4, "d")], "at int, project_id string")
    assert sorted(r["at"] for r in artifacts.unsorted_rows(registry, "at").collect()) == [2, 3]
