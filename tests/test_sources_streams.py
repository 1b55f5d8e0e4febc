import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnfield.sources import artifacts
from tarnfield.streaming import jobs


@pytest.fixture
def tree(tmp_path):
    files = {"a.json": b'{"x": 1}', "sub/run-1.json": b"{}", "sub/run-1.orchestration.json": b"{}", "run-index.json": b"{}", "sub/deep/run-2.json": b"{}", "notes.md": b"---\nk: v\n---\n\nbody\n", "bad.json": b"\xff\xfe", "big.bin": b"x" * 2000}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path), files


def test_artifact_files(spark, tree):
    root, files = tree
    rows = artifacts.artifact_files(spark, root)
    got = {r.path: (bytes(r.content), r.length, r.revision) for r in rows.collect()}
    assert got == {k: (v, len(v), "sha256:" + hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert {r.path for r in artifacts.artifact_files(spark, root, "*.md").collect()} == {"notes.md"}
    assert {r.path for r in artifacts.bounded_files(rows, 1000).collect()} == files.keys() - {"big.bin"}
    assert {r.path for r in artifacts.with_extension(rows, "md", "bin").collect()} == {"notes.md", "big.bin"}
    assert {r.path for r in artifacts.run_files(rows).collect()} == {"sub/run-1.json"}
    texts = {r.path: r.t for r in rows.select("path", artifacts.utf8(F.col("content")).alias("t")).collect()}
    assert texts["bad.json"] is None
    assert texts["a.json"] == '{"x": 1}'


@pytest.mark.parametrize(("text", "problem"), [
    ('{"a": [1, 2.5e3, "x\\"]"]}', None), ("\ufeff{}", "byte-order-mark"), (None, "not-utf8"), ("[" * 65 + "]" * 65, "too-deep"), ("[" * 64 + "]" * 64, None), ('"' + "[" * 70 + '"', None),
    ('{"a": 1, "a": 2}', "syntax"), ("NaN", "syntax"), ("1e999", "syntax"), ("{", "syntax"), ("[[],[],[]]" , None), ('"\\\\" ', None),
])
def test_strict_json(spark, text, problem):
    assert spark.createDataFrame([(text,)], "t string").select(artifacts.strict_json_problem(F.col("t"))).first()[0] == problem


def test_ledger_and_json_objects(spark, tmp_path):
    lines = ['{"seq": 1, "type": "a", "prev_sha256": null}', "", '{"seq": 2, "type": "b"}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n")
    got = artifacts.ledger(spark, str(tmp_path / "l.jsonl")).orderBy("seq").collect()
    assert [(r.line, r.seq, r.type) for r in got] == [(lines[0], 1, "a"), (lines[2], 2, "b")]
    assert spark.range(1).select(artifacts.json_object(F.lit('{"a": 1}'), "a int").alias("x")).first().x.a == 1


def test_markdown_both_ways(spark):
    texts = ['---\ntitle: "a: \\"b\\""\nmeta:\n  k: v\n---\n\nBody\nmore', "no front matter", "---\na: 1\na: 2\n---\n\nx", "---\na: [1]\n---\n\nx"]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(artifacts.markdown(F.col("t")).alias("m")).collect()]
    assert (got[0].meta, got[0].body) == ({"title": 'a: "b"', "meta.k": "v"}, "Body\nmore")
    assert got[1] is None
    assert got[2].meta is None
    assert got[3].meta is None
    out = spark.range(1).select(artifacts.rendered_document({"title": F.lit('a "b"\u2028'), "none": F.lit(None).cast("string")}, {"meta": {"k": F.lit("v")}}, F.lit("Body")).alias("d"))
    assert out.first().d == '---\ntitle: "a \\"b\\"\\u2028"\nmeta:\n  k: "v"\n---\n\nBody\n'
    back = out.select(artifacts.markdown(F.col("d")).alias("m")).first().m
    assert back.meta == {"title": 'a "b"\u2028', "meta.k": "v"}


def test_exports_inventories_and_budgets(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 1}\n{bad\n')
    got = artifacts.corpus_export(spark, str(tmp_path / "e.json"), "id long").collect()
    assert [(r.id, r._corrupt_record) for r in got] == [(1, None), (None, "{bad")]
    files = spark.createDataFrame([("t/a.md", "r1"), ("t/b.md", "r2"), ("u/c.md", "r3")], "path string, revision string")
    one = {r.entity_type: (r.n, r.digest) for r in artifacts.entity_inventory(files).collect()}
    assert {k: n for k, (n, _) in one.items()} == {"t": 2, "u": 1}
    changed = {r.entity_type: (r.n, r.digest) for r in artifacts.entity_inventory(files.withColumn("revision", F.replace("revision", F.lit("r1"), F.lit("r9")))).collect()}
    assert changed["u"] == one["u"]
    assert changed["t"] != one["t"]
    registry = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "b")], "at int, project_id string")
    assert [r["at"] for r in artifacts.unsorted_rows(registry, "at").collect()] == [3, 4]
    inputs = artifacts.provider_inputs(docs=spark.createDataFrame([(1, "ä")], "identity long, body string"), pages=spark.createDataFrame([("p", "xy")], "identity string, body string"))
    assert tuple(artifacts.within_budget(inputs).first()) == (2, 4, True)
    assert artifacts.within_budget(inputs, files=1).first().fits is False
    artifacts.write_json_report(registry.limit(1), str(tmp_path / "report"))
    assert [json.loads(x) for p in (tmp_path / "report").glob("*.json") for x in p.read_text().splitlines()] == [{"at": 1, "project_id": "a"}]


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)


def streamed(spark, tmp_path, schema, batches, build, mode="append"):
    """Runs ``build`` over a stream of one file a batch and returns all rows it put out."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        part = next((tmp_path / f"stage{i}").glob("*.parquet"))
        part.rename(source / f"{i:03}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = build(stream).writeStream.outputMode(mode).format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return spark.read.parquet(str(out)).collect()


def test_event_windows_leave_out_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    batches = [[(at(5), "a", 1.0), (at(20), "a", 2.0)], [(at(200), "b", 1.0)], [(at(10), "a", 100.0), (at(230), "b", 3.0)], [(at(500), "z", 0.0)]]
    got = {(r.event_type, r.n, r.total) for r in streamed(spark, tmp_path, schema, batches, jobs.event_windows)}
    # The row at minute 10 came after the watermark had passed its window.
    assert got == {("a", 2, 3.0), ("b", 2, 4.0)}


def test_distinct_events_within_the_watermark(spark, tmp_path):
    schema = "ts timestamp, event_id long"
    got = streamed(spark, tmp_path, schema, [[(at(0), 1), (at(1), 1), (at(2), 2)], [(at(3), 1), (at(4), 3)]], jobs.distinct_events)
    assert sorted(r.event_id for r in got) == [1, 2, 3]


def test_sessions_and_rule_totals_on_static_rows(spark):
    events = spark.createDataFrame([(at(0), 1), (at(20), 1), (at(100), 1), (at(0), 2)], "ts timestamp, user_id long")
    assert sorted((r.user_id, r.n) for r in jobs.sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]
    docs = spark.createDataFrame([(at(0), 1, "Cookie: a=b"), (at(30), 2, "Cookie: c=d Bearer abcdefgh"), (at(90), 3, "plain")], "ts timestamp, doc_id long, text string")
    assert sorted((r.rule_id, r.findings) for r in jobs.rule_totals(docs, "ts").collect()) == [("credential.bearer", 1), ("credential.cookie", 2)]
    assert {r.key: dict(r.findings) for r in jobs.screened_stream(docs).collect()} == {1: {"credential.cookie": 1}, 2: {"credential.bearer": 1, "credential.cookie": 1, "input.redaction-overlap": 1}, 3: {}}


def test_a_batch_run_twice_replaces_itself(spark, tmp_path):
    write = jobs.upsert_writer(str(tmp_path / "rows"), "k")
    first = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    write(first, 0)
    write(spark.createDataFrame([("a", 5)], "k string, v int"), 1)
    write(first.repartition(3), 0)
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.count() == 3
    assert {r.k: r.v for r in jobs.current_rows(rows, "k").collect()} == {"a": 5, "b": 2}
