import datetime
import json

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import context, entities, handles, reports
from tarnfield.sources import versions

BASE = {"title": "T", "summary": "S", "sourceRefs": ["a"], "sourceRevision": "sha256:" + "0" * 64}
CASES = [
    ("d1", "decisions", BASE, "active", [], ["archived", "status"]),
    ("d2", "decisions", BASE | {"status": "superseded", "archived": True}, "superseded", [], []),
    ("d3", "decisions", BASE | {"status": "superseded"}, "superseded", ["supersedes:state"], ["archived"]),
    ("d4", "decisions", BASE | {"status": "archived", "archiveReason": " "}, "archived", ["archiveReason:state"], ["archived"]),
    ("d5", "decisions", BASE | {"status": "open"}, "open", ["status:enum"], ["archived"]),
    ("f1", "failures", BASE | {"failureClass": "x", "status": "resolved", "resolution": "done"}, "resolved", [], ["archived"]),
    ("f2", "failures", BASE | {"status": "resolved"}, "resolved", ["failureClass:required", "resolution:state", "verified-by:state"], ["archived"]),
    ("v1", "verifications", BASE | {"verificationKind": "t", "evidenceRefs": [], "status": "passed"}, "passed", [], ["archived"]),
    ("v2", "verifications", BASE | {"verificationKind": "t", "evidenceRefs": [1], "archived": "yes", "confidence": 1.5, "zeta": 1, "Alpha": 2}, "recorded", ["confidence:range", "archived:type", "evidenceRefs:type", "Alpha:unknown", "zeta:unknown"], ["status"]),
    ("v3", "verifications", {"title": "x" * 201, "summary": 5, "sourceRefs": "a", "sourceRevision": "short", "confidence": 1, "provenanceState": "guessed"}, "recorded", ["title:length", "summary:type", "sourceRefs:type", "sourceRevision:length", "provenanceState:enum", "verificationKind:required", "evidenceRefs:required"], ["archived", "status"]),
    ("n1", "notes", BASE, None, ["entity_type:unknown"], []),
]


def test_entities_against_the_schema(spark):
    rows = [(i, kind, json.dumps(body)) for i, kind, body, *_ in CASES] + [("x1", "decisions", "[]"), ("x2", "decisions", "{not json"), ("x3", "decisions", None), ("e1", "decisions", json.dumps(BASE | {"title": "\U0001f600" * 101}))]
    relations = [("supersedes", "d1", "d2"), ("supersedes", "d1", "d2"), ("supersedes", "d2", "d3"), ("verified-by", "f1", "v1"), ("verified-by", "f2", "v2"), ("supersedes", "missing", "d3")]
    frame = spark.createDataFrame(rows, "id string, entity_type string, body string")
    got = {r.id: (r.state, r.violations, r.defaulted) for r in entities.entity_problems(frame, spark.createDataFrame(relations, "relation string, from_id string, to_id string")).collect()}
    for i, _, _, state, violations, defaulted in CASES:
        assert got[i] == (state, violations, defaulted), i
    for i in ("x1", "x2", "x3"):
        assert got[i][1:] == (["body:type"], [])
    # Lengths count UTF-16 units.
    assert got["e1"][1] == ["title:length"]


def test_a_schema_is_rows(spark):
    schema = spark.createDataFrame([("box", "size", "number", True, 2.0, None, None, None), ("box", "colour", "enum", False, None, None, ["red"], "red")], entities.SCHEMA_COLUMNS)
    frame = spark.createDataFrame([("a", "box", '{"size": 1}'), ("b", "box", '{"size": 2.5, "colour": "blue"}'), ("c", "box", "{}")], "id string, entity_type string, body string")
    got = {r.id: (r.violations, r.defaulted) for r in entities.checked_entities(frame, schema, "colour").collect()}
    assert got == {"a": (["size:range"], ["colour"]), "b": (["colour:enum"], []), "c": (["size:required"], ["colour"])}


def report(**changes):
    gates = {("lexical", "korean-exact"): (0.75, 0.9), ("semantic", "korean-synonym"): (None, 0.8), ("semantic", "korean-to-english"): (None, 0.7)}

    def cell(mode, category, value=1.0):
        least = gates.get((mode, category), (None, None))
        return {"category": category, "mode": mode, "mrr": value, "recallAt5": value, "passed": all(x is None or value >= x for x in least), "queryCount": 2, "thresholds": {"minimumMrr": least[0], "minimumRecallAt5": least[1]}}

    all_of = lambda mode, low=None: [cell(mode, c, 0.5 if c == low else 1.0) for c in reports.CATEGORIES]
    out = {
        "metrics": [c for m in reports.MODES for c in all_of(m)], "candidateComparisonPassed": True, "overallPassed": True, "regression": {"compatible": True, "passed": True, "reasonCodes": []},
        "candidates": [{"candidateId": "words", "decision": "rejected", "indexBytes": 5, "metrics": all_of("lexical", "korean-spacing-morphology")}, {"candidateId": "grams", "decision": "selected", "indexBytes": 9, "metrics": all_of("lexical")}],
    }
    for path, value in changes.items():
        *way, last = [int(p) if p.isdigit() else p for p in path.split("__")]
        node = out
        for step in way:
            node = node[step]
        if value is KeyError:
            del node[last]
        elif isinstance(node, list) and value is list:
            node.append(node[last])
        else:
            node[last] = value
    return out


def test_reports_are_worked_out_again(spark):
    cases = {
        "sound": (report(), set()), "not-json": ("{", {"unreadable"}), "no-flag": (report(overallPassed=None), {"unreadable"}),
        "false-passed": (report(metrics__7__passed=False), {"passed"}), "lenient": (report(metrics__0__thresholds__minimumMrr=0.1), {"thresholds"}),
        "missing": (report(metrics__12=KeyError), {"missing-cell"}), "repeated": (report(metrics__12=list), {"repeated-cell"}), "beyond": (report(metrics__8__mrr=1.5), {"range"}),
        "no-queries": (report(metrics__8__queryCount=0), {"range"}), "other-numbers": (report(metrics__1__mrr=0.9), {"selected-metrics"}), "two": (report(candidates__0__decision="selected"), {"selected", "comparison"}),
        "twice": (report(candidates__0__candidateId="grams"), {"repeated-candidate", "repeated-cell", "comparison"}), "bytes": (report(candidates__0__indexBytes=None), {"index-bytes"}),
        "reasons": (report(regression__reasonCodes=["slow"]), {"regression"}), "comparison": (report(candidateComparisonPassed=False), {"comparison", "overall"}), "overall": (report(overallPassed=False), {"overall"}),
        "no-gain": (report(candidates__0__metrics__1__mrr=1.0, candidates__0__metrics__1__recallAt5=1.0), {"comparison"}),
    }
    frame = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in cases.items()], "report_id string, body string")
    got = {}
    for r in reports.report_problems(frame).collect():
        got.setdefault(r.report_id, set()).add(r.problem)
    for k, (_, want) in cases.items():
        found = got.get(k, set())
        assert found == want, (k, found)


def test_contexts_fit_their_budgets(spark):
    requests = spark.createDataFrame([(1, 7, 3, 4), (2, 1, 2, 1), (3, 100, 2, 0), (4, 100, 1, 5)], "query_id long, budget long, top_pages int, top_chunks int")
    ranked = spark.createDataFrame([(q, p, i + 1, 1.0) for q, ps in ((1, "abg"), (2, "ab"), (3, "bz"), (4, "b")) for i, p in enumerate(ps)], "query_id long, page_id string, rank int, score double")
    pages = spark.createDataFrame([("a", "12345678"), ("b", "1234"), ("g", None)], "page_id string, summary string")
    chunks = spark.createDataFrame([("a", 1, "1234"), ("a", 2, "12345"), ("a", 3, "1" * 40), ("g", 1, "x")], "page_id string, chunk int, text string")
    got = {(r.query_id, r.page_id): (r.gap, r.chunks, r.page_tokens, r.estimated_tokens, r.truncated) for r in context.context_results(requests, ranked, pages, chunks).collect()}
    assert got == {
        (1, "a"): (None, 2, 5, 5, True), (1, "b"): ("over-budget", 0, 0, 5, True), (1, "g"): ("over-budget", 0, 0, 5, True),
        (2, "a"): ("over-budget", 0, 0, 0, True), (2, "b"): ("over-budget", 0, 0, 0, True), (3, "b"): (None, 0, 1, 1, False), (3, "z"): ("page-missing", 0, 0, 1, False), (4, "b"): ("no-chunks", 0, 1, 1, False),
    }


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_a_handle_counts_once(spark):
    issued = spark.createDataFrame([("a", at(10)), ("a", at(500)), ("b", at(10))], "handle string, issued_at timestamp")
    uses = [(1, "a", 5), (2, "a", 30), (3, "a", 20), (4, "a", 20), (5, "a", 111), (6, "b", 110), (7, "c", 50), (8, None, 50), (9, "a", None)]
    frame = spark.createDataFrame([(i, h, None if t is None else at(t)) for i, h, t in uses], "use_id long, handle string, at timestamp")
    got = {r.use_id: r.outcome for r in handles.single_use(frame, issued, 100).collect()}
    assert got == {1: "unknown", 2: "consumed", 3: "granted", 4: "consumed", 5: "expired", 6: "granted", 7: "unknown", 8: "unknown", 9: "unknown"}
    assert handles.single_use(frame.limit(0), issued, 100).count() == 0


def test_a_handle_counts_once_over_batches_and_restarts(spark, tmp_path):
    schema = "handle string, kind string, use_id long, at timestamp"
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def run(rows, name):
        spark.createDataFrame([(h, k, u, at(t)) for h, k, u, t in rows], schema).coalesce(1).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        found = handles.single_use_stream(stream, 100, "10 seconds")
        # A new query each time, from the same checkpoint: a restart.
        found.writeStream.format("parquet").option("checkpointLocation", marks).option("path", out).trigger(availableNow=True).start().awaitTermination()

    run([("a", "issue", None, 0), ("a", "use", 2, 9), ("a", "use", 1, 5), ("b", "issue", None, 0), ("c", "use", 3, 4)], 1)
    run([("a", "use", 4, 20), ("b", "use", 5, 30), ("c", "issue", None, 40)], 2)
    run([("b", "use", 6, 31), ("c", "use", 7, 60), ("b", "use", 8, 101)], 3)
    got = {r.use_id: r.outcome for r in spark.read.parquet(out).collect()}
    assert got == {1: "granted", 2: "consumed", 3: "unknown", 4: "consumed", 5: "granted", 6: "consumed", 7: "granted", 8: "expired"}
    # Nothing new: nothing is judged again.
    handles.single_use_stream(spark.readStream.schema(schema).parquet(f"{source}/*"), 100, "10 seconds").writeStream.format("parquet").option("checkpointLocation", marks).option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 8


def test_plan_then_apply(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, value string").repartition(2)
    first = versions.plan_change(spark, path)
    assert (first.version, first.fingerprint) == (0, "absent")
    rival = versions.plan_change(spark, path)
    assert versions.apply_change(first, rows(1, 2)) == 1
    with pytest.raises(versions.BindingInvalid):
        versions.apply_change(first, rows(3))
    with pytest.raises(versions.BindingInvalid):
        versions.apply_change(rival, rows(9))
    same = versions.plan_change(spark, path)
    assert versions.apply_change(same, rows(2, 1)) == 1
    # The rows change in place between plan and apply.
    plan = versions.plan_change(spark, path)
    rows(1, 5).write.mode("overwrite").parquet(f"{path}/v-00000001")
    with pytest.raises(versions.BindingInvalid):
        versions.apply_change(plan, rows(1))
    assert versions.apply_change(versions.plan_change(spark, path), rows(4)) == 2
    assert [r.id for r in versions.read_version(spark, path).collect()] == [4]
    # Another writer takes the number between the second look and the rename.
    plan, looked = versions.plan_change(spark, path), versions.fingerprint

    def looks_and_loses(*args):
        found = looked(*args)
        rows(7).write.parquet(f"{path}/v-00000003")
        return found

    versions.fingerprint = looks_and_loses
    try:
        with pytest.raises(versions.BindingInvalid):
            versions.apply_change(plan, rows(8))
    finally:
        versions.fingerprint = looked
    assert [r.id for r in versions.read_version(spark, path).collect()] == [7]
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["v-00000001", "v-00000002", "v-00000003"]


def test_attempts_to_apply(spark):
    plans = spark.createDataFrame([(1, "p", "x", "changed", False), (2, "p", "x", "unchanged", False), (3, "p", "old", "changed", False), (4, "p", "x", "changed", True)], "plan_id int, project_id string, fingerprint string, disposition string, migration boolean")
    current = spark.createDataFrame([("p", "x"), ("q", "x")], "project_id string, fingerprint string")
    attempts = spark.createDataFrame([(1, 1, "p"), (2, 1, "p"), (3, 2, "p"), (4, 3, "p"), (5, 4, "p"), (6, 4, "p"), (7, 9, "p"), (8, 2, "q"), (9, 2, "r")], "attempt int, plan_id int, project_id string")
    got = {r.attempt: r.outcome for r in handles.apply_outcomes(attempts, plans, current).collect()}
    bad = "binding-invalid"
    assert got == {1: "applied", 2: bad, 3: "unchanged", 4: bad, 5: "migration-required", 6: "migration-required", 7: bad, 8: bad, 9: bad}
    assert handles.apply_outcomes(attempts.where(F.lit(False)), plans, current).count() == 0
