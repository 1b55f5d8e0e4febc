import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnfield.functions.text import component_decoded, percent_encoded
from tarnfield.operators import index, projection, select

PAGES = "page_id string, title string, summary string, body string, source_refs array<string>"
DOCS = [
    ("a/one", "인증 오류 복구", "로그인", "토큰 인증 alpha", ["s.md"]),
    ("a/two", "Alpha beta", "", "gamma \"delta\" alpha", ["s.md"]),
    ("b/three", "배포 자동화", "캐시무효화", "beta", ["s.md"]),
]


def grams(words, n):
    import re

    return {run[i : i + n] for w in words for run in re.findall("[가-힣]+", w) for i in range(len(run) - n + 1)}


def words(text):
    import re

    return set(re.findall(r"[^\W_]+", text.lower()))


def test_index_bytes_are_those_of_the_json(spark):
    pages = spark.createDataFrame(DOCS, PAGES)
    lists, plain = {}, {}
    for page, title, summary, body, _ in DOCS:
        for field, text in (("title", title), ("summary", summary), ("body", body)):
            for kind, values in (("w", words(text)), ("b", grams(words(text), 2)), ("t", grams(words(text), 3))):
                for v in values:
                    lists.setdefault(f"{field}:{kind}:{v}", set()).add(page)
        for w in words(f"{title} {summary} {body}"):
            plain.setdefault(w, set()).add(page)

    def size(found):
        return len((json.dumps([{"feature": k, "pageIds": sorted(v)} for k, v in sorted(found.items())], indent=2, ensure_ascii=False) + "\n").encode())

    row = index.index_bytes(index.posting_lists(pages)).first()
    assert (row["lists"], row["entries"], row["index_bytes"]) == (len(lists), sum(map(len, lists.values())), size(lists))
    assert index.index_bytes(index.word_postings(pages)).first()["index_bytes"] == size(plain)
    assert index.index_bytes(index.posting_lists(pages.limit(0))).first()["index_bytes"] == 3
    assert index.corpus_bounds(pages).first()["problem"] is None
    assert index.corpus_bounds(pages, most_pages=2).first()["problem"] == "too-many-pages"
    assert index.corpus_bounds(pages, most_chars=5).first()["problem"] == "too-many-characters"
    assert index.corpus_bounds(pages.unionByName(pages)).first()["problem"] == "duplicate-page"


def test_evaluation_of_all_modes(spark):
    pages = spark.createDataFrame(DOCS, PAGES)
    queries = spark.createDataFrame([("q1", "인증오류", "korean-spacing-morphology"), ("q2", "alpha beta", "korean-exact"), ("q3", "nothing", "korean-synonym")], "query_id string, query_text string, category string")
    relevant = spark.createDataFrame([("q1", "a/one"), ("q2", "b/three"), ("q3", "b/three")], "query_id string, page_id string")
    recorded = spark.createDataFrame([("q2", "b/three", 1), ("q3", "b/three", 2)], "query_id string, page_id string, rank int")
    found = {(r["mode"], r["category"]): (r["recall_at_5"], r["mrr"], r["passed"]) for r in index.evaluation(pages, queries, relevant, recorded).collect()}
    assert found["lexical", "korean-spacing-morphology"] == (1.0, 1.0, True)
    assert found["word-only", "korean-spacing-morphology"] == (0.0, 0.0, True)
    # a/two holds both words, b/three one; the recorded side puts b/three first.
    assert found["lexical", "korean-exact"] == (1.0, 0.333333, False)
    assert found["hybrid", "korean-exact"] == (1.0, 1.0, True)
    assert found["semantic", "korean-synonym"] == (1.0, 0.5, True)
    rows = [(r.page_id, r["rank"], r.score) for r in index.rankings(pages, queries).where("query_id = 'q2'").orderBy("rank").collect()]
    assert rows == [("a/two", 1, 1.0), ("a/one", 2, 0.5), ("b/three", 3, 0.5)]
    assert index.word_only_rankings(pages, spark.createDataFrame([("q", "alpha x y")], "query_id string, query_text string")).first().score == 1 / 3


def test_warnings_tokens_and_requests(spark):
    row = spark.range(1).select(index.known_warnings(F.array(*map(F.lit, ["zzz", "journal-unavailable", "aaa", "journal-unavailable"]))).alias("w"), index.is_partial(F.array(F.lit("provider-unconfigured"))).alias("no"), index.is_partial(F.array(F.lit("incomplete-compile"))).alias("yes")).first()
    assert (row.w, row.no, row.yes) == (["journal-unavailable", "query-warning"], False, True)
    pages = spark.createDataFrame(DOCS, PAGES)
    columns = tuple(pages.columns)
    one = index.snapshot_token(pages, columns=columns)
    assert one == index.snapshot_token(pages.repartition(3), columns=columns)
    assert index.drifted(one, index.snapshot_token(pages.limit(2), columns=columns))
    assert index.drifted(one, index.snapshot_token(pages, warnings=("x",), columns=columns))
    asked = [("p-1", "cafe\u0301", None), ("P", "x", None), ("p", " ", "lexical"), ("p", "x\u0007", None), ("p", "x", "odd"), ("p", "!!", None), ("p", "x" * 8193, None), ("p", "x", "semantic")]
    got = index.checked_searches(spark.createDataFrame(asked, "project_id string, query string, mode string")).collect()
    assert [r.problem for r in got] == [None, "project", "query", "query", "mode", "no-words", "query", None]
    assert (got[0]["query"], got[0]["mode"]) == ("caf\u00e9", "hybrid")
    contexts = [("p", "x", None, None, None, None, True), ("p", "x", 0, None, None, None, True), ("p", "x", 1, 3, None, None, True), ("p", "x", 100_000, 2, 50, 20, False), ("p", "x", 1, 0, 51, 1, True)]
    got = index.checked_contexts(spark.createDataFrame(contexts, "project_id string, prompt string, budget long, depth long, top_chunks long, top_pages long, e boolean"), "e").collect()
    assert [r.problem for r in got] == [None, "budget", "depth", None, "top_chunks"]
    assert [r.top_chunks for r in got] == [None, None, None, 0, 51]


@pytest.mark.parametrize(("text", "encoded"), [("a/b c", "a%2Fb%20c"), ("~!*'()-_.", "~!*'()-_."), ("é+%", "%C3%A9%2B%25"), ("한", "%ED%95%9C"), ("", "")])
def test_percent_encoding_both_ways(spark, text, encoded):
    row = spark.createDataFrame([(text, encoded)], "t string, e string").select(percent_encoded(F.col("t")).alias("e"), component_decoded(F.col("e")).alias("t")).first()
    assert (row.e, row.t) == (encoded, text)


def test_percent_decoding_takes_one_form_only(spark):
    rows = spark.createDataFrame([(x,) for x in ("a+b", "%2f", "a b", "%7E", "%zz", "%C3")], "x string").select(component_decoded(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [None] * 6


def test_source_identities(spark):
    digest = "ab" * 32
    good = [
        ("planning", "app:/repo/proj/it-1/intake/iterations%2Fit-1%2Fgate-a-intake%2Fintake.json"),
        ("planning", "app:/repo/proj/it-1/product-spec/iterations%2Fit-1%2Fgate-b-spec%2Fspec.json"),
        ("planning", "app:/repo/proj/it-1/archived-iteration/iterations%2Fit-1%2Fiteration.json"),
        ("execution", f"app:/repo/proj/it-1/execution-task/iterations%2Fit-1%2Fgate-c-task-graph%2Ftask-graph.json/task-7/{digest}"),
    ]
    bad = [
        ("planning", "other:/repo/proj/it-1/intake/iterations%2Fit-1%2Fgate-a-intake%2Fintake.json"),
        ("planning", "app:/repo/else/it-1/intake/iterations%2Fit-1%2Fgate-a-intake%2Fintake.json"),
        ("planning", "app:/repo/proj/it-1/intake/iterations%2fit-1%2Fgate-a-intake%2Fintake.json"),
        ("planning", "app:/repo/proj/it-1/intake/iterations%2Fit-2%2Fgate-a-intake%2Fintake.json"),
        ("planning", "app:/repo/proj/It-1/intake/iterations%2FIt-1%2Fgate-a-intake%2Fintake.json"),
        ("planning", "app:/repo/proj/it-1/unknown/iterations%2Fit-1%2Fiteration.json"),
        ("planning", good[0][1] + "/more"),
        ("execution", good[3][1][:-1] + "g"),
        ("execution", good[3][1].replace("task-7", "task-x")),
        ("execution", good[0][1]),
        ("planning", good[3][1]),
    ]
    frame = spark.createDataFrame([(k, s, "proj") for k, s in good + bad] + [("planning", None, "proj")], "kind string, source string, project string")
    found = frame.select(projection.source_identity(F.col("source"), F.col("kind"), F.col("project"), "repo", "app:").alias("i")).collect()
    assert [r.i is not None for r in found] == [True] * 4 + [False] * 12
    assert found[3].i.asDict() == {"iteration_id": "it-1", "document_kind": None, "artifact_path": "iterations/it-1/gate-c-task-graph/task-graph.json", "task_id": "task-7", "contract": digest}
    agree = lambda **stated: frame.limit(1).select(projection.source_identity(F.col("source"), F.col("kind"), F.col("project"), "repo", "app:", **{k: F.lit(v) for k, v in stated.items()}).alias("i")).first().i is not None
    assert agree(iteration_id="it-1", document_kind="intake")
    assert not agree(document_kind="product-spec")
    assert not agree(iteration_id="it-2")


def test_task_contracts(spark):
    task = {"id": "task-1", "title": "ä", "status": "open", "blockNote": "x", "deps": [{"b": 1, "a": None}]}
    expected = hashlib.sha256('{"schema_version":"app.task_contract.v1","task":{"deps":[{"a":null,"b":1}],"id":"task-1","title":"ä"}}'.encode()).hexdigest()
    rows = [(json.dumps(task),), (json.dumps(task | {"status": "done", "blockReason": "y"}),), ("[1]",), ("{",), (None,)]
    got = [r.d for r in spark.createDataFrame(rows, "t string").select(projection.contract_digest(F.col("t"), "app.task_contract.v1").alias("d")).collect()]
    assert got == [expected, expected, None, None, None]


def run(**changes):
    return {"agentTool": "a", "finishedAt": None, "iterationId": "i1", "runId": "run-1", "runRef": "i1/run-1.json", "startedAt": "2024-01-01T00:00:00Z", "status": "started", "taskGraphRef": "t", "taskId": "task-1", "workspaceRef": None} | changes


def test_run_indexes(spark):
    task = {"latestRunId": None, "runIds": ["run-1"], "taskId": "task-1"}
    whole = lambda runs, tasks=(task,), **more: json.dumps({"projectId": "p", "schema_version": "app.run_index.v1", "runs": list(runs), "tasks": list(tasks)} | more)
    cases = [
        (whole([run()]), None), (whole([]), None), (whole([run(), run(runId="run-2", runRef="run-2.json")]), None), (whole([run(finishedAt="2024-01-02T00:00:00+01:00", status="finished")]), None),
        ("{", "unsupported_schema"), (whole([], schema_version="v2"), "unsupported_schema"), (whole([], extra=1), "unsupported_schema"), (whole([run()], projectId="q"), "project_mismatch"),
        (whole([run(), run()]), "run_reference_invalid"), (whole([run(runRef="other/run-1.json")]), "run_reference_invalid"), (whole([run(status="odd")]), "run_reference_invalid"), (whole([run(startedAt="2024-02-30T00:00:00Z")]), "run_reference_invalid"),
        (whole([run(extra=1)]), "run_reference_invalid"), (whole([{k: v for k, v in run().items() if k != "agentTool"}]), "run_reference_invalid"), (whole([run(taskId="x")]), "run_reference_invalid"), (whole([run(runId="run-1/..", runRef="run-1/...json")]), "run_reference_invalid"),
        (whole([], [task | {"latestRunId": "x"}]), "run_reference_invalid"), (whole([], [task | {"runIds": ["x"]}]), "run_reference_invalid"), (whole([], [{"taskId": "task-1"}]), "run_reference_invalid"),
    ]
    frame = spark.createDataFrame([(i, t, "p") for i, (t, _) in enumerate(cases)], "n int, t string, p string")
    got = projection.run_index(frame, "t", "p", "app.run_index.v1").orderBy("n").collect()
    assert [r.problem for r in got] == [p for _, p in cases]
    assert [r.decoded is None for r in got] == [p is not None for _, p in cases]
    assert got[2].decoded.runs[1].runId == "run-2"


def test_a_change_beyond_the_cut_remains_to_be_written(spark):
    rows = lambda end: select.source_documents(spark.createDataFrame([(1, "x" * 100_001 + end)], "doc_id long, text string"))
    plan = rows("a").withColumn("decision", F.lit("include")).join(select.upsert_status(rows("a"), rows("b")).withColumnRenamed("status", "write_status"), "target")
    plan = plan.select("target", "uri", "content_hash", "decision", "write_status")
    summary, _ = projection.sync_plan(plan, plan.limit(0), dry_run=True)
    assert [(r.included, r.remaining) for r in summary.collect()] == [(1, 1)]


def test_the_queries_cut_by_code_points_as_their_sql_does(spark, tmp_path):
    """In UTF-16 units the first text would end behind a line feed, and the second would not."""
    import duckdb

    from tarnfield.plans import projection_queries

    texts = ["\U0001f600" + "x" * 99_997 + "\n" + "yz", "\U0001f600" + "x" * 99_998 + "\n" + "yzz", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in projection_queries.sync_summary(spark, str(tmp_path)).collect()]
    assert got == db.sql(projection_queries.SYNC_SQL).fetchall()
    assert got[0][0] == 2


def test_recorded_rankings_are_those_of_the_single_modes(spark):
    """Ties, Hangul, a page id that two rows share, a query without words and a page that nothing records."""
    pages = spark.createDataFrame([(1, "가나다 b c"), (2, "b c"), (3, "c 가나"), (4, "b c"), (4, "d"), (5, None), (6, "가나다라"), (7, "c")], "page_id long, body string")
    queries = spark.createDataFrame([(1, "b c d", "x"), (2, "가나다 c", "y"), (3, "-", "y"), (4, "c", "x")], "query_id long, query_text string, category string")
    good = spark.createDataFrame([(2,), (4,), (4,), (6,), (7,), (9,)], "page_id long")
    wanted = queries.select("query_id").crossJoin(pages.select("page_id").distinct())
    got = index.recorded_rankings(pages, queries, good, wanted, fields=("body",))
    assert got.count() > 20
    single = {"lexical": index.rankings(pages, queries, fields=("body",)), "word-only": index.word_only_rankings(pages, queries, fields=("body",)), "semantic": index.word_only_rankings(pages.join(good, "page_id", "left_semi"), queries, fields=("body",))}
    single["hybrid"] = index.fused_rankings(single["lexical"], single["semantic"])
    for mode, ranks in single.items():
        assert {(r.query_id, r.page_id, r.rank) for r in got.where(F.col("mode") == mode).collect()} == {(r.query_id, r.page_id, r["rank"]) for r in ranks.collect()}, mode


PLAN = "target string, uri string, content_hash string, decision string, write_status string"


def test_sync_plans(spark):
    one = spark.createDataFrame([("planning--a", "u1", "h", "include", "create"), ("planning--b", "u2", "h", "include", "unchanged"), ("planning--c", "u3", "h", "exclude", None)], PLAN)
    two = spark.createDataFrame([("execution--a", "u4", "h", "include", "update")], PLAN)

    def outcome(planning, execution, **more):
        summary, writes = projection.sync_plan(planning, execution, **more)
        return (*summary.select("included", "problem", "remaining", "applied").first(), sorted(r.target for r in writes.collect()))

    assert outcome(one, two) == (3, None, 0, 2, ["execution--a", "planning--a", "planning--b"])
    assert outcome(one, two, dry_run=True) == (3, None, 2, 0, [])
    stop = spark.createDataFrame([("x", "u", "h", "quarantine", None)], PLAN)
    assert outcome(one, two.unionByName(stop)) == (3, "execution", 2, 0, [])
    assert outcome(one.unionByName(stop), stop) == (2, "planning", 1, 0, [])
    assert outcome(one, one) == (4, "target-collision", 2, 0, [])
    assert projection.remaining_count(one.unionByName(two)).first()[0] == 2
    writes = spark.createDataFrame([("sha256:" + "a" * 64, "planning--" + "b" * 64 + ".md", "create"), ("sha256:" + "a" * 64, "planning--" + "b" * 64 + ".md", "unchanged"), ("bad", "x", "gone")], "source_revision string, target string, write_status string")
    assert tuple(projection.applied_counts(writes).first()) == (3, 2, 1)


def test_fingerprints_ignore_order(spark):
    rows = [("g", i, None if i % 3 else "x") for i in range(50)]
    got = [projection.plan_fingerprint(spark.createDataFrame(r, "g string, a int, b string").repartition(n), "g", ["a", "b"]).first() for r, n in ((rows, 1), (rows[::-1], 4), (rows[:-1], 2))]
    assert got[0] == got[1] != got[2]
    assert got[0].entries == 50


def test_checked_projects(spark):
    status = "project_id string, pending_changes long, state_status string, pending_candidates long, stale long, orphaned long, warnings array<string>"
    before = spark.createDataFrame([("a", 0, "ok", 0, 0, 0, ["w2", "w1"]), ("b", 1, "bad", 0, 2, 0, []), ("c", 0, "ok", 0, 0, 0, []), ("d", 0, "ok", 0, 0, 0, [])], status)
    after = spark.createDataFrame([("a", 0, "ok", 0, 0, 0, ["w1", "w2"]), ("b", 1, "bad", 0, 2, 0, []), ("c", 1, "ok", 0, 0, 0, [])], status)
    lint = spark.createDataFrame([(p, int(p == "b"), ["w3"] if p == "a" else []) for p in "abcd"], "project_id string, lint_errors long, warnings array<string>")
    evaluated = spark.createDataFrame([(p, 0, int(p == "b"), []) for p in "abcd"], "project_id string, pending_reviews long, threshold_violations long, warnings array<string>")
    got = {r.project_id: (r.problem, r.gates, r.passed, r.warnings) for r in projection.checked_projects(before, after, lint, evaluated).collect()}
    assert got["a"] == (None, [], True, ["w1", "w2", "w3"])
    assert got["b"] == (None, ["pending-changes", "state-unhealthy", "stale-pages", "lint-errors", "eval-threshold-violations"], False, [])
    assert got["c"][:3] == ("snapshot-changed", None, False)
    assert got["d"][:3] == ("component-failed", None, False)


@pytest.mark.parametrize(("text", "good"), [
    ("https://host/a/b", True), ("HTTP://host", True), ("ticket:12/3", False), ("ticket:123", False), ("mailto:x", False), ("T-12/3", True), ("12:30", True), ("http:x", True), ("a.b-c:d", False), ("a_b:c", True), ("a", True), ("https://u:p@host/", False), ("https://host/?q", False), ("https://host/#f", False), ("ftp://host/", False), ("/abs", False), ("C:/x", False),
    ("x/home/y", False), ("Bearer  x", False), ("PASSWORD=x", False), ("akia" + "0123456789abcdef", False), ("a b", False), ("", False), ("a" * 257, False), ("x@y", False), (None, False),
])
def test_audit_references(spark, text, good):
    assert spark.createDataFrame([(text,)], "x string").select(projection.audit_reference(F.col("x"))).first()[0] is good


def test_error_reasons_and_denied_corpora(spark):
    codes = spark.createDataFrame([("PROJECTION_PATH_UNSAFE",), ("PROJECTION_WRITE_FAILED",), ("OTHER",)], "c string")
    assert [r[0] for r in codes.select(projection.error_reason(F.col("c"))).collect()] == ["path_unsafe", "unsupported_schema", None]
    pages = spark.createDataFrame(DOCS, PAGES)
    assert tuple(projection.corpus_denied(pages).first()) == (3, 0, False)
    bad = spark.createDataFrame([("c/x", "t", "", "Cookie: a=b", ["s"])], PAGES)
    assert tuple(projection.corpus_denied(pages.unionByName(bad)).first()) == (4, 1, True)
