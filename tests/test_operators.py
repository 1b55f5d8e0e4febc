import hashlib

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import evaluate, fusion, history, lexical, lifecycle, screen, select
from tarnfield.plans.screening_queries import SAMPLES

PAGES = "page_id string, title string, summary string, body string, source_refs array<string>"


def pages(spark, *rows):
    return spark.createDataFrame([(i, t, "", b, ["s.md"]) for i, t, b in rows], PAGES)


def test_search_scores_words_and_grams(spark):
    found = lexical.search(pages(spark, ("a/one", "인증 오류", "복구"), ("a/two", "인증", "other"), ("a/none", "x", "y")), "인증오류복구")
    assert [(r.page_id, r.score) for r in found.collect()] == [("a/one", 0.18), ("a/two", 0.06)]
    exact = lexical.search(pages(spark, ("a/b", "인증오류복구", ""), ("a/c", "인증 오류 복구", "")), "인증오류복구").collect()
    assert exact[0].page_id == "a/b"
    assert exact[0].score == 1.0


def test_search_order_doesnt_depend_on_input_order(spark):
    rows = [(f"p/{i}", "alpha beta" if i % 3 else "alpha", f"w{i}") for i in range(30)]
    one = lexical.search(pages(spark, *rows), "alpha beta").collect()
    two = lexical.search(pages(spark, *reversed(rows)).repartition(5), "alpha beta").collect()
    assert one == two
    assert len(one) == 20
    assert [r.rank for r in one] == list(range(1, 21))


def test_search_plan_has_no_join(spark):
    plan = lexical.search(pages(spark, ("a/b", "x", "y")), "x")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "TakeOrderedAndProject" in plan


def test_evidence_and_problems(spark):
    found = lexical.evidence(pages(spark, ("a/b", "alpha", "alpha beta")), "alpha beta").collect()
    assert {(r.kind, r.field, r.matches) for r in found} == {("word", "title", 1), ("word", "body", 2)}
    bad = lexical.validated_pages(pages(spark, ("a/b", "t", "b"), ("a/b", "t", "b"), ("bad", "t", "b"), ("a/c", "", "b"), ("a/d", "t", "b")))
    assert sorted((r.page_id, r.problem) for r in bad.collect()) == sorted([("a/b", "duplicate-page"), ("a/b", "duplicate-page"), ("bad", "page-id"), ("a/c", "title"), ("a/d", None)])


def test_fusion(spark):
    lex = spark.createDataFrame([("alpha", 1), ("zeta", 2)], "page_id string, rank int")
    sem = spark.createDataFrame([("zeta", 1), ("other", 2)], "page_id string, rank int")
    assert [(r.page_id, r.score) for r in fusion.fused(lex, sem).orderBy("rank").collect()] == [("zeta", 0.75), ("alpha", 0.5), ("other", 0.25)]
    listed = spark.createDataFrame([("q", ["b", "a", "b", "c"])], "query_id string, page_ids array<string>")
    assert sorted((r.rank, r.page_id) for r in fusion.first_places(listed).collect()) == [(1, "b"), (2, "a"), (3, "c")]
    assert fusion.search_mode("hybrid", False, False, "missing") == ("lexical", "store-unavailable")
    assert fusion.search_mode("hybrid", True, True, "compatible") == ("hybrid", None)


def test_recall_and_mrr(spark):
    ranks = spark.createDataFrame([("m", "q", p, i + 1) for i, p in enumerate(["x", "r1", "y", "z", "w", "r2"])], "mode string, query_id string, page_id string, rank int")
    relevant = spark.createDataFrame([("q", p) for p in ("r1", "r2", "r3", "r4")], "query_id string, page_id string")
    queries = spark.createDataFrame([("q", "c")], "query_id string, category string")
    row = evaluate.metrics(ranks, relevant, queries, ("m",)).first()
    assert (row.recall_at_5, row.mrr, row.query_count) == (0.25, 0.5, 1)


def test_gates_and_regressions(spark):
    found = spark.createDataFrame([("lexical", "korean-exact", 0.8, 0.9), ("lexical", "other", 0.0, 0.0), ("semantic", "korean-synonym", 0.7, 0.0)], "mode string, category string, mrr double, recall_at_5 double")
    assert {(r.mode, r.category): r.passed for r in evaluate.gated(found).collect()} == {("lexical", "korean-exact"): True, ("lexical", "other"): True, ("semantic", "korean-synonym"): False}
    lower = found.where("category <> 'other'").withColumn("mrr", F.col("mrr") - F.when(F.col("mode") == "semantic", 0.1).otherwise(0.0))
    assert {r.category: r.regressed for r in evaluate.regressions(lower, found).collect()} == {"korean-exact": False, "other": True, "korean-synonym": True}


def test_corpus_problems(spark):
    docs = spark.createDataFrame([("e1", "p1"), ("e1", "p2")], "evidence_id string, page_id string")
    queries = spark.createDataFrame([("q1", c) for c in evaluate.CATEGORIES[:4]] + [("q2", evaluate.CATEGORIES[0])], "query_id string, category string")
    judged = spark.createDataFrame([("q1", "e1", 4), ("q9", "e9", 1)], "query_id string, evidence_id string, relevance int")
    found = {r.problem for r in evaluate.corpus_problems(docs, queries, judged).collect()}
    assert found == {"duplicate-evidence", "duplicate-query", "unknown-query", "unknown-evidence", "unjudged-query", "bad-relevance", "missing-category"}


def test_every_sample_sets_off_its_rule(spark):
    rows = screen.screened(spark.createDataFrame(SAMPLES, "key string, text string"), "key", "text", home="/home/someone")
    found = {r.key: (r.findings, r.output) for r in rows.collect()}
    for key in ("bearer", "basic", "cookie", "environment", "jwt", "url"):
        assert found[key][0] == {f"credential.{key}": 1}
        assert "<REDACTED:CREDENTIAL>" in found[key][1]
    assert set(found["anthropic"][0]) == {"credential.provider.anthropic", "credential.provider.openai"}
    assert found["pem"][0] == {"private-key.pem": 1}
    assert found["home"] == ({"path.home": 2}, "file <HOME>/notes.txt and <HOME>\\x")
    assert found["clean"] == ({}, "nothing to see here")
    decided = {r.key: r.decision for r in screen.decisions(rows).collect()}
    assert decided["pem"] == "blocked"
    assert decided["override"] == decided["tool"] == "quarantine"
    assert decided["bearer"] == decided["clean"] == "include"


def test_input_guards_overlap_and_overrides(spark):
    texts = [("nul", "a\x00b"), ("odd", "a\x07"), ("two", "PASSWORD=Bearer abcdefgh12"), ("many", "ghp_" + "a1" * 12 + " " + ("Bearer abcdefgh12 " * 600)), ("rnd", "tok aB3dE5gH7jK9mN1pQ2sT4vW6_x end")]
    rows = screen.screened(spark.createDataFrame(texts, "key string, text string"), "key", "text")
    found = {r.key: r for r in rows.collect()}
    assert set(found["nul"].findings) == {"input.nul", "input.invalid-character"}
    assert set(found["odd"].findings) == {"input.invalid-character"}
    assert found["many"].overflow
    assert found["many"].output is None
    assert found["rnd"].findings == {"entropy.candidate": 1}
    over = spark.createDataFrame([("rnd", "entropy.candidate"), ("nul", "input.nul")], "key string, rule_id string")
    decided = {r.key: r.decision for r in screen.decisions(rows, over).collect()}
    assert decided["rnd"] == "include"
    assert decided["nul"] == decided["many"] == "blocked"


def test_policy_problems(spark):
    rules = spark.createDataFrame([("k", None, "a"), ("k", None, "b")], "source_kind string, source_identity string, classification string")
    over = spark.createDataFrame([("x", "input.nul"), ("y", "entropy.candidate"), ("y", "entropy.candidate")], "key string, rule_id string")
    assert {r.problem for r in screen.policy_problems(rules, over).collect()} == {"duplicate-classification", "duplicate-override", "not-overridable"}


def fold(attempts):
    """The inclusion rule as a plain fold over one ordered group."""
    kept, out, last, failed = [], {}, None, False
    for a in attempts:
        if a["status"] == "started":
            out[a["run_id"]] = (False, "started")
        elif a["status"] in ("failed", "blocked"):
            kept.append(a)
            failed = True
        elif not failed and last == a["fingerprint"]:
            out[a["run_id"]] = (False, "duplicate_success")
        else:
            kept.append(a)
            last, failed = a["fingerprint"], False
    meaning = lambda a: a["has_durable"] or a["has_reusable"]
    bad = [i for i, a in enumerate(kept) if a["status"] != "finished"]
    if bad:
        after = [a for a in kept[bad[-1] + 1 :] if a["status"] == "finished"]
        name = "retry_succeeded" if after else "failed_or_blocked"
        for a in kept:
            yes = a["status"] != "finished" or after and a is after[-1]
            out[a["run_id"]] = (True, name) if yes else (False, "duplicate_success" if meaning(a) else "low_signal")
        return out
    chosen = [a for a in kept if meaning(a)]
    name = "significant_change" if any(a["has_durable"] for a in chosen) else "reusable_verification"
    for a in kept:
        out[a["run_id"]] = (True, name) if meaning(a) else (False, "low_signal")
    return out


def test_inclusion_equals_the_fold(spark):
    import random

    rnd = random.Random(6)
    rows = []
    for task in range(150):
        for i in range(rnd.randint(1, 9)):
            rows.append({"task": task, "started_at": f"{i:03d}", "finished_at": None, "run_id": f"r{task}-{i}", "status": rnd.choice(history.STATUSES), "fingerprint": rnd.choice("ab"), "has_durable": rnd.random() < 0.4, "has_reusable": rnd.random() < 0.3})
    schema = "task int, started_at string, finished_at string, run_id string, status string, fingerprint string, has_durable boolean, has_reusable boolean"
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r.run_id: (r.included, r.reason) for r in history.inclusion(frame.repartition(5)).collect()}
    expected = {}
    for task in range(150):
        expected |= fold([r for r in rows if r["task"] == task])
    assert got == expected


def test_run_problems(spark):
    schema = "run_id string, task_id string, status string, started_at string, updated_at string, finished_at string, failure_class string, verification array<struct<status:string,exit_code:int,started_at:string,finished_at:string>>"
    rows = [
        ("a", "t", "finished", "1", "2", "3", None, [("passed", 0, "1", "2")]), ("b", "t", "odd", "1", None, None, None, None), ("c", "t", "finished", "1", None, None, None, None), ("d", "t", "failed", "1", None, "2", None, None),
        ("e", "t", "finished", "3", None, "2", None, None), ("f", "t", "finished", "1", None, "2", None, [("passed", 1, "1", "2")]), (None, "t", "started", "1", None, None, None, None), ("g", "t", "started", "1", None, "2", None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(history.run_problem()).collect()]
    assert got == [None, "bad-status", "missing-end", "missing-failure-class", "time-order", "bad-verification", "missing-key", "ended-start"]


def test_durable_and_reusable(spark):
    frame = spark.createDataFrame([(["src/a", "dist", "dist/x", "distance"], [("command", "failed", 1)]), ([], [("manual", "passed", 0), ("command", "passed", None)])], "p array<string>, v array<struct<source:string,status:string,exit_code:int>>")
    assert [tuple(r) for r in frame.select(history.durable(F.col("p")), history.reusable(F.col("v"))).collect()] == [(["src/a", "distance"], True), ([], False)]


def test_upsert_and_selection(spark):
    new = spark.createDataFrame([("t1", "u1", "c1"), ("t2", "u2", "c2"), ("t3", "u3", "c3"), ("t4", "u4", "c4")], "target string, uri string, content_hash string")
    old = spark.createDataFrame([("t2", "u2", "c2"), ("t3", "u3", "x"), ("t4", "other", "c4"), ("t5", "u5", "c5")], "target string, uri string, content_hash string")
    assert {r.target: r.status for r in select.upsert_status(new, old).collect()} == {"t1": "create", "t2": "unchanged", "t3": "update", "t4": "collision", "t5": "kept"}
    assert select.merged(new, old).count() == 5
    assert {r.problem for r in select.consistent(new, old, "target", ["uri", "content_hash"]).collect()} == {"no-candidate", "no-entry", "field-mismatch"}
    fan = spark.createDataFrame([("i", True)], "k string, ok boolean")
    assert sorted(r.kind for r in select.fanned_out(fan, "k", {"spec": "ok", "plan": "ok", "archive": "not ok"}).collect()) == ["plan", "spec"]
    value, source = select.first_instant(a=F.lit("bad"), b=F.lit("2024-01-01T00:00:00Z"))
    assert tuple(spark.range(1).select(value, source).first()) == ("2024-01-01T00:00:00.000Z", "b")


def test_source_documents_hash_and_check_what_lies_beyond_the_cut(spark):
    """The digest is that of the whole body, and a control character after 100,000 characters is unsafe."""
    rows = [(1, "x" * 100_001 + "a\r\n"), (2, "x" * 100_001 + "\x01"), (3, "short\n"), (4, " \n"), (5, None)]
    new = select.source_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.key: r for r in new.collect()}
    digest = lambda x: "sha256:" + hashlib.sha256(x.encode()).hexdigest()
    assert (got[1].content_hash, got[1].body_hash, got[1].truncated, got[1].problem) == (digest("x" * 100_001 + "a"), digest("x" * 100_000), True, None)
    assert (got[2].problem, got[3].content_hash, got[3].body_hash) == ("unsafe-text", digest("short"), digest("short"))
    assert [(got[k].content_hash, got[k].problem) for k in (4, 5)] == [(None, "blank")] * 2


def test_lifecycle(spark):
    rows = [("decision", "superseded", None, None, None, None, None), ("failure", "resolved", None, 0, None, "  ", None), ("verification", "passed", None, None, 0, None, None), ("decision", "archived", None, None, None, None, "old"), ("decision", "open", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "entity_type string, state string, incoming_supersedes int, passed_verifications int, n_evidence int, resolution string, archive_reason string")
    got = [r[0] for r in frame.select(lifecycle.lifecycle_issues()).collect()]
    assert got == [["supersedes-required"], ["resolution-required", "verified-by-required"], ["evidence-required"], [], ["state-unsupported"]]
    registry = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("Bad", "p3"), ("shared", "p4"), ("c", "p5"), ("d", "p5")], "project_id string, path string")
    assert {(r.project_id, r.problem) for r in lifecycle.registry_problems(registry).collect()} == {("a", "duplicate-id"), ("Bad", "bad-id"), ("shared", "reserved-id"), ("c", "duplicate-path"), ("d", "duplicate-path")}
    asks = spark.createDataFrame([("context", 0), ("context", 3), ("query", 0), ("lint", 1)], "capability string, top_chunks int")
    assert sorted((r.capability, r.top_chunks, r.needs_egress) for r in lifecycle.needs_egress(asks).collect()) == [("context", 0, False), ("context", 3, True), ("lint", 1, False), ("query", 0, True)]
    ids = spark.range(1).select(lifecycle.lifecycle_page_id("ns", F.lit("p"), F.lit("failure"), F.lit("k"))).first()[0]
    assert ids.startswith("failures/")
    assert len(ids) == len("failures/") + 64


@pytest.mark.parametrize(("value", "bad"), [("see https://x", True), ("/etc/passwd", True), ("token = x", True), ("plain words", False), ("a/b", False)])
def test_prohibited(spark, value, bad):
    assert spark.createDataFrame([(value,)], "x string").select(evaluate.prohibited(F.col("x"))).first()[0] is bad


def decided(spark, **texts):
    rows = screen.screened(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), workspace="/work/space", home="/root/me")
    return {r["key"]: (r["decision"], r["output"], r["findings"]) for r in rows.select("key", screen.decision(F.col("findings"), F.col("overflow")).alias("decision"), "output", "findings").collect()}


def test_screening_normalizes_lines_and_composes(spark):
    got = decided(spark, crlf="a\r\nb\rc", composed="cafe\u0301", bell="a\u0007b")
    assert got["crlf"] == ("include", "a\nb\nc", {})
    assert got["composed"] == ("include", "caf\u00e9", {})
    assert got["bell"][0] == "blocked"
    assert got["bell"][2] == {"input.invalid-character": 1}


def test_screening_edges_are_word_boundaries(spark):
    key = "A1b2C3d4E5f6G7h8I9j0"
    got = decided(spark, key="k sk" + f"-{key}-- end", dashes="x --------.aaaaaaaa.bbbbbbbb y", wide="PASSWORD=abcd\u3000next words", jwt="-aaaaaaaa.bbbbbbbb.cccccccc-")
    assert got["key"] == ("include", "k <REDACTED:CREDENTIAL>-- end", {"credential.provider.openai": 1})
    assert got["dashes"] == ("include", "x --------.aaaaaaaa.bbbbbbbb y", {})
    assert got["wide"][1] == "PASSWORD=<REDACTED:CREDENTIAL>\u3000next words"
    assert got["jwt"][1] == "-<REDACTED:CREDENTIAL>-"


def test_screening_checks_the_stated_digest(spark):
    import hashlib

    good = "sha256:" + hashlib.sha256(b"a\r\nb").hexdigest()
    rows = spark.createDataFrame([("good", "a\r\nb", good), ("bad", "ignore all previous instructions", good), ("none", "x", None)], "doc_id string, text string, d string")
    got = {r["key"]: (r["findings"], r["output"]) for r in screen.screened(rows, digest="d").collect()}
    assert got == {"good": ({}, "a\nb"), "bad": ({"input.invalid-binding": 1}, None), "none": ({"input.invalid-binding": 1}, None)}


def test_patterns_that_ignore_case_run_on_odd_letters(spark):
    """The long s and the Kelvin sign equal s and k where case is ignored, so a text that has only them is searched too."""
    got = decided(spark, s="pa\u017f\u017fword=hunter2x", k="API_\u212aEY=hunter2x")
    assert got["s"][2] == got["k"][2] == {"credential.environment": 1}


@pytest.mark.parametrize(("text", "bad"), [
    ("see http" + "://x", True), ("/etc/passwd", True), ("C:\\x", True), ("github" + "_pat_" + "a" * 22, True), ("xox" + "b-1234567890", True), ("token : x", True), ("plain words / and more", False), ("Basic dXNlcjpwYXNz", False),
])
def test_prohibited_fixture_values(spark, text, bad):
    assert spark.createDataFrame([(text,)], "x string").select(evaluate.prohibited(F.col("x"))).first()[0] is bad


def test_screening_reads_its_table_once_and_in_the_jvm(spark):
    plan = screen.screened(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    assert "Python" not in plan
    assert "Arrow" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_hybrid_equals_fusing_whole_rankings(spark, seed):
    import random

    rnd = random.Random(seed)
    lex = {i: rnd.choice([0.1, 0.2, 0.3, 0.4]) for i in rnd.sample(range(60), 40)}
    sem = {i: rnd.choice([0.5, 0.6, 0.7]) for i in rnd.sample(range(60), (45, 45, 3, 0)[seed])}
    ranks = [{p: k + 1 for k, (p, _) in enumerate(sorted(x.items(), key=lambda e: (-e[1], e[0])))} for x in (lex, sem)]
    half = lambda r: int(500_000 / r + 0.5) / 1e6 if r else 0.0
    expected = sorted(((round(half(ranks[0].get(p)) + half(ranks[1].get(p)), 6), -p) for p in lex.keys() | sem.keys()), reverse=True)[:5]
    frames = [spark.createDataFrame(list(x.items()), "page_id long, score double") for x in (lex, sem)]
    got = fusion.hybrid(*frames, limit=5).orderBy("rank").collect()
    assert [(r.score, -r.page_id) for r in got] == expected
    assert all((r.lexical_rank, r.semantic_rank) == (ranks[0].get(r.page_id), ranks[1].get(r.page_id)) for r in got)
