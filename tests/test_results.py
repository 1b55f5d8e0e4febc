import copy
import json

import pytest

from tarnfield.operators import results

PAGE = {"id": "d/p", "chunks": [{"text": "x"}], "reasons": ["hit"], "score": 0.5, "summary": "s", "title": "t"}
GOOD = {
    "compile": {"errors": [], "compiled": 1, "deleted": 0, "skipped": 2.0, "concepts": [], "pages": ["z", "a/가", "z/\U0001f600", "z/￮"], "candidates": ["x-y-0123abcd"], "review": {"held": [], "forced": [{"id": "x-y-0123abcd", "slug": "x-y", "reasons": ["all", "contradicted"]}]}},
    "context": {"version": 1, "budget": {"estimatedTokens": 1, "requestedTokens": 2, "truncated": False}, "primary": [PAGE], "gaps": [{"code": "gone", "pageId": "d/q"}], "warnings": [{"code": "w.1"}]},
    "eval-fast": {"suite": "fast", "health": {"score": 100, "pendingReviews": 0}, "citationCoverage": {"coveragePercent": 0, "precisionPercent": 99.5}, "stats": {"pageCount": 1, "sourceCount": 1, "embeddingsAvailable": False}, "thresholdViolations": [{}]},
    "lint": {"results": [{"file": "b/c.md", "rule": "r", "severity": "error"}, {"file": "a.md", "rule": "r", "severity": "info", "line": 0}], "errors": 1, "info": 1, "warnings": 0},
    "query": {"pageIds": ["d/a", "d/b"], "refs": [{"pageId": "d/a", "slug": "a"}, {"pageId": "d/b", "slug": "b"}], "selectedPages": ["a", "b"], "answer": "so"},
    "search": {"pages": [{"slug": "a", "title": "", "summary": ""}], "refs": [{"kind": "page", "pageId": "d/a", "slug": "a", "title": "t"}]},
    "status": {"pendingChanges": [{"file": "b.md", "status": "new"}, {"file": "a.md", "status": "deleted"}], "pendingChangesCount": 3, "stateStatus": "ok", "pages": {"total": 4}, "stalePages": ["a"], "staleCount": 1, "orphanedPages": [], "orphanedCount": 0, "lastCompiledAt": None, "pendingCandidates": 0, "sources": 1},
}
GOOD["eval-full"] = GOOD["eval-fast"] | {"suite": "full", "citationSupport": {"judgeErrors": 0, "meanScore": 2}}
GONE = object()
# (capability, path, value, status, detail)
BAD = [
    ("compile", "errors", ["e"], "failed", "errors"), ("compile", "errors", "e", "contract", "errors"), ("compile", "compiled", 1.5, "contract", "compiled"), ("compile", "deleted", -1, "contract", "deleted"), ("compile", "skipped", 2**53, "contract", "skipped"),
    ("compile", "concepts", GONE, "contract", "concepts"), ("compile", "pages", ["a/b/c"], "contract", "pages"), ("compile", "pages", ["z", "concepts/z"], "contract", "pages:repeated"), ("compile", "pages", [f"p{i}" for i in range(101)], "contract", "pages"),
    ("compile", "candidates", ["x-0123abcg"], "contract", "candidates"), ("compile", "candidates", None, "contract", "candidates"), ("compile", "candidates", GONE, "contract", "review:other-ids"), ("compile", "review", GONE, "contract", "review"), ("compile", "review", [], "contract", "review"),
    ("compile", "review.forced.0.slug", "x", "contract", "review.forced"), ("compile", "review.forced.0.reasons", ["all", "all"], "contract", "review.forced"), ("compile", "review.forced.0.reasons", [], "contract", "review.forced"), ("compile", "review.held", GONE, "contract", "review.held"),
    ("context", "version", "1", "contract", "version"), ("context", "warnings", [{"code": "query-embedding-unavailable"}], "provider-unavailable", "warnings"), ("context", "warnings", [{"code": "semantic-retrieval-error"}], "failed", "warnings"), ("context", "warnings", None, "contract", "warnings"),
    ("context", "budget", [], "contract", "budget"), ("context", "primary.0.score", "1", "contract", "primary"), ("context", "primary", [PAGE] * 51, "contract", "primary"), ("context", "primary.0.chunks", [{"text": "\U0001f600" * 16000}] * 3, "contract", "primary:total"), ("context", "primary.0.chunks.0.text", "a\u0000", "contract", "primary"),
    ("context", "gaps.0.code", "Gone", "contract", "gaps"), ("context", "budget.truncated", "no", "contract", "budget.truncated"), ("context", "budget.requestedTokens", None, "contract", "budget.requestedTokens"),
    ("eval-fast", "suite", "full", "contract", "suite"), ("eval-fast", "citationSupport", {}, "contract", "citationSupport"), ("eval-full", "citationSupport", GONE, "contract", "citationSupport"), ("eval-full", "citationSupport.judgeErrors", 2, "failed", "citationSupport.judgeErrors"),
    ("eval-full", "citationSupport.meanScore", 2.1, "contract", "citationSupport.meanScore"), ("eval-fast", "citationCoverage.coveragePercent", 100.5, "contract", "citationCoverage.coveragePercent"), ("eval-fast", "stats.embeddingsAvailable", 1, "contract", "stats.embeddingsAvailable"), ("eval-fast", "thresholdViolations", {}, "contract", "thresholdViolations"),
    ("lint", "results.0.file", "/a", "contract", "results"), ("lint", "results.0.file", "a/../b", "contract", "results"), ("lint", "results.0.file", "c:d", "contract", "results"), ("lint", "results.1.line", -1, "contract", "results"), ("lint", "results.0.rule", "R", "contract", "results"), ("lint", "results.0", "x", "contract", "results"),
    ("lint", "errors", 2, "contract", "errors:total"), ("lint", "info", 0, "contract", "info:total"), ("lint", "warnings", 1, "contract", "warnings:total"), ("lint", "results.0.severity", "fatal", "contract", "results"),
    ("query", "saved", False, "contract", "saved"), ("query", "debug", None, "contract", "debug"), ("query", "pageIds", ["d/a"], "contract", "refs:number"), ("query", "selectedPages", ["b", "a"], "contract", "refs:slug"), ("query", "answer", "  \n", "contract", "answer"), ("query", "answer", "x" * 16385, "contract", "answer"), ("query", "pageIds.0", "A/a", "contract", "pageIds"),
    ("search", "refs", [], "contract", "refs:number"), ("search", "refs.0.kind", "word", "contract", "refs"), ("search", "pages.0.slug", "b", "contract", "refs:slug"), ("search", "pages.0.title", "t" * 513, "contract", "pages"), ("search", "warnings", [{"code": "A"}], "contract", "warnings"),
    ("status", "pendingChanges.0.file", "a/b.md", "unsafe-item", "pendingChanges"), ("status", "pendingChanges.0.status", "moved", "unsafe-item", "pendingChanges"), ("status", "pendingChanges.0.file", 1, "contract", "pendingChanges"), ("status", "pendingChanges.0.file", "a.md", "contract", "pendingChanges:repeated"),
    ("status", "pendingChangesCount", 1, "contract", "pendingChangesCount:fewer"), ("status", "stateStatus", "fine", "contract", "stateStatus"), ("status", "stateStatus", "corrupt", "contract", "stateStatus:pending"), ("status", "lastCompiledAt", "2023-02-29T00:00:00.000Z", "contract", "lastCompiledAt"),
    ("status", "lastCompiledAt", "2024-02-29T00:00:00Z", "contract", "lastCompiledAt"), ("status", "lastCompiledAt", GONE, "contract", "lastCompiledAt"), ("status", "staleCount", 0, "contract", "staleCount:fewer"), ("status", "orphanedPages", [".."], "contract", "orphanedPages"), ("status", "pages", {}, "contract", "pages.total"),
]


def changed(body, path, value):
    out, *steps = copy.deepcopy(body), *(int(s) if s.isdigit() else s for s in path.split("."))
    node = out
    for step in steps[:-1]:
        node = node[step]
    if value is GONE:
        del node[steps[-1]]
    else:
        node[steps[-1]] = value
    return out


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"good-{c}", c, json.dumps(b)) for c, b in GOOD.items()] + [(f"bad-{i}", c, json.dumps(changed(GOOD[c], p, v))) for i, (c, p, v, _, _) in enumerate(BAD)]
    rows += [("null", "lint", None), ("list", "lint", "[]"), ("cut", "lint", "{"), ("other", "deploy", "{}"), ("none", None, "{}"), ("twice", "lint", json.dumps(GOOD["lint"])), ("twice", "lint", json.dumps(GOOD["lint"]))]
    rows += [("unchanged", "compile", json.dumps(changed(GOOD["compile"], "compiled", 0))), ("dated", "status", json.dumps(changed(GOOD["status"], "lastCompiledAt", "2024-02-29T23:59:59.999Z")))]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "result_id string, capability string, body string, status string")
    return [r for r in results.normalized_results(frame).collect()]


def test_accepted_results(judged):
    got = {r.result_id: r for r in judged if r.status == "ok"}
    assert {r for r in got if not r.startswith("good-")} == {"twice", "unchanged", "dated"} and sum(r.result_id == "twice" for r in judged) == 2
    assert {c for c in GOOD if f"good-{c}" in got} == set(GOOD)
    items = {c: got[f"good-{c}"].items for c in GOOD}
    # By UTF-16 units a surrogate pair comes before U+FFEE.
    assert got["good-compile"]["items"] == ["a/가", "concepts/z", "z/\U0001f600", "z/￮"], items
    assert got["good-lint"]["items"] == ["a.md", "b/c.md"] and got["good-status"]["items"] == ["a.md", "b.md"] and got["good-query"]["items"] == ["d/a", "d/b"] and got["good-eval-full"]["items"] == []
    assert got["good-lint"].counts == {"errors": 1, "info": 1, "warnings": 0} and got["good-compile"].counts == {"compiled": 1, "deleted": 0, "skipped": 2, "candidates": 1}
    assert got["good-context"].warnings == ["w.1"] and got["unchanged"].outcome == "unchanged" and got["good-compile"].outcome == "succeeded"


def test_refused_results(judged):
    got = {r.result_id: (r.status, r.detail) for r in judged}
    wrong = [(case[:3], got[f"bad-{i}"]) for i, case in enumerate(BAD) if got[f"bad-{i}"] != case[3:]]
    assert not wrong
    assert [got[k] for k in ("null", "list", "cut", "other", "none")] == [("unreadable", None)] * 3 + [("unknown-capability", None)] * 2
    assert all(r.outcome is r["items"] is r.counts is r.warnings is None for r in judged if r.status != "ok")


def test_no_results(spark):
    assert results.normalized_results(spark.createDataFrame([], "result_id string, capability string, body string")).count() == 0


def test_checks_share_what_they_read(spark):
    """No check takes a field out of the body, or a field's members out of it, for itself."""
    for contract in results._contracts().values():
        told = str(contract.told())
        assert "_body" not in told
        fields, members, _ = contract.shared()
        assert not any(text in results._members_named(x, members) for text in members.values() for *_, x in contract.checks if isinstance(x, str))
        assert len(set(fields.values())) == len(fields)
