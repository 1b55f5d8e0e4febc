import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import planning

SPEC = {
    "schema_version": "app.spec.v1", "project_id": "p", "approval": "approved", "source_intake": "i", "source_intake_sha256": "a" * 64, "clarifying_question_disposition": [], "evidence": [], "open_decisions": [],
    "implementation": {k: ["x"] for k in planning.IMPLEMENTATION_KEYS}, "product": {k: [] for k in planning.PRODUCT_KEYS} | {"problem": "why"},
}
DECISION = {"id": "ND-1", "question": "q", "options": [{"id": "a", "label": "l", "description": "d"}] * 2, "impact": "i", "default": "d", "status": "open"}
INTAKE = {
    "schema_version": "app.intake.v1", "idea": "i", "summary": "s", "known_facts": ["f"], "assumptions": [{"id": "A-1", "statement": "s", "risk": "low", "confirmation_needed": False}],
    "clarifying_questions": [{"id": "CQ-1", "question": "q", "why_it_matters": "w", "blocks": []}], "needs_user_decision": [DECISION], "status": "ready_for_spec", "evidence": [{"source_id": "WEB-1", "title": "t", "url": "", "used_for": "u"}],
}


def problems(spark, rule, *texts):
    frame = spark.createDataFrame([(i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "n int, t string")
    return [r.p for r in frame.select("n", rule(F.col("t")).alias("p")).orderBy("n").collect()]


def test_specs(spark):
    rule = lambda t: planning.spec_problem(t, F.lit("p"), "app.spec.v1")
    got = problems(
        spark, rule, SPEC, SPEC | {"extra": 1}, SPEC | {"project_id": "q"}, SPEC | {"approval": "draft"}, SPEC | {"open_decisions": [1]}, SPEC | {"source_intake_sha256": "A" * 64}, SPEC | {"evidence": {}},
        SPEC | {"product": SPEC["product"] | {"problem": ["x"]}}, SPEC | {"product": SPEC["product"] | {"goals": [1]}}, SPEC | {"implementation": {}}, "[]", "{",
    )
    assert got == [None, "keys", *["not-eligible"] * 5, *["view"] * 3, "keys", "keys"]


@pytest.mark.parametrize(("change", "problem"), [
    ({}, None), ({"more": 1}, "keys"), ({"idea": ""}, "schema"), ({"known_facts": [None]}, "facts"), ({"known_facts": []}, None), ({"assumptions": [INTAKE["assumptions"][0] | {"risk": "odd"}]}, "assumptions"),
    ({"assumptions": [INTAKE["assumptions"][0] | {"confirmation_needed": "no"}]}, "assumptions"), ({"clarifying_questions": [INTAKE["clarifying_questions"][0] | {"status": "answered", "answer": ""}]}, None),
    ({"clarifying_questions": [INTAKE["clarifying_questions"][0] | {"status": "odd"}]}, "questions"), ({"needs_user_decision": [DECISION | {"options": DECISION["options"][:1]}]}, "decisions"),
    ({"needs_user_decision": [DECISION | {"affected_fields": ["spec.product.goals"], "supersedes": [{"field_ref": "spec.product.goals", "baseline_value": "b"}], "answer": "x"}]}, None),
    ({"needs_user_decision": [DECISION | {"supersedes": []}]}, "decisions"), ({"needs_user_decision": [DECISION | {"answer": ""}]}, "decisions"), ({"needs_user_decision": [DECISION | {"affected_fields": ["other"]}]}, "decisions"),
    ({"status": "done"}, "status"), ({"evidence": [INTAKE["evidence"][0] | {"source_id": "X-1"}]}, "evidence"), ({"evidence": []}, None),
])
def test_intakes(spark, change, problem):
    assert problems(spark, lambda t: planning.intake_problem(t, "app.intake.v1"), INTAKE | change) == [problem]


def test_other_artifacts(spark):
    current = {"schema_version": "app.current_spec.v1", "project_id": "p", "closed_iterations": []}
    assert problems(spark, lambda t: planning.current_spec_problem(t, F.lit("p"), "app.current_spec.v1"), current, current | {"closed_iterations": None}, current | {"x": 1}) == [None, "schema", "keys"]
    iteration = {"schema_version": "app.iteration_metadata.v1", "project_id": "p", "iteration_id": "i"}
    rule = lambda t: planning.iteration_problem(t, F.lit("p"), F.lit("i"), "app.iteration_metadata.v1")
    assert problems(spark, rule, iteration, iteration | {"idea": ""}, iteration | {"iteration_id": "j"}, iteration | {"x": 1}) == [None, "schema", "schema", "keys"]
    assert problems(spark, planning.closed_iteration_problem, {"status": 1}, {"x": 1}, {}) == [None, "keys", None]
    counts = {"blocked": 0, "done": 3, "in_progress": 0, "todo": 1}
    assert problems(spark, planning.task_counts_valid, counts, counts | {"done": -1}, counts | {"done": 1.5}, counts | {"done": "1"}, {"done": 1}, counts | {"x": 1}) == [True, False, False, False, False, False]


def test_profiles(spark):
    digest = "sha256:" + hashlib.sha256(b"src").hexdigest()
    rows = [
        (False, None, None, None, None, False, False), (False, None, "P", None, None, False, False), (False, None, None, "odd", None, False, False), (False, None, None, "C", None, False, False),
        (True, "src", "P", "C", digest, True, True), (True, "src", "P", "C", digest, True, False), (True, "src", "P", "odd", digest, True, True), (True, "src", "P", "C", "sha256:other", False, True),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, bound boolean, source string, profile string, config string, hash string, hm boolean, lm boolean")
    wanted = (F.lit("P"), F.lit("C"))
    out = frame.select("n", planning.profile_disposition(F.col("bound"), F.col("profile"), F.col("config"), *wanted, F.col("hm"), F.col("lm"), "app").alias("d"), planning.profile_binding(F.col("bound"), F.col("source"), F.col("profile"), F.col("config"), F.col("hash"), *wanted, F.col("lm")).alias("b")).orderBy("n").collect()
    assert [(r.d.disposition, r.d.reasons) for r in out] == [
        ("compatible-recompile", ["default-to-app"]), ("migration-required", ["foreign-profile"]), ("migration-required", ["foreign-config"]), ("compatible-recompile", ["default-to-app"]),
        ("unchanged", ["already-applied"]), ("compatible-recompile", ["language-update"]), ("migration-required", ["materialized-drift"]), ("compatible-recompile", ["language-update"]),
    ]
    assert [r.b for r in out] == ["default", "drift", "default", "default", "custom", "drift", "drift", "drift"]
