import hashlib
import json

from tarnfield.operators import eligibility, planning

SCHEMAS = {"spec": "app.spec.v1", "intake": "app.intake.v1", "current_spec": "app.current_spec.v1", "iteration": "app.iteration_metadata.v1"}
INTAKE = {
    "schema_version": "app.intake.v1", "idea": "i", "summary": "s", "known_facts": ["f"], "assumptions": [], "clarifying_questions": [], "needs_user_decision": [], "status": "ready_for_spec", "evidence": [],
}
LATE = "2024-05-01T00:00:00.000Z"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Project:
    """A project with one archived and one active iteration, in which everything is right."""

    def __init__(self, name="p"):
        self.name, self.files, self.ledger, self.closed, self.over = name, {}, [], [], {}
        self.current = {"schema_version": "app.current_spec.v1", "project_id": name, "active_iteration": "two"}
        self.add("one", "archived")
        self.add("two", "gate_b_approved")

    def add(self, i, status, spec=None, intake=None, meta=None, closed=None, approve=("spec", "intake")):
        at = f"iterations/{i}"
        intake_text = json.dumps(INTAKE | (intake or {}))
        spec_text = json.dumps({
            "schema_version": "app.spec.v1", "project_id": self.name, "approval": "approved", "source_intake": "../gate-a-intake/intake.json", "source_intake_sha256": sha(intake_text),
            "clarifying_question_disposition": [], "evidence": [], "open_decisions": [], "implementation": {k: ["x"] for k in planning.IMPLEMENTATION_KEYS}, "product": {k: [] for k in planning.PRODUCT_KEYS} | {"problem": "why"},
        } | (spec or {}))
        texts = {f"{at}/gate-b-spec/spec.json": spec_text, f"{at}/gate-a-intake/intake.json": intake_text, f"{at}/gate-c-task-graph/task-graph.json": "{}"}
        record = {
            "iteration_id": i, "status": "archived", "closed_at": "2024-03-01T00:00:00Z", "spec_ref": f"{at}/gate-b-spec/spec.json", "task_graph_ref": f"{at}/gate-c-task-graph/task-graph.json",
            "task_status_counts": {"blocked": 0, "done": 1, "in_progress": 0, "todo": 0}, "artifact_hashes": {p: {"present": True, "sha256": sha(t)} for p, t in texts.items()},
        } | (closed or {})
        body = {"schema_version": "app.iteration_metadata.v1", "project_id": self.name, "iteration_id": i, "status": status}
        if status == "archived":
            self.closed.append(record)
            body |= {"closed_at": record["closed_at"], "close": dict(reversed(record.items()))}
        self.files |= texts | {f"{at}/iteration.json": json.dumps(body | (meta or {}))}
        for n, kind in enumerate(approve):
            path = f"{at}/gate-{'b-spec' if kind == 'spec' else 'a-intake'}/{kind}.json"
            self.ledger.append(("gate.what.approved", path, sha(texts[path]), f"2024-0{n + 1}-01T00:00:00Z"))

    def texts(self):
        return self.files | {"current-spec.json": json.dumps(self.current | {"closed_iterations": self.closed}), "decisions.jsonl": ""} | self.over

    def odd(self, spark, **how):
        """{(path, kind): (decision, reason, at_source)}."""
        return {(r.path and r.path.removeprefix("iterations/"), r.kind): (r.decision, r.reason, r.at_source) for r in entries(spark, [self], **how)}


def entries(spark, projects, explicit=None, revised=()):
    files = [(p.name, path, text, LATE if path in revised else None) for p in projects for path, text in p.texts().items() if text != "gone"]
    ledger = [(p.name, n, *r) for p in projects for n, r in enumerate(p.ledger)]
    files = spark.createDataFrame(files, "project_id string, path string, text string, revised_at string")
    return eligibility.planning_entries(files, spark.createDataFrame(ledger, "project_id string, sequence long, record_type string, scope string, sha256 string, at string"), SCHEMAS, explicit).collect()


SPEC, TAKE = "gate-b-spec/spec.json", "gate-a-intake/intake.json"


def test_all_kept(spark):
    p = Project()
    got = p.odd(spark)
    for i in ("one", "two"):
        assert got.pop((f"{i}/{SPEC}", "product-spec")) == got.pop((f"{i}/{SPEC}", "implementation-plan")) == got.pop((f"{i}/{TAKE}", "intake")) == ("include", None, "approval")
        assert got.pop((f"{i}/gate-c-task-graph/task-graph.json", None)) == ("exclude", "task_or_run", None)
    assert got.pop(("one/iteration.json", "archived-iteration")) == ("include", None, "close")
    assert got.pop(("two/iteration.json", None)) == ("exclude", "pending_iteration", None)
    assert set(got) == {("current-spec.json", None), ("decisions.jsonl", None)}
    assert {r.at for r in entries(spark, [p])} == {None, "2024-01-01T00:00:00.000Z", "2024-02-01T00:00:00.000Z", "2024-03-01T00:00:00.000Z"}


def test_every_reason(spark):
    p = Project()
    p.files["runs/run-1.json"] = "{}"
    p.add("draft", "archived", spec={"approval": "draft"})
    p.add("open", "archived", spec={"open_decisions": [1]})
    p.add("early", "gate_a")
    p.add("foreign", "archived", spec={"schema_version": "other"})
    p.add("view", "archived", spec={"product": {}})
    p.add("none", "archived", approve=("intake",))
    p.add("revoked", "archived")
    p.ledger.append(("gate.what.revoked", f"iterations/revoked/{SPEC}", None, None))
    p.add("stale", "archived")
    p.ledger.append(("scope.added", f"iterations/stale/{SPEC}", "0" * 64, "2024-01-01T00:00:00Z"))
    p.ledger.append(("note", f"iterations/one/{SPEC}", "0" * 64, "2024-01-01T00:00:00Z"))
    p.add("badtake", "archived", intake={"status": "odd"})
    p.add("notake", "archived", approve=("spec",))
    p.add("bothtake", "archived", intake={"status": "odd"}, approve=("spec",))
    p.add("other", "archived", spec={"source_intake_sha256": "0" * 64})
    p.add("where", "archived", spec={"source_intake": "intake.json"})
    p.add("unclosed", "archived")
    p.closed.pop()
    p.add("idle", "gate_b_approved")
    p.add("counts", "archived", closed={"task_status_counts": {"done": 1}})
    p.add("ref", "archived", closed={"spec_ref": "x"})
    p.add("hash", "archived", closed={"artifact_hashes": {}})
    p.add("close", "archived", meta={"close": {}})
    p.add("when", "archived", meta={"closed_at": "2024-03-01T00:00:01Z"})
    p.add("Odd_id", "archived")
    p.add("a" * 121, "archived")
    p.add("maintenance", "archived")
    p.add("nospec", "archived")
    p.files[f"iterations/nospec/{SPEC}"] = "gone"
    p.add("nointake", "archived")
    p.files[f"iterations/nointake/{TAKE}"] = "gone"
    p.add("text", "archived")
    p.files[f"iterations/text/{SPEC}"] = "{"
    p.add("null", "archived")
    p.files[f"iterations/null/{TAKE}"] = None
    p.add("extra", "archived", meta={"more": 1})
    p.add("graph", "archived")
    p.files["iterations/graph/gate-c-task-graph/task-graph.json"] = '{"a": 1}'
    p.files[f"iterations/stray/{SPEC}"] = "{}"
    got = p.odd(spark)
    at = lambda i, file, kind=None: got[(f"{i}/{file}", kind)][:2]
    for i, want in {
        "draft": ("exclude", "draft"), "open": ("exclude", "draft"), "early": ("exclude", "draft"), "foreign": ("error", "unsupported_schema"), "view": ("error", "unsupported_schema"), "none": ("error", "approval_invalid"),
        "revoked": ("error", "approval_invalid"), "stale": ("error", "approval_invalid"), "idle": ("exclude", "draft"), "Odd_id": ("exclude", "generated_artifact"), "a" * 121: ("exclude", "generated_artifact"),
        "maintenance": ("exclude", "maintenance"), "nointake": ("error", "lineage_invalid"), "text": ("error", "unsupported_schema"), "null": ("error", "unsupported_schema"), "extra": ("error", "unsupported_schema"), "stray": ("exclude", "generated_artifact"),
    }.items():
        assert at(i, SPEC) == want, i
        assert (f"{i}/{SPEC}", "product-spec") not in got
        if (f"{i}/{TAKE}", None) in got:
            assert at(i, TAKE)[0] == "exclude", i
    for i, want in {"badtake": "unsupported_schema", "notake": "approval_invalid", "bothtake": "approval_invalid", "other": "lineage_invalid", "where": "lineage_invalid"}.items():
        assert at(i, TAKE) == ("error", want) and at(i, SPEC, "product-spec") == ("include", None) and at(i, "iteration.json", "archived-iteration") == ("include", None), i
    for i in ("unclosed", "counts", "ref", "hash", "close", "when", "graph"):
        assert at(i, "iteration.json") == ("error", "lineage_invalid") and at(i, SPEC, "implementation-plan") == at(i, TAKE, "intake") == ("include", None), i
    assert at("Odd_id", "iteration.json") == at("a" * 121, "iteration.json") == ("error", "unsupported_schema")
    assert at("nospec", "iteration.json") == at("nointake", "iteration.json") == ("error", "lineage_invalid")
    assert at("maintenance", "iteration.json") == ("exclude", "maintenance") and at("one", SPEC, "product-spec") == ("include", None)
    assert got[("runs/run-1.json", None)][:2] == ("exclude", "task_or_run")


def test_times(spark):
    p = Project()
    p.ledger = [(kind, scope, digest, "soon") for kind, scope, digest, _ in p.ledger]
    p.add("three", "archived", meta={"promoted_at": "2024-04-01T00:00:00Z"}, closed={"closed_at": "later"})
    got = p.odd(spark, revised={f"iterations/two/{TAKE}", f"iterations/three/{SPEC}"})
    assert got[(f"one/{SPEC}", None)] == got[(f"one/{TAKE}", None)] == got[("three/iteration.json", None)] == ("error", "timestamp_unavailable", None)
    assert got[(f"two/{TAKE}", "intake")] == ("include", None, "revision") and got[(f"three/{SPEC}", "product-spec")] == ("include", None, "approval")
    p.ledger = [(kind, scope, digest, "soon") for kind, scope, digest, _ in p.ledger]
    got = p.odd(spark, explicit="2024-06-01T02:00:00+02:00", revised={f"iterations/three/{SPEC}"})
    assert got[(f"three/{SPEC}", "product-spec")][2] == "promotion" and got[("three/iteration.json", "archived-iteration")][2] == got[(f"one/{SPEC}", "product-spec")][2] == "explicit"
    # A closed record of what is no archive.
    p = Project()
    p.closed.append(p.closed[0] | {"iteration_id": "two"})
    got = p.odd(spark)
    assert got[("two/iteration.json", None)][:2] == ("error", "lineage_invalid") and (f"two/{SPEC}", "product-spec") in got


def test_refused_projects(spark):
    cases = [
        lambda p: setattr(p, "over", {"decisions.jsonl": "gone"}), lambda p: setattr(p, "over", {"current-spec.json": "gone"}), lambda p: setattr(p, "over", {"current-spec.json": None}), lambda p: p.current.update(more=1),
        lambda p: p.current.update(active_iteration="lost"), lambda p: p.current.update(active_iteration=2), lambda p: p.closed.append(p.closed[0]), lambda p: p.closed.append({"iteration_id": "lost"}),
        lambda p: p.closed.append({"more": 1, "iteration_id": "two"}), lambda p: p.closed.append({}), lambda p: p.current.update(project_id="q"), lambda p: p.current.update(active_iteration=None),
    ]
    projects = [Project(f"p{i}") for i in range(len(cases))]
    for p, change in zip(projects, cases, strict=True):
        change(p)
    got = {}
    for r in entries(spark, projects):
        got.setdefault(r.project_id, []).append((r.path, r.kind, r.decision, r.reason))
    for i in range(10):
        assert got[f"p{i}"] == [(None, None, "error", "unsupported_schema")], i
    assert got["p10"] == [(None, None, "error", "project_mismatch")]
    # No active iteration is fine.
    assert (f"iterations/two/{SPEC}", None, "exclude", "draft") in got["p11"] and (f"iterations/one/{SPEC}", "product-spec", "include", None) in got["p11"]
    assert entries(spark, []) == []


def test_an_artifact_is_parsed_once(spark):
    rows = spark.createDataFrame([("p", "iterations/i/iteration.json", "{}", None)], "project_id string, path string, text string, revised_at string")
    schemas = {"spec": "s", "intake": "i", "current_spec": "c", "iteration": "m"}
    for found in (eligibility._facts(rows, schemas), eligibility._current(rows, schemas)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
