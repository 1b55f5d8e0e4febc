"""Which planning artifacts are kept, worked out from the artifacts themselves, for any number of projects at once.

Every file is parsed where it lies and leaves a few short facts; those of an iteration, its closed record, its approvals and
whether it is the active one meet in one aggregate by project and iteration, so that texts aren't shuffled and a project
with most of the iterations still spreads over all tasks. One ordered rule a document then gives its decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import history, planning, select
from tarnfield.operators.planning import _get, _items, _kind, _text
from tarnfield.operators.projection import DOCUMENT_PATHS, TASK_GRAPH_PATH

# Files a project must have, what an iteration's id looks like, and the statuses that may be kept.
CURRENT_SPEC, LEDGER = "current-spec.json", "decisions.jsonl"
ITERATION_ID, MOST_ID = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z", 120
MAINTENANCE = "maintenance"
ARCHIVED, APPROVED = "archived", "gate_b_approved"
REVOKED = "gate.what.revoked"
INTAKE_REFERENCE = "../gate-a-intake/intake.json"

_FILES = {
    "meta": DOCUMENT_PATHS["archived-iteration"],
    "spec": DOCUMENT_PATHS["product-spec"],
    "intake": DOCUMENT_PATHS["intake"],
    "graph": TASK_GRAPH_PATH,
}


def _none() -> Column:
    return F.lit(None).cast("string")


def _role(path: Column) -> Column:
    """Which file of an iteration a path is, or null."""
    below = F.regexp_extract(path, r"\Aiterations/[^/]+/(.*)\z", 1)
    role = _none()
    for name, file in _FILES.items():
        role = F.when(below == file, name).otherwise(role)
    return role


def _path(role: str) -> Column:
    return F.concat(F.lit("iterations/"), F.col("iteration"), F.lit(f"/{_FILES[role]}"))


def _object(x: Column) -> Column:
    return F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))


def _absent(x: Column) -> Column:
    return F.coalesce(_kind(x) == "VOID", F.lit(True))


def _no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _facts(files: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """project_id, iteration, role and one struct for each role, null but for the row's own."""
    text, x, role = F.col("text"), F.col("x"), _role(F.col("path"))
    project, iteration = F.col("project_id"), F.col("iteration")
    digest, revised = F.sha2(text, 256).alias("digest"), F.col("revised_at").alias("revised_at")
    status = _text(_get(x, "status"))
    foreign = _no((_text(_get(x, "schema_version")) == schemas["spec"]) & (_text(_get(x, "project_id")) == project))
    draft = _no((_text(_get(x, "approval")) == "approved") & (F.size(_items(_get(x, "open_decisions"))) == 0))
    of = {
        "meta": F.struct(
            planning.iteration_problem(text, project, iteration, schemas["iteration"], x).alias("problem"), status.alias("status"), _text(_get(x, "promoted_at")).alias("promoted_at"),
            F.to_json(_get(x, "closed_at")).alias("closed_at"), F.sha2(F.to_json(_get(x, "close")), 256).alias("close"), revised,
        ),
        "spec": F.struct(
            (~_object(x) | foreign).alias("foreign"), draft.alias("draft"), planning.spec_problem(text, project, schemas["spec"], x).alias("problem"),
            (_text(_get(x, "source_intake")) == INTAKE_REFERENCE).alias("refers"), _text(_get(x, "source_intake_sha256")).alias("intake"), digest, revised,
        ),
        "intake": F.struct(_object(x).alias("readable"), planning.intake_problem(text, schemas["intake"], x).alias("problem"), digest, revised),
        "graph": F.struct(digest),
    }
    # A task graph is only hashed. Parsed once, in a projection of its own.
    rows = files.where(role.isNotNull()).select("project_id", select.iteration_of(F.col("path")).alias("iteration"), role.alias("role"), "text", "revised_at")
    rows = rows.withColumn("x", F.when(F.col("role") != "graph", F.try_parse_json(text)))
    return rows.select("project_id", "iteration", "role", *(F.when(F.col("role") == name, facts).alias(name) for name, facts in of.items()))


def _current(files: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """project_id, ``x`` (the current specification) and ``problem``."""
    x = F.col("x")
    problem = (
        F.when(~_object(x), "unsupported_schema").when(_no(_text(_get(x, "project_id")) == F.col("project_id")), "project_mismatch")
        .when(planning.current_spec_problem(F.col("text"), F.col("project_id"), schemas["current_spec"], x).isNotNull(), "unsupported_schema")
    )
    rows = files.where(F.col("path") == CURRENT_SPEC).select("project_id", "text", F.try_parse_json(F.col("text")).alias("x"))
    return rows.select("project_id", "x", problem.alias("problem"))


def _closed(current: DataFrame) -> DataFrame:
    """The closed records as rows with the role ``closed``; the iteration is null where a record doesn't name one."""
    rows = current.where("problem is null").select("project_id", F.explode(_items(_get(F.col("x"), "closed_iterations"))).alias("c"))
    c = F.col("c")
    rows = rows.withColumns({"iteration": _text(_get(c, "iteration_id")), "hashes": F.try_variant_get(c, "$.artifact_hashes", "map<string, variant>")})

    def recorded(role: str) -> Column:
        entry = F.try_element_at(F.col("hashes"), _path(role))
        return F.when((_kind(_get(entry, "present")) == "BOOLEAN") & _get(entry, "present").cast("boolean"), _text(_get(entry, "sha256")))

    bound = (
        _yes(_text(_get(c, "task_graph_ref")) == _path("graph")) & _yes(_text(_get(c, "status")) == ARCHIVED) & _yes(_text(_get(c, "spec_ref")) == _path("spec"))
        & _yes(planning.task_counts_valid(F.to_json(_get(c, "task_status_counts"))))
    )
    facts = F.struct(
        planning.closed_iteration_problem(F.to_json(c)).alias("problem"), bound.alias("bound"), F.to_json(_get(c, "closed_at")).alias("closed_at"), _text(_get(c, "closed_at")).alias("at"),
        F.sha2(F.to_json(c), 256).alias("digest"), *(recorded(r).alias(r) for r in ("spec", "intake", "graph")),
    )
    return rows.select("project_id", "iteration", F.lit("closed").alias("role"), facts.alias("closed"))


def _active(current: DataFrame) -> DataFrame:
    named = _get(F.col("x"), "active_iteration")
    return current.where(F.col("problem").isNull() & ~_absent(named)).select("project_id", _text(named).alias("iteration"), F.lit("active").alias("role"))


def _approvals(ledger: DataFrame) -> DataFrame:
    """Approvals and revocations of specifications and intakes, as rows with the role ``spec-approval`` or ``intake-approval``."""
    rows = ledger.where(F.col("record_type").isin(*history.ACTIVE_TYPES, REVOKED)).withColumn("r", _role(F.col("scope"))).where(F.col("r").isin("spec", "intake"))
    facts = F.struct("sequence", "record_type", "sha256", "at")
    return rows.select("project_id", select.iteration_of(F.col("scope")).alias("iteration"), F.concat("r", F.lit("-approval")).alias("role"), facts.alias("approval"))


def _grouped(files: DataFrame, ledger: DataFrame, current: DataFrame, schemas: dict[str, str]) -> DataFrame:
    rows = _facts(files, schemas)
    for more in (_closed(current), _active(current), _approvals(ledger)):
        rows = rows.unionByName(more, allowMissingColumns=True)
    newest = lambda role: F.max_by("approval", F.when(F.col("role") == role, F.col("approval.sequence")))
    return rows.groupBy("project_id", "iteration").agg(
        *(F.max(name).alias(name) for name in (*_FILES, "closed")), F.count("closed").alias("n_closed"), F.max(F.col("role") == "active").alias("is_active"), F.max(F.col("role") == "meta").alias("has_meta"),
        newest("spec-approval").alias("spec_approval"), newest("intake-approval").alias("intake_approval"),
    )


def _refused(files: DataFrame, current: DataFrame, grouped: DataFrame) -> DataFrame:
    """(project_id, reason): projects of which nothing can be decided. Of ``grouped`` it needs what no artifact is parsed for."""
    there = files.groupBy("project_id").agg(*(F.max(F.col("path") == p).alias(n) for p, n in ((CURRENT_SPEC, "c"), (LEDGER, "l"))))
    reason = lambda rank, x: F.struct(F.lit(rank).alias("rank"), x.alias("reason"))
    lacking = there.where(~(F.col("c") & F.col("l"))).select("project_id", reason(0, F.lit("unsupported_schema")).alias("r"))
    wrong = current.where("problem is not null").select("project_id", reason(1, F.col("problem")).alias("r"))
    named = (F.col("n_closed") > 0) | F.col("is_active")
    loose = grouped.where((~F.col("has_meta") & named) | (F.col("n_closed") > 1) | F.col("closed.problem").isNotNull())
    loose = loose.select("project_id", reason(2, F.lit("unsupported_schema")).alias("r"))
    return lacking.unionByName(wrong).unionByName(loose).groupBy("project_id").agg(F.min("r")["reason"].alias("reason"))


def _entry(path: Column | None, decision: str, reason: Column | None, kind: Column | None = None, at: Column | None = None, source: Column | None = None) -> Column:
    fields = {"path": path, "kind": kind, "decision": F.lit(decision), "reason": reason, "at": at, "at_source": source}
    return F.struct(*((_none() if v is None else v.cast("string")).alias(k) for k, v in fields.items()))


def _decided(grouped: DataFrame, explicit: str | None) -> DataFrame:
    """The entries of the three documents of every iteration, as far as they are there."""
    c = F.col
    explicit = F.lit(explicit).cast("string")
    approved = lambda kind: _yes(c(f"{kind}_approval.record_type").isin(*history.ACTIVE_TYPES) & (c(f"{kind}_approval.sha256") == c(f"{kind}.digest")))
    times = {
        "spec": select.first_instant(approval=c("spec_approval.at"), promotion=c("meta.promoted_at"), revision=c("spec.revised_at"), explicit=explicit),
        "intake": select.first_instant(approval=c("intake_approval.at"), revision=c("intake.revised_at"), explicit=explicit),
        "meta": select.first_instant(close=c("closed.at"), revision=c("meta.revised_at"), explicit=explicit),
    }
    archived = _yes(c("meta.status") == ARCHIVED)
    whole = _yes(c("closed.bound")) & c("closed.closed_at").eqNullSafe(c("meta.closed_at")) & _yes(c("closed.digest") == c("meta.close"))
    for role in ("spec", "intake", "graph"):
        whole = whole & _yes(c(f"closed.{role}") == c(f"{role}.digest"))
    unreadable = c("meta.problem").isNotNull() | c("spec.foreign") | ~c("intake.readable")
    barred = (
        F.when(unreadable, "unsupported_schema").when(c("spec.draft") | _no(c("meta.status").isin(ARCHIVED, APPROVED)), "draft").when(c("spec.problem").isNotNull(), "unsupported_schema")
        .when(~approved("spec"), "approval_invalid")
    )
    taken = F.when(~approved("intake"), "approval_invalid").when(_no(c("spec.refers") & (c("spec.intake") == c("intake.digest"))), "lineage_invalid").when(c("intake.problem").isNotNull(), "unsupported_schema")
    odd_id = ~c("iteration").rlike(ITERATION_ID) | (F.length("iteration") > MOST_ID)
    state = F.when(c("meta").isNull() | (c("iteration") == MAINTENANCE), "skipped").when(odd_id, "odd-id").when(c("spec").isNull() | c("intake").isNull(), "parted").when(barred.isNotNull(), "barred").otherwise("reached")
    # Each step is a projection of its own, so that no expression is written out once for every place that uses it.
    rows = grouped.select(
        "project_id", "iteration", *(c(role).isNotNull().alias(f"has_{role}") for role in ("spec", "intake", "meta")), state.alias("state"), barred.alias("barred"), taken.alias("taken"), archived.alias("archived"), whole.alias("whole"),
        (~archived & ~(_yes(c("meta.status") == APPROVED) & c("is_active"))).alias("idle"), c("closed").isNotNull().alias("recorded"), *(x.alias(f"{role}_{n}") for role, pair in times.items() for n, x in zip(("at", "source"), pair, strict=True)),
    )
    late = lambda role: F.when(c(f"{role}_at").isNull(), "timestamp_unavailable")
    rows = rows.withColumns({
        "spec_reason": F.coalesce("barred", F.when(c("idle"), "draft"), late("spec")),
        "intake_reason": F.coalesce("taken", F.when(~c("idle"), late("intake"))),
        "meta_reason": F.when((c("archived") != c("recorded")) | (c("archived") & ~c("whole")), "lineage_invalid").when(c("archived"), late("meta")),
    })
    at = lambda *states: c("state").isin(*states)
    error = lambda role, reason: F.array(_entry(_path(role), "error", reason))
    other = lambda role: F.array(_entry(_path(role), "exclude", select.path_class(_path(role))))
    kept = lambda role, *kinds: F.array(*(_entry(_path(role), "include", None, F.lit(k), c(f"{role}_at"), c(f"{role}_source")) for k in kinds))
    lineage = F.lit("lineage_invalid")
    spec = (
        F.when(at("skipped", "odd-id"), other("spec")).when(at("parted"), error("spec", lineage)).when(c("spec_reason") == "draft", F.array(_entry(_path("spec"), "exclude", c("spec_reason"))))
        .when(c("spec_reason").isNotNull(), error("spec", c("spec_reason"))).otherwise(kept("spec", "product-spec", "implementation-plan"))
    )
    intake = F.when(at("reached") & c("intake_reason").isNotNull(), error("intake", c("intake_reason"))).when(at("reached") & ~c("idle"), kept("intake", "intake")).otherwise(other("intake"))
    meta = (
        F.when(at("odd-id"), error("meta", F.lit("unsupported_schema"))).when(at("parted"), error("meta", lineage)).when(at("reached") & c("meta_reason").isNotNull(), error("meta", c("meta_reason")))
        .when(at("reached") & c("archived"), kept("meta", "archived-iteration")).otherwise(other("meta"))
    )
    there = [F.when(c(f"has_{role}"), entries).otherwise(F.array().cast(_ENTRIES)) for role, entries in (("spec", spec), ("intake", intake), ("meta", meta))]
    return rows.select("project_id", F.inline(F.concat(*there)))


_ENTRIES = "array<struct<path:string,kind:string,decision:string,reason:string,at:string,at_source:string>>"


def planning_entries(files: DataFrame, ledger: DataFrame, schemas: dict[str, str], explicit: str | None = None) -> DataFrame:
    """project_id, path, kind, decision, reason, at and at_source: what becomes of every file of every project.

    ``files``: project_id, path (below the project's root, once a project), text (null if it can't be read as UTF-8) and
    revised_at (when its revision was made, or null). ``ledger``: project_id, sequence, record_type, scope (a path), sha256, at.
    ``schemas``: the schema_version that ``spec``, ``intake``, ``current_spec`` and ``iteration`` files state. ``explicit``: a
    time for what has none of its own.

    A kept document has a row for each kind it becomes, with decision ``include`` and its time; other files have one row, of
    decision ``error`` or ``exclude`` with a reason. A project whose current specification is missing or wrong, names what isn't
    there or names it twice, or that lacks its ledger, has one row alone, with a null path. No files give no rows.
    """
    current = _current(files, schemas)
    grouped = _grouped(files, ledger, current, schemas)
    refused = _refused(files, current, grouped)
    path = F.col("path")
    role = _role(path)
    rest = files.where(role.isNull() | (role == "graph")).select("project_id", F.inline(F.array(_entry(path, "exclude", select.path_class(path)))))
    decided = _decided(grouped, explicit).unionByName(rest).join(refused.select("project_id"), "project_id", "left_anti")
    return decided.unionByName(refused.select("project_id", F.inline(F.array(_entry(None, "error", F.col("reason"))))))
