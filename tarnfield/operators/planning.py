"""Validators of planning artifacts given as JSON text, and the state of a profile against what is stored.

Each validator is a column expression over a parsed variant: null for a good artifact, or a word for what is wrong.
``schema`` is the schema_version that the artifact must state. ``x``: the text, parsed already; a column of a projection of its own, so
that it isn't parsed anew for each check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys that artifacts may have, and those that their parts must have.
PRODUCT_KEYS = ("constraints", "core_flows", "data_model_draft", "external_integrations", "goals", "must_preserve", "non_goals", "problem", "screens_or_interfaces", "success_criteria", "target_users")
IMPLEMENTATION_KEYS = ("architecture", "data_flow", "dependencies", "edge_cases", "interfaces", "verification")
SPEC_KEYS = ("approval", "approval_audit", "clarifying_question_disposition", "evidence", "implementation", "open_decisions", "product", "project_id", "reference_reconnaissance", "schema_version", "source_intake", "source_intake_sha256", "visual_experience")
INTAKE_KEYS = ("approval_audit", "assumptions", "baseline_context", "clarifying_questions", "evidence", "idea", "interview", "known_facts", "needs_user_decision", "schema_version", "status", "summary")
CURRENT_SPEC_KEYS = (
    "active_iteration", "closed_iterations", "composed_at", "composed_from", "composition_conflicts", "effective_implementation", "effective_product", "effective_spec_ref", "gate_b_approval_audits", "gate_b_promoted_at",
    "last_closed_iteration", "note", "open_decisions", "pending_iteration", "project_id", "schema_version", "skipped_iterations", "source_specs", "superseded_refs",
)
ITERATION_KEYS = (
    "approved_spec_artifacts", "baseline", "close", "closed_at", "draft_artifacts", "drafted_at", "expected_artifacts", "idea", "iteration_id", "memory_freshness", "opened_at", "optional_artifacts", "planning_memory",
    "project_id", "promoted_at", "schema_version", "status",
)
CLOSED_ITERATION_KEYS = ("artifact_hashes", "closed_at", "effective_spec_ref", "iteration_id", "spec_ref", "status", "task_count", "task_graph_ref", "task_status_counts")
TASK_COUNT_KEYS = ("blocked", "done", "in_progress", "todo")
_FIELD_REF = r"\Aspec\.(?:product|implementation)\.[a-z_]+\z"


def _all(*conditions: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _get(x: Column, key: str) -> Column:
    return F.try_variant_get(x, f"$.{key}", "variant")


def _text(x: Column) -> Column:
    """The string of a variant that is one, else null."""
    return F.when(_kind(x) == "STRING", x.cast("string"))


def _filled(x: Column) -> Column:
    return F.coalesce(F.length(_text(x)) > 0, F.lit(False))


def _items(x: Column) -> Column:
    """The elements of a variant that is an array, else null."""
    return F.when(_kind(x).startswith("ARRAY"), x.cast("array<variant>"))


def _each(x: Column, good) -> Column:
    return F.coalesce(F.forall(_items(x), lambda y: F.coalesce(good(y), F.lit(False))), F.lit(False))


def _texts(x: Column) -> Column:
    return _each(x, lambda y: _kind(y) == "STRING")


def _keys(x: Column) -> Column:
    return F.when(_kind(x).startswith("OBJECT"), F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>")))


def _exact(x: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(_keys(x)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def _allowed(x: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.size(F.array_except(_keys(x), F.array(*map(F.lit, keys)))) == 0, F.lit(False))


def _absent_or(x: Column, good: Column) -> Column:
    return x.isNull() | F.coalesce(good, F.lit(False))


def _view(x: Column, keys: tuple[str, ...], texts: tuple[str, ...] = ()) -> Column:
    return _all(_exact(x, keys), *((_kind(_get(x, k)) == "STRING") if k in texts else _texts(_get(x, k)) for k in keys))


def spec_problem(text: Column, project: Column, schema: str, x: Column | None = None) -> Column:
    """keys, not-eligible (schema, project, approval, intake digest, lists, or open decisions left) or view."""
    x = F.try_parse_json(text) if x is None else x
    lists = [_items(_get(x, k)).isNotNull() for k in ("clarifying_question_disposition", "evidence", "open_decisions")]
    eligible = _all(
        _text(_get(x, "schema_version")) == schema, _text(_get(x, "project_id")) == project, _text(_get(x, "approval")) == "approved", _kind(_get(x, "source_intake")) == "STRING",
        _text(_get(x, "source_intake_sha256")).rlike(r"\A[a-f0-9]{64}\z"), *lists, F.size(_items(_get(x, "open_decisions"))) == 0,
    )
    views = _view(_get(x, "implementation"), IMPLEMENTATION_KEYS) & _view(_get(x, "product"), PRODUCT_KEYS, ("problem",))
    return F.when(~_allowed(x, SPEC_KEYS), "keys").when(~eligible, "not-eligible").when(~views, "view")


def _assumption(x: Column) -> Column:
    return _all(_exact(x, ("confirmation_needed", "id", "risk", "statement")), _text(_get(x, "id")).rlike(r"\AA-[0-9]+\z"), _filled(_get(x, "statement")), _text(_get(x, "risk")).isin("low", "medium", "high"), _kind(_get(x, "confirmation_needed")) == "BOOLEAN")


def _question(x: Column) -> Column:
    return _all(
        _allowed(x, ("answer", "blocks", "id", "question", "status", "why_it_matters")), _text(_get(x, "id")).rlike(r"\ACQ-[0-9]+\z"), _filled(_get(x, "question")), _filled(_get(x, "why_it_matters")), _texts(_get(x, "blocks")),
        _absent_or(_get(x, "status"), _text(_get(x, "status")).isin("open", "answered", "assumed", "not_applicable")), _absent_or(_get(x, "answer"), _kind(_get(x, "answer")) == "STRING"),
    )


def _option(x: Column) -> Column:
    return _all(_exact(x, ("description", "id", "label")), *(_filled(_get(x, k)) for k in ("description", "id", "label")))


def _superseded(x: Column) -> Column:
    return _all(_exact(x, ("baseline_value", "field_ref")), _text(_get(x, "field_ref")).rlike(_FIELD_REF), _filled(_get(x, "baseline_value")))


def _decision(x: Column) -> Column:
    fields, supersedes = _get(x, "affected_fields"), _get(x, "supersedes")
    return _all(
        _allowed(x, ("affected_fields", "answer", "blocks", "current_resolution", "default", "disposition", "id", "impact", "options", "question", "status", "supersedes")), _text(_get(x, "id")).rlike(r"\AND-[0-9]+\z"),
        *(_filled(_get(x, k)) for k in ("question", "impact", "default")), F.size(_items(_get(x, "options"))) >= 2, _each(_get(x, "options"), _option), _text(_get(x, "status")).isin("open", "answered", "deferred"),
        _absent_or(_get(x, "blocks"), _texts(_get(x, "blocks"))), _absent_or(fields, _each(fields, lambda y: _text(y).rlike(_FIELD_REF))),
        *(_absent_or(_get(x, k), _filled(_get(x, k))) for k in ("answer", "current_resolution", "disposition")), _absent_or(supersedes, (F.size(_items(supersedes)) > 0) & _each(supersedes, _superseded)),
    )


def _evidence(x: Column) -> Column:
    return _all(_exact(x, ("source_id", "title", "url", "used_for")), _text(_get(x, "source_id")).rlike(r"\A(?:WEB|USER|LOCAL)-[0-9]+\z"), _filled(_get(x, "title")), _kind(_get(x, "url")) == "STRING", _filled(_get(x, "used_for")))


def intake_problem(text: Column, schema: str, x: Column | None = None) -> Column:
    """keys, or the first part that is wrong: schema, facts, assumptions, questions, decisions, status or evidence."""
    x = F.try_parse_json(text) if x is None else x
    head = _all(_text(_get(x, "schema_version")) == schema, _filled(_get(x, "idea")), _filled(_get(x, "summary")))
    status = F.coalesce(_text(_get(x, "status")).isin("blocked_on_user", "ready_for_spec"), F.lit(False))
    return (
        F.when(~_allowed(x, INTAKE_KEYS), "keys").when(~head, "schema").when(~_texts(_get(x, "known_facts")), "facts").when(~_each(_get(x, "assumptions"), _assumption), "assumptions")
        .when(~_each(_get(x, "clarifying_questions"), _question), "questions").when(~_each(_get(x, "needs_user_decision"), _decision), "decisions").when(~status, "status").when(~_each(_get(x, "evidence"), _evidence), "evidence")
    )


def current_spec_problem(text: Column, project: Column, schema: str, x: Column | None = None) -> Column:
    x = F.try_parse_json(text) if x is None else x
    good = _all(_text(_get(x, "schema_version")) == schema, _text(_get(x, "project_id")) == project, _items(_get(x, "closed_iterations")).isNotNull())
    return F.when(~_allowed(x, CURRENT_SPEC_KEYS), "keys").when(~good, "schema")


def iteration_problem(text: Column, project: Column, iteration: Column, schema: str, x: Column | None = None) -> Column:
    x = F.try_parse_json(text) if x is None else x
    good = _all(_text(_get(x, "schema_version")) == schema, _text(_get(x, "project_id")) == project, _text(_get(x, "iteration_id")) == iteration, _absent_or(_get(x, "idea"), _filled(_get(x, "idea"))))
    return F.when(~_allowed(x, ITERATION_KEYS), "keys").when(~good, "schema")


def closed_iteration_problem(text: Column) -> Column:
    return F.when(~_allowed(F.try_parse_json(text), CLOSED_ITERATION_KEYS), "keys")


def task_counts_valid(text: Column) -> Column:
    """Whether a text is an object of the four counts, each a whole number of at least 0 that a double holds exactly."""
    x = F.try_parse_json(text)
    return _all(_exact(x, TASK_COUNT_KEYS), *((_kind(_get(x, k)) == "BIGINT") & F.try_variant_get(x, f"$.{k}", "long").between(0, (1 << 53) - 1) for k in TASK_COUNT_KEYS))


def profile_disposition(bound: Column, profile: Column, config: Column, wanted_profile: Column, wanted_config: Column, hash_matches: Column, language_matches: Column, name: str) -> Column:
    """A struct of ``disposition`` and ``reasons`` of putting a profile on a project.

    ``bound``: the project has a custom profile already; ``profile`` and ``config``: the stored bytes or null; ``hash_matches``
    and ``language_matches``: the project's record agrees with the profile. ``name`` stands in the reason of a first change.
    """
    foreign = F.array_compact(F.array(F.when(config.isNotNull() & ~config.eqNullSafe(wanted_config), F.lit("foreign-config")), F.when(profile.isNotNull(), F.lit("foreign-profile"))))
    drift = ~(profile.eqNullSafe(wanted_profile) & config.eqNullSafe(wanted_config))
    reasons = (
        F.when(~bound & (F.size(foreign) > 0), foreign).when(~bound, F.array(F.lit(f"default-to-{name}"))).when(drift, F.array(F.lit("materialized-drift")))
        .when(hash_matches & language_matches, F.array(F.lit("already-applied"))).otherwise(F.array(F.lit("language-update")))
    )
    migrate = (~bound & (F.size(foreign) > 0)) | (bound & drift)
    disposition = F.when(migrate, "migration-required").when(bound & hash_matches & language_matches, "unchanged").otherwise("compatible-recompile")
    return F.struct(disposition.alias("disposition"), reasons.alias("reasons"))


def profile_binding(bound: Column, source: Column, profile: Column, config: Column, recorded_hash: Column, wanted_profile: Column, wanted_config: Column, language_matches: Column) -> Column:
    """default, custom, or drift where what is stored isn't what the record and the profile's source say."""
    whole = _all(source.isNotNull(), profile == wanted_profile, config == wanted_config, F.concat(F.lit("sha256:"), F.sha2(source, 256)) == recorded_hash, language_matches)
    return F.when(~bound & source.isNull() & profile.isNull(), "default").when(bound & whole, "custom").otherwise("drift")
