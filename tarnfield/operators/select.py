"""Selection of artifacts: classes of paths, eligibility, targets, upserts, collisions, counts and source documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import UNSAFE, bounded_body, instant, plain_body, prefixed_sha256

# Classes of unselected paths in their order, as (pattern, class).
PATH_CLASSES = (
    (r"\Aiterations/maintenance/", "maintenance"),
    (r"\Aruns/|/gate-c-task-graph/", "task_or_run"),
    (r"(?:product-spec|implementation-plan|intake)\.md\z", "duplicate_copy"),
    (r"/baseline/|(?:README|status)\.md\z", "generated_artifact"),
    (r"\Aiterations/[^/]+/iteration\.json\z", "pending_iteration"),
    (r"evidence|review|experience", "evidence_or_review"),
)
OTHER_CLASS = "generated_artifact"
DECISIONS = ("include", "exclude", "quarantine", "blocked", "error")


def path_class(path: Column) -> Column:
    return reduce(lambda rest, x: F.when(path.rlike(x[0]), x[1]).otherwise(rest), reversed(PATH_CLASSES), F.lit(OTHER_CLASS))


def iteration_of(path: Column) -> Column:
    """The iteration id in a path, or null."""
    found = F.regexp_extract(path, r"\Aiterations/([^/]+)/", 1)
    return F.when(found != "", found)


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not there."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


#: Reasons of ``eligible`` in the order they are looked for; the input gives a boolean for each but the last.
ELIGIBILITY = (
    ("is_maintenance", True, "maintenance"),
    ("valid_id", False, "unsupported_schema"),
    ("has_spec", False, "missing_spec"),
    ("has_intake", False, "missing_intake"),
    ("is_approved", False, "pending_approval"),
    ("has_open_decisions", True, "open_decisions"),
    ("ledger_approved", False, "approval_invalid"),
    ("lineage_matches", False, "lineage_mismatch"),
    ("archive_matches", False, "archive_mismatch"),
)


def eligible(rows: DataFrame, timestamp: str = "ingested_at") -> DataFrame:
    """``rows`` with ``reason``: null for what may be selected, else the first ground against it.

    A null flag counts as the bad value. Expects the columns of ``ELIGIBILITY`` and the timestamp text.
    """
    reason = F.when(instant(F.col(timestamp)).isNull(), "timestamp_unavailable")
    for column, bad, name in reversed(ELIGIBILITY):
        reason = F.when(F.coalesce(F.col(column), F.lit(bad)) == bad, name).otherwise(reason)
    return rows.withColumn("reason", reason)


def fanned_out(rows: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """A row for each kind whose condition (SQL) holds: one approved spec gives several candidates."""
    kind = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in kinds.items())))
    return rows.select(key, F.explode(kind).alias("kind"))


def first_instant(**candidates: Column) -> tuple[Column, Column]:
    """The first candidate that is a real instant, and which it was."""
    values = {k: instant(c) for k, c in candidates.items()}
    source = reduce(lambda rest, k: F.when(values[k].isNotNull(), k).otherwise(rest), reversed(list(values)), F.lit(None).cast("string"))
    return F.coalesce(*values.values()), source


def target_name(kind: Column, uri: Column) -> Column:
    return F.concat(kind, F.lit("--"), F.sha2(uri, 256), F.lit(".md"))


def source_documents(docs: DataFrame, key: str = "doc_id", body: str = "text", kind: str = "planning", scheme: str = "doc://corpus/", points: bool = False) -> DataFrame:
    """Canonical source documents: key, uri, target, body, truncated, original_chars, content_hash, body_hash and ``problem``.

    ``content_hash`` and the check for unsafe characters are those of the whole body, so that a change beyond the cut is
    seen; ``body_hash`` is that of ``body``, which may be cut. ``points``: lengths and the cut are in code points, not UTF-16 units.
    """
    uri = F.concat(F.lit(scheme), F.col(key).cast("string"))
    rows = docs.select(F.col(key).alias("key"), uri.alias("uri"), target_name(F.lit(kind), uri).alias("target"), plain_body(F.col(body)).alias("whole"))
    rows = rows.select("key", "uri", "target", "whole", bounded_body(F.col("whole"), plain=True, points=points).alias("b"))
    problem = F.when(F.col("whole").isNull(), "blank").when(~F.col("b.valid"), "truncation-invalid").when(F.col("whole").rlike(UNSAFE), "unsafe-text")
    return rows.select("key", "uri", "target", "b.body", "b.truncated", "b.original_chars", prefixed_sha256(F.col("whole")).alias("content_hash"), prefixed_sha256(F.col("b.body")).alias("body_hash"), problem.alias("problem"))


def upsert_status(expected: DataFrame, existing: DataFrame, key: str = "target", identity: str = "uri", content: str = "content_hash") -> DataFrame:
    """Per target: create, unchanged, update, collision (another identity holds it) or kept (not expected any more)."""
    new = expected.select(key, F.col(identity).alias("_i1"), F.col(content).alias("_c1"))
    old = existing.select(key, F.col(identity).alias("_i2"), F.col(content).alias("_c2"))
    status = (
        F.when(F.col("_i2").isNull(), "create").when(F.col("_i1").isNull(), "kept").when(F.col("_i1") != F.col("_i2"), "collision")
        .when(F.col("_c1").eqNullSafe(F.col("_c2")), "unchanged").otherwise("update")
    )
    return new.join(old, key, "full").select(key, status.alias("status"))


def merged(expected: DataFrame, existing: DataFrame, key: str = "target") -> DataFrame:
    """The rows after an upsert: every expected row, and existing ones that nothing replaces. Ready to be written."""
    return expected.unionByName(existing.join(expected.select(key), key, "left_anti"))


def collisions(left: DataFrame, right: DataFrame, key: str = "target") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def duplicate_targets(plan: DataFrame, key: str = "target", identity: str = "uri") -> DataFrame:
    """Targets that more than one identity claims."""
    return plan.groupBy(key).agg(F.count_distinct(identity).alias("n")).where("n > 1").select(key, "n")


def decision_counts(plan: DataFrame, group: str, decision: str = "decision") -> DataFrame:
    counts = plan.groupBy(group).pivot(decision, list(DECISIONS)).count()
    return counts.na.fill(0, list(DECISIONS))


def plan_gate(counts: DataFrame) -> DataFrame:
    """``counts`` with ``blocked_plan``: something is blocked, failed or quarantined."""
    return counts.withColumn("blocked_plan", F.col("blocked") + F.col("error") + F.col("quarantine") > 0)


def blocking_phase(planning_blocked: bool, execution_blocked: bool) -> str | None:
    return "planning" if planning_blocked else "execution" if execution_blocked else None


def consistent(entries: DataFrame, candidates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) where the two sides don't hold the same rows with equal fields."""
    left = entries.select(key, F.struct(*fields).alias("_a"))
    right = candidates.select(key, F.struct(*fields).alias("_b"))
    problem = F.when(F.col("_b").isNull(), "no-candidate").when(F.col("_a").isNull(), "no-entry").when(~F.col("_a").eqNullSafe(F.col("_b")), "field-mismatch")
    return left.join(right, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def ranked_claims(plan: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``plan`` with ``claim``: 1 for the first row of each target in the given order."""
    return plan.withColumn("claim", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
