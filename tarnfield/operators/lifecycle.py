"""Eligibility of pages, lifecycles of typed entities, review holds, quality gates, registry and capability checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import slug_like

EXCLUSIONS = ("archived", "orphaned", "stale", "unverified")
# Allowed changes of state by entity type.
TRANSITIONS = (
    ("decision", "active", "superseded"),
    ("decision", "active", "archived"),
    ("decision", "superseded", "archived"),
    ("failure", "open", "resolved"),
    ("failure", "resolved", "archived"),
    ("verification", "recorded", "passed"),
    ("verification", "recorded", "failed"),
    ("verification", "passed", "archived"),
    ("verification", "failed", "archived"),
)
STATES = {"decision": ("active", "superseded", "archived"), "failure": ("open", "resolved", "archived"), "verification": ("recorded", "passed", "failed", "archived")}
# Gates in their order, as (name, condition).
GATES = (
    ("pending-changes", "pending_changes_count > 0"),
    ("state-unhealthy", "state_status <> 'ok'"),
    ("pending-candidates", "pending_candidates > 0"),
    ("pending-reviews", "pending_reviews > 0"),
    ("stale-pages", "stale_count > 0"),
    ("orphaned-pages", "orphaned_count > 0"),
    ("lint-errors", "errors > 0"),
    ("eval-threshold-violations", "threshold_violation_count > 0"),
)
# Capabilities as (name, provider, workspace effect, egress).
CAPABILITIES = (
    ("compile", "required", "content-write", "source-to-generation-provider"),
    ("context", "conditional", "none", "prompt-to-embedding-provider"),
    ("eval-fast", "none", "none", "none"),
    ("eval-full", "required", "cache-write", "citation-evidence-to-judge"),
    ("lint", "none", "none", "none"),
    ("query", "required", "log-write", "question-and-wiki-to-provider"),
    ("search", "required", "none", "question-and-wiki-to-provider"),
    ("status", "none", "none", "none"),
)
# Submodule states with the pin state and what to run to recover.
PIN_STATES = (
    ("ready", "matched", None),
    ("commit-mismatch", "mismatched", "knowledge init"),
    ("conflicted", "conflicted", "knowledge status"),
    ("uninitialized", "uninitialized", "knowledge init"),
    ("unconfigured", "unconfigured", "knowledge clone"),
    ("invalid", "invalid", "knowledge status"),
)
#: Ids that no project may take.
RESERVED_IDS = ("knowledge", "manifest", "projects", "shared")
DIRECTORIES = {"decision": "decisions", "failure": "failures", "verification": "verifications"}


def plain_exclusion(archived: Column, freshness: Column, contradicted: Column, n_refs: Column) -> Column:
    """Archived, then stale, then unverified (by state, by contradiction or for want of references); else null."""
    no = F.lit(False)
    weak = (freshness == "unverified") | F.coalesce(contradicted, no) | (F.coalesce(n_refs, F.lit(0)) < 1)
    return F.when(F.coalesce(archived, no), "archived").when(freshness == "stale", "stale").when(F.coalesce(weak, F.lit(True)), "unverified")


def entity_exclusion(archived: Column, orphaned: Column, confidence: Column, provenance: Column, n_contradictions: Column, verified: Column) -> Column:
    no = F.lit(False)
    weak = ~F.coalesce(confidence >= 0.5, no) | ~F.coalesce(provenance.isin("extracted", "merged", "inferred"), no) | (F.coalesce(n_contradictions, F.lit(0)) > 0) | ~F.coalesce(verified, no)
    return F.when(F.coalesce(archived, no), "archived").when(F.coalesce(orphaned, no), "orphaned").when(weak, "unverified")


def exclusion_counts(pages: DataFrame, exclusion: str = "exclusion") -> DataFrame:
    """A row for each class of exclusion, with zeros."""
    classes = pages.sparkSession.createDataFrame([(c,) for c in EXCLUSIONS], "exclusion string")
    counts = pages.where(F.col(exclusion).isNotNull()).groupBy(F.col(exclusion).alias("exclusion")).count()
    return classes.join(counts, "exclusion", "left").select("exclusion", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "entity_type string, from_state string, to_state string")


def checked_transitions(changes: DataFrame) -> DataFrame:
    """``changes`` (entity_type, from_state, to_state) with ``allowed``."""
    table = transition_table(changes.sparkSession).withColumn("allowed", F.lit(True))
    return changes.join(F.broadcast(table), ["entity_type", "from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def review_holds(confidence: Column, contradicted: Column, n_schema: Column, n_provenance: Column) -> Column:
    """Why a page waits for review; a confidence outside 0 to 1 gives that one reason only."""
    bad = confidence.isNotNull() & (F.isnan(confidence) | (confidence < 0) | (confidence > 1))
    reasons = F.array_compact(F.array(
        F.when(confidence.isNull() | (confidence < 0.5), "low-confidence"), F.when(F.coalesce(contradicted, F.lit(False)), "contradicted"),
        F.when(n_schema > 0, "schema-violating"), F.when(n_provenance > 0, "provenance-violating"),
    ))
    return F.when(bad, F.array(F.lit("schema-violating"))).otherwise(reasons)


def lifecycle_issues() -> Column:
    """Sorted issues of an entity row. Columns: entity_type, state, incoming_supersedes, passed_verifications, n_evidence,
    resolution, archive_reason; null counts as none."""
    c = F.col
    none = lambda x: F.coalesce(c(x), F.lit(0)) < 1
    blank = lambda x: ~F.coalesce(c(x).rlike(r"\S"), F.lit(False))
    known = F.lit(False)
    for kind, states in STATES.items():
        known = known | ((c("entity_type") == kind) & c("state").isin(*states))
    resolved = (c("entity_type") == "failure") & (c("state") == "resolved")
    return F.array_sort(F.array_compact(F.array(
        F.when(~F.coalesce(known, F.lit(False)), "state-unsupported"),
        F.when((c("entity_type") == "decision") & (c("state") == "superseded") & none("incoming_supersedes"), "supersedes-required"),
        F.when(resolved & blank("resolution"), "resolution-required"), F.when(resolved & none("passed_verifications"), "verified-by-required"),
        F.when((c("entity_type") == "verification") & c("state").isin("passed", "failed") & none("n_evidence"), "evidence-required"),
        F.when((c("state") == "archived") & blank("archive_reason"), "archive-reason-required"),
    )))


def lifecycle_page_id(namespace: str, project: Column, entity_type: Column, key: Column) -> Column:
    """A stable id from a namespace, the project, the type and the producer's key."""
    zero = F.lit("\x00")
    folder = F.element_at(F.create_map(*(F.lit(x) for kv in DIRECTORIES.items() for x in kv)), entity_type)
    return F.concat(folder, F.lit("/"), F.sha2(F.concat(F.lit(namespace), zero, project, zero, entity_type, zero, key), 256))


def quality_gates() -> Column:
    """Names of the gates that a status row fails, in their order."""
    return F.array_compact(F.array(*(F.when(F.expr(cond), name) for name, cond in GATES)))


def capability_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "capability string, provider string, effect string, egress string")


def needs_egress(requests: DataFrame) -> DataFrame:
    """``requests`` (capability, top_chunks) with ``needs_egress``."""
    table = capability_table(requests.sparkSession).select("capability", "provider")
    rows = requests.join(F.broadcast(table), "capability", "left")
    return rows.withColumn("needs_egress", F.coalesce((F.col("provider") == "required") | (F.col("provider") == "conditional") & (F.coalesce("top_chunks", F.lit(1)) != 0), F.lit(False))).drop("provider")


def pin_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PIN_STATES, "state string, pin_state string, recovery string")


def registry_problems(registry: DataFrame, reserved: tuple[str, ...] = RESERVED_IDS) -> DataFrame:
    """(project_id, problem): bad or reserved ids, repeated ids or paths."""
    ids, paths = Window.partitionBy("project_id"), Window.partitionBy("path")
    problem = F.when(~slug_like(F.col("project_id")), "bad-id").when(F.col("project_id").isin(*reserved), "reserved-id").when(F.count("*").over(ids) > 1, "duplicate-id").when(F.count("*").over(paths) > 1, "duplicate-path")
    return registry.select("project_id", problem.alias("problem")).where("problem is not null")


def declared_totals(findings: DataFrame, declared: DataFrame, key: str = "severity") -> DataFrame:
    """(severity, declared, counted) where a report's totals aren't those of its rows."""
    counted = findings.groupBy(key).agg(F.count("*").alias("counted"))
    both = declared.select(key, F.col("n").alias("declared")).join(counted, key, "full").na.fill(0, ["declared", "counted"])
    return both.where("declared <> counted")


def identity_state(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per project whether its embedding identity is missing, outdated or compatible with the wanted digest."""
    rows = wanted.select("project_id", F.col("digest").alias("_w")).join(projects.select("project_id", F.col("digest").alias("_h")), "project_id", "left")
    return rows.select("project_id", F.when(F.col("_h").isNull(), "missing").when(F.col("_h") == F.col("_w"), "compatible").otherwise("outdated").alias("state"))


def differing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that one side has and the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
