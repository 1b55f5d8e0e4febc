"""Plans of what to write: source identities, task contracts, run indexes, completeness, recorded hashes, fingerprints,
counts, the two-phase sync, the union of page sources with its budget, and the checks that guard them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.functions.text import EDGE, canonical_json, component_decoded, instant, prefixed_sha256, utf16_length
from tarnfield.operators import screen, select

# The path of a document kind inside its iteration.
DOCUMENT_PATHS = {
    "archived-iteration": "iteration.json",
    "intake": "gate-a-intake/intake.json",
    "implementation-plan": "gate-b-spec/spec.json",
    "product-spec": "gate-b-spec/spec.json",
}
TASK_GRAPH_PATH = "gate-c-task-graph/task-graph.json"
RUN_STATUSES = ("blocked", "failed", "finished", "started")
# The reason code of each error.
ERROR_REASONS = {
    "PROJECTION_APPROVAL_INVALID": "approval_invalid",
    "PROJECTION_PATH_UNSAFE": "path_unsafe",
    "PROJECTION_PROJECT_MISMATCH": "project_mismatch",
    "PROJECTION_SOURCE_COLLISION": "source_collision",
    "PROJECTION_TIMESTAMP_UNAVAILABLE": "timestamp_unavailable",
    "PROJECTION_ARTIFACT_CHANGED": "unsupported_schema",
    "PROJECTION_ARTIFACT_INVALID": "unsupported_schema",
    "PROJECTION_SANITIZATION_FAILED": "unsupported_schema",
    "PROJECTION_WRITE_FAILED": "unsupported_schema",
}


def source_identity(source: Column, kind: Column, project: Column, repository: str, scheme: str, **stated: Column) -> Column:
    """The decoded parts of a source URI as a struct, or null if any part is wrong.

    A URI is ``scheme``, repository, project, iteration, then for planning the document kind and its path, for execution the
    word execution-task, the task graph's path, the task and its contract digest; every segment but that digest is
    percent-encoded in the one canonical way. ``stated`` columns (iteration_id, document_kind, artifact_path, task_id,
    task_contract_sha256) must agree with the URI where they are not null.
    """
    parts = F.split(source, "/")
    size = F.size(parts)
    # The eighth segment is a bare digest, which its own pattern checks.
    decoded = F.transform(parts, lambda x, i: F.when(i == 0, x).when((kind == "execution") & (i == 7), x).otherwise(component_decoded(x)))
    at = lambda i: F.get(decoded, F.lit(i))
    agrees = lambda name, value: F.coalesce(stated[name] == value, F.lit(True)) if name in stated else F.lit(True)
    iteration = at(3)
    common = (at(0) == scheme) & ~F.exists(decoded, lambda x: x.isNull()) & (at(1) == repository) & (at(2) == project) & iteration.rlike(r"\A[a-z0-9][a-z0-9._-]{0,127}\z") & agrees("iteration_id", iteration)
    path = reduce(lambda rest, k: F.when(at(4) == k, F.concat(F.lit("iterations/"), iteration, F.lit(f"/{DOCUMENT_PATHS[k]}"))).otherwise(rest), DOCUMENT_PATHS, F.lit(None).cast("string"))
    planning = (kind == "planning") & (size == 6) & (at(5) == path) & agrees("document_kind", at(4)) & agrees("artifact_path", at(5))
    graph = F.concat(F.lit("iterations/"), iteration, F.lit(f"/{TASK_GRAPH_PATH}"))
    execution = (
        (kind == "execution") & (size == 8) & (at(4) == "execution-task") & (at(5) == graph) & at(6).rlike(r"\Atask-[0-9]+\z") & at(7).rlike(r"\A[a-f0-9]{64}\z")
        & agrees("artifact_path", at(5)) & agrees("task_id", at(6)) & agrees("task_contract_sha256", at(7))
    )
    fields = F.struct(iteration.alias("iteration_id"), F.when(kind == "planning", at(4)).alias("document_kind"), at(5).alias("artifact_path"), F.when(kind == "execution", at(6)).alias("task_id"), F.when(kind == "execution", at(7)).alias("contract"))
    return F.when(F.coalesce(common & (planning | execution), F.lit(False)), fields)


def contract_digest(task: Column, schema: str) -> Column:
    """SHA-256 of a task given as JSON text, in canonical form, under its ``schema`` and without its status, blockReason and
    blockNote; null if it is no JSON object."""

    @F.pandas_udf(T.StringType())
    def contract(rows):
        import json

        def one(value):
            try:
                found = json.loads(value)
            except (TypeError, ValueError):
                return None
            if not isinstance(found, dict):
                return None
            kept = {k: v for k, v in found.items() if k not in ("status", "blockReason", "blockNote")}
            return json.dumps({"schema_version": schema, "task": kept})

        return rows.map(one)

    return F.sha2(canonical_json(contract(task)), 256)


_RUN = T.StructType([T.StructField(k, T.StringType()) for k in ("agentTool", "finishedAt", "iterationId", "runId", "runRef", "startedAt", "status", "taskGraphRef", "taskId", "workspaceRef")])
_TASK = T.StructType([T.StructField("latestRunId", T.StringType()), T.StructField("runIds", T.ArrayType(T.StringType())), T.StructField("taskId", T.StringType())])
_INDEX = T.StructType([T.StructField("projectId", T.StringType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("schema_version", T.StringType()), T.StructField("tasks", T.ArrayType(_TASK))])
_MOST_RUNS = 10_000


def run_index(indexes: DataFrame, text: str, project: str, schema: str) -> DataFrame:
    """``indexes`` with ``decoded`` (the index, null if refused) and ``problem``: unsupported_schema, project_mismatch or run_reference_invalid.

    ``text``: the index as JSON; ``project``: the column of the expected project id; ``schema``: the schema_version it must
    state. Objects must have exactly their keys.
    """
    source, found = F.col(text), F.from_json(F.col(text), _INDEX)
    keys = lambda x, names: F.array_sort(F.json_object_keys(x)) == F.array(*map(F.lit, sorted(names)))
    raw = lambda path: F.from_json(F.get_json_object(source, path), T.ArrayType(T.StringType()))
    path = lambda x: (F.length(x).between(1, 1024)) & ~x.rlike(r"[\x00-\x1F\x7F-\x9F]|\\|\A/|\A[A-Za-z]:/") & ~F.exists(F.split(x, "/"), lambda p: p.isin(".", ".."))
    run_id = lambda x: x.rlike(r"\Arun-[A-Za-z0-9._-]+\z")
    task_id = lambda x: x.rlike(r"\Atask-[0-9]+\z")
    good_run = lambda r: F.coalesce(
        run_id(r["runId"]) & task_id(r["taskId"]) & r["iterationId"].rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & r["status"].isin(*RUN_STATUSES) & instant(r["startedAt"]).isNotNull()
        & (r["finishedAt"].isNull() | instant(r["finishedAt"]).isNotNull()) & path(r["runRef"])
        & ((r["runRef"] == F.concat(r["runId"], F.lit(".json"))) | (r["runRef"] == F.concat(r["iterationId"], F.lit("/"), r["runId"], F.lit(".json")))), F.lit(False),
    )
    good_task = lambda t: F.coalesce(task_id(t["taskId"]) & F.forall(t["runIds"], lambda x: F.coalesce(run_id(x), F.lit(False))) & (t["latestRunId"].isNull() | run_id(t["latestRunId"])), F.lit(False))
    ids = F.transform("_x.runs", lambda r: r["runId"])
    rows = indexes.withColumns({"_x": found, "_runs": raw("$.runs"), "_tasks": raw("$.tasks")})
    shape = F.coalesce(keys(source, _INDEX.names) & (F.col("_x.schema_version") == schema), F.lit(False))
    entries = F.coalesce(
        (F.size("_x.runs") <= _MOST_RUNS) & (F.size("_x.tasks") <= _MOST_RUNS) & F.forall("_runs", lambda r: F.coalesce(keys(r, _RUN.names), F.lit(False))) & F.forall("_x.runs", good_run)
        & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall("_tasks", lambda t: F.coalesce(keys(t, _TASK.names), F.lit(False))) & F.forall("_x.tasks", good_task), F.lit(False),
    )
    problem = F.when(~shape, "unsupported_schema").when(~F.coalesce(F.col("_x.projectId") == F.col(project), F.lit(False)), "project_mismatch").when(~entries, "run_reference_invalid")
    return rows.withColumn("problem", problem).withColumn("decoded", F.when(F.col("problem").isNull(), F.col("_x"))).drop("_x", "_runs", "_tasks")


def complete_entries(files: DataFrame, explicit: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """(path, decision, reason): every scanned file's entry. Explicit entries stand, candidates are left for later phases, all others are excluded by class."""
    rest = files.select(path).distinct().join(explicit.select(path), path, "left_anti").join(candidates.select(path), path, "left_anti")
    return explicit.select(path, "decision", "reason").unionByName(rest.select(path, F.lit("exclude").alias("decision"), select.path_class(F.col(path)).alias("reason")))


def hash_matches(artifacts: DataFrame, recorded: DataFrame, path: str = "path") -> DataFrame:
    """``artifacts`` (path, digest as sha256:...) with ``matches``: the record of the path says it is present with just that hash."""
    own = recorded.select(path, F.col("present").alias("_present"), F.col("sha256").alias("_hash")).dropDuplicates([path])
    good = F.col("_present") & F.col("_hash").rlike(r"\A[a-f0-9]{64}\z") & (F.concat(F.lit("sha256:"), F.col("_hash")) == F.col("digest"))
    return artifacts.join(own, path, "left").withColumn("matches", F.coalesce(good, F.lit(False))).drop("_present", "_hash")


def plan_fingerprint(plan: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, entries, fingerprint): a digest over a plan's rows whatever their order; two digests a row meet in buckets first."""
    own = plan.select(group, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("d"))
    parts = own.groupBy(group, F.substring("d", 1, 3).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return parts.groupBy(group).agg(F.sum("n").alias("entries"), prefixed_sha256(joined).alias("fingerprint"))


def remaining_count(plan: DataFrame) -> DataFrame:
    """One row: included entries whose target is still to be created or updated."""
    return plan.agg(F.count_if((F.col("decision") == "include") & F.col("write_status").isin("create", "update")).alias("remaining"))


def applied_counts(writes: DataFrame) -> DataFrame:
    """One row: writes, those that changed something, and those that are malformed in digest, target or status."""
    bad = ~F.coalesce(F.col("source_revision").rlike(r"\Asha256:[a-f0-9]{64}\z") & F.col("target").rlike(r"\A(?:execution|planning)--[a-f0-9]{64}\.md\z") & F.col("write_status").isin("create", "unchanged", "update"), F.lit(False))
    return writes.agg(F.count("*").alias("writes"), F.count_if(F.col("write_status") != "unchanged").alias("applied"), F.count_if(bad).alias("malformed"))


def sync_plan(planning: DataFrame, execution: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both plans (target, uri, content_hash, decision, write_status) as one: a summary row and the rows to write.

    The summary has ``problem``: the blocked phase, or target-collision if both phases include one target; then nothing is
    to be written. A dry run writes nothing and says what remains.
    """
    both = planning.withColumn("phase", F.lit("planning")).unionByName(execution.withColumn("phase", F.lit("execution")))
    included = F.col("decision") == "include"
    stopped = F.col("decision").isin("blocked", "error", "quarantine")
    counts = both.agg(
        F.count_if(stopped & (F.col("phase") == "planning")).alias("p"), F.count_if(stopped & (F.col("phase") == "execution")).alias("e"),
        F.count_if(included).alias("included"), F.count_if(included & F.col("write_status").isin("create", "update")).alias("open"),
    )
    shared = select.collisions(planning.where(included & F.col("target").isNotNull()), execution.where(included)).agg(F.count("*").alias("shared"))
    summary = counts.join(F.broadcast(shared))
    problem = F.when(F.col("p") > 0, "planning").when(F.col("e") > 0, "execution").when(F.col("shared") > 0, "target-collision")
    summary = summary.select("included", problem.alias("problem"), F.when(F.lit(dry_run) | problem.isNotNull(), F.col("open")).otherwise(0).alias("remaining"), F.when(F.lit(dry_run) | problem.isNotNull(), 0).otherwise(F.col("open")).alias("applied"))
    fine = F.broadcast(summary.where("problem is null").select("problem"))
    writes = both.where(included).select("phase", "target", "uri", "content_hash", "write_status")
    return summary, writes.limit(0) if dry_run else writes.join(fine).drop("problem")


def page_union(legacy: DataFrame, entities: DataFrame, most_chars: int | None = None, columns: tuple[str, ...] = ("page_id", "title", "summary", "body")) -> tuple[DataFrame, DataFrame]:
    """The pages of both sources, and (problem, key): repeated page ids, and a total of characters beyond the bound."""
    pages = legacy.select(*columns).unionByName(entities.select(*columns))
    twice = pages.groupBy("page_id").count().where("count > 1").select(F.lit("duplicate-page").alias("problem"), F.col("page_id").cast("string").alias("key"))
    if most_chars is None:
        return pages, twice
    chars = sum(utf16_length(F.coalesce(F.col(c), F.lit(""))).cast("long") for c in columns[1:])
    over = pages.agg(F.sum(chars).alias("n")).where(F.col("n") > most_chars).select(F.lit("too-many-characters").alias("problem"), F.col("n").cast("string").alias("key"))
    return pages, twice.unionByName(over)


def corpus_denied(pages: DataFrame, workspace: str | None = None, home: str | None = None) -> DataFrame:
    """One row: pages, those with any finding or a changed text, and ``denied``: one such page denies the whole corpus."""
    body = F.concat_ws("\n", "title", "summary", F.array_join(F.coalesce("source_refs", F.array().cast("array<string>")), "\n"), "body")
    rows = screen.screened(pages.select("page_id", body.alias("b")), "page_id", "b", workspace, home)
    bad = (F.size("findings") > 0) | F.col("output").isNull()
    return rows.agg(F.count("*").alias("pages"), F.count_if(bad).alias("found")).withColumn("denied", F.col("found") > 0)


# Quality gates in their order, as (code, what holds when it is set).
CHECK_GATES = (
    ("pending-changes", "pending_changes > 0"),
    ("state-unhealthy", "state_status <> 'ok'"),
    ("pending-candidates", "pending_candidates > 0"),
    ("pending-reviews", "pending_reviews > 0"),
    ("stale-pages", "stale > 0"),
    ("orphaned-pages", "orphaned > 0"),
    ("lint-errors", "lint_errors > 0"),
    ("eval-threshold-violations", "threshold_violations > 0"),
)
_STATUS = ("pending_changes", "state_status", "pending_candidates", "stale", "orphaned")


def checked_projects(before: DataFrame, after: DataFrame, lint: DataFrame, evaluated: DataFrame, project: str = "project_id") -> DataFrame:
    """(project_id, problem, gates, passed, warnings): the quality gates of each project.

    ``before`` and ``after``: the columns of a status and its warnings (array); ``lint``: lint_errors, warnings;
    ``evaluated``: pending_reviews, threshold_violations, warnings. A status that changed meanwhile is a problem, a missing
    component too, and then no gate is judged.
    """
    token = lambda: F.struct(*_STATUS, F.array_sort("warnings"))
    one = before.select(project, token().alias("_t1"), F.col("warnings").alias("_w1"))
    two = after.select(project, *_STATUS, token().alias("_t2"), F.col("warnings").alias("_w2"))
    rows = one.join(two, project, "full").join(lint.select(project, "lint_errors", F.col("warnings").alias("_w3")), project, "left").join(evaluated.select(project, "pending_reviews", "threshold_violations", F.col("warnings").alias("_w4")), project, "left")
    missing = F.col("_t1").isNull() | F.col("_t2").isNull() | F.col("lint_errors").isNull() | F.col("pending_reviews").isNull()
    problem = F.when(missing, "component-failed").when(F.col("_t1") != F.col("_t2"), "snapshot-changed")
    gates = F.array_compact(F.array(*(F.when(F.expr(holds), F.lit(code)) for code, holds in CHECK_GATES)))
    warnings = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(f"_w{i}", F.array().cast("array<string>")) for i in (1, 2, 3, 4))))))
    rows = rows.withColumn("problem", problem).withColumn("gates", F.when(F.col("problem").isNull(), gates))
    return rows.select(project, "problem", "gates", F.coalesce(F.size("gates") == 0, F.lit(False)).alias("passed"), warnings.alias("warnings"))


def error_reason(code: Column) -> Column:
    return reduce(lambda rest, x: F.when(code == x[0], x[1]).otherwise(rest), ERROR_REASONS.items(), F.lit(None).cast("string"))


# What an audit reference must not hold.
_LABELLED_SECRET = rf"(?iu)(?:{EDGE}(?:Bearer|Basic)[ \t]+|{EDGE}(?:API[_-]?KEY|ACCESS[_-]?TOKEN|AUTH[_-]?TOKEN|COOKIE|PASSWORD|SECRET)[ \t]*=)"


def audit_reference(x: Column) -> Column:
    """Whether a text may stand as an audit reference: a plain http(s) address without user, query or fragment, or a simple name.

    What begins with a scheme is an address, whatever follows, so ``ticket:12`` isn't a name; only where nothing but slashes follow a
    scheme that needs a host is there no address.
    """
    secret = x.rlike(_LABELLED_SECRET)
    for rule, pattern, _ in screen.CREDENTIALS:
        if rule.startswith(("credential.jwt", "credential.provider")):
            secret = secret | x.rlike("(?iu)" + pattern)
    bad = secret | x.rlike(r"[\x00-\x1F\x7F-\x9F]") | x.rlike(r"\A[/\\]|\A[A-Za-z]:[\\/]") | x.rlike(r"(?:\A|[\\/])(?:home|Users)(?:[\\/]|\z)")
    address = x.rlike(r"(?i)\Ahttps?://[^\s/?#@]+(?:/[^\s?#]*)?\z")
    scheme = x.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") & ~x.rlike(r"(?i)\Ahttps?:") & ~x.rlike(r"(?i)\A(?:ftp|wss?):/*\z")
    name = x.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._:/-]{0,255}\z") & ~x.contains("://") & ~scheme
    return F.coalesce((utf16_length(x).between(1, 256)) & ~bad & (address | name), F.lit(False))
