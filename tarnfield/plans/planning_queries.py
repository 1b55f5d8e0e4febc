"""Planning artifacts made of documents, with every ground for rejection among them, and digests of nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.text import canonical_digest
from tarnfield.operators import eligibility, planning
from tarnfield.plans.tables import table

SCHEMAS = {"spec": "app.spec.v1", "intake": "app.intake.v1", "current_spec": "app.current_spec.v1", "iteration": "app.iteration_metadata.v1"}
#: Iterations of a project.
_EACH = 25
_SPEC, _INTAKE, _GRAPH = "gate-b-spec/spec.json", "gate-a-intake/intake.json", "gate-c-task-graph/task-graph.json"


def _artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files and the ledger of projects of 25 iterations, one for each document; its number says what is odd about it."""
    n, p = F.col("n"), F.col("p")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % _EACH).alias("n"), F.floor(F.col("doc_id") / _EACH).alias("p"))
    day = F.lpad((n + 1).cast("string"), 2, "0")
    time = lambda month, rest: F.concat(F.lit(f"2024-{month}-"), day, F.lit(rest))
    empty, text = F.array().cast("array<string>"), F.lit
    iteration = F.when(n == 19, "It_19").when(n == 22, "maintenance").otherwise(F.concat(text("it-"), n))
    rows = docs.withColumns({"project_id": F.concat(text("p"), p), "it": iteration, "folder": F.concat(text("iterations/"), iteration, text("/")), "status": F.when(n.isin(0, 18, 24), "gate_b_approved").when(n == 4, "gate_a").otherwise("archived")})
    intake = F.struct(
        text("app.intake.v1").alias("schema_version"), F.concat(text("idea "), "text").alias("idea"), text("s").alias("summary"), *(empty.alias(k) for k in ("known_facts", "assumptions", "clarifying_questions", "needs_user_decision", "evidence")),
        F.when(n == 13, "odd").otherwise("ready_for_spec").alias("status"),
    )
    rows = rows.withColumns({"intake": F.to_json(intake), "graph": F.concat(text('{"tasks":['), "doc_id", text("]}"))})
    views = {
        "implementation": F.struct(*(empty.alias(k) for k in planning.IMPLEMENTATION_KEYS)),
        "product": F.struct(F.col("text").alias("problem"), *(empty.alias(k) for k in planning.PRODUCT_KEYS if k != "problem")),
    }
    spec = F.struct(
        F.when(n == 8, "other").otherwise("app.spec.v1").alias("schema_version"), "project_id", F.when(n == 2, "draft").otherwise("approved").alias("approval"), text("../gate-a-intake/intake.json").alias("source_intake"),
        F.when(n == 15, F.repeat(text("0"), F.lit(64))).otherwise(F.sha2("intake", 256)).alias("source_intake_sha256"), empty.alias("clarifying_question_disposition"), empty.alias("evidence"),
        F.when(n == 3, F.array(text("x"))).otherwise(empty).alias("open_decisions"), *(v.alias(k) for k, v in views.items()),
    )
    body = F.to_json(spec)
    rows = rows.withColumn("spec", F.when(n == 7, F.substring(body, 1, 20)).when(n == 9, F.replace(body, text('"goals":[]'), text('"goal":[]'))).otherwise(body))
    path = lambda file: F.concat("folder", text(file))
    held = lambda digest: F.struct(F.lit(True).alias("present"), digest.alias("sha256"))
    closed = F.struct(
        F.col("it").alias("iteration_id"), text("archived").alias("status"), F.when(n == 20, "later").otherwise(time("03", "T10:00:00Z")).alias("closed_at"), F.when(n == 23, "x").otherwise(path(_SPEC)).alias("spec_ref"), path(_GRAPH).alias("task_graph_ref"),
        F.struct(*(F.lit(0).alias(k) for k in ("blocked", "in_progress", "todo")), n.alias("done")).alias("task_status_counts"),
        F.create_map(path(_SPEC), held(F.sha2("spec", 256)), path(_INTAKE), held(F.sha2("intake", 256)), path(_GRAPH), held(F.when(n == 17, F.repeat(text("0"), F.lit(64))).otherwise(F.sha2("graph", 256)))).alias("artifact_hashes"),
    )
    rows = rows.withColumn("closed", closed)
    archive = F.col("status") == "archived"
    meta = F.struct(
        text("app.iteration_metadata.v1").alias("schema_version"), "project_id", F.col("it").alias("iteration_id"), "status", F.when(n == 21, time("04", "T00:00:00Z")).alias("promoted_at"),
        F.when(archive, F.col("closed.closed_at")).alias("closed_at"), F.when(archive, F.col("closed")).alias("close"),
    )
    none = F.lit(None).cast("string")
    file = lambda name, content, revised=none: F.struct(path(name).alias("path"), content.alias("text"), revised.alias("revised_at"))
    each = F.array_compact(F.array(
        file("iteration.json", F.to_json(meta)), F.when(n != 5, file(_SPEC, F.col("spec"))), F.when(n != 6, file(_INTAKE, F.col("intake"), F.when(n == 21, time("05", "T00:00:00Z")))), file(_GRAPH, F.col("graph")),
    ))
    own = rows.select("project_id", F.inline(each))

    listed = (archive & (n != 16)) | (n == 18)
    heads = rows.groupBy("project_id", "p").agg(F.collect_list(F.when(listed, F.col("closed"))).alias("closed_iterations"), F.max(F.when(n == 0, F.col("it"))).alias("first"))
    current = F.struct(
        text("app.current_spec.v1").alias("schema_version"), F.when(p % 10 == 8, "q").otherwise(F.col("project_id")).alias("project_id"), F.when(p % 10 == 9, "lost").otherwise(F.col("first")).alias("active_iteration"), "closed_iterations",
    )
    top = lambda name, content: F.struct(text(name).alias("path"), content.alias("text"), none.alias("revised_at"))
    heads = heads.select("project_id", F.inline(F.array_compact(F.array(top("current-spec.json", F.to_json(current)), F.when(p % 10 != 7, top("decisions.jsonl", text("")))))))

    def record(i: int, kind: str, file: str, digest: Column, at: Column = none) -> Column:
        return F.struct((F.col("doc_id") * 10 + i).alias("sequence"), text(kind).alias("record_type"), path(file).alias("scope"), digest.alias("sha256"), at.alias("at"))

    no_time = n.isin(20, 21)
    ledger = F.array_compact(F.array(
        F.when(n != 10, record(1, "gate.what.approved", _SPEC, F.sha2("spec", 256), F.when(no_time, "soon").otherwise(time("01", "T08:00:00+02:00")))),
        F.when(n != 14, record(2, "gate.what.approved", _INTAKE, F.sha2("intake", 256), F.when(no_time, "soon").otherwise(time("02", "T09:00:00Z")))),
        F.when(n == 11, record(3, "gate.what.revoked", _SPEC, none)), F.when(n == 12, record(4, "scope.added", _SPEC, F.sha2("graph", 256))), record(5, "note", _SPEC, F.sha2("graph", 256)),
    ))
    return own.unionByName(heads), rows.select("project_id", F.inline(ledger))


def artifact_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.planning_entries(*_artifacts(spark, sf_dir), SCHEMAS)


ARTIFACTS_SQL = """
WITH d AS (SELECT doc_id // 25 AS p, doc_id % 25 AS n, lpad((doc_id % 25 + 1)::VARCHAR, 2, '0') AS dd FROM documents),
i AS (SELECT 'p' || p AS project_id, n, dd, 'iterations/' || CASE n WHEN 19 THEN 'It_19' WHEN 22 THEN 'maintenance' ELSE 'it-' || n END || '/' AS f FROM d WHERE p % 10 < 7),
s AS (SELECT *, CASE WHEN n = 19 THEN 'generated_artifact' WHEN n = 22 THEN 'maintenance' WHEN n = 6 THEN 'lineage_invalid' WHEN n IN (2, 3, 4, 18, 24) THEN 'draft' WHEN n IN (7, 8, 9) THEN 'unsupported_schema'
  WHEN n IN (10, 11, 12) THEN 'approval_invalid' WHEN n = 20 THEN 'timestamp_unavailable' END AS reason FROM i WHERE n <> 5),
k AS (SELECT *, CASE WHEN n = 22 THEN 'maintenance' WHEN n IN (2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 18, 19, 24) THEN 'generated_artifact' WHEN n = 13 THEN 'unsupported_schema' WHEN n = 14 THEN 'approval_invalid' WHEN n = 15 THEN 'lineage_invalid'
  WHEN n = 20 THEN 'timestamp_unavailable' END AS reason FROM i WHERE n <> 6),
m AS (SELECT *, CASE WHEN n = 22 THEN 'maintenance' WHEN n = 19 THEN 'unsupported_schema' WHEN n IN (5, 6, 16, 17, 18, 23) THEN 'lineage_invalid' WHEN n IN (0, 2, 3, 4, 7, 8, 9, 10, 11, 12, 24) THEN 'pending_iteration'
  WHEN n = 20 THEN 'timestamp_unavailable' END AS reason FROM i),
a AS (SELECT project_id, f || 'gate-b-spec/spec.json' AS path, unnest(CASE WHEN reason IS NULL THEN ['product-spec', 'implementation-plan'] ELSE [NULL] END) AS kind, reason,
    CASE WHEN reason IS NULL THEN CASE WHEN n = 21 THEN '2024-04-' || dd || 'T00:00:00.000Z' ELSE '2024-01-' || dd || 'T06:00:00.000Z' END END AS "at", CASE WHEN reason IS NULL THEN CASE WHEN n = 21 THEN 'promotion' ELSE 'approval' END END AS at_source FROM s
  UNION ALL SELECT project_id, f || 'gate-a-intake/intake.json', CASE WHEN reason IS NULL THEN 'intake' END, reason,
    CASE WHEN reason IS NULL THEN CASE WHEN n = 21 THEN '2024-05-' || dd || 'T00:00:00.000Z' ELSE '2024-02-' || dd || 'T09:00:00.000Z' END END, CASE WHEN reason IS NULL THEN CASE WHEN n = 21 THEN 'revision' ELSE 'approval' END END FROM k
  UNION ALL SELECT project_id, f || 'iteration.json', CASE WHEN reason IS NULL THEN 'archived-iteration' END, reason, CASE WHEN reason IS NULL THEN '2024-03-' || dd || 'T10:00:00.000Z' END, CASE WHEN reason IS NULL THEN 'close' END FROM m
  UNION ALL SELECT project_id, f || 'gate-c-task-graph/task-graph.json', NULL, CASE WHEN n = 22 THEN 'maintenance' ELSE 'task_or_run' END, NULL, NULL FROM i
  UNION ALL SELECT DISTINCT project_id, unnest(['current-spec.json', 'decisions.jsonl']), NULL, 'generated_artifact', NULL, NULL FROM i)
SELECT project_id, path, kind, CASE WHEN reason IS NULL THEN 'include' WHEN reason IN ('draft', 'maintenance', 'generated_artifact', 'pending_iteration', 'task_or_run') THEN 'exclude' ELSE 'error' END AS decision, reason, "at", at_source FROM a
UNION ALL SELECT DISTINCT 'p' || p, NULL, NULL, 'error', CASE WHEN p % 10 = 8 THEN 'project_mismatch' ELSE 'unsupported_schema' END, NULL, NULL FROM d WHERE p % 10 >= 7"""


def nested_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a nested value and as the same one with its arrays and keys in another order: one digest."""
    lines, pair = F.split(F.coalesce("text", F.lit("")), "\n", -1), F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    docs = table(spark, sf_dir, "documents")
    none = F.slice(lines, 1, 0)
    one = F.to_json(F.struct(F.array(lines, none, pair).alias("parts"), F.col("doc_id").alias("id")))
    other = F.to_json(F.struct(F.col("doc_id").alias("id"), F.array(F.reverse(pair), F.reverse(lines), none).alias("parts")))
    rows = docs.select("doc_id", canonical_digest(one).alias("digest"), canonical_digest(other).alias("other"))
    return rows.select("doc_id", "digest", (F.col("digest") == F.col("other")).alias("same"))


DIGESTS_SQL = """
WITH q AS (SELECT doc_id, unnest([string_split(coalesce(text, ''), chr(10)), [coalesce(source, '-'), coalesce(lang, '-')]]) AS x FROM documents), s AS (SELECT doc_id, list_sort(list_transform(x, lambda y: to_json(y)::VARCHAR)) AS l FROM q),
t AS (SELECT doc_id, string_agg('    [' || chr(10) || '      ' || array_to_string(l, ',' || chr(10) || '      ') || chr(10) || '    ],' || chr(10), '' ORDER BY array_to_string(l, ',') || ']') AS parts FROM s GROUP BY 1)
SELECT doc_id, 'sha256:' || sha256('{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || '  "parts": [' || chr(10) || parts || '    []' || chr(10) || '  ]' || chr(10) || '}' || chr(10)) AS digest, true AS same FROM t"""

QUERIES = {f.__name__: f for f in (artifact_eligibility, nested_digests)}
ORACLES = {"artifact_eligibility": ARTIFACTS_SQL, "nested_digests": DIGESTS_SQL}
