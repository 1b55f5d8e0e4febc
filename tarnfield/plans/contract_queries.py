"""Typed entities, evaluation reports, contexts, single-use handles and plans to apply, made of the given tables, with odd ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators import context, entities, handles, reports
from tarnfield.plans import lexical_queries
from tarnfield.plans.tables import table


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every turn as an entity whose fields hold or break the schema by its text, its conversation and its turn; turns answer one another."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("k", c + t)
    kind = F.when(t == 7, "notes").when(F.col("role") == "user", "decisions").when(F.col("role") == "assistant", "failures").otherwise("verifications")
    pick = lambda x, *values: F.element_at(F.array(*map(F.lit, values)), (x % len(values) + 1).cast("int"))
    fields = {
        "title": F.substring("text", 1, 210), "summary": F.col("text"), "sourceRefs": F.when(c % 5 != 3, F.array(F.concat(F.lit("c"), c))), "sourceRevision": F.when(c % 7 != 2, F.concat(F.lit("sha256:"), F.sha2("text", 256))).otherwise("sha256:x"),
        "confidence": t / 5.0, "provenanceState": pick(c, "extracted", "merged", "guessed"), "archived": F.when(c % 4 == 1, F.lit(True)), "archiveReason": F.when(c % 3 == 0, F.lit("old")).when(c % 3 == 1, F.lit(" ")),
        "status": pick(F.col("k"), None, "archived", "resolved", "passed", "superseded", "active"), "failureClass": F.when((kind == "failures") & (c % 2 == 0), F.lit("timeout")), "resolution": F.when((kind == "failures") & (c % 2 == 1), F.lit("done")),
        "verificationKind": F.when(kind == "verifications", F.lit("test")), "evidenceRefs": F.when(kind == "verifications", F.array().cast("array<string>")), "zeta": F.when(c % 11 == 0, F.lit(1)), "alpha": F.when(c % 22 == 0, F.lit(1)),
    }
    body = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    body = F.when(c % 8 == 5, F.replace(body, F.lit('"archived":true'), F.lit('"archived":"yes"'))).when(c % 17 == 9, F.lit("[]")).otherwise(body)
    made = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), kind.alias("entity_type"), body.alias("body"))
    link = lambda name, cond, other: rows.where(cond).select(F.lit(name).alias("relation"), F.concat_ws("-", "conv_id", "turn").alias("from_id"), F.concat_ws("-", "conv_id", other).alias("to_id"))
    return made, link("verified-by", "turn > 0", F.lit(0)).unionByName(link("supersedes", "turn > 1", t - 2))


def entity_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.entity_problems(*_entities(spark, sf_dir))
    return found.select("id", "entity_type", "state", F.array_join("violations", ",").alias("violations"), F.array_join("defaulted", ",").alias("defaulted"))


ENTITY_SQL = """
WITH e AS (SELECT conv_id AS c, turn AS t, text, CASE WHEN turn = 7 THEN 'notes' WHEN role = 'user' THEN 'decisions' WHEN role = 'assistant' THEN 'failures' ELSE 'verifications' END AS kind,
  [NULL, 'archived', 'resolved', 'passed', 'superseded', 'active'][(conv_id + turn) % 6 + 1] AS status, conv_id % 17 = 9 AND conv_id % 8 <> 5 AS bare FROM conversations),
s AS (SELECT *, CASE WHEN kind <> 'notes' THEN coalesce(CASE WHEN NOT bare THEN status END, CASE kind WHEN 'decisions' THEN 'active' WHEN 'failures' THEN 'open' ELSE 'recorded' END) END AS state FROM e),
r AS (SELECT s.*, EXISTS (SELECT 1 FROM s o WHERE o.c = s.c AND o.t = s.t + 2 AND o.t > 1 AND o.kind = 'decisions' AND o.state = 'active') AS replaced,
  EXISTS (SELECT 1 FROM s o WHERE o.c = s.c AND o.t = 0 AND s.t > 0 AND o.kind = 'verifications' AND o.state = 'passed') AS verified FROM s),
u AS (SELECT * FROM r)
SELECT concat_ws('-', c, t) AS id, kind AS entity_type, state, concat_ws(',', CASE WHEN bare THEN 'body:type' WHEN kind = 'notes' THEN 'entity_type:unknown' ELSE nullif(concat_ws(',',
    CASE WHEN text IS NULL THEN 'title:required' WHEN length(text) NOT BETWEEN 1 AND 200 THEN 'title:length' END, CASE WHEN text IS NULL THEN 'summary:required' WHEN length(text) NOT BETWEEN 1 AND 4000 THEN 'summary:length' END,
    CASE WHEN c % 5 = 3 THEN 'sourceRefs:required' END, CASE WHEN c % 7 = 2 THEN 'sourceRevision:length' WHEN text IS NULL THEN 'sourceRevision:required' END, CASE WHEN t > 5 THEN 'confidence:range' END, CASE WHEN c % 3 = 2 THEN 'provenanceState:enum' END,
    CASE WHEN c % 8 = 5 THEN 'archived:type' END, CASE kind WHEN 'failures' THEN CASE WHEN c % 2 = 1 THEN 'failureClass:required' END END,
    CASE WHEN NOT (status IS NULL OR list_contains(CASE kind WHEN 'decisions' THEN ['active', 'superseded', 'archived'] WHEN 'failures' THEN ['open', 'resolved', 'archived'] ELSE ['recorded', 'passed', 'failed', 'archived'] END, status)) THEN 'status:enum' END,
    CASE WHEN c % 22 = 0 THEN 'alpha:unknown' END, CASE WHEN c % 11 = 0 THEN 'zeta:unknown' END), '') END,
  CASE WHEN kind <> 'notes' AND state = 'archived' AND c % 3 <> 0 THEN 'archiveReason:state' END, CASE WHEN kind = 'failures' AND state = 'resolved' AND c % 2 = 0 THEN 'resolution:state' END,
  CASE WHEN kind = 'decisions' AND state = 'superseded' AND NOT replaced THEN 'supersedes:state' END, CASE WHEN kind = 'failures' AND state = 'resolved' AND NOT verified THEN 'verified-by:state' END) AS violations,
  CASE WHEN bare OR kind = 'notes' THEN '' ELSE concat_ws(',', CASE WHEN c % 4 <> 1 THEN 'archived' END, CASE WHEN status IS NULL THEN 'status' END) END AS defaulted FROM u"""

_CATEGORIES = ("korean-exact", "korean-spacing-morphology", "korean-synonym", "korean-to-english", "code-symbol-korean")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each user, its numbers from the user's events, with false flags and repeated or missing cells."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    u, n, i = F.col("user_id"), F.col("n"), F.col("i")
    parts = [("", m) for m in reports.MODES] + [("words", "lexical"), ("grams", "lexical")]
    grid = [F.struct(F.lit(5 * p + k).alias("i"), F.lit(part).alias("part"), F.lit(mode).alias("mode"), F.lit(category).alias("category")) for p, (part, mode) in enumerate(parts) for k, category in enumerate(_CATEGORIES)]
    rows = users.select("user_id", "n", F.inline(F.array(*grid)))
    # The selected candidate has the report's own lexical numbers, but for a few users.
    j = F.when((F.col("part") == "grams") & (u % 19 != 3), i - 20).otherwise(i)
    mrr, recall = ((n * 31 + j * 17) % 61 + 40) / 100.0, F.when((j % 5 == 4) & (u % 3 == 0), 1.0).otherwise(((n * 13 + j * 29) % 41 + 60) / 100.0)
    gate_mrr = F.when((F.col("mode") == "lexical") & (F.col("category") == "korean-exact"), 0.75)
    gate_recall = F.when((F.col("mode") == "lexical") & (F.col("category") == "korean-exact"), 0.9).when((F.col("mode") == "semantic") & (F.col("category") == "korean-synonym"), 0.8).when((F.col("mode") == "semantic") & (F.col("category") == "korean-to-english"), 0.7)
    fine = F.coalesce(mrr >= gate_mrr, F.lit(True)) & F.coalesce(recall >= gate_recall, F.lit(True))
    cell = F.struct(
        "category", "mode", F.when((u + i) % 67 == 1, mrr + 1).otherwise(mrr).alias("mrr"), recall.alias("recallAt5"), F.when((u + i) % 37 == 0, ~fine).otherwise(fine).alias("passed"), F.when((u + i) % 71 == 2, 0).otherwise(2).alias("queryCount"),
        F.struct(gate_mrr.alias("minimumMrr"), F.when((u + i) % 73 == 3, 0.5).otherwise(gate_recall).alias("minimumRecallAt5")).alias("thresholds"),
    )
    rows = rows.where((u + i) % 53 != 0).withColumn("cell", cell).withColumn("copy", F.explode(F.when((u + i) % 59 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    lists = rows.groupBy("user_id", "n").agg(*(F.collect_list(F.when(F.col("part") == p, F.col("cell"))).alias(p or "own") for p in ("", "words", "grams")))
    candidate = lambda name, decision, b: F.struct(F.lit(name).alias("candidateId"), decision.alias("decision"), b.alias("indexBytes"), F.lit(None).cast("string").alias("indexBytesUnavailableReason"), F.col(name).alias("metrics"))
    candidates = F.array(candidate("words", F.when(u % 23 == 5, "selected").otherwise("rejected"), F.when(u % 31 != 7, n)), candidate("grams", F.lit("selected"), n))
    reasons = F.when(u % 4 == 1, F.array(F.lit("slower"))).otherwise(F.array().cast("array<string>"))
    regression = F.struct((u % 6 != 2).alias("compatible"), (u % 4 != 1).alias("passed"), reasons.alias("reasonCodes"))
    body = F.to_json(F.struct(F.col("own").alias("metrics"), candidates.alias("candidates"), (u % 2 == 0).alias("candidateComparisonPassed"), (u % 5 == 0).alias("overallPassed"), regression.alias("regression")))
    return lists.select(F.col("user_id").alias("report_id"), F.when(u % 29 == 11, F.substring(body, 1, 50)).otherwise(body).alias("body"))


def report_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_problems(_reports(spark, sf_dir))


REPORT_SQL = """
WITH us AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1),
g AS (SELECT p * 5 + k AS i, ['', '', '', 'words', 'grams'][p + 1] AS part, ['lexical', 'semantic', 'hybrid', 'lexical', 'lexical'][p + 1] AS mode, ['korean-exact', 'korean-spacing-morphology', 'korean-synonym', 'korean-to-english', 'code-symbol-korean'][k + 1] AS category FROM range(5) a(p), range(5) b(k)),
j AS (SELECT *, CASE WHEN part = 'grams' AND u % 19 <> 3 THEN i - 20 ELSE i END AS j FROM us, g),
v AS (SELECT *, ((n * 31 + j * 17) % 61 + 40) / 100.0::DOUBLE AS m0, CASE WHEN j % 5 = 4 AND u % 3 = 0 THEN 1.0 ELSE ((n * 13 + j * 29) % 41 + 60) / 100.0::DOUBLE END AS r FROM j),
w AS (SELECT *, CASE WHEN (u + i) % 67 = 1 THEN m0 + 1 ELSE m0 END AS m, CASE WHEN mode = 'lexical' AND category = 'korean-exact' THEN m0 >= 0.75 AND r >= 0.9 WHEN mode = 'semantic' AND category = 'korean-synonym' THEN r >= 0.8 WHEN mode = 'semantic' AND category = 'korean-to-english' THEN r >= 0.7 ELSE true END AS fine0 FROM v),
x AS (SELECT *, CASE WHEN mode = 'lexical' AND category = 'korean-exact' THEN m >= 0.75 AND r >= 0.9 WHEN mode = 'semantic' AND category = 'korean-synonym' THEN r >= 0.8 WHEN mode = 'semantic' AND category = 'korean-to-english' THEN r >= 0.7 ELSE true END AS fine,
  CASE WHEN (u + i) % 37 = 0 THEN NOT fine0 ELSE fine0 END AS passed, CASE WHEN (u + i) % 71 = 2 THEN 0 ELSE 2 END AS q, concat_ws('/', nullif(part, ''), mode, category) AS detail FROM w WHERE u % 29 <> 11),
c AS (SELECT * FROM x WHERE (u + i) % 53 <> 0), d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE (u + i) % 59 = 0),
lex AS (SELECT u, category, {'m': m, 'r': r, 'p': passed, 'q': q} AS a FROM c WHERE part = '' AND mode = 'lexical'), sel AS (SELECT u, category, {'m': m, 'r': r, 'p': passed, 'q': q} AS b FROM c WHERE part = 'grams'),
ch AS (SELECT u, CASE WHEN u % 23 = 5 THEN 'words' ELSE 'grams' END AS chosen FROM us WHERE u % 29 <> 11),
k AS (SELECT ch.u, any_value(c.m) FILTER (part = chosen AND category = 'korean-spacing-morphology') AS sm, any_value(c.r) FILTER (part = chosen AND category = 'korean-spacing-morphology') AS sr, any_value(c.r) FILTER (part = chosen AND category = 'code-symbol-korean') AS code,
  any_value(c.m) FILTER (part = 'words' AND category = 'korean-spacing-morphology') AS bm, any_value(c.r) FILTER (part = 'words' AND category = 'korean-spacing-morphology') AS br, bool_and(fine) FILTER (part = '' AND mode = 'hybrid') AS hybrid, bool_and(fine) FILTER (part = '') AS every FROM ch JOIN c USING (u) GROUP BY ch.u)
SELECT u AS report_id, 'unreadable' AS problem, NULL AS detail FROM us WHERE u % 29 = 11
UNION ALL SELECT u, 'range', detail FROM d WHERE m > 1 OR q < 1 UNION ALL SELECT u, 'thresholds', detail FROM d WHERE (u + i) % 73 = 3 UNION ALL SELECT u, 'passed', detail FROM d WHERE passed <> fine
UNION ALL SELECT u, 'repeated-cell', detail FROM c WHERE (u + i) % 59 = 0 UNION ALL SELECT u, 'missing-cell', detail FROM x WHERE (u + i) % 53 = 0
UNION ALL SELECT u, 'index-bytes', 'words' FROM ch WHERE u % 31 = 7 UNION ALL SELECT u, 'selected', NULL FROM ch WHERE u % 23 = 5
UNION ALL SELECT u, 'selected-metrics', category FROM lex FULL JOIN sel USING (u, category) WHERE a IS DISTINCT FROM b AND u % 23 <> 5
UNION ALL SELECT u, 'regression', NULL FROM ch WHERE u % 4 <> 1 AND u % 6 = 2
UNION ALL SELECT u, 'comparison', NULL FROM k WHERE (u % 2 = 0) <> coalesce(sr >= br AND sm >= bm AND (sr > br OR sm > bm) AND code = 1 AND hybrid, false)
UNION ALL SELECT u, 'overall', NULL FROM k WHERE (u % 5 = 0) <> (coalesce(every, false) AND u % 2 = 0 AND u % 4 <> 1)"""


def context_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context for every benchmark item: its best documents, some of which are gone, by budgets that cut."""
    item = F.col("item_id")
    requests = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), (item * 37 % 900 + 20).alias("budget"), (item % 5 + 1).alias("top_pages"), (item % 7).alias("top_chunks"))
    ranked = lexical_queries._batch(spark, sf_dir, 5).select("query_id", "page_id", "rank", "score")
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").where("doc_id % 13 <> 4")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.substring(text, 1, 120).alias("summary"))
    chunks = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(text, "\n", -1)).alias("chunk", "text")).where("chunk > 0 and text <> ''")
    return context.context_results(requests, ranked, pages, chunks).withColumn("rank", F.col("rank").cast("long"))


CONTEXT_SQL = f"""
WITH {lexical_queries._BATCH.lstrip()},
q AS (SELECT item_id AS query_id, item_id * 37 % 900 + 20 AS budget, item_id % 5 + 1 AS tp, item_id % 7 AS tc FROM benchmark),
p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 13 <> 4),
ch AS (SELECT * FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS c FROM p) WHERE c > 0 AND x <> ''),
k AS (SELECT q.*, br.doc_id, br.rank, br.score FROM q JOIN br USING (query_id) WHERE rank <= 5 AND rank <= tp),
hd AS (SELECT k.*, 0 AS c, ceil(length(substr(t, 1, 120)) / 4.0)::BIGINT AS n FROM k JOIN p USING (doc_id)),
o AS (SELECT k.*, c, ceil(length(x) / 4.0)::BIGINT AS n FROM k JOIN ch USING (doc_id) WHERE c <= tc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, c) <= tc),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank, c ROWS UNBOUNDED PRECEDING) <= budget AS fits FROM (FROM hd UNION ALL FROM o)),
t AS (SELECT query_id, coalesce(sum(n) FILTER (fits), 0)::BIGINT AS e, bool_or(NOT fits) AS cut FROM u GROUP BY 1),
g AS (SELECT query_id, doc_id, bool_or(fits AND c = 0) AS head, count(*) FILTER (fits AND c > 0) AS chunks, coalesce(sum(n) FILTER (fits), 0)::BIGINT AS n FROM u GROUP BY ALL)
SELECT k.query_id, k.doc_id AS page_id, k.rank, k.score, CASE WHEN k.doc_id % 13 = 4 THEN 'page-missing' WHEN NOT coalesce(head, false) THEN 'over-budget' WHEN tc > 0 AND k.doc_id NOT IN (SELECT doc_id FROM ch) THEN 'no-chunks' END AS gap,
  coalesce(g.chunks, 0) AS chunks, coalesce(g.n, 0) AS page_tokens, k.budget AS requested_tokens, coalesce(t.e, 0) AS estimated_tokens, coalesce(t.cut, false) AS truncated
FROM k LEFT JOIN g ON g.query_id = k.query_id AND g.doc_id = k.doc_id LEFT JOIN t ON t.query_id = k.query_id"""


def single_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of handles, five users to a handle; signups issue them for half a day."""
    rows = table(spark, sf_dir, "events").withColumn("handle", F.floor(F.col("user_id") / 5))
    issued = rows.where("event_type = 'signup'").select("handle", F.col("ts").alias("issued_at"))
    uses = rows.where("event_type <> 'signup'").select(F.col("event_id").alias("use_id"), "handle", F.col("ts").alias("at"))
    return handles.single_use(uses, issued, 43_200).select("use_id", "handle", "outcome")


SINGLE_USE_SQL = """
WITH e AS (SELECT event_id AS use_id, user_id // 5 AS handle, event_type, ts FROM events), i AS (SELECT handle, min(ts) AS t0 FROM e WHERE event_type = 'signup' GROUP BY 1),
u AS (SELECT e.*, t0, coalesce(ts >= t0 AND ts <= t0 + INTERVAL 43200 SECOND, false) AS valid FROM e LEFT JOIN i USING (handle) WHERE event_type <> 'signup')
SELECT use_id, handle, CASE WHEN valid THEN CASE WHEN row_number() OVER (PARTITION BY handle, valid ORDER BY ts, use_id) = 1 THEN 'granted' ELSE 'consumed' END WHEN ts > t0 THEN 'expired' ELSE 'unknown' END AS outcome FROM u"""


def plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an attempt to apply one of its user's plans against the user's newest state."""
    events = table(spark, sf_dir, "events")
    current = events.groupBy(F.col("user_id").alias("project_id")).agg(F.max_by("event_type", "event_id").alias("fingerprint"))
    plans = events.where("event_id % 3 = 0").select(F.col("event_id").alias("plan_id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("fingerprint"), F.when(F.col("event_id") % 2 == 0, "unchanged").otherwise("changed").alias("disposition"), (F.col("event_id") % 5 == 0).alias("migration"))
    attempts = events.select(F.col("event_id").alias("attempt"), (F.col("event_id") - F.col("event_id") % 6).alias("plan_id"), "user_id").join(plans.select("plan_id", F.col("project_id").alias("owner")), "plan_id", "left")
    attempts = attempts.select("attempt", "plan_id", F.when(F.col("attempt") % 4 == 1, F.col("user_id")).otherwise(F.coalesce("owner", "user_id")).alias("project_id"))
    return handles.apply_outcomes(attempts, plans, current)


OUTCOMES_SQL = """
WITH c AS (SELECT user_id AS project_id, arg_max(event_type, event_id) AS now FROM events GROUP BY 1),
a AS (SELECT e.event_id AS attempt, e.event_id - e.event_id % 6 AS plan_id, CASE WHEN e.event_id % 4 = 1 THEN e.user_id ELSE p.user_id END AS project_id, p.user_id AS owner, p.event_type AS planned FROM events e LEFT JOIN events p ON p.event_id = e.event_id - e.event_id % 6),
b AS (SELECT a.*, coalesce(owner = project_id AND planned = now, false) AS bound, plan_id % 5 = 0 AS migration FROM a LEFT JOIN c USING (project_id)),
f AS (SELECT *, min(CASE WHEN bound AND NOT migration THEN attempt END) OVER (PARTITION BY plan_id) AS first FROM b)
SELECT attempt, plan_id, project_id, CASE WHEN NOT bound OR coalesce(attempt > first, false) THEN 'binding-invalid' WHEN migration THEN 'migration-required' WHEN plan_id % 2 = 0 THEN 'unchanged' ELSE 'applied' END AS outcome FROM f"""

QUERIES = {f.__name__: f for f in (entity_schema, report_decode, context_results, single_use, plan_outcomes)}
ORACLES = {"entity_schema": ENTITY_SQL, "report_decode": REPORT_SQL, "context_results": CONTEXT_SQL, "single_use": SINGLE_USE_SQL, "plan_outcomes": OUTCOMES_SQL}
