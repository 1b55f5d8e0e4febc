"""Backend results made of the orders and their lines, eight capabilities by turns, with odd ones among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators import results
from tarnfield.plans.tables import table


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each order: its lines are the items, in the order of their values."""
    line = F.struct(F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 40).alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    rows = rows.withColumns({"k": F.floor(F.col("o") / 8), "cap": F.col("o") % 8, "n": F.size("x")})
    k, n, x, none = F.col("k"), F.col("n"), F.col("x"), F.array().cast("array<string>")
    each = lambda f: F.transform(x, f)
    slug, page = (lambda r: F.concat(F.lit("p"), r["p"].cast("string"))), (lambda r: F.concat(F.lit("d/p"), r["p"].cast("string")))
    obj = lambda **fields: F.struct(*(v.alias(name) for name, v in fields.items()))
    first = lambda r, rule, odd, plain: F.when(rule & (r["ln"] == 1), odd).otherwise(plain)
    by_flag = lambda r, a, b, c: F.when(r["f"] == "R", a).when(r["f"] == "A", b).otherwise(c)
    many = lambda flag: F.size(F.filter(x, lambda r: r["f"] == flag))
    candidate = lambda r: F.concat_ws("-", F.concat(F.lit("s"), r["s"].cast("string")), F.lower(F.lpad(F.hex(r["s"]), 8, "0")))
    review = lambda keep: F.transform(F.filter(x, keep), lambda r: obj(id=candidate(r), slug=F.concat(F.lit("s"), r["s"].cast("string")), reasons=F.array(F.lit("all"))))
    compiled = obj(
        errors=F.when(k % 11 == 3, F.array(F.lit("e"))).otherwise(none), compiled=F.when(k % 5 != 0, n).otherwise(0), deleted=F.lit(0), skipped=F.when(k % 13 == 4, -1).otherwise(k % 4), concepts=none,
        pages=each(lambda r: first(r, k % 17 == 5, F.lit(".."), F.when(r["p"] % 2 == 1, page(r)).otherwise(slug(r)))), candidates=each(candidate),
        review=obj(held=review(lambda r: (r["ln"] % 2 == 1) & ~((k % 7 == 6) & (r["ln"] == 1))), forced=review(lambda r: r["ln"] % 2 == 0)),
    )
    code = F.when(k % 8 == 1, "query-embedding-unavailable").when(k % 8 == 2, "semantic-retrieval-error").when(k % 8 == 3, "Bad Code").otherwise("fine")
    context = obj(
        version=F.when(k % 12 == 7, 2).otherwise(1), warnings=F.when((k % 8 < 4) | (k % 2 == 0), F.array(obj(code=code))), budget=obj(estimatedTokens=F.when(k % 10 == 5, n + 0.5).otherwise(n + 0.0), requestedTokens=F.lit(100), truncated=k % 2 == 0),
        primary=each(lambda r: obj(id=page(r), chunks=F.array(obj(text=r["f"])), reasons=F.array(F.lit("hit")), score=r["q"], summary=F.lit("s"), title=F.when(~((k % 9 == 8) & (r["ln"] == 2)), "t"))),
        gaps=F.array(obj(code=F.lit("gone"), pageId=F.when(k % 14 == 9, "bad").otherwise("d/gone"))),
    )
    most, least = F.array_max(each(lambda r: r["q"])), F.array_min(each(lambda r: r["q"]))
    evaluation = obj(
        suite=F.when(k % 12 == 1, "slow").when(F.col("cap") == 2, "fast").otherwise("full"), health=obj(score=F.lit(50), pendingReviews=n), citationCoverage=obj(coveragePercent=most * 2.2, precisionPercent=100 - least),
        stats=obj(pageCount=n, sourceCount=n), citationSupport=F.when((F.col("cap") == 3) != (k % 15 == 2), obj(judgeErrors=F.when(k % 8 == 5, 1).otherwise(0), meanScore=most / 20)), thresholdViolations=F.transform(F.filter(x, lambda r: r["f"] == "R"), slug),
    )
    lint = obj(
        results=each(lambda r: obj(file=first(r, k % 10 == 7, F.lit("../x"), F.concat(F.lit("w/"), slug(r), F.lit(".md"))), rule=F.lit("r.1"), severity=by_flag(r, "error", "warning", "info"), line=r["ln"])),
        errors=many("R") + (k % 9 == 2).cast("int"), info=n - many("R") - many("A"), warnings=many("A") + (k % 11 == 4).cast("int"),
    )
    refs = each(lambda r: obj(pageId=page(r), slug=slug(r)))
    query = obj(
        pageIds=each(page), refs=F.when(k % 13 == 1, F.slice(refs, 1, n - 1)).otherwise(refs), selectedPages=F.when(k % 9 == 4, F.reverse(each(slug))).otherwise(each(slug)), saved=F.when(k % 15 == 7, "x"), answer=F.when(k % 14 == 3, " \t").otherwise("so"),
    )
    search = obj(
        pages=each(lambda r: obj(slug=slug(r), title=F.when(k % 16 != 2, "t"), summary=F.lit("s"))), refs=each(lambda r: obj(kind=first(r, k % 9 == 8, F.lit("other"), by_flag(r, "chunk", "index", "page")), pageId=page(r), slug=slug(r), title=F.lit("t"))),
    )
    status = obj(
        pendingChanges=each(lambda r: obj(file=first(r, k % 13 == 11, F.lit("a/b.md"), F.concat(slug(r), F.lit(".md"))), status=by_flag(r, "changed", "deleted", "new"))), pendingChangesCount=n - (k % 6 == 5).cast("int"), stateStatus=F.when(k % 10 == 9, "corrupt").otherwise("ok"),
        pages=obj(total=n), stalePages=none, staleCount=F.lit(0), orphanedPages=F.array(F.lit("o")), orphanedCount=k % 4, pendingCandidates=F.lit(0), sources=n,
        lastCompiledAt=F.when(k % 19 == 6, "2024-02-30T00:00:00.000Z").when(k % 3 == 1, "never").otherwise("2024-02-29T00:00:00.000Z"),
    )
    body: Column = F.to_json(compiled)
    for cap, made in ((1, context), (2, evaluation), (3, evaluation), (4, lint), (5, query), (6, search), (7, F.replace(F.to_json(status), F.lit('"never"'), F.lit("null")))):
        body = F.when(F.col("cap") == cap, made if cap == 7 else F.to_json(made)).otherwise(body)
    names = F.array(*map(F.lit, ("compile", "context", "eval-fast", "eval-full", "lint", "query", "search", "status")))
    capability = F.when(F.col("o") % 89 == 7, "compost").otherwise(F.element_at(names, (F.col("cap") + 1).cast("int")))
    return rows.select(F.col("o").alias("result_id"), capability.alias("capability"), F.when(F.col("o") % 97 == 5, F.substring(body, 1, 20)).otherwise(body).alias("body"))


def result_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.normalized_results(_results(spark, sf_dir))
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return found.select("result_id", "capability", "status", "detail", "outcome", F.array_join("items", ",").alias("items"), counts.alias("counts"), F.array_join("warnings", ",").alias("warnings"))


RESULT_SQL = """
WITH g AS (SELECT l_orderkey AS o, l_orderkey // 8 AS k, l_orderkey % 8 AS cap, count(*) AS n, bool_or(l_linenumber = 1) AS one, bool_or(l_linenumber = 2) AS two, count(DISTINCT l_partkey % 40) AS ps, count(DISTINCT l_suppkey) AS ss,
  max(l_quantity) AS most, min(l_quantity) AS least, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a,
  list(l_partkey % 40 ORDER BY l_linenumber, l_partkey % 40, l_suppkey, l_returnflag, l_quantity) AS p FROM lineitem GROUP BY 1),
v AS (SELECT *, CASE WHEN o % 89 = 7 THEN 'compost' ELSE ['compile', 'context', 'eval-fast', 'eval-full', 'lint', 'query', 'search', 'status'][cap + 1] END AS capability,
  CASE WHEN o % 89 = 7 THEN 'unknown-capability:' WHEN o % 97 = 5 THEN 'unreadable:' ELSE CASE cap
  WHEN 0 THEN CASE WHEN k % 11 = 3 THEN 'failed:errors' WHEN k % 13 = 4 THEN 'contract:skipped' WHEN k % 17 = 5 AND one THEN 'contract:pages' WHEN ps < n THEN 'contract:pages:repeated' WHEN ss < n THEN 'contract:candidates:repeated' WHEN k % 7 = 6 AND one THEN 'contract:review:other-ids' END
  WHEN 1 THEN CASE WHEN k % 12 = 7 THEN 'contract:version' WHEN k % 8 = 3 THEN 'contract:warnings' WHEN k % 8 = 1 THEN 'provider-unavailable:warnings' WHEN k % 8 = 2 THEN 'failed:warnings' WHEN k % 9 = 8 AND two THEN 'contract:primary' WHEN k % 14 = 9 THEN 'contract:gaps' WHEN k % 10 = 5 THEN 'contract:budget.estimatedTokens' END
  WHEN 4 THEN CASE WHEN k % 10 = 7 AND one THEN 'contract:results' WHEN k % 9 = 2 THEN 'contract:errors:total' WHEN k % 11 = 4 THEN 'contract:warnings:total' END
  WHEN 5 THEN CASE WHEN k % 15 = 7 THEN 'contract:saved' WHEN k % 13 = 1 THEN 'contract:refs:number' WHEN k % 9 = 4 AND list_reverse(p) <> p THEN 'contract:refs:slug' WHEN ps < n THEN 'contract:pageIds:repeated' WHEN k % 14 = 3 THEN 'contract:answer' END
  WHEN 6 THEN CASE WHEN k % 16 = 2 THEN 'contract:pages' WHEN k % 9 = 8 AND one THEN 'contract:refs' WHEN ps < n THEN 'contract:refs:repeated' END
  WHEN 7 THEN CASE WHEN k % 13 = 11 AND one THEN 'unsafe-item:pendingChanges' WHEN k % 6 = 5 THEN 'contract:pendingChangesCount:fewer' WHEN ps < n THEN 'contract:pendingChanges:repeated' WHEN k % 10 = 9 THEN 'contract:stateStatus:pending' WHEN k % 19 = 6 THEN 'contract:lastCompiledAt' WHEN k % 4 = 0 THEN 'contract:orphanedCount:fewer' END
  ELSE CASE WHEN k % 12 = 1 THEN 'contract:suite' WHEN k % 15 = 2 THEN 'contract:citationSupport' WHEN cap = 3 AND k % 8 = 5 THEN 'failed:citationSupport.judgeErrors' WHEN cap = 3 AND most / 20 > 2 THEN 'contract:citationSupport.meanScore' WHEN most * 2.2 > 100 THEN 'contract:citationCoverage.coveragePercent' END END END AS bad FROM g),
w AS (SELECT *, CASE WHEN bad IS NULL THEN 'ok' ELSE split_part(bad, ':', 1) END AS status FROM v)
SELECT o AS result_id, capability, status, nullif(substr(bad, length(status) + 2), '') AS detail, CASE WHEN status = 'ok' THEN CASE WHEN cap = 0 AND k % 5 = 0 THEN 'unchanged' ELSE 'succeeded' END END AS outcome,
  CASE WHEN status = 'ok' THEN array_to_string(CASE cap WHEN 0 THEN list_sort([CASE WHEN y % 2 = 1 THEN 'd/p' ELSE 'concepts/p' END || y FOR y IN p]) WHEN 4 THEN list_sort(list_distinct(['w/p' || y || '.md' FOR y IN p])) WHEN 7 THEN list_sort(['p' || y || '.md' FOR y IN p])
    WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN []::VARCHAR[] ELSE ['d/p' || y FOR y IN p] END, ',') END AS items,
  CASE WHEN status = 'ok' THEN CASE cap WHEN 0 THEN concat('candidates=', n, ',compiled=', CASE WHEN k % 5 <> 0 THEN n ELSE 0 END, ',deleted=0,skipped=', k % 4) WHEN 1 THEN concat('estimated=', n, ',gaps=1,requested=100') WHEN 4 THEN concat('errors=', r, ',info=', n - r - a, ',warnings=', a)
    WHEN 5 THEN concat('pages=', n) WHEN 6 THEN concat('pages=', n) WHEN 7 THEN concat('candidates=0,orphaned=', k % 4, ',pages=', n, ',pending=', n, ',sources=', n, ',stale=0') ELSE concat('pages=', n, ',reviews=', n, ',sources=', n, ',violations=', r) END END AS counts,
  CASE WHEN status = 'ok' THEN CASE WHEN cap = 1 AND k % 2 = 0 THEN 'fine' ELSE '' END END AS warnings FROM w"""

QUERIES = {"result_contracts": result_contracts}
ORACLES = {"result_contracts": RESULT_SQL}
