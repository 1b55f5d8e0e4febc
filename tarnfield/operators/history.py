"""Execution history and decision ledger: attempts, inclusion, lineage, hash chains and as-of approvals.

What reads like a fold over ordered events is windows here: a success repeats the one before it if their fingerprints are
equal and no failure came between, which is a lag over successes and a running count of failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import ordering

#: Roots whose changes don't last; a project adds its own.
TRANSIENT_ROOTS = ("dist", "node_modules", "plans")
#: Record types that leave a scope active.
ACTIVE_TYPES = ("gate.what.approved", "scope.added", "scope.removed")
STATUSES = ("started", "finished", "failed", "blocked")


def durable(paths: Column, roots: tuple[str, ...] = TRANSIENT_ROOTS) -> Column:
    """The paths outside the transient roots."""
    return F.filter(paths, lambda p: ~F.exists(F.array(*map(F.lit, roots)), lambda r: (p == r) | F.startswith(p, F.concat(r, F.lit("/")))))


def reusable(verification: Column) -> Column:
    """Whether a check by command or config passed with exit code 0 or failed with another."""
    kind = lambda v: v["source"].isin("command", "config")
    good = lambda v: (v["status"] == "passed") & (v["exit_code"] == 0) | (v["status"] == "failed") & (v["exit_code"] != 0)
    return F.coalesce(F.exists(verification, lambda v: F.coalesce(kind(v) & good(v), F.lit(False))), F.lit(False))


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def inclusion(attempts: DataFrame, group: str = "task", started: str = "started_at", finished: str = "finished_at", run: str = "run_id") -> DataFrame:
    """``attempts`` with ``included`` and ``reason``.

    Columns: status, fingerprint, has_durable and has_reusable (booleans). Started attempts are out. With a failure in the
    group, failures stay and so does the newest success after the last of them; without one, successes with a durable
    change or a reusable check stay. A success that repeats the one before it is a duplicate.
    """
    by = Window.partitionBy(group)
    order = by.orderBy(started, F.coalesce(F.col(finished), F.lit("")), run)
    failed = F.col("status").isin("failed", "blocked")
    rows = attempts.withColumn("_n", F.row_number().over(order)).withColumn("_f", F.sum(failed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    success = F.col("status") == "finished"
    last = Window.partitionBy(group, "_ok").orderBy("_n")
    rows = rows.withColumn("_ok", success).withColumns({"_p": F.lag("fingerprint").over(last), "_pf": F.lag("_f").over(last)})
    repeated = success & F.coalesce(F.col("_p").eqNullSafe(F.col("fingerprint")) & (F.col("_pf") == F.col("_f")), F.lit(False))
    rows = rows.withColumn("_dup", repeated)
    kept = success & ~F.col("_dup")
    rows = rows.withColumns({"_last": F.max(F.when(failed, F.col("_n"))).over(by), "_meaning": F.col("has_durable") | F.col("has_reusable")})
    rows = rows.withColumn("_rec", F.max(F.when(kept & (F.col("_n") > F.col("_last")), F.col("_n"))).over(by))
    any_failed = F.col("_last").isNotNull()
    included = F.when(any_failed, failed | (F.col("_n") == F.col("_rec"))).otherwise(kept & F.col("_meaning"))
    rows = rows.withColumn("included", F.coalesce(included, F.lit(False)))
    lasting = F.max(F.when(F.col("included"), F.col("has_durable").cast("int"))).over(by)
    yes = F.when(any_failed, F.when(F.col("_rec").isNull(), "failed_or_blocked").otherwise("retry_succeeded")).when(lasting == 1, "significant_change").otherwise("reusable_verification")
    no = F.when(F.col("status") == "started", "started").when(F.col("_dup"), "duplicate_success").when(any_failed & F.col("_meaning"), "duplicate_success").otherwise("low_signal")
    return rows.withColumn("reason", F.when(F.col("included"), yes).otherwise(no)).drop("_n", "_f", "_ok", "_p", "_pf", "_dup", "_last", "_meaning", "_rec")


def chain_revisions(included: DataFrame, group: str = "task") -> DataFrame:
    """(group, attempts, ingested_at, revision): the newest end and a digest over the ordered runs of each group.

    Runs of a task are bounded by what a person retries; digests alone are gathered.
    """
    runs = F.array_sort(F.collect_list(F.struct("started_at", F.coalesce("finished_at", F.lit("")).alias("f"), "run_id", "fingerprint")))
    return included.groupBy(group).agg(F.count("*").alias("attempts"), F.max("finished_at").alias("ingested_at"), F.sha2(F.to_json(runs), 256).alias("revision"))


def run_problem() -> Column:
    """What is wrong with a decoded run, or null. Columns: run_id, task_id, status, started_at, updated_at, finished_at,
    failure_class, verification."""
    c = F.col
    ends = c("finished_at").isNotNull()
    bad_check = F.exists(F.coalesce("verification", F.array().cast("array<struct<status:string,exit_code:int,started_at:string,finished_at:string>>")), lambda v: (v["status"] == "passed") & (v["exit_code"] != 0) | (v["status"] == "failed") & (v["exit_code"] == 0) | (v["finished_at"] < v["started_at"]))
    return (
        F.when(c("run_id").isNull() | c("task_id").isNull(), "missing-key")
        .when(~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "bad-status")
        .when(c("started_at").isNull(), "missing-start")
        .when((c("status") == "started") & ends, "ended-start")
        .when((c("status") != "started") & ~ends, "missing-end")
        .when((c("finished_at") < c("started_at")) | (c("updated_at") < c("started_at")), "time-order")
        .when((c("status") == "failed") & c("failure_class").isNull(), "missing-failure-class")
        .when((c("status") == "finished") & c("failure_class").isNotNull(), "unexpected-failure-class")
        .when(F.coalesce(bad_check, F.lit(False)), "bad-verification")
    )


def index_mismatches(index: DataFrame, runs: DataFrame, ref: str = "run_ref", fields: tuple[str, ...] = ("run_id", "task_id", "iteration_id", "status", "started_at", "finished_at")) -> DataFrame:
    """(run_ref, problem): indexed runs that are missing or differ in a field, and runs that no index row names."""
    right = runs.select(ref, F.lit(True).alias("_there"), F.struct(*fields).alias("_b"))
    both = index.select(ref, F.lit(True).alias("_listed"), F.struct(*fields).alias("_a")).join(right, ref, "full")
    problem = F.when(F.col("_there").isNull(), "missing-run").when(F.col("_listed").isNull(), "unindexed-run").when(~F.col("_a").eqNullSafe(F.col("_b")), "index-mismatch")
    return both.select(ref, problem.alias("problem")).where("problem is not null")


def lineage(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """``runs`` with ``lineage``: ok, missing-task or contract-mismatch. Keys: iteration_id and task_id; contract digests."""
    known = tasks.select("iteration_id", "task_id", F.col("contract_sha256").alias("_c"), F.lit(True).alias("_there"))
    rows = runs.join(known, ["iteration_id", "task_id"], "left")
    state = F.when(F.col("_there").isNull(), "missing-task").when(~F.col("_c").eqNullSafe(F.col("contract_sha256")), "contract-mismatch").otherwise("ok")
    return rows.withColumn("lineage", state).drop("_c", "_there")


def normalized_verification(rows: Column) -> Column:
    """Distinct checks by start, type and command."""
    return F.array_sort(F.array_distinct(F.transform(rows, lambda v: F.struct(v["started_at"].alias("started_at"), v["type"].alias("type"), v["command"].alias("command"), v["status"].alias("status"), v["source"].alias("source"), v["exit_code"].alias("exit_code")))))


def chain_check(ledger: DataFrame, scope: str | None = None, line: str = "line", seq: str = "seq", prev: str = "prev_sha256") -> DataFrame:
    """``ledger`` with ``chain_ok``: numbered without gaps from 1, and naming the digest of the line before.

    One chain for the table, or one for each ``scope``. Either way the rows are checked in ranges of their order, side by
    side, however many a chain has.
    """
    rows = ledger.withColumn("_digest", F.sha2(F.col(line), 256))
    rows = ordering.sequenced(rows, [seq], "_digest", [scope] if scope else None)
    return rows.withColumn("chain_ok", (F.col("place") == F.col(seq)) & F.col("before").eqNullSafe(F.col(prev))).drop("_digest", "place", "before")


def newest_by_scope(ledger: DataFrame, scope: str = "scope_ref", seq: str = "seq") -> DataFrame:
    """The newest record of each scope, by a partial aggregate: no scope's rows are gathered."""
    others = [c for c in ledger.columns if c != scope]
    newest = ledger.groupBy(scope).agg(F.max_by(F.struct(*others), F.col(seq)).alias("r"))
    return newest.select(scope, *(F.col(f"r.{c}").alias(c) for c in others))


def approvals(requests: DataFrame, ledger: DataFrame, scope: str = "scope_ref") -> DataFrame:
    """``requests`` with ``approval``: none, revoked, stale (another digest) or approved, by the newest record of the scope.

    Any newest record whose type isn't active counts as revoked.
    """
    newest = newest_by_scope(ledger, scope).select(scope, F.col("type").alias("_t"), F.col("sha256").alias("_s"))
    state = F.when(F.col("_t").isNull(), "none").when(~F.col("_t").isin(*ACTIVE_TYPES), "revoked").when(F.col("_s").eqNullSafe(F.col("sha256")), "approved").otherwise("stale")
    return requests.join(newest, scope, "left").withColumn("approval", state).drop("_t", "_s")


def back_references(ledger: DataFrame, scope: str = "scope_ref", seq: str = "seq", back: str = "prev_seq") -> DataFrame:
    """``ledger`` with ``reference_ok``: the record names the one before it in its scope, or none if it is the first."""
    before = F.lag(seq).over(Window.partitionBy(scope).orderBy(seq))
    return ledger.withColumn("reference_ok", before.eqNullSafe(F.col(back)))


#: Record types that speak for a scope, and those whose reference must name the newest of them.
SCOPE_TYPES = ("gate.what.approved", "gate.what.revoked", "scope.added", "scope.removed")


def references(ledger: DataFrame, scope: str = "scope_ref", seq: str = "seq", back: str = "prev_seq", kind: str = "type") -> DataFrame:
    """``ledger`` with ``reference``: what the record's back reference, to any earlier row, amounts to.

    none (it names no row), missing, not-earlier, and for records that speak for a scope: inactive (the row named leaves no scope
    active), other-scope, superseded (the scope has a newer record before this one), or ok. The row named is looked up
    by its number; the newest record before each row comes from the order of its scope, in ranges.
    """
    named = ledger.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("_named")).agg(F.min(F.struct(F.col(kind).alias("type"), F.col(scope).alias("scope"))).alias("_row"))
    speaks = F.coalesce(F.col(kind).isin(*SCOPE_TYPES), F.lit(False))
    rows = ordering.sequenced(ledger.withColumns({"_speaks": speaks, "_seq": F.col(seq)}), [seq], "_seq", ["_speaks", scope])
    rows = rows.join(named, F.col(back) == F.col("_named"), "left")
    to = F.col("_row")
    state = (
        F.when(F.col(back).isNull(), "none").when(to.isNull(), "missing").when(F.col(back) >= F.col(seq), "not-earlier").when(~F.col("_speaks"), "ok")
        .when(~F.coalesce(to["type"].isin(*ACTIVE_TYPES), F.lit(False)), "inactive").when(~to["scope"].eqNullSafe(F.col(scope)), "other-scope")
        .when(F.col("before") != F.col(back), "superseded").otherwise("ok")
    )
    return rows.withColumn("reference", state).drop("_speaks", "_seq", "place", "before", "_named", "_row")
