"""Single-use handles: the first valid use of an issued handle counts, over a table or over all batches of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOMES = ("granted", "consumed", "expired", "unknown")


def single_use(uses: DataFrame, issued: DataFrame, seconds: int) -> DataFrame:
    """``uses`` (use_id, handle, at) with ``outcome``: granted, consumed, expired or unknown.

    ``issued``: handle and issued_at; of a handle issued twice the first issue holds. A use before the issue is unknown, one more than
    ``seconds`` after it expired. Of the valid uses of a handle the earliest, of equal times that of the smallest
    use_id, is granted. That use is found by a partial aggregate, so a handle with any number of uses is never gathered.
    """
    first = issued.groupBy("handle").agg(F.min("issued_at").alias("_issued"))
    rows = uses.join(first, "handle", "left")
    late = F.col("at") > F.col("_issued") + F.make_interval(secs=F.lit(seconds))
    valid = F.coalesce((F.col("at") >= F.col("_issued")) & ~late, F.lit(False))
    one = rows.where(valid).groupBy("handle").agg(F.min(F.struct("at", "use_id")).alias("_first"))
    rows = rows.join(one, "handle", "left")
    state = F.when(valid, F.when(F.col("_first.use_id") == F.col("use_id"), "granted").otherwise("consumed")).when(F.col("at") > F.col("_issued"), "expired").otherwise("unknown")
    return rows.withColumn("outcome", state).drop("_issued", "_first")


def single_use_stream(events: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream of ``events``: handle, kind (issue or use), use_id and at. Gives (use_id, handle, outcome).

    A handle's state is when it was issued and whether it was used; it is dropped when the watermark is past its end, and later
    uses of it are unknown. Uses are judged in the order of a batch's times, so over batches the one that came first counts. State
    and outcomes are committed together with the batch: one that is run again after a restart decides as before.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        issued, used = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values(["at", "kind", "use_id"])
        out = []
        for kind, use, at in zip(rows["kind"], rows["use_id"], rows["at"], strict=True):
            time = at.timestamp()
            if kind == "issue":
                issued = time if issued is None else issued
                continue
            if issued is None or time < issued:
                out.append((use, "unknown"))
            elif time > issued + seconds:
                out.append((use, "expired"))
            else:
                out.append((use, "consumed" if used else "granted"))
                used = True
        if issued is not None:
            state.update((issued, used))
            end = int((issued + seconds) * 1000)
            if end > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end)
            else:
                state.remove()
        yield pd.DataFrame({"use_id": [u for u, _ in out], "handle": [key[0]] * len(out), "outcome": [o for _, o in out]})

    kinds = dict(events.dtypes)
    marked = events.withWatermark("at", delay).select("handle", "kind", "use_id", "at")
    return marked.groupBy("handle").applyInPandasWithState(judge, f"use_id {kinds['use_id']}, handle {kinds['handle']}, outcome string", "issued double, used boolean", "append", GroupStateTimeout.EventTimeTimeout)


def apply_outcomes(attempts: DataFrame, plans: DataFrame, current: DataFrame) -> DataFrame:
    """``attempts`` (attempt, plan_id, project_id) with ``outcome`` of applying a plan against the state that is there now.

    ``plans``: plan_id, project_id, fingerprint, disposition, migration; ``current``: project_id, fingerprint. A plan that isn't
    known or is of another project, a changed fingerprint, and any attempt after the one that got through are binding-invalid; then
    migration-required, unchanged or applied. The first attempt that is bound and needs no migration uses the plan up.
    """
    plan = plans.select("plan_id", F.col("project_id").alias("_project"), F.col("fingerprint").alias("_planned"), "disposition", "migration")
    rows = attempts.join(plan, "plan_id", "left").join(current.select("project_id", F.col("fingerprint").alias("_now")), "project_id", "left")
    bound = F.coalesce((F.col("_project") == F.col("project_id")) & (F.col("_planned") == F.col("_now")), F.lit(False))
    rows = rows.withColumn("_bound", bound)
    first = rows.where(F.col("_bound") & ~F.coalesce("migration", F.lit(False))).groupBy("plan_id").agg(F.min("attempt").alias("_first"))
    rows = rows.join(first, "plan_id", "left")
    outcome = (
        F.when(~F.col("_bound") | F.coalesce(F.col("attempt") > F.col("_first"), F.lit(False)), "binding-invalid").when(F.coalesce("migration", F.lit(False)), "migration-required")
        .when(F.col("disposition") == "unchanged", "unchanged").otherwise("applied")
    )
    return rows.select("attempt", "plan_id", "project_id", outcome.alias("outcome"))
