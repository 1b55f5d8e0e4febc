"""Structured Streaming forms of screening, ledger and event operators: an addition of this engine.

Each takes a streaming DataFrame (or a static one, which runs the same plan once) and returns one; the caller starts the
query and names its checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import screen


def screened_stream(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Screening keeps no state, so a stream of documents runs the batch plan."""
    return screen.screened(docs, key, body)


def rule_totals(docs: DataFrame, time: str, delay: str = "10 minutes", width: str = "1 hour", key: str = "doc_id", body: str = "text") -> DataFrame:
    """Findings by rule and window of event time; windows close when the watermark passes them."""
    counts = docs.withWatermark(time, delay).select(F.window(time, width).alias("window"), F.create_map(*(x for rule, n in screen.pattern_counts(F.col(body), screen.lowered(F.col(body))).items() for x in (F.lit(rule), n))).alias("c"))
    rows = counts.select("window", F.explode("c").alias("rule_id", "n"))
    return rows.where("n > 0").groupBy("window", "rule_id").agg(F.sum("n").alias("findings")).select(F.col("window.start").alias("start"), "rule_id", "findings")


def event_windows(events: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), user)
    return grouped.agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def upsert_writer(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes each batch under its own number, so a batch that is run again replaces itself.

    Of rows of a batch with one key the largest by its other columns is kept, so a second run writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        others = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in others))
        one.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current_rows(rows: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """Of what ``upsert_writer`` has written, the newest row of each key."""
    others = [c for c in rows.columns if c not in (key, batch)]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(batch)).alias("r"))
    return newest.select(key, *(F.col(f"r.{c}").alias(c) for c in others))
