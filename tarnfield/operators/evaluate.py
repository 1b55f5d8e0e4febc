"""Retrieval quality: Recall@5 and MRR by mode and category, gates, comparison of candidates and regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import EDGE, EDGE_AFTER, EDGE_BEFORE, SPACE_CLASS, SPACES, round6
from tarnfield.operators.screen import CREDENTIALS

#: Least MRR and Recall@5 by mode and category; other pairs have no gate.
GATES = (
    ("lexical", "korean-exact", 0.75, 0.9),
    ("semantic", "korean-synonym", None, 0.8),
    ("semantic", "korean-to-english", None, 0.7),
)
CATEGORIES = ("korean-exact", "korean-spacing-morphology", "korean-synonym", "korean-to-english", "code-symbol-korean")


def relevant_pages(judgements: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, page_id) of the judged evidence, one row each; grades don't matter."""
    return judgements.join(documents.select("evidence_id", "page_id"), "evidence_id").select("query_id", "page_id").distinct()


def metrics(rankings: DataFrame, relevant: DataFrame, queries: DataFrame, modes: tuple[str, ...], depth: int = 5) -> DataFrame:
    """mode, category, query_count, recall_at_5, mrr. ``rankings``: mode, query_id, page_id, rank over whole results.

    A query without a relevant page, or without results, counts with zeros in each of the ``modes``.
    """
    hits = rankings.join(relevant, ["query_id", "page_id"]).groupBy("mode", "query_id").agg(F.count_if(F.col("rank") <= depth).alias("hits"), F.min("rank").alias("first"))
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    every = queries.select("query_id", "category", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    rows = every.join(sizes, "query_id", "left").join(hits, ["mode", "query_id"], "left")
    recall = F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n").cast("double")).otherwise(0.0)
    scored = rows.select("mode", "category", recall.alias("r"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("m"))
    return scored.groupBy("mode", "category").agg(F.count("*").alias("query_count"), round6(F.avg("r")).alias("recall_at_5"), round6(F.avg("m")).alias("mrr"))


def gated(found: DataFrame) -> DataFrame:
    """The metrics with their thresholds and ``passed``; without a threshold a metric passes."""
    gates = found.sparkSession.createDataFrame(GATES, "mode string, category string, minimum_mrr double, minimum_recall_at_5 double")
    rows = found.join(F.broadcast(gates), ["mode", "category"], "left")
    fine = lambda value, least: F.coalesce(F.col(value) >= F.col(least), F.lit(True))
    return rows.withColumn("passed", fine("mrr", "minimum_mrr") & fine("recall_at_5", "minimum_recall_at_5"))


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per baseline metric whether the current one is missing or lower."""
    now = current.select("mode", "category", F.col("recall_at_5").alias("r1"), F.col("mrr").alias("m1"))
    both = baseline.select("mode", "category", "recall_at_5", "mrr").join(now, ["mode", "category"], "left")
    return both.withColumn("regressed", F.col("r1").isNull() | F.coalesce(F.col("r1") < F.col("recall_at_5"), F.lit(False)) | F.coalesce(F.col("m1") < F.col("mrr"), F.lit(False)))


def hits_at(rankings: DataFrame, relevant: DataFrame, queries: DataFrame, depth: int = 5) -> DataFrame:
    """(query_id, category, hit): whether a relevant page is among the first ``depth``."""
    found = rankings.where(F.col("rank") <= depth).join(relevant, ["query_id", "page_id"]).select("query_id", F.lit(True).alias("hit")).distinct()
    return queries.select("query_id", "category").join(found, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def candidate_comparison(candidate: DataFrame, baseline: DataFrame, hybrid: DataFrame, hybrid_baseline: DataFrame) -> DataFrame:
    """One row: does the candidate win a spacing query, lose none, find all code queries, and is hybrid nowhere lower?"""
    both = candidate.select("query_id", "category", F.col("hit").alias("now")).join(baseline.select("query_id", F.col("hit").alias("before")), "query_id")
    spacing, code = F.col("category") == CATEGORIES[1], F.col("category") == CATEGORIES[4]
    flags = both.agg(
        F.coalesce(F.bool_or(spacing & F.col("now") & ~F.col("before")), F.lit(False)).alias("gained"),
        F.coalesce(F.bool_or(spacing & ~F.col("now") & F.col("before")), F.lit(False)).alias("lost"),
        F.coalesce(F.bool_and(F.when(code, F.col("now"))), F.lit(False)).alias("code_found"),
    )
    lower = regressions(hybrid, hybrid_baseline).agg(F.coalesce(F.bool_or("regressed"), F.lit(False)).alias("hybrid_lower"))
    return flags.crossJoin(lower).withColumn("passed", F.col("gained") & ~F.col("lost") & F.col("code_found") & ~F.col("hybrid_lower"))


def corpus_problems(documents: DataFrame, queries: DataFrame, judgements: DataFrame) -> DataFrame:
    """(problem, key): broken references, repeated keys, queries without a judgement, missing categories."""
    say = lambda rows, problem, key: rows.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("key"))
    twice = lambda rows, *keys: rows.groupBy(*keys).count().where("count > 1")
    out = say(twice(documents, "evidence_id"), "duplicate-evidence", "evidence_id")
    for part in (
        say(twice(documents, "page_id"), "duplicate-page", "page_id"),
        say(twice(queries, "query_id"), "duplicate-query", "query_id"),
        say(twice(judgements, "query_id", "evidence_id"), "duplicate-judgement", "query_id"),
        say(judgements.join(queries, "query_id", "left_anti"), "unknown-query", "query_id"),
        say(judgements.join(documents, "evidence_id", "left_anti"), "unknown-evidence", "evidence_id"),
        say(queries.join(judgements, "query_id", "left_anti"), "unjudged-query", "query_id"),
        say(judgements.where(~F.col("relevance").between(1, 3) | F.col("relevance").isNull()), "bad-relevance", "query_id"),
        say(queries.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string").join(queries, "category", "left_anti"), "missing-category", "category"),
    ):
        out = out.unionByName(part)
    return out


# What a fixture text must not hold.
_ABSOLUTE = rf"(?:^|[{SPACES}\"'(=])(?:/(?:[^/{SPACES}]+/)*[^/{SPACES}]+|[A-Za-z]:[\\/]|\\\\[^\\{SPACES}]+\\[^\\{SPACES}]+)"
_ADDRESS = r"(?i)(?:https?|file)://"
_LABELLED = rf"(?iu)(?:authorization{SPACE_CLASS}*:|bearer{SPACE_CLASS}+|(?:api[-_]?key|password|secret|token){SPACE_CLASS}*[=:])"
_FINE_GRAINED = rf"{EDGE_BEFORE}github_pat_[A-Za-z0-9_]{{20,255}}{EDGE_AFTER}"
_CHAT = rf"{EDGE_BEFORE}xox[baprs]-[A-Za-z0-9-]{{10,255}}{EDGE}"


def prohibited(x: Column) -> Column:
    """Whether a fixture text holds a URL, an absolute path, a known credential or something labelled as one."""
    out = x.rlike(_ABSOLUTE) | x.rlike(_ADDRESS) | x.rlike(_LABELLED) | x.rlike(_FINE_GRAINED) | x.rlike(_CHAT)
    for rule, pattern, _ in CREDENTIALS:
        if rule.startswith(("credential.jwt", "credential.provider")):
            out = out | x.rlike(pattern)
    return out


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The value at place n div 2 (from 0) of each group's sorted values."""
    order = Window.partitionBy(*group).orderBy(value)
    placed = rows.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*group))})
    return placed.where(F.col("_at") == F.floor(F.col("_n") / 2)).select(*group, F.col(value).alias("upper_median"))
