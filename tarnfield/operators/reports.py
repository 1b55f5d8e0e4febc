"""Decoding of evaluation reports: nested JSON into tables of cells, every derived flag worked out again and compared.

Nothing that a report says of itself is believed: whether a metric passed, which thresholds it had, whether the candidates' comparison
and the whole passed follow from its numbers. Reports are rows; a report's few dozen cells are exploded, joined with
the gates and with the grid of all cells that must be there, and what differs is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.storage import checkpointed
from tarnfield.operators.evaluate import CATEGORIES, GATES

MODES = ("lexical", "semantic", "hybrid")
_METRICS = "array<struct<category:string,mode:string,mrr:double,recallAt5:double,passed:boolean,queryCount:long,thresholds:struct<minimumMrr:double,minimumRecallAt5:double>>>"
REPORT = (
    f"struct<metrics:{_METRICS},candidates:array<struct<candidateId:string,decision:string,indexBytes:long,indexBytesUnavailableReason:string,metrics:{_METRICS}>>,"
    "candidateComparisonPassed:boolean,overallPassed:boolean,regression:struct<compatible:boolean,passed:boolean,reasonCodes:array<string>>>"
)
_SPACING, _CODE = CATEGORIES[1], CATEGORIES[4]


def cells(reports: DataFrame) -> DataFrame:
    """(report_id, part, mode, category and the rest of a metric): ``part`` is the report itself, as '', or a candidate's id."""
    own = reports.select("report_id", F.lit("").alias("part"), F.explode("r.metrics").alias("m"))
    theirs = reports.select("report_id", F.explode("r.candidates").alias("c")).select("report_id", F.col("c.candidateId").alias("part"), F.explode("c.metrics").alias("m"))
    rows = own.unionByName(theirs)
    return rows.select("report_id", "part", "m.mode", "m.category", F.col("m.mrr").alias("mrr"), F.col("m.recallAt5").alias("recall"), "m.passed", F.col("m.queryCount").alias("queries"), F.col("m.thresholds.minimumMrr").alias("least_mrr"), F.col("m.thresholds.minimumRecallAt5").alias("least_recall"))


def _judged(found: DataFrame) -> DataFrame:
    """The cells with the gates' own thresholds and whether the numbers pass them."""
    gates = found.sparkSession.createDataFrame(GATES, "mode string, category string, gate_mrr double, gate_recall double")
    rows = found.join(F.broadcast(gates), ["mode", "category"], "left")
    fine = F.coalesce(F.col("mrr") >= F.col("gate_mrr"), F.lit(True)) & F.coalesce(F.col("recall") >= F.col("gate_recall"), F.lit(True))
    return rows.withColumn("fine", fine)


def report_problems(reports: DataFrame, baseline: str = "words", report_id: str = "report_id", body: str = "body") -> DataFrame:
    """(report_id, problem, detail) of reports given as JSON text; a report without a row is sound.

    ``baseline``: the candidate that the selected one is compared with. Problems: unreadable, range, thresholds, passed, repeated-cell,
    missing-cell, repeated-candidate, index-bytes, selected, selected-metrics, regression, comparison, overall. Where cells are missing or repeated,
    flags that rest on them are judged by the cells there are.
    """
    # Parsed once; a dozen comparisons read the result.
    read = checkpointed(reports.select(F.col(report_id).alias("report_id"), F.from_json(F.col(body), REPORT, {"mode": "PERMISSIVE"}).alias("r")))
    whole = read.where(F.col("r").isNotNull() & F.col("r.metrics").isNotNull() & F.col("r.candidates").isNotNull() & F.col("r.overallPassed").isNotNull() & F.col("r.candidateComparisonPassed").isNotNull() & F.col("r.regression.passed").isNotNull())
    judged = checkpointed(_judged(cells(whole)))
    at = F.concat_ws("/", F.when(F.col("part") != "", F.col("part")), "mode", "category")
    say = lambda rows, problem, detail=None: rows.select("report_id", F.lit(problem).alias("problem"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    unit = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    out = [
        say(read.join(whole.select("report_id"), "report_id", "left_anti"), "unreadable"),
        say(judged.where(~(unit("mrr") & unit("recall") & F.coalesce(F.col("queries").between(1, 500), F.lit(False)))), "range", at),
        say(judged.where(~(F.col("least_mrr").eqNullSafe(F.col("gate_mrr")) & F.col("least_recall").eqNullSafe(F.col("gate_recall")))), "thresholds", at),
        say(judged.where(~F.col("passed").eqNullSafe(F.col("fine"))), "passed", at),
        say(judged.groupBy("report_id", "part", "mode", "category").count().where("count > 1"), "repeated-cell", at),
    ]
    grid = whole.select("report_id", F.lit("").alias("part"), F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    grid = grid.unionByName(whole.select("report_id", F.explode("r.candidates.candidateId").alias("part"), F.lit("lexical").alias("mode")).distinct())
    grid = grid.withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    out.append(say(grid.join(judged.select("report_id", "part", "mode", "category"), ["report_id", "part", "mode", "category"], "left_anti"), "missing-cell", at))

    candidates = whole.select("report_id", F.explode("r.candidates").alias("c")).select("report_id", "c.candidateId", "c.decision", "c.indexBytes", F.col("c.indexBytesUnavailableReason").alias("why"))
    out.append(say(candidates.groupBy("report_id", "candidateId").count().where("count > 1"), "repeated-candidate", F.col("candidateId")))
    out.append(say(candidates.where(F.col("indexBytes").isNull() == F.col("why").isNull()), "index-bytes", F.col("candidateId")))
    chosen = candidates.groupBy("report_id").agg(F.count_if(F.col("decision") == "selected").alias("n"), F.max(F.when(F.col("decision") == "selected", F.col("candidateId"))).alias("chosen"))
    chosen = whole.select("report_id").join(chosen, "report_id", "left")
    out.append(say(chosen.where(F.coalesce("n", F.lit(0)) != 1), "selected"))

    # The report's lexical cells must be those of the selected candidate, number by number.
    numbers = F.struct("mrr", "recall", "passed", "queries")
    mine = judged.where("part = '' and mode = 'lexical'").groupBy("report_id", "category").agg(F.max(numbers).alias("a"))
    theirs = judged.join(chosen.where("n = 1").select("report_id", F.col("chosen").alias("part")), ["report_id", "part"]).groupBy("report_id", "category").agg(F.max(numbers).alias("b"))
    both = mine.join(theirs, ["report_id", "category"], "full").join(chosen.where("n = 1").select("report_id"), "report_id")
    out.append(say(both.where(~F.col("a").eqNullSafe(F.col("b"))), "selected-metrics", F.col("category")))

    reasons = F.coalesce(F.size("r.regression.reasonCodes"), F.lit(0))
    good = F.when(F.col("r.regression.passed"), F.coalesce("r.regression.compatible", F.lit(False)) & (reasons == 0)).otherwise(reasons > 0)
    out.append(say(whole.where(~good), "regression"))

    base = judged.where((F.col("part") == baseline) & (F.col("category") == _SPACING)).groupBy("report_id").agg(F.max(F.struct("mrr", "recall")).alias("base"))
    sums = judged.join(chosen.select("report_id", "chosen"), "report_id").groupBy("report_id").agg(
        F.max(F.when((F.col("part") == F.col("chosen")) & (F.col("category") == _SPACING), F.struct("mrr", "recall"))).alias("spacing"),
        F.max(F.when((F.col("part") == F.col("chosen")) & (F.col("category") == _CODE), F.col("recall"))).alias("code"),
        F.bool_and(F.when((F.col("part") == "") & (F.col("mode") == "hybrid"), F.col("fine"))).alias("hybrid"),
        F.bool_and(F.when(F.col("part") == "", F.col("fine"))).alias("all"),
    )
    flags = whole.select("report_id", F.col("r.candidateComparisonPassed").alias("said_comparison"), F.col("r.overallPassed").alias("said_overall"), F.col("r.regression.passed").alias("regression")).join(sums, "report_id", "left").join(base, "report_id", "left")
    a, b = F.col("spacing"), F.col("base")
    better = (a["recall"] >= b["recall"]) & (a["mrr"] >= b["mrr"]) & ((a["recall"] > b["recall"]) | (a["mrr"] > b["mrr"]))
    comparison = F.coalesce(better & (F.col("code") == 1) & F.col("hybrid"), F.lit(False))
    out.append(say(flags.where(F.col("said_comparison") != comparison), "comparison"))
    overall = F.coalesce("all", F.lit(False)) & F.col("said_comparison") & F.col("regression")
    out.append(say(flags.where(F.col("said_overall") != overall), "overall"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found
