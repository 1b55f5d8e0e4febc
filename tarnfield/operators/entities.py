"""Typed entities: a schema held as rows, compiled into one expression over JSON objects, and what states ask of relations.

A schema is a table of fields, so another one is other rows; nothing is written by hand for a field. The rows are a few dozen
and read on the driver once; the entities are checked in one projection, without Python. A state may ask for fields
that must not be blank, and for relations to other entities in given states, which are counted by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.text import utf16_length

SCHEMA_COLUMNS = "entity_type string, field string, kind string, required boolean, least double, most double, allowed array<string>, default string"

# Fields as (field, kind, required, least, most, allowed, default).
_COMMON = (
    ("title", "string", True, 1, 200, None, None),
    ("summary", "string", True, 1, 4000, None, None),
    ("sourceRefs", "string[]", True, None, None, None, None),
    ("sourceRevision", "string", True, 71, 71, None, None),
    ("confidence", "number", False, 0, 1, None, None),
    ("provenanceState", "enum", False, None, None, ("extracted", "merged", "inferred", "ambiguous"), None),
    ("contradictedBy", "string[]", False, None, None, None, None),
    ("archived", "boolean", False, None, None, None, "false"),
    ("archiveReason", "string", False, 1, 1000, None, None),
)
_OWN = {
    "decisions": (
        ("rationale", "string", False, None, 8000, None, None),
        ("status", "enum", True, None, None, ("active", "superseded", "archived"), "active"),
    ),
    "failures": (
        ("failureClass", "string", True, 1, 200, None, None),
        ("resolution", "string", False, 1, 8000, None, None),
        ("status", "enum", True, None, None, ("open", "resolved", "archived"), "open"),
    ),
    "verifications": (
        ("verificationKind", "string", True, 1, 200, None, None),
        ("evidenceRefs", "string[]", True, None, None, None, None),
        ("command", "string", False, None, 2000, None, None),
        ("status", "enum", True, None, None, ("recorded", "passed", "failed", "archived"), "recorded"),
    ),
}
# Fields that a state asks for, as (entity_type, state, field).
STATE_FIELDS = (
    ("decisions", "archived", "archiveReason"),
    ("failures", "resolved", "resolution"),
    ("failures", "archived", "archiveReason"),
    ("verifications", "archived", "archiveReason"),
)
# Relations that a state asks for, as (entity_type, state, relation, role, other type, other state, least).
STATE_RELATIONS = (
    ("decisions", "superseded", "supersedes", "to", "decisions", "active", 1),
    ("failures", "resolved", "verified-by", "from", "verifications", "passed", 1),
)
_KINDS = {"string": r"\ASTRING\z", "enum": r"\ASTRING\z", "number": r"\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL\b.*)\z", "boolean": r"\ABOOLEAN\z", "string[]": r"\AARRAY<(?:STRING|VOID)>\z"}


def schema_table(spark: SparkSession) -> DataFrame:
    """The schema of decisions, failures and verifications as rows."""
    rows = [(kind, *field) for kind, own in _OWN.items() for field in (*_COMMON, *own)]
    plain = [(e, f, k, r, None if a is None else float(a), None if b is None else float(b), None if v is None else list(v), d) for e, f, k, r, a, b, v, d in rows]
    return spark.createDataFrame(plain, SCHEMA_COLUMNS)


def _value(body: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(body, f"$['{field}']", kind)


def _field_problems(body: Column, row) -> Column:
    """What is wrong with one field: required, type, enum, length or range; null where nothing is."""
    kind = F.schema_of_variant(_value(body, row["field"], "variant"))
    problem = F.when(kind.isNull(), F.when(F.lit(row["required"] and row["default"] is None), "required")).when(~kind.rlike(_KINDS[row["kind"]]), "type")
    if row["allowed"] is not None:
        problem = problem.when(~_value(body, row["field"], "string").isin(*row["allowed"]), "enum")
    if row["least"] is not None or row["most"] is not None:
        measured = _value(body, row["field"], "double") if row["kind"] == "number" else utf16_length(_value(body, row["field"], "string"))
        low, high = (F.lit(float("-inf") if row["least"] is None else row["least"]), F.lit(float("inf") if row["most"] is None else row["most"]))
        problem = problem.when(~measured.cast("double").between(low, high), "range" if row["kind"] == "number" else "length")
    return F.concat(F.lit(row["field"] + ":"), problem)


def checked_entities(entities: DataFrame, schema: DataFrame, state: str = "status") -> DataFrame:
    """``entities`` (id, entity_type, body: a JSON object as text) with ``violations``, ``defaulted`` and ``state``.

    Violations are ``field:reason`` in the schema's order, then fields that it doesn't know, sorted. ``defaulted``: the fields
    whose default holds. A body that is no object is ``body:type``, a type without fields ``entity_type:unknown``.
    """
    rows = schema.collect()
    types = list(dict.fromkeys(r["entity_type"] for r in rows))
    parsed = entities.withColumn("_body", F.try_parse_json("body"))
    body, keys = F.col("_body"), F.json_object_keys("body")
    found, defaulted, now = F.array(F.lit("entity_type:unknown")), F.array().cast("array<string>"), F.lit(None).cast("string")
    for kind in types:
        own = [r for r in rows if r["entity_type"] == kind]
        known = F.array(*(F.lit(r["field"]) for r in own))
        unknown = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(":unknown")))
        mine = F.col("entity_type") == kind
        found = F.when(mine, F.concat(F.array_compact(F.array(*(_field_problems(body, r) for r in own))), unknown)).otherwise(found)
        given = [F.when(_value(body, r["field"], "variant").isNull(), r["field"]) for r in own if r["default"] is not None]
        defaulted = F.when(mine, F.array_compact(F.array(*given)).cast("array<string>")).otherwise(defaulted)
        first = next((r["default"] for r in own if r["field"] == state), None)
        now = F.when(mine, F.coalesce(_value(body, state, "string"), F.lit(first))).otherwise(now)
    found = F.when(keys.isNull(), F.array(F.lit("body:type"))).otherwise(found)
    return parsed.withColumns({"violations": found, "defaulted": F.when(keys.isNull(), F.array().cast("array<string>")).otherwise(defaulted), "state": now})


def entity_problems(entities: DataFrame, relations: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(id, entity_type, state, violations, defaulted), with what each state asks for: ``field:state`` and ``relation:state``.

    ``relations``: relation, from_id, to_id. Both ends of a relation meet their entities by a join on the id, and what
    counts is summed for each entity before it is joined back, so an entity with any number of relations is one row there.
    """
    rows = checked_entities(entities, schema if schema is not None else schema_table(entities.sparkSession))
    asked = [F.when((F.col("entity_type") == e) & (F.col("state") == s) & ~F.coalesce(_value(F.col("_body"), f, "string").rlike(r"\S"), F.lit(False)), f"{f}:state") for e, s, f in STATE_FIELDS]
    others = rows.select(F.col("id").alias("_other"), F.col("entity_type").alias("_type"), F.col("state").alias("_state"))
    counts = None
    for i, (_, _, relation, role, kind, state, _) in enumerate(STATE_RELATIONS):
        mine, theirs = ("to_id", "from_id") if role == "to" else ("from_id", "to_id")
        part = relations.where(F.col("relation") == relation).select(F.col(mine).alias("_id"), F.col(theirs).alias("_other")).distinct()
        part = part.join(others.where((F.col("_type") == kind) & (F.col("_state") == state)), "_other").select("_id", F.lit(i).alias("_which"))
        counts = part if counts is None else counts.unionByName(part)
    counts = counts.groupBy("_id").agg(*(F.count_if(F.col("_which") == i).alias(f"_n{i}") for i in range(len(STATE_RELATIONS))))
    rows = rows.join(counts, F.col("id") == F.col("_id"), "left")
    asked += [F.when((F.col("entity_type") == e) & (F.col("state") == s) & (F.coalesce(F.col(f"_n{i}"), F.lit(0)) < least), f"{relation}:state") for i, (e, s, relation, _, _, _, least) in enumerate(STATE_RELATIONS)]
    return rows.select("id", "entity_type", "state", F.concat("violations", F.array_compact(F.array(*asked))).alias("violations"), "defaulted")
