"""Readers and writers for artifact trees, JSON, JSON lines, Markdown with front matter, corpora and reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.functions.text import prefixed_sha256
from tarnfield.operators import ordering

MAX_FILE_BYTES = 8 << 20
MAX_DEPTH = 64
# Endings of files beside a run that are no runs.
RUN_SIDECARS = (
    ".acceptance-review.json",
    ".memory-recall.json",
    ".monitor-gate.json",
    ".monitor-verdict.json",
    ".orchestration-runtime.json",
    ".orchestration.json",
    ".style-verdict.json",
    ".visual-review.json",
)


def artifact_files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path (below the root), length, modified, content and revision of each file, as one distributed scan.

    ``pattern`` is a glob on file names. The listing is unordered; sort by path where order matters. Empty files are left out, as
    by all of Spark's file sources; ``sources.tree`` has them, and refuses links.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(root)
    below = F.regexp_replace(F.col("path"), r"\A.*?" + "".join(c if c.isalnum() or c == "/" else "\\" + c for c in root.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    return rows.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"), "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("revision"))


def bounded_files(files: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    """The files that aren't too large; their ``content`` isn't read if only the length is used before."""
    return files.where(F.col("length") <= most)


def with_extension(files: DataFrame, *extensions: str) -> DataFrame:
    return files.where(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1).isin(*extensions))


def run_files(files: DataFrame, sidecars: tuple[str, ...] = RUN_SIDECARS) -> DataFrame:
    """Run files at most one folder deep, without those that end in a sidecar suffix."""
    rows = files.where(F.col("path").rlike(r"\A(?:[^/]+/)?run-[A-Za-z0-9._-]+\.json\z"))
    rows = rows.where(~F.col("path").rlike(r"(?:\A|/)run-index\.json\z"))
    for suffix in sidecars:
        rows = rows.where(~F.endswith("path", F.lit(suffix)))
    return rows


def utf8(content: Column) -> Column:
    """The content as text, or null if it isn't UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def json_object(text: Column, schema: str | T.StructType) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def _json_depth(text: Column) -> Column:
    """The deepest nesting of brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\(?s:.))*+(?:"|\z)', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))
    closing = lambda acc, c: F.when(c.isin("[", "{"), step(acc, c)).otherwise(F.struct((acc["now"] - 1).alias("now"), acc["most"].alias("most")))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), closing, lambda acc: acc["most"])


@F.pandas_udf(T.BooleanType())
def _strict_json(values: pd.Series) -> pd.Series:
    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def finite(text):
        value = float(text)
        if value in (float("inf"), float("-inf")):
            raise ValueError("not finite")
        return value

    def never(text):
        raise ValueError(text)

    def good(text):
        if text is None:
            return None
        try:
            json.loads(text, object_pairs_hook=unique, parse_float=finite, parse_constant=never)
        except (ValueError, RecursionError):
            return False
        return True

    return values.map(good)


def strict_json_problem(text: Column) -> Column:
    """Why a text isn't strict JSON (null, mark, depth, syntax), or null. Repeated keys and non-finite numbers are syntax."""
    return (
        F.when(text.isNull(), "not-utf8").when(F.startswith(text, F.lit("﻿")), "byte-order-mark")
        .when(_json_depth(text) > MAX_DEPTH, "too-deep").when(~_strict_json(text), "syntax")
    )


LEDGER = "seq long, at string, type string, quote string, prev_sha256 string, scope_ref string, sha256 string, scope_change string, prev_seq long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger: the raw line beside its fields."""
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(F.col("value").alias("line"), F.from_json("value", LEDGER).alias("r")).select("line", "r.*")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _front_matter(values: pd.Series) -> pd.Series:
    def scalar(text):
        if text[:1] == '"':
            return str(json.loads(text))
        if text[:1] in "'&*!|>{[%@`" or ": " in text or " #" in text:
            raise ValueError(text)
        return text

    def parse(block):
        if block is None:
            return None
        out, parent = {}, ""
        try:
            for line in block.split("\n"):
                if not line.strip():
                    continue
                nested = line.startswith("  ")
                if line.startswith(" ") and not nested or nested and not parent:
                    return None
                key, colon, value = line.strip().partition(":")
                if not colon or not key.replace("_", "").isalnum():
                    return None
                name = f"{parent}.{key}" if nested else key
                if name in out:
                    return None
                if not nested:
                    parent = "" if value.strip() else key
                if value.strip():
                    out[name] = scalar(value.strip())
        except ValueError:
            return None
        return out

    return values.map(parse)


def markdown(text: Column) -> Column:
    """A struct of ``meta`` (front matter as a map; nested keys joined by a dot) and ``body``; null meta if it isn't strict.

    The front matter is a small subset of YAML: plain or JSON-quoted scalars, unique keys, one level of nesting.
    """
    shape = r"\A---\n((?:.*\n)*?)---\n((?s:.*))\z"
    body = F.regexp_replace(F.regexp_extract(text, shape, 2), r"\A\n", "")
    return F.when(text.rlike(shape), F.struct(_front_matter(F.regexp_extract(text, shape, 1)).alias("meta"), body.alias("body")))


def quoted(x: Column) -> Column:
    """A JSON string literal, with the line separators U+2028 and U+2029 escaped."""
    text = F.to_json(F.array(x))
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    return F.replace(F.replace(inner, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def rendered_document(fields: dict[str, Column], nested: dict[str, dict[str, Column]], body: Column) -> Column:
    """Markdown with front matter in the given order; null fields are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), quoted(c.cast("string")))) for k, c in fields.items()]
    for name, inner in nested.items():
        lines.append(F.lit(f"{name}:"))
        lines += [F.when(c.isNotNull(), F.concat(F.lit(f"  {k}: "), quoted(c.cast("string")))) for k, c in inner.items()]
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n\n"), body, F.lit("\n"))


def corpus_export(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON export with a fixed schema; bad rows keep their text in ``_corrupt_record``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def entity_inventory(files: DataFrame) -> DataFrame:
    """(entity_type, n, digest) of files laid out as type/name.md; digests meet by bucket, not all in one place."""
    rows = files.select(F.regexp_extract("path", r"\A([^/]+)/", 1).alias("entity_type"), F.concat_ws(":", "path", "revision").alias("line"))
    parts = rows.groupBy("entity_type", F.substring(F.sha2("line", 256), 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return parts.groupBy("entity_type").agg(F.sum("n").alias("n"), prefixed_sha256(joined).alias("digest"))


def unsorted_rows(registry: DataFrame, position: str, key: str = "project_id") -> DataFrame:
    """Registry rows that aren't after the one before them, in ranges of their positions."""
    rows = ordering.sequenced(registry, [position], key)
    return rows.where(F.col("before") >= F.col(key)).drop("place", "before")


def write_json_report(rows: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON-lines file, committed as a whole."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def provider_inputs(**sources: DataFrame) -> DataFrame:
    """The union of (identity, body) tables with their kind and size."""
    out = None
    for kind, rows in sources.items():
        own = rows.select(F.lit(kind).alias("kind"), F.col("identity").cast("string").alias("identity"), F.col("body"), F.octet_length("body").alias("bytes"))
        out = own if out is None else out.unionByName(own)
    return out


def within_budget(inputs: DataFrame, files: int = 4096, total: int = 32 << 20) -> DataFrame:
    """One row: the inputs' number and bytes, and whether both are within bounds."""
    sums = inputs.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("fits", (F.col("n") <= files) & (F.col("bytes") <= total))
