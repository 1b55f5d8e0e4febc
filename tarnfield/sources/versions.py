"""A table of versions with compare-and-set: plan against what is there, stage, look again, publish or refuse.

A version is a folder ``v-<number>`` of Parquet files. Publishing is one rename of a staged folder to the next number, which the file
system refuses if another writer has taken it, so of two plans on one version one is published.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnfield.operators.lexical import corpus_digest


class BindingInvalid(RuntimeError):
    """The table is no longer what the plan was made against, or the plan has been used."""


@dataclass
class ChangePlan:
    path: str
    version: int
    fingerprint: str
    used: bool = False


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return hadoop, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> int:
    """The newest published version, 0 where there is none."""
    _, place, files = _files(spark, path)
    if not files.exists(place):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return max((int(n[2:]) for n in names if n.startswith("v-")), default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/v-{current_version(spark, path) if version is None else version:08d}")


def fingerprint(spark: SparkSession, path: str, version: int) -> str:
    """A digest of a version's rows, whatever their order and files."""
    if not version:
        return "absent"
    rows = read_version(spark, path, version)
    return corpus_digest(rows, rows.columns).first()["digest"]


def plan_change(spark: SparkSession, path: str) -> ChangePlan:
    version = current_version(spark, path)
    return ChangePlan(path, version, fingerprint(spark, path, version))


def apply_change(plan: ChangePlan, rows: DataFrame) -> int:
    """Publishes ``rows`` as the next version and gives its number, or the number there is if they are what is there already.

    Rows are staged first; then the table is looked at again. A plan counts once: a second use, a version that was published meanwhile or rows that
    were changed in place raise ``BindingInvalid`` and leave nothing behind. A writer that dies before the rename leaves a staged folder, never half a version.
    """
    spark = rows.sparkSession
    if plan.used:
        raise BindingInvalid("the plan has been used")
    hadoop, place, files = _files(spark, f"{plan.path}/_staged-{uuid.uuid4().hex}")
    try:
        rows.write.parquet(place.toString())
        if current_version(spark, plan.path) != plan.version or fingerprint(spark, plan.path, plan.version) != plan.fingerprint:
            raise BindingInvalid("the table has changed since the plan")
        staged = spark.read.parquet(place.toString())
        if plan.version and corpus_digest(staged, staged.columns).first()["digest"] == plan.fingerprint:
            plan.used = True
            return plan.version
        context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()) if place.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        no_overwrite = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(place, hadoop.Path(f"{plan.path}/v-{plan.version + 1:08d}"), no_overwrite)
        except Exception as error:
            raise BindingInvalid("another writer has published") from error
        plan.used = True
        return plan.version + 1
    finally:
        files.delete(place, True)
