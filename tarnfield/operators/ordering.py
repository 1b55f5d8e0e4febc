"""Total orders without one task: range partitions that hand their edge row to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.storage import checkpointed


def sequenced(rows: DataFrame, order: list[str], value: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``place``, its number from 1 in the order among the rows of its keys, and ``before``, the ``value`` of the row ahead.

    Rows are sorted into ranges of keys and order, so that a key with a third of all rows spans many partitions. Each
    partition numbers its own rows; its first key, last key, last value and last number, one row a partition, go through
    the driver, and come back as what the partition starts with. Equal orders of one key stay together, in no fixed order.
    """
    keys = keys or []
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("k"))
    ranged = checkpointed(rows.repartitionByRange(*keys, *order)).withColumns({"_part": F.spark_partition_id(), "_key": key})
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    rows = ranged.withColumns({"_n": F.row_number().over(own), "_before": F.lag(value).over(own)})
    last = F.max_by(F.struct(F.col("_key").alias("key"), F.col(value).alias("value"), F.col("_n").alias("n")), F.struct("_key", *order, "_n"))
    edges = rows.groupBy("_part").agg(F.min("_key").alias("first"), last.alias("last")).collect()
    carried, starts = None, []
    for edge in sorted(edges, key=lambda e: e["_part"]):
        goes_on = carried is not None and carried[0] == edge["first"]
        if goes_on:
            starts.append((edge["_part"], edge["first"], carried[1], carried[2]))
        end = edge["last"]
        ahead = carried[2] if goes_on and end["key"] == edge["first"] else 0
        carried = end["key"], end["value"], end["n"] + ahead
    kinds = dict(rows.dtypes)
    start = rows.sparkSession.createDataFrame(starts, f"_at int, _start {kinds['_key']}, _handed {kinds[value]}, _ahead long")
    met = rows.join(F.broadcast(start), (F.col("_part") == F.col("_at")) & F.col("_key").eqNullSafe(F.col("_start")), "left")
    before = F.when((F.col("_n") == 1) & F.col("_at").isNotNull(), F.col("_handed")).otherwise(F.col("_before"))
    out = met.withColumns({"place": F.col("_n") + F.coalesce("_ahead", F.lit(0)), "before": before})
    return out.drop("_part", "_key", "_n", "_before", "_at", "_start", "_handed", "_ahead")
