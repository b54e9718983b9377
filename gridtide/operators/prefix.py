"""Ranks and running totals over a whole table, without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import shared_path, write_and_read


def running_totals(rows: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """rows with rank (from 1), cumulative (of ``value``, up to and with the row) and total (of all rows), in the order given.

    A prefix sum in two levels: the rows are dealt to ranges of the order and stored in it, each range is numbered and summed by itself, and the figures of the
    ranges before it, one row for each range, are joined back. Rows that are equal in all of ``order`` stand in one range, so the
    order should end with a key. A null value adds nothing. An empty table gives no rows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # Stored, as another run of the same plan may draw other ranges.
    stored = write_and_read(dealt.withColumn("__range", F.shiftright("__at", 33)), shared_path(rows.sparkSession, "ranges"))
    per = stored.groupBy("__range").agg(F.count("*").alias("rows"), F.min("__at").alias("first"), F.coalesce(F.sum(value), F.lit(0)).alias("sum"))
    kind = per.schema["sum"].dataType
    listed = per.agg(F.sort_array(F.collect_list(F.struct("__range", "rows", "first", "sum"))).alias("r"))

    def before(part: Column, name: str, zero: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: (a + x[name]).cast("long" if name == "rows" else kind))

    def upto(n: Column) -> Column:
        return F.slice("r", F.lit(1), n)

    one = listed.select("r", F.posexplode("r").alias("i", "x"))
    offsets = one.select(
        F.col("x.__range").alias("__range"), (before(upto(F.col("i")), "rows", F.lit(0).cast("long")) - F.col("x.first") + 1).alias("__rank"),
        before(upto(F.col("i")), "sum", F.lit(0).cast(kind)).alias("__before"), before(F.col("r"), "sum", F.lit(0).cast(kind)).alias("total"),
    )
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Ranges are as many as the partitions of one shuffle at most, so this side is small at every size.
    joined = stored.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "__range")
    return joined.select(*rows.columns, (F.col("__at") + F.col("__rank")).alias("rank"), (F.col("__before") + F.col("__inside")).cast(kind).alias("cumulative"), "total")
