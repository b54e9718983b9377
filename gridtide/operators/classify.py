"""Classification of raw records by ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import hour_of, is_fold, is_gap, to_utc, wall_clock, wall_time
from ..spec import PanelSpec

REJECTED, QUARANTINED, ACCEPTED = "rejected", "quarantined", "accepted"


def classify_records(records: DataFrame, lookup: DataFrame, spec: PanelSpec, *, time: str = "local_time", key: str = "key", areas: tuple[str, ...] | None = None) -> DataFrame:
    """records with the lookup's columns (key, zone, area), reason, status, time_utc and hour_utc.

    The first rule that holds names the reason. Times that no instant shows, or two do, are
    quarantined and never converted. With ``areas``, a key whose area is not among them, or is null, is outside. The lookup is
    small by nature (one row for each key) and left to Spark's size check for broadcast.
    """
    wall = wall_clock(F.col(time))
    known = lookup.select(F.col("key").alias("__key"), "zone", "area")
    joined = records.join(known, F.col(key) == F.col("__key"), "left")
    outside = (wall < wall_time(spec.start)) | (wall >= wall_time(spec.end))
    reason = (
        F.when(F.col(time).isNull(), "rejected_missing_time")
        .when(outside, "rejected_outside_window")
        .when(is_gap(wall, spec.tz), "quarantined_gap")
        .when(is_fold(wall, spec.tz), "quarantined_fold")
        .when(F.col(key).isNull(), "rejected_missing_key")
        .when(F.col("__key").isNull(), "rejected_unknown_key")
    )
    if areas is not None:
        reason = reason.when(~F.coalesce(F.col("area").isin(*areas), F.lit(False)), "rejected_outside_area")
    named = joined.withColumn("reason", reason.otherwise("accepted")).drop("__key")
    status = F.when(F.col("reason").startswith(REJECTED), REJECTED).when(F.col("reason").startswith(QUARANTINED), QUARANTINED).otherwise(ACCEPTED)
    with_status = named.withColumn("status", status)
    utc = F.when(F.col("status") == ACCEPTED, to_utc(wall, spec.tz))
    return with_status.withColumns({"time_utc": utc, "hour_utc": hour_of(utc)})


def reason_counts(classified: DataFrame) -> DataFrame:
    """status, reason, n; one partial count in each task, then one row for each reason."""
    return classified.groupBy("status", "reason").agg(F.count("*").alias("n"))
