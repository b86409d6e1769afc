"""A clip's metrics against the baseline of its shot type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions.numbers import z_score
from gaitframe.operators.baseline import metric_rows

COMPARABLE = ("within_baseline", "above_baseline", "below_baseline")

#: What is said of each status.
NOTES = {
    "missing_shot_type_baseline": "No shot of this type is in the baseline.",
    "insufficient_shot_pose_data": "No frame of the shot can be used for motion.",
    "insufficient_baseline_data": "None of the baseline's shots of this type can be used.",
    "insufficient_metric_overlap": "No metric is known of both the shot and the baseline.",
    "comparison_available": "The shot was compared; its metrics are proxies in the picture's plane.",
}

#: What is said of each metric.
INTERPRETATIONS = {
    "shot_metric_unavailable": "The shot has no value of this metric.",
    "baseline_metric_unavailable": "The baseline's shots have no usable values of this metric.",
    "baseline_variance_unavailable": "The baseline's values show no spread, so there is no z-score.",
    "above_baseline": "The value lies more than one standard deviation over the baseline's mean.",
    "below_baseline": "The value lies more than one standard deviation under the baseline's mean.",
    "within_baseline": "The value lies within one standard deviation of the baseline's mean.",
}
#: The same where the baseline does not list the metric at all.
NOT_LISTED = "The baseline does not list this metric."


def interpretation(status: Column, listed: Column) -> Column:
    said = F.create_map(*[F.lit(x) for kv in INTERPRETATIONS.items() for x in kv])
    return F.when((status == "baseline_metric_unavailable") & ~listed, NOT_LISTED).otherwise(F.element_at(said, status))


def metric_status(value: Column, count: Column, mean: Column, std: Column) -> Column:
    z = z_score(value, mean, std)
    return (
        F.when(value.isNull(), "shot_metric_unavailable")
        .when(mean.isNull() | (F.coalesce(count, F.lit(0)) <= 0), "baseline_metric_unavailable")
        .when(std.isNull() | (std == 0), "baseline_variance_unavailable")
        .when(z > 1, "above_baseline")
        .when(z < -1, "below_baseline")
        .otherwise("within_baseline")
    )


def metric_comparisons(shots: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each of the seven metrics of every shot beside its type's distribution, with status and interpretation.

    shots: shot_id, shot_type and the metrics; baseline: shot_type, metric, count, mean, std.
    """
    rows = metric_rows(shots, "shot_id", "shot_type")
    b = baseline.select("shot_type", "metric", F.col("count").alias("_n"), F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    j = rows.join(b, ["shot_type", "metric"], "left")
    value, known = F.col("value"), F.col("value").isNotNull()
    mean, std = F.when(known, F.col("_mean")), F.when(known, F.col("_std"))
    return j.select(
        "shot_id", "shot_type", "metric", value.alias("shot_value"), mean.alias("baseline_mean"), std.alias("baseline_std"), F.when(known, F.coalesce("_n", F.lit(0))).otherwise(0).alias("baseline_count"),
        F.when(known, value - F.col("_mean")).alias("delta_from_mean"), z_score(value, mean, std).alias("z_score"), metric_status(value, F.col("_n"), F.col("_mean"), F.col("_std")).alias("status"), F.col("_n").isNotNull().alias("_listed"),
    ).withColumn("interpretation", interpretation(F.col("status"), F.col("_listed"))).drop("_listed")


def shot_status(shots: DataFrame, metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """Comparison status and note of every shot; shots need usable_frames, and rows pass through."""
    per = metrics.groupBy("shot_id").agg(F.count_if(F.col("status").isin(*COMPARABLE)).alias("_comparable"))
    had = [c for c in ("rows",) if c in shots.columns]
    j = shots.select("shot_id", "shot_type", "usable_frames", *had).join(counts.select("shot_type", "manifest_shots", "usable_shots"), "shot_type", "left").join(per, "shot_id", "left")
    status = (
        F.when(F.col("manifest_shots").isNull(), "missing_shot_type_baseline")
        .when(F.coalesce("usable_frames", F.lit(0)) == 0, "insufficient_shot_pose_data")
        .when(F.col("usable_shots") == 0, "insufficient_baseline_data")
        .when(F.coalesce("_comparable", F.lit(0)) == 0, "insufficient_metric_overlap")
        .otherwise("comparison_available")
    )
    comparable = F.when(F.col("manifest_shots").isNull(), 0).otherwise(F.coalesce("_comparable", F.lit(0)))
    notes = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    return j.select("shot_id", "shot_type", *had, "usable_frames", comparable.alias("comparable_metrics"), status.alias("comparison_status")).withColumn("note", F.element_at(notes, F.col("comparison_status")))
