"""Label join and leave-one-out nearest neighbours over clip metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.functions.numbers import number
from gaitframe.operators import neighbours
from gaitframe.schema import METRIC_NAMES


def first_labels(audit: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One label a clip: the first by ``ordinal`` among rows with clip and type."""
    rows = audit.where("video_id IS NOT NULL AND shot_type IS NOT NULL")
    return rows.groupBy("video_id").agg(F.min_by("shot_type", ordinal).alias("shot_type"))


def label_join(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest rows with the audit's shot type (null where there is none)."""
    return manifest.drop("shot_type").join(labels.withColumnRenamed("video_id", "shot_id"), "shot_id", "left")


def unmatched(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    return manifest.join(labels, manifest["shot_id"] == labels["video_id"], "left_anti")


def checked_label_join(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """The same, but a row without a label fails the query and names its id."""
    joined = label_join(manifest, labels)
    return joined.withColumn("shot_type", F.coalesce("shot_type", F.raise_error(F.concat(F.lit("no label for "), "shot_id")).cast("string")))


def known_metrics(shots: DataFrame) -> list[str]:
    """The metrics that some shot has: one pass, seven counts."""
    counts = shots.agg(*[F.count(number(F.col(c))).alias(c) for c in METRIC_NAMES]).first()
    return [c for c in METRIC_NAMES if counts[c]]


def scaled(shots: DataFrame, columns: tuple[str, ...] = METRIC_NAMES) -> DataFrame:
    """Metrics with means for nulls, less the mean, over the population deviation (0: 1).

    A metric that no shot has is 0 everywhere, and so adds nothing to a distance; to leave
    such metrics out, give ``known_metrics``.

    Means and deviations are numbers in the plan (two passes, a row each), since a sum that
    runs again on a cluster may add its parts in another order and end in other last digits.
    """
    means = shots.agg(*[F.avg(c).alias(c) for c in columns]).first()
    filled = shots.select("shot_id", "shot_type", *[F.coalesce(c, F.lit(means[c]).cast("double")).alias(c) for c in columns])
    devs = filled.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return filled.select("shot_id", "shot_type", *[F.coalesce((F.col(c) - F.lit(means[c]).cast("double")) / F.lit(devs[c] or 1.0), F.lit(0.0)).alias(c) for c in columns])


def nearest(points: DataFrame, columns: tuple[str, ...] = METRIC_NAMES) -> DataFrame:
    """Every shot's nearest other shot by Euclidean distance, the smaller shot_id on ties (``neighbours`` skips what is too far)."""
    return neighbours.nearest(points, columns).drop("compared")


def confusion(predictions: DataFrame, shots: DataFrame) -> DataFrame:
    """Counts of every pair of labels, zeros included (labels are few)."""
    labels = shots.select(F.col("shot_type").cast("string").alias("t")).distinct()
    pairs = labels.select(F.col("t").alias("true_shot_type")).join(F.broadcast(labels.select(F.col("t").alias("predicted_shot_type"))))
    counts = predictions.groupBy(F.col("true_shot_type").cast("string").alias("true_shot_type"), F.col("predicted_shot_type").cast("string").alias("predicted_shot_type")).agg(F.count(F.lit(1)).alias("shots"))
    return pairs.join(counts, ["true_shot_type", "predicted_shot_type"], "left").withColumn("shots", F.coalesce("shots", F.lit(0)))


def evaluation(predictions: DataFrame, shots: DataFrame) -> DataFrame:
    """One row: status, samples, classes, accuracy."""
    sizes = shots.groupBy("shot_type").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
    hit = predictions.agg(F.avg((F.col("true_shot_type") == F.col("predicted_shot_type")).cast("double")).alias("accuracy"))
    known = shots.agg(F.max(F.coalesce(*METRIC_NAMES).isNotNull()).alias("known")) if set(METRIC_NAMES) <= set(shots.columns) else shots.agg(F.lit(True).alias("known"))
    status = (
        F.when(F.col("samples") == 0, "no_usable_features")
        .when((F.col("samples") < 2) | ~F.coalesce("known", F.lit(False)), "insufficient_samples_or_features")
        .when(F.col("least") >= 2, "ok")
        .otherwise("insufficient_class_replicates_for_reliable_evaluation")
    )
    one = sizes.join(F.broadcast(hit)).join(F.broadcast(known))  # one row each
    return one.select(status.alias("evaluation_status"), "samples", "classes", F.when(status.isin("ok", "insufficient_class_replicates_for_reliable_evaluation"), F.col("accuracy")).alias("accuracy"))
