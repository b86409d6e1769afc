"""Clip metrics over usable frames, and their distributions by shot type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.functions.names import relative_path
from gaitframe.functions.numbers import number
from gaitframe.schema import METRIC_NAMES, METRICS

AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min}


def aggregate(column: str, how: str) -> Column:
    """Mean, max or min of what is a number; any other name is an error."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {how}")
    return AGGREGATES[how](number(F.col(column)))


def shot_summary(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows, usable_frames, is_usable and seven metrics of every manifest row; clips without features are not usable."""
    use = F.col("usable_for_motion") if "usable_for_motion" in features.columns else F.lit(True)
    present = [c for c in features.columns if c in {m[1] for m in METRICS}]
    f = features.select("video_id", use.alias("_use"), *[F.when(use, F.col(c)).alias(c) for c in present])
    metrics = [(aggregate(column, how) if column in present else F.lit(None).cast("double")).alias(name) for name, column, how in METRICS]
    per = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_use").alias("usable_frames"), *metrics)
    out = manifest.join(per, manifest["shot_id"] == per["video_id"], "left")
    return out.select("shot_id", "shot_type", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("usable_frames", F.lit(0)).alias("usable_frames"), F.coalesce(*METRIC_NAMES).isNotNull().alias("is_usable"), *METRIC_NAMES)


def metric_rows(shots: DataFrame, *ids: str) -> DataFrame:
    """A row a shot and metric."""
    return shots.unpivot(list(ids), list(METRIC_NAMES), "metric", "value")


def distributions(shots: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min and max of each metric by shot type, over usable shots."""
    rows = metric_rows(shots.where("is_usable"), "shot_type").where("value IS NOT NULL")
    return rows.groupBy("shot_type", "metric").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def moments(shots: DataFrame) -> DataFrame:
    """n, mean, m2 (squared deviations from the mean), min and max of each metric by shot type: what clips add to a baseline.

    Also, as metric null, how many shots of the manifest there are and how many can be used.
    """
    rows = metric_rows(shots.where("is_usable"), "shot_type").where("value IS NOT NULL")
    n = F.count("value")
    per = rows.groupBy("shot_type", "metric").agg(n.alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * n).alias("m2"), F.min("value").alias("min"), F.max("value").alias("max"))
    sizes = shots.groupBy("shot_type").agg(F.count(F.lit(1)).alias("manifest_shots"), F.count_if("is_usable").alias("usable_shots"))
    return per.unionByName(sizes.withColumn("metric", F.lit(None).cast("string")), allowMissingColumns=True)


def merged(parts: DataFrame) -> DataFrame:
    """Moments of the union of the clips that the parts stand for; the parts' order does not matter."""
    whole = parts.groupBy(F.col("shot_type").alias("_type"), F.col("metric").alias("_metric")).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    j = parts.join(whole, F.col("shot_type").eqNullSafe(F.col("_type")) & F.col("metric").eqNullSafe(F.col("_metric")))
    off = F.col("mean") - F.col("_mean")
    return j.groupBy("shot_type", "metric").agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("manifest_shots").alias("manifest_shots"), F.sum("usable_shots").alias("usable_shots"),
    )


def add_clips(shots: DataFrame, path: str) -> None:
    """Append the moments of new clips to the stored baseline; old clips are not read."""
    moments(shots).coalesce(1).write.mode("append").parquet(path)  # seven rows a type


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Moments of all clips that were added to a stored baseline."""
    return merged(spark.read.parquet(path))


def distributions_of(whole: DataFrame) -> DataFrame:
    """``distributions`` out of moments."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return whole.where("metric IS NOT NULL").select("shot_type", "metric", F.col("n").alias("count"), "mean", std.alias("std"), "min", "max")


def baseline_manifest(clips: DataFrame, folder: str, shot_type: str) -> DataFrame:
    """shot_id, one shot type for all, and the feature file's path as seen from the manifest's folder (clips: video_id, features_path)."""
    return clips.select(F.col("video_id").alias("shot_id"), F.lit(shot_type).alias("shot_type"), relative_path(F.col("features_path"), F.lit(folder)).alias("movement_features_csv"))


def baseline_table(shots: DataFrame) -> DataFrame:
    """Manifest shots, usable shots and how many metrics have a distribution, by type."""
    known = [F.count(F.when(F.col("is_usable"), F.col(m))) > 0 for m in METRIC_NAMES]
    features = sum((k.cast("int") for k in known), F.lit(0))
    return shots.groupBy("shot_type").agg(F.count(F.lit(1)).alias("manifest_shots"), F.count_if("is_usable").alias("usable_shots"), features.alias("feature_count"))


def type_counts(shots: DataFrame) -> DataFrame:
    """Manifest shots, usable shots and sorted shot ids by type."""
    return shots.groupBy("shot_type").agg(F.count(F.lit(1)).alias("manifest_shots"), F.count_if("is_usable").alias("usable_shots"), F.sort_array(F.collect_list("shot_id")).alias("shot_ids"))
