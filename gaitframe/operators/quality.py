"""Pose quality of frames and clips, by array functions: nothing is exploded or shuffled per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions import names
from gaitframe.functions.numbers import clamp01, clean
from gaitframe.operators.landmarks import first_pose
from gaitframe.schema import LANDMARK_NAMES


def mean_of(landmarks: Column, field: str) -> Column:
    """Mean of a field where it is not null; null if it nowhere is."""
    known = F.filter(F.transform(landmarks, lambda x: clean(x[field])), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.size(known))


def valid_share(landmarks: Column) -> Column:
    """Share of landmarks with x and y in [0, 1]; a null is outside, no landmarks give 0."""
    inside = F.filter(landmarks, lambda x: clean(x["x"]).between(0, 1) & clean(x["y"]).between(0, 1))
    return F.coalesce(F.try_divide(F.size(inside).cast("double"), F.size(landmarks)), F.lit(0.0))


def frame_quality(records: DataFrame) -> DataFrame:
    """13 columns for every processed frame, with or without a pose."""
    r = records.select("*", first_pose(F.col("pose_landmarks")).alias("_image"), first_pose(F.col("pose_world_landmarks")).alias("_world"))
    r = r.select(
        names.video_id(F.col("video_path")).alias("video_id"), F.coalesce("video_path", F.lit("")).alias("source_video_path"), "frame_index", "timestamp_ms", F.coalesce("pose_count", F.lit(0)).alias("pose_count"),
        (F.size("_image") > 0).alias("has_pose"), F.size("_image").alias("image_landmark_count"), F.size("_world").alias("world_landmark_count"),
        clamp01(F.size("_image") / F.lit(float(len(LANDMARK_NAMES)))).alias("landmark_coverage"),
        mean_of(F.col("_image"), "visibility").alias("mean_visibility"), mean_of(F.col("_image"), "presence").alias("mean_presence"), valid_share(F.col("_image")).alias("coordinate_valid_ratio"),
    )
    score = 0.40 * F.col("landmark_coverage") + 0.25 * F.coalesce("mean_visibility", F.lit(0.0)) + 0.25 * F.coalesce("mean_presence", F.lit(0.0)) + 0.10 * F.col("coordinate_valid_ratio")
    return r.withColumn("frame_quality_score", F.when(F.col("has_pose"), clamp01(score)).otherwise(0.0))


def clip_quality(frames: DataFrame, *by: str, low: float = 0.5) -> DataFrame:
    """Detection rate and mean scores by clip, or over all frames if ``by`` is empty (zeros for no frames)."""
    n = F.count(F.lit(1))
    return frames.groupBy(*by).agg(
        n.alias("total_frames_processed"),
        F.count_if("has_pose").alias("frames_with_pose"),
        F.coalesce(F.try_divide(F.count_if("has_pose").cast("double"), n), F.lit(0.0)).alias("pose_detection_rate"),
        F.coalesce(F.avg("frame_quality_score"), F.lit(0.0)).alias("mean_frame_quality_score"),
        F.avg("mean_visibility").alias("mean_visibility"),
        F.avg("mean_presence").alias("mean_presence"),
        F.coalesce(F.try_divide(F.count_if(F.col("frame_quality_score") < low).cast("double"), n), F.lit(0.0)).alias("low_quality_frame_rate"),
    )
