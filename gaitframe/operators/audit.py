"""Detection rates of clips, the best clip, archive counts and balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.functions import names
from gaitframe.functions.numbers import half_even
from gaitframe.schema import SHOT_CLASSES


def audit_rows(clips: DataFrame) -> DataFrame:
    """Ids, labels, rate and status of clips (relative_path, frames_seen, frames_processed, frames_with_pose, error)."""
    split, kind = names.sample_labels(F.col("relative_path"))
    c = clips.withColumns({"split": split, "shot_type": kind, "_bad": F.col("error").isNotNull() & (F.col("error") != "")})
    counts = {k: F.when(F.col("_bad"), 0).otherwise(F.coalesce(k, F.lit(0))) for k in ("frames_seen", "frames_processed", "frames_with_pose")}
    c = c.withColumns(counts).withColumn("video_id", names.safe_id(F.col("split"), F.col("shot_type"), F.col("relative_path")))
    rate = F.coalesce(F.try_divide(F.col("frames_with_pose").cast("double"), F.col("frames_processed")), F.lit(0.0))
    status = F.when(F.col("_bad"), "failed").when(F.col("frames_with_pose") > 0, "pose_detected").otherwise("no_pose_detected")
    return c.select(
        "video_id", "split", "shot_type", F.col("relative_path").alias("video_path"), F.concat("video_id", F.lit(".pose.jsonl")).alias("output_jsonl_path"),
        *counts, half_even(rate, 4).alias("pose_detection_rate"), status.alias("status"), F.coalesce("error", F.lit("")).alias("error"),
    )


def audit_summary(audit: DataFrame, ordinal: str = "video_id") -> DataFrame:
    """One row: counts, mean of the rounded rates of clips that did not fail, and the best of them (the first on ties)."""
    ok = F.col("status") != "failed"
    best = F.struct(F.when(ok, -F.col("pose_detection_rate")).alias("a"), (-F.col("frames_with_pose")).alias("b"), F.col(ordinal).alias("c"))
    return audit.agg(
        F.count(F.lit(1)).alias("total_videos"), F.count_if(ok).alias("attempted_videos"), F.count_if(~ok).alias("failed_videos"), F.count_if(F.col("frames_with_pose") > 0).alias("videos_with_pose"),
        F.coalesce(half_even(F.avg(F.when(ok, F.col("pose_detection_rate"))), 4), F.lit(0.0)).alias("mean_pose_detection_rate"), F.min_by("video_id", F.when(ok, best)).alias("best_video"),
    )


def best_clips(audit: DataFrame, n: int = 1, ordinal: str = "video_id") -> DataFrame:
    """The clips with the highest rate, then most frames with a pose, among those with a pose."""
    return audit.where("status = 'pose_detected'").orderBy(F.desc("pose_detection_rate"), F.desc("frames_with_pose"), ordinal).limit(n)


def archive_members(members: DataFrame) -> DataFrame:
    """Clips of an archive with their split and type (needs member)."""
    split, kind = names.archive_labels(F.col("member"))
    return members.where(names.is_video(F.col("member"))).withColumns({"split": split, "shot_type": kind})


def archive_counts(members: DataFrame) -> DataFrame:
    """Clips by split, by type, by both, and in all, from one pass."""
    counts = archive_members(members).groupingSets([["split"], ["shot_type"], ["split", "shot_type"], []], "split", "shot_type").agg(F.count(F.lit(1)).alias("videos"), F.grouping_id().alias("level"))
    return counts.select("level", "split", "shot_type", "videos")


def balanced_sample(members: DataFrame, split: str, per_class: int, ordinal: str = "ordinal") -> DataFrame:
    """The first clips of each known class within a split."""
    rows = archive_members(members).where((F.col("split") == split) & F.col("shot_type").isin(*SHOT_CLASSES))
    nth = F.row_number().over(Window.partitionBy("shot_type").orderBy(ordinal))
    return rows.withColumn("nth", nth).where(F.col("nth") <= per_class)


def first_members(members: DataFrame, n: int = 30, ordinal: str = "ordinal") -> DataFrame:
    return members.where(names.is_video(F.col("member"))).orderBy(ordinal).limit(n)


def every_nth_frame(frames: DataFrame, every: int, most: int | None = None, clip: str = "video_id", frame: str = "frame_index") -> DataFrame:
    """Frames whose number ``every`` divides, at most ``most`` of a clip."""
    if every < 1 or most is not None and most < 1:
        raise ValueError("every and most must be positive")
    kept = frames.where(F.col(frame) % every == 0)
    if most is None:
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(clip).orderBy(frame))).where(F.col("_n") <= most).drop("_n")


def frame_file_name(frame, suffix: str = ".jpg"):
    return F.format_string(f"frame_%06d{suffix}", frame)
