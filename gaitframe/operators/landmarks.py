"""Nested frame records to the tidy landmark table, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions import names
from gaitframe.functions.numbers import clean
from gaitframe.schema import LANDMARK_COLUMNS


def landmarks(records: DataFrame) -> DataFrame:
    """A row for each landmark of each pose of each space, and its ordinal in the record.

    Both spaces leave one scan: they are two elements of one array that is exploded.
    """
    spaces = F.array(F.struct(F.lit("image").alias("s"), F.col("pose_landmarks").alias("p")), F.struct(F.lit("world").alias("s"), F.col("pose_world_landmarks").alias("p")))
    by_space = records.select("video_path", "frame_index", "timestamp_ms", F.explode(spaces).alias("g"))
    by_pose = by_space.select("video_path", "frame_index", "timestamp_ms", F.col("g.s").alias("coordinate_space"), F.posexplode("g.p").alias("pose_index", "pose"))
    rows = by_pose.select("*", F.posexplode("pose").alias("ordinal", "l"))
    return rows.select(
        names.video_id(F.col("video_path")).alias("video_id"), F.coalesce("video_path", F.lit("unknown_video")).alias("source_video_path"), "frame_index", "timestamp_ms", "pose_index", "coordinate_space",
        "l.landmark_index", names.landmark_name(F.col("l.landmark_index")).alias("landmark_name"), *[clean(F.col(f"l.{c}")).alias(c) for c in LANDMARK_COLUMNS[-5:]], "ordinal",
    )


def landmark_summary(table: DataFrame, *by: str) -> DataFrame:
    """Rows, frames, pose instances and spaces, over all or by columns."""
    return table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("landmark_rows"),
        F.count_distinct("video_id", "frame_index").alias("frames"),
        F.count_distinct("video_id", "frame_index", "pose_index", "coordinate_space").alias("pose_instances"),
        F.sort_array(F.collect_set("coordinate_space")).alias("spaces"),
    )


def first_pose(poses: Column) -> Column:
    """Landmarks of the first pose, an empty array if there is none."""
    return F.coalesce(F.get(poses, F.lit(0)), F.expr("cast(array() as array<struct<landmark_index:int,x:double,y:double,z:double,visibility:double,presence:double>>)"))
