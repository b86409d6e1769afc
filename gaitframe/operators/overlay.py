"""What an overlay draws: pixel points, skeleton edges, and the state of every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions.numbers import half_even
from gaitframe.operators.landmarks import first_pose
from gaitframe.schema import SKELETON


def pixel_points(records: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of the first pose's landmarks that lie in the picture; the last of equal indexes. A record is a frame."""
    return records.select("video_path", "frame_index", F.inline(_placed(width, height)))


def _placed(width: int, height: int) -> Column:
    """The record's points in the picture: landmark_index, px, py."""

    def pixel(v, size):
        return half_even(v * size).cast("int")

    def drawn(x):
        return x["x"].between(0, 1) & x["y"].between(0, 1)

    inside = F.filter(first_pose(F.col("pose_landmarks")), drawn)
    points = F.transform(inside, lambda x, i: F.struct(i.alias("nth"), x["landmark_index"].alias("landmark_index"), pixel(x["x"], width).alias("px"), pixel(x["y"], height).alias("py")))
    last = F.filter(points, lambda p: ~F.exists(points, lambda q: (q["nth"] > p["nth"]) & q["landmark_index"].eqNullSafe(p["landmark_index"])))
    return F.transform(last, lambda p: F.struct(p["landmark_index"].alias("landmark_index"), p["px"].alias("px"), p["py"].alias("py")))


def record_edges(records: DataFrame, width: int, height: int) -> DataFrame:
    """The skeleton's lines of every record, inside the record: nothing is joined or shuffled."""
    known = F.filter(_placed(width, height), lambda p: p["landmark_index"].isNotNull())
    at = F.map_from_entries(F.transform(known, lambda p: F.struct(p["landmark_index"], p)))
    lines = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SKELETON])
    r = records.select("video_path", "frame_index", at.alias("_at"))
    ends = F.transform(lines, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.element_at("_at", e["a"]).alias("p"), F.element_at("_at", e["b"]).alias("q")))
    r = r.select("video_path", "frame_index", F.explode(F.filter(ends, lambda e: e["p"].isNotNull() & e["q"].isNotNull())).alias("e"))
    return r.select("video_path", "frame_index", "e.a", "e.b", F.col("e.p.px").alias("ax"), F.col("e.p.py").alias("ay"), F.col("e.q.px").alias("bx"), F.col("e.q.py").alias("by"))


def skeleton_edges(points: DataFrame) -> DataFrame:
    """Lines between points of a table whose both ends are there."""
    edges = points.sparkSession.createDataFrame(list(SKELETON), "a int, b int")
    e = F.broadcast(edges)  # 35 rows
    one = points.withColumnRenamed("landmark_index", "a").join(e, "a").withColumnsRenamed({"px": "ax", "py": "ay"})
    two = points.withColumnsRenamed({"landmark_index": "b", "px": "bx", "py": "by"})
    return one.join(two, ["video_path", "frame_index", "b"]).select("video_path", "frame_index", "a", "b", "ax", "ay", "bx", "by")


def frame_states(frames: DataFrame, records: DataFrame) -> DataFrame:
    """``not_sampled``, ``no_pose`` or ``pose_detected`` for every frame (video_path, frame_index)."""
    r = records.select("video_path", "frame_index", F.coalesce("pose_count", F.lit(0)).alias("_n"))
    j = frames.select("video_path", "frame_index").join(r, ["video_path", "frame_index"], "left")
    return j.select("video_path", "frame_index", F.when(F.col("_n").isNull(), "not_sampled").when(F.col("_n") > 0, "pose_detected").otherwise("no_pose").alias("state"))
