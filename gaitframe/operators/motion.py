"""Frame signals of clips: pivot of tracked landmarks, then lags over each clip's frames.

Records are pivoted in place, landmark tables by one aggregate by frame (partial sums
first). The signals are windows by clip; a clip's frames are what one window holds, and
Spark spills them if it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaitframe.functions import names
from gaitframe.functions.numbers import angle, angle_difference, clean, line_angle, row_mean
from gaitframe.operators.landmarks import first_pose
from gaitframe.schema import FEATURES, LANDMARK_NAMES, TRACKED


def by_frame() -> WindowSpec:
    """The frames of a clip in order."""
    return Window.partitionBy("video_id").orderBy("frame_index", "timestamp_ms")


def whole_clip() -> WindowSpec:
    return by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def pivot_frames(landmarks: DataFrame) -> DataFrame:
    """x_ and y_ of every tracked landmark, a row a frame, from pose 0 in image space.

    A cell is the first value that is not null, by ``ordinal``. Frames whose landmarks
    are all null, and rows without clip, frame or time, are left out.
    """
    rows = landmarks.where("coordinate_space = 'image' AND pose_index = 0 AND video_id IS NOT NULL AND frame_index IS NOT NULL AND timestamp_ms IS NOT NULL")
    rows = rows.withColumns({"x": clean(F.col("x")), "y": clean(F.col("y"))}).where("x IS NOT NULL OR y IS NOT NULL")
    nth = "ordinal" if "ordinal" in landmarks.columns else "0"
    # min_by keeps to a hash aggregate, which a minimum of structs would not
    cells = [F.expr(f"min_by({axis}, CASE WHEN landmark_name = '{name}' AND {axis} IS NOT NULL THEN {nth} END) AS {axis}_{name}") for name in TRACKED for axis in "xy"]
    return rows.groupBy("video_id", "frame_index", "timestamp_ms").agg(*cells)


def pivot_records(records: DataFrame, *more: str) -> DataFrame:
    """The same as ``pivot_frames``, out of nested records with one a frame (see ``last_by_frame``), and more of their columns.

    Each cell is looked up in the record's own first pose, so nothing is exploded or
    shuffled, and columns that no cell needs are not read.
    """
    pose = first_pose(F.col("pose_landmarks"))
    number = {name: i for i, name in enumerate(LANDMARK_NAMES)}

    def cell(name: str, axis: str) -> Column:
        return F.get(F.filter(F.col("_pose"), lambda m: (m["landmark_index"] == number[name]) & clean(m[axis]).isNotNull()), F.lit(0))[axis].alias(f"{axis}_{name}")

    rows = records.select(names.video_id(F.col("video_path")).alias("video_id"), "frame_index", "timestamp_ms", *more, pose.alias("_pose"))
    rows = rows.where("video_id IS NOT NULL AND frame_index IS NOT NULL AND timestamp_ms IS NOT NULL")
    rows = rows.where(F.exists("_pose", lambda m: F.coalesce(clean(m["x"]), clean(m["y"])).isNotNull()))
    return rows.select("video_id", "frame_index", "timestamp_ms", *more, *[cell(name, axis) for name in TRACKED for axis in "xy"])


def elapsed(window: WindowSpec | None = None, time: str = "timestamp_ms", frame: str = "frame_index") -> Column:
    """Seconds since the frame before; by 24 frames a second where time does not rise."""
    window = window or by_frame()
    dt = (F.col(time) - F.lag(time).over(window)) / 1000.0
    step = F.col(frame) - F.lag(frame).over(window)
    return F.when(dt > 0, dt).otherwise(F.when(step > 0, step).otherwise(1) / 24.0)


def signals(frames: DataFrame) -> DataFrame:
    """Centres, heights and elapsed time, which phases and features share."""
    if "_dt" in frames.columns:
        return frames
    c = F.col
    f = frames.withColumns({
        "wrist_center_x": row_mean(c("x_left_wrist"), c("x_right_wrist")),
        "wrist_center_y": row_mean(c("y_left_wrist"), c("y_right_wrist")),
        "shoulder_y": row_mean(c("y_left_shoulder"), c("y_right_shoulder")),
    })
    return f.withColumns({"backlift_height_proxy": c("shoulder_y") - c("wrist_center_y"), "_dt": elapsed()})


def vertical_speed(value: str) -> Column:
    """Change a second, 0 where it is unknown."""
    return F.coalesce((F.col(value) - F.lag(value).over(by_frame())) / F.col("_dt"), F.lit(0.0))


def with_motion(frames: DataFrame) -> DataFrame:
    """Add what phase detection reads: hand height and vertical speed, and whether all four points are there."""
    f = signals(frames)
    four = " AND ".join(f"{c} IS NOT NULL" for c in ("y_left_wrist", "y_right_wrist", "y_left_shoulder", "y_right_shoulder"))
    return f.withColumns({"hand_y": F.col("wrist_center_y"), "hand_height_proxy": F.col("backlift_height_proxy"), "wrist_speed_y": vertical_speed("wrist_center_y"), "usable_for_phase": F.expr(four)})


def frame_motion(frames: DataFrame) -> DataFrame:
    """The seven columns of the frame motion table."""
    return with_motion(frames).select("video_id", "frame_index", "timestamp_ms", "hand_y", "hand_height_proxy", "wrist_speed_y", "usable_for_phase")


def wrist_kinematics(frames: DataFrame, x: str = "wrist_center_x", y: str = "wrist_center_y") -> DataFrame:
    """Speed, acceleration and smoothness of a point; frames need ``_dt``."""
    window = by_frame()
    vx, vy = ((F.col(v) - F.lag(v).over(window)) / F.col("_dt") for v in (x, y))
    f = frames.withColumn("wrist_speed_proxy", F.coalesce(F.sqrt(vx * vx + vy * vy), F.lit(0.0)))
    change = F.abs(F.col("wrist_speed_proxy") - F.lag("wrist_speed_proxy").over(window))
    f = f.withColumn("wrist_acceleration_proxy", F.coalesce(change / F.col("_dt"), F.lit(0.0)))
    return f.withColumn("wrist_path_smoothness_proxy", 1 / (1 + F.col("wrist_acceleration_proxy")))


def head_displacement(x: str, y: str, whole: WindowSpec | None = None) -> Column:
    """Distance from the first place that is known."""
    start = F.first(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), ignorenulls=True).over(whole or whole_clip())
    dx, dy = F.col(x) - start["x"], F.col(y) - start["y"]
    return F.sqrt(dx * dx + dy * dy)


def joint_angles(frames: DataFrame) -> DataFrame:
    """Knee angles, the smaller one, and the angle between shoulder and hip lines."""
    p = lambda name: (F.col(f"x_{name}"), F.col(f"y_{name}"))
    knee = lambda side: angle(p(f"{side}_hip"), p(f"{side}_knee"), p(f"{side}_ankle"))
    f = frames.withColumns({"left_knee_angle_deg": knee("left"), "right_knee_angle_deg": knee("right")})
    return f.withColumns({
        "front_knee_bend_proxy_deg": F.least("left_knee_angle_deg", "right_knee_angle_deg"),
        "shoulder_hip_separation_proxy_deg": angle_difference(line_angle(p("left_shoulder"), p("right_shoulder")), line_angle(p("left_hip"), p("right_hip"))),
    })


def movement_features(frames: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """The 19 feature columns of every frame.

    The phase is the timeline's (of the latest time, if it holds a frame more than once),
    else the frames' own if they have one (no join then), else null.
    """
    f = wrist_kinematics(joint_angles(signals(frames)))
    f = f.withColumns({"head_x": F.col("x_nose"), "head_y": F.col("y_nose"), "head_displacement_proxy": head_displacement("x_nose", "y_nose")})
    if timeline is None and "phase" not in f.columns:
        f = f.withColumn("phase", F.lit(None).cast("string"))
    elif timeline is not None:
        last = timeline.groupBy("video_id", "frame_index").agg(F.max_by("phase", "timestamp_ms").alias("phase"))
        f = f.drop("phase").join(last, ["video_id", "frame_index"], "left")
    core = " AND ".join(f"{c} IS NOT NULL" for c in ("head_x", "head_y", "wrist_center_x", "wrist_center_y", "backlift_height_proxy"))
    f = f.withColumns({"follow_through_height_proxy": F.when(F.col("phase") == "follow_through", F.col("backlift_height_proxy")), "usable_for_motion": F.expr(core)})
    return f.select(*FEATURES.names)


def movement_summary(features: DataFrame, *by: str) -> DataFrame:
    """Metrics over all frames (not only the usable ones) by clip."""
    c = F.col
    return features.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("usable_for_motion").alias("usable_frames"),
        F.max("backlift_height_proxy").alias("max_backlift_height_proxy"),
        F.max("follow_through_height_proxy").alias("follow_through_height_proxy"),
        F.avg("head_displacement_proxy").alias("mean_head_displacement_proxy"),
        F.when(F.count_if(c("head_x").isNotNull() & c("head_y").isNotNull()) > 0, F.sqrt(F.var_samp("head_x") + F.var_samp("head_y"))).alias("head_motion_std_proxy"),
        F.min("front_knee_bend_proxy_deg").alias("min_front_knee_bend_proxy_deg"),
        F.avg("shoulder_hip_separation_proxy_deg").alias("mean_shoulder_hip_separation_proxy_deg"),
        F.avg("wrist_speed_proxy").alias("mean_wrist_speed_proxy"),
        F.avg("wrist_path_smoothness_proxy").alias("mean_wrist_path_smoothness_proxy"),
    )
