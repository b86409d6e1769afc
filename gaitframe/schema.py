"""Types and fixed values of pose records, landmark tables and what follows from them."""

from __future__ import annotations

from pyspark.sql import types as T

LANDMARK = T.StructType([T.StructField("landmark_index", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "visibility", "presence")])
POSES = T.ArrayType(T.ArrayType(LANDMARK))
RECORD = T.StructType([
    T.StructField("video_path", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("pose_count", T.IntegerType()),
    T.StructField("pose_landmarks", POSES), T.StructField("pose_world_landmarks", POSES),
])

# Names of the 33 body landmarks by index.
LANDMARK_NAMES = (
    "nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye", "right_eye_outer", "left_ear", "right_ear", "mouth_left", "mouth_right",
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_pinky", "right_pinky", "left_index", "right_index", "left_thumb", "right_thumb",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle", "left_heel", "right_heel", "left_foot_index", "right_foot_index",
)

# Pairs of landmarks that the skeleton joins.
SKELETON = (
    (0, 1), (1, 2), (2, 3), (3, 7), (0, 4), (4, 5), (5, 6), (6, 8), (9, 10), (11, 12), (11, 13), (13, 15), (15, 17), (15, 19), (15, 21), (17, 19), (12, 14), (14, 16),
    (16, 18), (16, 20), (16, 22), (18, 20), (11, 23), (12, 24), (23, 24), (23, 25), (24, 26), (25, 27), (26, 28), (27, 29), (28, 30), (29, 31), (30, 32), (27, 31), (28, 32),
)

# Landmarks whose x and y the motion signals need.
TRACKED = ("nose", "left_wrist", "right_wrist", "left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")

# Columns of the landmark table.
LANDMARK_COLUMNS = ("video_id", "source_video_path", "frame_index", "timestamp_ms", "pose_index", "coordinate_space", "landmark_index", "landmark_name", "x", "y", "z", "visibility", "presence")

# Phases in order, with confidence and reason.
PHASES = (
    ("stance", 0.55, "early low-motion setup window"),
    ("backlift", 0.70, "hand height proxy rising toward backlift apex"),
    ("downswing", 0.70, "after backlift apex and before contact proxy"),
    ("contact_zone", 0.65, "contact proxy near strongest downward wrist motion"),
    ("follow_through", 0.65, "after contact proxy before recovery window"),
    ("recovery", 0.55, "late post-shot stabilization window"),
)
UNAVAILABLE = ("unavailable", 0.0, "missing required wrist/shoulder landmarks")

# Clip metric, frame column, aggregate.
METRICS = (
    ("max_backlift_height_proxy", "backlift_height_proxy", "max"),
    ("follow_through_height_proxy", "follow_through_height_proxy", "max"),
    ("mean_head_displacement_proxy", "head_displacement_proxy", "mean"),
    ("min_front_knee_bend_proxy_deg", "front_knee_bend_proxy_deg", "min"),
    ("mean_shoulder_hip_separation_proxy_deg", "shoulder_hip_separation_proxy_deg", "mean"),
    ("mean_wrist_speed_proxy", "wrist_speed_proxy", "mean"),
    ("mean_wrist_path_smoothness_proxy", "wrist_path_smoothness_proxy", "mean"),
)
METRIC_NAMES = tuple(m[0] for m in METRICS)

# Names of the documents' versions.
BASELINE_VERSION = "movement_proxy_baseline_v1"
COMPARISON_VERSION = "shot_vs_baseline_v1"

# What a chart of features draws.
CHART_COLUMNS = ("head_displacement_proxy", "backlift_height_proxy", "wrist_speed_proxy", "wrist_path_smoothness_proxy")

# Clips of each split of the public archive.
SPLIT_CLIPS = {"train": 1250, "validation": 250, "test": 250}

# Classes, splits and file extensions of the clip archive.
SHOT_CLASSES = ("cover", "defense", "flick", "hook", "late_cut", "lofted", "pull", "square_cut", "straight", "sweep")
SPLITS = ("train", "val", "validation", "test")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm")

# Columns of the feature table, the audit and the manifest.
FEATURES = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("phase", T.StringType()), T.StructField("usable_for_motion", T.BooleanType())] + [
    T.StructField(c, T.DoubleType()) for c in (
        "head_x", "head_y", "head_displacement_proxy", "left_knee_angle_deg", "right_knee_angle_deg", "front_knee_bend_proxy_deg", "shoulder_hip_separation_proxy_deg", "wrist_center_x", "wrist_center_y",
        "wrist_speed_proxy", "wrist_acceleration_proxy", "wrist_path_smoothness_proxy", "backlift_height_proxy", "follow_through_height_proxy",
    )
])
AUDIT = T.StructType([T.StructField(c, T.StringType()) for c in ("video_id", "split", "shot_type", "video_path", "output_jsonl_path")] + [T.StructField(c, T.IntegerType()) for c in ("frames_seen", "frames_processed", "frames_with_pose")] + [T.StructField("pose_detection_rate", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("shot_id", "shot_type", "movement_features_csv")])
