"""Report rows, Markdown reports and cards of compared shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.functions import names
from gaitframe.schema import CHART_COLUMNS, METRIC_NAMES

#: The closing words of a report.
LIMITATION = "Metrics are two-dimensional proxies from detected poses; they describe signals and are no coaching, medical or injury advice."
#: The closing words of a baseline.
BASELINE_LIMITATION = "Baselines describe the listed clips only; they are neither norms of a population nor standards to train by."
#: What the dashboard's modes call their demo.
MODES = {"real": "real_demo", "synthetic": None}


def report_rows(metrics: DataFrame) -> DataFrame:
    """A formatted line of the metric table for every compared metric."""
    line = F.concat(F.lit("| "), "metric", F.lit(" | "), names.shown(F.col("shot_value")), F.lit(" | "), names.shown(F.col("baseline_mean")), F.lit(" | "), names.shown(F.col("baseline_std")), F.lit(" | "), "status", F.lit(" |"))
    return metrics.select("shot_id", "metric", names.short_metric(F.col("metric")).alias("short_name"), "status", line.alias("line"))


def chart_rows(metrics: DataFrame) -> DataFrame:
    """What a bar chart shows: metrics with a value and a baseline mean."""
    return metrics.where("shot_value IS NOT NULL AND baseline_mean IS NOT NULL").select("shot_id", names.short_metric(F.col("metric")).alias("short_name"), "shot_value", "baseline_mean")


def feature_chart(features: DataFrame) -> DataFrame:
    """Clip, frame, and those of the chart's columns that are there, by clip and frame."""
    return features.select("video_id", "frame_index", *[c for c in CHART_COLUMNS if c in features.columns]).orderBy("video_id", "frame_index")


def rate_chart(audit: DataFrame) -> DataFrame:
    """Detection rates by falling rate; clips of one rate by id."""
    return audit.select("video_id", "shot_type", "pose_detection_rate").orderBy(F.desc("pose_detection_rate"), "video_id")


def markdown(shots: DataFrame, metrics: DataFrame) -> DataFrame:
    """A Markdown report a shot (shot_id, shot_type, comparison_status, note, rows, usable_frames).

    At most seven lines meet a shot, in the metrics' fixed order.
    """
    place = F.array_position(F.array(*map(F.lit, METRIC_NAMES)), F.col("metric"))
    lines = report_rows(metrics).groupBy("shot_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("n"), "line"))), lambda x: x["line"]), "\n").alias("table"))
    j = shots.join(lines, "shot_id", "left")
    table = F.when(F.col("comparison_status") == "missing_shot_type_baseline", "| No comparable metrics |  |  |  | insufficient data |").otherwise(F.coalesce("table", F.lit("| No comparable metrics |  |  |  | insufficient data |")))
    text = F.concat_ws(
        "\n", F.lit("# Shot report"), F.lit(""), F.lit("## Summary"), F.lit(""),
        F.concat(F.lit("- Shot type: `"), "shot_type", F.lit("`")), F.concat(F.lit("- Comparison status: `"), "comparison_status", F.lit("`")),
        F.concat(F.lit("- Movement rows: `"), F.col("rows").cast("string"), F.lit("`")), F.concat(F.lit("- Usable motion frames: `"), F.col("usable_frames").cast("string"), F.lit("`")),
        F.lit(""), F.lit("## Notes"), F.lit(""), F.concat(F.lit("- "), "note"), F.lit(""), F.lit("## Metric comparisons"), F.lit(""),
        F.lit("| Metric | Shot value | Baseline mean | Baseline std | Status |"), F.lit("|---|---:|---:|---:|---|"), table, F.lit(""), F.lit("## Limitations"), F.lit(""), F.lit(LIMITATION), F.lit(""),
    )
    return j.select("shot_id", text.alias("markdown"))


def cards(status: DataFrame, quality: DataFrame, movement: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Display values of a clip: status, usable frames, detection rate and mean quality.

    status by shot_id (no row: ``missing``, no value: ``unknown``); quality by video_id.
    movement (video_id, usable_frames) fills usable frames that the comparison lacks, and
    selected (video_id, selected_pose_detection_rate) comes before the quality's rate.
    """
    s = status.select(F.col("shot_id").alias("_shot"), F.coalesce("comparison_status", F.lit("unknown")).alias("_status"), F.col("usable_frames").cast("string").alias("_usable"))
    q = quality.select(F.col("video_id").alias("_shot"), F.col("pose_detection_rate").alias("_rate"), F.col("mean_frame_quality_score").alias("_quality"))
    j, usable, rate = s.join(q, "_shot", "full"), F.col("_usable"), F.col("_rate")
    if movement is not None:
        j = j.join(movement.select(F.col("video_id").alias("_shot"), F.col("usable_frames").cast("string").alias("_moved")), "_shot", "full")
        usable = F.coalesce(usable, "_moved")
    if selected is not None:
        j = j.join(selected.select(F.col("video_id").alias("_shot"), F.col("selected_pose_detection_rate").alias("_selected")), "_shot", "left")
        rate = F.coalesce("_selected", rate)
    return j.select(
        F.col("_shot").alias("shot_id"), F.coalesce("_status", F.lit("missing")).alias("comparison_status"), F.coalesce(usable, F.lit("N/A")).alias("usable_motion_frames"),
        names.shown(rate, 3).alias("pose_detection_rate"), names.shown(F.col("_quality"), 3).alias("mean_frame_quality"),
    )


def mode_paths(root: str, clip: str, mode: str) -> dict[str, str]:
    """``artifact_paths`` of a mode of the dashboard; another mode is an error."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode} (there are {', '.join(MODES)})")
    return artifact_paths(root, clip, MODES[mode])


def artifact_paths(root: str, clip: str, demo: str | None = None) -> dict[str, str]:
    """Where a clip's artifacts lie under a folder: those of a demo of that name, or of single steps.

    An audit, a manifest and a summary belong to a demo only.
    """
    if not root or not clip or demo == "":
        raise ValueError("a folder, a clip and, for a demo, its name are needed")
    data = f"{root}/data/processed" + (f"/{demo}" if demo else "")
    features, reports = f"{data}/features/{clip}", f"{data}/reports/{clip}"
    out = {
        "landmark_parquet": f"{data}/landmarks/{clip}.landmarks.parquet", "overlay_video": f"{root}/outputs/{demo or 'sample_overlays'}/{clip}_pose_overlay.mp4", "report_markdown": f"{reports}_report.md", "comparison_json": f"{reports}_comparison.json",
        "report_chart": f"{reports}_metric_comparison.png", "pose_quality_summary": f"{features}.pose_quality_summary.json", "pose_quality_csv": f"{features}.pose_quality.csv",
        "phase_summary": f"{features}.phase_summary.json", "phase_timeline_csv": f"{features}.phase_timeline.csv", "movement_summary": f"{features}.movement_summary.json",
        "movement_features_csv": f"{features}.movement_features.csv", "baseline_profile": f"{data}/baselines/{demo or 'sample'}_baseline_profile.json",
    }
    if demo:
        out |= {"demo_summary": f"{data}/{demo}_summary.json", "pose_audit_summary": f"{data}/pose_audit/pose_audit_summary.json", "pose_audit_csv": f"{data}/pose_audit/pose_audit.csv", "baseline_manifest": f"{data}/baselines/{demo}_baseline_manifest.csv"}
    return out


def manifest_evidence(manifest: DataFrame) -> DataFrame:
    """One row: status, manifest rows and distinct feature paths."""
    if "movement_features_csv" in manifest.columns:
        status, paths = F.lit("ok"), F.count_distinct("movement_features_csv")
    else:
        status, paths = F.lit("missing_movement_features_csv"), F.lit(0).cast("long")
    n = F.count(F.lit(1))
    return manifest.agg(F.when(n == 0, "missing_or_empty").otherwise(status).alias("status"), n.alias("manifest_rows"), paths.alias("unique_movement_feature_paths"))
