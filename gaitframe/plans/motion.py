"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitframe.functions import names, numbers
from gaitframe.operators import audit, baseline, classify, compare, landmarks, motion, overlay, phases, quality, report
from gaitframe.sources import pose, sinks
from gaitframe.sources import stand_ins as s
from gaitframe.sources.folders import new_folder
from gaitframe.streaming import clips


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as far as two engines agree; -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _table(spark, sf, sparse=False):
    return landmarks.landmarks(s.pose_records(spark, sf, sparse))


def _frames(spark, sf, sparse=False):
    return motion.pivot_records(s.pose_records(spark, sf, sparse))


def _timeline(spark, sf, sparse=False):
    return phases.phase_timeline(motion.frame_motion(_frames(spark, sf, sparse)))


def _features(spark, sf, sparse=False):
    """Phases and features in one pass with one shuffle, by clip."""
    return motion.movement_features(phases.with_phases(motion.with_motion(_frames(spark, sf, sparse))))


def _shots(spark, sf):
    """A row a clip; a checkpoint where there is a folder for one, since comparisons and neighbours read it several times."""
    shots = baseline.shot_summary(_features(spark, sf, True), s.manifest(spark, sf))
    return shots.checkpoint() if spark.sparkContext.getCheckpointDir() else shots


def _comparisons(spark, sf):
    shots = _shots(spark, sf)
    return compare.metric_comparisons(shots, baseline.distributions(shots))


def landmark_explode(spark, sf):
    return rounded(_table(spark, sf, True).drop("ordinal"))


def landmark_summary(spark, sf):
    return landmarks.landmark_summary(_table(spark, sf), "coordinate_space").withColumn("spaces", F.array_join("spaces", ","))


def frame_quality(spark, sf):
    return rounded(quality.frame_quality(s.pose_records(spark, sf, True)))


def frame_quality_of_lines(spark, sf):
    """Records as JSON lines, written and read again with the strict reader."""
    path = new_folder(spark, "records")
    sinks.write_json(s.pose_records(spark, sf, True), path)
    return rounded(quality.frame_quality(pose.read_pose_records(spark, path)))


def clip_quality_summary(spark, sf):
    return rounded(quality.clip_quality(quality.frame_quality(s.pose_records(spark, sf, True)), "video_id"), 5)


def frame_pivot(spark, sf):
    return rounded(_frames(spark, sf, True))


def frame_pivot_of_table(spark, sf):
    return rounded(motion.pivot_frames(_table(spark, sf, True)))


def phase_timeline_of_table(spark, sf):
    """Phases out of a landmark table in buckets by clip, which needs no exchange."""
    path = new_folder(spark, "landmarks")
    table = sinks.write_landmark_table(_table(spark, sf, True), path.rpartition("/")[2].replace("-", "_"), path=path)
    return rounded(phases.phase_timeline(motion.frame_motion(motion.pivot_frames(table))))


def joint_angles(spark, sf):
    f = motion.joint_angles(_frames(spark, sf, True))
    return rounded(f.select("video_id", "frame_index", "left_knee_angle_deg", "right_knee_angle_deg", "front_knee_bend_proxy_deg", "shoulder_hip_separation_proxy_deg"), 4)


def wrist_kinematics(spark, sf):
    f = motion.wrist_kinematics(motion.signals(_frames(spark, sf, True)))
    return rounded(f.select("video_id", "frame_index", "wrist_center_x", "wrist_center_y", "wrist_speed_proxy", "wrist_acceleration_proxy", "wrist_path_smoothness_proxy"), 5)


def wrist_kinematics_irregular(spark, sf):
    e = s.event_signal(spark, sf).withColumn("_dt", motion.elapsed())
    f = motion.wrist_kinematics(e, "x", "y")
    return rounded(f.select("event_id", "video_id", "frame_index", "wrist_speed_proxy", "wrist_path_smoothness_proxy"))


def head_displacement(spark, sf):
    f = _frames(spark, sf, True).withColumn("head_displacement_proxy", motion.head_displacement("x_nose", "y_nose"))
    return rounded(f.select("video_id", "frame_index", "head_displacement_proxy"))


def conversation_displacement(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = s.table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("x"), F.col("turn").cast("double").alias("y"))
    return rounded(c.select("conv_id", "turn", motion.head_displacement("x", "y", w).alias("displacement")))


def frame_motion(spark, sf):
    return rounded(motion.frame_motion(_frames(spark, sf, True)))


def key_frames(spark, sf):
    m = phases.key_frames(motion.frame_motion(_frames(spark, sf, True)))
    return m.groupBy("video_id").agg(F.max("n").cast("long").alias("usable"), F.max("apex").alias("apex"), F.max("contact").alias("contact"))


def phase_timeline(spark, sf):
    return rounded(_timeline(spark, sf))


def phase_timeline_sparse(spark, sf):
    return rounded(_timeline(spark, sf, True))


def phase_timeline_arriving(spark, sf):
    """The rules that close a clip on a stream, over whole clips."""
    frames = _frames(spark, sf, True).withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    return rounded(clips.arriving_phases(frames))


def phase_profile(spark, sf):
    t = _timeline(spark, sf)
    return rounded(t.groupBy("phase").agg(F.count(F.lit(1)).alias("frames"), F.avg("hand_height_proxy").alias("mean_height"), F.count_if("is_contact_proxy").alias("contacts")))


def phase_summary(spark, sf):
    return phases.phase_summary(_timeline(spark, sf, True), "video_id")


def phase_counts(spark, sf):
    return phases.phase_counts(_timeline(spark, sf, True))


def movement_features(spark, sf):
    return rounded(_features(spark, sf, True), 4)


def movement_summary(spark, sf):
    return rounded(motion.movement_summary(_features(spark, sf, True), "video_id"), 4)


def shot_summary(spark, sf):
    return rounded(_shots(spark, sf), 4)


def baseline_distribution(spark, sf):
    return rounded(baseline.distributions(_shots(spark, sf)), 4)


def baseline_merged(spark, sf):
    """The distributions out of moments that were added clip group by clip group (three, by the clip's number)."""
    path = new_folder(spark, "moments")
    shots = _shots(spark, sf)
    for part in range(3):
        baseline.add_clips(shots.where(F.pmod(F.regexp_extract("shot_id", r"(\d+)$", 1).cast("long"), F.lit(3)) == part), path)
    return rounded(baseline.distributions_of(baseline.stored(spark, path)), 4)


def baseline_profile(spark, sf):
    """The one document of the baseline, read back: its head, and what it holds of each type and metric."""
    shots = _shots(spark, sf)
    doc = sinks.profile_document(shots, baseline.distributions(shots), baseline.type_counts(shots), "manifest.csv")
    stats = "struct<count: long, mean: double, std: double, min: double, max: double>"
    shape = f"baseline_version string, total_manifest_rows long, usable_shots long, shot_types map<string, struct<manifest_shots: long, usable_shots: long, features: map<string, {stats}>, shot_ids: array<string>>>, shot_summaries array<struct<shot_id: string, is_usable: boolean, metrics: map<string, double>>>, limitation string, source_manifest_path string"
    d = doc.select(F.from_json("document", shape).alias("d")).select("d.*", F.size("d.shot_summaries").alias("summaries"), F.size(F.filter("d.shot_summaries", lambda x: x["is_usable"])).alias("usable_summaries"))
    d = d.select("*", F.explode("shot_types").alias("shot_type", "t")).select("*", F.explode("t.features").alias("metric", "f"))
    return rounded(d.select("baseline_version", "total_manifest_rows", "usable_shots", "summaries", "usable_summaries", "limitation", "source_manifest_path", "shot_type", F.col("t.manifest_shots").alias("type_shots"), F.size("t.shot_ids").alias("type_ids"), "metric", "f.count", "f.mean", "f.std", "f.min", "f.max"), 4)


def baseline_counts(spark, sf):
    return baseline.type_counts(_shots(spark, sf)).withColumn("shot_ids", F.array_join("shot_ids", ","))


def segment_zscore(spark, sf):
    o = s.table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("value"))
    c = s.table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(o, F.col("c_custkey") == F.col("o_custkey"))
    b = c.groupBy("c_mktsegment").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    j = c.join(b, "c_mktsegment")
    return rounded(j.select("c_custkey", "c_mktsegment", numbers.z_score(F.col("value"), F.col("mean"), F.col("std")).alias("z_score"), compare.metric_status(F.col("value"), F.col("n"), F.col("mean"), F.col("std")).alias("status")), 4)


def metric_status(spark, sf):
    return rounded(_comparisons(spark, sf), 4)


def comparison_status(spark, sf):
    shots = _shots(spark, sf)
    return compare.shot_status(shots, compare.metric_comparisons(shots, baseline.distributions(shots)), baseline.type_counts(shots)).drop("rows")


def report_rows(spark, sf):
    return report.report_rows(_comparisons(spark, sf))


def _doc_manifest(spark, sf):
    return s.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("shot_id"), F.lit("mixed").alias("shot_type"), F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("movement_features_csv"))


def _doc_labels(spark, sf):
    rows = s.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("video_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("shot_type"), F.col("doc_id").alias("ordinal"))
    return classify.first_labels(rows)


def label_join(spark, sf):
    return classify.label_join(_doc_manifest(spark, sf), _doc_labels(spark, sf)).select("shot_id", "shot_type", "movement_features_csv")


def label_unmatched(spark, sf):
    return classify.unmatched(_doc_manifest(spark, sf), _doc_labels(spark, sf)).select("shot_id")


def label_dedupe_first(spark, sf):
    e = s.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("shot_type"), F.struct("ts", "event_id").alias("ordinal"))
    return classify.first_labels(e)


def feature_scaling(spark, sf):
    return rounded(classify.scaled(_shots(spark, sf)), 4)


def loo_nearest(spark, sf):
    return rounded(classify.nearest(classify.scaled(_shots(spark, sf))), 4)


def loo_confusion(spark, sf):
    points = classify.scaled(_shots(spark, sf))
    return classify.confusion(classify.nearest(points), points)


def loo_evaluation(spark, sf):
    shots = _shots(spark, sf)
    return rounded(classify.evaluation(classify.nearest(classify.scaled(shots)), shots))


def audit_rows(spark, sf):
    return audit.audit_rows(s.clips(spark, sf))


def audit_summary(spark, sf):
    return audit.audit_summary(audit.audit_rows(s.clips(spark, sf)))


def best_clips(spark, sf):
    return audit.best_clips(audit.audit_rows(s.clips(spark, sf)), 10).select("video_id", "pose_detection_rate", "frames_with_pose")


def archive_counts(spark, sf):
    return audit.archive_counts(s.archive(spark, sf)).withColumn("level", F.col("level").cast("int"))


def balanced_sample(spark, sf):
    return audit.balanced_sample(s.archive(spark, sf), "val", 3).withColumn("nth", F.col("nth").cast("long"))


def path_labels(spark, sf):
    p = s.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))
    split, kind = names.sample_labels(F.col("path"))
    return p.select("page_id", split.alias("split"), kind.alias("shot_type"), names.safe_id(split, kind, F.col("path")).alias("video_id"))


def json_props(spark, sf):
    e = s.table(spark, sf, "events").select("event_id", F.concat(F.lit("log line "), "props", F.lit(" done")).alias("log"))
    return e.select("event_id", names.json_between_braces(F.col("log"), "k int")["k"].alias("k"))


def metric_short_name(spark, sf):
    rows = baseline.metric_rows(_shots(spark, sf))
    return rows.groupBy("metric", names.short_metric(F.col("metric")).alias("short_name")).agg(F.count("value").alias("shots"))


def every_nth_frame(spark, sf):
    f = s.event_signal(spark, sf).select("event_id", "video_id", "frame_index")
    return audit.every_nth_frame(f, 3, 4)


def first_members(spark, sf):
    return audit.first_members(s.archive(spark, sf))


def pixel_points(spark, sf):
    return overlay.pixel_points(s.pose_records(spark, sf), 640, 360).select(names.video_id(F.col("video_path")).alias("video_id"), "frame_index", "landmark_index", "px", "py")


def skeleton_edges(spark, sf):
    e = overlay.record_edges(s.pose_records(spark, sf), 640, 360)
    return e.select(names.video_id(F.col("video_path")).alias("video_id"), "frame_index", "a", "b", "ax", "ay", "bx", "by")


def frame_states(spark, sf):
    r = s.pose_records(spark, sf)
    sampled = audit.every_nth_frame(r, 3, clip="video_path").withColumn("pose_count", F.col("frame_index") % 2)
    return overlay.frame_states(r, sampled).select(names.video_id(F.col("video_path")).alias("video_id"), "frame_index", "state")


def clip_scalars(spark, sf):
    o = s.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 31 - 1).cast("double").alias("fps"), (F.col("o_orderkey") % 1000).cast("int").alias("i"))
    p = F.col("i") / 999.0
    return rounded(o.select(
        "o_orderkey", numbers.timestamp_ms(F.col("i"), F.col("fps")).alias("timestamp_ms"), numbers.duration_sec(F.col("i"), F.col("fps")).alias("duration_sec"), numbers.slow_fps(F.col("fps"), F.lit(3.0)).alias("slow_fps"),
        numbers.bat_angle(p).alias("bat_angle"), numbers.drawn_phase(p).alias("phase"), numbers.fourcc(F.lit(0x34363248) + F.col("i") % 8).alias("codec"), audit.frame_file_name(F.col("i")).alias("file"),
    ), 4)


def cards(spark, sf):
    shots = _shots(spark, sf)
    status = compare.shot_status(shots, compare.metric_comparisons(shots, baseline.distributions(shots)), baseline.type_counts(shots))
    return report.cards(status, quality.clip_quality(quality.frame_quality(s.pose_records(spark, sf, True)), "video_id"))


def baseline_table(spark, sf):
    return baseline.baseline_table(_shots(spark, sf))


def baseline_manifest(spark, sf):
    m = s.manifest(spark, sf).select(F.col("shot_id").alias("video_id"), F.concat(F.lit("/data/features/"), "movement_features_csv").alias("features_path"))
    return baseline.baseline_manifest(m, "/data/baselines/demo", "sample_mixed")


def relative_paths(spark, sf):
    p = s.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+:/(/[^?#]*)", 1).alias("path"))
    start = F.regexp_extract("path", r"^(/[^/]*)", 1)
    return p.select("page_id", names.relative_path(F.col("path"), F.concat(start, F.lit("/a"))).alias("relative"), names.shown_path(F.col("path"), start).alias("shown"))


def feature_chart(spark, sf):
    return rounded(report.feature_chart(_features(spark, sf, True)), 4)


def rate_chart(spark, sf):
    return report.rate_chart(audit.audit_rows(s.clips(spark, sf)))


def comparison_documents(spark, sf):
    """The documents of ``sinks.comparison_document``, read back: their head, and a row for each of their metrics."""
    shots = _shots(spark, sf)
    metrics = compare.metric_comparisons(shots, baseline.distributions(shots))
    docs = sinks.comparison_document(compare.shot_status(shots, metrics, baseline.type_counts(shots)), metrics, "summary.json", "profile.json")
    entry = "struct<metric: string, shot_value: double, baseline_mean: double, baseline_std: double, baseline_count: long, delta_from_mean: double, z_score: double, status: string, interpretation: string>"
    head = "comparison_version string, baseline_version string, shot_id string, shot_type string, comparison_status string, notes array<string>, movement_rows long, usable_motion_frames long, comparable_metrics long, limitation string"
    d = docs.select(F.from_json("document", f"{head}, metric_comparisons array<{entry}>, source_paths struct<movement_summary_path: string, baseline_profile_path: string>").alias("d"))
    flat = d.select(*[f"d.{x.split()[0]}" for x in head.split(", ")], "d.source_paths.*", F.inline("d.metric_comparisons"))
    return rounded(flat.withColumn("notes", F.array_join("notes", "|")), 4)


def demo_summary(spark, sf):
    rows = audit.audit_rows(s.clips(spark, sf))
    best = audit.best_clips(rows)
    paths = {k: v for k, v in report.artifact_paths("/demo", "clip", "real").items() if k in ("comparison_json", "baseline_manifest", "landmark_parquet")}
    return sinks.demo_summary(best, s.manifest(spark, sf), paths)


def manifest_evidence(spark, sf):
    return report.manifest_evidence(s.manifest(spark, sf))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    phase_profile, landmark_explode, landmark_summary, frame_quality, clip_quality_summary, frame_pivot, joint_angles, wrist_kinematics, wrist_kinematics_irregular, head_displacement, conversation_displacement,
    frame_motion, key_frames, phase_timeline, phase_timeline_sparse, phase_summary, phase_counts, movement_features, movement_summary, shot_summary, baseline_distribution, baseline_counts, segment_zscore,
    metric_status, comparison_status, report_rows, label_join, label_unmatched, label_dedupe_first, feature_scaling, loo_nearest, loo_confusion, loo_evaluation, audit_rows, audit_summary, best_clips,
    archive_counts, balanced_sample, first_members, path_labels, json_props, metric_short_name, every_nth_frame, pixel_points, skeleton_edges, frame_states, clip_scalars, cards, manifest_evidence,
    frame_pivot_of_table, phase_timeline_of_table, phase_timeline_arriving, frame_quality_of_lines, baseline_merged, baseline_profile, baseline_table, baseline_manifest, relative_paths, feature_chart, rate_chart, comparison_documents, demo_summary,
)
