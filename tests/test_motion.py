"""Rules of the motion operators on small hand-made clips."""

import json
import math
import tarfile

import pytest
from gaitframe.functions import names, numbers
from gaitframe.operators import audit, baseline, classify, compare, landmarks, motion, neighbours, overlay, phases, quality, report
from gaitframe.schema import BASELINE_VERSION, COMPARISON_VERSION, LANDMARK_NAMES, METRIC_NAMES, RECORD, SKELETON
from gaitframe.sources import pose, sinks
from gaitframe.streaming import frames as streams
from pyspark.sql import Row
from pyspark.sql import functions as F

HAND = [0.58, 0.57, 0.56, 0.52, 0.47, 0.40, 0.34, 0.30, 0.33, 0.40, 0.49, 0.59, 0.54, 0.46, 0.38, 0.31, 0.28, 0.30, 0.34, 0.38, 0.42, 0.44, 0.45, 0.45]
SHORT = [0.58, 0.53, 0.46, 0.36, 0.30, 0.40, 0.55, 0.44, 0.34, 0.29]


def record(frame, points, path="clips/sample.mp4", ms=None, **more):
    marks = [{"landmark_index": LANDMARK_NAMES.index(n), "x": x, "y": y, "z": None, "visibility": 0.9, "presence": 0.9} for n, (x, y) in points.items()]
    return {"video_path": path, "frame_index": frame, "timestamp_ms": 42 * frame if ms is None else ms, "pose_count": 1, "pose_landmarks": [marks], "pose_world_landmarks": []} | more


def body(i, y):
    return {
        "nose": (0.50 + 0.001 * i, 0.20), "left_wrist": (0.42, y), "right_wrist": (0.46, y + 0.01), "left_shoulder": (0.40, 0.45), "right_shoulder": (0.52, 0.46), "left_hip": (0.42, 0.70), "right_hip": (0.50, 0.71),
        "left_knee": (0.43, 0.82), "right_knee": (0.49, 0.82), "left_ankle": (0.44, 0.95), "right_ankle": (0.48, 0.95),
    }


def swing(y):
    return {"left_wrist": (0.42, y), "right_wrist": (0.46, y + 0.01), "left_shoulder": (0.40, 0.45), "right_shoulder": (0.50, 0.45)}


def frames_of(spark, records):
    return motion.pivot_frames(landmarks.landmarks(spark.createDataFrame(records, RECORD)))


def timeline_of(spark, records):
    return phases.phase_timeline(motion.frame_motion(frames_of(spark, records))).orderBy("video_id", "frame_index").collect()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(x):
    return F.lit(x).cast("double") if x is None else F.lit(float(x))


def test_angles(spark):
    p = lambda x, y: (lit(x), lit(y))
    r = one(
        spark, numbers.angle(p(0, 1), p(0, 0), p(1, 0)), numbers.angle(p(-1, 0), p(0, 0), p(1, 0)), numbers.angle(p(0, 0), p(0, 0), p(1, 0)), numbers.angle(p(None, 0), p(0, 0), p(1, 0)),
        numbers.line_angle(p(0, 0), p(1, 0)), numbers.line_angle(p(0, 0), p(0, 1)), numbers.line_angle(p(1, 1), p(1, 1)), numbers.angle_difference(lit(350), lit(10)), numbers.angle_difference(lit(-170), lit(170)),
    )
    assert [x if x is None else round(x, 9) for x in r] == [90, 180, None, None, 0, 90, None, 20, 20]


def test_scalars(spark):
    r = one(
        spark, numbers.timestamp_ms(F.lit(12), lit(24)), numbers.timestamp_ms(F.lit(7), lit(0)), numbers.slow_fps(lit(24), lit(3)), numbers.slow_fps(lit(0), lit(100)), numbers.duration_sec(F.lit(24), lit(12)),
        numbers.fourcc(F.lit(0x34363248)), numbers.half_even(lit(8.5)), numbers.half_even(lit(9.5)), numbers.row_mean(lit(None), lit(2)), numbers.row_mean(lit(1), lit(2)), numbers.row_mean(lit(None), lit(None)),
        numbers.clamp01(lit(None)), numbers.clamp01(lit(7)), numbers.number(F.lit("nan")), numbers.number(F.lit("x")), numbers.number(F.lit("1.5")), numbers.bat_angle(lit(0)), numbers.drawn_phase(lit(0.6)),
    )
    assert list(r) == [500, 7, 8, 1, 2, "H264", 8, 10, 2, 1.5, None, None, 1, None, None, 1.5, -130, "contact_zone"]


def test_names(spark):
    split, kind = names.sample_labels(F.lit("test/cover/a b.mp4"))
    r = one(
        spark, names.video_id(F.lit("a/b/pull_0025.x.mp4")), names.video_id(F.lit("")), names.video_id(F.lit(None).cast("string")), names.landmark_name(F.lit(0)), names.landmark_name(F.lit(99)), split, kind,
        names.safe_id(F.lit("test"), F.lit("late_cut"), F.lit("x/example clip 01.mp4")), names.short_metric(F.lit("mean_wrist_speed_proxy")), names.shown(lit(None)), names.shown(lit(0.75), 3),
        names.json_between_braces(F.lit('log {"k": 3} end'), "k int")["k"], names.without_suffix(F.lit("a.pose.jsonl"), ".pose.jsonl"), names.without_images(F.lit("# A\n\n![x](y.png)\n\nB")), *names.sample_labels(F.lit("cover/a.mp4")),
    )
    assert list(r) == ["pull_0025.x", "unknown_video", "unknown_video", "nose", "unknown_99", "test", "cover", "test_late_cut_example_clip_01", "wrist speed", "N/A", "0.750", 3, "a", "# A\n\nB\n", "unknown", "cover"]


def test_archive(spark):
    members = ["d/test/cover/a.mp4", "d/test/pull/b.AVI", "d/train/cover/c.mp4", "d/Validation/sweep/d.mov", "d/test/cover/._a.mp4", "d/test/pull/._b.mp4", "__MACOSX/d/test/cover/a.mp4", "d/test/lone.mp4", "x/Pull/e.webm", "n.txt"]
    df = spark.createDataFrame(list(enumerate(members)), "ordinal int, member string")
    counts = {(r.level, r.split, r.shot_type): r.videos for r in audit.archive_counts(df).collect()}
    assert counts[3, None, None] == 6 and counts[1, "test", None] == 3 and counts[2, None, "cover"] == 2 and counts[0, "val", "sweep"] == 1 and counts[0, "unknown", "pull"] == 1 and counts[0, "test", "lone.mp4"] == 1
    assert sorted(r.member for r in audit.balanced_sample(df, "test", 1).collect()) == ["d/test/cover/a.mp4", "d/test/pull/b.AVI"]
    assert audit.balanced_sample(df, "validation", 1).count() == 0
    assert [r.ordinal for r in audit.first_members(df, 2).collect()] == [0, 1]


def test_landmark_rows(spark):
    rec = record(3, {"nose": (0.5, 0.4), "left_wrist": (math.nan, 0.6)}, ms=125)
    rec["pose_world_landmarks"] = [rec["pose_landmarks"][0][:1]]
    none = record(4, {}) | {"pose_landmarks": None, "pose_world_landmarks": None, "pose_count": None}
    rows = landmarks.landmarks(spark.createDataFrame([rec, none], RECORD)).orderBy("coordinate_space", "landmark_index").collect()
    assert [(r.landmark_name, r.coordinate_space, r.pose_index, r.x) for r in rows] == [("nose", "image", 0, 0.5), ("left_wrist", "image", 0, None), ("nose", "world", 0, 0.5)]
    s = landmarks.landmark_summary(landmarks.landmarks(spark.createDataFrame([rec, none], RECORD))).first()
    assert (s.landmark_rows, s.frames, s.pose_instances, s.spaces) == (3, 1, 2, ["image", "world"])


def test_quality(spark):
    full = record(1, dict.fromkeys(LANDMARK_NAMES, (0.5, 0.5)))
    for m in full["pose_landmarks"][0]:
        m |= {"visibility": 0.8, "presence": 0.6}
    q = quality.frame_quality(spark.createDataFrame([record(0, {}) | {"pose_landmarks": [], "pose_count": 0}, full], RECORD)).orderBy("frame_index")
    none, good = q.collect()
    assert not none.has_pose and none.frame_quality_score == 0 and none.mean_visibility is None and none.coordinate_valid_ratio == 0
    assert good.landmark_coverage == 1 and good.coordinate_valid_ratio == 1 and abs(good.frame_quality_score - 0.85) < 1e-12
    s = quality.clip_quality(q).first()
    assert (s.total_frames_processed, s.frames_with_pose, s.pose_detection_rate, s.low_quality_frame_rate) == (2, 1, 0.5, 0.5) and abs(s.mean_frame_quality_score - 0.425) < 1e-12
    assert quality.clip_quality(q.where("false")).first().pose_detection_rate == 0


def test_phases_in_order(spark):
    rows = timeline_of(spark, [record(i, swing(y)) for i, y in enumerate(HAND)])
    want = ["stance"] * 4 + ["backlift"] * 4 + ["downswing"] * 2 + ["contact_zone"] * 3 + ["follow_through"] * 7 + ["recovery"] * 4
    assert [r.phase for r in rows] == want and [r.frame_index for r in rows if r.is_contact_proxy] == [11]


def test_few_frames_are_unavailable(spark):
    rows = timeline_of(spark, [record(i, swing(0.5)) for i in range(5)] + [record(9, swing(0.5), path="other.mp4")])
    assert {r.phase for r in rows} == {"unavailable"} and not any(r.is_contact_proxy for r in rows)


def test_places_count_all_frames(spark):
    """Two frames without a wrist come first: the apex is then a place among all frames, two later."""
    lame = [record(i, {k: v for k, v in swing(0.5).items() if k != "left_wrist"}) for i in range(2)]
    rows = [record(i + 2, swing(y)) for i, y in enumerate(HAND)]
    m = motion.frame_motion(frames_of(spark, lame + rows))
    assert m.where("NOT usable_for_phase").count() == 2
    k = phases.key_frames(m).where("usable_for_phase").first()
    assert (k.n, k.apex, k.contact) == (24, 9, 13)
    assert {r.phase for r in timeline_of(spark, lame + rows) if r.frame_index < 2} == {"unavailable"}


def test_elapsed_without_time(spark):
    m = frames_of(spark, [record(0, swing(0.5), ms=0), record(2, swing(0.6), ms=0), record(3, swing(0.7), ms=1000)])
    rows = motion.frame_motion(m).orderBy("frame_index").collect()
    assert [round(r.wrist_speed_y, 9) for r in rows] == [0, 1.2, 0.1]


def test_pivot_takes_the_first_value(spark):
    twice = record(0, {"nose": (0.1, 0.2)})
    twice["pose_landmarks"] = [[{"landmark_index": 0, "x": x, "y": y, "z": None, "visibility": None, "presence": None} for x, y in ((None, 0.3), (0.4, 0.5))]]
    empty = record(1, {"nose": (None, math.nan)})
    rows = frames_of(spark, [twice, empty]).collect()
    assert [(r.x_nose, r.y_nose) for r in rows] == [(0.4, 0.3)]


def features_of(spark, records):
    f = frames_of(spark, records)
    return motion.movement_features(phases.with_phases(motion.with_motion(f)))


def test_features(spark):
    records = [record(i, body(i, y)) for i, y in enumerate(SHORT)]
    got = features_of(spark, records).orderBy("frame_index")
    rows = got.collect()
    assert len(rows) == 10 and all(r.usable_for_motion for r in rows) and len(got.columns) == 19
    assert abs(max(r.head_displacement_proxy for r in rows) - 0.009) < 1e-12
    assert all(r.front_knee_bend_proxy_deg is not None and r.shoulder_hip_separation_proxy_deg is not None and 0 <= r.wrist_path_smoothness_proxy <= 1 for r in rows)
    assert rows[0].wrist_speed_proxy == 0 and rows[0].wrist_path_smoothness_proxy == 1
    f = frames_of(spark, records)
    joined = motion.movement_features(f, phases.phase_timeline(motion.frame_motion(f))).orderBy("frame_index").collect()
    assert joined == rows
    assert {r.phase for r in motion.movement_features(f).collect()} == {None}
    s = motion.movement_summary(got, "video_id").first()
    assert s.rows == s.usable_frames == 10 and s.max_backlift_height_proxy > 0
    assert motion.movement_features(f.where("false")).count() == 0


def test_one_wrist_is_enough_for_motion(spark):
    b = body(0, 0.5)
    del b["left_wrist"], b["left_shoulder"]
    row = features_of(spark, [record(0, b)]).first()
    assert row.usable_for_motion and row.phase == "unavailable"


def shots(spark, rows):
    return spark.createDataFrame([(i, t, *([v] * 7 if not isinstance(v, tuple) else v)) for i, t, v in rows], "shot_id string, shot_type string, " + ", ".join(f"{m} double" for m in METRIC_NAMES))


def test_baseline(spark):
    cols = ("head_displacement_proxy", "front_knee_bend_proxy_deg", "backlift_height_proxy", "follow_through_height_proxy", "shoulder_hip_separation_proxy_deg", "wrist_speed_proxy", "wrist_path_smoothness_proxy")
    rows = []
    for clip, o in (("s1", 0.0), ("s2", 0.1), ("s3", 0.2)):
        for i, v in enumerate([(0.0, 170.0, -0.1, None), (0.01, 165.0, 0.0, None), (0.02, 160.0, 0.1, None), (0.03 + o, 158.0 - o, 0.2 + o, 0.2 + o)]):
            rows.append((clip, True, *v, 5.0 + i, 2.0, 0.5))
        rows.append((clip, False, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0, 9.0))
    f = spark.createDataFrame(rows, "video_id string, usable_for_motion boolean, " + ", ".join(f"{c} double" for c in cols))
    m = spark.createDataFrame([("s1", "cover"), ("s2", "cover"), ("s3", "pull"), ("s4", "pull")], "shot_id string, shot_type string")
    s = baseline.shot_summary(f, m).orderBy("shot_id")
    got = s.collect()
    assert [(r.rows, r.usable_frames, r.is_usable) for r in got] == [(5, 4, True)] * 3 + [(0, 0, False)]
    assert got[0].max_backlift_height_proxy == 0.2 and got[0].min_front_knee_bend_proxy_deg == 158
    d = {(r.shot_type, r.metric): r for r in baseline.distributions(s).collect()}
    b = d["cover", "max_backlift_height_proxy"]
    assert b["count"] == 2 and abs(b["mean"] - 0.25) < 1e-12 and abs(b["std"] - 0.1 / math.sqrt(2)) < 1e-12 and d["pull", "max_backlift_height_proxy"]["std"] is None
    t = {r.shot_type: (r.manifest_shots, r.usable_shots, r.shot_ids) for r in baseline.type_counts(s).collect()}
    assert t == {"cover": (2, 2, ["s1", "s2"]), "pull": (2, 1, ["s3", "s4"])}
    docs = {r.shot_type: json.loads(r.document) for r in sinks.baseline_document(baseline.distributions(s), baseline.type_counts(s)).collect()}
    assert docs["cover"]["features"]["max_backlift_height_proxy"]["count"] == 2 and docs["pull"]["features"]["max_backlift_height_proxy"]["std"] is None
    with pytest.raises(ValueError):
        baseline.aggregate("x", "median")


def test_comparison(spark):
    base = spark.createDataFrame([("cover", METRIC_NAMES[0], 2, 0.25, 0.05), ("cover", METRIC_NAMES[1], 1, 0.2, None), ("cover", METRIC_NAMES[2], 2, 0.2, 0.0), ("cover", METRIC_NAMES[3], 3, 1.0, 0.1)], "shot_type string, metric string, count long, mean double, std double")
    s = shots(spark, [("a", "cover", (0.30, 0.25, 0.05, 0.5, 12.0, None, 0.7)), ("b", "hook", 1.0), ("c", "pull", 1.0), ("d", "cover", 1.0)])
    m = compare.metric_comparisons(s, base)
    got = {r.metric: r for r in m.where("shot_id = 'a'").collect()}
    assert [got[k].status for k in METRIC_NAMES] == ["within_baseline", "baseline_variance_unavailable", "baseline_variance_unavailable", "below_baseline", "baseline_metric_unavailable", "shot_metric_unavailable", "baseline_metric_unavailable"]
    assert abs(got[METRIC_NAMES[0]].delta_from_mean - 0.05) < 1e-12 and got[METRIC_NAMES[1]].z_score is None and got[METRIC_NAMES[5]].baseline_count == 0
    counts = spark.createDataFrame([("cover", 3, 3), ("pull", 1, 0)], "shot_type string, manifest_shots long, usable_shots long")
    usable = s.withColumn("usable_frames", F.when(F.col("shot_id") == "d", 0).otherwise(10)).withColumn("rows", F.lit(10))
    st = compare.shot_status(usable, m, counts)
    assert {r.shot_id: r.comparison_status for r in st.collect()} == {"a": "comparison_available", "b": "missing_shot_type_baseline", "c": "insufficient_baseline_data", "d": "insufficient_shot_pose_data"}
    text = {r.shot_id: r.markdown for r in report.markdown(st.withColumn("rows", F.lit(10)), m).collect()}
    assert f"| {METRIC_NAMES[0]} | 0.3000 | 0.2500 | 0.0500 | within_baseline |" in text["a"] and "insufficient data" in text["b"] and "## Limitations" in text["a"]
    assert report.chart_rows(m).where("shot_id = 'a'").count() == 4
    card = {r.shot_id: r for r in report.cards(st, spark.createDataFrame([("a", 0.75, 0.6), ("z", 0.5, 0.5)], "video_id string, pose_detection_rate double, mean_frame_quality_score double")).collect()}
    assert card["a"].pose_detection_rate == "0.750" and card["a"].mean_frame_quality == "0.600" and card["z"].comparison_status == "missing" and card["d"].pose_detection_rate == "N/A"


@pytest.mark.parametrize("block", [1024, 2])
def test_classifier(spark, block):
    s = shots(spark, [("cover_a", "cover", 0.0), ("cover_b", "cover", 0.1), ("pull_a", "pull", 10.0), ("pull_b", "pull", 10.1)])
    p = neighbours.nearest(classify.scaled(s), block=block, pivots=block)
    assert {r.shot_id: r.nearest_neighbor_shot_id for r in p.collect()} == {"cover_a": "cover_b", "cover_b": "cover_a", "pull_a": "pull_b", "pull_b": "pull_a"}
    assert {(r.true_shot_type, r.predicted_shot_type): r.shots for r in classify.confusion(p, s).collect()} == {("cover", "cover"): 2, ("pull", "pull"): 2, ("cover", "pull"): 0, ("pull", "cover"): 0}
    assert classify.evaluation(p, s).first() == Row(evaluation_status="ok", samples=4, classes=2, accuracy=1.0)


def test_classifier_edges(spark):
    alone = shots(spark, [("a", "x", 1.0)])
    assert classify.nearest(classify.scaled(alone)).count() == 0
    assert classify.evaluation(classify.nearest(classify.scaled(alone)), alone).first().evaluation_status == "insufficient_samples_or_features"
    none = alone.where("false")
    assert classify.evaluation(classify.nearest(classify.scaled(none)), none).first().evaluation_status == "no_usable_features"
    tie = shots(spark, [("a", "x", 1.0), ("c", "y", 1.0), ("b", "z", 1.0), ("d", "x", None)])
    assert {r.shot_id: r.nearest_neighbor_shot_id for r in classify.nearest(classify.scaled(tie)).collect()} == {"a": "b", "b": "a", "c": "a", "d": "a"}


def test_labels(spark):
    m = spark.createDataFrame([("a", "mixed", "fa"), ("b", "mixed", "fb")], "shot_id string, shot_type string, movement_features_csv string")
    found = classify.first_labels(spark.createDataFrame([("a", "pull", 2), ("a", "hook", 1), (None, "x", 0), ("c", None, 0)], "video_id string, shot_type string, ordinal int"))
    assert {(r.shot_id, r.shot_type) for r in classify.label_join(m, found).collect()} == {("a", "hook"), ("b", None)}
    assert [r.shot_id for r in classify.unmatched(m, found).collect()] == ["b"]
    with pytest.raises(Exception, match="no label for b"):
        classify.checked_label_join(m, found).collect()
    assert report.manifest_evidence(m).first() == Row(status="ok", manifest_rows=2, unique_movement_feature_paths=2)
    assert report.manifest_evidence(m.where("false")).first().status == "missing_or_empty"


def test_audit(spark):
    c = spark.createDataFrame([("test/cover/a.mp4", 30, 10, 3, None), ("test/pull/b.mp4", 30, 10, 0, ""), ("c.mp4", 1, 1, 1, "broken"), ("test/pull/d.mp4", 30, 20, 6, None)], "relative_path string, frames_seen int, frames_processed int, frames_with_pose int, error string")
    rows = audit.audit_rows(c)
    assert {r.video_id: (r.pose_detection_rate, r.status) for r in rows.collect()} == {"test_cover_a": (0.3, "pose_detected"), "test_pull_b": (0.0, "no_pose_detected"), "unknown_unknown_c": (0.0, "failed"), "test_pull_d": (0.3, "pose_detected")}
    assert audit.audit_summary(rows).first() == Row(total_videos=4, attempted_videos=3, failed_videos=1, videos_with_pose=2, mean_pose_detection_rate=0.2, best_video="test_pull_d")
    assert audit.audit_summary(rows.where("false")).first().best_video is None
    assert audit.best_clips(rows).first().video_id == "test_pull_d"
    f = spark.createDataFrame([("a", i) for i in range(24)], "video_id string, frame_index int")
    assert sorted(r.frame_index for r in audit.every_nth_frame(f, 6, 3).collect()) == [0, 6, 12]
    assert f.select(audit.frame_file_name(F.col("frame_index")).alias("n")).where("n = 'frame_000018.jpg'").count() == 1
    with pytest.raises(ValueError):
        audit.every_nth_frame(f, 0)


def test_overlay(spark):
    marks = {n: (0.30 + 0.01 * (i % 5), 0.25 + 0.015 * (i % 7)) for i, n in enumerate(LANDMARK_NAMES)}
    df = spark.createDataFrame([record(0, marks), record(6, {"nose": (0.5, 1.5), "left_eye": (0.0125, 1.0)})], RECORD)
    points = overlay.pixel_points(df, 100, 100)
    assert points.where("frame_index = 0").count() == 33
    assert [(r.px, r.py) for r in points.where("frame_index = 6").collect()] == [(1, 100)]
    assert overlay.skeleton_edges(points).count() == len(SKELETON) == 35
    every = spark.createDataFrame([("clips/sample.mp4", i) for i in range(12)], "video_path string, frame_index int")
    states = {r.frame_index: r.state for r in overlay.frame_states(every, df.withColumn("pose_count", F.when(F.col("frame_index") == 6, 0).otherwise(1))).collect()}
    assert states[0] == "pose_detected" and states[6] == "no_pose" and sum(v == "not_sampled" for v in states.values()) == 10


def test_sources_and_sinks(spark, tmp_path):
    good = [record(i, swing(0.5)) for i in range(3)]
    lines = "\n\n   \n".join(map(json.dumps, good))
    (tmp_path / "good.jsonl").write_text(lines)
    (tmp_path / "bad.jsonl").write_text(lines + "\n{nope\n")
    assert pose.read_pose_records(spark, str(tmp_path / "good.jsonl")).count() == 3
    with pytest.raises(Exception, match="(?i)malformed"):
        pose.read_pose_records(spark, str(tmp_path / "bad.jsonl")).collect()
    lenient = pose.read_pose_records(spark, str(tmp_path / "bad.jsonl"), lenient=True).collect()
    assert [r._corrupt_record for r in lenient if r._corrupt_record] == ["{nope"] and len(lenient) == 4
    twice = spark.createDataFrame([Row(video_path="a", frame_index=0, ordinal=i, pose_count=i) for i in (2, 1)])
    assert pose.last_by_frame(twice).first().pose_count == 2
    f = features_of(spark, [record(i, body(i, y)) for i, y in enumerate(SHORT)])
    sinks.write_csv(f.coalesce(1), str(tmp_path / "f/sample.csv"))
    (tmp_path / "m.csv").write_text("shot_id,shot_type,movement_features_csv,more\ns1,cover,f/sample.csv,1\ns2,pull,f/sample.csv,2\n")
    m = pose.read_manifest(spark, str(tmp_path / "m.csv"))
    assert m.columns == ["shot_id", "shot_type", "movement_features_csv"]
    assert pose.read_features(spark, str(tmp_path / "f/sample.csv")).count() == 10
    (tmp_path / "short.csv").write_text("shot_id\na\n")
    with pytest.raises(ValueError, match="movement_features_csv"):
        pose.read_manifest(spark, str(tmp_path / "short.csv"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(f, str(tmp_path / "f/sample.csv"))
    sinks.write_landmarks(landmarks.landmarks(spark.createDataFrame(good, RECORD)), str(tmp_path / "lm"), 4)
    assert spark.read.parquet(str(tmp_path / "lm")).count() == 12
    for n in ("v/test/cover/a.mp4", "v/test/cover/._a.mp4", "v/__MACOSX/b.mp4", "v/c.txt", "v/d.MOV"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    assert pose.list_videos(spark, str(tmp_path / "v")).count() == 2
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "v", "v")
    assert audit.archive_members(pose.list_archive(spark, str(tmp_path / "a.tar.gz"))).count() == 2


def test_manifest_files(spark, tmp_path):
    f = features_of(spark, [record(i, body(i, y)) for i, y in enumerate(SHORT)]).toPandas()
    for n in ("a", "b"):
        f.to_csv(tmp_path / f"{n}.csv", index=False)
    m = spark.createDataFrame([("s1", "cover", "a.csv"), ("s2", "pull", str(tmp_path / "b.csv"))], "shot_id string, shot_type string, movement_features_csv string")
    rows = pose.manifest_features(spark, m, str(tmp_path)).groupBy("shot_id", "shot_type").count().collect()
    assert {(r.shot_id, r.shot_type, r["count"]) for r in rows} == {("s1", "cover", 10), ("s2", "pull", 10)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join(json.dumps(record(3 * k + i, swing(0.5))) for i in range(3)))
        q = streams.write_quality(streams.record_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "q"), str(tmp_path / "cq"))
        q.awaitTermination(120)
    assert sorted(r.frame_index for r in spark.read.parquet(str(tmp_path / "q")).collect()) == list(range(6))
    streams.write_landmark_rows(streams.record_stream(spark, str(tmp_path / "in")), str(tmp_path / "l"), str(tmp_path / "cl")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 24


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("frame_index,head_y,head_x,video_id,usable_for_motion,extra\n3,0.2,NaN,v,True,z\n4,bad,0.5,v,False,z\n")
    got = {r.frame_index: r for r in pose.read_features(spark, str(tmp_path / "a.csv")).collect()}
    assert (got[3].head_x, got[3].head_y, got[3].usable_for_motion, got[3].phase) == (None, 0.2, True, None)
    assert (got[4].head_x, got[4].head_y, got[4].usable_for_motion) == (0.5, None, False)
    (tmp_path / "b.csv").write_text("video_id,frame_index\nv,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        pose.read_features(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()


def test_manifest_files_with_odd_names_keep_their_rows(spark, tmp_path):
    rows = []
    for i, name in enumerate(["plain.csv", "with space.csv", "a+b 100%.csv"]):
        (tmp_path / name).write_text(f"video_id,frame_index\nv,{i}\n")
        rows.append((f"s{i}", "pull", name if i else f"file://{tmp_path}/{name}"))
    m = spark.createDataFrame(rows, "shot_id string, shot_type string, movement_features_csv string")
    assert {(r.shot_id, r.frame_index) for r in pose.manifest_features(spark, m, str(tmp_path)).collect()} == {("s0", 0), ("s1", 1), ("s2", 2)}


def test_first_videos_by_path(spark, tmp_path):
    for name in ("b.mp4", "a.mov", "c.txt", "d.avi"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in pose.list_videos(spark, str(tmp_path), 2).collect()] == ["a.mov", "b.mp4"]


def test_relative_paths(spark):
    rows = [("/d/f/a.csv", "/d/b", "../f/a.csv", "/d/f/a.csv"), ("/d/b/x/a.csv", "/d/b", "x/a.csv", "x/a.csv"), ("/d/b", "/d/b/", ".", "."), ("/d/./c/../b/a", "/d/b", "a", "a"), ("s3://k/d/a", "/d", "s3://k/d/a", "s3://k/d/a"), ("s3://k/d/a", "s3://k/e", "../d/a", "s3://k/d/a"), ("/d/..x", "/d", "..x", "..x")]
    df = spark.createDataFrame(rows, "path string, start string, relative string, shown string")
    got = df.select(names.relative_path(F.col("path"), F.col("start")).alias("r"), names.shown_path(F.col("path"), F.col("start")).alias("s"))
    assert [(r.r, r.s) for r in got.collect()] == [(x[2], x[3]) for x in rows]
    m = baseline.baseline_manifest(df.limit(1).select(F.lit("v").alias("video_id"), F.col("path").alias("features_path")), "/d/b", "mixed")
    assert m.first() == Row(shot_id="v", shot_type="mixed", movement_features_csv="../f/a.csv")


def test_negative_frame_is_an_error(spark):
    with pytest.raises(Exception, match="must not be negative"):
        spark.range(1).select(numbers.timestamp_ms(F.lit(-1), F.lit(25.0))).collect()


def test_charts_and_known_metrics(spark):
    f = spark.createDataFrame([("v", 1, 0.5), ("v", 0, 0.1)], "video_id string, frame_index int, wrist_speed_proxy double")
    assert report.feature_chart(f).collect() == [Row(video_id="v", frame_index=0, wrist_speed_proxy=0.1), Row(video_id="v", frame_index=1, wrist_speed_proxy=0.5)]
    a = spark.createDataFrame([("a", "x", 0.1), ("c", "y", 0.5), ("b", "z", 0.5)], "video_id string, shot_type string, pose_detection_rate double")
    assert [r.video_id for r in report.rate_chart(a).collect()] == ["b", "c", "a"]
    s = shots(spark, [("a", "x", (1.0, None, 2.0, None, None, None, None)), ("b", "x", (2.0, None, None, None, None, None, None)), ("c", "y", None)])
    known = classify.known_metrics(s)
    assert known == [METRIC_NAMES[0], METRIC_NAMES[2]]
    points = classify.scaled(s, tuple(known))
    assert points.columns == ["shot_id", "shot_type", *known]
    assert {r.shot_id: r.distance for r in classify.nearest(points).collect()} == {r.shot_id: r.distance for r in classify.nearest(classify.scaled(s)).collect()}
    assert {r.shot_type: (r.manifest_shots, r.usable_shots, r.feature_count) for r in baseline.baseline_table(s.withColumn("is_usable", F.coalesce(*METRIC_NAMES).isNotNull())).collect()} == {"x": (2, 2, 2), "y": (1, 0, 0)}


def test_documents(spark):
    base = spark.createDataFrame([("cover", METRIC_NAMES[0], 2, 0.25, 0.05)], "shot_type string, metric string, count long, mean double, std double")
    s = shots(spark, [("a", "cover", (0.30, None, None, None, None, None, None)), ("b", "hook", 1.0)]).withColumn("usable_frames", F.lit(10))
    m = compare.metric_comparisons(s, base)
    st = compare.shot_status(s, m, spark.createDataFrame([("cover", 3, 3)], "shot_type string, manifest_shots long, usable_shots long"))
    docs = {r.shot_id: json.loads(r.document) for r in sinks.comparison_document(st, m, "s.json", "p.json").collect()}
    a, b = docs["a"], docs["b"]
    assert a["comparison_version"] == COMPARISON_VERSION and a["baseline_version"] == BASELINE_VERSION and a["comparison_status"] == "comparison_available" and len(a["metric_comparisons"]) == 7 and a["notes"] == [compare.NOTES["comparison_available"]] and a["limitation"]
    assert {x["metric"]: x["status"] for x in a["metric_comparisons"]}[METRIC_NAMES[0]] == "within_baseline" and a["source_paths"]["baseline_profile_path"] == "p.json"
    assert b["comparison_status"] == "missing_shot_type_baseline" and b["metric_comparisons"] == []
    c = shots(spark, [("a", "x", 0.0), ("b", "x", 0.1), ("c", "y", 9.0)])
    doc = json.loads(sinks.classifier_document(classify.evaluation(classify.nearest(classify.scaled(c)), c), c, classify.known_metrics(c)).first().document)
    assert doc["classes"] == ["x", "y"] and doc["class_counts"] == {"x": 2, "y": 1} and doc["samples"] == 3 and doc["feature_columns"] and doc["evaluation_status"].startswith("insufficient_class")
    rows = audit.audit_rows(spark.createDataFrame([("test/cover/a.mp4", 30, 10, 3, None)], "relative_path string, frames_seen int, frames_processed int, frames_with_pose int, error string"))
    got = sinks.demo_summary(audit.best_clips(rows), c, report.artifact_paths("/r", "test_cover_a", "demo")).first()
    assert (got.selected_video_id, got.selected_pose_detection_rate, got.baseline_video_count) == ("test_cover_a", 0.3, 3) and got.phase_summary_path == "/r/data/processed/demo/features/test_cover_a.phase_summary.json"
    assert "baseline_manifest" not in report.artifact_paths("/r", "c")
    with pytest.raises(ValueError):
        report.artifact_paths("/r", "c", "")


def test_cards_fall_back(spark):
    st = spark.createDataFrame([("a", None, None), ("b", "ok", 4)], "shot_id string, comparison_status string, usable_frames long")
    q = spark.createDataFrame([("a", 0.5, 0.6)], "video_id string, pose_detection_rate double, mean_frame_quality_score double")
    moved = spark.createDataFrame([("a", 7), ("b", 9), ("c", 1)], "video_id string, usable_frames long")
    picked = spark.createDataFrame([("a", 0.5714)], "video_id string, selected_pose_detection_rate double")
    got = {r.shot_id: tuple(r)[1:] for r in report.cards(st, q, moved, picked).collect()}
    assert got == {"a": ("unknown", "7", "0.571", "0.600"), "b": ("ok", "4", "N/A", "N/A"), "c": ("missing", "1", "N/A", "N/A")}


def test_edges_of_records_are_those_of_points(spark):
    marks = {n: (0.30 + 0.01 * (i % 5), 0.25 + 0.015 * (i % 7)) for i, n in enumerate(LANDMARK_NAMES)}
    r = record(0, marks)
    r["pose_landmarks"][0].append({**r["pose_landmarks"][0][3], "x": 0.9})  # the last of equal indexes counts
    r["pose_landmarks"][0].append({**r["pose_landmarks"][0][5], "landmark_index": None})
    df = spark.createDataFrame([r, record(1, {"nose": (0.5, 1.5), "left_eye": (0.1, 1.0), "left_eye_inner": (0.2, 0.1)}), record(2, {}), {**record(3, {}), "pose_landmarks": None}], RECORD)
    points = overlay.pixel_points(df, 100, 100)
    assert points.where("frame_index = 0 AND landmark_index = 3").collect()[0].px == 90
    want = {tuple(x) for x in overlay.skeleton_edges(points).collect()}
    assert {tuple(x) for x in overlay.record_edges(df, 100, 100).collect()} == want and len(want) == 36


def test_archives_beyond_one_value_are_streamed(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    for i in range(3):
        (tmp_path / f"clip{i}.mp4").write_bytes(b"x" * (i + 1))
    with tarfile.open(tmp_path / "in put/a.tar.gz", "w:gz") as t:
        for i in range(3):
            t.add(tmp_path / f"clip{i}.mp4", f"test/cover/clip{i}.mp4")
    path = str(tmp_path / "in put/a.tar.gz")
    assert sorted(pose.list_archive(spark, path, whole=0).collect()) == sorted(pose.list_archive(spark, path).collect()) and pose.list_archive(spark, path, whole=0).count() == 3
    info = pose.dataset_info(spark, "shots.tar.gz", "apache-2.0").first()
    assert info.expected_train_samples == 1250 and len(info.expected_classes) == 10
