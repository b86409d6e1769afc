"""Pruned neighbours, pivots in the record, bucketed tables, located errors, split archives, growing baselines, closing clips."""

import io
import json
import random
import tarfile
import time

import pytest
from gaitframe.operators import baseline, classify, compare, landmarks, motion, neighbours, phases, report
from gaitframe.schema import METRIC_NAMES, RECORD
from gaitframe.sources import archives, pose, sinks
from gaitframe.streaming import clips
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_motion import HAND, body, record


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


# neighbours


def points(spark, rows):
    return spark.createDataFrame([(i, t, *v) for i, t, v in rows], "shot_id string, shot_type string, " + ", ".join(f"{m} double" for m in METRIC_NAMES))


def plain_nearest(rows):
    out = {}
    for i, t, v in rows:
        best = None
        for j, u, w in rows:
            if i is not None and j is not None and j != i:
                d = sum((a - b) ** 2 for a, b in zip(w, v)) ** 0.5
                if best is None or (d, j) < best[:2]:
                    best = (d, j, u)
        if best and ((i, t) not in out or best < out[i, t]):
            out[i, t] = best
    return out


def clustered(seed, n, groups):
    r = random.Random(seed)
    centres = [[r.gauss(0, 5) for _ in METRIC_NAMES] for _ in range(groups)]
    return [(f"s{i:05d}", f"t{i % 3}", [r.gauss(c, 1) for c in centres[r.randrange(groups)]]) for i in range(n)]


@pytest.mark.parametrize("block,pivots", [(512, 512), (1, 1), (3, 4), (7, 64)])
def test_nearest_is_exact(spark, block, pivots):
    r = random.Random(6)
    rows = clustered(1, 120, 4)
    rows += [(f"c{i:02d}", "same", rows[5][2]) for i in range(30)]  # copies
    rows += [(f"g{i:02d}", "grid", [float(r.randrange(3)) for _ in METRIC_NAMES[:2]] + [0.0] * 5) for i in range(40)]  # ties
    rows += [("s00001", "t1", rows[9][2]), ("s00002", "again", [0.5] * 7), ("z", "far", [1e6] * 7), (None, "none", [0.0] * 7), ("m", "zero", [-0.0] * 7)]
    got = {(x.shot_id, x.true_shot_type): (x.distance, x.nearest_neighbor_shot_id) for x in neighbours.nearest(points(spark, rows), block=block, pivots=pivots).collect()}
    want = plain_nearest(rows)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - v[0]) < 1e-9 * max(1, v[0]) for k, v in want.items())


def test_nearest_skips_most_pairs(spark):
    n = 2000
    for groups, share in ((1, 3), (20, 5)):  # a seventh goes to the pivots
        work = neighbours.nearest(points(spark, clustered(2, n, groups))).agg(F.sum("compared"), F.count(F.lit(1))).first()
        assert work[1] == n and work[0] < n * n / share, (groups, work[0] / n / n)


def test_nearest_of_few(spark):
    assert neighbours.nearest(points(spark, [])).count() == 0
    assert neighbours.nearest(points(spark, [("a", "t", [1.0] * 7)])).count() == 0
    assert {x.shot_id: x.distance for x in neighbours.nearest(points(spark, [("a", "t", [1.0] * 7), ("b", "t", [1.0] * 7)])).collect()} == {"a": 0.0, "b": 0.0}


def test_nearest_loses_no_shot_to_last_digits(spark):
    """Values that differ with each evaluation, as sums on a cluster do: every shot has its neighbour still."""
    noise = F.udf(lambda x: x + (time.time_ns() % 997) * 1e-13, "double").asNondeterministic()
    rows = clustered(4, 300, 4)
    got = neighbours.nearest(points(spark, rows).withColumns({m: noise(m) for m in METRIC_NAMES})).collect()
    want = plain_nearest(rows)
    assert {(x.shot_id, x.true_shot_type): x.nearest_neighbor_shot_id for x in got} == {k: v[1] for k, v in want.items()}
    assert "Aggregate" not in plan(classify.scaled(points(spark, rows)))  # means that no second run changes


# pivots and tables


def some_records(n_clips=5):
    r = random.Random(4)
    out = []
    for c in range(n_clips):
        for i, y in enumerate(HAND):
            p = {k: v for k, v in body(i, y + 0.01 * c).items() if r.random() > 0.1}
            one = record(i, p, path=f"clips/clip {c}.mp4")
            marks = one["pose_landmarks"][0]
            if marks and r.random() < 0.3:
                marks[0] = marks[0] | {"x": float("nan") if r.random() < 0.5 else None}
                marks.append(marks[0] | {"x": 0.25, "y": 0.75})  # the same landmark again
            if r.random() < 0.2:
                one["pose_landmarks"].append([m | {"x": 0.9} for m in marks])  # a second pose
            out.append(one)
    out += [record(40, {}), record(41, {"nose": (None, None)}), record(42, {"nose": (None, 0.5)}), record(43, {"left_ear": (0.1, 0.1)}), record(44, {"nose": (0.1, 0.1)}) | {"frame_index": None}, record(45, {}) | {"pose_landmarks": None}, record(46, {}) | {"video_path": None}]
    return out


def test_pivot_in_the_record(spark):
    df = spark.createDataFrame(some_records(), RECORD)
    there, here = motion.pivot_frames(landmarks.landmarks(df)), motion.pivot_records(df)
    key = lambda rows: sorted(map(repr, rows))
    assert here.columns == there.columns and here.dtypes == there.dtypes
    assert key(here.collect()) == key(there.collect())
    assert exchanges(here) == 0 and exchanges(phases.phase_timeline(motion.frame_motion(here))) == 1
    assert motion.pivot_records(df.where("false")).count() == 0


def test_landmark_table_needs_no_exchange(spark, tmp_path):
    df = spark.createDataFrame(some_records(9), RECORD)
    flat = landmarks.landmarks(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    table = sinks.write_landmark_table(flat, "bucketed_landmarks", 5, str(tmp_path / "t"))
    try:
        timeline = phases.phase_timeline(motion.frame_motion(motion.pivot_frames(table)))
        assert exchanges(timeline) == 0
        assert sorted(map(repr, timeline.collect())) == sorted(map(repr, phases.phase_timeline(motion.frame_motion(motion.pivot_frames(flat))).collect()))
        assert len(list((tmp_path / "t").glob("*.parquet"))) <= 5
    finally:
        spark.sql("DROP TABLE bucketed_landmarks")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# errors with places


def test_errors_name_file_and_line(spark, tmp_path):
    good = json.dumps(record(0, {"nose": (0.1, 0.2)}))
    (tmp_path / "a.jsonl").write_text("\n".join([good] * 400) + "\n")
    lines = [good] * 700
    lines[3], lines[500], lines[650] = "", '{"frame_index": ', "not json"
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits a file
    try:
        with pytest.raises(ValueError, match=r"line 501 of .*b\.jsonl"), pose.naming_lines(spark, str(tmp_path)):
            pose.read_pose_records(spark, str(tmp_path)).agg(F.sum("frame_index"), F.max(F.size("pose_landmarks"))).collect()
        bad = pose.malformed_lines(spark, str(tmp_path))
        assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()) == [("b.jsonl", 501), ("b.jsonl", 651)]
        with pose.naming_lines(spark, str(tmp_path / "a.jsonl")):
            assert pose.read_pose_records(spark, str(tmp_path / "a.jsonl")).count() == 400
        with pytest.raises(ZeroDivisionError), pose.naming_lines(spark, str(tmp_path)):
            raise ZeroDivisionError
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest_errors_name_the_shot(spark, tmp_path):
    n = 300
    (tmp_path / "f").mkdir()
    for i in range(n):
        (tmp_path / "f" / f"{i} ä%20.csv").write_text(f"frame_index,head_x,extra\n{i},0.5,x\n{i + 1},word,\n")
    (tmp_path / "f" / "empty.csv").write_text("")
    (tmp_path / "f" / "only head.csv").write_text("frame_index,head_x\n")
    rows = [(f"s{i}", "t", f"f/{i} ä%20.csv") for i in range(n)] + [("gone", "t", "f/gone.csv"), ("null", "t", None), ("e", "t", "f/empty.csv"), ("h", "t", f"{tmp_path}/f/only head.csv"), ("twice", "t", f"file://{tmp_path}/f/0 ä%20.csv")]
    m = spark.createDataFrame(rows, "shot_id string, shot_type string, movement_features_csv string")
    got = pose.manifest_features(spark, m, str(tmp_path), errors="rows").collect()
    ok = {(r.shot_id, r.frame_index, r.head_x) for r in got if r.error is None}
    assert ok == {(f"s{i}", k, x) for i in range(n) for k, x in ((i, 0.5), (i + 1, None))} | {("twice", 0, 0.5), ("twice", 1, None)}
    assert {r.shot_id for r in got if r.error is not None} == {"gone", "null"} and all(r.shot_id in r.error for r in got if r.error)
    with pytest.raises(Exception, match="features of shot gone"):
        pose.manifest_features(spark, m, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="nonsense"):
        pose.manifest_features(spark, m, str(tmp_path), errors="nonsense")


# archives


def random_tar(r, path, members=60):
    """An archive with long names, folders and members that are archives themselves."""
    with tarfile.open(path, "w", format=r.choice([tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])) as tar:
        for i in range(members):
            name = f"train/cover/clip_{i}.mp4"
            if r.random() < 0.2 and tar.format != tarfile.USTAR_FORMAT:
                name = "train/" + "x" * r.randrange(90, 300) + f"_{i}.mp4"
            info = tarfile.TarInfo(name)
            if r.random() < 0.1:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
                continue
            data = r.randbytes(r.choice([0, 1, 511, 512, 513, 4000]))
            if r.random() < 0.3:
                inner = io.BytesIO()
                with tarfile.open(fileobj=inner, mode="w") as t:
                    for j in range(r.randrange(1, 5)):
                        one = tarfile.TarInfo(f"inner_{j}.mp4")
                        one.size = r.choice([0, 100, 600])
                        t.addfile(one, io.BytesIO(r.randbytes(one.size)))
                data = inner.getvalue()[: r.choice([512, 1024, 5000, 20_000])]
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_split_archives_are_listed_like_streams(spark, tmp_path):
    r = random.Random(9)
    for i in range(4):
        random_tar(r, tmp_path / f"a{i}.tar")
    cut = (tmp_path / "a0.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(cut[: len(cut) // 2 // 512 * 512])
    (tmp_path / "empty.tar").write_bytes(b"\0" * 10240)
    with tarfile.open(tmp_path / "z.tar.gz", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("only.mp4"))
    for name in ("a0.tar", "a1.tar", "a2.tar", "a3.tar", "empty.tar", "z.tar.gz"):
        path = str(tmp_path / name)
        want = sorted(pose.list_archive(spark, path).collect())
        for piece in (512, 4096, 64 << 20):
            if piece == 512 and name != "a1.tar":
                continue
            assert sorted(pose.list_archive(spark, path, whole=0, piece=piece).collect()) == want, (name, piece)
    assert pose.list_archive(spark, str(tmp_path / "a*.tar"), whole=0, piece=8192).count() == pose.list_archive(spark, str(tmp_path / "a*.tar")).count()
    with pytest.raises(ValueError, match="whole number"):
        archives.list_ranges(spark.createDataFrame([], "path string, length long"), 1000)


def test_ways_out_of_ranges(tmp_path):
    """From every header that the sequential reader meets, a range leaves where that reader goes on."""
    r = random.Random(2)
    for i in range(6):
        random_tar(r, tmp_path / f"{i}.tar", 40)
        with open(tmp_path / f"{i}.tar", "rb") as raw:
            chain = [(a, z) for a, z, _ in archives.follow(raw, 0)]
            size = raw.seek(0, 2)
            for piece in (1024, 5120, 1 << 20):
                for lo in range(0, size, piece):
                    usual, others = archives.ways_out(raw, lo, min(size, lo + piece))
                    for a, _ in chain:
                        if lo <= a < lo + piece:
                            later = next((x for x, _ in chain if x >= lo + piece), archives.END)
                            assert others.get(a, usual) == later


# baselines that grow


def some_shots(spark, n=60):
    r = random.Random(3)
    rows = [(f"s{i:03d}", f"t{i % 4}" if i % 13 else None, 9, 9, i % 7 != 0, *[r.gauss(100, 5) if r.random() > 0.2 else None for _ in METRIC_NAMES]) for i in range(n)]
    rows.append(("alone", "single", 9, 9, True, *[1.0] * 7))
    return spark.createDataFrame(rows, "shot_id string, shot_type string, rows long, usable_frames long, is_usable boolean, " + ", ".join(f"{m} double" for m in METRIC_NAMES))


def test_baselines_grow_by_moments(spark, tmp_path):
    shots = some_shots(spark)
    want = {(r.shot_type, r.metric): r for r in baseline.distributions(shots).collect()}
    for parts in (1, 2, 7):
        path = str(tmp_path / f"m{parts}")
        for k in range(parts):
            baseline.add_clips(shots.where(F.pmod(F.xxhash64("shot_id"), F.lit(parts)) == k), path)
        whole = baseline.stored(spark, path)
        got = {(r.shot_type, r.metric): r for r in baseline.distributions_of(whole).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            for c in ("count", "mean", "std", "min", "max"):
                a, b = got[k][c], w[c]
                assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1.0, abs(b))), (k, c, a, b)
        sizes = {r.shot_type: (r.manifest_shots, r.usable_shots) for r in whole.where("metric IS NULL").collect()}
        assert sizes == {r.shot_type: (r.manifest_shots, r.usable_shots) for r in baseline.type_counts(shots).collect()}
    # a merge of merges is the merge
    halves = [baseline.merged(baseline.moments(shots.where(w))) for w in ("shot_id < 's030'", "shot_id >= 's030' OR shot_id IS NULL")]
    again = {(r.shot_type, r.metric): r["mean"] for r in baseline.merged(halves[0].unionByName(halves[1])).collect()}
    assert all(abs(again[k] - w["mean"]) < 1e-9 for k, w in want.items())


def test_profile_document(spark):
    shots = some_shots(spark).where("shot_type IS NOT NULL").withColumn("movement_features_csv", F.concat(F.lit("f/"), "shot_id"))
    found = baseline.distributions(shots)
    doc = json.loads(sinks.profile_document(shots, found, baseline.type_counts(shots), "m.csv").first().document)
    n = shots.count()
    assert list(doc) == ["baseline_version", "total_manifest_rows", "usable_shots", "shot_types", "shot_summaries", "limitation", "source_manifest_path"]
    assert doc["total_manifest_rows"] == n and doc["usable_shots"] == shots.where("is_usable").count() and doc["source_manifest_path"] == "m.csv"
    assert [s["shot_id"] for s in doc["shot_summaries"]] == sorted(r.shot_id for r in shots.collect())
    by = {r.shot_id: r for r in shots.collect()}
    for s in doc["shot_summaries"]:
        assert s["movement_features_csv"] == f"f/{s['shot_id']}" and s["metrics"] == {m: by[s["shot_id"]][m] for m in METRIC_NAMES}
    for r in found.collect():
        assert doc["shot_types"][r.shot_type]["features"][r.metric] == {"count": r["count"], "mean": r["mean"], "std": r["std"], "min": r["min"], "max": r["max"]}
    none = shots.where("false")
    empty = json.loads(sinks.profile_document(none, baseline.distributions(none), baseline.type_counts(none)).first().document)
    assert (empty["total_manifest_rows"], empty["shot_types"], empty["shot_summaries"]) == (0, {}, [])


def test_interpretations(spark):
    shots = some_shots(spark).where("shot_type IS NOT NULL")
    stats = baseline.distributions(shots).where("metric <> 'max_backlift_height_proxy' OR shot_type <> 't1'")
    seen = set()
    for r in compare.metric_comparisons(shots, stats).collect():
        want = compare.INTERPRETATIONS[r.status]
        if r.status == "baseline_metric_unavailable":
            want = compare.NOT_LISTED
        assert r.interpretation == want
        seen.add(r.status)
    assert seen == set(compare.INTERPRETATIONS)
    listed = spark.createDataFrame([("t1", METRIC_NAMES[0], 0, None, None)], "shot_type string, metric string, count long, mean double, std double")
    r = compare.metric_comparisons(shots.where(f"shot_type = 't1' AND {METRIC_NAMES[0]} IS NOT NULL"), listed).where(F.col("metric") == METRIC_NAMES[0]).first()
    assert (r.status, r.interpretation) == ("baseline_metric_unavailable", compare.INTERPRETATIONS["baseline_metric_unavailable"])


def test_modes():
    assert report.mode_paths("/r", "c", "real") == report.artifact_paths("/r", "c", "real_demo")
    assert report.mode_paths("/r", "c", "synthetic") == report.artifact_paths("/r", "c")
    with pytest.raises(ValueError, match="no such mode: other"):
        report.mode_paths("/r", "c", "other")


# clips that close


def same_timeline(got, want):
    got, want = (sorted(x, key=lambda r: (r.video_id, r.frame_index, r.timestamp_ms)) for x in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a.video_id, a.frame_index, a.timestamp_ms, a.phase, a.phase_reason, a.is_contact_proxy) == (b.video_id, b.frame_index, b.timestamp_ms, b.phase, b.phase_reason, b.is_contact_proxy)
        for c in ("hand_y", "hand_height_proxy", "wrist_speed_y", "phase_confidence"):
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or abs(a[c] - b[c]) < 1e-9)


def clip_records():
    r = random.Random(12)
    out = some_records(6)
    for c in range(25):  # clips of many lengths, with frames that lack wrists
        for i in range(r.randrange(1, 40)):
            p = body(i, r.choice([0.3, 0.4, 0.5, 0.6]))
            out.append(record(i, {k: v for k, v in p.items() if r.random() > 0.05}, path=f"clips/r{c}.mp4", ms=0 if c % 5 == 0 else None))
    return [x for x in out if x["frame_index"] is not None]


def test_whole_clips_give_the_timeline(spark):
    frames = motion.pivot_records(spark.createDataFrame(clip_records(), RECORD))
    want = phases.phase_timeline(motion.frame_motion(frames)).collect()
    assert {r.phase for r in want} > {"stance", "unavailable", "contact_zone", "recovery"}
    same_timeline(clips.arriving_phases(frames.withColumn("arrived", F.current_timestamp())).collect(), want)


def test_late_and_shuffled_frames_give_the_batch_timeline(spark, tmp_path):
    records = clip_records()
    random.Random(1).shuffle(records)
    schema = T.StructType([*RECORD.fields, T.StructField("arrived", T.TimestampType())])
    want = phases.phase_timeline(motion.frame_motion(motion.pivot_records(spark.createDataFrame(records, RECORD)))).collect()
    folder = tmp_path / "in"
    folder.mkdir()

    def send(name, rows, second):
        stamp = [x | {"arrived": f"2024-01-01T00:{(second + i % 5) // 60:02d}:{(second + i % 5) % 60:02d}Z"} for i, x in enumerate(rows)]
        (folder / name).write_text("\n".join(json.dumps(x).replace("NaN", "null") for x in stamp) + "\n")

    cut = len(records) // 3
    for k in range(3):
        send(f"{k}.json", records[k * cut : (k + 1) * cut if k < 2 else None], 5 * k)
    # what comes much later moves the watermark, and so closes the clips
    send("8.json", [record(0, body(0, 0.5), path="clips/later.mp4")], 300)
    send("9.json", [record(0, body(0, 0.5), path="clips/last.mp4")], 600)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        q = clips.arriving_phases(motion.pivot_records(stream, "arrived"), "arrived", "20 seconds", 10_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.video_id not in ("later", "last")]
    same_timeline(got, want)
