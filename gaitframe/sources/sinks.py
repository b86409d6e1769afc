"""Writers: Parquet by clip, CSV, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.operators.report import BASELINE_LIMITATION, LIMITATION
from gaitframe.schema import BASELINE_VERSION, COMPARISON_VERSION, METRIC_NAMES


def write_landmarks(landmarks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Landmarks as Parquet, a folder for each of a bounded number of clip buckets."""
    n = buckets or int(landmarks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    landmarks.withColumn("clip_bucket", F.pmod(F.hash("video_id"), F.lit(n))).write.partitionBy("clip_bucket").parquet(path)


def write_landmark_table(landmarks: DataFrame, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Landmarks as a catalog table, bucketed by clip and sorted by frame, and the table.

    The planner knows its layout: pivots and windows by clip over it need no exchange. Each
    bucket is one file, written by the task that holds its clips.
    """
    n = buckets or int(landmarks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("video_id", "frame_index", "timestamp_ms")
    out = landmarks.repartition(n, "video_id").sortWithinPartitions(*keys).write.bucketBy(n, "video_id").sortBy(*keys)
    (out.option("path", path) if path else out).saveAsTable(name)
    return landmarks.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def baseline_types(distributions: DataFrame, counts: DataFrame) -> DataFrame:
    per = distributions.groupBy("shot_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("count", "mean", "std", "min", "max"))))).alias("features"))
    none = F.create_map().cast("map<string,struct<count:bigint,mean:double,std:double,min:double,max:double>>")
    return counts.join(per, "shot_type", "left").withColumn("features", F.coalesce("features", none))


def baseline_document(distributions: DataFrame, counts: DataFrame) -> DataFrame:
    """One JSON object a shot type: its counts, shot ids and metric distributions by name."""
    return baseline_types(distributions, counts).select("shot_type", _json(F.struct("manifest_shots", "usable_shots", "features", "shot_ids")).alias("document"))


def profile_document(shots: DataFrame, distributions: DataFrame, counts: DataFrame, manifest_path: str | None = None) -> DataFrame:
    """The whole baseline as one JSON object: version, totals, shot types, a summary of every shot, the limitation.

    It is one row, a few hundred bytes a shot (Spark holds 2 GB in one); ``baseline_document``
    gives a row a type, and ``baseline.moments`` what grows by types only. shots may have
    movement_features_csv.
    """
    types = baseline_types(distributions, counts).select(F.struct("shot_type", F.struct("manifest_shots", "usable_shots", "features", "shot_ids")).alias("t"))
    by_name = lambda name: lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).when(a[name].isNull(), 1).when(b[name].isNull(), -1).otherwise(0)
    types = types.where("t.shot_type IS NOT NULL").agg(F.map_from_entries(F.array_sort(F.collect_list("t"), by_name("shot_type"))).alias("shot_types"))
    own = [c for c in ("movement_features_csv",) if c in shots.columns]
    metrics = F.when(F.col("usable_frames") > 0, F.create_map(*[x for m in METRIC_NAMES for x in (F.lit(m), F.col(m))])).otherwise(F.create_map().cast("map<string,double>"))
    one = F.struct("shot_id", "shot_type", *own, "rows", "usable_frames", "is_usable", metrics.alias("metrics"))
    each = shots.agg(F.count(F.lit(1)).alias("total_manifest_rows"), F.count_if("is_usable").alias("usable_shots"), F.collect_list(one).alias("_all"))
    summaries = F.array_sort("_all", by_name("shot_id"))
    body = F.struct(
        F.lit(BASELINE_VERSION).alias("baseline_version"), "total_manifest_rows", "usable_shots", "shot_types", summaries.alias("shot_summaries"),
        F.lit(BASELINE_LIMITATION).alias("limitation"), F.lit(manifest_path).alias("source_manifest_path"),
    )
    return each.join(F.broadcast(types)).select(_json(body).alias("document"))  # one row each


def comparison_document(status: DataFrame, metrics: DataFrame, summary_path: str, baseline_path: str) -> DataFrame:
    """One JSON object a shot: its status and note, its metrics by name, the sources' paths, the limitation.

    A shot without a baseline of its type has no metrics.
    """
    fields = [c for c in metrics.columns if c not in ("shot_id", "shot_type")]
    per = metrics.groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_metrics"))  # seven a shot
    none = F.filter("_metrics", lambda x: F.lit(False))
    kept = F.when(F.col("comparison_status") == "missing_shot_type_baseline", none).otherwise(F.col("_metrics"))
    paths = F.struct(F.lit(summary_path).alias("movement_summary_path"), F.lit(baseline_path).alias("baseline_profile_path"))
    body = F.struct(
        F.lit(COMPARISON_VERSION).alias("comparison_version"), F.lit(BASELINE_VERSION).alias("baseline_version"), "shot_id", "shot_type", "comparison_status", F.array("note").alias("notes"),
        (F.col("rows") if "rows" in status.columns else F.lit(None).cast("long")).alias("movement_rows"), F.col("usable_frames").alias("usable_motion_frames"), "comparable_metrics",
        F.coalesce(kept, F.array()).alias("metric_comparisons"), paths.alias("source_paths"), F.lit(LIMITATION).alias("limitation"),
    )
    return status.join(per, "shot_id", "left").select("shot_id", _json(body).alias("document"))


def classifier_document(evaluation: DataFrame, shots: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object: the evaluation, shots by class, the metrics used, the limitation."""
    sizes = shots.groupBy(F.col("shot_type").cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", "n")))).alias("class_counts"))  # a row a class
    body = F.struct(
        "evaluation_status", F.lit("leave_one_out_nearest_neighbor_on_movement_proxies").alias("evaluation_method"), "samples", F.map_keys("class_counts").alias("classes"), "class_counts",
        F.array(*map(F.lit, columns)).cast("array<string>").alias("feature_columns"), "accuracy", F.lit(LIMITATION).alias("limitation"),
    )
    return evaluation.join(F.broadcast(sizes)).select(_json(body).alias("document"))  # one row each


def demo_summary(best: DataFrame, manifest: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One row: the selected clip (a row of the audit), the artifacts' paths, clips of the baseline, the limitation."""
    clips = manifest.agg(F.count(F.lit(1)).alias("baseline_video_count"))
    picked = best.select(
        F.col("video_id").alias("selected_video_id"), F.col("shot_type").alias("selected_shot_type"), F.col("video_path").alias("selected_video_path"),
        F.col("output_jsonl_path").alias("selected_pose_jsonl_path"), F.bround("pose_detection_rate", 4).alias("selected_pose_detection_rate"),
    ).limit(1)
    return picked.join(F.broadcast(clips)).select("*", *[F.lit(p).alias(f"{k}_path") for k, p in paths.items()], F.lit(LIMITATION).alias("limitation"))  # one row
