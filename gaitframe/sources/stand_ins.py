"""The driver's tables in the shape of pose records, audits and archives.

Vectors become frames: ten rows a clip, 64 numbers as 32 landmarks (x, y). ``sparse``
turns what is below -0.2 to null, so that landmarks are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.schema import RECORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pose_records(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    clean = F.transform("embedding", lambda v: F.when(v.cast("double") >= (-0.2 if sparse else float("-inf")), v.cast("double")))
    e = e.select("vec_id", clean.alias("e"))

    def landmark(i):
        x, y = F.get("e", 2 * i), F.get("e", 2 * i + 1)
        return F.struct(i.alias("landmark_index"), x.alias("x"), y.alias("y"), F.lit(None).cast("double").alias("z"), F.abs(x).alias("visibility"), F.abs(y).alias("presence"))

    poses = F.array(F.transform(F.sequence(F.lit(0), F.lit(31)), landmark)).cast(RECORD["pose_landmarks"].dataType)
    return e.select(
        F.concat(F.lit("clips/clip_"), F.expr("vec_id div 10").cast("string"), F.lit(".mp4")).alias("video_path"), (F.col("vec_id") % 10).cast("int").alias("frame_index"), (42 * (F.col("vec_id") % 10)).cast("long").alias("timestamp_ms"),
        F.lit(1).alias("pose_count"), poses.alias("pose_landmarks"), F.array().cast(RECORD["pose_world_landmarks"].dataType).alias("pose_world_landmarks"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a clip; its type is the label of its first frame."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0")
    shot = F.concat(F.lit("clip_"), F.expr("vec_id div 10").cast("string"))
    return e.select(shot.alias("shot_id"), F.concat(F.lit("type_"), F.col("label").cast("string")).alias("shot_type"), F.concat(shot, F.lit(".movement_features.csv")).alias("movement_features_csv"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames at irregular times: x from the value, y from the JSON property."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "events")
    ms = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000)
    k = F.from_json("props", "k int")["k"]
    rows = t.select("event_id", F.col("user_id").cast("string").alias("video_id"), ms.cast("long").alias("timestamp_ms"), (F.col("value") / 500).alias("x"), (k / 100).alias("y"), "ts")
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "event_id")) - 1
    return rows.withColumn("frame_index", nth.cast("int")).drop("ts")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as processed clips: toxic ones failed."""
    d, bad = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("model failed").alias("error"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".mp4")))
    n = F.col("n_chars")
    rows = d.select("doc_id", path.alias("relative_path"), n.cast("int").alias("frames_seen"), (n % 97).cast("int").alias("frames_processed"), F.least(n % 41, n % 97).cast("int").alias("frames_with_pose"))
    return rows.join(bad, "doc_id", "left")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive members in the order of doc_id."""
    i = F.col("doc_id")

    def pick(values: str, by):
        v = values.split(" ")
        return F.element_at(F.array(*map(F.lit, v)), (by % len(v) + 1).cast("int"))

    member = F.concat(
        F.when(i % 13 == 0, "__MACOSX/").otherwise(""), F.lit("archive/"), pick("train val Validation test other", i), F.lit("/"), pick("cover pull Sweep extra straight hook lofted", i * 7 + F.expr("doc_id div 5")),
        F.lit("/"), F.when(i % 11 == 0, "._").otherwise(""), F.lit("clip_"), i.cast("string"), pick(".mp4 .avi .txt .MOV", i),
    )
    return table(spark, sf_dir, "documents").select(i.cast("long").alias("ordinal"), member.alias("member"))
