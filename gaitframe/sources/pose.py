"""Readers: pose records, tables with stated schemas, listings of clips."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.functions import names
from gaitframe.functions.numbers import clean
from gaitframe.sources import archives
from gaitframe.schema import AUDIT, FEATURES, MANIFEST, RECORD, SHOT_CLASSES, SPLIT_CLIPS

#: What a user of the archive should know.
RISKS = (
    "The clips were gathered to tell shots apart and not to measure bodies.",
    "Views, covered limbs, blur and small figures make poses fail.",
    "Look into the archive itself; previews of it may fail.",
    "What is computed from poses is no coaching advice.",
)


def read_pose_records(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Frame records from JSON lines. Blank lines are skipped.

    A malformed line is an error, which ``naming_lines`` places; with ``lenient`` it is a row
    whose ``_corrupt_record`` holds the line and whose other columns are null.
    """
    if lenient:
        return spark.read.schema(T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of the first malformed line of each split of the files.

    A split's lines are numbered as it is read; what stands before it in its file is the sum
    of the lines of the splits before it, a row a split.
    """
    parsed = F.from_json("value", T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"})
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    bad = (F.length(F.trim("value")) > 0) & parsed["_corrupt_record"].isNotNull()
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min(F.when(bad, F.struct("at", "value"))).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return splits.withColumn("before", before).where("bad IS NOT NULL").select("file", (F.col("before") + F.col("bad.at") - F.col("first") + 1).alias("line"), F.col("bad.value").alias("text"))


@contextmanager
def naming_lines(spark: SparkSession, path: str) -> Iterator[None]:
    """Around an action on strict records of ``path``: a malformed line becomes a ValueError with its file and line.

    Lines are only counted once an action has failed.
    """
    try:
        yield
    except Exception as failed:  # Spark's errors reach Python as several classes
        if "MALFORMED_RECORD_IN_PARSING" not in str(failed):
            raise
        found = malformed_lines(spark, path).orderBy("file", "line").first()
        if found is None:
            raise
        raise ValueError(f"malformed record on line {found['line']} of {found['file']}") from failed


def last_by_frame(records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One record a clip and frame: the last by ``ordinal``."""
    cols = [c for c in records.columns if c not in (ordinal, "video_path", "frame_index")]
    rows = records.groupBy("video_path", "frame_index").agg(F.max_by(F.struct(*cols), ordinal).alias("r"))
    return rows.select("video_path", "frame_index", "r.*")


def _by_name(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV columns by the names in the header, null where one is absent or a value does not parse.

    Files that are read together share the first one's header; another header is an error.
    """
    header = spark.read.csv(path, header=True).schema  # the header only
    raw = spark.read.schema(header).option("enforceSchema", False).csv(path, header=True)
    return raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in header.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Movement features from CSV; NaN counts as null."""
    df = _by_name(spark, path, FEATURES)
    return df.select(*[clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in FEATURES.fields])


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return _by_name(spark, path, AUDIT)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """shot_id, shot_type and feature path as strings. ValueError lists missing columns."""
    found = set(spark.read.csv(path, header=True).columns)  # the header only
    missing = sorted({f.name for f in MANIFEST.fields} - found)
    if missing:
        raise ValueError(f"manifest lacks columns: {missing}")
    return spark.read.csv(path, header=True).select(*[F.col(f.name).cast("string") for f in MANIFEST.fields])


def manifest_features(spark: SparkSession, manifest: DataFrame, base: str, tasks: int | None = None, errors: str = "raise") -> DataFrame:
    """Features of every file that the manifest names, with their shot_id: tasks open the files of their manifest rows.

    Paths that start with ``/`` or a scheme are absolute. Columns go by the file's own header:
    null where one is absent or a value does not parse. A file that can't be read is an error
    that names its shot; with ``errors="rows"`` it is a row whose ``error`` says so. No list of
    files is made on the driver. Files are opened by their file system, so it must be one that
    a task can reach (local, or one that Arrow knows).
    """
    if errors not in ("raise", "rows"):
        raise ValueError(f"errors are raised or rows, not {errors}")
    path = F.col("movement_features_csv")
    file = F.when(path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    named = manifest.select("shot_id", "shot_type", file.alias("file")).repartition(tasks or 4 * spark.sparkContext.defaultParallelism)
    fields = [f for f in FEATURES.fields if f.name != "video_id"]

    def rows(batches):
        import csv

        import pyarrow as pa
        from pyarrow import fs

        wanted = [f.name for f in fields]
        schema = pa.schema([(n, pa.string()) for n in (*wanted, "shot_id", "shot_type", "error")])

        def batch(found, shot, kind, error=None):
            one = found or ([[None] * len(wanted)] if error else [])
            cols = list(zip(*one, strict=True)) or [()] * len(wanted)
            more = [[x] * len(one) for x in (shot, kind, error)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (*cols, *more)], schema=schema)

        def open_text(uri):
            import io

            if not uri.startswith("/") and not uri.startswith("file:"):
                system, name = fs.FileSystem.from_uri(uri)
                return io.TextIOWrapper(system.open_input_file(name), "utf-8", newline="")
            return open(uri if uri.startswith("/") else "/" + uri.removeprefix("file:").lstrip("/"), encoding="utf-8", newline="")

        for b in batches:
            for shot, kind, uri in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if uri is None:
                        raise OSError("no path")
                    with open_text(uri) as f:
                        read = csv.reader(f)
                        header = next(read, [])
                        place = [header.index(n) if n in header else -1 for n in wanted]
                        found = []
                        for r in read:
                            found.append([r[i] if 0 <= i < len(r) and r[i] != "" else None for i in place] if r else [None] * len(wanted))
                            if len(found) == 5000:
                                yield batch(found, shot, kind)
                                found = []
                        yield batch(found, shot, kind)
                except (OSError, UnicodeDecodeError, csv.Error, pa.ArrowInvalid) as failed:
                    if errors == "raise":
                        raise ValueError(f"features of shot {shot} can't be read: {failed}") from failed
                    yield batch([], shot, kind, f"features of shot {shot} can't be read: {failed}")

    raw = named.mapInArrow(rows, ", ".join(f"{f.name} string" for f in fields) + ", shot_id string, shot_type string, error string")
    cast = [F.col(f.name).try_cast(f.dataType) for f in fields]
    typed = [(clean(c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name) for c, f in zip(cast, fields, strict=True)]
    return raw.select(*typed, "shot_id", "shot_type", *(["error"] if errors == "rows" else []))


def list_videos(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Paths of the clips under a folder, the first ``limit`` by path if asked; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    files = files.where(names.is_video(F.col("path")))
    return files if limit is None else files.orderBy("path").limit(limit)


def list_archive(spark: SparkSession, path: str, whole: int = 1 << 30, piece: int = 64 << 20) -> DataFrame:
    """Members (ordinal, member, size) of a tar archive in their order.

    Several archives (a glob) are read side by side. Spark hands archives of at most
    ``whole`` bytes to a task each. Longer ones are beyond one binary value: plain ones are
    read in pieces of ``piece`` bytes by many tasks (``archives.list_ranges``); a compressed
    one is one stream, so one task's work, in bounded memory.
    """

    def members(open_one):
        def rows(batches):
            import pyarrow as pa

            kinds = (pa.int64(), pa.string(), pa.int64())
            for b in batches:
                for value in b.column(0):
                    with open_one(value.as_py()) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                        found = []
                        for i, m in enumerate(tar):
                            tar.members = []  # a stream needs none of them again
                            if m.isfile():
                                found.append((i, m.name, m.size))
                            if len(found) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["ordinal", "member", "size"])
                                found = []
                    cols = list(zip(*found, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["ordinal", "member", "size"])

        return rows

    def held(content):
        import io

        return io.BytesIO(content)

    def told(batches):
        import pyarrow as pa

        for b in batches:
            plain = []
            for uri in b.column(0).to_pylist():
                with archives.opened(uri) as raw:
                    plain.append(archives.is_plain(raw))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plain, pa.bool_())], ["path", "length", "plain"])

    files, schema = spark.read.format("binaryFile").load(path), "ordinal long, member string, size long"
    short = files.where(F.col("length") <= whole).select("content").mapInArrow(members(held), schema)
    long = files.where(F.col("length") > whole).select("path", "length").mapInArrow(told, "path string, length long, plain boolean")
    packed = long.where("NOT plain").select("path").mapInArrow(members(archives.opened), schema)
    return short.unionByName(packed).unionByName(archives.list_ranges(long.where("plain").select("path", "length"), piece))


def dataset_info(spark: SparkSession, archive: str, licence: str, repository: str | None = None, repository_type: str = "dataset") -> DataFrame:
    """One row: what is known of the clip archive, and of the repository that holds it, before it is read."""
    row = (repository, repository_type, archive, licence, "video-classification", list(SHOT_CLASSES), *SPLIT_CLIPS.values(), list(RISKS))
    return spark.createDataFrame([row], "repo_id string, repo_type string, archive_filename string, license string, task string, expected_classes array<string>, expected_train_samples int, expected_validation_samples int, expected_test_samples int, known_risks array<string>")
