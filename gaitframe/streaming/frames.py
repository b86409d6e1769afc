"""Frame quality and landmarks of pose records as they arrive.

Both are stateless, so any trigger and restart from the checkpoint gives each record
once. Phases need the whole clip and stay batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gaitframe.operators.landmarks import landmarks
from gaitframe.operators.quality import frame_quality
from gaitframe.schema import RECORD


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def write_quality(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return frame_quality(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def write_landmark_rows(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return landmarks(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
