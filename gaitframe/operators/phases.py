"""Phases of a clip by rules over its usable frames, in windows of one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.functions.numbers import half_even
from gaitframe.operators.motion import by_frame, whole_clip
from gaitframe.schema import PHASES, UNAVAILABLE

LEAST_USABLE = 6


def key_frames(motion: DataFrame) -> DataFrame:
    """Add pos, rank, n, and the apex and contact positions of each clip.

    An apex or contact is the place of the largest value among all the clip's frames,
    the first on ties, but is then compared with ranks among usable frames, as the rules
    have it. Both are null with too few usable frames.
    """
    use = F.col("usable_for_phase")
    m = motion.withColumns({
        "pos": F.row_number().over(by_frame()) - 1,
        "rank": F.when(use, F.count_if(use).over(by_frame()) - 1),
        "n": F.count_if(use).over(whole_clip()),
    })
    ready = use & (F.col("n") >= LEAST_USABLE)

    def place(value: str, inside):
        best = F.max(F.when(ready & inside, F.struct(F.col(value).alias("v"), (-F.col("rank")).alias("r"), "pos"))).over(whole_clip())
        return best["pos"].cast("long")

    share = lambda x: half_even(F.col("n") * F.lit(x)).cast("long")
    m = m.withColumn("apex", place("hand_height_proxy", F.col("rank") < F.greatest(F.lit(2), share(0.60))))
    start = F.least(F.col("apex") + 1, F.col("n") - 1)
    return m.withColumn("contact", place("wrist_speed_y", (F.col("rank") >= start) & (F.col("rank") < F.greatest(start + 1, share(0.85)))))


def with_phases(motion: DataFrame) -> DataFrame:
    """Add phase, confidence, reason and the contact mark to every frame.

    Without six usable frames a clip is ``unavailable``. A clip whose contact lies beyond
    its usable frames has no contact row.
    """
    m = key_frames(motion)
    rank, apex, contact, n = (F.col(c) for c in ("rank", "apex", "contact", "n"))
    share = lambda x: half_even(n * F.lit(x)).cast("long")
    radius = F.greatest(F.lit(1), share(0.04))
    recovery = F.greatest(contact + radius + 1, share(0.85))
    stance = F.greatest(F.lit(1), F.least(share(0.18), apex - 1))
    told = {p[0]: F.struct(F.lit(p[0]).alias("phase"), F.lit(p[1]).alias("confidence"), F.lit(p[2]).alias("reason")) for p in (*PHASES, UNAVAILABLE)}
    label = (
        F.when(rank.isNull() | (n < LEAST_USABLE), told["unavailable"])
        .when(rank < stance, told["stance"])
        .when(rank <= apex, told["backlift"])
        .when(F.abs(rank - contact) <= radius, told["contact_zone"])
        .when(rank < contact, told["downswing"])
        .when(rank >= recovery, told["recovery"])
        .otherwise(told["follow_through"])
    )
    m = m.withColumns({"_l": label, "is_contact_proxy": F.coalesce(rank == contact, F.lit(False))})
    m = m.withColumns({"phase": F.col("_l.phase"), "phase_confidence": F.col("_l.confidence"), "phase_reason": F.col("_l.reason")})
    return m.drop("_l", "pos", "rank", "n", "apex", "contact")


def phase_timeline(motion: DataFrame) -> DataFrame:
    """The ten columns of the phase timeline."""
    cols = ("video_id", "frame_index", "timestamp_ms", "phase", "phase_confidence", "phase_reason", "hand_y", "hand_height_proxy", "wrist_speed_y", "is_contact_proxy")
    return with_phases(motion).select(*cols)


def phase_summary(timeline: DataFrame, *by: str) -> DataFrame:
    """Frames, usable frames, contacts, and the phases that occur, in their fixed order."""
    order = F.array(*[F.lit(p[0]) for p in PHASES])
    return timeline.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("phase") != "unavailable").alias("usable_frames"),
        F.count_if("is_contact_proxy").alias("contacts"),
        F.array_join(F.array_intersect(order, F.collect_set("phase")), ",").alias("phases"),
    )


def phase_counts(timeline: DataFrame, *by: str) -> DataFrame:
    return timeline.groupBy(*by, "phase").agg(F.count(F.lit(1)).alias("frames"))
