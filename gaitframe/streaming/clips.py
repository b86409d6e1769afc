"""Phases of clips that arrive frame by frame, in any order.

A clip's frames are state under its id. Each frame that arrives sets the clip's timer
anew; when nothing has come for ``gap`` of event time (the watermark has passed the
clip's last arrival by that), the clip is closed, its frames are ordered and labelled by
the rules of ``phases``, and its state is removed. A frame that comes after that starts
the clip anew, so ``gap`` and the watermark's delay say how late frames may be.

State is a clip's frames (seven numbers each); clips are short. The rules are those of
``phases.key_frames``, as one clip is a small table then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaitframe.functions.numbers import row_mean
from gaitframe.operators.phases import LEAST_USABLE
from gaitframe.schema import PHASES, UNAVAILABLE

TIMELINE = "video_id string, frame_index int, timestamp_ms long, phase string, phase_confidence double, phase_reason string, hand_y double, hand_height_proxy double, wrist_speed_y double, is_contact_proxy boolean"
HELD = "frame_index array<int>, timestamp_ms array<long>, hand_y array<double>, height array<double>, usable array<boolean>"


def _share(n: int, x: float) -> int:
    return int(np.round(n * x))  # ties to even


def _first_max(values: np.ndarray, where: np.ndarray) -> int:
    """Place of the largest value among some, the first on ties; nulls are smallest. -1 without any."""
    at = np.flatnonzero(where)
    return int(at[np.argmax(np.where(np.isnan(values[at]), -np.inf, values[at]))]) if len(at) else -1


def clip_phases(f: pd.DataFrame) -> pd.DataFrame:
    """The phase timeline of one clip's frames (frame_index, timestamp_ms, hand_y, height, usable)."""
    f = f.sort_values(["frame_index", "timestamp_ms"], kind="stable").reset_index(drop=True)
    y, height, use = f["hand_y"].to_numpy(float), f["height"].to_numpy(float), f["usable"].to_numpy(bool)
    step, ms = np.diff(f["frame_index"].to_numpy(float)), np.diff(f["timestamp_ms"].to_numpy(float)) / 1000.0
    dt = np.where(ms > 0, ms, np.where(step > 0, step, 1.0) / 24.0)
    speed = np.r_[0.0, np.nan_to_num(np.diff(y) / dt, nan=0.0)] if len(f) else np.zeros(0)
    n, rank = int(use.sum()), np.where(use, np.cumsum(use) - 1, -1)
    named = {p[0]: p for p in (*PHASES, UNAVAILABLE)}
    label, contact = ["unavailable"] * len(f), None
    if n >= LEAST_USABLE:
        apex = _first_max(height, use & (rank < max(2, _share(n, 0.60))))
        start = min(apex + 1, n - 1)
        contact = _first_max(speed, use & (rank >= start) & (rank < max(start + 1, _share(n, 0.85))))
        contact = contact if contact >= 0 else None
        radius, stance = max(1, _share(n, 0.04)), max(1, min(_share(n, 0.18), apex - 1))
        recovery = max(contact + radius + 1, _share(n, 0.85)) if contact is not None else _share(n, 0.85)
        for i in np.flatnonzero(use):
            r = rank[i]
            if r < stance:
                label[i] = "stance"
            elif r <= apex:
                label[i] = "backlift"
            elif contact is not None and abs(r - contact) <= radius:
                label[i] = "contact_zone"
            elif contact is not None and r < contact:
                label[i] = "downswing"
            else:
                label[i] = "recovery" if r >= recovery else "follow_through"
    return pd.DataFrame({
        "frame_index": f["frame_index"], "timestamp_ms": f["timestamp_ms"], "phase": label, "phase_confidence": [named[x][1] for x in label], "phase_reason": [named[x][2] for x in label],
        "hand_y": y, "hand_height_proxy": height, "wrist_speed_y": speed, "is_contact_proxy": (rank == contact) & use if contact is not None else np.zeros(len(f), bool),
    })


def arriving_phases(frames: DataFrame, arrived: str = "arrived", delay: str = "10 seconds", gap_ms: int = 10_000) -> DataFrame:
    """The phase timeline of each clip once it is closed; frames are pivoted and have a column of arrival times.

    ``frames`` may be a stream or a table (then every clip is closed at its end).
    """
    c = F.col
    height = row_mean(c("y_left_shoulder"), c("y_right_shoulder")) - row_mean(c("y_left_wrist"), c("y_right_wrist"))
    four = c("y_left_wrist").isNotNull() & c("y_right_wrist").isNotNull() & c("y_left_shoulder").isNotNull() & c("y_right_shoulder").isNotNull()
    slim = frames.withWatermark(arrived, delay).select("video_id", "frame_index", "timestamp_ms", row_mean(c("y_left_wrist"), c("y_right_wrist")).alias("hand_y"), height.alias("height"), four.alias("usable"), arrived)
    cols = [x.split()[0] for x in HELD.split(", ")]

    def close(key, state: GroupState) -> pd.DataFrame:
        held = pd.DataFrame(dict(zip(cols, map(list, state.get), strict=True)))
        out = clip_phases(held)
        out.insert(0, "video_id", key[0])
        return out

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            out = close(key, state)
            state.remove()
            yield out
            return
        held = list(map(list, state.get)) if state.exists else [[] for _ in cols]
        latest = 0
        for b in batches:
            for k, name in enumerate(cols):
                kind = {"frame_index": int, "timestamp_ms": int, "usable": bool}.get(name, float)
                held[k] += [None if pd.isna(x) else kind(x) for x in b[name]]
            latest = max(latest, int(b[arrived].max().timestamp() * 1000))
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + gap_ms)
        yield from ()

    if frames.isStreaming:
        return slim.groupBy("video_id").applyInPandasWithState(update, TIMELINE, HELD, "append", GroupStateTimeout.EventTimeTimeout)

    def whole(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = clip_phases(f)
        out.insert(0, "video_id", key[0])
        return out

    return slim.groupBy("video_id").applyInPandas(whole, TIMELINE)
