"""SQL for DuckDB that gives each query's rows, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from gaitframe.operators.compare import INTERPRETATIONS, NOT_LISTED, NOTES
from gaitframe.operators.report import BASELINE_LIMITATION, LIMITATION
from gaitframe.schema import BASELINE_VERSION, COMPARISON_VERSION, LANDMARK_NAMES, METRICS, PHASES, SHOT_CLASSES, SKELETON, TRACKED, UNAVAILABLE


def _mean(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({a} + {b}) / 2 ELSE coalesce({a}, {b}) END"


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in columns.split())


def _angle(a: str, b: str, c: str) -> str:
    ux, uy, vx, vy = f"(x_{a} - x_{b})", f"(y_{a} - y_{b})", f"(x_{c} - x_{b})", f"(y_{c} - y_{b})"
    n = f"(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}))"
    return f"CASE WHEN {n} > 0 THEN degrees(acos(greatest(-1e0, least(1e0, ({ux} * {vx} + {uy} * {vy}) / {n})))) END"


def _line(a: str, b: str) -> str:
    return f"CASE WHEN x_{b} <> x_{a} OR y_{b} <> y_{a} THEN degrees(atan2(y_{b} - y_{a}, x_{b} - x_{a})) END"


def _raw(sparse: bool) -> str:
    v = "CASE WHEN v::DOUBLE >= -0.2::DOUBLE THEN v::DOUBLE END" if sparse else "v::DOUBLE"
    return f"raw AS (SELECT 'clip_' || (vec_id // 10) AS video_id, (vec_id % 10)::INTEGER AS frame_index, (42 * (vec_id % 10))::BIGINT AS timestamp_ms, list_transform(embedding, lambda v: {v}) AS e FROM embeddings)"


def _frames(sparse: bool) -> str:
    at = {name: LANDMARK_NAMES.index(name) for name in TRACKED}
    cells = ", ".join(f"e[{2 * at[n] + 1}] AS x_{n}, e[{2 * at[n] + 2}] AS y_{n}" for n in TRACKED)
    w = "(PARTITION BY video_id ORDER BY frame_index)"
    return f"""WITH {_raw(sparse)},
    fr AS (SELECT video_id, frame_index, timestamp_ms, {cells} FROM raw WHERE len(list_filter(e, lambda v: v IS NOT NULL)) > 0),
    sig AS (SELECT *, {_mean("x_left_wrist", "x_right_wrist")} AS wx, {_mean("y_left_wrist", "y_right_wrist")} AS wy, {_mean("y_left_shoulder", "y_right_shoulder")} AS sy,
            (timestamp_ms - lag(timestamp_ms) OVER {w}) / 1e3 AS dms, frame_index - lag(frame_index) OVER {w} AS df FROM fr),
    mot AS (SELECT *, sy - wy AS hh, CASE WHEN dms > 0 THEN dms WHEN df > 0 THEN df / 24e0 ELSE 1 / 24e0 END AS dt FROM sig),
    spd AS (SELECT *, coalesce((wy - lag(wy) OVER {w}) / dt, 0e0) AS wsy,
            coalesce(sqrt(pow((wx - lag(wx) OVER {w}) / dt, 2) + pow((wy - lag(wy) OVER {w}) / dt, 2)), 0e0) AS speed FROM mot),
    acc AS (SELECT *, coalesce(abs(speed - lag(speed) OVER {w}) / dt, 0e0) AS accel FROM spd)"""


def _timeline(sparse: bool) -> str:
    case = lambda k: (
        f"CASE WHEN rk IS NULL OR n < 6 THEN {told[6][k]} WHEN rk < greatest(1, least(round_even(n * 0.18::DOUBLE, 0), apex - 1)) THEN {told[0][k]} WHEN rk <= apex THEN {told[1][k]} "
        f"WHEN abs(rk - contact) <= radius THEN {told[3][k]} WHEN rk < contact THEN {told[2][k]} WHEN rk >= greatest(contact + radius + 1, round_even(n * 0.85::DOUBLE, 0)) THEN {told[5][k]} ELSE {told[4][k]} END"
    )
    told = [(f"'{p[0]}'", f"{p[1]}::DOUBLE", f"'{p[2]}'") for p in (*PHASES, UNAVAILABLE)]
    return f"""{_frames(sparse)},
    p0 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS pos, y_left_wrist IS NOT NULL AND y_right_wrist IS NOT NULL AND y_left_shoulder IS NOT NULL AND y_right_shoulder IS NOT NULL AS usable FROM acc),
    p1 AS (SELECT *, CASE WHEN usable THEN (sum(usable::INT) OVER (PARTITION BY video_id ORDER BY frame_index))::BIGINT - 1 END AS rk, (sum(usable::INT) OVER (PARTITION BY video_id))::DOUBLE AS n FROM p0),
    ap AS (SELECT video_id, pos AS apex FROM p1 WHERE n >= 6 AND rk < greatest(2, round_even(n * 0.6::DOUBLE, 0)) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY hh DESC, rk) = 1),
    co AS (SELECT video_id, pos AS contact FROM p1 JOIN ap USING (video_id) WHERE rk >= least(apex + 1, n - 1) AND rk < greatest(least(apex + 1, n - 1) + 1, round_even(n * 0.85::DOUBLE, 0))
           QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY wsy DESC, rk) = 1),
    k AS (SELECT p1.*, apex, contact, greatest(1, round_even(n * 0.04::DOUBLE, 0)) AS radius FROM p1 LEFT JOIN ap USING (video_id) LEFT JOIN co USING (video_id)),
    tl AS (SELECT *, {case(0)} AS phase, {case(1)} AS phase_confidence, {case(2)} AS phase_reason, coalesce(rk = contact, false) AS is_contact_proxy FROM k)"""


def _features(sparse: bool = True) -> str:
    return f"""{_timeline(sparse)},
    ang AS (SELECT *, {_angle("left_hip", "left_knee", "left_ankle")} AS left_knee_angle_deg, {_angle("right_hip", "right_knee", "right_ankle")} AS right_knee_angle_deg,
            {_line("left_shoulder", "right_shoulder")} - ({_line("left_hip", "right_hip")}) AS turn,
            first(CASE WHEN x_nose IS NOT NULL AND y_nose IS NOT NULL THEN {{'x': x_nose, 'y': y_nose}} END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS start FROM tl),
    ft AS (SELECT video_id, frame_index, timestamp_ms, phase, x_nose IS NOT NULL AND y_nose IS NOT NULL AND wx IS NOT NULL AND wy IS NOT NULL AND hh IS NOT NULL AS usable_for_motion, x_nose AS head_x, y_nose AS head_y,
           sqrt(pow(x_nose - start.x, 2) + pow(y_nose - start.y, 2)) AS head_displacement_proxy, left_knee_angle_deg, right_knee_angle_deg, least(left_knee_angle_deg, right_knee_angle_deg) AS front_knee_bend_proxy_deg,
           abs((turn + 180) - 360 * floor((turn + 180) / 360) - 180) AS shoulder_hip_separation_proxy_deg, wx AS wrist_center_x, wy AS wrist_center_y, speed AS wrist_speed_proxy, accel AS wrist_acceleration_proxy,
           1 / (1 + accel) AS wrist_path_smoothness_proxy, hh AS backlift_height_proxy, CASE WHEN phase = 'follow_through' THEN hh END AS follow_through_height_proxy FROM ang)"""


def _shots() -> str:
    how = {"mean": "avg", "max": "max", "min": "min"}
    metrics = ", ".join(f"{how[h]}({c}) FILTER (WHERE usable_for_motion) AS {m}" for m, c, h in METRICS)
    names = ", ".join(m[0] for m in METRICS)
    return f"""{_features()},
    man AS (SELECT 'clip_' || (vec_id // 10) AS shot_id, 'type_' || label AS shot_type FROM embeddings WHERE vec_id % 10 = 0),
    per AS (SELECT video_id, count(*) AS rows, count(*) FILTER (WHERE usable_for_motion) AS usable_frames, {metrics} FROM ft GROUP BY video_id),
    shots AS (SELECT shot_id, shot_type, coalesce(rows, 0) AS rows, coalesce(usable_frames, 0) AS usable_frames, coalesce({names}) IS NOT NULL AS is_usable, {names} FROM man LEFT JOIN per ON shot_id = video_id),
    long AS (SELECT shot_id, shot_type, is_usable, metric, value FROM shots UNPIVOT INCLUDE NULLS (value FOR metric IN ({names}))),
    dist AS (SELECT shot_type, metric, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM long WHERE is_usable AND value IS NOT NULL GROUP BY shot_type, metric),
    cmp AS (SELECT shot_id, shot_type, metric, value AS shot_value, CASE WHEN value IS NOT NULL THEN mean END AS baseline_mean, CASE WHEN value IS NOT NULL THEN std END AS baseline_std,
            CASE WHEN value IS NULL THEN 0 ELSE coalesce(count, 0) END AS baseline_count, value - mean AS delta_from_mean, (value - mean) / nullif(std, 0) AS z_score,
            CASE WHEN value IS NULL THEN 'shot_metric_unavailable' WHEN mean IS NULL THEN 'baseline_metric_unavailable' WHEN std IS NULL OR std = 0 THEN 'baseline_variance_unavailable'
                 WHEN (value - mean) / std > 1 THEN 'above_baseline' WHEN (value - mean) / std < -1 THEN 'below_baseline' ELSE 'within_baseline' END AS status
            FROM long LEFT JOIN dist USING (shot_type, metric)),
    stat AS (SELECT s.shot_id, s.shot_type, s.usable_frames, c.n AS comparable_metrics,
             CASE WHEN s.usable_frames = 0 THEN 'insufficient_shot_pose_data' WHEN u.n = 0 THEN 'insufficient_baseline_data' WHEN c.n = 0 THEN 'insufficient_metric_overlap' ELSE 'comparison_available' END AS comparison_status
             FROM shots s JOIN (SELECT shot_type, count(*) FILTER (WHERE is_usable) AS n FROM shots GROUP BY shot_type) u USING (shot_type)
             JOIN (SELECT shot_id, count(*) FILTER (WHERE status LIKE '%n_baseline' OR status LIKE 'above%' OR status LIKE 'below%') AS n FROM cmp GROUP BY shot_id) c USING (shot_id))"""


def _scaled() -> str:
    names = [m[0] for m in METRICS]
    filled = ", ".join(f"coalesce({m}, avg({m}) OVER ()) AS {m}" for m in names)
    out = ", ".join(f"coalesce(({m} - avg({m}) OVER ()) / coalesce(nullif(stddev_pop({m}) OVER (), 0), 1), 0e0) AS {m}" for m in names)
    far = " + ".join(f"pow(a.{m} - b.{m}, 2)" for m in names)
    return f"""{_shots()},
    fil AS (SELECT shot_id, shot_type, {filled} FROM shots), sca AS (SELECT shot_id, shot_type, {out} FROM fil),
    nn AS (SELECT a.shot_id, a.shot_type AS true_shot_type, b.shot_type AS predicted_shot_type, b.shot_id AS nearest_neighbor_shot_id, sqrt({far}) AS distance
           FROM sca a JOIN sca b ON a.shot_id <> b.shot_id QUALIFY row_number() OVER (PARTITION BY a.shot_id ORDER BY sqrt({far}), b.shot_id) = 1)"""


AUDIT = """WITH c AS (SELECT coalesce(source, 'none') AS split, coalesce(lang, 'none') AS shot_type, doc_id, n_chars, toxic IS NOT NULL AS bad
                     FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) USING (doc_id)),
    n AS (SELECT *, split || '/' || shot_type || '/doc ' || doc_id || '.mp4' AS video_path, regexp_replace(split || '_' || shot_type || '_doc ' || doc_id, '[^A-Za-z0-9_-]+', '_', 'g') AS video_id,
          CASE WHEN bad THEN 0 ELSE n_chars END::INTEGER AS frames_seen, CASE WHEN bad THEN 0 ELSE n_chars % 97 END::INTEGER AS frames_processed, CASE WHEN bad THEN 0 ELSE least(n_chars % 41, n_chars % 97) END::INTEGER AS frames_with_pose FROM c),
    au AS (SELECT video_id, split, shot_type, video_path, video_id || '.pose.jsonl' AS output_jsonl_path, frames_seen, frames_processed, frames_with_pose,
           CASE WHEN frames_processed = 0 THEN 0e0 ELSE round_even(frames_with_pose / frames_processed::DOUBLE, 4) END AS pose_detection_rate,
           CASE WHEN bad THEN 'failed' WHEN frames_with_pose > 0 THEN 'pose_detected' ELSE 'no_pose_detected' END AS status, CASE WHEN bad THEN 'model failed' ELSE '' END AS error FROM n)"""

ARCHIVE = f"""WITH m AS (SELECT doc_id AS ordinal, CASE WHEN doc_id % 13 = 0 THEN '__MACOSX/' ELSE '' END || 'archive/' || ['train', 'val', 'Validation', 'test', 'other'][doc_id % 5 + 1] || '/'
        || ['cover', 'pull', 'Sweep', 'extra', 'straight', 'hook', 'lofted'][(doc_id * 7 + doc_id // 5) % 7 + 1] || '/' || CASE WHEN doc_id % 11 = 0 THEN '._' ELSE '' END || 'clip_' || doc_id || ['.mp4', '.avi', '.txt', '.MOV'][doc_id % 4 + 1] AS member FROM documents),
    v AS (SELECT *, string_split(lower(member), '/') AS p FROM m WHERE regexp_matches(member, '\\.(mp4|avi|mov|mkv|webm)$', 'i') AND member NOT LIKE '%/.\\_%' ESCAPE '\\' AND member NOT LIKE '\\_\\_MACOSX/%' ESCAPE '\\'),
    a AS (SELECT ordinal, member, CASE p[2] WHEN 'validation' THEN 'val' WHEN 'other' THEN 'unknown' ELSE p[2] END AS split,
          CASE WHEN p[2] <> 'other' OR list_contains({list(SHOT_CLASSES)}, p[3]) THEN p[3] ELSE 'unknown' END AS shot_type FROM v)"""

EVENTS = """WITH ev AS (SELECT event_id, user_id::VARCHAR AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame_index, epoch_us(ts) // 1000 AS timestamp_ms,
                     value / 500 AS x, (props->>'$.k')::INTEGER / 100 AS y FROM events)"""

PIXELS = f"""WITH {_raw(False)}, lm AS (SELECT video_id, frame_index, unnest(range(0, 32))::INTEGER AS landmark_index, e FROM raw),
    px AS (SELECT video_id, frame_index, landmark_index, round_even(e[2 * landmark_index + 1] * 640, 0)::INTEGER AS px, round_even(e[2 * landmark_index + 2] * 360, 0)::INTEGER AS py FROM lm
           WHERE e[2 * landmark_index + 1] BETWEEN 0 AND 1 AND e[2 * landmark_index + 2] BETWEEN 0 AND 1)"""

TIMELINE = f"video_id, frame_index, timestamp_ms, phase, {_r('phase_confidence')}, phase_reason, round(wy, 6) + 0e0 AS hand_y, round(hh, 6) + 0e0 AS hand_height_proxy, round(wsy, 6) + 0e0 AS wrist_speed_y, is_contact_proxy"
FEATURE_COLUMNS = (
    "head_x head_y head_displacement_proxy left_knee_angle_deg right_knee_angle_deg front_knee_bend_proxy_deg shoulder_hip_separation_proxy_deg wrist_center_x wrist_center_y "
    "wrist_speed_proxy wrist_acceleration_proxy wrist_path_smoothness_proxy backlift_height_proxy follow_through_height_proxy"
)


def _notes() -> str:
    said = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in NOTES.items())
    return f"CASE comparison_status {said} END"


def _interpretations() -> str:
    said = " ".join(f"WHEN status = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in INTERPRETATIONS.items())
    return f"CASE WHEN status = 'baseline_metric_unavailable' AND baseline_count = 0 THEN '{NOT_LISTED}' {said} END"


def _shown(column: str, digits: int = 4) -> str:
    return f"coalesce(printf('%.{digits}f', {column}), 'N/A')"


def sql() -> dict[str, str]:
    metrics = " ".join(m[0] for m in METRICS)
    landmark_names = list(LANDMARK_NAMES)
    score = "0.40::DOUBLE * 32 / 33 + 0.25::DOUBLE * coalesce(mv, 0) + 0.25::DOUBLE * coalesce(mp, 0) + 0.10::DOUBLE * ok / 32"
    quality = f"""WITH {_raw(True)}, lm AS (SELECT video_id, frame_index, timestamp_ms, unnest(range(0, 32)) AS i, e FROM raw),
        fq AS (SELECT video_id, frame_index, timestamp_ms, avg(abs(e[2 * i + 1])) AS mv, avg(abs(e[2 * i + 2])) AS mp, count(*) FILTER (WHERE e[2 * i + 1] BETWEEN 0 AND 1 AND e[2 * i + 2] BETWEEN 0 AND 1) AS ok FROM lm GROUP BY ALL),
        q AS (SELECT *, least(1e0, greatest(0e0, {score})) AS score FROM fq)"""
    short = {m[0]: m[0].replace("_proxy", "").replace("_deg", "").replace("mean_", "").replace("max_", "").replace("min_", "").replace("_", " ") for m in METRICS}
    values = ", ".join(f"('{k}', '{v}')" for k, v in short.items())
    edges = ", ".join(f"({a}, {b})" for a, b in SKELETON)
    p = "i / 999e0"
    return {
        "phase_profile": f"{_timeline(False)} SELECT phase, count(*) AS frames, round(avg(hh), 6) + 0e0 AS mean_height, count(*) FILTER (WHERE is_contact_proxy) AS contacts FROM tl GROUP BY phase",
        "landmark_explode": f"""WITH {_raw(True)}, lm AS (SELECT video_id, frame_index, timestamp_ms, unnest(range(0, 32))::INTEGER AS landmark_index, e FROM raw)
            SELECT video_id, 'clips/' || video_id || '.mp4' AS source_video_path, NULL::DOUBLE AS z, frame_index, timestamp_ms, 0 AS pose_index, 'image' AS coordinate_space, landmark_index, {landmark_names}[landmark_index + 1] AS landmark_name, round(e[2 * landmark_index + 1], 6) + 0e0 AS x, round(e[2 * landmark_index + 2], 6) + 0e0 AS y,
                   round(abs(e[2 * landmark_index + 1]), 6) AS visibility, round(abs(e[2 * landmark_index + 2]), 6) AS presence FROM lm""",
        "landmark_summary": "SELECT 'image' AS coordinate_space, count(*) * 32 AS landmark_rows, count(*) AS frames, count(*) AS pose_instances, 'image' AS spaces FROM embeddings",
        "frame_quality": f"{quality} SELECT video_id, 'clips/' || video_id || '.mp4' AS source_video_path, frame_index, timestamp_ms, 1 AS pose_count, true AS has_pose, 32 AS image_landmark_count, 0 AS world_landmark_count, round(32 / 33e0, 6) AS landmark_coverage, round(mv, 6) AS mean_visibility, round(mp, 6) AS mean_presence, round(ok / 32e0, 6) AS coordinate_valid_ratio, round(score, 6) AS frame_quality_score FROM q",
        "frame_quality_of_lines": f"{quality} SELECT video_id, 'clips/' || video_id || '.mp4' AS source_video_path, frame_index, timestamp_ms, 1 AS pose_count, true AS has_pose, 32 AS image_landmark_count, 0 AS world_landmark_count, round(32 / 33e0, 6) AS landmark_coverage, round(mv, 6) AS mean_visibility, round(mp, 6) AS mean_presence, round(ok / 32e0, 6) AS coordinate_valid_ratio, round(score, 6) AS frame_quality_score FROM q",
        "clip_quality_summary": f"{quality} SELECT video_id, count(*) AS total_frames_processed, count(*) AS frames_with_pose, 1e0 AS pose_detection_rate, round(avg(score), 5) AS mean_frame_quality_score, round(avg(mv), 5) AS mean_visibility, round(avg(mp), 5) AS mean_presence, round(count(*) FILTER (WHERE score < 0.5) / count(*), 5) AS low_quality_frame_rate FROM q GROUP BY video_id",
        "frame_pivot": f"{_frames(True)} SELECT video_id, frame_index, timestamp_ms, {_r(' '.join(f'x_{n} y_{n}' for n in TRACKED))} FROM fr",
        "frame_pivot_of_table": f"{_frames(True)} SELECT video_id, frame_index, timestamp_ms, {_r(' '.join(f'x_{n} y_{n}' for n in TRACKED))} FROM fr",
        "joint_angles": f"{_features()} SELECT video_id, frame_index, {_r('left_knee_angle_deg right_knee_angle_deg front_knee_bend_proxy_deg shoulder_hip_separation_proxy_deg', 4)} FROM ft",
        "wrist_kinematics": f"{_features()} SELECT video_id, frame_index, {_r('wrist_center_x wrist_center_y wrist_speed_proxy wrist_acceleration_proxy wrist_path_smoothness_proxy', 5)} FROM ft",
        "wrist_kinematics_irregular": f"""{EVENTS}, d AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS dms, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ev WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)),
            t AS (SELECT *, CASE WHEN dms > 0 THEN dms / 1e3 ELSE 1 / 24e0 END AS dt FROM d), v AS (SELECT *, coalesce(sqrt(pow(dx / dt, 2) + pow(dy / dt, 2)), 0e0) AS speed FROM t),
            a AS (SELECT *, coalesce(abs(speed - lag(speed) OVER (PARTITION BY video_id ORDER BY frame_index)) / dt, 0e0) AS accel FROM v)
            SELECT event_id, video_id, frame_index, round(speed, 6) AS wrist_speed_proxy, round(1 / (1 + accel), 6) AS wrist_path_smoothness_proxy FROM a""",
        "head_displacement": f"{_features()} SELECT video_id, frame_index, {_r('head_displacement_proxy')} FROM ft",
        "conversation_displacement": """WITH c AS (SELECT conv_id, turn, length(text)::DOUBLE AS x, turn::DOUBLE AS y FROM conversations), f AS (SELECT *, first(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM c)
            SELECT conv_id, turn, round(sqrt(pow(x - s.x, 2) + pow(y - s.y, 2)), 6) AS displacement FROM f""",
        "frame_motion": f"{_timeline(True)} SELECT video_id, frame_index, timestamp_ms, round(wy, 6) + 0e0 AS hand_y, round(hh, 6) + 0e0 AS hand_height_proxy, round(wsy, 6) + 0e0 AS wrist_speed_y, usable AS usable_for_phase FROM tl",
        "key_frames": f"{_timeline(True)} SELECT video_id, max(n)::BIGINT AS usable, max(apex) AS apex, max(contact) AS contact FROM k GROUP BY video_id",
        "phase_timeline": f"{_timeline(False)} SELECT {TIMELINE} FROM tl",
        "phase_timeline_sparse": f"{_timeline(True)} SELECT {TIMELINE} FROM tl",
        "phase_timeline_arriving": f"{_timeline(True)} SELECT {TIMELINE} FROM tl",
        "phase_timeline_of_table": f"{_timeline(True)} SELECT {TIMELINE} FROM tl",
        "phase_summary": f"{_timeline(True)} SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE phase <> 'unavailable') AS usable_frames, count(*) FILTER (WHERE is_contact_proxy) AS contacts, array_to_string(list_filter({[p[0] for p in PHASES]}, lambda x: list_contains(list(phase), x)), ',') AS phases FROM tl GROUP BY video_id",
        "phase_counts": f"{_timeline(True)} SELECT phase, count(*) AS frames FROM tl GROUP BY phase",
        "movement_features": f"{_features()} SELECT video_id, frame_index, timestamp_ms, phase, usable_for_motion, {_r(FEATURE_COLUMNS, 4)} FROM ft",
        "movement_summary": f"""{_features()}, s AS (SELECT video_id, count(*) AS rows, count(*) FILTER (WHERE usable_for_motion) AS usable_frames, max(backlift_height_proxy) AS max_backlift_height_proxy, max(follow_through_height_proxy) AS follow_through_height_proxy, avg(head_displacement_proxy) AS mean_head_displacement_proxy,
            CASE WHEN count(*) FILTER (WHERE head_x IS NOT NULL AND head_y IS NOT NULL) > 0 THEN sqrt(var_samp(head_x) + var_samp(head_y)) END AS head_motion_std_proxy, min(front_knee_bend_proxy_deg) AS min_front_knee_bend_proxy_deg, avg(shoulder_hip_separation_proxy_deg) AS mean_shoulder_hip_separation_proxy_deg,
            avg(wrist_speed_proxy) AS mean_wrist_speed_proxy, avg(wrist_path_smoothness_proxy) AS mean_wrist_path_smoothness_proxy FROM ft GROUP BY video_id)
            SELECT video_id, rows, usable_frames, {_r(metrics + ' head_motion_std_proxy', 4)} FROM s""",
        "shot_summary": f"{_shots()} SELECT shot_id, shot_type, rows, usable_frames, is_usable, {_r(metrics, 4)} FROM shots",
        "baseline_distribution": f"{_shots()} SELECT shot_type, metric, count, {_r('mean std min max', 4)} FROM dist",
        "baseline_merged": f"{_shots()} SELECT shot_type, metric, count, {_r('mean std min max', 4)} FROM dist",
        "baseline_profile": f"""{_shots()}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_usable) AS u FROM shots), y AS (SELECT shot_type, count(*) AS c FROM shots GROUP BY shot_type)
            SELECT '{BASELINE_VERSION}' AS baseline_version, a.n AS total_manifest_rows, a.u AS usable_shots, a.n::INTEGER AS summaries, a.u::INTEGER AS usable_summaries, '{BASELINE_LIMITATION}' AS limitation, 'manifest.csv' AS source_manifest_path,
                   shot_type, y.c AS type_shots, y.c::INTEGER AS type_ids, metric, count, {_r('mean std min max', 4)} FROM dist JOIN y USING (shot_type) CROSS JOIN a""",
        "baseline_counts": f"{_shots()} SELECT shot_type, count(*) AS manifest_shots, count(*) FILTER (WHERE is_usable) AS usable_shots, array_to_string(list_sort(list(shot_id)), ',') AS shot_ids FROM shots GROUP BY shot_type",
        "segment_zscore": """WITH o AS (SELECT o_custkey, avg(o_totalprice) AS value FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey, c_mktsegment, value FROM customer JOIN o ON c_custkey = o_custkey),
            b AS (SELECT c_mktsegment, avg(value) AS mean, stddev_samp(value) AS std FROM c GROUP BY c_mktsegment), z AS (SELECT c_custkey, c_mktsegment, (value - mean) / nullif(std, 0) AS z, value, mean, std FROM c JOIN b USING (c_mktsegment))
            SELECT c_custkey, c_mktsegment, round(z, 4) + 0e0 AS z_score, CASE WHEN std IS NULL OR std = 0 THEN 'baseline_variance_unavailable' WHEN z > 1 THEN 'above_baseline' WHEN z < -1 THEN 'below_baseline' ELSE 'within_baseline' END AS status FROM z""",
        "metric_status": f"{_shots()} SELECT shot_id, shot_type, metric, baseline_count, status, {_interpretations()} AS interpretation, {_r('shot_value baseline_mean baseline_std delta_from_mean z_score', 4)} FROM cmp",
        "comparison_status": f"{_shots()} SELECT shot_id, shot_type, usable_frames, comparable_metrics, comparison_status, {_notes()} AS note FROM stat",
        "report_rows": f"{_shots()} SELECT shot_id, cmp.metric, short_name, status, '| ' || cmp.metric || ' | ' || {_shown('shot_value')} || ' | ' || {_shown('baseline_mean')} || ' | ' || {_shown('baseline_std')} || ' | ' || status || ' |' AS line FROM cmp JOIN (VALUES {values}) t(metric, short_name) USING (metric)",
        "label_join": "SELECT d.doc_id::VARCHAR AS shot_id, 'q' || quality AS shot_type, 'f/' || d.doc_id AS movement_features_csv FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) l USING (doc_id)",
        "label_unmatched": "SELECT doc_id::VARCHAR AS shot_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "label_dedupe_first": "SELECT user_id::VARCHAR AS video_id, event_type AS shot_type FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
        "feature_scaling": f"{_scaled()} SELECT shot_id, shot_type, {_r(metrics, 4)} FROM sca",
        "loo_nearest": f"{_scaled()} SELECT shot_id, true_shot_type, predicted_shot_type, nearest_neighbor_shot_id, {_r('distance', 4)} FROM nn",
        "loo_confusion": f"{_scaled()}, t AS (SELECT DISTINCT shot_type AS t FROM sca) SELECT a.t AS true_shot_type, b.t AS predicted_shot_type, count(shot_id) AS shots FROM t a CROSS JOIN t b LEFT JOIN nn ON true_shot_type = a.t AND predicted_shot_type = b.t GROUP BY ALL",
        "loo_evaluation": f"""{_scaled()}, g AS (SELECT count(*) AS n FROM shots GROUP BY shot_type) SELECT CASE WHEN min(n) >= 2 THEN 'ok' ELSE 'insufficient_class_replicates_for_reliable_evaluation' END AS evaluation_status, sum(n)::BIGINT AS samples, count(*) AS classes,
            (SELECT round(avg((true_shot_type = predicted_shot_type)::INT), 6) FROM nn) AS accuracy FROM g""",
        "audit_rows": f"{AUDIT} SELECT * FROM au",
        "audit_summary": f"{AUDIT} SELECT count(*) AS total_videos, count(*) FILTER (WHERE status <> 'failed') AS attempted_videos, count(*) FILTER (WHERE status = 'failed') AS failed_videos, count(*) FILTER (WHERE frames_with_pose > 0) AS videos_with_pose, round_even(avg(pose_detection_rate) FILTER (WHERE status <> 'failed'), 4) AS mean_pose_detection_rate, (SELECT video_id FROM au WHERE status <> 'failed' ORDER BY pose_detection_rate DESC, frames_with_pose DESC, video_id LIMIT 1) AS best_video FROM au",
        "best_clips": f"{AUDIT} SELECT video_id, pose_detection_rate, frames_with_pose FROM au WHERE status = 'pose_detected' ORDER BY pose_detection_rate DESC, frames_with_pose DESC, video_id LIMIT 10",
        "archive_counts": f"{ARCHIVE} SELECT GROUPING(split, shot_type)::INTEGER AS level, split, shot_type, count(*) AS videos FROM a GROUP BY GROUPING SETS ((split), (shot_type), (split, shot_type), ())",
        "balanced_sample": f"{ARCHIVE} SELECT ordinal, member, split, shot_type, row_number() OVER (PARTITION BY shot_type ORDER BY ordinal) AS nth FROM a WHERE split = 'val' AND list_contains({list(SHOT_CLASSES)}, shot_type) QUALIFY nth <= 3",
        "first_members": f"{ARCHIVE} SELECT ordinal, member FROM a ORDER BY ordinal LIMIT 30",
        "path_labels": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS a FROM p),
            l AS (SELECT *, CASE WHEN len(a) >= 3 THEN a[1] ELSE 'unknown' END AS split, CASE WHEN len(a) >= 3 THEN a[2] WHEN len(a) = 2 THEN a[1] ELSE 'unknown' END AS shot_type FROM q)
            SELECT page_id, split, shot_type, regexp_replace(split || '_' || shot_type || '_' || regexp_replace(a[-1], '^(.+)\.[^.]*$', '\1'), '[^A-Za-z0-9_-]+', '_', 'g') AS video_id FROM l""",
        "json_props": "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events",
        "metric_short_name": f"{_shots()} SELECT long.metric, short_name, count(value) AS shots FROM long JOIN (VALUES {values}) t(metric, short_name) USING (metric) GROUP BY ALL",
        "every_nth_frame": f"{EVENTS} SELECT event_id, video_id, frame_index FROM ev WHERE frame_index % 3 = 0 AND frame_index < 12",
        "pixel_points": f"{PIXELS} SELECT * FROM px",
        "skeleton_edges": f"{PIXELS} SELECT o.video_id, o.frame_index, a, b, o.px AS ax, o.py AS ay, t.px AS bx, t.py AS by FROM (VALUES {edges}) e(a, b) JOIN px o ON o.landmark_index = a JOIN px t ON t.landmark_index = b AND t.video_id = o.video_id AND t.frame_index = o.frame_index",
        "frame_states": f"WITH {_raw(False)} SELECT video_id, frame_index, CASE WHEN frame_index % 3 <> 0 THEN 'not_sampled' WHEN frame_index % 2 > 0 THEN 'pose_detected' ELSE 'no_pose' END AS state FROM raw",
        "clip_scalars": f"""WITH o AS (SELECT o_orderkey, (o_orderkey % 31 - 1)::DOUBLE AS fps, o_orderkey % 1000 AS i FROM orders)
            SELECT o_orderkey, CASE WHEN fps > 0 THEN round_even(i / fps * 1000, 0)::BIGINT ELSE i END AS timestamp_ms, CASE WHEN fps > 0 THEN round(i / fps, 4) ELSE 0e0 END AS duration_sec, round(greatest(CASE WHEN fps > 0 THEN fps ELSE 24 END / 3e0, 1), 4) AS slow_fps,
            round(CASE WHEN {p} < 0.25::DOUBLE THEN -130 + 25 * ({p} / 0.25::DOUBLE) WHEN {p} < 0.55::DOUBLE THEN -105 + 150 * (({p} - 0.25::DOUBLE) / 0.30::DOUBLE) WHEN {p} < 0.80::DOUBLE THEN 45 + 45 * (({p} - 0.55::DOUBLE) / 0.25::DOUBLE) ELSE 90 - 18 * (({p} - 0.80::DOUBLE) / 0.20::DOUBLE) END, 4) + 0e0 AS bat_angle,
            CASE WHEN {p} < 0.18 THEN 'stance' WHEN {p} < 0.35 THEN 'backlift' WHEN {p} < 0.55 THEN 'downswing' WHEN {p} < 0.62 THEN 'contact_zone' WHEN {p} < 0.85 THEN 'follow_through' ELSE 'recovery' END AS phase,
            chr((72 + i % 8)::INTEGER) || '264' AS codec, printf('frame_%06d.jpg', i) AS file FROM o""",
        "cards": f"""{_shots()}, {quality.removeprefix(f'WITH {_raw(True)}, ')} SELECT shot_id, comparison_status, usable_frames::VARCHAR AS usable_motion_frames, '1.000' AS pose_detection_rate, {_shown('mean', 3)} AS mean_frame_quality
            FROM stat LEFT JOIN (SELECT video_id, avg(score) AS mean FROM q GROUP BY video_id) ON video_id = shot_id""",
        "baseline_table": f"{_shots()} SELECT shot_type, count(*) AS manifest_shots, count(*) FILTER (WHERE is_usable) AS usable_shots, (SELECT count(*) FROM dist d WHERE d.shot_type = s.shot_type)::INTEGER AS feature_count FROM shots s GROUP BY shot_type",
        "baseline_manifest": "SELECT 'clip_' || (vec_id // 10) AS shot_id, 'sample_mixed' AS shot_type, '../../features/clip_' || (vec_id // 10) || '.movement_features.csv' AS movement_features_csv FROM embeddings WHERE vec_id % 10 = 0",
        "relative_paths": r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1), '/'), lambda x: x NOT IN ('', '.')) AS p FROM pages)
            SELECT page_id, CASE WHEN p[2] = 'a' THEN coalesce(nullif(array_to_string(p[3:], '/'), ''), '.') ELSE array_to_string(['..'] || p[2:], '/') END AS relative, coalesce(nullif(array_to_string(p[2:], '/'), ''), '.') AS shown FROM p""",
        "feature_chart": f"{_features()} SELECT video_id, frame_index, {_r('head_displacement_proxy backlift_height_proxy wrist_speed_proxy wrist_path_smoothness_proxy', 4)} FROM ft",
        "rate_chart": f"{AUDIT} SELECT video_id, shot_type, pose_detection_rate FROM au",
        "comparison_documents": f"""{_shots()} SELECT '{COMPARISON_VERSION}' AS comparison_version, '{BASELINE_VERSION}' AS baseline_version, stat.shot_id, stat.shot_type, comparison_status, {_notes()} AS notes, shots.rows AS movement_rows, stat.usable_frames AS usable_motion_frames,
            comparable_metrics, '{LIMITATION}' AS limitation, 'summary.json' AS movement_summary_path, 'profile.json' AS baseline_profile_path, metric, baseline_count, status, {_interpretations()} AS interpretation,
            {_r('shot_value baseline_mean baseline_std delta_from_mean z_score', 4)} FROM stat JOIN cmp USING (shot_id) JOIN shots USING (shot_id)""",
        "demo_summary": f"""{AUDIT}, b AS (SELECT * FROM au WHERE status = 'pose_detected' ORDER BY pose_detection_rate DESC, frames_with_pose DESC, video_id LIMIT 1)
            SELECT video_id AS selected_video_id, shot_type AS selected_shot_type, video_path AS selected_video_path, output_jsonl_path AS selected_pose_jsonl_path, pose_detection_rate AS selected_pose_detection_rate,
            (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) AS baseline_video_count, '/demo/data/processed/real/reports/clip_comparison.json' AS comparison_json_path, '/demo/data/processed/real/baselines/real_baseline_manifest.csv' AS baseline_manifest_path, '/demo/data/processed/real/landmarks/clip.landmarks.parquet' AS landmark_parquet_path, '{LIMITATION}' AS limitation FROM b""",
        "manifest_evidence": "SELECT 'ok' AS status, count(*) AS manifest_rows, count(DISTINCT vec_id // 10) AS unique_movement_feature_paths FROM embeddings WHERE vec_id % 10 = 0",
    }
