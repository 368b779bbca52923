"""The queries as SQL for an independent engine, written from their meaning rather than from the plans."""

from __future__ import annotations

from pulsegrid.operators import composites
from pulsegrid.plans.synth import oracle_ctes

IN_WEEK = "{0} >= TIMESTAMP '2024-01-15' AND {0} < TIMESTAMP '2024-01-22'"
# Windows of the week of 2024-01-15.
WINDOWS = {"cur": ("2024-01-15", "2024-01-22"), "base": ("2024-01-08", "2024-01-15"), "acute": ("2024-01-15", "2024-01-22"), "chronic": ("2023-12-25", "2024-01-22")}
NIGHT = "CAST(start_ts - INTERVAL 12 HOUR AS DATE)"
HR = "SELECT w.id, w.type, w.start_ts, w.end_ts, w.duration_sec, h.ts, h.bpm, h.source FROM workouts w JOIN heart_rate h ON h.ts BETWEEN w.start_ts AND w.end_ts"
PERF = "SELECT w.id, w.start_ts, w.end_ts, w.duration_sec, p.* FROM workouts w JOIN performance p ON p.ts BETWEEN w.start_ts AND w.end_ts"
ALIGNED = """SELECT * FROM (SELECT p.id, p.start_ts, p.duration_sec, p.ts, p.speed, h.ts AS hr_ts, h.bpm, row_number() OVER (PARTITION BY p.id, p.ts, p.speed
  ORDER BY abs(epoch(h.ts) - epoch(p.ts)), h.ts) AS rn FROM perf p JOIN hr h ON h.id = p.id AND abs(epoch(h.ts) - epoch(p.ts)) <= 60 WHERE p.speed IS NOT NULL) WHERE rn = 1"""
LOAD = "SELECT w.id, w.start_ts, w.duration_sec, avg(h.bpm) AS avg_hr, w.duration_sec * avg(h.bpm) AS load FROM workouts w LEFT JOIN hr h ON h.id = w.id GROUP BY w.id, w.start_ts, w.duration_sec"
DRIFT = """SELECT w.id, f AS first_avg, s AS second_avg, CASE WHEN f <> 0 THEN (s - f) / f * 100 END AS drift_pct FROM workouts w LEFT JOIN
  (SELECT id, avg(bpm) FILTER (epoch(ts) < m) AS f, avg(bpm) FILTER (epoch(ts) >= m) AS s FROM (SELECT *, (epoch(start_ts) + epoch(end_ts)) / 2 AS m FROM hr) GROUP BY id) x ON x.id = w.id"""
FADE = """SELECT w.id, CASE WHEN s1 > 0 THEN (s1 - s2) / s1 * 100 END AS speed_fade_pct, CASE WHEN p1 > 0 THEN (p1 - p2) / p1 * 100 END AS power_fade_pct FROM workouts w LEFT JOIN
  (SELECT id, avg(speed) FILTER (epoch(ts) < m) AS s1, avg(speed) FILTER (epoch(ts) >= m) AS s2, avg(power) FILTER (epoch(ts) < m) AS p1, avg(power) FILTER (epoch(ts) >= m) AS p2
   FROM (SELECT *, (epoch(start_ts) + epoch(end_ts)) / 2 AS m FROM perf) GROUP BY id) x ON x.id = w.id"""
PACE = """SELECT w.id, coalesce(n, 0) AS sample_count, v AS avg_speed_mps, 1000.0 / v AS pace_sec_per_km FROM workouts w LEFT JOIN
  (SELECT id, count(*) AS n, avg(speed) AS v FROM aligned WHERE bpm BETWEEN 120 AND 130 AND speed > 0 GROUP BY id) x ON x.id = w.id"""
DECOUPLING = """SELECT id, window_sec, n AS sample_count, e1 AS first_half_efficiency, e2 AS second_half_efficiency, (e2 - e1) / e1 * 100 AS decoupling_pct FROM (
  SELECT w.id, least(w.duration_sec, 3600) AS window_sec, coalesce(n, 0) AS n, CASE WHEN least(w.duration_sec, 3600) >= 2700 THEN p1 / b1 END AS e1, CASE WHEN least(w.duration_sec, 3600) >= 2700 THEN p2 / b2 END AS e2
  FROM workouts w LEFT JOIN (SELECT id, count(*) AS n, avg(1000.0 / speed) FILTER (o < half) AS p1, avg(bpm) FILTER (o < half) AS b1, avg(1000.0 / speed) FILTER (o >= half) AS p2, avg(bpm) FILTER (o >= half) AS b2
    FROM (SELECT *, epoch(ts) - epoch(start_ts) AS o, least(duration_sec, 3600) / 2 AS half FROM aligned WHERE speed > 0) WHERE o <= 2 * half GROUP BY id) x ON x.id = w.id)"""
QUALITY = """SELECT *, CASE WHEN duration_sec < 2700 OR hr_samples = 0 OR speed_samples = 0 OR aligned_speed_hr_samples = 0 THEN 'poor'
    WHEN power_samples = 0 OR route_count = 0 OR context_count = 0 THEN 'mixed' ELSE 'high' END AS sample_quality,
  concat_ws(',', CASE WHEN duration_sec < 2700 THEN 'too_short' END, CASE WHEN hr_samples = 0 THEN 'missing_hr' END, CASE WHEN speed_samples = 0 THEN 'missing_speed' END,
    CASE WHEN power_samples = 0 THEN 'missing_power' END, CASE WHEN speed_samples > 0 AND hr_samples > 0 AND aligned_speed_hr_samples = 0 THEN 'alignment_gap' END,
    CASE WHEN route_count = 0 THEN 'missing_route' END, CASE WHEN context_count = 0 THEN 'missing_context' END) AS issues
  FROM (SELECT w.id AS workout_id, w.duration_sec, (SELECT count(*) FROM hr WHERE hr.id = w.id) AS hr_samples, (SELECT count(speed) FROM perf p WHERE p.id = w.id) AS speed_samples,
    (SELECT count(power) FROM perf p WHERE p.id = w.id) AS power_samples,
    (SELECT count(*) FROM near n WHERE n.id = w.id) AS aligned_speed_hr_samples,
    (SELECT count(*) FROM workout_routes r WHERE r.workout_id = w.id) AS route_count,
    (SELECT count(*) FROM workout_routes r WHERE r.workout_id = w.id) + (SELECT count(*) FROM workout_stats r WHERE r.workout_id = w.id)
      + (SELECT count(*) FROM workout_events r WHERE r.workout_id = w.id) + (SELECT count(*) FROM workout_metadata r WHERE r.workout_id = w.id) AS context_count FROM workouts w)"""
NEAR = "SELECT * FROM perf p WHERE speed IS NOT NULL AND EXISTS (SELECT 1 FROM hr h WHERE h.id = p.id AND abs(epoch(h.ts) - epoch(p.ts)) <= 60)"
CONTEXT = """SELECT w.id AS workout_id, CASE WHEN coalesce(indoor, 0) > 0 THEN 'indoor' WHEN route_count > 0 THEN 'outdoor_route' WHEN coalesce(outdoor, 0) > 0 THEN 'outdoor_no_route' ELSE 'unknown' END AS context_label,
  route_count, stat_count, pause_count, segment_count, coalesce(metadata_count, 0) AS metadata_count, coalesce(weather, 0) > 0 AS has_weather, coalesce(elevation, 0) > 0 AS has_elevation FROM (
  SELECT w.id, (SELECT count(*) FROM workout_routes r WHERE r.workout_id = w.id) AS route_count, (SELECT count(*) FROM workout_stats r WHERE r.workout_id = w.id) AS stat_count,
    (SELECT count(*) FROM workout_events r WHERE r.workout_id = w.id AND lower(r.type) LIKE '%pause%') AS pause_count, (SELECT count(*) FROM workout_events r WHERE r.workout_id = w.id AND lower(r.type) LIKE '%segment%') AS segment_count
  FROM workouts w) w LEFT JOIN (SELECT workout_id, count(*) AS metadata_count, count(*) FILTER (lower(key) LIKE '%indoor%' AND lower(value) IN ('1', 'true', 'yes')) AS indoor,
    count(*) FILTER (lower(key) LIKE '%indoor%' AND lower(value) IN ('0', 'false', 'no')) AS outdoor, count(*) FILTER (lower(key) LIKE '%weather%' OR lower(value) LIKE '%weather%') AS weather,
    count(*) FILTER (lower(key) LIKE '%elevation%' OR lower(key) LIKE '%altitude%' OR lower(value) LIKE '%elevation%' OR lower(value) LIKE '%altitude%') AS elevation
    FROM workout_metadata GROUP BY 1) m ON m.workout_id = w.id"""
#: Steps that build on the tables, in order.
STEPS = {"hr": HR, "perf": PERF, "aligned": ALIGNED, "near": NEAR, "loads": LOAD, "drifts": DRIFT, "fades": FADE, "paces": PACE, "decouplings": DECOUPLING, "qualities": QUALITY, "contexts": CONTEXT}


def _with(body: str) -> str:
    return oracle_ctes() + "".join(f", {n} AS ({s})" for n, s in STEPS.items()) + " " + body


def _span(name: str, ts: str = "ts") -> str:
    a, b = WINDOWS[name]
    return f"{ts} >= TIMESTAMP '{a}' AND {ts} < TIMESTAMP '{b}'"


def _mean(table: str, column: str, window: str) -> str:
    return f"(SELECT avg(v) FROM (SELECT avg({column}) AS v FROM {table} WHERE {column} IS NOT NULL AND {_span(window)} GROUP BY CAST(ts AS DATE)))"


def _total(window: str) -> str:
    return f"(SELECT sum(load) FROM loads WHERE {_span(window, 'start_ts')})"


def _runs(column: str, table: str, window: str, agg: str = "avg") -> str:
    return f"(SELECT {agg}(x.{column}) FROM {table} x JOIN workouts w ON w.id = x.id WHERE w.type = 'Running' AND {_span(window, 'w.start_ts')})"


def _slept(window: str, state: str) -> str:
    return f"(SELECT sum(date_diff('second', start_ts, end_ts)) FROM sleep WHERE state = '{state}' AND {_span(window, 'start_ts')})"


def _z2(window: str) -> str:
    return f"(SELECT count(*) FILTER (bpm BETWEEN 115 AND 125) / count(*) FROM heart_rate WHERE {_span(window)})"


def _trend(a: str, b: str, up: bool = True, flat: float = 0.03) -> str:
    sign = ">" if up else "<"
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'insufficient_data' WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 'flat' ELSE 'insufficient_data' END
      WHEN abs(({a} - {b}) / abs({b})) < {flat} THEN 'flat' WHEN ({a} - {b}) {sign} 0 THEN 'improving' ELSE 'declining' END"""


def _score(t: str) -> str:
    return f"CASE {t} WHEN 'declining' THEN 1 WHEN 'improving' THEN -1 ELSE 0 END"


def _fixed(x: str, digits: int, unit: str = "") -> str:
    """Nine places, then exact rounding; printf rounds real ties to even, so these are moved up a little first."""
    x = f"round(({x})::DOUBLE, 9)"
    size = f"abs({x})"
    tie = f"regexp_matches(printf('%.60f', {size}), '[.][0-9]{{{digits}}}50*$')"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || printf('%.{digits}f', {size} * CASE WHEN {tie} THEN 1.000000000000001::DOUBLE ELSE 1::DOUBLE END) || '{unit}')"


def _signed(x: str, digits: int, unit: str = "") -> str:
    return f"(CASE WHEN {x} > 0 THEN '+' ELSE '' END || {_fixed(x, digits, unit)})"


def _whole(x: str, unit: str = "") -> str:
    return f"(CAST(CAST(floor({x} + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '{unit}')"


def _evidence(**items: str) -> str:
    """Evidence as one text: label=value, numbers as ``n:`` with four digits; words of a label are joined by underscores here."""
    one = lambda x: f"coalesce('n:' || printf('%.4f', ({x[2:]})::DOUBLE), 'none')" if x.startswith("n:") else f"coalesce({x}, 'none')"
    return " || '; ' || ".join(f"'{name}=' || {one(x)}" for name, x in items.items()) + " AS evidence"


PACE_TEXT = f"(CASE WHEN p - p0 > 0 THEN '+' ELSE '' END || {_whole('p - p0', ' sec/km')})"
CONF = "CASE sample_quality WHEN 'high' THEN 'high' WHEN 'mixed' THEN 'medium' ELSE 'low' END AS confidence"


def _composite(inputs: dict[str, str], body: str, columns: str) -> str:
    first = ", ".join(f"{sql} AS {name}" for name, sql in inputs.items())
    return _with(f", i AS (SELECT {first}) {body}").replace(") , i AS", "), i AS") + f" SELECT {columns}, claim_strength, evidence, {CONF} FROM r"


def _strain() -> dict[str, str]:
    return {
        "load_ratio": f"{_total('acute')} / ({_total('chronic')} / 4)",
        "acute": _total("acute"),
        "chronic": _total("chronic"),
        "rhr": _mean("resting_hr", "bpm", "acute"),
        "rhr0": _mean("resting_hr", "bpm", "base"),
        "hrv": _mean("hrv", "value", "acute"),
        "hrv0": _mean("hrv", "value", "base"),
    }


def _daily(table: str, columns: dict[str, str], total: bool = False) -> str:
    if total:
        parts = ", ".join(f"round(coalesce(sum({c}), 0), 6) AS {n}" for c, n in columns.items())
        where = "TRUE"
    else:
        parts = ", ".join(f"round(avg({c}), 6) AS {n}" for c, n in columns.items())
        where = " OR ".join(f"{c} IS NOT NULL" for c in columns)
    return f"{oracle_ctes(table)} SELECT CAST(ts AS DATE) AS day, {parts} FROM {table} WHERE {where} GROUP BY 1"


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _consistency_parts(w: str, k: str) -> dict[str, str]:
    where = _span(w, "start_ts")
    return {
        f"n{k}": f"(SELECT count(*) FROM workouts WHERE {where})",
        f"minutes{k}": f"coalesce((SELECT sum(duration_sec) / 60 FROM workouts WHERE {where}), 0)",
        f"steps{k}": f"(SELECT avg(v) FROM (SELECT sum(count) AS v FROM steps WHERE {_span(w)} GROUP BY CAST(ts AS DATE)))",
        f"sleep{k}": f"(SELECT stddev_samp(epoch(s) % 86400) / 60 FROM (SELECT min(start_ts) AS s FROM sleep WHERE state = 'asleep' AND {where} GROUP BY {NIGHT}))",
        f"rhr{k}": f"(SELECT stddev_samp(v) FROM (SELECT avg(bpm) AS v FROM resting_hr WHERE {_span(w)} GROUP BY CAST(ts AS DATE)))",
    }


def _consistency(k: str) -> str:
    cap = lambda x, top: f"coalesce(least(1, greatest(0, {x})), 0) * {top}"
    inverse = lambda x, limit, top: f"CASE WHEN {x} IS NULL THEN 0 ELSE least(1, greatest(0, 1 - {x} / {limit})) * {top} END"
    return f"{cap(f'n{k} / 3.0::DOUBLE', 25)} + {cap(f'minutes{k} / 150', 25)} + {cap(f'coalesce(steps{k}, 0) / 7000', 20)} + {inverse(f'sleep{k}', 45, 15)} + {inverse(f'rhr{k}', 3, 15)}"


INGEST = """WITH rows AS (SELECT concat_ws('|', event_type, CAST(user_id AS VARCHAR), strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g')) AS dedup_key, place, ts, event_type
  FROM (SELECT event_id AS place, ts, user_id, event_type FROM events UNION ALL SELECT event_id + 1000000, ts, user_id, event_type FROM events WHERE event_id % 5 = 0)) """


def _cases(column: str, picks: list[str]) -> str:
    return f"CASE l_orderkey % {len(picks)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(picks)) + " END"


def _weights(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in weights.items()) + " END"


#: Evidence that is known: all items but those whose value is none.
_RANK = f"""{_weights('action_kind', composites.ACTIONS)} * 100 + {_weights('confidence', composites.CONFIDENCE)} * 10 + {_weights('sample_quality', composites.QUALITY)} * 4
  + {_weights('claim_strength', composites.CLAIMS)} + len(list_filter(string_split(evidence, '; '), lambda x: NOT suffix(x, '=none'))) / 10.0::DOUBLE AS rank"""


def _report(found: dict[str, str]) -> str:
    """The strongest result of each section, and next week's action from the strongest of all."""
    sections = {
        "fitness_direction": ["fitness_trend"],
        "easy_run_quality": ["aerobic_efficiency", "load_quality", "run_economy"],
        "recovery_state": ["readiness", "recovery_debt", "training_strain"],
    }
    common = "state, action_kind, confidence, sample_quality, claim_strength, evidence"
    rows = [f"SELECT {place} AS place, '{section}' AS section, '{name}' AS source, {n} AS n, {common} FROM ({found[name]})" for place, (section, names) in enumerate(sections.items(), 1) for n, name in enumerate(names)]
    return f"""WITH results AS ({' UNION ALL '.join(rows)}),
      best AS (SELECT place, section, source, {common}, rank FROM (SELECT *, {_RANK} FROM results) QUALIFY row_number() OVER (PARTITION BY place ORDER BY rank DESC, n) = 1),
      flags AS (SELECT *, {_RANK}, {_weights('diagnosis', composites.DIAGNOSES)} AS severity FROM ({found['run_fatigue_flags']}) WHERE start_ts >= TIMESTAMP '2024-01-15' AND start_ts < TIMESTAMP '2024-01-22'),
      kinds AS (SELECT diagnosis, count(*) AS n, max(start_ts) AS seen FROM flags GROUP BY 1),
      mix AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, string_agg(replace(diagnosis, '_', ' ') || ': ' || n, ', ' ORDER BY seen DESC, diagnosis DESC) AS mix FROM kinds),
      strongest AS (SELECT * FROM flags ORDER BY severity DESC, rank DESC, start_ts DESC, workout_id LIMIT 1),
      workouts_section AS (SELECT coalesce(s.state, 'no workout flags') AS state, coalesce(s.action_kind, 'retest') AS action_kind, coalesce(s.confidence, 'low') AS confidence,
        coalesce(s.sample_quality, 'poor') AS sample_quality, coalesce(s.claim_strength, 'worth_watching') AS claim_strength,
        CASE WHEN m.n = 0 THEN 'Flagged_runs=n:0.0000' ELSE 'Strongest_flag=' || replace(s.diagnosis, '_', ' ') || '; Flagged_runs=n:' || printf('%.4f', m.n::DOUBLE) || '; Flag_mix=' || m.mix || '; '
          || string_split(s.evidence, '; ')[1] END AS evidence FROM mix m LEFT JOIN strongest s ON TRUE),
      every AS (SELECT * FROM best UNION ALL SELECT 4, 'workout_diagnoses', 'run_fatigue_flags', {common}, rank FROM (SELECT *, {_RANK} FROM workouts_section))
      SELECT place, section, source, {common}, round(rank, 6) AS rank, first_value(action_kind) OVER (ORDER BY rank DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_week_action FROM every"""


def _run_metrics(found: dict[str, str]) -> str:
    sources = {"drift_pct": "drift_per_workout", "decoupling_pct": "decoupling", "pace_sec_per_km": "pace_at_hr", "z2_ratio": "z2_ratio_per_workout"}
    rows = " UNION ALL ".join(f"SELECT '{name}' AS metric, {name}::DOUBLE AS x FROM ({found[query]}) JOIN runs USING (id)" for name, query in sources.items())
    percent = _fixed("mean", 1, "%")
    pace = "CAST(CAST(floor(mean / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(mean % 60 + 0.5) AS BIGINT) AS VARCHAR), 2, '0') || '/km'"
    shown = f"CASE metric WHEN 'pace_sec_per_km' THEN {pace} WHEN 'z2_ratio' THEN {_whole('mean * 100', '%')} ELSE {percent} END"
    return f"""WITH runs AS ({oracle_ctes('workouts')} SELECT id FROM workouts WHERE type = 'Running'), v AS ({rows}), m AS (SELECT metric, round(avg(x), 6) AS mean, count(x) AS runs FROM v GROUP BY 1)
      SELECT metric, mean, runs, coalesce({shown}, 'unknown') AS shown, CASE runs WHEN 0 THEN 'No qualifying runs' WHEN 1 THEN '1 qualifying run' ELSE runs || ' qualifying runs' END AS coverage FROM m"""


def _hours_km(found: dict[str, str]) -> str:
    return f"""SELECT 'Hours' AS series, CAST(week AS TIMESTAMP) AS at, round(total_duration_sec / 3600, 6) AS value FROM ({found['weekly_activity']})
      UNION ALL SELECT 'Distance km', CAST(day AS TIMESTAMP), round(total_meters / 1000, 6) FROM ({found['distance_daily']})"""


def _sleep_page(found: dict[str, str]) -> str:
    return f"""WITH n AS (SELECT * FROM ({found['sleep_nights']})), s AS (SELECT night, count(*) AS segments FROM ({found['sleep_segments']}) GROUP BY 1),
      a AS (SELECT max(day) AS last, count(*) AS nights, round(sum(asleep_hours), 6) AS total_asleep_hours, round(avg(asleep_hours), 6) AS avg_asleep_hours, round(avg(efficiency), 6) AS avg_efficiency,
        count(*) FILTER (coalesce(core_hours, deep_hours, rem_hours, unspecified_hours) IS NOT NULL) AS staged_nights FROM n)
      SELECT a.last AS selected_night, n.asleep_hours AS selected_asleep_hours, n.efficiency AS selected_efficiency, coalesce(s.segments, 0) AS selected_segments, a.nights, a.total_asleep_hours, a.avg_asleep_hours, a.avg_efficiency,
        a.staged_nights FROM a JOIN n ON n.day = a.last LEFT JOIN s ON s.night = a.last"""


def oracle_sql() -> dict[str, str]:
    out = {
        "resting_hr_daily": _daily("resting_hr", {"bpm": "avg_rhr"}),
        "hrv_daily": _daily("hrv", {"value": "avg_hrv"}),
        "walking_hr_daily": _daily("walking_hr", {"bpm": "avg_walking_hr"}),
        "vo2max_daily": _daily("performance", {"vo2max": "avg_vo2max"}),
        "speed_daily": _daily("performance", {"speed": "avg_speed"}),
        "power_daily": _daily("performance", {"power": "avg_power"}),
        "running_dynamics_daily": _daily("performance", {c: f"avg_{c}" for c in ("vertical_oscillation_cm", "ground_contact_time_ms", "stride_length_m")}),
        "steps_daily": _daily("steps", {"count": "total_steps"}, True),
        "distance_daily": _daily("distance", {"meters": "total_meters"}, True),
        "energy_daily": _daily("energy", {"active_kcal": "active_kcal", "basal_kcal": "basal_kcal"}, True),
        "weekly_activity": oracle_ctes("workouts") + " SELECT CAST(date_trunc('week', start_ts) AS DATE) AS week, count(*) AS workout_count, coalesce(sum(duration_sec), 0) AS total_duration_sec FROM workouts GROUP BY 1",
        "resting_hr_rolling_7d": oracle_ctes("resting_hr")
        + """, d AS (SELECT CAST(ts AS DATE) AS day, avg(bpm) AS v FROM resting_hr GROUP BY 1)
        SELECT day, round((SELECT avg(b.v) FROM d b WHERE b.day BETWEEN a.day - 6 AND a.day), 6) AS avg_rhr_7d FROM d a WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
        "workouts_list": oracle_ctes("workouts") + f" SELECT * FROM workouts WHERE type = 'Running' AND {IN_WEEK.format('start_ts')}",
        "workouts_page": oracle_ctes("workouts") + " SELECT * FROM workouts ORDER BY start_ts DESC, id LIMIT 20 OFFSET 40",
        "workout_summary": oracle_ctes("workouts") + " SELECT * FROM workouts",
        "workout_hr_stream": _with("SELECT id, ts, bpm, source FROM hr"),
        "load_per_workout": _with(f"SELECT id, start_ts, {_r('duration_sec', 'avg_hr', 'load', digits=4)} FROM loads"),
        "drift_per_workout": _with(
            f"SELECT id, {_r('first_avg', 'second_avg', 'drift_pct')}, CASE WHEN abs(drift_pct) < 3 THEN 'stable' WHEN abs(drift_pct) < 6 THEN 'moderate' WHEN drift_pct IS NOT NULL THEN 'high' END AS drift_class FROM drifts"
        ),
        "fade_per_workout": _with(f"SELECT id, {_r('speed_fade_pct', 'power_fade_pct')} FROM fades"),
        "z2_ratio_range": _with(f"SELECT round({_z2('cur')}, 6) AS z2_ratio"),
        "z2_ratio_per_workout": _with("SELECT w.id, round(count(*) FILTER (bpm BETWEEN 115 AND 125) / nullif(count(bpm), 0), 6) AS z2_ratio FROM workouts w LEFT JOIN hr ON hr.id = w.id GROUP BY 1"),
        "zone_breakdown": _with(
            """, z(zone, lo, hi) AS (VALUES ('Z1', 0, 114), ('Z2', 115, 125), ('Z3', 126, 140), ('Z4', 141, 155), ('Z5', 156, 1000)) SELECT id, zone, count(*) FILTER (bpm BETWEEN lo AND hi) AS sample_count,
            round(count(*) FILTER (bpm BETWEEN lo AND hi) / count(*), 6) AS ratio FROM hr CROSS JOIN z GROUP BY 1, 2"""
        ).replace(") , z(", "), z("),
        "zone_time_distribution": _with(
            """, z(zone, lo, hi) AS (VALUES ('Z1', 0, 114), ('Z2', 115, 125), ('Z3', 126, 140), ('Z4', 141, 155), ('Z5', 156, 1000)),
            g AS (SELECT bpm, greatest(0, least(120, epoch(coalesce(lead(ts) OVER (PARTITION BY id ORDER BY ts, bpm), end_ts)) - epoch(ts))) AS s FROM hr),
            t AS (SELECT zone, coalesce(sum(s), 0) AS d FROM z LEFT JOIN g ON bpm BETWEEN lo AND hi GROUP BY 1)
            SELECT zone, round(d, 6) AS duration_sec, round(d / (SELECT sum(d) FROM t), 6) AS ratio FROM t"""
        ).replace(") , z(", "), z("),
        "sleep_summary": _with(
            f"""SELECT round(coalesce({_slept('cur', 'asleep')} / 3600.0::DOUBLE, 0), 6) AS total_hours, round((SELECT stddev_samp(epoch(s) % 86400) FROM
            (SELECT min(start_ts) AS s FROM sleep WHERE state = 'asleep' AND {_span('cur', 'start_ts')} GROUP BY {NIGHT})), 6) AS consistency_stddev, round({_slept('cur', 'asleep')}::DOUBLE / {_slept('cur', 'in_bed')}, 6) AS efficiency"""
        ),
        "sleep_nightly": oracle_ctes("sleep")
        + f""", n AS (SELECT {NIGHT} AS day, state, sum(date_diff('second', start_ts, end_ts) / 3600.0::DOUBLE) AS h FROM sleep GROUP BY 1, 2)
        SELECT a.day, round(a.h, 6) AS asleep_hours, round(b.h, 6) AS in_bed_hours, round(a.h / nullif(b.h, 0), 6) AS efficiency FROM n a LEFT JOIN n b ON b.day = a.day AND b.state = 'in_bed' WHERE a.state = 'asleep'""",
        "sleep_nights": oracle_ctes("sleep")
        + f""", s AS (SELECT {NIGHT} AS day, *, date_diff('second', start_ts, end_ts) / 3600.0::DOUBLE AS h, lower(replace(raw_state, 'HKCategoryValueSleepAnalysisAsleep', '')) AS stage FROM sleep),
        g AS (SELECT day, min(start_ts) AS bedtime, max(end_ts) AS wake_time, coalesce(sum(h) FILTER (state = 'asleep'), 0) AS asleep_hours, coalesce(sum(h) FILTER (state = 'in_bed'), 0) AS in_bed_hours,
          coalesce(sum(h) FILTER (state = 'awake'), 0) AS awake_hours, count(stage) AS k, coalesce(sum(h) FILTER (stage = 'core'), 0) AS c, coalesce(sum(h) FILTER (stage = 'deep'), 0) AS d,
          coalesce(sum(h) FILTER (stage = 'rem'), 0) AS m, coalesce(sum(h) FILTER (stage = 'unspecified'), 0) AS u FROM s GROUP BY day)
        SELECT day, bedtime, wake_time, {_r('asleep_hours', 'in_bed_hours', 'awake_hours')}, round(asleep_hours / nullif(in_bed_hours, 0), 6) AS efficiency, CASE WHEN k > 0 THEN round(c, 6) END AS core_hours,
          CASE WHEN k > 0 THEN round(d, 6) END AS deep_hours, CASE WHEN k > 0 THEN round(m, 6) END AS rem_hours, CASE WHEN k > 0 THEN round(u, 6) END AS unspecified_hours FROM g""",
        "sleep_segments": oracle_ctes("sleep")
        + f" SELECT {NIGHT} AS night, start_ts, end_ts, state, raw_state, lower(replace(raw_state, 'HKCategoryValueSleepAnalysisAsleep', '')) AS stage, round(date_diff('second', start_ts, end_ts) / 3600.0::DOUBLE, 6) AS duration_hours FROM sleep",
        "aligned_samples": _with("SELECT id, ts, round(speed, 6) AS speed, hr_ts, bpm FROM aligned"),
        "pace_at_hr": _with(f"SELECT id, sample_count, {_r('avg_speed_mps', 'pace_sec_per_km')} FROM paces"),
        "decoupling": _with(f"SELECT id, window_sec, sample_count, {_r('first_half_efficiency', 'second_half_efficiency', 'decoupling_pct')} FROM decouplings"),
        "workout_detail": _with(
            f"""SELECT w.*, {_r('first_avg', 'second_avg', 'drift_pct', digits=4)}, CASE WHEN abs(drift_pct) < 3 THEN 'stable' WHEN abs(drift_pct) < 6 THEN 'moderate' WHEN drift_pct IS NOT NULL THEN 'high' END AS drift_class,
            round(avg_hr, 4) AS avg_hr, round(load, 4) AS load, (SELECT round(count(*) FILTER (bpm BETWEEN 115 AND 125) / nullif(count(*), 0), 4) FROM hr WHERE hr.id = w.id) AS z2_ratio
            FROM workouts w JOIN drifts d ON d.id = w.id JOIN loads l ON l.id = w.id"""
        ),
        **{n: f"{oracle_ctes(n)} SELECT * FROM {n}" for n in ("workout_stats", "workout_events", "workout_metadata", "workout_routes")},
        "sample_quality": _with("SELECT * FROM qualities"),
        "workout_context": _with("SELECT * FROM contexts"),
        "economy_averages": _with(
            "SELECT "
            + ", ".join(
                f"(SELECT round(avg(p.{c}), 6) FROM perf p JOIN workouts w ON w.id = p.id WHERE w.type = 'Running' AND {_span('cur', 'w.start_ts')}) AS avg_{c}"
                for c in ("speed", "power", "vertical_oscillation_cm", "ground_contact_time_ms", "stride_length_m")
            )
            + f", (SELECT round(avg(bpm), 6) FROM hr WHERE type = 'Running' AND {_span('cur', 'start_ts')}) AS avg_hr"
        ),
        "readiness": _composite(
            {
                "rhr": _mean("resting_hr", "bpm", "cur"),
                "rhr0": _mean("resting_hr", "bpm", "base"),
                "hrv": _mean("hrv", "value", "cur"),
                "hrv0": _mean("hrv", "value", "base"),
                "h": f"coalesce({_slept('cur', 'asleep')} / 3600.0::DOUBLE, 0) / 7",
                "e": f"{_slept('cur', 'asleep')}::DOUBLE / nullif({_slept('cur', 'in_bed')}, 0)",
                "l": _total("cur"),
                "l0": _total("base"),
            },
            f""", s AS (SELECT *, {_score(_trend('rhr', 'rhr0', False))} + {_score(_trend('hrv', 'hrv0'))} + {_score(_trend('l', 'l0', False))} + CASE WHEN h < 7 OR coalesce(e < 0.85, FALSE) THEN 1 WHEN h >= 8 THEN -1 ELSE 0 END AS score FROM i),
            r AS (SELECT 'suggests' AS claim_strength, {_evidence(Resting_HR=_signed('rhr - rhr0', 1, ' bpm'), HRV=_signed('hrv - hrv0', 1, ' ms'), Sleep=_fixed('h', 1, ' h/night'), Training_load=_signed('l - l0', 1))},
              score, round(h, 6) AS sleep_hours_per_day, CASE WHEN score >= 2 THEN 'Strained' WHEN score <= -1 THEN 'Fresh' ELSE 'Normal' END AS state, CASE WHEN score >= 2 THEN 'reduce_intensity' WHEN score <= -1 THEN 'push' ELSE 'maintain' END AS action_kind,
              CASE WHEN rhr IS NULL OR hrv IS NULL THEN 'poor' WHEN rhr0 IS NULL OR hrv0 IS NULL THEN 'mixed' ELSE 'high' END AS sample_quality FROM s)""",
            "state, action_kind, sample_quality, score, sleep_hours_per_day",
        ),
        "training_strain": _composite(
            _strain(),
            f""", s AS (SELECT *, CASE WHEN {_trend('rhr', 'rhr0', False)} = 'declining' THEN 1 ELSE 0 END + CASE WHEN {_trend('hrv', 'hrv0')} = 'declining' THEN 1 ELSE 0 END AS penalty FROM i),
            q AS (SELECT *, CASE WHEN load_ratio IS NULL THEN 'unclear' WHEN load_ratio > 1.3 OR penalty >= 2 OR (load_ratio > 1.1 AND penalty >= 1) THEN 'excessive' WHEN load_ratio >= 0.8 AND penalty = 0 THEN 'productive' ELSE 'moderate' END AS state FROM s),
            r AS (SELECT 'suggests' AS claim_strength, {_evidence(**{'Acute:chronic_load': 'n:' + _fixed('load_ratio', 2), 'Recovery_penalty': 'n:penalty', 'Resting_HR': _signed('rhr - rhr0', 1, ' bpm'), 'HRV': _signed('hrv - hrv0', 1, ' ms')})},
              state, penalty, round(load_ratio, 6) AS load_ratio, CASE state WHEN 'productive' THEN 'push' WHEN 'excessive' THEN 'reduce_intensity' ELSE 'maintain' END AS action_kind,
              CASE WHEN load_ratio IS NULL THEN 'poor' WHEN rhr IS NULL OR rhr0 IS NULL OR hrv IS NULL OR hrv0 IS NULL THEN 'mixed' ELSE 'high' END AS sample_quality FROM q)""",
            "state, action_kind, sample_quality, penalty, load_ratio",
        ),
        "recovery_debt": _composite(
            _strain() | {"hours": f"coalesce({_slept('acute', 'asleep')} / 3600.0::DOUBLE, 0)"},
            f""", p AS (SELECT *, greatest(0, 56 - hours) AS d, NOT (hours > 0 OR rhr IS NOT NULL OR hrv IS NOT NULL) AND acute IS NULL AND chronic IS NULL AS poor FROM i),
            s AS (SELECT *, CASE WHEN NOT poor THEN d + greatest(0, coalesce(rhr - rhr0, 0)) / 2 + greatest(0, -coalesce(hrv - hrv0, 0)) / 5 + greatest(0, coalesce(load_ratio, 1) - 1) * 4 END AS score,
              CASE WHEN NOT poor THEN CASE WHEN d >= 4 THEN 1 ELSE 0 END + CASE WHEN coalesce(rhr - rhr0, 0) >= 3 THEN 1 ELSE 0 END + CASE WHEN coalesce(hrv - hrv0, 0) <= -8 THEN 1 ELSE 0 END + CASE WHEN coalesce(load_ratio, 0) >= 1.2 THEN 1 ELSE 0 END END AS n FROM p),
            q AS (SELECT *, CASE WHEN poor THEN 'needs more data' WHEN score >= 7 AND n >= 2 THEN 'accumulating' WHEN score >= 3 AND n <= 1 THEN 'short-term dip' WHEN score >= 3 THEN 'moderate' ELSE 'low' END AS state FROM s),
            m AS (SELECT *, CASE WHEN rhr - rhr0 IS NOT NULL OR hrv - hrv0 IS NOT NULL THEN coalesce('RHR ' || {_signed('rhr - rhr0', 1, ' bpm')}, 'RHR unknown') || ', ' || coalesce('HRV ' || {_signed('hrv - hrv0', 1, ' ms')}, 'HRV unknown') END AS markers FROM q),
            r AS (SELECT CASE WHEN poor THEN 'worth_watching' ELSE 'suggests' END AS claim_strength, CASE WHEN poor THEN 'Sleep_deficit=none; Recovery_markers=none; Training_load=none'
                ELSE {_evidence(Debt_score='n:' + _fixed('score', 1), Sleep_deficit=_fixed('d', 1, ' h'), Recovery_markers='markers', Training_load='n:' + _fixed('load_ratio', 2)).removesuffix(' AS evidence')} END AS evidence,
              state, round(score, 6) AS debt_score, n AS fatigue_signals, CASE state WHEN 'needs more data' THEN 'retest' WHEN 'accumulating' THEN 'reduce_intensity' WHEN 'short-term dip' THEN 'add_sleep' WHEN 'moderate' THEN 'run_easier' ELSE 'maintain' END AS action_kind,
              CASE WHEN poor THEN 'poor' WHEN rhr0 IS NULL OR hrv0 IS NULL OR (acute IS NULL AND chronic IS NULL) THEN 'mixed' ELSE 'high' END AS sample_quality FROM m)""",
            "state, action_kind, sample_quality, debt_score, fatigue_signals",
        ),
        "fitness_trend": _composite(
            {f"{n}{k}": _mean(t, c, w) for n, t, c in (("vo2", "performance", "vo2max"), ("pw", "performance", "power"), ("rhr", "resting_hr", "bpm")) for k, w in (("", "cur"), ("0", "base"))}
            | {"p": _runs("pace_sec_per_km", "paces", "cur"), "p0": _runs("pace_sec_per_km", "paces", "base"), "n": _runs("pace_sec_per_km", "paces", "cur", "count"), "n0": _runs("pace_sec_per_km", "paces", "base", "count")},
            f""", t AS (SELECT *, {_trend('vo2', 'vo20')} AS tv, {_trend('p', 'p0', False, 0.02)} AS tp, {_trend('pw', 'pw0')} AS tw, {_trend('rhr', 'rhr0', False)} AS tr FROM i),
            s AS (SELECT *, -({_score('tv')} + {_score('tp')} + {_score('tw')} + {_score('tr')}) AS score, CASE WHEN tv <> 'improving' THEN 'not leading' WHEN 'improving' IN (tp, tw, tr) THEN 'supported' ELSE 'isolated' END AS vo2_support FROM t),
            q AS (SELECT *, CASE WHEN score >= 2 THEN 'Improving' WHEN score <= -2 THEN 'Declining' WHEN tv = tp AND tp = tw AND tw = tr AND tr = 'insufficient_data' THEN 'Unclear' ELSE 'Flat' END AS state FROM s),
            r AS (SELECT CASE WHEN state = 'Unclear' THEN 'worth_watching' ELSE 'suggests' END AS claim_strength,
              {_evidence(VO2_Max=_signed('vo2 - vo20', 1), **{'Fixed-HR_pace': PACE_TEXT}, Power=_signed('pw - pw0', 1, ' W'), Resting_HR=_signed('rhr - rhr0', 1, ' bpm'))}, state, score, vo2_support, CASE WHEN state = 'Declining' THEN 'run_easier' WHEN state = 'Improving' AND vo2_support = 'supported' THEN 'maintain' WHEN vo2_support = 'isolated' THEN 'watch' ELSE 'maintain' END AS action_kind,
              CASE WHEN vo2 IS NULL AND p IS NULL THEN 'poor' WHEN vo20 IS NULL OR p0 IS NULL OR n < 2 OR n0 < 2 THEN 'mixed' ELSE 'high' END AS sample_quality FROM q)""",
            "state, action_kind, sample_quality, score, vo2_support",
        ),
        "aerobic_efficiency": _composite(
            {"p": _runs("pace_sec_per_km", "paces", "cur"), "p0": _runs("pace_sec_per_km", "paces", "base"), "n": _runs("pace_sec_per_km", "paces", "cur", "count"), "n0": _runs("pace_sec_per_km", "paces", "base", "count"), "d": _runs("decoupling_pct", "decouplings", "cur"), "z": _z2("cur"), "rhr": _mean("resting_hr", "bpm", "cur"), "rhr0": _mean("resting_hr", "bpm", "base")},
            f""", q AS (SELECT *, {_trend('p', 'p0', False, 0.02)} AS state FROM i),
            r AS (SELECT CASE WHEN state = 'insufficient_data' THEN 'worth_watching' ELSE 'suggests' END AS claim_strength,
              {_evidence(**{'Fixed-HR_pace': PACE_TEXT}, Decoupling=_fixed('d', 1, '%'), Z2_share=_whole('z * 100', '%'), Resting_HR=_signed('rhr - rhr0', 1, ' bpm'))}, state, round(p, 6) AS cur_pace, round(p0, 6) AS base_pace, round(d, 6) AS cur_decoupling, round(z, 6) AS z2_ratio, CASE state WHEN 'declining' THEN 'run_easier' WHEN 'insufficient_data' THEN 'retest' ELSE 'maintain' END AS action_kind,
              CASE WHEN p IS NULL OR p0 IS NULL THEN 'poor' WHEN n < 2 OR n0 < 2 THEN 'mixed' ELSE 'high' END AS sample_quality FROM q)""",
            "state, action_kind, sample_quality, cur_pace, base_pace, cur_decoupling, z2_ratio",
        ),
        "load_quality": _composite(
            {"lr": f"{_total('cur')} / ({_total('chronic')} / 4)", "z": _z2("cur"), "d": _runs("decoupling_pct", "decouplings", "cur"), "n": _runs("id", "paces", "cur", "count")},
            f""", q AS (SELECT *, CASE WHEN lr IS NULL OR z IS NULL THEN 'unclear' WHEN lr > 1.3 OR (z < 0.45 AND coalesce(d >= 6, FALSE)) THEN 'high-strain low-quality' WHEN z < 0.45 THEN 'junk intensity' WHEN z >= 0.6 AND coalesce(d < 6, TRUE) THEN 'productive aerobic' ELSE 'mixed' END AS state FROM i),
            r AS (SELECT 'suggests' AS claim_strength, {_evidence(**{'Acute:chronic_load': 'n:' + _fixed('lr', 2)}, Z2_share=_whole('z * 100', '%'), Decoupling=_fixed('d', 1, '%'), Run_consistency='n:n')}, state, round(lr, 6) AS load_ratio, round(z, 6) AS z2_ratio, round(d, 6) AS cur_decoupling, CASE state WHEN 'productive aerobic' THEN 'maintain' WHEN 'junk intensity' THEN 'run_easier' WHEN 'high-strain low-quality' THEN 'reduce_intensity' ELSE 'watch' END AS action_kind,
              CASE WHEN lr IS NULL OR z IS NULL OR n = 0 THEN 'poor' WHEN d IS NULL OR n < 2 THEN 'mixed' ELSE 'high' END AS sample_quality FROM q)""",
            "state, action_kind, sample_quality, load_ratio, z2_ratio, cur_decoupling",
        ),
        "consistency_index": _composite(
            _consistency_parts("cur", "") | _consistency_parts("base", "0"),
            f""", q AS (SELECT *, {_consistency('')} AS a, {_consistency('0')} AS b FROM i),
            m AS (SELECT *, CASE WHEN sleep IS NOT NULL OR rhr IS NOT NULL THEN coalesce({_whole('sleep', ' min sleep')}, 'sleep unknown') || ', ' || coalesce({_fixed('rhr', 1, ' bpm RHR')}, 'RHR unknown') END AS stability FROM q),
            r AS (SELECT 'suggests' AS claim_strength, {_evidence(Consistency_score='n:floor(a + 0.5)', Training_rhythm=f"CAST(n AS VARCHAR) || ' workouts, ' || {_whole('minutes', ' min')}", Daily_basics='n:floor(steps + 0.5)', Recovery_stability='stability')},
              round(a, 6) AS c_score, round(b, 6) AS b_score, {_trend('a', 'b', True, 0.05)} AS direction, CASE WHEN a >= 75 THEN 'strong' WHEN a >= 50 THEN 'mixed' ELSE 'inconsistent' END AS state,
              CASE WHEN a >= 75 THEN 'maintain' WHEN a >= 50 THEN 'watch' ELSE 'maintain' END AS action_kind,
              CASE WHEN steps IS NULL AND n = 0 THEN 'poor' WHEN steps0 IS NULL AND n0 = 0 THEN 'mixed' ELSE 'high' END AS sample_quality FROM m)""",
            "state, action_kind, sample_quality, direction, c_score, b_score",
        ),
        "run_economy": _composite(
            {
                f"{n}{k}": f"(SELECT avg(p.{c}) FROM perf p JOIN workouts w ON w.id = p.id WHERE w.type = 'Running' AND {_span(win, 'w.start_ts')})"
                for n, c in (("v", "speed"), ("w", "power"), ("o", "vertical_oscillation_cm"), ("g", "ground_contact_time_ms"), ("s", "stride_length_m"))
                for k, win in (("", "cur"), ("0", "base"))
            }
            | {f"h{k}": f"(SELECT avg(bpm) FROM hr WHERE type = 'Running' AND {_span(win, 'start_ts')})" for k, win in (("", "cur"), ("0", "base"))},
            f""", t AS (SELECT *, v / nullif(w, 0) AS a, v0 / nullif(w0, 0) AS a0, v / nullif(h, 0) AS b, v0 / nullif(h0, 0) AS b0,
              coalesce(greatest(0, o - 10), 0) + coalesce(greatest(0, g - 300), 0) / 20 + coalesce(greatest(0, 1 - s), 0) * 10 AS m,
              coalesce(greatest(0, o0 - 10), 0) + coalesce(greatest(0, g0 - 300), 0) / 20 + coalesce(greatest(0, 1 - s0), 0) * 10 AS m0 FROM i),
            k AS (SELECT *, {_trend('a', 'a0')} AS ta, {_trend('b', 'b0')} AS tb, {_trend('m', 'm0', False)} AS tm,
              CASE WHEN v IS NULL OR h IS NULL THEN 'poor' WHEN v0 IS NULL OR h0 IS NULL OR w IS NULL OR w0 IS NULL THEN 'mixed' ELSE 'high' END AS sample_quality FROM t),
            q AS (SELECT *, CASE WHEN sample_quality = 'poor' THEN 'insufficient data' WHEN tm = 'declining' OR m - m0 >= 1 THEN 'mechanics' WHEN ta = 'improving' AND tb = 'improving' THEN 'fitness'
              WHEN ta = 'declining' AND tb <> 'improving' THEN 'output' ELSE 'mixed economy' END AS state FROM k),
            r AS (SELECT CASE WHEN sample_quality = 'poor' THEN 'worth_watching' ELSE 'suggests' END AS claim_strength,
              {_evidence(Speed_per_watt=_signed('a - a0', 4), Speed_per_bpm=_signed('b - b0', 4), Mechanics_penalty='n:' + _fixed('m', 1), Output=_fixed('w', 1, ' W'))}, state, sample_quality, round(m, 6) AS c_penalty, round(m0, 6) AS b_penalty, CASE state WHEN 'insufficient data' THEN 'retest' WHEN 'mechanics' THEN 'watch' ELSE 'maintain' END AS action_kind FROM q)""",
            "state, action_kind, sample_quality, c_penalty, b_penalty",
        ),
        "run_fatigue_flags": _with(
            f""", rd AS (SELECT CAST(ts AS DATE) AS day, avg(bpm) AS v FROM resting_hr GROUP BY 1), vd AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM hrv GROUP BY 1),
            f AS (SELECT w.id, w.start_ts, q.sample_quality, d.drift_pct, c.decoupling_pct, a.speed_fade_pct, a.power_fade_pct, x.context_label,
              (SELECT v FROM rd WHERE day = CAST(w.start_ts AS DATE)) AS r1, (SELECT avg(v) FROM rd WHERE day BETWEEN CAST(w.start_ts AS DATE) - 7 AND CAST(w.start_ts AS DATE) - 1) AS r0,
              (SELECT v FROM vd WHERE day = CAST(w.start_ts AS DATE)) AS v1, (SELECT avg(v) FROM vd WHERE day BETWEEN CAST(w.start_ts AS DATE) - 7 AND CAST(w.start_ts AS DATE) - 1) AS v0
              FROM workouts w JOIN qualities q ON q.workout_id = w.id JOIN drifts d ON d.id = w.id JOIN decouplings c ON c.id = w.id JOIN fades a ON a.id = w.id JOIN contexts x ON x.workout_id = w.id WHERE w.type = 'Running'),
            g AS (SELECT *, CASE WHEN sample_quality = 'poor' THEN 'poor_sample_quality' WHEN coalesce(drift_pct, 0) >= 6 OR coalesce(decoupling_pct, 0) >= 6 THEN 'cardiac_drift'
              WHEN coalesce(speed_fade_pct, 0) >= 5 OR coalesce(power_fade_pct, 0) >= 5 THEN 'pacing_fade'
              WHEN {_trend('r1', 'r0', False)} = 'declining' OR {_trend('v1', 'v0')} = 'declining' THEN 'under_recovered' ELSE 'clean_aerobic' END AS diagnosis FROM f)
            SELECT id AS workout_id, start_ts, diagnosis, sample_quality, context_label, {_r('drift_pct', 'decoupling_pct', 'speed_fade_pct', 'power_fade_pct')},
              CASE diagnosis WHEN 'clean_aerobic' THEN 'maintain' WHEN 'poor_sample_quality' THEN 'retest' ELSE 'run_easier' END AS action_kind, diagnosis AS state, 'suggests' AS claim_strength, {CONF},
              {_evidence(HR_drift=_fixed('drift_pct', 1, '%'), Decoupling=_fixed('decoupling_pct', 1, '%'),
                **{'Pace/power_fade': f"nullif(concat_ws(', ', 'speed ' || {_fixed('speed_fade_pct', 1, '%')}, 'power ' || {_fixed('power_fade_pct', 1, '%')}), '')"},
                **{'Pre-run_recovery': f"CASE WHEN r1 IS NULL AND v1 IS NULL THEN 'unknown' ELSE coalesce('RHR ' || {_signed('r1 - r0', 1, ' bpm')}, 'RHR unknown') || ', ' || coalesce('HRV ' || {_signed('v1 - v0', 1, ' ms')}, 'HRV unknown') END"})} FROM g"""
        ).replace(") , rd AS", "), rd AS"),
        "dashboard_series_summary": _with(
            ", d AS ("
            + " UNION ALL ".join(
                f"SELECT '{n}' AS series, CAST(ts AS DATE) AS day, {a}({c}) AS v FROM {t} WHERE {c} IS NOT NULL GROUP BY 1, 2"
                for n, t, c, a in (("resting_hr", "resting_hr", "bpm", "avg"), ("hrv", "hrv", "value", "avg"), ("walking_hr", "walking_hr", "bpm", "avg"), ("vo2max", "performance", "vo2max", "avg"), ("speed", "performance", "speed", "avg"), ("power", "performance", "power", "avg"), ("steps", "steps", "count", "sum"))
            )
            + f") SELECT series, count(*) AS days, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(arg_min(v, day), 6) AS first_value, round(arg_max(v, day), 6) AS latest, round(arg_max(v, day) - arg_min(v, day), 6) AS delta FROM d GROUP BY 1"
        ).replace(") , d AS", "), d AS"),
        "run_context_coverage": _with(
            """SELECT count(*) AS runs, count(*) FILTER (id IN (SELECT workout_id FROM workout_stats)) AS with_stats, count(*) FILTER (id IN (SELECT workout_id FROM workout_routes)) AS with_routes,
            count(*) FILTER (id IN (SELECT workout_id FROM workout_events WHERE type = 'HKWorkoutEventTypePause')) AS with_pauses,
            count(*) FILTER (id IN (SELECT workout_id FROM workout_metadata WHERE key = 'HKIndoorWorkout' AND value = '0')) AS outdoor FROM workouts WHERE type = 'Running'"""
        ),
        "dashboard_training_totals": _with(
            f"""SELECT round((SELECT sum(coalesce(load, 0)) FROM loads WHERE {_span('cur', 'start_ts')}), 3) AS total_load, round((SELECT sum(duration_sec) / 60 FROM loads WHERE {_span('cur', 'start_ts')}), 3) AS minutes,
            (SELECT round(avg(drift_pct), 3) FROM drifts JOIN workouts w USING (id) WHERE w.type = 'Running') AS mean_drift_pct, (SELECT count(drift_pct) FROM drifts JOIN workouts w USING (id) WHERE w.type = 'Running') AS drift_runs"""
        ),
        "run_zone_share": _with(
            """SELECT w.id, round(count(*) FILTER (bpm BETWEEN 115 AND 125) / nullif(count(bpm), 0), 6) AS z2_ratio, round(1 - count(*) FILTER (bpm BETWEEN 115 AND 125) / nullif(count(bpm), 0), 6) AS other_ratio
            FROM (SELECT id FROM workouts WHERE type = 'Running' ORDER BY start_ts DESC, id LIMIT 10) w LEFT JOIN hr ON hr.id = w.id GROUP BY 1"""
        ),
        "ingest_dedup_first_wins": INGEST + "SELECT dedup_key, min(place) AS place FROM rows GROUP BY 1",
        "ingest_incremental_filter": INGEST + "SELECT event_type, count(*) AS n FROM rows WHERE ts >= TIMESTAMP '2024-01-19' GROUP BY 1",
        "ingest_unseen": INGEST + "SELECT event_type, count(*) AS n FROM rows WHERE dedup_key NOT IN (SELECT dedup_key FROM rows WHERE place % 2 = 0) GROUP BY 1",
        "unit_normalisation": "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, "
        + ", ".join(
            f"round({_cases('', picks)}, 6) AS {n}"
            for n, picks in {
                "meters": ["v", "v * 1000", "v * 1609.344::DOUBLE", "v * 0.3048::DOUBLE", "NULL"],
                "kcal": ["v", "v", "v / 4.184::DOUBLE", "NULL"],
                "mps": ["v", "v / 3.6::DOUBLE", "v * 0.44704::DOUBLE", "NULL"],
                "length": ["v", "v / 100", "v / 1000", "NULL"],
                "seconds": ["v", "v * 60", "v * 3600", "NULL"],
                "contact_ms": ["v * 1000", "v"],
            }.items()
        )
        + " FROM l",
        "number_parsing": """SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN 12 WHEN 1 THEN 3.5 WHEN 3 THEN 1000 WHEN 6 THEN 0.5 END AS DOUBLE) AS value,
            CAST(CASE event_id % 7 WHEN 0 THEN 12 WHEN 1 THEN 3.5 WHEN 3 THEN 1000 WHEN 5 THEN 12 WHEN 6 THEN 0.5 END AS DOUBLE) AS prefix FROM events""",
        "sleep_state_map": """SELECT raw, mapped, count(*) AS n FROM events JOIN (VALUES (0, 'Asleep', 'asleep'), (1, 'InBed', 'in_bed'), (2, 'Awake', 'awake'),
            (3, 'HKCategoryValueSleepAnalysisInBed', 'in_bed'), (4, 'HKCategoryValueSleepAnalysisAsleep', 'asleep'), (5, 'HKCategoryValueSleepAnalysisAsleepUnspecified', 'asleep'),
            (6, 'HKCategoryValueSleepAnalysisAsleepCore', 'asleep'), (7, 'HKCategoryValueSleepAnalysisAsleepDeep', 'asleep'), (8, 'HKCategoryValueSleepAnalysisAsleepREM', 'asleep'),
            (9, 'HKCategoryValueSleepAnalysisAwake', 'awake'), (10, 'Dozing', NULL)) v(k, raw, mapped) ON event_id % 11 = k GROUP BY 1, 2""",
        "workout_id_sha1": oracle_ctes("workouts")
        + " SELECT id, sha1(concat_ws('|', 'HKWorkoutActivityType' || type, strftime(date_trunc('millisecond', start_ts), '%Y-%m-%d %H:%M:%S.%g'), strftime(date_trunc('millisecond', end_ts), '%Y-%m-%d %H:%M:%S.%g'))) AS workout_id FROM workouts",
    }
    return out | {"advanced_report": _report(out), "run_metric_summary": _run_metrics(out), "hours_km_series": _hours_km(out), "sleep_page": _sleep_page(out)}
