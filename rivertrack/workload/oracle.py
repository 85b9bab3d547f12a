"""The same results in plain SQL over the given tables, written independently of the operators."""

import csv
from importlib.resources import files

DET = """det AS (
  SELECT user_id AS tag, ts, event_id AS seq, value AS power, CAST(ts AS DATE) AS date,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rkm, event_type AS zone,
         CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' WHEN 'error' THEN '3'
              WHEN 'purchase' THEN '4' WHEN 'signup' THEN '5' END AS station,
         CASE WHEN event_type = 'error' THEN 'Mobile' ELSE 'Fixed' END AS method
  FROM events)"""
TAGS = """tags AS (
  SELECT c_custkey AS tag, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex,
         c_acctbal AS fork_length,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 10 AS INTEGER)) AS tag_ts
  FROM customer)"""
AFTER = f"""{DET}, {TAGS}, aft AS (
  SELECT det.*, tags.sex, tags.fork_length, tags.tag_ts
  FROM det JOIN tags USING (tag) WHERE ts > tag_ts)"""
ORDER = "PARTITION BY tag ORDER BY ts, seq"
LAG_S = f"(epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORDER})) / 1000000.0::DOUBLE"
LAGGED = f"lagged AS (SELECT *, {LAG_S} AS lag_s FROM det)"


def _moves(source, name="moves"):
    return f"""{name} AS (
  SELECT *, abs(rkm - lag(rkm) OVER ({ORDER})) AS distance, {LAG_S} / 86400.0::DOUBLE AS lag_days
  FROM {source})"""


def _rate():
    return "CASE WHEN lag_days <> 0 THEN distance / lag_days END AS rate"


def _key(tag):
    return (
        f"(CASE WHEN {tag} % 2 = 0 THEN '149.500 ' ELSE '149.320 ' END || printf('%03d', {tag}))"
    )


def _lock(source, zone, name):
    return f"""{name} AS (
  SELECT * EXCLUDE (first_seq, first_ts) FROM (
    SELECT *, min(CASE WHEN zone = '{zone}' THEN ts END) OVER (PARTITION BY tag) AS first_ts,
           arg_min(CASE WHEN zone = '{zone}' THEN seq END,
                   CASE WHEN zone = '{zone}' THEN (ts, seq) END)
             OVER (PARTITION BY tag) AS first_seq
    FROM {source})
  WHERE first_ts IS NULL OR zone = '{zone}' OR (ts, seq) <= (first_ts, first_seq))"""


RULES = """rules(tag, station, rkm, methods, ts_from, ts_to) AS (
  SELECT col0, col1, col2, col3, CAST(col4 AS TIMESTAMP), CAST(col5 AS TIMESTAMP) FROM (VALUES
    (1, NULL, NULL, NULL, NULL, NULL),
    (2, '3', NULL, NULL, NULL, NULL),
    (3, NULL, 42.0, NULL, NULL, NULL),
    (5, NULL, NULL, ['Fixed', 'Mobile'], '2024-01-10 00:00:00', NULL),
    (8, NULL, NULL, ['Mobile'], NULL, NULL),
    (13, '1', NULL, NULL, NULL, '2024-01-20 12:00:00'),
    (21, NULL, NULL, NULL, '2024-01-05 00:00:00', '2024-01-15 00:00:00'),
    (34, '4', NULL, ['Fixed'], '2024-01-12 06:30:00', '2024-01-25 00:00:00'),
    (55, '2', NULL, NULL, '2024-01-02 00:00:00', NULL),
    (89, NULL, NULL, ['Fixed'], NULL, '2024-01-28 00:00:00'),
    (144, NULL, NULL, NULL, '2024-01-20 00:00:00', NULL),
    (144, NULL, NULL, NULL, NULL, '2024-01-03 00:00:00')))"""


def _allowed(d, only="TRUE"):
    return f"""NOT EXISTS (
    SELECT 1 FROM rules r WHERE r.tag = {d}.tag AND {only}
      AND (r.station IS NULL OR r.station = {d}.station)
      AND (r.rkm IS NULL OR r.rkm = {d}.rkm)
      AND (r.methods IS NULL OR list_contains(r.methods, {d}.method))
      AND (r.ts_from IS NULL OR {d}.ts >= r.ts_from)
      AND (r.ts_to IS NULL OR {d}.ts <= r.ts_to))"""


def _shipped_rules():
    """The rules that ship with the package, keys padded here as well."""
    text = files("rivertrack").joinpath("data/exclusion_rules.csv").read_text("utf-8")
    rows = []
    for r in csv.DictReader(x for x in text.splitlines() if not x.startswith("#")):
        freq, code = r["tag"].split()
        methods = ", ".join(f"'{m}'" for m in r["methods"].split("|") if m)
        said = [
            f"'{float(freq):.3f} {int(code):03d}'",
            f"'{r['station']}'" if r["station"] else "NULL",
            f"{r['rkm']}::DOUBLE" if r["rkm"] else "NULL::DOUBLE",
            f"[{methods}]" if methods else "NULL::VARCHAR[]",
            *(f"TIMESTAMP '{r[c]}'" if r[c] else "NULL::TIMESTAMP" for c in ("ts_from", "ts_to")),
        ]
        rows.append(f"({', '.join(said)})")
    return f"rules(tag, station, rkm, methods, ts_from, ts_to) AS (VALUES {', '.join(rows)})"


STATIONS = """stations(station, zone, rkm, lat, long) AS (VALUES
    ('1', 'Bulkley River', -0.7::DOUBLE, 55.01835::DOUBLE, -127.3189::DOUBLE),
    ('2', 'Bulkley River', 42.0, 54.78871, -127.1463),
    ('4', 'Nanika River', 214.0, 54.04742, -127.4264),
    ('5', 'Atna River', 226.5, 54.014545, -127.74321),
    ('6', 'Morice Lake', 201.0, 54.10783, -127.4250))"""

_TARGETS = [
    ("fallback", "station = '1'", "hours"),
    ("click", "station = '2'", "days"),
    ("error", "zone = 'error'", "days"),
    ("signup", "zone = 'signup'", "days"),
    ("purchase", "zone = 'purchase'", "days"),
]


def _elapsed(a, b, unit):
    if unit == "hours":
        return f"round_even((epoch_us({a}) - epoch_us({b})) / 1000000.0::DOUBLE / 3600.0, 1)"
    return f"round_even((epoch_us({a}) - epoch_us({b})) / 1000000.0::DOUBLE / 86400.0, 0)"


def _arrivals():
    """One left join per target, on the first row of each."""
    ctes, joins, columns = [], [], []
    for name, where, unit in _TARGETS:
        ctes.append(
            f"{name}_first AS (SELECT tag, ts FROM aft WHERE {where} "
            f"QUALIFY row_number() OVER ({ORDER}) = 1)"
        )
        joins.append(f"LEFT JOIN {name}_first ON {name}_first.tag = tags.tag")
        columns.append(
            f"CAST({name}_first.ts AS DATE) AS {name}_date, "
            f"{_elapsed(f'{name}_first.ts', 'tags.tag_ts', unit)} AS {name}_{unit}"
        )
    return f"""{AFTER}, {", ".join(ctes)}, summary AS (
  SELECT tags.tag, tags.tag_ts, tags.sex, {", ".join(columns)}, tags.fork_length
  FROM tags {" ".join(joins)})"""


def _summary_text():
    return ", ".join(f"{n}_date::VARCHAR AS {n}_date, {n}_{u}" for n, _, u in _TARGETS)


def _timing():
    return ", ".join(
        f"round_even(avg({n}_{u}), 1) AS mean_{n}_{u}, "
        f"round_even(stddev_samp({n}_{u}), 1) AS sd_{n}_{u}, "
        f"(DATE '1970-01-01' + CAST(floor(avg({n}_date - DATE '1970-01-01')) AS INTEGER))::VARCHAR"
        f" AS mean_{n}_date"
        for n, _, u in _TARGETS
    )


_SECTIONS = {
    "upper": "(zone = 'view' AND rkm >= 60)",
    "lake": "(zone = 'error' AND rkm >= 0)",
    "left_arm": "(zone = 'signup' AND rkm >= 30)",
    "right_arm": "(zone = 'purchase' AND rkm >= 50)",
}


def _priority(sections, system, names, source):
    upper, second, third, fourth = names
    pick = f"QUALIFY row_number() OVER ({ORDER}) = 1"
    last = f"SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY tag) AS m FROM {source} WHERE "
    return f"""sets AS (
  SELECT 0 AS p, '{upper}' AS source, * FROM (
    SELECT * FROM {source} WHERE {sections[0]} {pick})
  UNION ALL BY NAME
  SELECT 1 AS p, '{second}' AS source, * EXCLUDE (m) FROM ({last} {system}) WHERE ts = m)
  UNION ALL BY NAME
  SELECT 2 AS p, '{third}' AS source, * FROM (
    SELECT * FROM {source} WHERE {sections[1]} {pick})
  UNION ALL BY NAME
  SELECT 3 AS p, '{fourth}' AS source, * FROM (
    SELECT * FROM {source} WHERE {sections[2]} {pick})),
best AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY tag ORDER BY p, ts, seq) = 1)"""


# of GRS 80: eccentricity, the series of the transverse Mercator projection, rectifying radius
UTM_E = 0.08181919104281579
UTM_SERIES = (
    0.0008377318247344344, 7.608527788826164e-07, 1.1976380191731537e-09, 2.443376242510368e-12,
)
UTM_RADIUS = 6367449.145771048


def _utm(long, lat, prefix, source):
    """Projection in steps, as CTEs ending in ``{prefix}_xy`` with x and y."""
    e = UTM_E
    east = " + ".join(
        f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(UTM_SERIES, 1)
    )
    north = " + ".join(
        f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(UTM_SERIES, 1)
    )
    k = 0.9996 * UTM_RADIUS
    return f"""{prefix}_a AS (
  SELECT *, sin(radians({lat})) AS s, radians({long} + 129.0) AS lam FROM {source}),
{prefix}_b AS (
  SELECT *, sinh(ln((1 + s) / (1 - s)) / 2
                 - {e!r} * ln((1 + {e!r} * s) / (1 - {e!r} * s)) / 2) AS tau FROM {prefix}_a),
{prefix}_c AS (
  SELECT *, atan2(tau, cos(lam)) AS xi,
         asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS eta FROM {prefix}_b),
{prefix}_xy AS (
  SELECT * EXCLUDE (s, lam, tau, xi, eta),
         500000.0 + {k!r} * (eta + {east}) AS x, {k!r} * (xi + {north}) AS y FROM {prefix}_c)"""


PLACED = """placed AS (
  SELECT *, -127.0 - rkm / 100.0 + (power - 100.0) / 10000.0 AS long,
         54.0 + rkm / 100.0 - (power - 100.0) / 10000.0 AS lat FROM det)"""
EXTENTS = """extents(extent, x0, x1, y0, y1) AS (VALUES
  ('Study area', 580000.0::DOUBLE, 660000.0::DOUBLE, 5950000.0::DOUBLE, 6120000.0::DOUBLE),
  ('Study area zoom', 575000, 590000, 5965000, 5990000),
  ('Atna Lake', 576500, 583500, 5984000, 5991000),
  ('SW Morice Lake', 576500, 584000, 5966000, 5973500),
  ('Nanika River', 598500, 603500, 5976000, 5981000),
  ('Morice-Bulkley Confluence, September 22', 638000, 653000, 6023380, 6038380),
  ('Morice-Bulkley Confluence, September 26', 645000, 660000, 6023380, 6038380),
  ('SW Morice Lake, October 4', 575500, 589000, 5963000, 5976500),
  ('Bulkley River', 605700, 655000, 6020000, 6100900),
  ('Morice River', 603000, 655000, 5998000, 6031000),
  ('Morice Lake', 575000, 607000, 5962000, 5999000))"""

VEC = """vec AS (
  SELECT vec_id AS det_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         label FROM embeddings)"""

# downloads of four stations: lines in their order, then the first per folder, tag and hour
_DOWNLOADS = f"""{DET}, lines AS (
  SELECT station AS folder, CASE station WHEN '5' THEN '6' ELSE station END AS station,
         {_key("tag")} AS tag, tag AS number, date_trunc('hour', ts)::TIMESTAMP AS hourly, seq,
         CAST(round(power * 100) AS INTEGER) AS power,
         CASE WHEN tag % 2 = 0 THEN '149.500' ELSE '149.320' END AS freq,
         CASE WHEN rkm IN (13, 77) THEN rkm END AS bad
  FROM det WHERE station IN ('1', '2', '4', '5')),
raw AS (
  SELECT *, hourly AS ts FROM lines WHERE bad IS NULL
  QUALIFY row_number() OVER (PARTITION BY folder, tag, hourly ORDER BY seq) = 1)"""

ORACLE = {
    "detection_tag_join": f"""WITH {DET}, {TAGS}
SELECT tag, ts, seq, station, sex, fork_length, tag_ts FROM det JOIN tags USING (tag)""",
    "after_tagging": f"WITH {AFTER} SELECT tag, ts, seq, station, tag_ts FROM aft",
    "undetected_tags": f"""WITH {DET}, {TAGS}
SELECT DISTINCT tag FROM tags WHERE NOT EXISTS (SELECT 1 FROM det WHERE det.tag = tags.tag)""",
    "dedup_keep_first": f"""WITH {DET}
SELECT tag, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, seq, ts, power FROM det
QUALIFY row_number() OVER (PARTITION BY tag, date_trunc('hour', ts) ORDER BY seq) = 1""",
    "detection_lag": f"WITH {DET}, {LAGGED} SELECT tag, ts, seq, lag_s FROM lagged",
    "min_gap_filter": f"""WITH {DET}, {LAGGED}
SELECT tag, ts, seq, lag_s FROM lagged WHERE lag_s IS NULL OR lag_s >= 3600""",
    "lost_tag_flag": f"""WITH {DET}, {LAGGED}
SELECT tag, ts, seq,
       CASE WHEN lag_s BETWEEN 45000 AND 48600 THEN 'Lost Tag' ELSE method END AS method
FROM lagged""",
    "lost_tags": f"""WITH {DET}, {LAGGED}
SELECT tag, count(DISTINCT tag) AS unique_tags, min(ts) AS earliest FROM lagged
WHERE lag_s BETWEEN 45000 AND 48600 GROUP BY tag""",
    "movement_rates": f"""WITH {DET}, {_moves("det")}
SELECT tag, ts, seq, rkm, distance, lag_days, {_rate()} FROM moves""",
    "impossible_moves": f"""WITH {DET}, {_moves("det")}
SELECT tag, ts, seq, rkm, distance, lag_days FROM moves
WHERE distance > 50 AND distance > lag_days * 100""",
    "speed_filter_fixpoint": f"""WITH RECURSIVE {DET}, numbered AS (
  SELECT tag, ts, seq, rkm, row_number() OVER ({ORDER}) AS rn FROM det),
walk AS (
  SELECT tag, ts, seq, rkm, rn, TRUE AS kept, ts AS at, rkm AS at_rkm FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.tag, n.ts, n.seq, n.rkm, n.rn, ok.v, CASE WHEN ok.v THEN n.ts ELSE w.at END,
         CASE WHEN ok.v THEN n.rkm ELSE w.at_rkm END
  FROM walk w JOIN numbered n ON n.tag = w.tag AND n.rn = w.rn + 1,
  LATERAL (SELECT NOT (abs(n.rkm - w.at_rkm) > 50 AND abs(n.rkm - w.at_rkm)
           > (epoch_us(n.ts) - epoch_us(w.at)) / 86400000000.0::DOUBLE * 100) AS v) ok)
SELECT tag, ts, seq, rkm FROM walk WHERE kept""",
    "terminal_zone_lock": f"""WITH {DET}, {_lock("det", "purchase", "one")},
{_lock("one", "signup", "two")} SELECT tag, ts, seq, zone FROM two""",
    "reach_flag_cumsum": f"""WITH {DET}, flagged AS (
  SELECT *, CASE WHEN zone = 'purchase' AND row_number() OVER (
    PARTITION BY tag, zone ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS flag FROM det)
SELECT tag, ts, seq, zone, CAST(flag AS INTEGER) AS flag, CAST(sum(flag) OVER (
  {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached FROM flagged""",
    "exclusion_rules": f"""WITH {DET}, {RULES}
SELECT tag, ts, seq, station, rkm, method FROM det WHERE {_allowed("det")}""",
    "rules_by_time": f"""WITH {DET}, {RULES}
SELECT tag, ts, seq, station, rkm, method FROM det WHERE {_allowed("det")}
  AND NOT EXISTS (SELECT 1 FROM det m WHERE m.tag = det.tag AND m.method = 'Mobile'
                  AND det.method = 'Fixed' AND det.ts BETWEEN m.ts AND m.ts + INTERVAL 6 HOUR)""",
    "study_rules": f"""WITH {DET}, {_shipped_rules()}, keys AS (
  SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT tag FROM rules)),
d AS (
  SELECT keys.tag, TIMESTAMP '2023-07-04' + 3 * (det.ts - TIMESTAMP '2024-01-01') AS ts, seq,
         CASE WHEN method = 'Mobile' THEN 'Mobile' ELSE station END AS station, method,
         CASE WHEN rkm < 40 THEN -0.7::DOUBLE WHEN rkm < 60 THEN 42 WHEN rkm < 80 THEN 214
              ELSE rkm END AS rkm
  FROM det JOIN keys ON det.tag % n = k)
SELECT tag, ts, seq, station, rkm, method FROM d WHERE {_allowed("d")}""",
    "max_power_per_day": f"""WITH {DET}, peaked AS (
  SELECT *, max(CASE WHEN method = 'Mobile' THEN power END) OVER (PARTITION BY tag, date) AS peak
  FROM det)
SELECT tag, ts, seq, method, power FROM peaked WHERE method <> 'Mobile' OR power = peak""",
    "movement_facts": f"""WITH {AFTER}, {_priority(
        [_SECTIONS["upper"], _SECTIONS["left_arm"], _SECTIONS["right_arm"]],
        f"({_SECTIONS['lake']} OR {_SECTIONS['left_arm']} OR {_SECTIONS['right_arm']})",
        ("upper", "system", "left_arm", "right_arm"), "aft")}, flags AS (
  SELECT tag, min(CASE WHEN station = '1' THEN ts END) AS fallback_ts,
         min(CASE WHEN station = '2' THEN ts END) AS click_ts,
         min(CASE WHEN zone = 'error' THEN ts END) AS error_ts,
         min(CASE WHEN zone = 'signup' THEN ts END) AS signup_ts,
         min(CASE WHEN zone = 'purchase' THEN ts END) AS purchase_ts, TRUE AS present,
         bool_or(rkm = 20) AS at_20, bool_or(rkm >= 20) AS up_20, bool_or(rkm = 40) AS at_40,
         bool_or(rkm >= 40) AS up_40, bool_or(rkm = 60 AND zone = 'signup') AS at_60,
         bool_or(rkm >= 60 AND zone = 'signup') AS up_60,
         bool_or(rkm = 80 AND zone = 'purchase') AS at_80,
         bool_or(rkm >= 80 AND zone = 'purchase') AS up_80,
         {", ".join(f"bool_or({c}) AS in_{n}" for n, c in _SECTIONS.items())},
         count(DISTINCT CASE WHEN station = '3' THEN date END) AS surveys,
         max(CASE sex WHEN 'M' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) AS sex_number
  FROM aft GROUP BY tag)
SELECT flags.*, best.source AS fate_source, best.ts AS fate_ts, best.seq AS fate_seq
FROM flags LEFT JOIN best USING (tag)""",
    "first_arrival": f"""WITH {AFTER}, f AS (SELECT * FROM aft WHERE zone = 'purchase'
  QUALIFY row_number() OVER ({ORDER}) = 1)
SELECT tag, sex, CAST(ts AS DATE)::VARCHAR AS zone_date,
       {_elapsed("ts", "tag_ts", "hours")} AS zone_hours, station, tag_ts FROM f""",
    "arrival_summary": f"""WITH {_arrivals()}
SELECT tag, tag_ts, sex, {_summary_text()}, fork_length FROM summary""",
    "arrival_timing_stats": f"WITH {_arrivals()} SELECT {_timing()} FROM summary",
    "last_detection": f"""WITH {DET} SELECT tag, ts, seq, zone FROM det
QUALIFY row_number() OVER (PARTITION BY tag ORDER BY ts DESC, seq) = 1""",
    "last_detection_ties": f"""WITH {DET}, m AS (
  SELECT *, max(date) OVER (PARTITION BY tag) AS last FROM det)
SELECT tag, ts, seq, date::VARCHAR AS date FROM m WHERE date = last""",
    "priority_union": f"""WITH {AFTER}, {_priority(
        [_SECTIONS["upper"], _SECTIONS["left_arm"], _SECTIONS["right_arm"]],
        f"({_SECTIONS['lake']} OR {_SECTIONS['left_arm']} OR {_SECTIONS['right_arm']})",
        ("upper", "system", "left_arm", "right_arm"), "aft")}
SELECT tag, source, ts, seq, zone, sex, CASE WHEN source <> 'upper' THEN power END AS power
FROM best""",
    "spawner_fate": f"""WITH {AFTER}, {STATIONS}, rows_ AS (
  SELECT {_key("aft.tag")} AS tag, aft.ts, aft.seq, aft.method,
         CASE WHEN method = 'Mobile' THEN 'Mobile' ELSE aft.station END AS station,
         CASE WHEN method <> 'Mobile' THEN s.zone WHEN aft.rkm >= 97 THEN 'Upper Bulkley River'
              WHEN aft.rkm < 30 THEN 'Atna River' WHEN aft.rkm < 60 THEN 'Nanika River'
              ELSE 'Morice Lake' END AS zone
  FROM aft LEFT JOIN stations s USING (station)
  WHERE method = 'Mobile' OR aft.station IN ('1','2','4','5','6')),
{_priority(
        ["(method = 'Mobile' AND zone = 'Upper Bulkley River')",
         "(station = '5' OR method = 'Mobile' AND zone = 'Atna River')",
         "(station = '4' OR method = 'Mobile' AND zone = 'Nanika River')"],
        "(station IN ('4', '5', '6') OR method = 'Mobile' AND "
        "zone IN ('Atna River', 'Nanika River', 'Morice Lake'))",
        ("upper_bulkley", "morice_system", "atna", "nanika"), "rows_")}
SELECT tag, source, ts, seq, station, zone FROM best""",
    "unified_timeline": f"""WITH {DET}, {TAGS}, joined AS (
  SELECT det.*, tags.sex, tags.fork_length, tags.tag_ts FROM det JOIN tags USING (tag))
SELECT CAST(tag AS VARCHAR) AS tag, date::VARCHAR AS date, ts, power, zone, rkm, method, station,
       tag_ts, sex, fork_length,
       CASE WHEN method = 'Mobile' THEN 1152921504606846976 ELSE 0 END + seq AS seq FROM joined
UNION ALL
SELECT CAST(tag AS VARCHAR), CAST(tag_ts AS DATE)::VARCHAR, tag_ts, NULL, 'Tagging', 0.0,
       'Tagging', 'Tagging', tag_ts, sex, fork_length, 2305843009213693952 FROM tags""",
    "zone_assignment": f"""WITH {DET} SELECT tag, seq, rkm, zone,
  CASE WHEN rkm < 10 THEN 'Fallback' WHEN rkm < 40 AND zone = 'view' THEN 'Lower river'
       WHEN zone = 'signup' THEN 'Left arm' WHEN zone = 'purchase' AND rkm >= 50 THEN 'Right arm'
       WHEN rkm BETWEEN 60 AND 80 THEN 'Lake' END AS reach FROM det""",
    "station_lookup": f"""WITH {DET}, {STATIONS}
SELECT det.tag, det.seq, det.station, s.zone, s.rkm, s.lat, s.long
FROM det LEFT JOIN stations s USING (station)""",
    "channel_to_freq": f"""WITH {DET} SELECT tag, seq, CAST(station AS INTEGER) AS channel,
  CASE station WHEN '1' THEN '149.500' WHEN '2' THEN '149.320' WHEN '3' THEN '149.340'
       ELSE 'other' END AS frequency FROM det""",
    "tag_key": f"""WITH {DET}
SELECT seq, CASE WHEN rkm <> 50 THEN {_key("tag")} END AS key FROM det""",
    "tag_key_normalise": f"""WITH {DET}, w AS (
  SELECT seq, tag % 120 AS n, CASE WHEN tag % 120 % 2 = 0 THEN '149.5' ELSE '149.32' END AS f,
         rkm = 3 AS odd FROM det),
t AS (SELECT *, f || ' ' || CASE WHEN odd THEN '3?' ELSE CAST(n AS VARCHAR) END AS written FROM w)
SELECT seq, written,
       CASE WHEN odd THEN written ELSE rpad(f, 7, '0') || ' ' || printf('%03d', n) END AS key,
       CASE WHEN NOT odd AND n BETWEEN 10 AND 99 THEN f || ' 0' || n ELSE written END AS padded
FROM t""",
    "parse_timestamps": f"""WITH {DET}, t AS (
  SELECT seq, rkm < 5 AS bad, ts FROM det)
SELECT seq, CASE WHEN NOT bad THEN CAST(ts AS DATE)::VARCHAR END AS iso_day,
       CASE WHEN NOT bad THEN CAST(ts AS DATE)::VARCHAR END AS us_day,
       CASE WHEN NOT bad THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END AS at,
       CASE WHEN NOT bad THEN CAST(hour(ts) AS BIGINT) END AS hour,
       CASE WHEN NOT bad THEN CAST(date_trunc('minute', ts) AS TIMESTAMP) END AS at_minute
FROM t""",
    "metadata_overrides": """WITH raw AS (
  SELECT o_custkey AS code, CASE WHEN o_orderpriority <> '1-URGENT' THEN '500' END AS freq,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE)::VARCHAR END AS date,
         o_orderkey AS seq FROM orders),
one AS (SELECT code, date, seq, CASE WHEN code IN (19, 88) THEN '500'
                                     WHEN code IN (199, 193, 192, 191, 197, 194) THEN '320'
                                     ELSE freq END AS freq FROM raw),
two AS (SELECT code, freq, seq,
               CASE WHEN code = 13 AND freq = '500' THEN '2024-07-12' ELSE date END AS date
        FROM one)
SELECT '149.' || freq || ' ' || printf('%03d', code) AS tag, date, seq FROM two
WHERE freq IS NOT NULL AND date IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY code, freq ORDER BY seq) = 1""",
    "exclude_test_tags": f"""WITH {DET}, keyed AS (SELECT {_key("tag")} AS tag, ts, seq FROM det)
SELECT * FROM keyed
WHERE tag NOT IN ('149.500 212', '149.500 211', '149.500 012', '149.320 011')""",
    "reject_error_records": f"""WITH {DET}, c AS (
  SELECT seq, CASE rkm WHEN 13 THEN '999' WHEN 77 THEN 'of' ELSE CAST(tag AS VARCHAR) END AS code
  FROM det) SELECT seq, code, code NOT IN ('999', 'of') AS ok FROM c""",
    "length_summary": f"""WITH {TAGS}
SELECT sex, count(*) AS n, round(avg(fork_length), 4) AS mean,
       round(median(fork_length), 4) AS median, round(min(fork_length), 4) AS min,
       round(max(fork_length), 4) AS max, round(stddev_samp(fork_length), 4) AS sd
FROM tags GROUP BY sex""",
    "length_histogram": f"""WITH {TAGS}
SELECT CASE sex WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE 'Unknown' END AS sex,
       CAST(ceil(fork_length / 1000 - 0.5) * 1000 AS DOUBLE) AS bin, count(*) AS n
FROM tags WHERE fork_length BETWEEN -500 AND 9500 GROUP BY 1, 2""",
    "detections_per_station": f"WITH {DET} SELECT station, count(*) AS n FROM det GROUP BY 1",
    "freqs_per_survey": f"""WITH {DET}
SELECT date::VARCHAR AS date, CASE WHEN tag % 2 = 0 THEN '149.500' ELSE '149.320' END AS freq,
       count(*) AS n FROM det WHERE method = 'Mobile' GROUP BY 1, 2""",
    "false_positive_rate": f"""WITH {AFTER},
r AS (SELECT station, count(*) AS raw FROM det GROUP BY 1),
k AS (SELECT station, count(*) AS kept FROM aft GROUP BY 1)
SELECT station, raw, coalesce(kept, 0) AS kept,
       round(1 - coalesce(kept, 0) / raw::DOUBLE, 6) AS false_positive_rate
FROM r LEFT JOIN k USING (station)""",
    "detected_counts": f"""WITH {AFTER}
SELECT (SELECT count(DISTINCT tag) FROM tags) AS tags, count(DISTINCT tag) AS "any",
       count(DISTINCT tag) FILTER (WHERE method <> 'Mobile' AND station <> '3') AS fixed,
       count(DISTINCT tag) FILTER (WHERE method = 'Mobile') AS mobile,
       (SELECT count(DISTINCT tag) FROM tags) - count(DISTINCT tag) AS undetected
FROM aft WHERE method = 'Mobile' OR station IN ('1', '2', '4', '5', '6')""",
    "zone_presence_counts": f"WITH {AFTER}, s AS ("
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS section, tag, sex FROM aft WHERE {c}"
        for n, c in _SECTIONS.items()
    )
    + """) SELECT section, count(*) FILTER (WHERE sex = 'M') AS male,
  count(*) FILTER (WHERE sex = 'F') AS female, count(*) FILTER (WHERE sex IS NULL) AS unknown,
  count(*) AS total FROM s GROUP BY section""",
    "multi_survey_tags": f"""WITH {DET}
SELECT tag, count(DISTINCT date) AS surveys FROM det WHERE station = '3' GROUP BY tag
HAVING count(DISTINCT date) >= 3""",
    "detection_efficiency": f"""WITH {DET}, st(station, r, z) AS (VALUES
  ('20', 20.0, NULL), ('40', 40.0, NULL), ('60', 60.0, 'signup'), ('80', 80.0, 'purchase')),
c AS (
  SELECT st.station, count(DISTINCT CASE WHEN rkm = r THEN tag END) AS at_station,
         count(DISTINCT tag) AS at_or_upstream
  FROM st LEFT JOIN det ON rkm >= r AND (z IS NULL OR zone = z) GROUP BY 1)
SELECT *, round(at_station / at_or_upstream::DOUBLE * 100, 6) AS efficiency FROM c""",
    "project_utm": f"""WITH {VEC},
p AS (SELECT det_id, -127.0 + x AS long, 54.5 + y AS lat FROM vec),
{_utm("long", "lat", "p", "p")} SELECT det_id, round(x, 2) AS x, round(y, 2) AS y FROM p_xy""",
    "nearest_reference_point": f"""WITH {VEC}, pts AS (
  SELECT label AS zone_label, det_id AS idx, x AS px, y AS py FROM vec
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY det_id) = 1),
d AS (SELECT det_id, idx, zone_label,
             sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM vec, pts)
SELECT det_id, idx, zone_label, round(dist, 6) AS dist FROM d
QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY d.dist, idx) = 1""",
    "survey_slice": f"""WITH {DET}, m AS (SELECT * FROM det WHERE method = 'Mobile')
SELECT tag, seq, date::VARCHAR AS date, dense_rank() OVER (ORDER BY m.date) AS survey, rkm
FROM m""",
    "bbox_membership": f"""WITH {VEC}, boxes(extent, x0, x1, y0, y1) AS (VALUES
  ('all', -1.0::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE, 1.0::DOUBLE),
  ('centre', -0.05, 0.05, -0.05, 0.05), ('north', -0.2, 0.2, 0.05, 0.4),
  ('south west', -0.4, 0.0, -0.4, 0.0))
SELECT det_id, x, y, extent FROM vec JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "survey_map": f"""WITH {DET}, {PLACED}, {EXTENTS}, m AS (
  SELECT *, dense_rank() OVER (ORDER BY date) AS survey FROM placed WHERE method = 'Mobile'),
{_utm("long", "lat", "p", "m")}
SELECT tag, seq, survey, extent, round(x, 2) AS x, round(y, 2) AS y
FROM p_xy JOIN extents ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "survey_map_jitter": f"""WITH {DET}, {PLACED}, {EXTENTS}, m AS (
  SELECT *, dense_rank() OVER (ORDER BY date) AS survey FROM placed
  WHERE method = 'Mobile' AND day(date) IN (2, 4, 5, 9, 11, 12, 18, 19, 23, 30)),
{_utm("long", "lat", "p", "m")}, h AS (
  SELECT *, CASE WHEN day(date) = 18 THEN 2000 ELSE 500 END AS far,
         ('0x' || substr(md5(seq || ':1'), 1, 13))::BIGINT::DOUBLE AS h1,
         ('0x' || substr(md5(seq || ':2'), 1, 13))::BIGINT::DOUBLE AS h2 FROM p_xy)
SELECT tag, seq, date::VARCHAR AS date, survey, extent,
       round(x + (h1 / 4503599627370496.0::DOUBLE * 2 - 1) * far, 2) AS x_jitter,
       round(y + (h2 / 4503599627370496.0::DOUBLE * 2 - 1) * far, 2) AS y_jitter
FROM h JOIN extents ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "last_detection_map": f"""WITH {DET}, {PLACED}, {EXTENTS}, m AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY tag ORDER BY ts DESC, seq) = 1),
{_utm("long", "lat", "p", "m")}
SELECT tag, seq, extent, round(x, 2) AS x, round(y, 2) AS y
FROM p_xy JOIN extents ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "jitter_points": f"""WITH {VEC}, h AS (
  SELECT *, ('0x' || substr(md5(det_id || ':1'), 1, 13))::BIGINT::DOUBLE AS h1,
         ('0x' || substr(md5(det_id || ':2'), 1, 13))::BIGINT::DOUBLE AS h2 FROM vec)
SELECT det_id, x, y, label, x + (h1 / 4503599627370496.0::DOUBLE * 2 - 1) * 500 AS x_jitter,
       y + (h2 / 4503599627370496.0::DOUBLE * 2 - 1) * 500 AS y_jitter FROM h""",
    "vertex_attribute_join": """SELECT l_orderkey AS id, l_linenumber AS vertex,
       l_extendedprice AS long, l_quantity AS lat, o_orderpriority AS road_class
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "history_panel": f"""WITH {DET}, r AS (
  SELECT tag, ts, seq, CASE WHEN zone = 'signup' THEN 42.0 ELSE rkm END AS rkm, method, zone,
         upper(zone[1]) || zone[2:] AS location, dense_rank() OVER (ORDER BY tag) AS k FROM det)
SELECT tag, ts, seq, rkm, method, zone, location, (k - 1) // 9 + 1 AS page,
       (k - 1) % 9 + 1 AS panel
FROM r WHERE rkm BETWEEN 5 AND 90""",
    "cleaning_cascade": f"""WITH {AFTER}, {RULES},
gaps AS (SELECT *, {LAG_S} AS lag_s FROM aft),
gated AS (
  SELECT * EXCLUDE (method), CASE WHEN lag_s BETWEEN 45000 AND 48600 THEN 'Lost Tag'
                                  ELSE method END AS method
  FROM gaps WHERE lag_s IS NULL OR lag_s >= 3600),
early AS (SELECT * FROM gated WHERE {_allowed("gated", "r.station IS NOT NULL")}),
{_lock("early", "purchase", "one")}, {_lock("one", "signup", "two")},
late AS (SELECT * FROM two WHERE {_allowed("two", "r.station IS NULL")}),
{_moves("late")},
peaked AS (
  SELECT *, max(CASE WHEN method = 'Mobile' THEN power END) OVER (PARTITION BY tag, date) AS peak
  FROM moves)
SELECT tag, ts, seq, zone, method, rkm, distance, lag_days, {_rate()}, power FROM peaked
WHERE method <> 'Mobile' OR power = peak""",
    "fixed_pipeline": f"""WITH {DET}, {TAGS}, {STATIONS}, raw AS (
  SELECT {_key("tag")} AS tag, tag AS number, ts, seq, station, date FROM det
  WHERE method = 'Fixed'
  QUALIFY row_number() OVER (PARTITION BY station, tag, ts ORDER BY seq) = 1)
SELECT raw.tag, raw.ts, raw.seq, raw.station, s.zone, s.rkm, s.lat, s.long, 'Fixed' AS method,
       tags.sex, tags.tag_ts
FROM raw LEFT JOIN stations s USING (station) JOIN tags ON tags.tag = raw.number
WHERE raw.tag NOT IN ('149.500 212', '149.500 211') AND raw.date >= DATE '2024-01-04'
  AND raw.ts > tags.tag_ts""",
    "mobile_pipeline": f"""WITH {DET}, {TAGS}, {PLACED},
srx AS (
  SELECT tag AS code, ts, seq, long, lat,
         CASE WHEN rkm = 50 THEN NULL WHEN tag % 2 = 0 THEN '149.500 ' ELSE '149.320 ' END AS f
  FROM placed WHERE method = 'Mobile' AND power >= 5),
known AS (
  SELECT f || printf('%03d', code) AS tag, srx.ts, srx.seq, srx.long, srx.lat
  FROM srx JOIN tags ON tags.tag = srx.code WHERE f IS NOT NULL AND srx.ts > tags.tag_ts
  QUALIFY row_number() OVER (PARTITION BY srx.code, srx.ts ORDER BY srx.seq) = 1),
{_utm("long", "lat", "q", "known")},
centre AS (SELECT DISTINCT rkm, -127.0 - rkm / 100.0 AS long, 54.0 + rkm / 100.0 AS lat FROM det),
{_utm("long", "lat", "c", "centre")},
pairs AS (
  SELECT q.tag, q.ts, q.seq, q.x, q.y, c.rkm,
         sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y)) AS dist
  FROM q_xy q, c_xy c)
SELECT tag, ts, seq, CAST(rkm AS BIGINT) AS idx, rkm, round(x, 2) AS x, round(y, 2) AS y,
       round(dist, 3) AS dist FROM pairs
QUALIFY row_number() OVER (PARTITION BY seq ORDER BY pairs.dist, rkm) = 1""",
    "scan_receiver": f"""WITH {DET} SELECT {_key("tag")} AS tag, ts, station,
  CAST(tag AS INTEGER) AS code, CAST(round(power * 100) AS INTEGER) AS power FROM det""",
    "fixed_raw": f"""WITH {_DOWNLOADS}
SELECT folder, 'part' AS file, station, tag, ts, power FROM raw""",
    "fixed_study": f"""WITH {_DOWNLOADS}, {TAGS}, {STATIONS}
SELECT raw.tag, raw.ts, raw.power, raw.station, s.zone, s.rkm, 'Fixed' AS method, tags.sex,
       tags.tag_ts
FROM raw LEFT JOIN stations s USING (station) JOIN tags ON tags.tag = raw.number
WHERE raw.tag NOT IN ('149.500 212', '149.500 211') AND raw.ts >= TIMESTAMP '2024-01-04'
  AND raw.ts > tags.tag_ts""",
    "fixed_quarantine": f"""WITH {_DOWNLOADS}
SELECT folder, CASE WHEN bad = 13 THEN 'no time' ELSE 'no frequency or code' END AS reason,
       strftime(hourly, '%Y-%m-%d ') || CASE WHEN bad = 13 THEN 'xx' ELSE strftime(hourly, '%H') END
       || ':00:00 ' || CASE WHEN folder = '5' THEN '9' ELSE folder END || ' 1 ' || freq
       || ' LOTEK ' || CASE WHEN bad = 77 THEN '??' ELSE CAST(number AS VARCHAR) END || ' '
       || power AS value
FROM lines WHERE bad IS NOT NULL""",
    "fixed_lines": f"""WITH {_DOWNLOADS}
SELECT folder, CASE WHEN bad IS NULL THEN 'kept' ELSE 'rejected' END AS kind, count(*) AS n
FROM lines GROUP BY 1, 2""",
    "csv_rejects": f"""WITH {TAGS}
SELECT 'fork_length' AS "column", fork_length::VARCHAR AS text FROM tags
WHERE fork_length >= 0""",
    "scan_srx": f"""WITH {DET}
SELECT date::VARCHAR AS date, ts, CAST(hour(ts) AS BIGINT) AS hour,
       CAST(station AS INTEGER) AS channel, CAST(tag AS INTEGER) AS code,
       CAST(round(power * 100) AS DOUBLE) AS power,
       CASE WHEN zone <> 'signup'
            THEN round(54.0 + rkm / 100.0 - (power - 100.0) / 10000.0, 6) END AS lat,
       CASE WHEN zone <> 'signup'
            THEN round(-127.0 - rkm / 100.0 + (power - 100.0) / 10000.0, 6) END AS long,
       'part-0' AS station
FROM det WHERE rkm NOT IN (13, 77) AND tag <> 999""",
    "csv_null_tokens": f"""WITH {TAGS}
SELECT tag, sex, CASE WHEN fork_length >= 0 THEN fork_length END AS fork_length,
       CASE WHEN fork_length <= 9000 THEN tag_ts END AS tag_ts FROM tags""",
    "stage_roundtrip": f"""WITH {DET}
SELECT tag, ts, seq, power, date::VARCHAR AS date, rkm, zone, station, method FROM det""",
}
ORACLE["clustered_cascade"] = ORACLE["cleaning_cascade"]  # the same rows, from clustered tables
ORACLE["extent_windows"] = ORACLE["bbox_membership"]  # the same rows, extent by extent
ORACLE["layer_points"] = ORACLE["nearest_reference_point"]  # the same answers, leaf by leaf
