"""The queries in SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from .queries import COORDINATES, GAP_LENGTHS, GIVEN, NAMES, NUMBERS, PERCENT, SEED_DAYS

_FIRST, _LAST = "1995-01-01", "2001-12-31"


def _panel(by: str = "nation") -> str:
    key = "s_nationkey" if by == "nation" else "n_regionkey"
    source = "supplier" if by == "nation" else "supplier JOIN nation ON s_nationkey = n_nationkey"
    return f"""
keyed AS (SELECT s_suppkey, {key} AS key FROM {source}),
calendar AS (SELECT unnest(generate_series(DATE '{_FIRST}', DATE '{_LAST}', INTERVAL 1 DAY))::DATE AS date),
sums AS (SELECT key, l_shipdate::DATE AS date, SUM(l_quantity) AS value FROM lineitem JOIN keyed ON l_suppkey = s_suppkey GROUP BY 1, 2),
panel AS (
  SELECT 's' || lpad(k.key::VARCHAR, 2, '0') AS station, c.date, (c.date - DATE '1970-01-01')::INTEGER AS dn,
         CASE WHEN ((c.date - DATE '1970-01-01') + 37 * k.key) % 97 < 10 THEN NULL ELSE s.value END AS value
  FROM (SELECT DISTINCT key FROM keyed) k CROSS JOIN calendar c LEFT JOIN sums s ON s.key = k.key AND s.date = c.date
)"""


def _fills(source: str, key: str = "station", columns: str = "") -> str:
    """All deterministic fills of a table (station, date, dn, value), as columns."""
    return f"""
means AS (SELECT {key}, COALESCE(AVG(value), 0.0) AS mean FROM {source} GROUP BY {key}),
near AS (
  SELECT p.*, means.mean,
    AVG(value) OVER h AS past, COUNT(value) OVER h AS n_past, AVG(value) OVER s AS season,
    last_value(value IGNORE NULLS) OVER u AS v0, last_value(CASE WHEN value IS NOT NULL THEN dn END IGNORE NULLS) OVER u AS d0,
    first_value(value IGNORE NULLS) OVER d AS v1, first_value(CASE WHEN value IS NOT NULL THEN dn END IGNORE NULLS) OVER d AS d1
  FROM {source} p JOIN means USING ({key})
  WINDOW h AS (PARTITION BY {key}, dayofyear(date) ORDER BY year(date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    s AS (PARTITION BY {key} ORDER BY dn RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING),
    u AS (PARTITION BY {key} ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    d AS (PARTITION BY {key} ORDER BY dn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
filled AS (
  SELECT *, COALESCE(value, mean) AS column_mean,
    COALESCE(value, CASE WHEN n_past >= 2 THEN past END, mean) AS historical_mean,
    COALESCE(value, season, mean) AS seasonal_mean,
    COALESCE(value, CASE WHEN d1 > d0 THEN v0 + (v1 - v0) * (dn - d0) / (d1 - d0) END, v0, v1) AS linear_time
  FROM near
)"""


_WINDOWS = f"""
counts AS (SELECT date, dn, COUNT(value) AS n FROM panel GROUP BY 1, 2),
windows AS (
  SELECT date - {SEED_DAYS - 1} AS start_date, date AS end_date, score FROM (
    SELECT date, SUM(n) OVER w AS score, COUNT(*) OVER w AS n_rows FROM counts
    WINDOW w AS (ORDER BY dn RANGE BETWEEN {SEED_DAYS - 1} PRECEDING AND CURRENT ROW)) WHERE n_rows >= {SEED_DAYS}
),
best AS (SELECT * FROM windows ORDER BY score DESC, end_date LIMIT 1)"""

_OUTSIDE = "outside AS (SELECT p.*, row_number() OVER (PARTITION BY station ORDER BY dn) - 1 AS pos FROM panel p, best WHERE date NOT BETWEEN start_date AND end_date)"


def _greedy(name: str, source: str, length: int, count: str) -> str:
    """Choice of gaps along each station's drawn order."""
    return f"""
size_{name} AS (SELECT station, COUNT(*) AS n_rows, {count} AS wanted FROM {source} GROUP BY station),
drawn_{name} AS (
  SELECT station, wanted, list([s] ORDER BY md5('42|' || station || '|' || s::VARCHAR), s) AS starts
  FROM (SELECT station, wanted, unnest(range(0, n_rows - {length} + 1)) AS s FROM size_{name}) GROUP BY station, wanted
),
plan_{name} AS (
  SELECT station AS at_station, unnest(list_reduce(starts, lambda got, x: CASE WHEN len(got) < wanted AND len(list_filter(got, lambda g: abs(g - x[1]) < {length})) = 0 THEN list_concat(got, x) ELSE got END, []::BIGINT[])) AS start
  FROM drawn_{name}
)"""


def _percent(length: int) -> str:
    return f"GREATEST(floor(COUNT(*) * {PERCENT / 100.0}::DOUBLE / {length}), 1)"


_METRICS = """
  COUNT(*) AS n, round(sqrt(AVG(pow(t - p, 2))), 6) AS rmse, round(AVG(abs(t - p)), 6) AS mae,
  round(CASE WHEN var_pop(t) > 0 THEN 1 - SUM(pow(t - p, 2)) / (var_pop(t) * COUNT(*)) END, 6) AS r2,
  round(CASE WHEN var_pop(t) > 0 THEN 1 - SUM(pow(t - p, 2)) / (var_pop(t) * COUNT(*)) END, 6) AS nse,
  round(1 - sqrt(pow(CASE WHEN stddev_pop(t) * stddev_pop(p) > 0 THEN covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)) ELSE 0 END - 1, 2)
    + pow(CASE WHEN AVG(t) <> 0 THEN AVG(p) / AVG(t) WHEN AVG(p) = 0 THEN 1.0 END - 1, 2)
    + pow(CASE WHEN stddev_pop(t) <> 0 THEN stddev_pop(p) / stddev_pop(t) WHEN stddev_pop(p) = 0 THEN 1.0 END - 1, 2)), 6) AS kge"""


def _leaderboard(methods: tuple[str, ...]) -> str:
    plans = ",".join(_greedy(f"g{n}", "outside", n, _percent(n)) for n in GAP_LENGTHS)
    cells = " UNION ALL ".join(
        f"SELECT '{n}-day_gap|' || station AS series, o.station, date, dn, pos, value AS truth, g.start IS NOT NULL AS is_gap, CASE WHEN g.start IS NULL THEN value END AS value "
        f"FROM outside o LEFT JOIN plan_g{n} g ON g.at_station = o.station AND o.pos >= g.start AND o.pos < g.start + {n}" for n in GAP_LENGTHS)  # fmt: skip
    long = " UNION ALL ".join(f"SELECT split_part(series, '|', 1) AS gap_scenario, '{m}' AS method, truth AS t, {m} AS p FROM filled WHERE is_gap AND truth IS NOT NULL" for m in methods)
    return f"WITH RECURSIVE {_panel()}, {_WINDOWS}, {_OUTSIDE}, {plans}, cells AS ({cells}), {_fills('cells', 'series')} SELECT gap_scenario, method, {_METRICS} FROM ({long}) GROUP BY 1, 2"


def _gap_kinds(contiguous: tuple[int, ...], points: tuple[int, ...]) -> str:
    place = "placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY dn) - 1 AS pos, COUNT(*) OVER (PARTITION BY station) AS n_rows FROM panel)"
    plans = ",".join(_greedy(f"c{n}", "panel", n, f"LEAST(5, COUNT(*) // {n})") for n in contiguous)
    parts = [
        f"SELECT 'contiguous|{n}|' || o.station AS series, date, dn, value AS truth, g.start IS NOT NULL AS is_gap, CASE WHEN g.start IS NULL THEN value END AS value FROM placed o LEFT JOIN plan_c{n} g ON g.at_station = o.station AND pos >= start AND pos < start + {n}"
        for n in contiguous
    ] + [
        f"SELECT 'single_point|{n}|' || station AS series, date, dn, value AS truth, row_number() OVER (PARTITION BY station ORDER BY md5('42|' || station || '|' || pos::VARCHAR), pos) <= floor(n_rows * {n / 365.0!r}::DOUBLE) AS is_gap, CASE WHEN NOT is_gap THEN value END AS value FROM placed"
        for n in points
    ]
    return f"""WITH RECURSIVE {_panel()}, {place}, {plans}, cells AS ({' UNION ALL '.join(parts)}), {_fills('cells', 'series')}
SELECT split_part(series, '|', 1) AS gap_type, split_part(series, '|', 2)::INTEGER AS gap_length, {_METRICS}
FROM (SELECT series, truth AS t, historical_mean AS p FROM filled WHERE is_gap AND truth IS NOT NULL) GROUP BY 1, 2"""


def _fill(method: str) -> str:
    return f"WITH {_panel()}, {_fills('panel')} SELECT station, date::VARCHAR AS date, round({method}, 6) AS filled, value IS NULL AS was_missing FROM filled"


def _values(rows: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in rows) + ") AS t(raw)"


_CLEAN = r"regexp_replace(lower(COALESCE(raw, 'none')), '[''\"`]|\s+', '', 'g')"


def _coordinate(limit: int, negative: str) -> str:
    part = lambda k: f"COALESCE(numbers[{k}]::DOUBLE, 0.0)"
    size = f"(abs({part(1)}) + {part(2)} / 60 + {part(3)} / 3600)"
    sign = f"CASE WHEN letter <> '' THEN letter = '{negative}' ELSE {part(1)} < 0 END"
    return f"(CASE WHEN len(numbers) > 0 THEN CASE WHEN {sign} THEN -{size} ELSE {size} END END)"


_NUMBERS = r"""parsed AS (
  SELECT *, regexp_extract_all(translate(raw, 'o°''"`', '     '), '-?[0-9]+\.?[0-9]*') AS numbers, upper(regexp_extract(raw, '([NSEWnsew])', 1)) AS letter FROM given
)"""

_PLACES = """
ids AS (SELECT DISTINCT s_nationkey AS k, 's' || lpad(s_nationkey::VARCHAR, 2, '0') AS station FROM supplier),
texts AS (
  SELECT station, (18 + k % 7)::VARCHAR || '°' || lpad(((k * 13) % 60)::VARCHAR, 2, '0') || '''' || lpad(((k * 29) % 60)::VARCHAR, 2, '0') || '"' AS lat_text,
    (75 + k % 11)::VARCHAR || '°' || lpad(((k * 17) % 60)::VARCHAR, 2, '0') || '''' || lpad(((k * 7) % 60)::VARCHAR, 2, '0') || '"' AS lon_text FROM ids
),
places AS (
  SELECT 's' || lpad(k::VARCHAR, 2, '0') AS station, 18 + k % 7 + ((k * 13) % 60) / 60.0::DOUBLE + ((k * 29) % 60) / 3600.0::DOUBLE AS lat,
    75 + k % 11 + ((k * 17) % 60) / 60.0::DOUBLE + ((k * 7) % 60) / 3600.0::DOUBLE AS lon FROM ids
),
edges AS (
  SELECT 's' || lpad(a.n_nationkey::VARCHAR, 2, '0') AS station, 's' || lpad(b.n_nationkey::VARCHAR, 2, '0') AS contributor
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey <= a.n_nationkey
  WHERE a.n_nationkey IN (SELECT k FROM ids) AND b.n_nationkey IN (SELECT k FROM ids)
)"""

_ORBIT = """sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS s, su1 * su2 + cu1 * cu2 * cos(lam) AS k"""
_TURN = """CASE WHEN s = 0 THEN 0.0 ELSE cu1 * cu2 * sin(lam) / s END AS sin_a, 1 - sin_a * sin_a AS cos2a,
  CASE WHEN cos2a = 0 THEN 0.0 ELSE k - 2 * su1 * su2 / cos2a END AS m, atan2(s, k) AS sigma"""
_FL = "(1 / 298.257223563::DOUBLE)"
_MINOR = f"(6378137.0::DOUBLE * (1 - {_FL}))"
_DISTANCES = f"""
walk AS (
  SELECT a.station AS target, b.station AS predictor, sin(atan(tan(radians(a.lat)) * (1 - {_FL}))) AS su1, cos(atan(tan(radians(a.lat)) * (1 - {_FL}))) AS cu1,
    sin(atan(tan(radians(b.lat)) * (1 - {_FL}))) AS su2, cos(atan(tan(radians(b.lat)) * (1 - {_FL}))) AS cu2, radians(b.lon) - radians(a.lon) AS gap, radians(b.lon) - radians(a.lon) AS lam, 0 AS n
  FROM places a JOIN places b ON a.station < b.station
  UNION ALL
  SELECT target, predictor, su1, cu1, su2, cu2, gap, gap + (1 - c) * {_FL} * sin_a * (sigma + c * s * (m + c * k * (-1 + 2 * m * m))), n + 1 FROM (
    SELECT *, {_FL} / 16 * cos2a * (4 + {_FL} * (4 - 3 * cos2a)) AS c FROM (SELECT *, {_TURN} FROM (SELECT *, {_ORBIT} FROM walk WHERE n < 50)))
),
half AS (
  SELECT target, predictor, {_MINOR} * big_a * (sigma - big_b * s * (m + big_b / 4 * (k * (-1 + 2 * m * m) - big_b / 6 * m * (-3 + 4 * s * s) * (-3 + 4 * m * m)))) / 1000 AS km FROM (
    SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS big_a, usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS big_b FROM (
      SELECT *, cos2a * (6378137.0::DOUBLE * 6378137.0::DOUBLE - {_MINOR} * {_MINOR}) / ({_MINOR} * {_MINOR}) AS usq FROM (SELECT *, {_TURN} FROM (SELECT *, {_ORBIT} FROM walk WHERE n = 50))))
),
distances AS (SELECT target, predictor, km FROM half UNION ALL SELECT predictor, target, km FROM half UNION ALL SELECT station, station, 0.0 FROM ids)"""


def _weights(kernel: str, connected: str) -> str:
    normal = lambda c: f"CASE WHEN SUM({c}) OVER (PARTITION BY target) > 0 THEN {c} / SUM({c}) OVER (PARTITION BY target) ELSE 0 END"
    return f"""WITH RECURSIVE {_PLACES}, {_DISTANCES},
raw AS (SELECT target, predictor, {kernel} AS wd, {connected} AS wc FROM distances WHERE target <> predictor),
one AS (SELECT *, {normal('wd')} AS nd, {normal('wc')} AS nc FROM raw),
two AS (SELECT target, predictor, 0.5 * nd + 0.5 * nc AS b FROM one)
SELECT target, predictor, round({normal('b')}, 9) AS weight FROM two"""


_CONNECTED = "CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.station = distances.target AND e.contributor = distances.predictor) THEN 1.0::DOUBLE ELSE 0.0 END"

def _knn(by: str) -> str:
    return f"""WITH {_panel(by)}, {_WINDOWS},
seed AS (SELECT panel.* FROM panel, best WHERE date BETWEEN start_date AND end_date),
part AS (SELECT panel.* FROM panel, best WHERE date NOT BETWEEN start_date AND end_date),
stats AS (SELECT station, AVG(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END AS scale
  FROM (SELECT station, COALESCE(value, AVG(value) OVER (PARTITION BY station), 0.0) AS x FROM seed) GROUP BY station)"""


def _knn_fill(by: str, calendar: bool) -> str:
    """Neighbours by the stations' scaled readings and, with ``calendar``, by two scaled calendar columns."""
    angle = "2.0::DOUBLE * pi() * dayofyear(date) / 366.0::DOUBLE"
    more = f"""
days AS (SELECT DISTINCT date, dn, sin({angle}) AS s, cos({angle}) AS c FROM panel),
turns AS (SELECT AVG(s) AS ms, stddev_pop(s) AS ds, AVG(c) AS mc, stddev_pop(c) AS dc FROM days, best WHERE date BETWEEN start_date AND end_date),
turned AS (SELECT ' s' AS station, date, dn, (s - ms) / ds AS z FROM days, turns UNION ALL SELECT ' c', date, dn, (c - mc) / dc FROM days, turns),""" if calendar else ""
    also = lambda columns, inside: f" UNION ALL SELECT {columns} FROM turned, best WHERE date {'' if inside else 'NOT '}BETWEEN start_date AND end_date" if calendar else ""
    return f"""{_knn(by)},{more}
donors AS (SELECT station, dn AS donor, (value - mean) / scale AS dz FROM seed JOIN stats USING (station) WHERE value IS NOT NULL),
asked AS (SELECT station, date, dn, value, mean, scale, CASE WHEN COUNT(value) OVER (PARTITION BY station) = 0 THEN (COALESCE(value, mean) - mean) / scale ELSE (value - mean) / scale END AS z FROM part JOIN stats USING (station)),
from_days AS (SELECT station, dn, z FROM asked WHERE z IS NOT NULL AND dn IN (SELECT dn FROM asked WHERE z IS NULL){also("station, dn, z", False)}),
to_days AS (SELECT * FROM donors{also("station, dn, z", True)}),
pairs AS (SELECT a.dn, d.donor, round(sqrt(((SELECT COUNT(*)::DOUBLE FROM stats) + {2.0 if calendar else 0.0}) / COUNT(*) * SUM(pow(z - dz, 2))), 8) AS distance FROM from_days a JOIN to_days d USING (station) GROUP BY 1, 2),
ranked AS (SELECT a.station, a.dn, dz, row_number() OVER (PARTITION BY a.station, a.dn ORDER BY distance, p.donor) AS k FROM asked a JOIN pairs p ON p.dn = a.dn JOIN donors d ON d.station = a.station AND d.donor = p.donor WHERE a.z IS NULL),
found AS (SELECT station, dn, AVG(dz) AS nz FROM ranked WHERE k <= 5 GROUP BY 1, 2)
SELECT station, date::VARCHAR AS date, round(COALESCE(value, COALESCE(z, nz, 0.0) * scale + mean), 4) AS filled, value IS NULL AS was_missing FROM asked LEFT JOIN found USING (station, dn)"""


def _kalman(params: tuple[float, ...]) -> str:
    """One-step-ahead predictions with given parameters, day by day: state in 9, covariance in 81 numbers."""
    a, b, sa, sb = params
    ar, shock = [a, 0, 0, 0, 0, 0, sa, -a * sa, 0], [1, b, 0, 0, 0, 0, 0, sb, b * sb]
    listed = lambda x: "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in x) + "]"
    return f"""WITH RECURSIVE {_panel()},
series AS (SELECT station, list(value ORDER BY dn) AS ys, list(date ORDER BY dn) AS dates FROM panel GROUP BY station),
coefficients AS (SELECT {listed(ar)} AS ar, {listed(shock)} AS sh),
walk AS (
  SELECT station, 1 AS t, list_transform(range(9), lambda k: 0.0::DOUBLE) AS a, list_transform(range(81), lambda k: CASE WHEN k % 10 = 0 THEN 1e6::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM series
  UNION ALL
  SELECT station, t + 1,
    list_transform(range(9), lambda k: ar[k + 1] * seen[1] + CASE WHEN k < 8 THEN seen[k + 2] ELSE 0.0::DOUBLE END),
    list_transform(range(81), lambda k: moved[(k // 9) * 9 + 1] * ar[k % 9 + 1] + CASE WHEN k % 9 < 8 THEN moved[k + 2] ELSE 0.0::DOUBLE END + sh[k // 9 + 1] * sh[k % 9 + 1])
  FROM (
    SELECT *, list_transform(range(81), lambda k: ar[k // 9 + 1] * less[k % 9 + 1] + CASE WHEN k // 9 < 8 THEN less[k + 10] ELSE 0.0::DOUBLE END) AS moved FROM (
      SELECT station, t, ar, sh,
        CASE WHEN y IS NULL THEN a ELSE list_transform(range(9), lambda k: a[k + 1] + p[k + 1] / p[1] * (y - a[1])) END AS seen,
        CASE WHEN y IS NULL THEN p ELSE list_transform(range(81), lambda k: p[k + 1] - p[k // 9 + 1] / p[1] * p[k % 9 + 1]) END AS less
      FROM (SELECT w.station, t, a, p, ys[t] AS y, ar, sh FROM walk w JOIN series s ON s.station = w.station, coefficients WHERE t < len(ys))
    )
  )
)
SELECT w.station, s.dates[t]::VARCHAR AS date, round(COALESCE(s.ys[t], a[1]), 4) AS filled, s.ys[t] IS NULL AS was_missing FROM walk w JOIN series s ON s.station = w.station"""


def _stump() -> str:
    """The best single split of each station by another one's readings, gaps in them at the seed's means."""
    return f"""{_knn("nation")},
means AS (SELECT station, AVG(value) AS m FROM seed GROUP BY station),
x AS (SELECT s.station AS j, dn, COALESCE(value, m) AS x FROM seed s JOIN means USING (station)),
grouped AS (SELECT s.station AS k, j, x, SUM(value)::DOUBLE AS s, COUNT(*)::DOUBLE AS n FROM seed s JOIN x ON x.dn = s.dn AND j <> s.station WHERE value IS NOT NULL GROUP BY 1, 2, 3),
running AS (SELECT *, SUM(s) OVER o AS s1, SUM(n) OVER o AS n1, SUM(s) OVER p AS s0, SUM(n) OVER p AS n0, lead(x) OVER o AS further FROM grouped WINDOW o AS (PARTITION BY k, j ORDER BY x), p AS (PARTITION BY k, j)),
best_split AS (
  SELECT k, j, (x + further) / 2 AS threshold, s1 / n1 AS low, (s0 - s1) / (n0 - n1) AS high FROM running WHERE further IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) DESC, j, x) = 1
)
SELECT p.station, p.date::VARCHAR AS date, round(COALESCE(p.value, CASE WHEN COALESCE(o.value, m.m) <= threshold THEN low ELSE high END), 6) AS filled, p.value IS NULL AS was_missing
FROM part p JOIN best_split b ON b.k = p.station JOIN part o ON o.station = b.j AND o.dn = p.dn JOIN means m ON m.station = b.j"""


ORACLES = {
    "panel_daily": f"WITH {_panel()} SELECT station, date::VARCHAR AS date, dn, value FROM panel",
    "fill_column_mean": _fill("column_mean"),
    "fill_historical_mean": _fill("historical_mean"),
    "fill_seasonal_mean": _fill("seasonal_mean"),
    "fill_linear_time": _fill("linear_time"),
    "best_window": f"WITH {_panel()}, {_WINDOWS} SELECT start_date::DATE::VARCHAR AS start_date, end_date::VARCHAR AS end_date, score::BIGINT AS score FROM best",
    "rolling_completeness": f"WITH {_panel()}, {_WINDOWS} SELECT start_date::DATE::VARCHAR AS start_date, end_date::VARCHAR AS end_date, score::BIGINT AS score FROM windows",
    "row_completeness": f"WITH {_panel()} SELECT date::VARCHAR AS date, COUNT(value) AS n_readings FROM panel GROUP BY date",
    "null_counts": f"WITH {_panel()} SELECT station, COUNT(*) - COUNT(value) AS n_missing, COUNT(*) AS n_rows FROM panel GROUP BY station",
    "year_completeness": f"""WITH {_panel()}, years AS (SELECT year(date)::INTEGER AS y, COUNT(value) AS n, COUNT(*) AS c FROM panel GROUP BY 1)
SELECT a.y AS first_year, b.y AS last_year, round(100.0::DOUBLE * (a.n + b.n) / (a.c + b.c), 6) AS percent FROM years a JOIN years b ON b.y = a.y + 1 WHERE 100.0::DOUBLE * (a.n + b.n) / (a.c + b.c) >= 20""",
    "temporal_features": f"WITH {_panel()} SELECT date::VARCHAR AS date, round(sin(2.0::DOUBLE * pi() * dayofyear(date) / 366.0::DOUBLE), 9) AS day_of_year_sin, round(cos(2.0::DOUBLE * pi() * dayofyear(date) / 366.0::DOUBLE), 9) AS day_of_year_cos FROM calendar",
    "clean_names": f"""WITH given AS ({_values(NAMES)} UNION ALL SELECT ' ' || upper(p_name) || '''s' || chr(9) || '`X" ' FROM part UNION ALL SELECT NULL)
SELECT raw, CASE {_CLEAN} WHEN 'parmanpur' THEN 'paramanpur' WHEN 'bamnidih' THEN 'bamnidhi' ELSE {_CLEAN} END AS clean FROM given""",
    "parse_dms": f"""WITH {_PLACES}, given AS ({_values(COORDINATES)} UNION ALL SELECT lat_text FROM texts UNION ALL SELECT lon_text FROM texts), {_NUMBERS},
found AS (SELECT raw, {_coordinate(90, 'S')} AS lat, {_coordinate(180, 'W')} AS lon FROM parsed)
SELECT raw, round(CASE WHEN lat BETWEEN -90 AND 90 THEN lat END, 9) AS latitude, round(CASE WHEN lon BETWEEN -180 AND 180 THEN lon END, 9) AS longitude FROM found""",
    "coerce_numeric": f"""WITH given AS ({_values(NUMBERS)} UNION ALL SELECT o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END FROM orders)
SELECT raw, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS number FROM given""",
    "canonical_stations": f"WITH {_PLACES} SELECT station FROM places WHERE lat < 23",
    "contrib_edges": f"WITH {_PLACES} SELECT station, contributor FROM edges",
    "connectivity": f"WITH {_PLACES} SELECT a.station AS target, b.station AS predictor, CASE WHEN e.station IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS w FROM ids a CROSS JOIN ids b LEFT JOIN edges e ON e.station = a.station AND e.contributor = b.station",
    "distance_matrix": f"WITH RECURSIVE {_PLACES}, {_DISTANCES} SELECT target, predictor, round(km, 6) AS km FROM distances",
    "weights_inverse": _weights("1 / (km + 1e-9)", _CONNECTED),
    "weights_exp": _weights("exp(-0.01::DOUBLE * km)", _CONNECTED),
    "weights_no_contrib": _weights("1 / (km + 1e-9)", "0.0::DOUBLE"),
    "gaps_points": f"""WITH {_panel()}, placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY dn) - 1 AS pos, COUNT(*) OVER (PARTITION BY station) AS n_rows FROM panel),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY md5('42|' || station || '|' || pos::VARCHAR), pos) AS k FROM placed)
SELECT station, date::VARCHAR AS date, value AS true_value FROM ranked WHERE k <= floor(n_rows * {30 / 365.0!r}::DOUBLE)""",
    "gaps_contiguous": f"WITH RECURSIVE {_panel()}, {_greedy('a', 'panel', 7, 'LEAST(5, COUNT(*) // 7)')} SELECT at_station AS station, start::INTEGER AS start, (start + 7)::INTEGER AS stop FROM plan_a",
    "gaps_by_percent": f"WITH RECURSIVE {_panel()}, {_greedy('a', 'panel', 30, _percent(30))} SELECT at_station AS station, start::INTEGER AS start, (start + 30)::INTEGER AS stop FROM plan_a",
    "seed_eval_split": f"""WITH {_panel()}, {_WINDOWS} SELECT CASE WHEN date BETWEEN start_date AND end_date THEN 'seed' ELSE 'evaluation' END AS part, COUNT(*) AS n_rows, COUNT(value) AS n_readings, MIN(dn) AS first_dn, MAX(dn) AS last_dn FROM panel, best GROUP BY 1""",
    "metrics_historical": _leaderboard(("historical_mean",)),
    "metrics_seasonal": _leaderboard(("seasonal_mean",)),
    "metrics_linear": _leaderboard(("linear_time",)),
    "metrics_leaderboard": _leaderboard(("column_mean", "historical_mean", "seasonal_mean", "linear_time")),
    "metrics_gap_kinds": _gap_kinds((7, 30), (30, 90)),
    "metrics_gap_kinds_all": _gap_kinds((7, 14, 30, 60, 180), (30, 60, 90, 180)),
    "plot_series": f"""WITH RECURSIVE {_panel()}, placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY dn) - 1 AS pos FROM panel), {_greedy('a', 'panel', 7, 'LEAST(5, COUNT(*) // 7)')},
cells AS (SELECT o.station, date, dn, value AS truth, g.start IS NOT NULL AS is_gap, CASE WHEN g.start IS NULL THEN value END AS value FROM placed o LEFT JOIN plan_a g ON g.at_station = o.station AND pos >= start AND pos < start + 7),
{_fills('cells')}, drawn AS (SELECT station FROM (SELECT DISTINCT at_station AS station FROM plan_a) ORDER BY md5('42|' || station) LIMIT 3)
SELECT station, date::VARCHAR AS date, truth AS true_value, is_gap, round(linear_time, 6) AS filled FROM filled WHERE station IN (SELECT station FROM drawn)""",
    "scale_stats": f"{_knn('region')} SELECT station, round(mean, 6) AS mean, round(scale, 6) AS scale FROM stats",
    "knn_fill": _knn_fill("region", False),
    "knn_fill_calendar": _knn_fill("nation", True),
    "forest_stump": _stump(),
    "kalman_given": _kalman(GIVEN),
}

_BLOCKS = f"""
ends AS (SELECT MIN(date) AS first, MAX(date) AS last FROM panel),
walk AS (
  SELECT 'backward' AS direction, 0 AS step, start_date::DATE AS s, end_date::DATE AS e FROM best UNION ALL SELECT 'forward', 0, start_date::DATE, end_date::DATE FROM best
  UNION ALL
  SELECT direction, step + 1, CASE direction WHEN 'backward' THEN GREATEST(s - 366, first) ELSE e + 1 END::DATE, CASE direction WHEN 'backward' THEN s - 1 ELSE LEAST(e + 366, last) END::DATE
  FROM walk, ends WHERE CASE direction WHEN 'backward' THEN s > first ELSE e < last END
)"""
ORACLES["block_plan_chain"] = f"WITH RECURSIVE {_panel()}, {_WINDOWS}, {_BLOCKS} SELECT direction, step, s::VARCHAR AS start_date, e::VARCHAR AS end_date FROM walk WHERE step > 0"
ORACLES["block_plan_expand"] = f"WITH RECURSIVE {_panel()}, {_WINDOWS}, {_BLOCKS} SELECT step, MIN(s)::VARCHAR AS start_date, MAX(e)::VARCHAR AS end_date, COUNT(*) AS n_blocks FROM walk WHERE step > 0 GROUP BY step"


def _held(source: str, ranged: bool = True) -> str:
    more = ", 0::BIGINT AS n_outside" if ranged else ""
    return f"WITH {_panel()}, {_WINDOWS}, {_OUTSIDE} SELECT station, COUNT(*) AS n_rows, COUNT(*) - COUNT(value) AS n_missing, 0::BIGINT AS n_left, 0::BIGINT AS n_changed, 0::BIGINT AS n_marked_wrong{more} FROM {source} GROUP BY station"


ORACLES |= {name: _held("outside") for name in ("forest_base", "forest_custom", "forest_vanilla", "forest_chained_equations")}
ORACLES |= {name: _held("panel") for name in ("seed_and_fill", "chaining", "expanding")}
ORACLES["kalman_fill"] = _held("panel", False)
ORACLES["evaluation"] = f"""WITH plain AS ({_leaderboard(("linear_time", "historical_mean"))}),
methods AS (SELECT unnest(['forest_chaining', 'forest_expanding', 'forest_seed_only', 'forest_vanilla', 'forest_chained_equations', 'knn_k5', 'kalman_sarima', 'linear_interpolation', 'historical_mean']) AS method),
scenarios AS (SELECT gap_scenario, MAX(n) AS n FROM plain GROUP BY 1)
SELECT s.gap_scenario, m.method, s.n, 5::INTEGER AS n_metrics, NULL::VARCHAR AS error, p.rmse
FROM scenarios s CROSS JOIN methods m LEFT JOIN plain p ON p.gap_scenario = s.gap_scenario AND m.method = CASE p.method WHEN 'linear_time' THEN 'linear_interpolation' ELSE p.method END"""
