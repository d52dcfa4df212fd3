"""SQL (DuckDB) for the registered queries: common table expressions of the test cube and what is computed from it."""

from __future__ import annotations

THRESHOLDS = {"a": 0.3, "b": 0.25, "c": 0.4}
EPS, MIN_SAMPLES = 1.5, 4


def _labels(m: str, threshold: float) -> str:
    """Density clusters of the points beyond a threshold: sel_, link_, core_, reach_, raw_ and labels_ of map m."""
    return f"""
sel_{m} AS MATERIALIZED (SELECT cell_id, t_idx, cell_id * 1000 + t_idx AS id, y_idx, x_idx, dts, CASE WHEN dts < 0 THEN -1 ELSE 1 END AS sign
  FROM dts JOIN cells USING (cell_id) WHERE abs(dts) > {threshold}),
link_{m} AS MATERIALIZED (SELECT a.id AS k, b.id AS o FROM sel_{m} a JOIN sel_{m} b
  ON (a.t_idx-b.t_idx)*(a.t_idx-b.t_idx) + (a.y_idx-b.y_idx)*(a.y_idx-b.y_idx) + (a.x_idx-b.x_idx)*(a.x_idx-b.x_idx) <= {EPS * EPS}),
core_{m} AS MATERIALIZED (SELECT k FROM link_{m} GROUP BY k HAVING count(*) >= {MIN_SAMPLES}),
near_{m} AS MATERIALIZED (SELECT k, o FROM link_{m} WHERE k IN (SELECT k FROM core_{m}) AND o IN (SELECT k FROM core_{m})),
reach_{m}(k, o) AS (SELECT k, k FROM core_{m} UNION SELECT r.k, n.o FROM reach_{m} r JOIN near_{m} n ON r.o = n.k),
comp_{m} AS MATERIALIZED (SELECT k, min(o) AS component FROM reach_{m} GROUP BY k),
every_{m} AS (SELECT k, component FROM comp_{m} UNION ALL
  SELECT e.o, c.component FROM (SELECT o, min(k) AS k FROM link_{m} WHERE k IN (SELECT k FROM core_{m}) AND o NOT IN (SELECT k FROM core_{m}) GROUP BY o) e JOIN comp_{m} c ON c.k = e.k),
raw_{m} AS (SELECT s.cell_id, s.t_idx, coalesce(e.num, -1) AS cluster FROM sel_{m} s LEFT JOIN (SELECT k, dense_rank() OVER (ORDER BY component) - 1 AS num FROM every_{m}) e ON e.k = s.id),
rank_{m} AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster DESC) - 1 AS new FROM raw_{m} WHERE cluster >= 0 GROUP BY cluster),
labels_{m} AS MATERIALIZED (SELECT r.cell_id, r.t_idx, coalesce(k.new, -1) AS cluster FROM raw_{m} r LEFT JOIN rank_{m} k USING (cluster))"""


CUBE = """
WITH RECURSIVE
li AS MATERIALIZED (SELECT CAST(l_suppkey % 8 AS INTEGER) AS y_idx, CAST(l_partkey % 8 AS INTEGER) AS x_idx, year(l_shipdate) * 12 + month(l_shipdate) AS mo, l_quantity AS q FROM lineitem),
dm AS MATERIALIZED (SELECT min(mo) AS m0, max(mo) - min(mo) + 1 AS n_t FROM li),
grid AS MATERIALIZED (SELECT CAST(y_idx * 8 + x_idx AS BIGINT) AS cell_id, y_idx, x_idx, CAST(mo - m0 AS INTEGER) AS t_idx,
  sum(q) + CASE WHEN mo - m0 >= 40 AND y_idx < 2 THEN 500.0 ELSE 0.0 END AS v FROM li, dm GROUP BY y_idx, x_idx, mo, m0),
times AS (SELECT CAST(unnest(range(0, n_t)) AS INTEGER) AS t_idx FROM dm),
cells AS (SELECT CAST(c AS BIGINT) AS cell_id, CAST(c // 8 AS INTEGER) AS y_idx, CAST(c % 8 AS INTEGER) AS x_idx, -78.75 + 22.5 * (c // 8) AS lat, -157.5 + 45.0 * (c % 8) AS lon FROM range(0, 64) t(c)),
status AS (SELECT cell_id, count(v) AS n_valid, min(v) = max(v) AS constant, count(v) = 0 AS all_null, count(v) < any_value(n_t) AND min(v) <> max(v) AS gappy,
  count(v) = any_value(n_t) AND min(v) <> max(v) AS valid FROM grid, dm GROUP BY cell_id),
lens AS (SELECT unnest(range(5, n_t // 3 + 1)) AS l, n_t FROM dm),
seg AS (SELECT l, 0 AS d, unnest(range(0, n_t // l)) AS k, 0 AS o FROM lens UNION ALL SELECT l, 1, unnest(range(0, n_t // l)), n_t - l * (n_t // l) FROM lens),
steps AS MATERIALIZED (SELECT l, d, k, unnest(range(k * l + o, k * l + o + l)) AS t FROM seg),
slope AS MATERIALIZED (SELECT cell_id, l, d, k, (l * sum(CAST(t AS DOUBLE) * v) - sum(CAST(t AS DOUBLE)) * sum(v)) / (l * sum(CAST(t AS DOUBLE) * t) - sum(CAST(t AS DOUBLE)) * sum(CAST(t AS DOUBLE))) AS slope
  FROM grid JOIN status USING (cell_id) JOIN steps ON steps.t = grid.t_idx WHERE valid GROUP BY cell_id, l, d, k),
med AS (SELECT cell_id, l, median(slope) AS med FROM slope GROUP BY cell_id, l),
mad AS (SELECT cell_id, l, any_value(med) AS med, median(abs(slope - med)) AS mad FROM slope JOIN med USING (cell_id, l) GROUP BY cell_id, l),
vote AS MATERIALIZED (SELECT cell_id, l, d, k, CASE WHEN abs(slope - med) > 3 * mad THEN sign(slope - med) ELSE 0 END AS vote FROM slope JOIN mad USING (cell_id, l)),
cov AS (SELECT cell_id, t, sum(vote) AS votes, count(*) AS n FROM vote JOIN steps USING (l, d, k) GROUP BY cell_id, t),
dts AS MATERIALIZED (SELECT cell_id, CAST(t AS INTEGER) AS t_idx, votes / max(n) OVER (PARTITION BY cell_id) AS dts FROM cov),
beyond AS (SELECT cell_id, t_idx, abs(dts) AS size, t_idx - row_number() OVER (PARTITION BY cell_id ORDER BY t_idx) AS run FROM dts WHERE abs(dts) > 0.3),
runs AS (SELECT *, max(size) OVER (PARTITION BY cell_id, run) AS top FROM beyond),
lpk AS (SELECT cell_id, min(t_idx) FILTER (WHERE size = top) AS a, max(t_idx) AS b FROM (SELECT *, min(CASE WHEN size = top THEN t_idx END) OVER (PARTITION BY cell_id, run) AS s FROM runs) WHERE top - size <= 1e-12 AND t_idx >= s GROUP BY cell_id, run),
local_peaks AS (SELECT p.cell_id, CAST(a + (b - a) // 2 AS INTEGER) AS t_idx, CASE WHEN d.dts < 0 THEN -1 ELSE 1 END AS sign, d.dts FROM lpk p JOIN dts d ON d.cell_id = p.cell_id AND d.t_idx = a + (b - a) // 2),
tops AS (SELECT cell_id, t_idx, abs(dts) AS size, max(abs(dts)) OVER (PARTITION BY cell_id) AS top FROM dts),
plat AS (SELECT cell_id, t_idx, t_idx - row_number() OVER (PARTITION BY cell_id ORDER BY t_idx) AS run FROM tops WHERE top - size <= 1e-12),
gpk AS (SELECT cell_id, min(t_idx) AS a, max(t_idx) AS b FROM (SELECT *, min(run) OVER (PARTITION BY cell_id) AS lead FROM plat) WHERE run = lead GROUP BY cell_id),
global_peaks AS MATERIALIZED (SELECT p.cell_id, CAST(a + (b - a) // 2 AS INTEGER) AS t_idx, CASE WHEN d.dts < 0 THEN -1 ELSE 1 END AS sign, d.dts FROM gpk p JOIN dts d ON d.cell_id = p.cell_id AND d.t_idx = a + (b - a) // 2),""" + ",".join(
    _labels(m, t) for m, t in THRESHOLDS.items()
) + """,
labels AS (SELECT * FROM labels_a),
members AS (SELECT * FROM labels_a WHERE cluster >= 0),
foot AS MATERIALIZED (SELECT DISTINCT cluster, cell_id FROM members),
maps AS (SELECT 'a' AS map, * FROM labels_a UNION ALL SELECT 'b', * FROM labels_b UNION ALL SELECT 'c', * FROM labels_c),
dens AS (SELECT cluster, t_idx, count(DISTINCT cell_id) / 64.0 AS density FROM members GROUP BY cluster, t_idx),
cser AS MATERIALIZED (SELECT cluster, t_idx, avg(v) AS mean, median(v) AS med FROM foot JOIN grid USING (cell_id) GROUP BY cluster, t_idx),
noise AS (SELECT cell_id FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM members)),
dense AS (SELECT c.cell_id, t.t_idx, coalesce(l.cluster, -1) AS cluster FROM cells c CROSS JOIN times t LEFT JOIN labels l ON l.cell_id = c.cell_id AND l.t_idx = t.t_idx),
wgs AS (SELECT cell_id, (6378.137 / sqrt(1 - (1 - (6356.752 * 6356.752) / (6378.137 * 6378.137)) * sin(radians(lat)) * sin(radians(lat)))) AS n, radians(lat) AS p, radians(lon) AS q FROM cells),
xyz AS (SELECT cell_id, n * cos(p) * cos(q) AS x, n * cos(p) * sin(q) AS y, (6356.752 * 6356.752) / (6378.137 * 6378.137) * n * sin(p) AS z FROM wgs)
"""


def hp(n: int, lat: str, lon: str) -> str:
    """HEALPix ring index as SQL."""
    z, tt = f"sin(radians({lat}))", f"(fmod(fmod(radians({lon}), 2*pi()) + 2*pi(), 2*pi()) / (pi()/2))"
    jp, jm = f"CAST(floor({n}*(0.5+{tt}) - 0.75*{n}*{z}) AS BIGINT)", f"CAST(floor({n}*(0.5+{tt}) + 0.75*{n}*{z}) AS BIGINT)"
    ring = f"({n}+1+{jp}-{jm})"
    odd = f"(1 - ((({ring}) % 2) + 2) % 2)"
    place = f"((CAST(floor(({jp}+{jm}-{n}+{odd}+1)/2.0) AS BIGINT) % {4 * n} + {4 * n}) % {4 * n})"
    belt = f"({2 * n * (n - 1)} + ({ring}-1)*{4 * n} + {place})"
    tp, s = f"({tt} - floor({tt}))", f"({n}*sqrt(3*(1-abs({z}))))"
    cr = f"(CAST(floor({tp}*{s}) AS BIGINT) + CAST(floor((1-{tp})*{s}) AS BIGINT) + 1)"
    cp = f"(CAST(floor({tt}*{cr}) AS BIGINT) % (4*{cr}))"
    return f"CASE WHEN abs({z}) <= 2.0/3 THEN {belt} WHEN {z} > 0 THEN 2*{cr}*({cr}-1)+{cp} ELSE {12 * n * n} - 2*{cr}*({cr}+1) + {cp} END"


KINDS = {"l": "CAST({c} AS BIGINT)", "d": "ROUND(CAST({c} AS DOUBLE), 6) + 0.0", "b": "CAST({c} AS BOOLEAN)", "s": "CAST({c} AS VARCHAR)"}


def shaped(columns: str, inner: str) -> str:
    """The query with every column cast to a plain type; `columns`: name:kind separated by spaces."""
    wanted = [c.split(":") for c in columns.split()]
    return f"{CUBE}SELECT {', '.join(f'{KINDS[k].format(c=f'"{c}"')} AS "{c}"' for c, k in wanted)} FROM ({inner}) q"
