"""Plain SQL for the registered queries, written independently of the DataFrame plans."""

PIXELS = """
px AS (
  SELECT 'events' AS stream_id, event_id AS seq, epoch_us(ts) AS timestamp_us,
         CAST(user_id % 24 AS INTEGER) AS x,
         CAST((event_id * 7 + user_id) % 18 AS INTEGER) AS y,
         event_type IN ('click', 'purchase') AS polarity, value
  FROM events)
"""
EVENT = "stream_id, seq, timestamp_us, x, y, polarity"
HOUR = 3_600_000_000
DAY = 24 * HOUR
IDLE = 8 * HOUR
SIX = 6 * HOUR
THREE = 3 * HOUR


def _with(*parts: str, recursive: bool = False) -> str:
    *tables, body = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([PIXELS, *tables])} {body}"


SUPPORTED = f"""
EXISTS (SELECT 1 FROM {{src}} o WHERE o.seq < e.seq AND o.timestamp_us >= e.timestamp_us - {HOUR}
        AND o.x BETWEEN e.x - 2 AND e.x + 2
        AND (o.x - e.x) * (o.x - e.x) + (o.y - e.y) * (o.y - e.y) BETWEEN 1 AND 4)
"""

# The sweep chain: the next sweep is the first event later than the last one plus the idle time.
SWEEPS = f"""
sweeps AS (
  SELECT min(timestamp_us) AS c FROM px WHERE timestamp_us > {IDLE}
  UNION ALL
  SELECT (SELECT min(timestamp_us) FROM px WHERE timestamp_us > c + {IDLE})
  FROM sweeps WHERE c IS NOT NULL)
"""

WINDOWS = f"""
w AS (SELECT *, CAST(timestamp_us // {SIX} AS BIGINT) AS window_id FROM px),
cells AS (
  SELECT stream_id, window_id, x AS cx, y AS cy, count(*) AS n,
         CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y,
         min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
  FROM w GROUP BY ALL)
"""
LABELS = """
reach AS (
  SELECT window_id, cx, cy, CAST(cx AS BIGINT) * 65536 + cy AS label FROM cells
  UNION
  SELECT c.window_id, c.cx, c.cy, r.label FROM reach r JOIN cells c
    ON c.window_id = r.window_id AND abs(c.cx - r.cx) <= 1 AND abs(c.cy - r.cy) <= 1),
lab AS (SELECT window_id, cx, cy, min(label) AS label FROM reach GROUP BY ALL),
clu AS (
  SELECT stream_id, window_id, label, CAST(sum(n) AS BIGINT) AS event_count,
         count(*) AS cell_count, sum(sum_x) / sum(n) AS centroid_x, sum(sum_y) / sum(n) AS centroid_y,
         min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y
  FROM cells JOIN lab USING (window_id, cx, cy) GROUP BY stream_id, window_id, label)
"""

BOUNDS = """
b AS (SELECT min_by(timestamp_us, seq) AS origin_us, max_by(timestamp_us, seq) AS last_us,
             max(seq) AS last_seq FROM px)
"""
TICKS = f"""
grid AS (
  SELECT unnest(generate_series(1, CAST((last_us - origin_us) // {THREE} AS BIGINT))) AS tick,
         origin_us FROM b),
fire AS (
  SELECT g.tick, g.origin_us + g.tick * {THREE} AS tick_us, f.timestamp_us AS fired_us, f.seq AS fired_seq
  FROM grid g ASOF JOIN px f ON f.timestamp_us >= g.origin_us + g.tick * {THREE})
"""
MEMBERS = f"""
members AS (
  SELECT e.*, fire.tick, fire.tick_us FROM px e JOIN fire
    ON e.timestamp_us BETWEEN fire.fired_us - {SIX} AND fire.tick_us AND e.seq <= fire.fired_seq
  UNION ALL
  SELECT e.*, CAST((last_us - origin_us) // {THREE} AS BIGINT) + 1 AS tick, last_us AS tick_us
  FROM px e, b WHERE e.timestamp_us >= last_us - {SIX})
"""

ORACLE = {
    "polarity_filter": _with(f"SELECT {EVENT} FROM px WHERE (polarity <> TRUE) = TRUE"),
    "background_filter": _with(f"SELECT {EVENT} FROM px e WHERE {SUPPORTED.format(src='px')}"),
    "static_cleanup": _with(
        SWEEPS, "SELECT 'events' AS stream_id, c AS cleanup_us FROM sweeps WHERE c IS NOT NULL", recursive=True
    ),
    "static_filter": _with(
        SWEEPS,
        """prev AS (
          SELECT *, x // 4 AS sx, y // 4 AS sy,
                 lag(timestamp_us) OVER (PARTITION BY x // 4, y // 4 ORDER BY seq) AS prev_us FROM px)""",
        "swept AS (SELECT p.*, s.c FROM prev p ASOF LEFT JOIN sweeps s ON s.c <= p.timestamp_us)",
        f"""opened AS (
          SELECT *, sum(CASE WHEN prev_us IS NULL OR coalesce(c - prev_us > {IDLE}, FALSE) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY sx, sy ORDER BY seq) AS session FROM swept)""",
        f"""SELECT {EVENT},
              timestamp_us - min(timestamp_us) OVER s >= {DAY} AND row_number() OVER s >= 8 AS is_static
            FROM opened WINDOW s AS (PARTITION BY sx, sy, session ORDER BY seq)""",
        recursive=True,
    ),
    "filter_chain": _with(
        "neg AS (SELECT * FROM px WHERE (polarity <> TRUE) = FALSE)",
        f"bg AS (SELECT * FROM neg e WHERE {SUPPORTED.format(src='neg')})",
        f"""st AS (
          SELECT *, timestamp_us - min(timestamp_us) OVER s >= {DAY} AND row_number() OVER s >= 10 AS is_static
          FROM bg WINDOW s AS (PARTITION BY x // 4, y // 4 ORDER BY seq))""",
        f"SELECT {EVENT} FROM st WHERE NOT is_static",
    ),
    "cell_counts": _with(
        f"""SELECT stream_id, CAST(timestamp_us // {SIX} AS BIGINT) AS window_id,
              CAST(x // 2 AS INTEGER) AS cx, CAST(y // 2 AS INTEGER) AS cy, count(*) AS n,
              CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y,
              min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
            FROM px GROUP BY ALL"""
    ),
    "window_components": _with(WINDOWS, LABELS, "SELECT * FROM clu", recursive=True),
    "tiled_components": _with(WINDOWS, LABELS, "SELECT * FROM clu", recursive=True),
    "best_cluster": _with(
        WINDOWS,
        LABELS,
        """SELECT *, round(least(event_count / 5.0, 1.0) * sqrt(least(
                event_count / ((max_x - min_x + 1) * (max_y - min_y + 1)), 1.0)), 6) AS confidence
           FROM clu WHERE event_count >= 5 AND cell_count >= 3
           QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY event_count DESC, label) = 1""",
        recursive=True,
    ),
    "daily_best_cluster": _with(
        WINDOWS.replace(str(SIX), str(DAY)).replace(
            "x AS cx, y AS cy", "CAST(x // 2 AS INTEGER) AS cx, CAST(y // 2 AS INTEGER) AS cy"
        ),
        LABELS,
        """SELECT *, round(least(event_count / 5.0, 1.0) * sqrt(least(
                event_count / ((max_x - min_x + 1) * (max_y - min_y + 1)), 1.0)), 6) AS confidence
           FROM clu WHERE event_count >= 5 AND cell_count >= 3
           QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY event_count DESC, label) = 1""",
        recursive=True,
    ),
    "rolling_ticks": _with(
        BOUNDS,
        TICKS,
        f"""SELECT 'events' AS stream_id, tick, tick_us, fired_us, fired_seq FROM fire
            WHERE fired_us - {SIX} <= tick_us""",
    ),
    "rolling_members": _with(
        BOUNDS,
        TICKS,
        MEMBERS,
        """SELECT stream_id, tick, tick_us, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq
           FROM members GROUP BY ALL""",
    ),
    "rolling_ideal": _with(
        BOUNDS,
        TICKS,
        f"""m AS (
          SELECT e.stream_id, g.tick, g.origin_us + g.tick * {THREE} AS tick_us FROM px e JOIN grid g
            ON e.timestamp_us BETWEEN g.origin_us + g.tick * {THREE} - {SIX} AND g.origin_us + g.tick * {THREE}
          UNION ALL
          SELECT e.stream_id, CAST((last_us - origin_us) // {THREE} AS BIGINT) + 1, last_us
          FROM px e, b WHERE e.timestamp_us >= last_us - {SIX})""",
        "SELECT stream_id, tick, tick_us, count(*) AS n FROM m GROUP BY ALL",
    ),
}

SHRUNK = """
sh AS (SELECT stream_id, seq, CAST(timestamp_us // 100000 AS BIGINT) AS timestamp_us, x, y, polarity, value FROM px)
"""
BEST = """
best AS (
  SELECT *, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h FROM clu
  WHERE event_count >= 5 AND cell_count >= 3
  QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY event_count DESC, label) = 1)
"""


def _lens(source: str, x: str, y: str, keep: str) -> list[str]:
    """Eight rounds of the lens inversion, one table per round."""
    k1, k2, p1, p2, k3 = -0.07, 0.11, -0.0003, -0.0002, -0.07
    tables = [f"u0 AS (SELECT {keep}, ({x} - 12.0) / 20.0 AS x0, ({y} - 9.0) / 21.0 AS y0, x0 AS rx, y0 AS ry FROM {source})"]
    for i in range(1, 9):
        tables.append(
            f"""u{i} AS (SELECT {keep}, x0, y0,
              (x0 - (2 * {p1} * rx * ry + {p2} * (r2 + 2 * rx * rx))) / (1 + r2 * ({k1} + r2 * ({k2} + r2 * {k3}))) AS rx,
              (y0 - ({p1} * (r2 + 2 * ry * ry) + 2 * {p2} * rx * ry)) / (1 + r2 * ({k1} + r2 * ({k2} + r2 * {k3}))) AS ry
              FROM (SELECT *, rx * rx + ry * ry AS r2 FROM u{i - 1}))"""
        )
    return tables


STILL = """
hop AS (SELECT *, unnest(generate_series((timestamp_us + 99999) // 100000, (timestamp_us + 300000) // 100000)) AS window_id FROM sh),
still AS (SELECT *, (timestamp_us - (window_id * 100000 - 300000)) / 300000.0 AS age FROM hop),
mc AS (
  SELECT stream_id, window_id, CAST(x // 3 AS INTEGER) AS cx, CAST(y // 3 AS INTEGER) AS cy, count(*) AS n,
         sum(age) / count(*) AS mean_age, count(*) FILTER (age < 0.25) AS early
  FROM still GROUP BY ALL),
scored AS (SELECT *, avg(mean_age) FILTER (n >= 3) OVER (PARTITION BY window_id) AS window_age FROM mc),
late AS (SELECT * FROM scored WHERE n >= 3 AND mean_age - window_age > 0.12)
"""
LATE_LABELS = """
spread AS (
  SELECT window_id, cx, cy, CAST(cx AS BIGINT) * 65536 + cy AS label FROM late
  UNION
  SELECT c.window_id, c.cx, c.cy, r.label FROM spread r JOIN late c
    ON c.window_id = r.window_id AND abs(c.cx - r.cx) <= 1 AND abs(c.cy - r.cy) <= 1),
marked AS (SELECT window_id, cx, cy, min(label) AS label FROM spread GROUP BY ALL),
support AS (
  SELECT l.stream_id, l.window_id, l.cx, l.cy, CAST(coalesce(sum(o.early), 0) AS BIGINT) AS early_support
  FROM late l LEFT JOIN mc o ON o.window_id = l.window_id AND abs(o.cx - l.cx) <= 1 AND abs(o.cy - l.cy) <= 1
  GROUP BY ALL)
"""
SAMPLES = """
smp AS (
  SELECT t - min(t) OVER () AS t, (v % 1.0 - 0.5) * 0.4 AS gx, (v / 10 % 1.0 - 0.5) * 0.4 AS gy, (v / 100 % 1.0 - 0.5) * 0.4 AS gz
  FROM (SELECT timestamp_us * 1e-6 AS t, arg_min(value, seq) AS v FROM sh GROUP BY 1)),
iv AS (
  SELECT t AS t0, lead(t) OVER o AS t1, gx, gy, gz,
         lead(gx) OVER o AS nx, lead(gy) OVER o AS ny, lead(gz) OVER o AS nz
  FROM smp WINDOW o AS (ORDER BY t))
"""
# A single turning axis: orientation is an angle, its running sum the product of all turns.
ANGLES = """
turn AS (
  SELECT *, coalesce(sum((gy + ny) * (t1 - t0) * 0.5) OVER (ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a0,
         sum((gy + ny) * (t1 - t0) * 0.5) OVER (ORDER BY t0) AS a1
  FROM iv WHERE t1 IS NOT NULL),
org AS (SELECT min(timestamp_us) AS o, max(timestamp_us) AS l FROM sh),
win AS (
  SELECT window_id, o + window_id * 100000 AS end_us, o + window_id * 100000 - 300000 AS start_us,
         (window_id * 100000) * 1e-6 AS end_s, (window_id * 100000 - 300000) * 1e-6 AS start_s
  FROM (SELECT o, unnest(generate_series(4, CAST(floor(((l - o) * 1e-6 * 1e6 - 100000) / 100000 + 1e-9) AS BIGINT))) AS window_id FROM org)),
rows AS (
  SELECT w.*, e.seq, e.x, e.y,
         least(greatest((e.timestamp_us - w.start_us) / 300000.0 * 600, 0.0), 600.0) AS pos,
         least(CAST(floor(pos) AS BIGINT), 599) AS bin
  FROM sh e JOIN win w ON e.timestamp_us BETWEEN w.start_us AND w.end_us),
asked AS (
  SELECT window_id, seq, 0 AS part, start_s + (end_s - start_s) * bin / 600 AS t FROM rows
  UNION ALL
  SELECT window_id, seq, 1, CASE WHEN bin = 599 THEN end_s ELSE start_s + (end_s - start_s) * (bin + 1) / 600 END FROM rows
  UNION ALL
  SELECT window_id, seq, 2, end_s FROM rows),
ang AS (
  SELECT q.window_id, q.seq, q.part, (q.t - v.t0) / (v.t1 - v.t0) AS f,
         2 * atan2(sin(a0 / 2) * (1 - f) + sin(a1 / 2) * f, cos(a0 / 2) * (1 - f) + cos(a1 / 2) * f) AS a
  FROM asked q ASOF JOIN turn v ON v.t0 <= q.t),
abc AS (
  SELECT window_id, seq, max(a) FILTER (part = 0) AS p, max(a) FILTER (part = 1) AS q, max(a) FILTER (part = 2) AS r
  FROM ang GROUP BY ALL),
ok AS (
  SELECT w.window_id, NOT EXISTS (
    SELECT 1 FROM iv WHERE t1 - t0 > 0.05 AND t1 >= w.start_s AND t0 <= w.end_s) AS covered FROM win w),
ray AS (
  SELECT rows.*, covered, pos - bin AS f, (x - 12.0) / 20.0 AS rx, (y - 9.0) / 21.0 AS ry, p - r AS d0, q - r AS d1
  FROM rows JOIN abc USING (window_id, seq) JOIN ok USING (window_id)),
vec AS (
  SELECT *, CASE WHEN covered THEN (cos(d0) * rx + sin(d0)) * (1 - f) + (cos(d1) * rx + sin(d1)) * f ELSE rx END AS vx,
         CASE WHEN covered THEN (cos(d0) - sin(d0) * rx) * (1 - f) + (cos(d1) - sin(d1) * rx) * f ELSE 1.0 END AS vz
  FROM ray)
"""
# Both versions of every window, as windows 2 w (unturned) and 2 w + 1 (turned).
TURNED = """
pt AS (
  SELECT window_id * 2 + kind AS window_id, pos / 600 AS age,
         CASE kind WHEN 1 THEN 20.0 * vx / vz + 12.0 ELSE 20.0 * rx + 12.0 END AS px,
         CASE kind WHEN 1 THEN 21.0 * (CASE WHEN covered THEN ry * (1 - f) + ry * f ELSE ry END) / vz + 9.0
                   ELSE 21.0 * ry + 9.0 END AS py
  FROM vec, (VALUES (0), (1)) AS k(kind)),
placed AS (
  SELECT *, CAST(floor(floor(px) / 3) AS INTEGER) AS cx, CAST(floor(floor(py) / 3) AS INTEGER) AS cy
  FROM pt WHERE px >= 0 AND px < 24 AND py >= 0 AND py < 18),
mc AS (
  SELECT (SELECT min(stream_id) FROM sh) AS stream_id, window_id, cx, cy, count(*) AS n,
         sum(age) / count(*) AS mean_age, count(*) FILTER (age < 0.25) AS early
  FROM placed GROUP BY ALL),
scored AS (SELECT *, avg(mean_age) FILTER (n >= 3) OVER (PARTITION BY window_id) AS window_age FROM mc),
late AS (SELECT * FROM scored WHERE n >= 3 AND mean_age - window_age > 0.12)
"""
TURNED_TABLES = """
flag AS (
  SELECT window_id, cx, cy,
         count(*) OVER r >= 2 AND count(*) FILTER (early_support < 3) OVER r >= count(*) OVER r * 0.1 AS keep
  FROM support JOIN marked USING (window_id, cx, cy) WINDOW r AS (PARTITION BY window_id, label)),
hits AS (SELECT window_id, count(*) AS n FROM placed JOIN flag USING (window_id, cx, cy) WHERE keep GROUP BY ALL),
corner AS (
  SELECT window_id, floor(px / 3) + i AS ix, floor(py / 3) + j AS iy,
         (CASE i WHEN 1 THEN px / 3 - floor(px / 3) ELSE 1 - (px / 3 - floor(px / 3)) END)
         * (CASE j WHEN 1 THEN py / 3 - floor(py / 3) ELSE 1 - (py / 3 - floor(py / 3)) END) AS v
  FROM pt, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS c(i, j)
  WHERE px >= 0 AND py >= 0 AND px / 3 < 7 AND py / 3 < 5),
energy AS (
  SELECT window_id, round(sum(v * v), 6) AS focus
  FROM (SELECT window_id, ix, iy, sum(v) AS v FROM corner GROUP BY ALL) GROUP BY ALL),
total AS (SELECT window_id, count(*) AS events FROM vec GROUP BY ALL)
"""
KALMAN = f"""
z AS (
  SELECT *, row_number() OVER (ORDER BY timestamp_us) AS rn FROM (
    SELECT stream_id, window_id * 50000 AS timestamp_us, (w + h) / 2.0 AS pixel_diameter,
           20.0::DOUBLE * 0.07::DOUBLE / ((w + h) / 2.0) AS z_m, (centroid_x - 12.0) * z_m / 20.0 AS x_m,
           (centroid_y - 9.0) * z_m / 21.0 AS y_m,
           least(event_count / 5.0, 1.0) * sqrt(least(event_count / (w * h), 1.0)) AS confidence
    FROM best)),
k AS (
  SELECT rn, timestamp_us AS t, x_m AS px, y_m AS py, z_m AS pz, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz,
         1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11 FROM z WHERE rn = 1
  UNION ALL
  SELECT rn, t, px + vx * dt + k0 * (x_m - px - vx * dt), py + vy * dt + k0 * (y_m - py - vy * dt),
         pz + vz * dt + k0 * (z_m - pz - vz * dt), vx + k1 * (x_m - px - vx * dt),
         vy + k1 * (y_m - py - vy * dt), vz + k1 * (z_m - pz - vz * dt),
         (1 - k0) * a, (1 - k0) * b, c - k1 * b
  FROM (
    SELECT *, a / (a + 0.02) AS k0, b / (a + 0.02) AS k1 FROM (
      SELECT z.rn, z.timestamp_us AS t, x_m, y_m, z_m, px, py, pz, vx, vy, vz,
             greatest((z.timestamp_us - k.t) * 1e-6, 1e-6) AS dt,
             p00 + 2 * dt * p01 + dt * dt * p11 + 0.05 * dt * dt AS a, p01 + dt * p11 AS b, p11 + 0.05 AS c
      FROM k JOIN z ON z.rn = k.rn + 1)))
"""


def _codec(words: int, time: str) -> str:
    return _with(
        SHRUNK,
        f"""SELECT stream_id, CAST(seq // 4096 AS BIGINT) AS block,
              CAST(((row_number() OVER (PARTITION BY seq // 4096 ORDER BY seq) - 1) * {words} + {words - 1}) * 32 AS BIGINT) AS seq,
              {time} AS timestamp_us, x, y, polarity FROM sh""",
    )


ORACLE |= {
    "pixel_mask": _with(
        f"SELECT {EVENT} FROM px WHERE (x, y) NOT IN ((0, 0), (7, 3), (23, 17), (12, 9))"
    ),
    "clip_range": _with(
        f"""SELECT {EVENT} FROM px WHERE timestamp_us BETWEEN {1_704_067_200_000_000 + 3 * DAY}
            AND {1_704_067_200_000_000 + 8 * DAY}"""
    ),
    "accepted_flags": _with(
        "pos AS (SELECT * FROM px WHERE NOT polarity)",
        f"ok AS (SELECT seq FROM pos e WHERE {SUPPORTED.format(src='pos')})",
        f"SELECT {EVENT}, seq IN (SELECT seq FROM ok) AS accepted FROM px",
    ),
    "evenly_spaced": _with(
        f"""d AS (SELECT stream_id, CAST(timestamp_us // {DAY} AS BIGINT) AS window_id, seq,
              row_number() OVER (PARTITION BY timestamp_us // {DAY} ORDER BY seq) - 1 AS r,
              count(*) OVER (PARTITION BY timestamp_us // {DAY}) - 1 AS last FROM px)""",
        """SELECT stream_id, window_id, seq FROM d
           WHERE last < 10 OR list_contains(list_transform(range(0, 10), lambda i: i * last // 9), r)""",
    ),
    "comparison_panels": _with(
        SHRUNK, STILL,
        "p AS (SELECT *, unnest(CASE WHEN polarity THEN [0, 1, 2] ELSE [0, 1, 3] END) AS panel FROM still)",
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, panel, CAST(x // 2 AS INTEGER) AS bx,
             CAST(y // 2 AS INTEGER) AS by, count(*) AS n,
             CAST(floor(255.0 * (1 - exp(-least(count(*), 255) / 2.0))) AS INTEGER) AS level FROM p GROUP BY ALL""",
    ),
    "hop_counts": _with(
        f"""h AS (SELECT *, unnest(generate_series((timestamp_us + {2 * HOUR} - 1) // {2 * HOUR},
                                            (timestamp_us + {SIX}) // {2 * HOUR})) AS window_id FROM px)""",
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, count(*) AS n, count(*) FILTER (polarity) AS positive
           FROM h GROUP BY ALL""",
    ),
    "density_panel": _with(
        f"""SELECT stream_id, CAST(timestamp_us // {SIX} AS BIGINT) AS window_id, CAST(x // 2 AS INTEGER) AS bx,
              CAST(y // 2 AS INTEGER) AS by, count(*) AS n,
              CAST(floor(255.0 * (1 - exp(-least(count(*), 255) / 2.0))) AS INTEGER) AS level
            FROM px GROUP BY ALL"""
    ),
    "pixel_last_color": _with(
        f"f AS (SELECT *, {SUPPORTED.format(src='px')} AS ok FROM px e)",
        f"""SELECT stream_id, CAST(timestamp_us // {DAY} AS BIGINT) AS window_id, x, y,
              arg_max(CAST(CASE WHEN ok AND NOT polarity THEN 16777215 WHEN ok THEN 3170559
                   WHEN NOT polarity THEN 4210752 ELSE 1581120 END AS INTEGER), seq) AS colour
            FROM f GROUP BY ALL""",
    ),
    "time_range": _with(
        """SELECT stream_id, arg_min(timestamp_us, seq) AS first_us, arg_max(timestamp_us, seq) AS last_us, count(*) AS events
           FROM px GROUP BY ALL"""
    ),
    "topn_detections": ORACLE["best_cluster"] + " ORDER BY window_id LIMIT 25",
    "index_percentile": _with(
        """s AS (SELECT polarity, list_sort(list(value)) AS v, count(*) AS n FROM px WHERE value IS NOT NULL GROUP BY ALL)""",
        """SELECT polarity, v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50,
              v[least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1] AS p90,
              v[least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) + 1] AS p95, v[n] AS max, n FROM s""",
    ),
    "recent_median": _with(
        WINDOWS, LABELS, BEST,
        """l AS (SELECT stream_id, window_id, w AS size,
                 list_sort(list(w) OVER (ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS v FROM best)""",
        "SELECT stream_id, window_id, size, v[len(v) // 2 + 1] AS median FROM l",
        recursive=True,
    ),
    "deadline_misses": _with(
        f"""SELECT stream_id, CAST(timestamp_us // {DAY} AS BIGINT) AS window_id, count(*) AS updates,
              count(*) FILTER (value > 10.0) AS misses, max(value) AS max_ms FROM px GROUP BY ALL"""
    ),
    "ball_depth": _with(
        WINDOWS, LABELS, BEST,
        """SELECT stream_id, window_id, (w + h) / 2.0::DOUBLE AS pixel_diameter, round(20.0::DOUBLE * 0.07::DOUBLE / pixel_diameter, 9) AS z_m,
             round((centroid_x - 12.0) * (20.0::DOUBLE * 0.07::DOUBLE / pixel_diameter) / 20.0, 9) AS x_m,
             round((centroid_y - 9.0) * (20.0::DOUBLE * 0.07::DOUBLE / pixel_diameter) / 21.0, 9) AS y_m FROM best""",
        recursive=True,
    ),
    "bbox_depth": _with(
        WINDOWS, LABELS, BEST,
        """deep AS (SELECT *, w * h * pi() / 4 AS area, 20.0 * sqrt(pi() * 0.25 * 0.25 / (w * h * pi() / 4)) AS z FROM best)""",
        *_lens("deep", "centroid_x", "centroid_y", "stream_id, window_id, area, z"),
        """SELECT stream_id, window_id, round(area, 6) AS pixel_area, round(rx * z, 6) AS x_m, round(ry * z, 6) AS y_m,
             round(z, 6) AS z_m FROM u8 WHERE z BETWEEN 0.05 AND 30""",
        recursive=True,
    ),
    "smoothed_path": _with(
        WINDOWS, LABELS, BEST, KALMAN,
        """SELECT z.stream_id, z.timestamp_us, pixel_diameter::DOUBLE AS pixel_diameter, round(confidence, 9) AS confidence,
             round(x_m, 9) AS x_m, round(y_m, 9) AS y_m, round(z_m, 9) AS z_m,
             round(px, 9) AS smooth_x_m, round(py, 9) AS smooth_y_m, round(pz, 9) AS smooth_z_m,
             round(vx, 9) AS vx_mps, round(vy, 9) AS vy_mps, round(vz, 9) AS vz_mps,
             round(sqrt(vx * vx + vy * vy + vz * vz), 9) AS speed_mps FROM z JOIN k USING (rn)""",
        recursive=True,
    ),
    "undistort": _with(
        *_lens("px", "x", "y", "seq"), "SELECT seq, round(rx, 8) AS ray_x, round(ry, 8) AS ray_y FROM u8"
    ),
    "imu_bracket": _with(
        SHRUNK, SAMPLES,
        """pt AS (SELECT DISTINCT CAST(timestamp_us // 10000 AS BIGINT) AS slot,
                  (slot * 10000 + 5000) * 1e-6 - (SELECT min(timestamp_us) FROM sh) * 1e-6 AS t FROM sh)""",
        "hit AS (SELECT *, (t - t0) / (t1 - t0) AS f FROM pt ASOF JOIN iv ON t0 <= t WHERE t1 - t0 <= 0.05)",
        """SELECT slot, round(gx * (1 - f) + nx * f, 8) AS gx, round(gy * (1 - f) + ny * f, 8) AS gy,
             round(gz * (1 - f) + nz * f, 8) AS gz FROM hit""",
    ),
    "compensated_points": _with(
        SHRUNK, SAMPLES, ANGLES,
        """SELECT window_id, seq, covered, round(20.0 * vx / vz + 12.0, 4) AS px,
             round(21.0 * (CASE WHEN covered THEN ry * (1 - f) + ry * f ELSE ry END) / vz + 9.0, 4) AS py FROM vec""",
    ),
    "turned_foreground": _with(
        SHRUNK, SAMPLES, ANGLES, TURNED, LATE_LABELS, TURNED_TABLES,
        """SELECT (SELECT min(stream_id) FROM sh) AS stream_id, CAST(t.window_id AS BIGINT) AS window_id, events,
             coalesce(h.n, 0) AS foreground_off, coalesce(g.n, 0) AS foreground_on,
             e.focus AS focus_off, d.focus AS focus_on
           FROM total t LEFT JOIN hits h ON h.window_id = 2 * t.window_id LEFT JOIN hits g ON g.window_id = 2 * t.window_id + 1
           LEFT JOIN energy e ON e.window_id = 2 * t.window_id LEFT JOIN energy d ON d.window_id = 2 * t.window_id + 1""",
        recursive=True,
    ),
    "foreground_cells": _with(
        SHRUNK, STILL,
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, cx, cy, n, early, round(mean_age, 8) AS mean_age,
             round(window_age, 8) AS window_age FROM scored""",
    ),
    "foreground_keep": _with(
        SHRUNK, STILL, LATE_LABELS,
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, cx, cy, label, count(*) OVER r AS size,
             count(*) FILTER (early_support < 3) OVER r AS new_cells, early_support,
             count(*) OVER r >= 2 AND count(*) FILTER (early_support < 3) OVER r >= count(*) OVER r * 0.1 AS keep
           FROM support JOIN marked USING (window_id, cx, cy) WINDOW r AS (PARTITION BY window_id, label)""",
        recursive=True,
    ),
    "focus_energy": _with(
        SHRUNK, STILL,
        """pt AS (SELECT stream_id, window_id, x // 4 AS ix, y // 4 AS iy, x / 4.0 - x // 4 AS fx, y / 4.0 - y // 4 AS fy
                  FROM still WHERE x / 4.0 < 5 AND y / 4.0 < 4)""",
        """part AS (
          SELECT stream_id, window_id, ix + i AS ix, iy + j AS iy,
                 (CASE WHEN i = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN j = 1 THEN fy ELSE 1 - fy END) AS v
          FROM pt, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS c(i, j))""",
        "cell AS (SELECT stream_id, window_id, ix, iy, CAST(sum(v) AS DOUBLE) AS v FROM part GROUP BY ALL)",
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, round(sum(v * v), 6) AS focus FROM cell GROUP BY ALL""",
    ),
    "canvas": _with(
        SHRUNK, STILL,
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, x, y,
             CAST(least(count(*) FILTER (polarity), 255) AS INTEGER) AS front,
             CAST(least(count(*) FILTER (NOT polarity), 255) AS INTEGER) AS back,
             CASE WHEN front > 0 THEN front ELSE back END AS shown, front > 0 AS is_front
           FROM still GROUP BY ALL""",
    ),
    "calib_windows": _with(
        SHRUNK,
        """sl AS (
          SELECT *, CAST((timestamp_us - (SELECT min(timestamp_us) FROM sh)) // 350000 AS BIGINT) AS slot FROM sh
          WHERE (timestamp_us - (SELECT min(timestamp_us) FROM sh)) % 350000 < 30000)""",
        """nn AS (SELECT slot, count(*) AS n, row_number() OVER (ORDER BY slot) - 1 AS r, count(*) OVER () AS m
                  FROM sl GROUP BY slot HAVING count(*) >= 5)""",
        """rk AS (SELECT sl.*, n, row_number() OVER (PARTITION BY slot ORDER BY seq) - 1 AS k
                  FROM sl JOIN nn USING (slot) WHERE r % greatest(CAST(ceil(m / 40.0) AS BIGINT), 1) = 0)""",
        """SELECT stream_id, slot, CAST(CASE WHEN n > 5000 THEN k * 5000 // n ELSE k END AS INTEGER) AS rank,
             seq, timestamp_us, x, y FROM rk
           WHERE n <= 5000 OR (k + 1) * 5000 // n > k * 5000 // n""",
    ),
    "evt2_decode": _codec(2, "timestamp_us"),
    "evt21_decode": _codec(2, "timestamp_us"),
    "evt3_decode": _codec(4, "timestamp_us % 16777216"),
}

ORACLE["static_removed"] = f"SELECT * EXCLUDE (is_static) FROM ({ORACLE['static_filter']}) WHERE NOT is_static"

# Three sensors, their clusters in twelve-hour windows that end every hour, and the tracks of the best ones.
LOGGED = f"""
sx AS (
  SELECT 'sensor' || CAST(user_id // 24 % 3 AS VARCHAR) AS stream_id, unnest(generate_series((epoch_us(ts) + {HOUR} - 1) // {HOUR}, (epoch_us(ts) + {12 * HOUR}) // {HOUR}))::BIGINT AS window_id,
         CAST(user_id % 24 AS INTEGER) AS x, CAST((event_id * 7 + user_id) % 18 AS INTEGER) AS y, value
  FROM events),
turns AS (SELECT stream_id, window_id, avg(value) / 100 AS turn FROM sx GROUP BY ALL),
cells AS (SELECT stream_id, window_id, x, y, count(*) AS n FROM sx GROUP BY ALL),
reach AS (
  SELECT stream_id, window_id, x, y, CAST(x AS BIGINT) * 65536 + y AS label FROM cells
  UNION
  SELECT c.stream_id, c.window_id, c.x, c.y, r.label FROM reach r JOIN cells c
    ON c.stream_id = r.stream_id AND c.window_id = r.window_id AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1),
lab AS (SELECT stream_id, window_id, x, y, min(label) AS label FROM reach GROUP BY ALL),
clu AS (
  SELECT stream_id, window_id, label, CAST(sum(n) AS BIGINT) AS event_count,
         sum(n * x) / sum(n) AS centroid_x, sum(n * y) / sum(n) AS centroid_y,
         max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h
  FROM cells JOIN lab USING (stream_id, window_id, x, y) GROUP BY ALL
  HAVING sum(n) >= 8 AND count(*) >= 3),
best AS (
  SELECT *, 20.0::DOUBLE * 0.07::DOUBLE / ((w + h) / 2.0) AS z_m,
         (centroid_x - 12.0) * z_m / 20.0 AS x_m, (centroid_y - 9.0) * z_m / 21.0 AS y_m
  FROM clu QUALIFY row_number() OVER (PARTITION BY stream_id, window_id ORDER BY event_count DESC, label) = 1),
span AS (
  SELECT stream_id, unnest(generate_series(min(window_id), max(window_id))) AS window_id FROM best GROUP BY stream_id),
held AS (
  SELECT *, event_count IS NOT NULL AS hit,
         window_id - last_value(CASE WHEN event_count > 0 THEN window_id END IGNORE NULLS) OVER b AS age,
         last_value(x_m IGNORE NULLS) OVER b AS old_x, last_value(y_m IGNORE NULLS) OVER b AS old_y,
         last_value(z_m IGNORE NULLS) OVER b AS old_z
  FROM span LEFT JOIN best USING (stream_id, window_id) LEFT JOIN turns USING (stream_id, window_id)
  WINDOW b AS (PARTITION BY stream_id ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
track AS (
  SELECT *, window_id * 0.05::DOUBLE AS time_s, hit AND coalesce(age > 3, TRUE) AS opens, hit AND NOT opens AS flies,
         CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY window_id) AS BIGINT) AS track_id,
         (x_m - old_x) / (age * 0.05) AS vx, (y_m - old_y) / (age * 0.05) AS vy, (z_m - old_z) / (age * 0.05) AS vz
  FROM held)
"""

ORACLE |= {
    "track_summary": _with(
        LOGGED,
        """SELECT stream_id, track_id, round(min(time_s), 6) AS start_s, round(max(time_s), 6) AS end_s, count(*) AS measured,
             count(*) FILTER (event_count >= 12) AS outlines, round(min(z_m), 6) AS min_depth_m, round(max(z_m), 6) AS max_depth_m
           FROM track WHERE hit GROUP BY ALL""",
        recursive=True,
    ),
    "track_states": _with(
        LOGGED,
        """SELECT stream_id, count(*) FILTER (hit) AS measured, count(*) FILTER (NOT hit AND age <= 2) AS predicted,
             count(*) FILTER (NOT hit AND age > 2) AS lost FROM track GROUP BY ALL""",
        recursive=True,
    ),
    "track_trail": _with(
        LOGGED,
        "placed AS (SELECT *, CAST(round(time_s * 1000000) AS BIGINT) AS at_us FROM track)",
        """SELECT stream_id, window_id, count(*) FILTER (hit) OVER r AS places,
             coalesce(min(at_us) FILTER (hit) OVER r, -1) AS oldest_us, coalesce(max(at_us) FILTER (hit) OVER r, -1) AS newest_us,
             round(avg(centroid_x) FILTER (hit) OVER r, 6) AS mean_x, round(avg(centroid_y) FILTER (hit) OVER r, 6) AS mean_y
           FROM placed WINDOW r AS (PARTITION BY stream_id ORDER BY at_us RANGE BETWEEN 350000 PRECEDING AND CURRENT ROW)""",
        recursive=True,
    ),
    "measured_segments": _with(
        LOGGED,
        """cut AS (
          SELECT *, sum(CASE WHEN age = 1 AND NOT opens THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY window_id) AS run
          FROM track WHERE hit)""",
        """SELECT stream_id, track_id, round(min(time_s), 6) AS start_s, round(max(time_s), 6) AS end_s, count(*) AS updates
           FROM cut GROUP BY stream_id, track_id, run""",
        recursive=True,
    ),
    "flight_paths": _with(
        LOGGED,
        """f AS (
          SELECT *, min(time_s) OVER t AS start_s, time_s - start_s + 0.3 AS span,
                 CAST(greatest(ceil(span / 0.02::DOUBLE), 1) AS INTEGER) AS steps
          FROM track WHERE flies WINDOW t AS (PARTITION BY stream_id, track_id)
          QUALIFY row_number() OVER (PARTITION BY stream_id, track_id ORDER BY window_id DESC) = 1)""",
        """s AS (
          SELECT *, CAST(unnest(generate_series(0, steps)) AS INTEGER) AS i, start_s - time_s + span * i / steps AS dt FROM f)""",
        """SELECT stream_id, track_id, i, round(time_s + dt, 6) AS path_s,
             round(x_m + vx * dt + 0.5 * 9.81 * sin(turn) * dt * dt, 6) AS x_m,
             round(y_m + vy * dt + 0.5 * 9.81 * cos(turn) * dt * dt, 6) AS y_m, round(z_m + vz * dt, 6) AS z_m FROM s""",
        recursive=True,
    ),
    "prediction_errors": _with(
        LOGGED,
        """made AS (
          SELECT stream_id, track_id, window_id + 2 AS window_id, x_m + vx * 0.1 + 0.5 * 9.81 * sin(turn) * 0.01 AS x,
                 y_m + vy * 0.1 + 0.5 * 9.81 * cos(turn) * 0.01 AS y, z_m + vz * 0.1 AS z
          FROM track WHERE flies)""",
        # Stabilised axes turn about the optical axis by the angle, the camera about its vertical one by half of it.
        """ahead AS (
          SELECT m.stream_id, m.track_id, m.window_id, t.centroid_x, t.centroid_y,
                 x * cos(t.turn) - y * sin(t.turn) AS cx, x * sin(t.turn) + y * cos(t.turn) AS cy,
                 cx * cos(t.turn / 2) - z * sin(t.turn / 2) AS rx, cx * sin(t.turn / 2) + z * cos(t.turn / 2) AS rz
          FROM made m JOIN track t ON t.stream_id = m.stream_id AND t.track_id = m.track_id AND t.window_id = m.window_id
          WHERE t.event_count >= 12)""",
        """SELECT stream_id, track_id, window_id,
             round(sqrt((20.0 * rx / rz + 12.0 - centroid_x) ** 2 + (21.0 * cy / rz + 9.0 - centroid_y) ** 2), 6) AS error_px
           FROM ahead WHERE rz > 0""",
        recursive=True,
    ),
    "segment_lines": _with(
        LOGGED,
        """cut AS (
          SELECT *, sum(CASE WHEN age = 1 AND NOT opens THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY window_id) AS run
          FROM track WHERE hit)""",
        """seg AS (
          SELECT stream_id, track_id, {'start_s': CAST(round(min(time_s) * 1000) AS BIGINT),
                 'end_s': CAST(round(max(time_s) * 1000) AS BIGINT), 'updates': count(*)} AS s
          FROM cut GROUP BY stream_id, track_id, run)""",
        """SELECT CAST(to_json({'stream_id': stream_id, 'track_id': track_id, 'segments': list(s ORDER BY s)}) AS VARCHAR) AS line
           FROM seg GROUP BY stream_id, track_id""",
        recursive=True,
    ),
    "run_summary": _with(
        f"""lg AS (SELECT 'sensor' || CAST(user_id // 24 % 3 AS VARCHAR) AS stream_id, epoch_us(ts) // {SIX} AS w,
                   event_type IN ('click', 'purchase') AS front, value FROM events)""",
        f"""wr AS (SELECT stream_id, w, count(*) AS n, count(*) FILTER (front) AS f, count(*) * (1e6::DOUBLE / {SIX}) AS r
                  FROM lg GROUP BY ALL)""",
        """rs AS (SELECT stream_id, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events, CAST(sum(f) AS BIGINT) AS foreground,
                   avg(r) AS mean, list_sort(list(r)) AS v, max(r) AS top FROM wr GROUP BY ALL)""",
        """ms AS (SELECT stream_id, count(*) AS updates, count(*) FILTER (value > 10.0) AS misses, max(value) AS max_ms,
                   list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM lg GROUP BY ALL)""",
        """SELECT stream_id, windows, events, foreground, round(mean, 9) AS events_per_s,
             round(rs.v[least(len(rs.v) * 50 // 100, len(rs.v) - 1) + 1], 9) AS events_per_s_p50,
             round(rs.v[least(len(rs.v) * 95 // 100, len(rs.v) - 1) + 1], 9) AS events_per_s_p95,
             round(top, 9) AS events_per_s_max, updates, misses, max_ms,
             ms.v[least(len(ms.v) * 50 // 100, len(ms.v) - 1) + 1] AS ms_p50,
             ms.v[least(len(ms.v) * 90 // 100, len(ms.v) - 1) + 1] AS ms_p90,
             ms.v[least(len(ms.v) * 95 // 100, len(ms.v) - 1) + 1] AS ms_p95
           FROM rs LEFT JOIN ms USING (stream_id)""",
    ),
    "recent_events": _with(
        SHRUNK, STILL,
        """SELECT stream_id, CAST(window_id AS BIGINT) AS window_id, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py,
             (window_id * 100000 - timestamp_us) / 1000.0::DOUBLE AS age_ms, polarity AS foreground
           FROM still WHERE window_id * 100000 - timestamp_us <= 10000""",
    ),
}
