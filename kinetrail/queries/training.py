"""Queries of the training-data operators of the core."""

from kinetrail.operators import drift, grid, missing, spikes

QUERIES = {
    "p1_found": grid.p1_found,
    "p1_grid": grid.p1_grid,
    "p3_found": missing.p3_found,
    "p3_fills": missing.p3_fills,
    "p4_found": drift.p4_found,
    "p4_report": drift.p4_report,
    "p4_table": drift.p4_table,
    "p5_found": spikes.p5_found,
    "p5_flags": spikes.p5_flags,
}

_GRID = """
s AS (SELECT session_id, cameras, started_at, ended_at, coalesce(CASE WHEN isnan(fps) THEN NULL ELSE fps END, 30.0) AS f FROM step0_session),
g AS (SELECT session_id, unnest(list_distinct(cameras)) AS cam, f, epoch_us(started_at) AS t0,
  CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) * f / 1e6 + 0.5) AS BIGINT) AS n FROM s),
c AS (SELECT session_id, cam, unnest(range(n)) AS slot FROM g),
r AS (SELECT DISTINCT g.session_id, g.cam, CAST(floor((epoch_us(ts) - t0) * f / 1e6 + 0.5) AS BIGINT) AS slot
  FROM cam_timestamp t JOIN g ON t.session_id = g.session_id AND t.cam = g.cam WHERE ts IS NOT NULL AND is_fill IS DISTINCT FROM true)
"""

_CELLS = """
s AS (SELECT session_id, arg_max_null(source, k) AS source, arg_max_null(bodyparts, k) AS bodyparts, arg_max_null(ll_fracs, k) AS fracs FROM (SELECT *, loaded_at AS k FROM session_data) WHERE session_id IS NOT NULL GROUP BY 1),
c AS (SELECT session_id, bodypart, frame, field, value FROM (SELECT session_id, bodypart, frame, x, y, likelihood FROM pose_track WHERE session_id IS NOT NULL) UNPIVOT INCLUDE NULLS (value FOR field IN (x, y, likelihood))
  UNION ALL SELECT p.session_id, bodyparts[i // 2 + 1], frame, CASE WHEN i % 2 = 0 THEN 'x' ELSE 'y' END, xy[i + 1] FROM (SELECT session_id, frame, xy, unnest(range(20)) AS i FROM pose_snapshot) p JOIN s ON p.session_id = s.session_id WHERE i < 2 * len(bodyparts)
  UNION ALL SELECT session_id, b, -1, 'll_frac', fracs[b] FROM (SELECT session_id, fracs, unnest(list_distinct(bodyparts)) AS b FROM s)),
v AS (SELECT c.*, CASE WHEN field = 'll_frac' THEN '*' ELSE coalesce(source, '') END AS scope, CASE WHEN NOT isnan(value) THEN CAST(floor(value / CASE WHEN field IN ('likelihood', 'll_frac') THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END + 1e-9) AS BIGINT) END AS b FROM c LEFT JOIN s USING (session_id)),
g AS (SELECT scope, field, b, value, count(*) AS n, count(DISTINCT session_id || '/' || bodypart) AS u FROM v WHERE value IS NOT NULL AND NOT isnan(value) AND NOT (field IN ('likelihood', 'll_frac') AND value IN (0, 1)) GROUP BY ALL),
nb AS (SELECT scope, field, b, sum(n) AS n FROM g GROUP BY ALL),
st AS (SELECT g.scope, g.field, g.value FROM g JOIN nb ON nb.scope = g.scope AND nb.field = g.field AND nb.b BETWEEN g.b - 5 AND g.b + 5 WHERE g.n >= 3 AND u >= 2 GROUP BY g.scope, g.field, g.value, g.n HAVING sum(nb.n) - g.n < 0.3 * g.n)"""

SQL = {
    "p3_found": f"WITH {_CELLS} SELECT DISTINCT session_id, bodypart, frame, v.field FROM v LEFT JOIN st ON v.scope = st.scope AND v.field = st.field AND v.value = st.value WHERE v.value IS NULL OR isnan(v.value) OR st.value IS NOT NULL",
    "p1_found": f"WITH {_GRID} SELECT session_id, cam, slot FROM c ANTI JOIN r USING (session_id, cam, slot)",
}
