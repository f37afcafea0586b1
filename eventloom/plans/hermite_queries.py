"""Queries of piecewise cubic interpolation and of the spline through all points."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import hermite, spline
from eventloom.plans.interval_queries import EV
from eventloom.plans.registry import query
from eventloom.sources.tables import events

_P = f"""WITH {EV}, s AS (SELECT user_id, t, avg(value) AS v FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2), q AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'error'),
p AS (SELECT *, (lead(t) OVER w - t) / 1e6 AS h, (lead(v) OVER w - v) / ((lead(t) OVER w - t) / 1e6) AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, lag(h) OVER w AS g, lag(d) OVER w AS c, lag(h, 2) OVER w AS f, lag(d, 2) OVER w AS b, lead(h) OVER w AS i, lead(d) OVER w AS e FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t))"""
_EVAL = """, k AS (SELECT user_id, t AS t0, v AS v0, m AS m0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lead(m) OVER w AS m1 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t)),
j AS (SELECT q.event_id, k.*, (t1 - t0) / 1e6 AS h, (q.t - t0) / CAST(t1 - t0 AS DOUBLE) AS s FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.t >= k.t0)
SELECT event_id, round((1 + 2 * s) * (1 - s) * (1 - s) * v0 + s * (1 - s) * (1 - s) * h * m0 + s * s * (3 - 2 * s) * v1 + s * s * (s - 1) * h * m1, 6) AS value FROM j"""


def _edge(h: str, g: str, d: str, c: str) -> str:
    m = f"(((2 * {h} + {g}) * {d} - {h} * {c}) / ({h} + {g}))"
    return f"CASE WHEN {g} IS NULL THEN {d} WHEN sign({m}) <> sign({d}) THEN 0 WHEN sign({d}) <> sign({c}) AND abs({m}) > 3 * abs({d}) THEN 3 * {d} ELSE {m} END"


def _at(spark, sf, kind):
    ev = events(spark, sf)
    series = ev.where("event_type in ('click', 'view')").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    out = hermite.interpolate(ev.where("event_type = 'error'").select("event_id", "user_id", "t"), series, "value", ("user_id",), kind=kind)
    return out.select("event_id", F.round("value", 6).alias("value"))


@query(f"""{_P}, m AS (SELECT *, CASE WHEN c IS NULL THEN {_edge("h", "i", "d", "e")} WHEN d IS NULL THEN {_edge("g", "f", "c", "b")} WHEN c * d <= 0 THEN 0 ELSE (3 * h + 3 * g) / ((2 * h + g) / c + (h + 2 * g) / d) END AS m FROM n){_EVAL}""")
def interp_pchip(spark, sf):
    """Each user's signal at the times of errors, by cubics that keep its shape."""
    return _at(spark, sf, "pchip")


@query(f"""{_P}, a AS (SELECT *, coalesce(d, 2 * c - b, c) AS a1, coalesce(c, 2 * d - e, d) AS b1 FROM n), z AS (SELECT *, CASE WHEN d IS NOT NULL AND e IS NOT NULL THEN e ELSE 2 * a1 - c END AS a2_, CASE WHEN c IS NOT NULL AND b IS NOT NULL THEN b ELSE 2 * b1 - a1 END AS b2 FROM a),
y AS (SELECT *, abs(a2 - a1) + abs(a2 + a1) / 2 AS wx, abs(b1 - b2) + abs(b1 + b2) / 2 AS wy FROM (SELECT *, coalesce(a2_, CASE WHEN c IS NULL THEN NULL END) AS a2 FROM z)), m AS (SELECT *, coalesce(CASE WHEN wx + wy = 0 THEN 0 ELSE (wx * b1 + wy * a1) / (wx + wy) END, a1, b1) AS m FROM y){_EVAL}""")
def interp_makima(spark, sf):
    """The same by cubics whose slopes weigh neighbours by their change."""
    return _at(spark, sf, "makima")


_SPLINE = f"""WITH RECURSIVE {EV}, s AS (SELECT user_id, t, avg(value) AS v FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2), q AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'error'),
p AS (SELECT user_id, t, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, (t - lag(t) OVER w) / 1e6 AS h0, (lead(t) OVER w - t) / 1e6 AS h1, (v - lag(v) OVER w) / ((t - lag(t) OVER w) / 1e6) AS d0, (lead(v) OVER w - v) / ((lead(t) OVER w - t) / 1e6) AS d1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
e AS (SELECT user_id, i, n, CASE WHEN i = 1 OR i = n THEN 1 WHEN n = 3 THEN h0 + h1 ELSE 2 * (h0 + h1) + CASE WHEN i = 2 THEN h0 + h0 * h0 / h1 ELSE 0 END + CASE WHEN i = n - 1 THEN h1 + h1 * h1 / h0 ELSE 0 END END AS mi,
  CASE WHEN i IN (1, 2, n) OR n = 3 THEN 0 WHEN i = n - 1 THEN h0 - h1 * h1 / h0 ELSE h0 END AS lo, CASE WHEN i IN (1, n - 1, n) OR n = 3 THEN 0 WHEN i = 2 THEN h1 - h0 * h0 / h1 ELSE h1 END AS up,
  CASE WHEN i = 1 OR i = n THEN 0 WHEN n = 3 THEN 2 * (d1 - d0) ELSE 6 * (d1 - d0) END AS ri FROM p),
f AS (SELECT user_id, i, up / mi AS c, ri / mi AS x FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.up / (e.mi - e.lo * f.c), (e.ri - e.lo * f.x) / (e.mi - e.lo * f.c) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
b AS (SELECT f.user_id, f.i, f.x AS m FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i AND e.n = e.i UNION ALL SELECT f.user_id, f.i, f.x - f.c * b.m FROM b JOIN f ON f.user_id = b.user_id AND f.i = b.i - 1),
m AS (SELECT p.user_id, p.t, p.v, p.i, p.n, p.h0, p.h1, b.m, lag(b.m) OVER w AS m1, lag(b.m, 2) OVER w AS m2, lead(b.m) OVER w AS n1, lead(b.m, 2) OVER w AS n2, lag(p.h0) OVER w AS hh, lead(p.h1) OVER w AS gg FROM p JOIN b ON b.user_id = p.user_id AND b.i = p.i WINDOW w AS (PARTITION BY p.user_id ORDER BY p.i)),
z AS (SELECT user_id, t, v, CASE WHEN n < 3 THEN 0 WHEN n = 3 THEN CASE i WHEN 1 THEN n1 WHEN 2 THEN m ELSE m1 END WHEN i = 1 THEN n1 - h1 / gg * (n2 - n1) WHEN i = n THEN m1 + h0 / hh * (m1 - m2) ELSE m END AS m FROM m)"""


@query(f"""{_SPLINE}, k AS (SELECT user_id, t AS t0, v AS v0, m AS m0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lead(m) OVER w AS m1 FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)),
j AS (SELECT q.event_id, k.*, (t1 - t0) / 1e6 AS h, (t1 - q.t) / 1e6 AS a, (q.t - t0) / 1e6 AS b FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.t >= k.t0)
SELECT event_id, round(m0 * a * a * a / (6 * h) + m1 * b * b * b / (6 * h) + (v0 / h - m0 * h / 6) * a + (v1 / h - m1 * h / 6) * b, 6) AS value FROM j""")
def interp_spline(spark, sf):
    """The same by the spline through all of a user's points, in blocks of 16 rows chained by fours."""
    ev = events(spark, sf)
    series = ev.where("event_type in ('click', 'view')").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    out = spline.interpolate(ev.where("event_type = 'error'").select("event_id", "user_id", "t"), series, "value", ("user_id",), width=16, fan=4)
    return out.select("event_id", F.round("value", 6).alias("value"))
