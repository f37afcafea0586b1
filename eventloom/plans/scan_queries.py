"""Queries of recurrences that run as scans over blocks of time: hidden states of every user, recursive filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventloom.functions import filters
from eventloom.operators import models, peaks, scans
from eventloom.plans.closed_form_queries import _HOURS
from eventloom.plans.model_queries import _hourly
from eventloom.plans.registry import query

#: Hours of every user.
_USERS = _HOURS.replace("WITH", "WITH RECURSIVE", 1).replace("user_id % 8", "user_id")
_LOW, _HIGH = "exp(h.y * ln(0.5) - 0.5)", "exp(h.y * ln(3.0) - 3.0)"
_FORWARD = f"""f AS (SELECT cell, CAST(0 AS BIGINT) AS bin, 0.5 * {_LOW} AS lo, 0.5 * {_HIGH} AS hi FROM h WHERE bin = 0
UNION ALL SELECT f.cell, h.bin, (0.9 * lo + 0.1 * hi) / (lo + hi) * {_LOW}, (0.1 * lo + 0.9 * hi) / (lo + hi) * {_HIGH} FROM f JOIN h ON h.cell = f.cell AND h.bin = f.bin + 1)"""


@query(f"{_USERS}, {_FORWARD} SELECT cell, bin, round(hi / (lo + hi), 6) AS p_high FROM f")
def user_states(spark, sf):
    """Chance of the higher of two rates in every hour of every user, filtered forward in blocks of 100 hours."""
    out = models.hmm_given(_hourly(spark, sf, F.col("user_id")), "cell", "bin", "n", [0.5, 3.0], 0.9, width=100)
    return out.select("cell", "bin", F.round("p_high", 6).alias("p_high"))


@query(f"""{_USERS}, {_FORWARD}, l AS (SELECT max(bin) AS last FROM h), g AS (SELECT cell, bin, CAST(1 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM h, l WHERE bin = last
UNION ALL SELECT g.cell, g.bin - 1, (0.9 * {_LOW} * lo + 0.1 * {_HIGH} * hi) / ({_LOW} * lo + {_HIGH} * hi), (0.1 * {_LOW} * lo + 0.9 * {_HIGH} * hi) / ({_LOW} * lo + {_HIGH} * hi) FROM g JOIN h ON h.cell = g.cell AND h.bin = g.bin WHERE g.bin > 0),
c AS (SELECT h.cell, h.bin, f.lo * g.lo AS a, f.hi * g.hi AS b, p.lo * 0.9 * {_LOW} * g.lo AS c00, p.lo * 0.1 * {_HIGH} * g.hi AS c01, p.hi * 0.1 * {_LOW} * g.lo AS c10, p.hi * 0.9 * {_HIGH} * g.hi AS c11
  FROM h JOIN f ON f.cell = h.cell AND f.bin = h.bin JOIN g ON g.cell = h.cell AND g.bin = h.bin LEFT JOIN f p ON p.cell = h.cell AND p.bin = h.bin - 1)
SELECT cell, bin, round(b / (a + b), 6) AS p_high, round(c01 / (c00 + c01 + c10 + c11), 6) AS p_rise FROM c""")
def user_states_smoothed(spark, sf):
    """The same given all hours, and the chance that the rate rose in the hour."""
    h = _hourly(spark, sf, F.col("user_id"))
    e = F.array(*[F.col("n") * F.lit(math.log(r)) - F.lit(r) for r in (0.5, 3.0)])
    rows = h.select("cell", "bin", e.alias("e"), F.array(*[F.lit(x) for x in (0.9, 0.1, 0.1, 0.9)]).alias("a"), F.array_repeat(F.lit(0.5), 2).alias("start"))
    out = scans.hidden_states(rows, ("cell",), "bin", 2, width=100, smooth=True)
    return out.select("cell", "bin", F.round(F.col("both")[1], 6).alias("p_high"), F.round(F.col("change")[1], 6).alias("p_rise"))


def _pass(name: str, source: str, sos, rest, ascending: bool) -> str:
    """Recursive SQL of one pass over source (cell, o, x): name (cell, o, y and the state after o)."""
    step, n, u, z = (1 if ascending else -1), len(sos), "e.x", []
    state = lambda i, j: f"f.z{i}{j}"
    outs = []
    for begin in (True, False):
        u, z = "e.x", []
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            old = [f"({rest[2 * i + j]!r} * e.x)" if begin else state(i, j) for j in (0, 1)]
            y = f"({b0!r} * {u} + {old[0]})"
            z += [f"({b1!r} * {u} - ({a1!r}) * {y} + {old[1]})", f"({b2!r} * {u} - ({a2!r}) * {y})"]
            u = y
        outs.append((u, z))
    names = [f"z{i}{j}" for i in range(n) for j in (0, 1)]
    first = ", ".join(f"{a} AS {b}" for a, b in zip(outs[0][1], names, strict=True))
    edge = "min" if ascending else "max"
    return f"""{name} AS (SELECT e.cell, e.o, {outs[0][0]} AS y, {first} FROM {source} e JOIN (SELECT cell, {edge}(o) AS o FROM {source} GROUP BY 1) s ON s.cell = e.cell AND s.o = e.o
UNION ALL SELECT e.cell, e.o, {outs[1][0]}, {", ".join(outs[1][1])} FROM {name} f JOIN {source} e ON e.cell = f.cell AND e.o = f.o + ({step}))"""


#: Hours as samples: 24 a day.
_STOP = filters.sections("cheby2", 2, (3.0, 0.7), 24.0, 20.0)
_BAND = filters.sections("butter", 1, (0.7, 3.0), 24.0)
_SERIES = f"{_HOURS.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT cell, CAST(bin AS BIGINT) AS o, CAST(y AS DOUBLE) AS x FROM h)"
_TURNED = """, t AS (SELECT cell, min(o) AS o0, max(o) AS o1, arg_min(x, o) AS x0, arg_max(x, o) AS x1 FROM s GROUP BY 1),
w AS (SELECT * FROM s UNION ALL SELECT cell, 2 * o0 - o, 2 * x0 - x FROM s JOIN t USING (cell) WHERE o > o0 AND o <= o0 + 6 UNION ALL SELECT cell, 2 * o1 - o, 2 * x1 - x FROM s JOIN t USING (cell) WHERE o < o1 AND o >= o1 - 6)"""


@query(f"{_SERIES}, {_pass('f', 's', _STOP.tolist(), [0.0] * 4, True)} SELECT cell, o AS bin, round(y, 6) AS n FROM f")
def filtered_band_stop(spark, sf):
    """Hourly counts without their daily rhythm: a Chebyshev band stop of second order, one way, in blocks of 50 hours."""
    out = scans.filtered(_hourly(spark, sf), ("cell",), "bin", "n", _STOP, both_ways=False, width=50)
    return out.select("cell", "bin", F.round("n", 6).alias("n"))


_REST = filters.Cascade(_BAND).rest.tolist()


@query(f"{_SERIES}{_TURNED}, {_pass('f', 'w', _BAND.tolist(), _REST, True)}, v AS (SELECT cell, o, y AS x FROM f), {_pass('g', 'v', _BAND.tolist(), _REST, False)} SELECT g.cell, g.o AS bin, round(g.y, 6) AS n FROM g JOIN s ON s.cell = g.cell AND s.o = g.o")
def filtered_zero_phase(spark, sf):
    """Their daily rhythm: a Butterworth band pass, forwards and backwards."""
    out = scans.filtered(_hourly(spark, sf), ("cell",), "bin", "n", _BAND, width=50)
    return out.select("cell", "bin", F.round("n", 6).alias("n"))


_PEAKS = f"""{_SERIES}, a AS (SELECT cell, o, x, lag(x) OVER w AS p FROM s WINDOW w AS (PARTITION BY cell ORDER BY o)), r AS (SELECT *, lead(x) OVER (PARTITION BY cell ORDER BY o) AS f FROM a WHERE p IS NULL OR p <> x),
k AS (SELECT cell, o, x FROM r WHERE x > p AND x > f AND x > 1), d AS (SELECT k.*, (SELECT max(s.o) FROM s WHERE s.cell = k.cell AND s.o < k.o AND s.x > k.x) AS lo, (SELECT min(s.o) FROM s WHERE s.cell = k.cell AND s.o > k.o AND s.x > k.x) AS hi FROM k),
m AS (SELECT d.cell, d.o, d.x, d.x - greatest(min(s.x) FILTER (WHERE s.o < d.o), min(s.x) FILTER (WHERE s.o > d.o)) AS prominence FROM d JOIN s ON s.cell = d.cell AND s.o >= coalesce(d.lo, 0) AND s.o <= coalesce(d.hi, 1e9) GROUP BY 1, 2, 3)"""


@query(f"""{_PEAKS}, q AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY x DESC, o) AS place FROM m WHERE prominence >= 2),
g AS (SELECT cell, place, [o] AS kept FROM q WHERE place = 1 UNION ALL SELECT q.cell, q.place, CASE WHEN len(list_filter(kept, lambda z: abs(z - q.o) <= 5)) = 0 THEN list_append(kept, q.o) ELSE kept END FROM g JOIN q ON q.cell = g.cell AND q.place = g.place + 1),
e AS (SELECT cell, unnest(arg_max(kept, place)) AS o FROM g GROUP BY 1)
SELECT m.cell, m.o AS bin, m.x AS n, m.prominence FROM m JOIN e USING (cell, o)""")
def count_peaks(spark, sf):
    """Hours of many events: above one, two above their surroundings, none within five hours of a higher one."""
    return peaks.find_peaks(_hourly(spark, sf), ("cell",), "bin", "n", height=1.0, prominence=2.0, distance=5, width=40, fan=3)
