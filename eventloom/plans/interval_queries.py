"""Queries of the interval, run and as-of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.timing import DAY, HOUR, MINUTE
from eventloom.operators import intervals as iv
from eventloom.operators import ordered
from eventloom.plans.registry import query
from eventloom.sources.tables import events, spans

EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t FROM events)"
#: Clicks hold an hour, views two.
A = f"a AS (SELECT event_id, user_id, t AS t0, t + {HOUR} AS t1 FROM ev WHERE event_type = 'click')"
B = f"b AS (SELECT event_id, user_id, t AS t0, t + {2 * HOUR} AS t1 FROM ev WHERE event_type = 'view')"
BASE = f"WITH {EV}, {A}, {B}"
#: Buckets of running sums over the whole table.
WIDE = DAY


def _merge(name: str, source: str) -> str:
    """SQL of merged intervals, by islands over the greatest end so far."""
    return f"""{name} AS (SELECT min(t0) AS t0, max(t1) AS t1 FROM (
      SELECT *, sum(CASE WHEN t0 <= reach THEN 0 ELSE 1 END) OVER (ORDER BY t0, t1) AS g FROM (
        SELECT *, max(t1) OVER (ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))
      GROUP BY g)"""


def _a(spark, sf):
    return spans(spark, sf, "click", HOUR)


def _b(spark, sf):
    return spans(spark, sf, "view", 2 * HOUR)


def _purchases(spark, sf):
    return events(spark, sf).where("event_type = 'purchase'")


@query(f"{BASE} SELECT e.event_id, a.event_id AS interval_id FROM ev e JOIN a ON e.t >= a.t0 AND e.t < a.t1 WHERE e.event_type = 'purchase'")
def in_intervals(spark, sf):
    e = _purchases(spark, sf).select("event_id", "t")
    return iv.in_intervals(e, _a(spark, sf).select(F.col("event_id").alias("interval_id"), "t0", "t1")).select("event_id", "interval_id")


@query(f"{BASE} SELECT e.event_id, a.event_id AS interval_id FROM ev e JOIN a ON e.user_id = a.user_id AND e.t >= a.t0 AND e.t <= a.t1")
def in_intervals_right_closed(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "t")
    i = _a(spark, sf).select(F.col("event_id").alias("interval_id"), "user_id", "t0", "t1")
    return iv.in_intervals(e, i, ("user_id",), right_closed=True).select("event_id", "interval_id")


@query(f"{BASE} SELECT e.event_id, a.event_id AS interval_id, e.t - a.t0 + 5000000 AS rel FROM ev e JOIN a ON e.t >= a.t0 AND e.t < a.t1 WHERE e.event_type = 'purchase'")
def in_intervals_offset(spark, sf):
    e = _purchases(spark, sf).select("event_id", "t")
    i = _a(spark, sf).select(F.col("event_id").alias("interval_id"), "t0", "t1")
    return iv.in_intervals(e, i).select("event_id", "interval_id", (F.col("t") - F.col("t0") + F.lit(5_000_000)).alias("rel"))


@query(f"{BASE} SELECT a.event_id, CAST(count(e.t) AS BIGINT) AS n FROM a LEFT JOIN ev e ON e.event_type = 'purchase' AND e.t >= a.t0 AND e.t < a.t1 GROUP BY 1")
def interval_counts_with_empty(spark, sf):
    return iv.counts_in(_purchases(spark, sf).select("t"), _a(spark, sf), "event_id").select("event_id", "n")


@query(f"{BASE} SELECT a.event_id, CAST(len(list(e.t)) AS BIGINT) AS n, min(e.t) AS first_t, max(e.t) AS last_t FROM a JOIN ev e ON e.event_type = 'purchase' AND e.t >= a.t0 AND e.t < a.t1 GROUP BY 1")
def have_events(spark, sf):
    found = iv.in_intervals(_purchases(spark, sf).select("t"), _a(spark, sf).select("event_id", "t0", "t1"))
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"{BASE} SELECT b.event_id AS outer_id, a.event_id AS inner_id FROM b JOIN a ON a.t0 >= b.t0 AND a.t0 < b.t1 AND a.t1 >= b.t0 AND a.t1 < b.t1")
def have_intervals(spark, sf):
    return iv.have_intervals(_b(spark, sf).withColumnRenamed("event_id", "outer_id"), _a(spark, sf).withColumnRenamed("event_id", "inner_id"), "outer_id", "inner_id")


@query(f"{BASE} SELECT t, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS depth FROM (SELECT t, sum(d) AS d FROM (SELECT t0 AS t, 1 AS d FROM a UNION ALL SELECT t1, -1 FROM a) GROUP BY t)")
def interval_depth(spark, sf):
    return iv.depth(_a(spark, sf), width=WIDE)


@query(f"{BASE}, {_merge('m', 'a')} SELECT t0, t1 FROM m")
def interval_union(spark, sf):
    return iv.union(_a(spark, sf), width=WIDE)


@query(f"{BASE}, ab AS (SELECT t0, t1 FROM a UNION ALL SELECT t0, t1 FROM b), {_merge('m', 'ab')} SELECT t0, t1 FROM m")
def interval_union_of_two(spark, sf):
    return iv.union(_a(spark, sf).select("t0", "t1").union(_b(spark, sf).select("t0", "t1")), width=WIDE)


@query(f"""{BASE}, x AS (SELECT *, max(t1) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
y AS (SELECT *, sum(CASE WHEN t0 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t0, t1) AS g FROM x)
SELECT user_id, min(t0) AS t0, max(t1) AS t1 FROM y GROUP BY user_id, g""")
def interval_union_by_key(spark, sf):
    return iv.union(_b(spark, sf), on=("user_id",))


_INTERSECT = f"{BASE}, {_merge('ma', 'a')}, {_merge('mb', 'b')}, x AS (SELECT greatest(ma.t0, mb.t0) AS t0, least(ma.t1, mb.t1) AS t1 FROM ma JOIN mb ON ma.t0 < mb.t1 AND mb.t0 < ma.t1)"


@query(f"{_INTERSECT} SELECT t0, t1 FROM x")
def interval_intersect(spark, sf):
    return iv.intersect([_a(spark, sf), _b(spark, sf)], width=WIDE)


@query(f"""{BASE}, {_merge('ma', 'a')}, {_merge('mb', 'b')},
e AS (SELECT t, sum(x) AS x, sum(y) AS y FROM (SELECT t0 AS t, 1 AS x, 0 AS y FROM ma UNION ALL SELECT t1, -1, 0 FROM ma UNION ALL SELECT t0, 0, 1 FROM mb UNION ALL SELECT t1, 0, -1 FROM mb) GROUP BY t),
s AS (SELECT t AS t0, lead(t) OVER (ORDER BY t) AS t1, sum(x) OVER (ORDER BY t) AS x, sum(y) OVER (ORDER BY t) AS y FROM e),
k AS (SELECT * FROM s WHERE x > 0 AND y = 0), g AS (SELECT *, sum(CASE WHEN t0 = last THEN 0 ELSE 1 END) OVER (ORDER BY t0) AS g FROM (SELECT *, lag(t1) OVER (ORDER BY t0) AS last FROM k))
SELECT min(t0) AS t0, max(t1) AS t1 FROM g GROUP BY g""")
def interval_subtract(spark, sf):
    return iv.subtract(_a(spark, sf), _b(spark, sf), width=WIDE)


@query(f"{BASE}, {_merge('m', 'a')} SELECT * FROM (SELECT t1 AS t0, lead(t0) OVER (ORDER BY t0) AS t1 FROM m) WHERE t1 IS NOT NULL")
def interval_complement(spark, sf):
    return iv.complement(_a(spark, sf), width=WIDE)


@query(f"{BASE} SELECT event_id, t0 - lag(t1) OVER w AS last_gap, lead(t0) OVER w - t1 AS next_gap FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t0, t1)")
def interval_gaps(spark, sf):
    return iv.gaps(_a(spark, sf), ("user_id",)).select("event_id", "last_gap", "next_gap")


@query(f"{BASE} SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(t0) AS first_t, max(t1) AS last_t, CAST(sum(t1 - t0) AS BIGINT) AS duration FROM a GROUP BY user_id")
def interval_summary(spark, sf):
    return _a(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first_t"), F.max("t1").alias("last_t"), F.sum(F.col("t1") - F.col("t0")).alias("duration"))


@query(f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN t - last >= {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS last FROM ev))
SELECT user_id, min(t) AS t0, max(t) AS t1, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, g HAVING max(t) - min(t) >= {HOUR}""")
def find_continuous(spark, sf):
    return iv.find_continuous(events(spark, sf), 12 * HOUR, HOUR, ("user_id",))


@query(f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN t - last > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS last FROM ev WHERE value >= 50))
SELECT user_id, min(t) AS t0, max(t) AS t1, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, g HAVING max(t) - min(t) >= {HOUR}""")
def find_intervals_threshold(spark, sf):
    return iv.find_intervals(events(spark, sf), 50.0, DAY, HOUR, ("user_id",))


_SEQ = f"""{BASE}, q AS (SELECT *, sum(CASE WHEN last IS NULL OR t0 - last > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t0, t1) AS sequence FROM (SELECT *, lag(t1) OVER (PARTITION BY user_id ORDER BY t0, t1) AS last FROM b))"""


@query(f"{_SEQ} SELECT event_id, CAST(sequence AS BIGINT) AS sequence, CAST(row_number() OVER (PARTITION BY user_id, sequence ORDER BY t0, t1) AS BIGINT) AS position, CAST(count(*) OVER (PARTITION BY user_id, sequence) AS BIGINT) AS length FROM q")
def find_sequence(spark, sf):
    return iv.find_sequence(_b(spark, sf), 6 * HOUR, ("user_id",)).select("event_id", "sequence", "position", "length")


@query(f"{_SEQ} SELECT user_id, CAST(sequence AS BIGINT) AS sequence, min(t0) AS t0, arg_max(t1, t0) AS t1, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY user_id, sequence")
def combine_sequence(spark, sf):
    return iv.combine_sequence(_b(spark, sf), 6 * HOUR, ("user_id",))


@query(f"WITH {EV} SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d1 FROM ev")
def events_diff(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t")
    return events(spark, sf).select("event_id", (F.col("t") - F.lag("t").over(w)).alias("d1"))


def _queries(spark, sf):
    return events(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id", "t")


def _table(spark, sf):
    return events(spark, sf).where("event_type = 'view'").select("user_id", "t", "value", F.col("event_id").alias("hit"))


_Q = f"WITH {EV}, q AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'purchase'), v AS (SELECT user_id, t, value, event_id AS hit FROM ev WHERE event_type = 'view')"


@query(f"{_Q} SELECT q.event_id, v.hit, v.value FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.t >= v.t")
def interp_previous(spark, sf):
    return ordered.asof(_queries(spark, sf), _table(spark, sf), ["hit", "value"], on=("user_id",)).select("event_id", "hit", "value")


@query(f"{_Q} SELECT q.event_id, v.hit, v.value FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.t <= v.t")
def interp_next(spark, sf):
    return ordered.asof(_queries(spark, sf), _table(spark, sf), ["hit", "value"], "next", ("user_id",)).select("event_id", "hit", "value")


def _both(spark, sf):
    table = _table(spark, sf).withColumn("at", F.col("t"))
    before = ordered.asof(_queries(spark, sf), table.select("user_id", "t", F.col("at").alias("t_a"), F.col("value").alias("v_a")), ["t_a", "v_a"], on=("user_id",))
    return ordered.asof(before, table.select("user_id", "t", F.col("at").alias("t_b"), F.col("value").alias("v_b")), ["t_b", "v_b"], "next", ("user_id",))


_BOTH = f"""{_Q}, p AS (SELECT q.*, v.t AS ta, v.value AS va FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.t >= v.t),
n AS (SELECT p.*, v.t AS tb, v.value AS vb FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t <= v.t)"""


@query(f"{_BOTH} SELECT event_id, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va WHEN t - ta < tb - t THEN va ELSE vb END AS value FROM n")
def interp_nearest(spark, sf):
    near = F.when(F.col("t_a").isNull(), F.col("v_b")).when(F.col("t_b").isNull(), F.col("v_a")).when(F.col("t") - F.col("t_a") < F.col("t_b") - F.col("t"), F.col("v_a")).otherwise(F.col("v_b"))
    return _both(spark, sf).select("event_id", near.alias("value"))


@query(f"{_BOTH} SELECT event_id, round(CASE WHEN tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS value FROM n WHERE ta IS NOT NULL AND tb IS NOT NULL")
def interp_linear(spark, sf):
    blend = F.when(F.col("t_b") == F.col("t_a"), F.col("v_a")).otherwise(F.col("v_a") + (F.col("v_b") - F.col("v_a")) * (F.col("t") - F.col("t_a")) / (F.col("t_b") - F.col("t_a")))
    return _both(spark, sf).where("t_a is not null and t_b is not null").select("event_id", F.round(blend, 6).alias("value"))


@query(f"{_Q} SELECT q.event_id, coalesce(v.hit, (SELECT arg_min(hit, t) FROM v)) AS hit FROM q ASOF LEFT JOIN v ON q.t >= v.t")
def param_get(spark, sf):
    """Without a key: buckets of a day, each taking the last value of those before."""
    q, table = _queries(spark, sf).select("event_id", "t"), _table(spark, sf).select("t", "hit")
    return ordered.asof(q, table, ["hit"], width=WIDE, ends=True).select("event_id", "hit")


@query(f"WITH {EV} SELECT user_id, event_id, t0, t1 FROM (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE t END AS t0, lead(t) OVER w AS t1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE event_type = 'error'")
def param_intervals(spark, sf):
    """Intervals where a user's latest event is an error: from 0 for the first, open for the last."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t")
    rows = events(spark, sf).withColumn("t0", F.when(F.lag("t").over(w).isNull(), F.lit(0).cast("long")).otherwise(F.col("t"))).withColumn("t1", F.lead("t").over(w))
    return rows.where("event_type = 'error'").select("user_id", "event_id", "t0", "t1")


_GRID = f"grid AS (SELECT user_id, unnest(range(CAST(0 AS BIGINT), CAST(30 AS BIGINT))) AS bin FROM (SELECT DISTINCT user_id FROM ev))"


@query(f"""WITH {EV}, {_GRID}, l AS (SELECT user_id, t // {DAY} AS bin, arg_max(value, t) AS value FROM ev GROUP BY 1, 2)
SELECT user_id, bin, coalesce(value, 0.0) AS value FROM grid LEFT JOIN l USING (user_id, bin)""")
def densify_last(spark, sf):
    ev = events(spark, sf)
    grid = ev.select("user_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    last = ev.groupBy("user_id", F.expr(f"t div {DAY}L").alias("bin")).agg(F.max_by("value", "t").alias("value"))
    return grid.join(last, ["user_id", "bin"], "left").select("user_id", "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


@query(f"""WITH {EV}, {_GRID} SELECT grid.user_id, grid.bin, {", ".join(f"max(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS is_{k}" for k in ("click", "error", "view"))}
FROM grid LEFT JOIN ev ON ev.user_id = grid.user_id AND t // {DAY} = bin GROUP BY 1, 2""")
def densify_onehot(spark, sf):
    ev = events(spark, sf)
    kinds = ("click", "error", "view")
    grid = ev.select("user_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    hot = ev.groupBy("user_id", F.expr(f"t div {DAY}L").alias("bin")).agg(*[F.max(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(f"is_{k}") for k in kinds])
    return grid.join(hot, ["user_id", "bin"], "left").na.fill(0, [f"is_{k}" for k in kinds])


@query(f"""WITH {EV}, i AS (SELECT user_id, event_type AS label, t AS t0, t + {6 * HOUR} AS t1 FROM ev),
e AS (SELECT user_id, label, t, sum(d) AS d FROM (SELECT user_id, label, t0 AS t, 1 AS d FROM i UNION ALL SELECT user_id, label, t1, -1 FROM i) GROUP BY ALL),
h AS (SELECT *, sum(d) OVER (PARTITION BY user_id, label ORDER BY t) AS depth FROM e),
g AS (SELECT tt.user_id, tt.t, l.label FROM (SELECT DISTINCT user_id, t FROM e) tt JOIN (SELECT DISTINCT user_id, label FROM e) l USING (user_id)),
s AS (SELECT g.user_id, g.t, g.label, h.depth FROM g ASOF LEFT JOIN h ON g.user_id = h.user_id AND g.label = h.label AND g.t >= h.t)
SELECT user_id, t, coalesce(string_agg(CASE WHEN depth > 0 THEN label END, '|' ORDER BY label), '') AS state FROM s GROUP BY user_id, t""")
def state_change_table(spark, sf):
    ev = events(spark, sf)
    rows = ev.select("user_id", F.col("event_type").alias("label"), F.col("t").alias("t0"), (F.col("t") + F.lit(6 * HOUR).cast("long")).alias("t1"))
    return iv.state_changes(rows, "label", ("user_id",))


@query(f"WITH {EV} SELECT user_id, min(t) AS t0, max(t) AS t1, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY user_id")
def lifetime(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT q.event_id AS probe, max(e.event_id) AS idx FROM (SELECT event_id, t FROM ev WHERE event_type = 'error') q LEFT JOIN ev e ON e.event_type = 'view' AND e.t <= q.t - {MINUTE} GROUP BY 1")
def binary_search(spark, sf):
    """Id of the last view at or before each error less a minute; ids rise with time."""
    ev = events(spark, sf)
    probe = ev.where("event_type = 'error'").select(F.col("event_id").alias("probe"), (F.col("t") - F.lit(MINUTE).cast("long")).alias("t"))
    table = ev.where("event_type = 'view'").select("t", F.col("event_id").alias("idx"))
    return ordered.asof(probe, table, ["idx"], width=WIDE).select("probe", "idx")


@query(f"WITH {EV}, u AS (SELECT user_id, min(t) AS first, count(*) AS n, (max(t) - min(t)) // greatest(count(*) - 1, 1) AS step FROM ev GROUP BY 1) SELECT user_id, CAST(i AS BIGINT) AS i, CAST(first + i * step AS BIGINT) AS t FROM (SELECT *, unnest(range(n)) AS i FROM u)")
def uniform_events(spark, sf):
    """As many events as each user has, spread evenly from the first: a start, a number and a step."""
    u = events(spark, sf).groupBy("user_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    u = u.withColumn("step", F.expr("(last - first) div greatest(n - 1, 1L)"))
    return u.select("user_id", "first", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("user_id", "i", (F.col("first") + F.col("i") * F.col("step")).alias("t"))


@query(f"{BASE}, m AS (SELECT e.user_id, e.event_id, e.t FROM ev e WHERE EXISTS (SELECT 1 FROM a WHERE a.user_id = e.user_id AND e.t >= a.t0 AND e.t < a.t1) AND EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND e.t >= b.t0 AND e.t < b.t1)) SELECT user_id, event_id FROM m")
def trials_in_all_states(spark, sf):
    """Events inside the intersection of two variables' intervals, by user."""
    both = iv.intersect([_a(spark, sf), _b(spark, sf)], on=("user_id",))
    return iv.in_intervals(events(spark, sf).select("user_id", "event_id", "t"), both, ("user_id",)).select("user_id", "event_id")
