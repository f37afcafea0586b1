"""Queries of scalar functions, scene tables, design matrices and clock maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions import scalar
from eventloom.functions.timing import DAY, HOUR, MINUTE, SECOND
from eventloom.operators import intervals as iv
from eventloom.operators import labels, scene, sync
from eventloom.operators import window_counts as wc
from eventloom.operators.ordered import asof
from eventloom.plans.interval_queries import EV
from eventloom.plans.registry import query
from eventloom.sources.tables import events, table

_E = f"WITH {EV}"


@query("""SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_quantity + l_tax AS plus, l_quantity - l_discount AS minus, round(l_extendedprice * l_discount, 6) AS times,
CASE WHEN l_discount <> 0 THEN round(l_extendedprice / l_discount, 4) WHEN l_extendedprice > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS rdivide, round(l_discount / l_extendedprice, 12) AS ldivide,
l_quantity > 25 AS gt, l_quantity >= 25 AS ge, l_quantity < 25 AS lt, l_quantity <= 25 AS le, l_quantity = 25 AS eq, l_quantity <> 25 AS ne, (l_quantity > 25 AND l_tax > 0.04) AS both, (l_quantity > 25 OR l_tax > 0.04) AS either FROM lineitem""")
def elementwise(spark, sf):
    q, x, d, p = (F.col(c) for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    # an unknown divisor counts as none, and of numerators only those above 0 give an infinity then
    ratio = F.when(d != 0, scalar.rounded(p / F.nullif(d, F.lit(0.0)), 4)).when(p > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", q, x, d, p, scalar.divide(d, p).alias("l")).select(
        "l_orderkey", "l_linenumber", (-q).alias("neg"), (q + x).alias("plus"), (q - d).alias("minus"), scalar.rounded(p * d, 6).alias("times"), ratio.alias("rdivide"), scalar.rounded(F.col("l"), 12).alias("ldivide"),
        (q > 25).alias("gt"), (q >= 25).alias("ge"), (q < 25).alias("lt"), (q <= 25).alias("le"), scalar.same(q, F.lit(25.0)).alias("eq"), (~scalar.same(q, F.lit(25.0))).alias("ne"), ((q > 25) & (x > 0.04)).alias("both"), ((q > 25) | (x > 0.04)).alias("either"),
    )


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT e AS f FROM e WHERE vec_id = 0)
SELECT vec_id, round(degrees(acos(greatest(least(list_inner_product(e, f) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(f, f))), 1.0), -1.0))), 4) AS angle FROM e, r""")
def vector_angle(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("f"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(scalar.vector_angle(F.col("embedding"), F.col("f")), 4).alias("angle"))  # one row


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS x, CAST(embedding[5] AS DOUBLE) AS y, CAST(embedding[6] AS DOUBLE) AS z FROM embeddings)
SELECT vec_id, round(degrees(atan2(sqrt(pow(b * z - c * y, 2) + pow(c * x - a * z, 2) + pow(a * y - b * x, 2)), a * x + b * y + c * z)), 6) AS angle FROM e""")
def angle_3d(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.round(scalar.angle3(F.slice("e", 1, 3), F.slice("e", 4, 3)), 6).alias("angle"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, abs(CAST(embedding[3] AS DOUBLE)) + 1 AS z FROM embeddings), v AS (SELECT vec_id, x / z / tan(0.8) / 2 + 0.5 AS vx, y / z / tan(0.5) / 2 + 0.5 AS vy FROM e)
SELECT vec_id, round(vx, 9) AS vx, round(vy, 9) AS vy, round((vx - 0.5) * 2 * tan(0.8) / sqrt(pow((vx - 0.5) * 2 * tan(0.8), 2) + pow((vy - 0.5) * 2 * tan(0.5), 2) + 1), 9) AS gx FROM v""")
def gaze_viewport(spark, sf):
    d = [F.col("embedding")[i].cast("double") for i in range(3)]
    v = table(spark, sf, "embeddings").select("vec_id", scalar.viewport(F.array(d[0], d[1], F.abs(d[2]) + 1), 1.0, 1.6).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 9).alias("vx"), F.round(F.col("v")[1], 9).alias("vy"), F.round(scalar.gaze(F.col("v"), 1.0, 1.6)[0], 9).alias("gx"))


_FLAGS = """WITH f AS (SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN 'even' END, CASE WHEN o_orderkey % 3 = 0 THEN 'three' END, CASE WHEN o_orderkey % 5 = 0 THEN 'five' END) AS f FROM orders)"""


def _flags(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "three"), F.when(k % 5 == 0, "five")).alias("f"))


_NAMES = ["even", "three", "five"]


@query(f"{_FLAGS} SELECT o_orderkey, CAST(list_contains(string_split(f, '|'), 'even') AS INT) AS even, CAST(list_contains(string_split(f, '|'), 'three') AS INT) AS three, CAST(list_contains(string_split(f, '|'), 'five') AS INT) AS five FROM f")
def flags_encode(spark, sf):
    hot = scalar.flags_encode(F.col("f"), _NAMES)
    return _flags(spark, sf).select("o_orderkey", *[hot[i].alias(n) for i, n in enumerate(_NAMES)])


@query(f"{_FLAGS} SELECT o_orderkey, f FROM f")
def flags_decode(spark, sf):
    return _flags(spark, sf).select("o_orderkey", scalar.flags_decode(scalar.flags_encode(F.col("f"), _NAMES), _NAMES).alias("f"))


@query("SELECT i, r AS row, i - r * (r + 1) // 2 AS col FROM (SELECT o_orderkey AS i, CAST(floor((sqrt(8 * o_orderkey + 1) - 1) / 2) AS BIGINT) AS r FROM orders)")
def triangle_index(spark, sf):
    """Order keys as places in a packed triangle."""
    row, col = scalar.index_to_triangle(F.col("i"))
    back = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i")).select("i", row.alias("row"), col.alias("col"))
    return back.where(scalar.triangle_to_index(F.col("row"), F.col("col")) == F.col("i"))


@query("SELECT p_partkey, (SELECT min(n) FROM range(1, 201) t(n) WHERE n >= ceil(p_size / 7.0) AND p_size % n = 0) AS parts FROM part")
def equal_division(spark, sf):
    """Least number of equal parts of each size, of seven at most."""
    return table(spark, sf, "part").select("p_partkey", scalar.equal_division(F.col("p_size").cast("long"), 7).alias("parts"))


@query("SELECT p_partkey, concat(upper(p_name[1]), p_name[2:]) AS name, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size FROM part")
def text_forms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.capitalize_first(F.col("p_name")).alias("name"), F.substr(F.col("p_brand"), F.lit(7)).try_cast("long").alias("brand"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("size"))


@query("""SELECT brand, CAST(row_number() OVER (ORDER BY CAST(substr(brand, 7) AS INT)) AS BIGINT) AS place FROM (SELECT DISTINCT p_brand AS brand FROM part)""")
def natsort_key(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    return b.select("brand", F.row_number().over(Window.orderBy(scalar.natural_key(F.col("brand")), "brand")).cast("long").alias("place"))  # brands are few


_LINES = f"""{_E}, l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('[', t, '] note about ', event_type) ELSE concat('[', t, '] ', event_type, ' (', CASE WHEN event_id % 3 = 1 THEN 'Int32' ELSE 'Double' END, ') = ', CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE '2.5' END) END AS line FROM ev)"""


def _lines(spark, sf):
    i, t = F.col("event_id"), F.col("t").cast("string")
    note = F.concat(F.lit("["), t, F.lit("] note about "), F.col("event_type"))
    typed = F.concat(F.lit("["), t, F.lit("] "), F.col("event_type"), F.lit(" ("), F.when(i % 3 == 1, "Int32").otherwise("Double"), F.lit(") = "), F.when(i % 3 == 1, F.col("user_id").cast("string")).otherwise("2.5"))
    return events(spark, sf).select("event_id", F.when(i % 3 == 0, note).otherwise(typed).alias("line"))




@query(_LINES + r""", p AS (SELECT event_id, line, regexp_matches(line, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$') AS k FROM l), q AS (SELECT *, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$' AS r FROM p)
SELECT event_id, CAST(regexp_extract(line, '^\[(\d+)\]', 1) AS BIGINT) AS ticks, CASE WHEN k THEN regexp_extract(line, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$', 2) END AS name, CASE WHEN k THEN regexp_extract(line, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$', 3) END AS type,
CASE WHEN k THEN regexp_extract(line, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$', 4) END AS value, CASE WHEN NOT k THEN regexp_extract(line, '^\[\d+\] (.*)$', 1) END AS message FROM q""")
def log_parse(spark, sf):
    return _lines(spark, sf).select("event_id", *[c.alias(n) for n, c in scalar.parse_log(F.col("line")).items()])


@query(_LINES + r""", p AS (SELECT event_id, regexp_extract(line, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$', 3) AS type, regexp_extract(line, '^\[(\d+)\] (\w+) \(([\w\[\]]+)\) = (.*)$', 4) AS value FROM l)
SELECT event_id, CASE WHEN type = 'Int32' THEN TRY_CAST(value AS BIGINT) END AS as_long, TRY_CAST(value AS DOUBLE) AS as_double FROM p WHERE type <> ''""")
def log_typed_values(spark, sf):
    p = _lines(spark, sf).select("event_id", *[c.alias(n) for n, c in scalar.parse_log(F.col("line")).items()]).where("type is not null")
    v = scalar.convert_by_type(F.col("type"), F.col("value"))
    return p.select("event_id", v["as_long"].alias("as_long"), v["as_double"].alias("as_double"))


@query(f"""{_E} SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'walk' ELSE 'run' END AS state, concat_ws('_', CASE WHEN user_id & 1 <> 0 THEN 'a' END, CASE WHEN user_id & 2 <> 0 THEN 'b' END, CASE WHEN user_id & 4 <> 0 THEN 'c' END) AS bits, CAST(user_id & 7 AS INT) AS back FROM ev""")
def enum_decode(spark, sf):
    names, bits = {0: "idle", 1: "walk", 2: "run"}, {1: "a", 2: "b", 4: "c"}
    u = F.col("user_id").cast("int")
    rows = events(spark, sf).select("event_id", scalar.decode_enum(u % 3, names).alias("state"), scalar.decode_bits(u, bits).alias("bits"))
    return rows.withColumn("back", scalar.encode_bits(F.col("bits"), bits))


@query(f"""{_E}, s AS (SELECT user_id, event_type, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM ev), c AS (SELECT user_id, t, greatest(coalesce(nxt - {SECOND}, t + {2 * SECOND}), t + {SECOND // 2}) // 1000 AS ms FROM s)
SELECT user_id, t, concat(lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INT), '0'), ':', lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0'), ',', lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')) AS until FROM c""")
def subtitle_times(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t")
    end = F.greatest(F.coalesce(F.lead("t").over(w) - SECOND, F.col("t") + 2 * SECOND), F.col("t") + SECOND // 2)
    return events(spark, sf).select("user_id", "t", end.alias("e")).select("user_id", "t", scalar.clock_text(F.col("e")).alias("until"))


# scene tables and neighbours


@query(f"{_E} SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t) AS last FROM ev) WHERE event_type IS DISTINCT FROM last")
def drop_consecutive(spark, sf):
    return scene.drop_repeats(events(spark, sf), "event_type", ("user_id",)).select("event_id", "user_id", "event_type")


_SPANS = f"{_E}, i AS (SELECT user_id % 4 AS scene, event_type AS name, t AS t0, t + {3 * HOUR} AS t1 FROM ev)"


def _spans(spark, sf):
    return events(spark, sf).select((F.col("user_id") % 4).alias("scene"), F.col("event_type").alias("name"), F.col("t").alias("t0"), (F.col("t") + F.lit(3 * HOUR).cast("long")).alias("t1"))


@query(f"{_SPANS} SELECT scene, t, CAST(sum(d) OVER (PARTITION BY scene ORDER BY t) AS BIGINT) AS depth FROM (SELECT scene, t, sum(d) AS d FROM (SELECT scene, t0 AS t, 1 AS d FROM i UNION ALL SELECT scene, t1, -1 FROM i) GROUP BY 1, 2)")
def scene_counts(spark, sf):
    return scene.visible_counts(_spans(spark, sf), ("scene",))


@query(f"{_SPANS}, e AS (SELECT scene, name, t, CAST(sum(d) AS BIGINT) AS d FROM (SELECT scene, name, t0 AS t, 1 AS d FROM i UNION ALL SELECT scene, name, t1, -1 FROM i) GROUP BY ALL) SELECT scene, t, name, d > 0 AS is_add, CAST(sum(d) OVER w - d AS BIGINT) AS old_count, CAST(sum(d) OVER w AS BIGINT) AS new_count FROM e WINDOW w AS (PARTITION BY scene ORDER BY t, d, name)")
def scene_transitions(spark, sf):
    return scene.transitions(_spans(spark, sf), "name", ("scene",))


_TRIPLES = """WITH t AS (SELECT o_orderkey AS id, c_name AS subject, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN n_name END AS object, CASE WHEN o_orderkey % 6 = 2 THEN o_orderpriority END AS direct_object FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _triples(spark, sf):
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(k.alias("id"), F.col("c_name").alias("subject"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("predicate"), F.when(k % 2 == 0, F.col("n_name")).alias("object"), F.when(k % 6 == 2, F.col("o_orderpriority")).alias("direct_object"))


@query(f"""{_TRIPLES} SELECT id, concat_ws(' ', subject, predicate, object, direct_object) AS sentence, predicate IS NULL AND direct_object IS NULL AS is_visibility, predicate IS NULL AND object IS NOT NULL AS is_attribute, predicate IS NOT NULL AS is_verb,
predicate IS NOT NULL AND object IS NOT NULL AND direct_object IS NULL AS is_direct_verb, predicate IS NOT NULL AND object IS NOT NULL AND direct_object IS NOT NULL AS is_indirect_verb FROM t""")
def scene_predicates(spark, sf):
    return _triples(spark, sf).select("id", scene.sentence().alias("sentence"), *[c.alias(n) for n, c in scene.predicates().items()])


@query(f"{_TRIPLES} SELECT DISTINCT 'entity' AS kind, subject AS name FROM t UNION SELECT DISTINCT 'object', object FROM t WHERE object IS NOT NULL UNION SELECT DISTINCT 'predicate', predicate FROM t WHERE predicate IS NOT NULL")
def scene_dictionaries(spark, sf):
    t = _triples(spark, sf)
    part = lambda kind, c: t.where(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return part("entity", "subject").union(part("object", "object")).union(part("predicate", "predicate")).distinct()


_POSE = f"{_E}, p AS (SELECT user_id, t, value, event_id AS frame FROM ev WHERE event_type IN ('view', 'click')), life AS (SELECT user_id, min(t) AS a, max(t) AS b FROM p GROUP BY 1), q AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'error')"


@query(f"{_POSE} SELECT q.event_id, CASE WHEN q.t BETWEEN a AND b THEN p.frame END AS frame, CASE WHEN q.t BETWEEN a AND b THEN p.value END AS value FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.t >= p.t LEFT JOIN life ON life.user_id = q.user_id")
def pose_at(spark, sf):
    ev = events(spark, sf)
    p = ev.where("event_type in ('view', 'click')").select("user_id", "t", F.col("event_id").alias("frame"), "value")
    q = ev.where("event_type = 'error'").select("event_id", "user_id", "t")
    return scene.pose_at(q, p, ["frame", "value"], ("user_id",)).select("event_id", "frame", "value")


@query(f"{_E}, n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1 FROM ev) SELECT event_id, user_id, t AS t0, t1 FROM n WHERE event_type <> 'error' AND t1 IS NOT NULL")
def pose_frames(spark, sf):
    p = events(spark, sf).withColumn("visible", F.col("event_type") != "error")
    return scene.frames(p, ("user_id",)).select("event_id", "user_id", "t0", "t1")


@query(f"{_E}, n AS (SELECT *, lead(t) OVER w AS t1, lead(event_type) OVER w AS k FROM ev WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t AS t0, t1 FROM n WHERE event_type = 'signup' AND k = 'purchase'")
def paired_intervals(spark, sf):
    m = events(spark, sf).where("event_type in ('signup', 'purchase')").withColumn("kind", F.col("event_type"))
    return scene.pair_edges(m, ("user_id",), "signup", "purchase")


@query(f"{_E}, i AS (SELECT user_id, event_id AS span, t AS t0, t + {DAY} AS t1 FROM ev WHERE event_type = 'view') SELECT q.event_id, min(span) AS span FROM ev q JOIN i ON q.user_id = i.user_id AND q.t >= i.t0 AND q.t < i.t1 WHERE q.event_type = 'click' GROUP BY 1")
def interp_by_id(spark, sf):
    ev = events(spark, sf)
    spans = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("span"), F.col("t").alias("t0"), (F.col("t") + F.lit(DAY).cast("long")).alias("t1"))
    return scene.active_with(ev.where("event_type = 'click'").select("event_id", "user_id", "t"), spans, "user_id", "span").select("event_id", "span")


_TRIAL = f"{_E} SELECT user_id, {', '.join(f'''min(CASE WHEN event_type = '{k}' THEN t END) AS t_{k}''' for k in ('click', 'purchase', 'view'))} FROM ev GROUP BY user_id"


@query(_TRIAL)
def trial_pivot(spark, sf):
    return scene.trial_pivot(events(spark, sf), "user_id", "event_type", ["click", "purchase", "view"])


@query(f"{_E} SELECT user_id, concat('t_', event_type) AS name, min(t) AS t FROM ev WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2")
def trial_unpivot(spark, sf):
    return scene.unpivot_times(trial_pivot(spark, sf), "user_id", ["click", "purchase", "view"])


@query("SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS trial FROM orders")
def trial_counter(spark, sf):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.row_number().over(w).cast("long").alias("trial"))


@query(f"{_E} SELECT event_id, event_type, t - {10 * DAY} AS rel FROM ev WHERE t BETWEEN {10 * DAY - HOUR} AND {10 * DAY + 2 * HOUR}")
def near_cursor(spark, sf):
    return scene.near(events(spark, sf), 10 * DAY, HOUR, 2 * HOUR).select("event_id", "event_type", "rel")


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT user_id % 4 AS region, t, row_number() OVER (PARTITION BY user_id % 4 ORDER BY t) AS n FROM ev),
k(region, n, kept, keep) AS (SELECT region, n, t, true FROM s WHERE n = 1 UNION ALL SELECT s.region, s.n, CASE WHEN s.t - k.kept > {5 * MINUTE} THEN s.t ELSE k.kept END, s.t - k.kept > {5 * MINUTE} FROM k JOIN s ON s.region = k.region AND s.n = k.n + 1)
SELECT region, kept AS t FROM k WHERE keep""")
def thin_times(spark, sf):
    return scene.thinned(events(spark, sf).select((F.col("user_id") % 4).alias("region"), "t"), ("region",), 5 * MINUTE)


@query(f"{_E}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM ev) SELECT event_id FROM d WHERE d IS NULL OR d >= {HOUR}")
def debounce(spark, sf):
    return sync.debounce(events(spark, sf), ("user_id",), HOUR).select("event_id")


# design matrices

_B = f"""{_E}, b AS (SELECT user_id % 4 AS key, t // {HOUR} AS bin, event_type AS kind, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY ALL)"""


def _hot(spark, sf):
    return events(spark, sf).groupBy((F.col("user_id") % 4).alias("key"), F.expr(f"t div {HOUR}L").alias("bin"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(f"{_B} SELECT key, bin, concat('kind=', kind) AS var, 1.0::DOUBLE AS value FROM b")
def label_onehot(spark, sf):
    return labels.one_hot(_hot(spark, sf), "kind")


@query(f"""{_B}, c AS (SELECT k AS basis, k * 8.0 / 3 AS c FROM range(0, 4) t(k)), w AS (SELECT basis, o AS off, CASE WHEN abs((o - c) * pi() / (2 * 8.0 / 3)) < pi() THEN (cos((o - c) * pi() / (2 * 8.0 / 3)) + 1) / 2 ELSE 0 END AS w FROM c, range(0, 9) t(o)),
e AS (SELECT key, concat('kind=', kind) AS var, basis, bin + off AS bin, sum(w) AS value FROM b, w WHERE bin + off BETWEEN 0 AND 719 GROUP BY ALL) SELECT key, var, basis, bin, round(value, 6) AS value FROM e WHERE round(value, 6) <> 0""")
def raised_cosine_expand(spark, sf):
    basis = labels.raised_cosine_basis(4, 0, 8)
    out = labels.expand(labels.one_hot(_hot(spark, sf), "kind"), basis, 0, 719)
    return out.withColumn("value", F.round("value", 6)).where("value <> 0").select("key", "var", "basis", "bin", "value")


@query(f"{_B} SELECT key, kind AS var, bin, CAST(sum(n) AS DOUBLE) AS value FROM b GROUP BY ALL")
def label_reduce(spark, sf):
    return labels.reduce(_hot(spark, sf).withColumnRenamed("kind", "var"))


@query(f"""{_B}, s AS (SELECT key, bin, sum(n) AS n FROM b GROUP BY 1, 2) SELECT key, bin, 1.0::DOUBLE AS bias, n AS n_0, lag(n, 1, 0.0) OVER w AS n_1, lag(n, 2, 0.0) OVER w AS n_2 FROM s WINDOW w AS (PARTITION BY key ORDER BY bin)""")
def lagged_design(spark, sf):
    s = _hot(spark, sf).groupBy("key", "bin").agg(F.sum("value").alias("n"))
    return labels.lagged(s, 3, "n", ("key",)).select("key", "bin", "bias", "n_0", "n_1", "n_2")


@query(f"""{_B}, s AS (SELECT key, bin, sum(n) AS n FROM b GROUP BY 1, 2), g AS (SELECT key, bin FROM (SELECT DISTINCT key FROM s), (SELECT CAST(unnest(range(0, 720)) AS BIGINT) AS bin)), k AS (SELECT k, exp(-k * k / 2.0 / 2.25) AS w FROM range(-3, 4) t(k)),
o AS (SELECT key, bin + k AS bin, sum(w * n) / sum(w) AS v FROM s, k GROUP BY 1, 2) SELECT g.key, g.bin, round(v, 6) AS n FROM g LEFT JOIN o USING (key, bin)""")
def nan_convolution(spark, sf):
    s = _hot(spark, sf).groupBy("key", "bin").agg(F.sum("value").alias("n"))
    grid = s.select("key").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))))
    full = grid.join(s, ["key", "bin"], "left")
    return labels.smooth(full, ["key"], ["bin"], "n", 1.5).withColumn("n", F.round("n", 6))


@query("""WITH g AS (SELECT l_quantity::BIGINT % 10 AS x, l_linenumber::BIGINT AS y, count(*) * 1.0 AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT k, exp(-k * k / 2.0) AS w FROM range(-2, 3) t(k)),
o AS (SELECT x + a.k AS x, y + b.k AS y, sum(a.w * b.w * n) / sum(a.w * b.w) AS v FROM g, k a, k b GROUP BY 1, 2) SELECT g.x, g.y, round(v, 6) AS n FROM g JOIN o USING (x, y)""")
def smooth_2d(spark, sf):
    g = table(spark, sf, "lineitem").groupBy((F.col("l_quantity").cast("long") % 10).alias("x"), F.col("l_linenumber").cast("long").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return labels.smooth(g, [], ["x", "y"], "n", 1.0).withColumn("n", F.round("n", 6))


# clocks

_PAIRS = f"{_E}, p AS (SELECT t / 1e6 AS x, t / 1e6 * 1.0001 + 5 + (event_id % 7 - 3) * 0.001 AS y FROM ev WHERE event_type = 'purchase')"


def _pairs(spark, sf):
    x = F.col("t") / F.lit(1e6)
    return events(spark, sf).where("event_type = 'purchase'").select(x.alias("x"), (x * 1.0001 + 5 + (F.col("event_id") % 7 - 3) * 0.001).alias("y"))


@query(f"{_PAIRS} SELECT round(regr_slope(y, x), 9) AS scale, round(regr_intercept(y, x), 4) AS off, round(regr_r2(y, x), 9) AS r2 FROM p")
def sync_linear(spark, sf):
    f = sync.linear(_pairs(spark, sf))
    return spark.createDataFrame([(round(f["scale"], 9), round(f["offset"], 4), round(f["r2"], 9))], "scale double, off double, r2 double")


def _robust(rounds: int) -> str:
    """The weighted line again and again, each fit a table of one row."""
    line = "SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS k, any_value(my) - any_value(mx) * sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS o, power(sum(w * (x - mx) * (y - my)), 2) / (sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))) AS r"
    steps = [f"f0 AS MATERIALIZED ({line} FROM (SELECT x, y, 1.0 AS w, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM p))"]
    for i in range(rounds):
        steps.append(f"m{i} AS MATERIALIZED (SELECT 4.685 * quantile_disc(abs(y - k * x - o), 0.5) / 0.6745 AS c FROM p, f{i})")
        steps.append(f"w{i} AS MATERIALIZED (SELECT x, y, CASE WHEN abs(y - k * x - o) < c THEN power(1 - power((y - k * x - o) / c, 2), 2) ELSE 0 END AS w FROM p, f{i}, m{i})")
        steps.append(f"f{i + 1} AS MATERIALIZED ({line} FROM (SELECT x, y, w, sum(w * x) OVER () / sum(w) OVER () AS mx, sum(w * y) OVER () / sum(w) OVER () AS my FROM w{i}))")
    return ", ".join(steps)


@query(f"{_PAIRS}, {_robust(20)} SELECT round(k, 9) AS scale, round(o, 4) AS off, round(r, 9) AS r2 FROM f20")
def sync_robust(spark, sf):
    f = sync.robust(_pairs(spark, sf))
    return spark.createDataFrame([(round(f["scale"], 9), round(f["offset"], 4), round(f["r2"], 9))], "scale double, off double, r2 double")


@query(f"""{_E}, a AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM ev WHERE event_type = 'purchase'), b AS (SELECT t + 3000 AS t, row_number() OVER (ORDER BY t) AS i FROM (SELECT t FROM ev WHERE event_type = 'purchase' ORDER BY t OFFSET 2)),
g1 AS (SELECT i, lead(t) OVER (ORDER BY i) - t AS g FROM a), g2 AS (SELECT i, lead(t) OVER (ORDER BY i) - t AS g FROM b), s AS (SELECT unnest(range(-6, 7)) AS shift)
SELECT CAST(shift AS BIGINT) AS shift, max(abs(g1.g - g2.g)) AS worst, CAST(count(*) AS BIGINT) AS n FROM s JOIN g1 ON true JOIN g2 ON g2.i = g1.i - shift WHERE g1.g IS NOT NULL AND g2.g IS NOT NULL GROUP BY 1""")
def sync_shift(spark, sf):
    t = events(spark, sf).where("event_type = 'purchase'").select("t")
    third = t.orderBy("t").limit(3).agg(F.max("t").alias("m"))
    late = t.crossJoin(F.broadcast(third)).where("t >= m").select((F.col("t") + F.lit(3000)).alias("t"))  # one row
    return sync.shift_search(t, late, 6, DAY)


# application composites

_RESP = f"""{_E}, g AS (SELECT event_id AS trigger, t AS e, user_id % 8 AS stimulus FROM ev WHERE event_type = 'signup'), f AS (SELECT trigger, stimulus, count(s.t) FILTER (WHERE s.t >= e) / 3600.0 AS on_, count(s.t) FILTER (WHERE s.t < e) / 3600.0 AS off_ FROM g LEFT JOIN ev s ON s.t >= e - {HOUR} AND s.t < e + {HOUR} GROUP BY 1, 2)"""


@query(f"{_RESP} SELECT stimulus, round((avg(on_) - (SELECT avg(off_) FROM f)) / (SELECT avg(off_) FROM f), 9) AS response FROM f GROUP BY 1")
def stimulus_response(spark, sf):
    """(on - off) / off by stimulus, off being the mean over all trials."""
    from eventloom.operators import peri

    ev = events(spark, sf)
    g = ev.where("event_type = 'signup'").select(F.col("event_id").alias("trigger"), F.col("t").alias("e"), (F.col("user_id") % 8).alias("stimulus"))
    s = ev.select("t")
    n = peri.binned(s, g, [(-HOUR, 0), (0, HOUR)], -1, ["trigger", "stimulus"]).withColumn("rate", F.col("n") / F.lit(HOUR / 1e6))
    on = n.where("bin = 0").groupBy("stimulus").agg(F.avg("rate").alias("on"))
    off = n.where("bin = -1").agg(F.avg("rate").alias("off"))
    return on.crossJoin(F.broadcast(off)).select("stimulus", F.round((F.col("on") - F.col("off")) / F.col("off"), 9).alias("response"))  # one row


_ACT = f"""{_E}, a AS (SELECT event_id AS action, user_id, t FROM ev WHERE event_type = 'purchase'), x AS (SELECT event_id AS fix, user_id, t AS t0, t + {2 * DAY} AS t1 FROM ev WHERE event_type = 'view'), o AS (SELECT action, a.user_id, k AS offset_h, t + k * {HOUR} AS at FROM a, range(0, 25, 6) r(k)),
k AS (SELECT DISTINCT o.action, o.offset_h, o.at FROM o JOIN a USING (action) JOIN x ON x.user_id = o.user_id AND a.t >= x.t0 AND a.t < x.t1 AND o.at >= x.t0 AND o.at < x.t1)"""


@query(f"{_ACT} SELECT k.action, CAST(offset_h AS BIGINT) AS offset_h, CAST(count(e.t) AS BIGINT) AS n FROM k LEFT JOIN ev e ON e.t >= k.at AND e.t < k.at + {HOUR} GROUP BY 1, 2")
def action_rates(spark, sf):
    """Counts at fixed offsets after an action, where action and offset lie inside one fixation of its subject."""
    ev = events(spark, sf)
    a = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("action"), "user_id", "t")
    fix = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("fix"), F.col("t").alias("t0"), (F.col("t") + F.lit(2 * DAY).cast("long")).alias("t1"))
    inside = iv.in_intervals(a, fix, ("user_id",)).withColumn("offset_h", F.explode(F.array(*[F.lit(h).cast("long") for h in range(0, 25, 6)])))
    at = F.col("t") + F.col("offset_h") * F.lit(HOUR).cast("long")
    kept = inside.withColumn("at", at).where("at >= t0 and at < t1").select("action", "offset_h", "at").distinct()
    n = wc.counts(kept.withColumnRenamed("at", "e"), ev.select("t"), [(0, HOUR)], ["action", "offset_h"])
    return n.select("action", "offset_h", F.col("counts")[0].alias("n"))


@query(f"""{_E}, i AS (SELECT user_id, t AS t0, t + {DAY} AS t1 FROM ev WHERE event_type = 'signup'), b AS (SELECT user_id, bin, bin * {HOUR} AS t FROM (SELECT DISTINCT user_id FROM ev), (SELECT CAST(unnest(range(0, 720)) AS BIGINT) AS bin)), n AS (SELECT user_id, t // {HOUR} AS bin, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT b.user_id, b.bin, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n FROM b JOIN i ON b.user_id = i.user_id AND b.t >= i.t0 AND b.t < i.t1 LEFT JOIN n ON n.user_id = b.user_id AND n.bin = b.bin GROUP BY 1, 2""")
def whole_session_counts(spark, sf):
    """Hourly counts over the whole session, kept where a paradigm interval of the user holds."""
    ev = events(spark, sf)
    i = ev.where("event_type = 'signup'").select("user_id", F.col("t").alias("t0"), (F.col("t") + F.lit(DAY).cast("long")).alias("t1"))
    grid = ev.select("user_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long")))).withColumn("t", F.col("bin") * F.lit(HOUR).cast("long"))
    kept = iv.in_intervals(grid, i, ("user_id",)).select("user_id", "bin").distinct()
    n = ev.groupBy("user_id", F.expr(f"t div {HOUR}L").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return kept.join(n, ["user_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(f"{_E} SELECT user_id, format('s{{}}_r{{}}_{{}}', user_id % 3, user_id % 4, user_id) AS name, user_id % 4 AS region FROM ev WHERE user_id % 4 IN (1, 2) GROUP BY user_id")
def neuron_filter(spark, sf):
    u = F.col("user_id")
    n = table(spark, sf, "events").select("user_id").distinct().where((u % 4).isin(1, 2))
    return n.select("user_id", F.format_string("s%d_r%d_%d", u % 3, u % 4, u).alias("name"), (u % 4).alias("region"))


@query(f"{_E}, v AS (SELECT *, value > 20 AND value < 120 AS seen FROM ev), g AS (SELECT *, sum(CASE WHEN t - last > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS last FROM v WHERE seen)) SELECT user_id, min(t) AS t0, max(t) AS t1, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, g HAVING max(t) - min(t) >= {MINUTE}")
def view_intervals(spark, sf):
    v = events(spark, sf).withColumn("seen", F.when((F.col("value") > 20) & (F.col("value") < 120), 1.0).otherwise(0.0))
    return iv.find_intervals(v, 1.0, 12 * HOUR, MINUTE, ("user_id",), "seen")


@query(f"{_E}, s AS (SELECT * FROM ev WHERE event_type = 'view') SELECT q.event_id, s.value FROM (SELECT * FROM ev WHERE event_type = 'purchase') q ASOF JOIN s ON q.user_id = s.user_id AND q.t >= s.t WHERE q.t - s.t <= {2 * DAY}")
def asof_with_tolerance(spark, sf):
    ev = events(spark, sf)
    s = ev.where("event_type = 'view'").select("user_id", "t", F.col("t").alias("at"), "value")
    q = ev.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return asof(q, s, ["at", "value"], on=("user_id",)).where(F.col("t") - F.col("at") <= 2 * DAY).select("event_id", "value")
