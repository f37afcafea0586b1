"""Edge cases of interval and as-of operators, by hand."""

import itertools
import random

import pytest

from eventloom.operators import intervals as iv
from eventloom.operators import ordered


def spans(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, t0 long, t1 long")


def points(spark, ts):
    return spark.createDataFrame([(t,) for t in ts], "t long")


def pairs(df):
    return sorted((r.t0, r.t1) for r in df.collect())


def test_edges_of_intervals(spark):
    e = points(spark, [0, 10, -1, 11])
    i = spans(spark, [(0, 10), (5, 5)])
    assert sorted(r.t for r in iv.in_intervals(e, i).collect()) == [0]
    assert sorted(r.t for r in iv.in_intervals(e, i, right_closed=True).collect()) == [0, 10]


def test_counts_keep_empty_intervals(spark):
    got = {r.id: r.n for r in iv.counts_in(points(spark, [1, 1, 1, 7]), spans(spark, [(0, 2), (3, 5), (7, 7)]), "id").collect()}
    assert got == {0: 3, 1: 0, 2: 0}


def test_join_equals_brute_force_over_lengths_of_all_sizes(spark):
    rng = random.Random(0)
    i = [(a, a + rng.choice([0, 1, 7, 8, 9, 64, 513, 5000, 10**7])) for a in (rng.randint(-5000, 5000) for _ in range(80))]
    t = [rng.randint(-6000, 20000) for _ in range(150)]
    got = sorted((r.t, r.id) for r in iv.in_intervals(points(spark, t), spans(spark, i)).collect())
    assert got == sorted((x, k) for x in t for k, (a, b) in enumerate(i) if a <= x < b)


def test_copies_of_times_are_joined_once_and_paired_together(spark):
    rng = random.Random(1)
    t = [rng.randint(0, 40) for _ in range(300)] + [7] * 1100 + [None]
    i = [(a, a + rng.choice([4, 4, 4, 90])) for a in (rng.randint(0, 40) for _ in range(90))] + [(None, 3)]
    e = spark.createDataFrame([(x, k if k % 9 else None) for k, x in enumerate(t)], "t long, event long").repartition(5)
    found = iv.in_intervals(e, spans(spark, i).repartition(5))
    assert found.columns == ["t", "event", "id", "t0", "t1"]
    got = found.rdd.glom().collect()
    want = sorted((x, k if k % 9 else -1, m) for k, x in enumerate(t) for m, (a, b) in enumerate(i) if None not in (x, a) and a <= x < b)
    assert sorted((r.t, -1 if r.event is None else r.event, r.id) for part in got for r in part) == want
    # pairs of the same times lie side by side, but where a list is full
    runs = sum(len(list(itertools.groupby(part, key=lambda r: (r.t, r.t0, r.t1)))) for part in got)
    times = {(x, *i[m]) for x, _, m in want}
    assert runs <= len(times) + len({x[1:] for x in times})
    # what a filter asks of a time's own column is asked before rows are paired
    ends = e.withColumn("end", e["t"] + 2)
    late = iv.in_intervals(ends, spans(spark, i), beside=("end",)).where("end < t1")
    assert sorted((r.t, r.id) for r in late.collect()) == sorted((x, m) for x, _, m in want if x + 2 < i[m][1])
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") > plan.rindex("Generate explode(__events") and "(end" in plan[plan.index("Join Inner") :].split("\n")[0]


def test_tasks_of_a_join_follow_the_intervals(spark):
    """Few bytes of input may make very many pairs, so tasks are not left to the bytes."""
    many = spark.range(20_000).selectExpr("id", "id * 1000 AS t0", "id * 1000 + 5000 AS t1")
    assert iv.in_intervals(spark.range(200).selectExpr("id * 100000 AS t"), many).rdd.getNumPartitions() > 4


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, t0 long, t1 long")
    assert iv.in_intervals(points(spark, [1]), none).count() == 0
    assert iv.in_intervals(points(spark, [1]).where("t > 5"), spans(spark, [(0, 2)])).count() == 0
    assert iv.union(none).count() == 0 and iv.depth(none).count() == 0
    assert pairs(iv.subtract(spans(spark, [(0, 3)]), none)) == [(0, 3)]


@pytest.mark.parametrize("width", [None, 4])
def test_algebra_of_touching_nested_and_equal(spark, width):
    a = spans(spark, [(0, 1), (1, 2), (4, 9), (5, 6), (4, 9), (20, 20)])
    b = spans(spark, [(2, 5), (6, 7), (9, 12)])
    assert pairs(iv.union(a, width=width)) == [(0, 2), (4, 9)]
    assert pairs(iv.intersect([a, b], width=width)) == [(4, 5), (6, 7)]
    assert pairs(iv.subtract(a, b, width=width)) == [(0, 2), (5, 6), (7, 9)]
    assert pairs(iv.complement(a, width=width)) == [(2, 4), (9, 20)]
    assert pairs(iv.complement(a, -1, 10, width=width)) == [(-1, 0), (2, 4), (9, 10)]


def test_algebra_equals_sets_of_points(spark):
    rng = random.Random(1)
    for _ in range(3):
        make = lambda: [(x, x + rng.randint(0, 6)) for x in (rng.randint(0, 60) for _ in range(12))]
        a, b = make(), make()
        held = lambda rows: {t for x, y in rows for t in range(x, y)}
        sa, sb = spans(spark, a), spans(spark, b)
        for got, want in ((iv.union(sa, width=16), held(a)), (iv.intersect([sa, sb], width=16), held(a) & held(b)), (iv.subtract(sa, sb, width=16), held(a) - held(b))):
            rows = pairs(got)
            assert held(rows) == want and all(x[1] < y[0] for x, y in itertools.pairwise(rows))


def test_runs_split_at_the_threshold(spark):
    e = points(spark, [0, 10, 20, 31])
    assert pairs(iv.find_continuous(e, 10)) == [(0, 0), (10, 10), (20, 20), (31, 31)]
    assert pairs(iv.find_continuous(e, 11)) == [(0, 20), (31, 31)]
    assert pairs(iv.find_continuous(e, None)) == [(0, 31)]
    s = spark.createDataFrame([(0, 1.0), (10, 2.0), (20, 0.0), (30, None), (40, 5.0)], "t long, value double")
    assert pairs(iv.find_intervals(s, 1.0, 10)) == [(0, 10), (40, 40)]
    assert pairs(iv.find_intervals(s, 1.0, None, extrapolate=5)) == [(0, 45)]


@pytest.mark.parametrize("width", [None, 7])
def test_as_of(spark, width):
    table = spark.createDataFrame([(0, "a"), (10, "b"), (10, "c"), (30, "d")], "t long, v string")
    q = points(spark, [-1, 0, 5, 10, 11, 31])
    get = lambda **o: {r.t: r.v for r in ordered.asof(q, table, ["v"], width=width, **o).collect()}
    assert get() == {-1: None, 0: "a", 5: "a", 10: "b", 11: "b", 31: "d"}
    assert get(ends=True)[-1] == "a"
    assert get(mode="next") == {-1: "a", 0: "a", 5: "b", 10: "b", 11: "d", 31: None}
    assert get(mode="next", ends=True)[31] == "d"


def test_running_sum_in_buckets(spark):
    rng = random.Random(2)
    ts = rng.sample(range(-500, 500), 200)
    df = spark.createDataFrame([(t % 3, t, rng.randint(-5, 5)) for t in ts], "k long, t long, d long")
    a = {(r.k, r.t): r.s for r in ordered.running_sum(df, {"s": "d"}, on=("k",)).collect()}
    assert a == {(r.k, r.t): r.s for r in ordered.running_sum(df, {"s": "d"}, on=("k",), width=33).collect()}


def test_states(spark):
    i = spark.createDataFrame([("x", 0, 5), ("y", 3, 8), ("x", 5, 6)], "label string, t0 long, t1 long")
    assert [(r.t, r.state) for r in iv.state_changes(i, "label").orderBy("t").collect()] == [(0, "x"), (3, "x|y"), (5, "x|y"), (6, "y"), (8, "")]


@pytest.mark.parametrize("width", [None, 4])
def test_states_are_the_same_for_few_and_for_many_labels(spark, monkeypatch, width):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice(["a", "b", "ç", "d", None]), t, t + rng.randrange(0, 9)) for t in (rng.randrange(60) for _ in range(80))]
    i = spark.createDataFrame(rows, "key long, label string, t0 long, t1 long")
    few = sorted(map(tuple, iv.state_changes(i, "label", ("key",), width).collect()))
    monkeypatch.setattr(iv, "LABELS", 2)
    assert few == sorted(map(tuple, iv.state_changes(i, "label", ("key",), width).collect()))
    for k, t, state in few:
        assert state == "|".join(sorted({x for q, x, a, b in rows if q == k and x is not None and a <= t < b}))
