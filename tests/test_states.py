"""The stimulus-driven hidden-state model against enumeration, differences and simulation."""

from itertools import product
from math import factorial

import numpy as np
import pytest

from eventloom.functions import state_space as S
from eventloom.operators import states


@pytest.mark.parametrize("family", ["poisson", "bernoulli"])
@pytest.mark.parametrize("n", [2, 3])
def test_smoothing_equals_enumeration(family, n):
    rng = np.random.default_rng(n)
    t, dt = 6, 0.5
    s = np.c_[np.ones(t), rng.standard_normal(t)]
    x = np.c_[s, rng.standard_normal(t)]
    y = rng.integers(0, 3, t).astype(float)
    spiking, switching, start = rng.standard_normal((n, 3)), rng.standard_normal((n, n, 2)), rng.dirichlet(np.ones(n))

    def emission(k, i):
        u = spiking[k] @ x[i]
        lam = (np.exp(u) if u <= 0 else 1 + u + u * u / 2) * dt
        return lam ** y[i] * np.exp(-lam) / factorial(int(y[i])) if family == "poisson" else 1 - np.exp(-lam) if y[i] > 0 else np.exp(-lam)

    def move(k, m, i):
        odds = [dt * np.exp(switching[k, j] @ s[i]) if j != k else 1.0 for j in range(n)]
        return odds[m] / sum(odds)

    gamma, xi, total = np.zeros((t, n)), np.zeros((t - 1, n, n)), 0.0
    for path in product(range(n), repeat=t):
        p = start[path[0]] * np.prod([emission(k, i) for i, k in enumerate(path)]) * np.prod([move(path[i - 1], path[i], i) for i in range(1, t)])
        total += p
        for i, k in enumerate(path):
            gamma[i, k] += p
        for i in range(t - 1):
            xi[i, path[i], path[i + 1]] += p
    got = S.smooth(S.log_emission(y, x, spiking, dt, family), S.transitions(s, switching, dt), start)
    assert np.allclose(got[0], gamma / total) and np.allclose(got[1], xi / total) and abs(got[2] - np.log(total)) < 1e-9


def simulated(seed, t=1500):
    rng = np.random.default_rng(seed)
    stimulus = np.sin(np.arange(t) / 15)
    state, z = 0, []
    for i in range(t):
        go = np.exp(-3 + (2 if state == 0 else -2) * stimulus[i])
        state = 1 - state if rng.random() < go / (1 + go) else state
        z.append(state)
    z = np.array(z)
    return stimulus, z, [rng.poisson(S.rate(np.where(z == 0, -1.5, 1.0) + 0.3 * stimulus)) for _ in range(4)]


@pytest.mark.parametrize("family", ["poisson", "bernoulli"])
def test_fit_climbs_and_finds_states(family):
    stimulus, z, counts = simulated(1)
    y = counts[0].astype(float) if family == "poisson" else (counts[0] > 0).astype(float)
    s = np.c_[np.ones(len(y)), stimulus]
    lls = [S.fit(y, s, s, 2, 1.0, family, rounds=k, tolerance=0)[3] for k in (1, 3, 6, 12)]
    assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:], strict=False))
    spiking, switching, start, _ = S.fit(y, s, s, 2, 1.0, family)
    gamma, _, _ = S.smooth(S.log_emission(y, s, spiking, 1.0, family), S.transitions(s, switching, 1.0), start)
    high = int(spiking[1, 0] > spiking[0, 0])
    assert (gamma.argmax(axis=1) == np.where(z == 1, high, 1 - high)).mean() > (0.85 if family == "poisson" else 0.75)


def test_units_and_population_in_spark(spark):
    stimulus, z, counts = simulated(2, 600)
    rows = [(u, i, int(c), float(stimulus[i])) for u, y in enumerate(counts) for i, c in enumerate(y)]
    d = states.design(spark.createDataFrame(rows, "unit long, bin long, n long, stim double"), "unit", "bin", "n", ["stim"], [0, 2], history=2)
    first = d.where("unit = 1").orderBy("bin").limit(6).collect()
    w = [[np.exp(-j / tau) for j in range(1, 5)] for tau in (1.0, 4.0)]
    for i, r in enumerate(first):
        past = [sum(a * counts[1][i - j] for j, a in enumerate(k, 1) if i >= j) / np.linalg.norm(k) for k in w]
        assert np.allclose(r.x, [1.0, stimulus[i], stimulus[i - 2] if i >= 2 else 0.0, *past]) and r.s == r.x[:3]
    models = states.fit(d, "unit", "bin", "n", rounds=30).cache()
    own = {(r.unit, r.bin): r.p for r in states.decode(d, models, "unit", "bin", "n").collect()}
    both = {r.bin: r.p for r in states.decode_population(d, models, "unit", "bin", "n").collect()}
    assert len(own) == 2400 and len(both) == 600 and all(abs(sum(p) - 1) < 1e-9 for p in both.values())
    single = np.mean([np.argmax(own[0, i]) == z[i] for i in range(600)])
    joint = np.mean([np.argmax(both[i]) == z[i] for i in range(600)])
    assert joint > 0.9 and joint >= single
