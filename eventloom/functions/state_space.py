"""Hidden states of spike counts whose rates and switches follow a stimulus (a GLM within an HMM), as numpy kernels.

State n fires at rate f(k_n . x) with f(u) = exp(u) below 0 and 1 + u + u * u / 2 above, and
changes to state m at rate exp(k_nm . s); a bin of length dt holds 1 / (1 + dt * sum of
rates) of the chance to stay. x has the stimulus terms s and the unit's own history.
"""

from __future__ import annotations

from math import lgamma

import numpy as np

_TINY = np.finfo(float).eps
_log_factorial = np.vectorize(lambda c: lgamma(c + 1), otypes=[float])


def rate(u: np.ndarray) -> np.ndarray:
    return np.where(u <= 0, np.exp(np.minimum(u, 0)), 1 + u + u * u / 2)


def rate_slope(u: np.ndarray) -> np.ndarray:
    return np.where(u <= 0, np.exp(np.minimum(u, 0)), 1 + u)


def log_emission(y: np.ndarray, x: np.ndarray, spiking: np.ndarray, dt: float, family: str) -> np.ndarray:
    """Log likelihood of each bin's count in each state: (bins, states)."""
    lam = rate(x @ spiking.T) * dt
    if family == "poisson":
        return y[:, None] * np.log(lam + _TINY) - lam - _log_factorial(y)[:, None]
    return np.where(y[:, None] > 0, np.log(np.maximum(-np.expm1(-lam), _TINY)), -lam)


def transitions(s: np.ndarray, switching: np.ndarray, dt: float) -> np.ndarray:
    """Chance of every change into each bin but the first: (bins - 1, from, to). switching: (from, to, terms), its diagonal unused."""
    n = len(switching)
    odds = np.exp(np.einsum("tp,nmp->tnm", s[1:], switching)) * dt
    odds[:, range(n), range(n)] = 1.0
    return odds / odds.sum(axis=2, keepdims=True)


def forward(log_e: np.ndarray, a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered chances of the states and each bin's log scale, whose sum is the log likelihood."""
    top = log_e.max(axis=1)
    e = np.exp(log_e - top[:, None])
    out, scale = np.empty_like(e), np.empty(len(e))
    p = start
    for t in range(len(e)):
        p = (p if t == 0 else p @ a[t - 1]) * e[t]
        scale[t] = p.sum() + _TINY
        out[t] = p = p / scale[t]
    return out, np.log(scale) + top


def smooth(log_e: np.ndarray, a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chances of the states and of the changes given all bins, and the log likelihood."""
    alpha, scale = forward(log_e, a, start)
    e = np.exp(log_e - log_e.max(axis=1, keepdims=True))
    beta = np.ones_like(alpha)
    for t in range(len(e) - 2, -1, -1):
        b = a[t] @ (beta[t + 1] * e[t + 1])
        beta[t] = b / (b.sum() + _TINY)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    xi = alpha[:-1, :, None] * a * (beta[1:] * e[1:])[:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    return gamma, xi, float(scale.sum())


def _climb(theta: np.ndarray, value, step, rounds: int = 20) -> np.ndarray:
    """Newton steps, halved until the value doesn't fall."""
    now = value(theta)
    for _ in range(rounds):
        d = step(theta)
        for _ in range(30):
            new = value(theta + d)
            if new >= now:
                break
            d = d / 2
        else:
            break
        theta, gain, now = theta + d, new - now, new
        if gain < 1e-9 * (abs(now) + 1):
            break
    return theta


def _fit_spiking(theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, dt: float, family: str, ridge: float) -> np.ndarray:
    def value(k: np.ndarray) -> float:
        return float((w * log_emission(y, x, k[None], dt, family)[:, 0]).sum() - ridge / 2 * k @ k)

    def step(k: np.ndarray) -> np.ndarray:
        u = x @ k
        lam, slope = np.maximum(rate(u), _TINY), rate_slope(u)
        if family == "poisson":
            g, h = w * (y / lam - dt) * slope, w * dt * slope * slope / lam
        else:
            p = np.maximum(-np.expm1(-lam * dt), _TINY)
            g, h = w * np.where(y > 0, (1 - p) / p, -1.0) * dt * slope, w * (1 - p) / p * (dt * slope) ** 2
        return np.linalg.solve(x.T @ (x * h[:, None]) + (ridge + 1e-8) * np.eye(len(k)), x.T @ g - ridge * k)

    return _climb(theta, value, step)


def _fit_switching(theta: np.ndarray, s: np.ndarray, xi: np.ndarray, stay: int, dt: float, ridge: float) -> np.ndarray:
    """Filters of the changes from one state: theta (other states, terms), xi (bins - 1, states)."""
    others = [m for m in range(xi.shape[1]) if m != stay]
    total, wanted, s = xi.sum(axis=1), xi[:, others], s[1:]
    m, p = theta.shape

    def chances(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds = dt * np.exp(np.clip(s @ k.reshape(m, p).T, -50, 50))
        below = 1 + odds.sum(axis=1)
        return odds / below[:, None], np.log(below)

    def value(k: np.ndarray) -> float:
        return float((wanted * np.clip(s @ k.reshape(m, p).T, -50, 50)).sum() - total @ chances(k)[1] - ridge / 2 * k @ k)

    def step(k: np.ndarray) -> np.ndarray:
        q, _ = chances(k)
        g = ((wanted - total[:, None] * q).T @ s).ravel() - ridge * k
        h = np.zeros((m * p, m * p))
        for i in range(m):
            for j in range(m):
                h[i * p : i * p + p, j * p : j * p + p] = s.T @ (s * (total * (q[:, i] * (i == j) - q[:, i] * q[:, j]))[:, None])
        return np.linalg.solve(h + (ridge + 1e-6) * np.eye(m * p), g)

    return _climb(theta.ravel(), value, step).reshape(m, p)


def fit(y: np.ndarray, s: np.ndarray, x: np.ndarray, states: int, dt: float, family: str = "poisson", ridge: float = 0.0, rounds: int = 100, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Spiking filters (states, terms), switching filters (from, to, terms), first chances and log likelihood, by expectation and maximisation.

    It begins from rates spread around the mean, which orders the states; the bias is the first term.
    """
    spiking, switching = np.zeros((states, x.shape[1])), np.zeros((states, states, s.shape[1]))
    mean = max(float(y.mean()), 1e-3) / dt
    level = mean * np.linspace(0.5, 1.5, states) if states > 1 else np.array([mean])
    spiking[:, 0] = np.where(level <= 1, np.log(level), np.sqrt(np.maximum(2 * level - 1, 0)) - 1)  # the inverse of rate()
    switching[:, :, 0] = np.log(0.1 / dt / max(states - 1, 1))
    start, last = np.full(states, 1 / states), -np.inf
    for _ in range(rounds):
        gamma, xi, ll = smooth(log_emission(y, x, spiking, dt, family), transitions(s, switching, dt), start)
        if abs(ll - last) < tolerance:
            break
        last, start = ll, gamma[0]
        for n in range(states):
            spiking[n] = _fit_spiking(spiking[n], x, y, gamma[:, n], dt, family, ridge)
            others = [m for m in range(states) if m != n]
            if others:
                switching[n, others] = _fit_switching(switching[n, others], s, xi[:, n], n, dt, ridge)
    return spiking, switching, start, ll
