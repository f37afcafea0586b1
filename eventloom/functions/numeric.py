"""Small numpy kernels that grouped functions call: distributions, filters and bases."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest component is positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and signed eigenvectors of a covariance."""
    value, vector = np.linalg.eigh(cov)
    return np.maximum(value[::-1], 0), signed(vector[:, ::-1])


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees between the column spaces."""
    s = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    return np.degrees(np.arccos(np.clip(s, -1, 1)))


def rotation_amount(m: np.ndarray) -> float:
    """Geodesic size in [0, 1] of the nearest proper rotation, from the angles of its eigenvalues."""
    u, _, v = np.linalg.svd(m)
    d = np.ones(len(m))
    d[-1] = np.sign(np.linalg.det(u @ v))
    angles = np.angle(np.linalg.eigvals(u @ np.diag(d) @ v))
    return float(np.sqrt((angles**2).sum()) / (math.pi * math.sqrt(2 * (len(m) // 2)))) if len(m) > 1 else 0.0


def log_det_low_rank(x: np.ndarray, eps: float) -> float:
    """Logarithm of the determinant of eps * I + x x' by the smaller of the two Gram matrices."""
    p, n = x.shape
    small = x.T @ x if n <= p else x @ x.T
    return float(p * math.log(eps) + np.linalg.slogdet(np.eye(len(small)) + small / eps)[1])


def shares(n: np.ndarray, means: np.ndarray, outer: np.ndarray, ridge: float | None = None, fraction: float = 0.0) -> tuple[float, float, float, float, float | None]:
    """What classes explain of several dimensions together, from their counts, means and all rows' outer products: trace, largest root, Pillai's mean root, 1 - Wilks' lambda, and the log determinant of ridge + between-class products (None without a ridge).

    ``ridge`` is added to the total products' diagonal, by default ``fraction`` of their mean; without one, dimensions of no variance don't count.
    """
    mean = n @ means / n.sum()
    total = outer - n.sum() * np.outer(mean, mean)
    all_ = float(np.trace(total))
    b = ((means - mean) * np.sqrt(n)[:, None]).T
    if len(n) < 2 or all_ <= 0:
        return 0.0, 0.0, 0.0, 0.0, None
    eps = fraction * all_ / len(total) if ridge is None else ridge
    value, vector = np.linalg.eigh((total + total.T) / 2)
    value = np.maximum(value, 0.0) + eps
    keep = value > max(len(total), n.sum()) * np.finfo(float).eps * value[-1]
    c = (vector[:, keep].T @ b) / np.sqrt(value[keep])[:, None]
    roots = np.sort(np.clip(np.linalg.eigvalsh(c.T @ c), 0.0, 1.0))[::-1][: len(n) - 1]
    wilks = 1 - math.exp(np.log(np.maximum(1 - roots, np.finfo(float).tiny)).sum())
    return float((b**2).sum() / all_), float(roots[0]), float(roots.sum() / len(roots)), wilks, log_det_low_rank(b, eps) if eps > 0 else None


def shuffled_tables(table: np.ndarray, shuffles: int, seed: int) -> np.ndarray:
    """Tables (shuffles, rows, columns) with the sums of a table of counts, as permuting one label against the other makes them."""
    rng = np.random.default_rng(seed)
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    out = np.zeros((shuffles, *table.shape), np.int64)
    for s in range(shuffles):
        left = columns.copy()
        for i, k in enumerate(rows[:-1]):
            out[s, i] = rng.multivariate_hypergeometric(left, k, method="marginals")
            left = left - out[s, i]
        out[s, -1] = left
    return out


def information(tables: np.ndarray) -> np.ndarray:
    """Bits that rows tell of columns, of tables of counts (..., rows, columns)."""
    p = tables / np.maximum(tables.sum(axis=(-2, -1), keepdims=True), 1)
    apart = p.sum(axis=-1, keepdims=True) * p.sum(axis=-2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / apart), 0.0).sum(axis=(-2, -1))


def map_information(p: np.ndarray, occupancy: np.ndarray, level: float) -> np.ndarray:
    """Bits of maps (..., bins) of shares against one level; empty and zero bins count nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        term = p * occupancy * np.log2(p / level)
    return np.where((p > 0) & (level > 0), term, 0.0).sum(axis=-1)


def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """The first k Slepian sequences, from the symmetric tridiagonal problem."""
    i = np.arange(n)
    main = ((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * nw / n)
    side = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(main) + np.diag(side, 1) + np.diag(side, -1))
    return signed(v[:, ::-1][:, :k])


def band_pass(x: np.ndarray, fs: float, lo: float | None, hi: float | None, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth response applied in the frequency domain, the signal mirrored at its ends."""
    pad = min(len(x) - 1, int(3 * fs / max(lo or hi or 1, 1e-9)) + 1)
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]] if pad > 0 else x
    f = np.fft.rfftfreq(len(y), 1 / fs)
    gain = np.ones(len(f))
    with np.errstate(divide="ignore", over="ignore"):
        if lo:
            gain /= 1 + (lo / np.maximum(f, 1e-12)) ** (2 * order)
        if hi:
            gain /= 1 + (f / hi) ** (2 * order)
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[pad : pad + len(x)]


def envelope(x: np.ndarray) -> np.ndarray:
    """Amplitude of the analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def glm(x: np.ndarray, y: np.ndarray, family: str = "poisson", alpha: float = 0.0, l1: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and deviance of an elastic-net GLM by reweighted coordinate descent."""
    n, p = x.shape
    beta, b0 = np.zeros(p), {"poisson": math.log(max(y.mean(), 1e-9)), "binomial": math.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9)), "gaussian": y.mean()}[family]
    for _ in range(rounds):
        eta = np.clip(x @ beta + b0, -30, 30)
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta)) if family == "binomial" else eta
        w = mu if family == "poisson" else mu * (1 - mu) if family == "binomial" else np.ones(n)
        w = np.maximum(w, 1e-9)
        z = eta + (y - mu) / w
        old = np.r_[beta, b0]
        r = z - x @ beta - b0
        for _ in range(5):
            d = (w * r).sum() / w.sum()
            b0 += d
            r -= d
            for j in range(p):
                xj = x[:, j]
                s = (w * xj * xj).sum() / n
                if s == 0:
                    continue
                g = (w * xj * r).sum() / n + s * beta[j]
                new = np.sign(g) * max(abs(g) - alpha * l1, 0) / (s + alpha * (1 - l1))
                r -= xj * (new - beta[j])
                beta[j] = new
        if np.abs(np.r_[beta, b0] - old).max() < 1e-9:
            break
    eta = np.clip(x @ beta + b0, -30, 30)
    with np.errstate(divide="ignore", invalid="ignore"):
        if family == "poisson":
            mu = np.exp(eta)
            dev = 2 * (np.where(y > 0, y * np.log(y / mu), 0) - (y - mu)).sum()
        elif family == "binomial":
            mu = 1 / (1 + np.exp(-eta))
            dev = -2 * (y * np.log(mu) + (1 - y) * np.log1p(-mu)).sum()
        else:
            dev = ((y - eta) ** 2).sum()
    return beta, float(b0), float(dev)


def _likelihoods(counts: np.ndarray, rates: np.ndarray) -> tuple[list[list[float]], float]:
    """Each bin's likelihood of each state over the bin's greatest, and the sum of the greatest's logarithms."""
    log_b = counts[:, None] * np.log(np.maximum(rates, 1e-12)) - rates
    top = log_b.max(axis=1)
    return np.exp(log_b - top[:, None]).tolist(), float(top.sum())


def _forward(b: list[list[float]], k: int, stay: float) -> tuple[list[list[float]], list[float]]:
    """Filtered chances and scales; plain numbers, since states are few and bins follow one another."""
    off = (1 - stay) / max(k - 1, 1)
    p, out, scale = [1 / k] * k, [], []
    for t, own in enumerate(b):
        w = [x * (off + (stay - off) * y) for x, y in zip(own, p, strict=True)] if t or k == 1 else [x * y for x, y in zip(own, p, strict=True)]
        c = sum(w)
        p = [x / c for x in w]
        out.append(p)
        scale.append(c)
    return out, scale


def hmm_filter(counts: np.ndarray, rates: np.ndarray, stay: float) -> np.ndarray:
    """Forward probabilities of Poisson states with one staying probability."""
    return np.array(_forward(_likelihoods(counts, rates)[0], len(rates), stay)[0]).reshape(len(counts), len(rates))


def hmm_fit(counts: np.ndarray, states: int = 2, rounds: int = 100) -> tuple[np.ndarray, float, float]:
    """Rates, staying probability and log-likelihood of a Poisson HMM by scaled forward and backward passes."""
    rates = np.quantile(counts, (np.arange(states) + 0.5) / states) + np.arange(states) * 0.5 + 0.1
    stay, last, n = 0.9, -np.inf, len(counts)
    for _ in range(rounds):
        b, top = _likelihoods(counts, rates)
        a, c = _forward(b, states, stay)
        off = (1 - stay) / max(states - 1, 1)
        back, same = [[1.0] * states], 0.0
        for t in range(n - 2, -1, -1):
            x = [u * v / c[t + 1] for u, v in zip(b[t + 1], back[-1], strict=True)]
            same += stay * sum(u * v for u, v in zip(a[t], x, strict=True))
            total = off * sum(x)
            back.append([total + (stay - off) * v for v in x])
        gamma = np.array(a) * np.array(back[::-1])
        gamma /= gamma.sum(axis=1, keepdims=True)
        rates = np.maximum((gamma * counts[:, None]).sum(axis=0) / gamma.sum(axis=0), 1e-6)
        stay = float(np.clip(same / max(n - 1, 1), 0.01, 0.999))
        ll = float(np.log(c).sum() + top)
        if abs(ll - last) < 1e-8 * abs(ll):
            break
        last = ll
    order = np.argsort(rates)
    return rates[order], stay, ll


def zeta(spikes: np.ndarray, events: np.ndarray, window: float, resamples: int = 100, seed: int = 0) -> tuple[float, float, float]:
    """ZETA statistic: greatest deviation of the mean-centred cumulative spike times after events, its z and p.

    The null jitters the events by up to two windows; a Gumbel curve through the null's
    mean and variance gives p.
    """
    def deviation(at: np.ndarray) -> tuple[float, float]:
        rel = np.concatenate([spikes[np.searchsorted(spikes, e) : np.searchsorted(spikes, e + window)] - e for e in at]) if len(at) else np.zeros(0)
        if len(rel) < 3:
            return 0.0, 0.0
        rel = np.sort(rel)
        d = (np.arange(len(rel)) + 1) / len(rel) - rel / window
        d -= d.mean()
        i = int(np.abs(d).argmax())
        return float(abs(d[i])), float(rel[i])

    own, latency = deviation(events)
    rng = np.random.default_rng(seed)
    null = np.array([deviation(events + rng.uniform(-2 * window, 2 * window, len(events)))[0] for _ in range(resamples)])
    spread = null.var(ddof=1)
    if own == 0 or spread == 0:
        return 0.0, 1.0, latency
    beta = math.sqrt(6 * spread) / math.pi
    p = -math.expm1(-math.exp(-(own - (null.mean() - 0.5772156649 * beta)) / beta))
    return own, max(p, 1e-300), latency


def demix(cells: np.ndarray, noise: np.ndarray, marginals: dict[str, np.ndarray], components: int, ridge: float) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Decoder, encoder and explained share of each marginalisation (units x conditions matrices)."""
    x = cells - cells.mean(axis=1, keepdims=True)
    total = (x**2).sum()
    inverse = np.linalg.inv(x @ x.T + noise + (math.sqrt(total) * ridge) ** 2 * np.eye(len(x)))
    out = {}
    for name, m in marginals.items():
        c = m @ x.T @ inverse
        u = np.linalg.svd(c @ x, full_matrices=False)[0][:, :components]
        w = (u.T @ c).T
        flip = np.where(np.sign(w).sum(axis=0) < 0, -1.0, 1.0)
        u, w = u * flip, w * flip
        share = np.array([100 - 100 * ((x - np.outer(u[:, k], w[:, k] @ x)) ** 2).sum() / total for k in range(u.shape[1])])
        order = np.argsort(-share)
        out[name] = (w[:, order], u[:, order], share[order])
    return out
