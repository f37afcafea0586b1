"""Recursive filters: Butterworth and Chebyshev (type II) designs as second-order sections, and how a stretch of samples passes them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Samples that pass a filter in one matrix product.
STRETCH = 64


def _prototype(kind: str, order: int, ripple: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analogue low-pass filter with its edge at 1 (Butterworth: half power; Chebyshev: the stop band begins, ``ripple`` dB down)."""
    angle = math.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    if kind == "butter":
        return np.zeros(0, complex), np.exp(1j * (angle + math.pi / 2)), 1.0
    if kind != "cheby2":
        raise ValueError(f"unknown filter {kind!r}")
    mu = math.asinh(math.sqrt(10 ** (ripple / 10) - 1)) / order
    poles = 1 / (-math.sinh(mu) * np.sin(angle) + 1j * math.cosh(mu) * np.cos(angle))
    zeros = np.array([1j / math.cos(a) for a in angle if abs(math.cos(a)) > 1e-12])
    return zeros, poles, float(np.real(np.prod(-poles) / np.prod(-zeros)))


def sections(kind: str, order: int, band: tuple[float, float], fs: float, ripple: float = 20.0) -> np.ndarray:
    """Second-order sections (k, 6: b0 b1 b2 1 a1 a2) for a band in Hz.

    (0, high) is a low pass, (low, infinity or more than half of fs) a high pass, low < high a band pass and high, low a
    band stop. ``order`` is that of the low pass behind it; a band pass or stop has twice as many poles.
    """
    z, p, k = _prototype(kind, order, ripple)
    warp = lambda f: 2 * math.tan(math.pi * f / fs)
    lo, hi = band
    if lo == hi:
        raise ValueError("the band has no width")
    more = len(p) - len(z)
    if hi > fs / 2 or lo == 0:  # high or low pass
        w = warp(hi if lo == 0 and hi <= fs / 2 else lo)
        if hi > fs / 2:
            k = k * np.real(np.prod(-z) / np.prod(-p))
            z, p = np.r_[w / z, np.zeros(more)], w / p
        else:
            z, p, k = z * w, p * w, k * w**more
    else:
        a, b = warp(min(band)), warp(max(band))
        width, middle = b - a, a * b
        split = lambda x: np.r_[x + np.sqrt(x * x - middle + 0j), x - np.sqrt(x * x - middle + 0j)]
        if lo < hi:
            z, p, k = np.r_[split(z * width / 2), np.zeros(more)], split(p * width / 2), k * width**more
        else:
            k = k * np.real(np.prod(-z) / np.prod(-p))
            ends = 1j * math.sqrt(middle)
            z, p = np.r_[split(width / 2 / z), np.full(more, ends), np.full(more, -ends)], split(width / 2 / p)
    more = len(p) - len(z)
    k = float(np.real(k * np.prod(2 - z) / np.prod(2 - p)))
    z, p = np.r_[(2 + z) / (2 - z), -np.ones(more)], (2 + p) / (2 - p)
    return _paired(z, p, k)


def _quadratics(roots: np.ndarray) -> list[np.ndarray]:
    """Real polynomials of degree two (at most one of degree one) of conjugate or real roots."""
    pairs = [np.real(np.poly([r, np.conj(r)])) for r in roots[roots.imag > 1e-10]]
    real = np.sort(roots[np.abs(roots.imag) <= 1e-10].real)
    return pairs + [np.poly(real[i : i + 2]) for i in range(0, len(real) - 1, 2)] + ([np.array([1.0, -real[-1], 0.0])] if len(real) % 2 else [])


def _paired(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Poles nearest to the circle last, each with the zeros nearest to them."""
    below, above = sorted(_quadratics(p), key=lambda q: abs(q[2])), _quadratics(z)
    out = []
    for q in reversed(below):
        place = lambda c: np.sort_complex(np.roots(c)) if np.any(c) else np.zeros(0)
        best = min(range(len(above)), key=lambda i: abs(place(above[i]) - place(q)).sum()) if above else None
        out.append(np.r_[above.pop(best) if best is not None else [1.0, 0.0, 0.0], q])
    out = np.array(out[::-1])
    out[0, :3] *= k
    return out


def gain(sos: np.ndarray, f: np.ndarray, fs: float) -> np.ndarray:
    """Complex response at frequencies."""
    x = np.exp(-2j * math.pi * np.asarray(f) / fs)
    powers = np.stack([np.ones_like(x), x, x * x])
    return np.prod((sos[:, :3] @ powers) / (sos[:, 3:] @ powers), axis=0)


class Cascade:
    """Sections one after another as a linear system z' = A z + B x, y = C z + D x, with two numbers of state a section."""

    def __init__(self, sos: np.ndarray):
        n = 2 * len(sos)
        self.a, self.b, self.c, self.d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            own = slice(2 * i, 2 * i + 2)
            into, keep = np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([[-a1, 1.0], [-a2, 0.0]])
            self.a[own] = np.outer(into, self.c)  # what comes in is what the sections before put out
            self.a[own, own] += keep
            self.b[own] = into * self.d
            self.c = self.c * b0
            self.c[2 * i] += 1.0
            self.d *= b0
        self.rest = np.linalg.solve(np.eye(n) - self.a, self.b)  # where a constant 1 leads
        seen, reach = [self.c], [self.b]
        for _ in range(STRETCH - 1):
            seen.append(seen[-1] @ self.a)
            reach.append(self.a @ reach[-1])
        self.seen, self.reach = np.stack(seen), np.stack(reach[::-1], axis=1)
        pulse = np.r_[self.d, self.seen[:-1] @ self.b]
        i = np.arange(STRETCH)
        self.pulse = np.where(i[:, None] >= i, pulse[np.abs(i[:, None] - i)], 0.0)
        self.ahead = np.linalg.matrix_power(self.a, STRETCH)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What comes out of samples x, and the state after them."""
        full = len(x) // STRETCH
        rows = x[: full * STRETCH].reshape(full, STRETCH)
        inner, into, out = rows @ self.pulse.T, rows @ self.reach.T, []
        for i in range(full):
            out.append(inner[i] + self.seen @ z)
            z = self.ahead @ z + into[i]
        tail = x[full * STRETCH :]
        if len(tail):
            m = len(tail)
            out.append(self.pulse[:m, :m] @ tail + self.seen[:m] @ z)
            z = np.linalg.matrix_power(self.a, m) @ z + self.reach[:, STRETCH - m :] @ tail
        return (np.concatenate(out) if out else np.zeros(0)), z


@lru_cache(16)
def cascade(sos: tuple[tuple[float, ...], ...]) -> Cascade:
    return Cascade(np.array(sos))
