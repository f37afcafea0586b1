"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Tags are O and, for each kind k, B (1 + 2k) and I (2 + 2k). Both directions run in one loop over time, the second on
reversed characters; their states give each character a score a tag, and a linear chain with learned transitions (I only
after B or I of its kind; before the first character stands O) makes them a path. Training minimises the chain's negative
log-likelihood by Adam, with gradients by the forward-backward algorithm and back-propagation through time.

Decoding is in two steps, so that a text of any length can be cut to blocks: blocks() gives the best score of each block
for every tag before it and every tag at its end, and path() follows one block between two known tags.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Classes of characters: ASCII one by one, then other letters, digits, spaces, all else, and the place after a text's end.
LETTER, DIGIT, SPACE, OTHER, END, CLASSES = 128, 129, 130, 131, 132, 133
NEVER = -1e4


@cache
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane."""
    kind = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE}
    return np.array([c if c < 128 else kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(1 << 16)], np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point; those beyond the basic plane count as other characters."""
    return np.where(codes < 1 << 16, _classes()[np.minimum(codes, (1 << 16) - 1)], OTHER).astype(np.uint8)


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _best(x: np.ndarray, axis: int) -> np.ndarray:
    """log-sum-exp."""
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights: ``into`` (2, classes, 4h), ``again`` (2, h, 4h), ``out`` (2h, tags), ``bias`` (tags), ``move`` (tags, tags)."""

    def __init__(self, kinds: int, hidden: int = 16, seed: int = 0, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = 1 + 2 * kinds, hidden
        self.weights = {
            "into": rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)), "again": rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)),
            "out": rng.normal(0, hidden**-0.5, (2 * hidden, self.tags)), "bias": np.zeros(self.tags), "move": np.zeros((self.tags, self.tags)),
        }
        self.weights["into"][:, :, hidden : 2 * hidden] += 1.0  # gates that keep, to begin with
        self.weights = {k: v.astype(dtype) for k, v in self.weights.items()}
        at = np.arange(self.tags)
        inside = (at > 0) & (at % 2 == 0)
        allowed = ~inside[None] | (at[:, None] == at[None]) | (at[:, None] + 1 == at[None])
        self.forbidden = np.where(allowed, 0, NEVER).astype(dtype)

    @property
    def move(self) -> np.ndarray:
        return self.weights["move"] + self.forbidden

    def _forward(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (n, t, tags) of windows of classes (n, t), and what the way back needs."""
        n, t = ids.shape
        h = self.hidden
        w = self.weights
        both = np.stack([ids, ids[:, ::-1]])
        states = np.empty((t, 2, n, h), w["out"].dtype)
        state, cell, log = np.zeros((2, n, h), w["out"].dtype), np.zeros((2, n, h), w["out"].dtype), []
        for s in range(t):
            z = state @ w["again"]
            z[0] += w["into"][0][both[0, :, s]]
            z[1] += w["into"][1][both[1, :, s]]
            gates, fresh = _squash(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            before, was = cell, state
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * fresh
            seen = np.tanh(cell)
            state = gates[..., 2 * h :] * seen
            states[s] = state
            if keep:
                log.append((gates, fresh, before, was, seen))
        joined = np.concatenate([states[:, 0].transpose(1, 0, 2), states[::-1, 1].transpose(1, 0, 2)], axis=2)
        return joined @ w["out"] + w["bias"], joined, both, log

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self._forward(ids)[0]

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the windows' tags, and its gradient."""
        e, joined, both, log = self._forward(ids, keep=True)
        n, t, k = e.shape
        move, h, w = self.move, self.hidden, self.weights
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = move[0] + e[:, 0]
        for s in range(1, t):
            alpha[:, s] = _best(alpha[:, s - 1, :, None] + move, 1) + e[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = _best(move + (e[:, s + 1] + beta[:, s + 1])[:, None], 2)
        total = _best(alpha[:, -1], 1)
        before = np.c_[np.zeros(n, tags.dtype), tags[:, :-1]]
        own = np.take_along_axis(e, tags[..., None], 2)[..., 0].sum(axis=1) + move[before, tags].sum(axis=1)
        d = np.exp(alpha + beta - total[:, None, None])
        grad = {"move": np.zeros((k, k), e.dtype)}
        grad["move"][0] += d[:, 0].sum(axis=0)
        for s in range(1, t):
            grad["move"] += np.exp(alpha[:, s - 1, :, None] + move + (e[:, s] + beta[:, s] - total[:, None])[:, None]).sum(axis=0)
        np.add.at(grad["move"], (before.ravel(), tags.ravel()), -1)
        d[np.arange(n)[:, None], np.arange(t), tags] -= 1
        grad["bias"] = d.sum(axis=(0, 1))
        grad["out"] = np.einsum("nth,ntk->hk", joined, d)
        back = d @ w["out"].T
        back = np.stack([back[..., :h].transpose(1, 0, 2), back[:, ::-1, h:].transpose(1, 0, 2)], axis=1)  # t, 2, n, h
        grad["into"], grad["again"] = np.zeros_like(w["into"]), np.zeros_like(w["again"])
        dstate, dcell, steps = np.zeros_like(back[0]), np.zeros_like(back[0]), np.empty((2, t, n, 4 * h), e.dtype)
        for s in range(t - 1, -1, -1):
            gates, fresh, cell, state, seen = log[s]
            dstate = dstate + back[s]
            take, hold, show = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            dcell = dcell + dstate * show * (1 - seen * seen)
            dgates = np.concatenate([dcell * fresh, dcell * cell, dstate * seen], axis=2) * gates * (1 - gates)
            dz = np.concatenate([dgates, dcell * take * (1 - fresh * fresh)], axis=2)
            grad["again"] += state.transpose(0, 2, 1) @ dz
            steps[:, s] = dz
            dstate, dcell = dz @ w["again"].transpose(0, 2, 1), dcell * hold
        for direction in (0, 1):
            seen = both[direction].T.ravel()
            grad["into"][direction] = (np.arange(CLASSES)[:, None] == seen).astype(e.dtype) @ steps[direction].reshape(-1, 4 * h)
        return float((total - own).mean()), {name: g / n for name, g in grad.items()}

    def train(self, draw, steps: int, rate: float = 0.02) -> list[float]:
        """Adam over ``steps`` batches that draw(step) gives; the rate falls to a tenth."""
        first, second, losses = {k: np.zeros_like(v) for k, v in self.weights.items()}, {k: np.zeros_like(v) for k, v in self.weights.items()}, []
        for s in range(steps):
            loss, grad = self.gradient(*draw(s))
            losses.append(loss)
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            now = rate * (1 - 0.9 * s / steps)
            for name, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-12))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                step = now * (first[name] / (1 - 0.9 ** (s + 1))) / (np.sqrt(second[name] / (1 - 0.99 ** (s + 1))) + 1e-8)
                self.weights[name] = (self.weights[name] - step).astype(g.dtype)
        return losses

    def blocks(self, e: np.ndarray) -> np.ndarray:
        """Best score (n, before, last) of each block of scores (n, t, tags), for every tag before it and at its end."""
        move = self.move
        best = move[None] + e[:, 0, None]
        for s in range(1, e.shape[1]):
            best = (best[..., None] + move).max(axis=2) + e[:, s, None]
        return best

    def path(self, e: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best tags (n, t) of each block between the tag before it and the one at its end."""
        n, t, k = e.shape
        move = self.move
        best, came = move[before] + e[:, 0], np.zeros((n, t, k), np.int8)
        for s in range(1, t):
            reach = best[..., None] + move
            came[:, s] = reach.argmax(axis=1)
            best = reach.max(axis=1) + e[:, s]
        out = np.empty((n, t), np.int64)
        out[:, -1] = last
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = came[np.arange(n), s, out[:, s]]
        return out
