"""A gated recurrent layer in numpy: forward, and backward through time.  Lanes are columns."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(pre: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Next state; ``pre`` (3H, lanes) holds the input's part of gates z, r and the candidate."""
    n = len(h)
    g = u @ h
    a = pre[: 2 * n] + g[: 2 * n]
    sigmoid(a)
    c = g[2 * n :]
    c *= a[n:]
    c += pre[2 * n :]
    np.tanh(c, out=c)
    out = h - c
    out *= a[:n]
    out += c
    return out


class Tape:
    """What ``forward`` keeps for ``backward``."""

    def __init__(self, u: np.ndarray):
        self.u, self.steps = u, []

    def forward(self, pre: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States (T, H, lanes) for inputs ``pre`` (T, 3H, lanes) from the state ``h``."""
        n, out = len(h), np.empty((len(pre), *h.shape), h.dtype)
        for t in range(len(pre)):
            g = self.u @ h
            a = sigmoid(pre[t, : 2 * n] + g[: 2 * n])
            z, r = a[:n], a[n:]
            c = np.tanh(pre[t, 2 * n :] + r * g[2 * n :])
            self.steps.append((h, z, r, c, g[2 * n :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def backward(self, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``pre`` and ``u`` from those of the states; none flows into the first state."""
        t_max, n, lanes = grad.shape
        dpre = np.empty((t_max, 3 * n, lanes), grad.dtype)
        du = np.zeros_like(self.u)
        carry = np.zeros((n, lanes), grad.dtype)
        for t in range(t_max - 1, -1, -1):
            h, z, r, c, gc = self.steps[t]
            dh = grad[t] + carry
            dc = dh * (1 - z) * (1 - c * c)
            d = dpre[t]
            d[:n] = dh * (h - c) * z * (1 - z)
            d[n : 2 * n] = dc * gc * r * (1 - r)
            d[2 * n :] = dc
            dg = d.copy()
            dg[2 * n :] *= r
            du += dg @ h.T
            carry = dh * z + self.u.T @ dg
        return dpre, du


class Adam:
    """Adam steps on a dict of arrays, gradients clipped to a joint norm."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 5.0):
        self.rate, self.clip, self.t = rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = min(1.0, self.clip / (norm + 1e-9))
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * np.float32(shrink)
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            params[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))
