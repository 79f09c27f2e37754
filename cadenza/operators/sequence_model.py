"""A bidirectional LSTM classifier over feature sequences, in numpy, for use inside Spark tasks.

Layers read both directions; outputs are pooled over time (mean and maximum), projected, normalised
and classified by two linear layers. All weights, the projection's too, are parameters of the model.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass(frozen=True)
class Shape:
    """Sizes of the model."""

    inputs: int
    hidden: int = 128
    layers: int = 2
    classes: int = 5

    def sizes(self) -> dict[str, tuple[int, ...]]:
        """Parameter names and shapes."""
        h, out = self.hidden, {}
        for layer in range(self.layers):
            for way in ("forward", "backward"):
                name = f"lstm{layer}.{way}"
                out |= {f"{name}.x": (self.inputs if not layer else 2 * h, 4 * h), f"{name}.h": (h, 4 * h), f"{name}.b": (4 * h,)}
        return out | {
            "project.w": (4 * h, 2 * h), "project.b": (2 * h,), "norm.gain": (2 * h,), "norm.bias": (2 * h,),
            "dense.w": (2 * h, h), "dense.b": (h,), "out.w": (h, self.classes), "out.b": (self.classes,),
        }

    def new(self, seed: int) -> Params:
        rng = np.random.default_rng(seed)
        bound = lambda s: 1 / np.sqrt(s[0] if len(s) > 1 else self.hidden)
        params = {k: rng.uniform(-bound(s), bound(s), s).astype(np.float32) for k, s in self.sizes().items()}
        return params | {"norm.gain": np.ones(2 * self.hidden, np.float32), "norm.bias": np.zeros(2 * self.hidden, np.float32)}

    def as_dict(self) -> dict[str, int]:
        return asdict(self)


def scan(x: np.ndarray, p: Params, name: str) -> tuple[np.ndarray, tuple]:
    """Hidden states (batch, time, hidden) of one direction, and what its gradient needs."""
    wx, wh, b = p[f"{name}.x"], p[f"{name}.h"], p[f"{name}.b"]
    n, t, h = len(x), x.shape[1], len(wh)
    pre, state, cell = x @ wx + b, np.zeros((n, t + 1, h), wh.dtype), np.zeros((n, t + 1, h), wh.dtype)
    gates = np.zeros((n, t, 4 * h), wh.dtype)
    for i in range(t):
        z = pre[:, i] + state[:, i] @ wh
        g = gates[:, i]
        g[:, : 3 * h], g[:, 3 * h :] = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        cell[:, i + 1] = g[:, h : 2 * h] * cell[:, i] + g[:, :h] * g[:, 3 * h :]
        state[:, i + 1] = g[:, 2 * h : 3 * h] * np.tanh(cell[:, i + 1])
    return state[:, 1:], (x, state, cell, gates)


def unscan(up: np.ndarray, p: Params, name: str, kept: tuple, grads: Params) -> np.ndarray:
    """Gradient of the input, given that of the hidden states; weights' gradients go to grads."""
    x, state, cell, gates = kept
    wx, wh = p[f"{name}.x"], p[f"{name}.h"]
    h, t = len(wh), x.shape[1]
    dz = np.zeros_like(gates)
    dh, dc = np.zeros_like(state[:, 0]), np.zeros_like(state[:, 0])
    for i in reversed(range(t)):
        g, tanh = gates[:, i], np.tanh(cell[:, i + 1])
        enter, keep, leave, new = (g[:, k * h : (k + 1) * h] for k in range(4))
        dh = dh + up[:, i]
        dc = dc + dh * leave * (1 - tanh**2)
        dz[:, i] = np.concatenate(
            [dc * new * enter * (1 - enter), dc * cell[:, i] * keep * (1 - keep), dh * tanh * leave * (1 - leave), dc * enter * (1 - new**2)], axis=1
        )
        dh, dc = dz[:, i] @ wh.T, dc * keep
    flat = dz.reshape(-1, 4 * h)
    grads[f"{name}.x"] = x.reshape(-1, x.shape[2]).T @ flat
    grads[f"{name}.h"] = state[:, :-1].reshape(-1, h).T @ flat
    grads[f"{name}.b"] = flat.sum(axis=0)
    return dz @ wx.T


def forward(p: Params, shape: Shape, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
    """Logits (batch, classes), and what backward() needs. drop: share of values left out while training."""
    tape: list = []

    def dropped(v: np.ndarray) -> np.ndarray:
        mask = np.ones((), np.float32) if not drop or rng is None else (rng.random(v.shape) >= drop).astype(np.float32) / (1 - drop)
        tape.append(mask)
        return v * mask

    y = x.astype(p["out.w"].dtype)
    for layer in range(shape.layers):
        if layer:
            y = dropped(y)
        a, kept_a = scan(y, p, f"lstm{layer}.forward")
        b, kept_b = scan(y[:, ::-1], p, f"lstm{layer}.backward")
        tape.append((kept_a, kept_b))
        y = np.concatenate([a, b[:, ::-1]], axis=2)
    pooled = np.concatenate([y.mean(axis=1), y.max(axis=1)], axis=1)
    z = pooled @ p["project.w"] + p["project.b"]
    centred = z - z.mean(axis=1, keepdims=True)
    scale = 1 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
    unit = centred * scale
    normed = unit * p["norm.gain"] + p["norm.bias"]
    dense = normed @ p["dense.w"] + p["dense.b"]
    hidden = dropped(np.maximum(dense, 0))
    tape.append((y, pooled, scale, unit, normed, dense, hidden))
    return hidden @ p["out.w"] + p["out.b"], tape


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradients(p: Params, shape: Shape, x: np.ndarray, target: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, Params]:
    """Mean cross-entropy of a batch, and its gradient."""
    logits, tape = forward(p, shape, x, drop, rng)
    probs, n = probabilities(logits), len(x)
    loss = -float(np.log(np.maximum(probs[np.arange(n), target], 1e-30)).mean())
    d = probs.copy()
    d[np.arange(n), target] -= 1
    d /= n
    y, pooled, scale, unit, normed, dense, hidden = tape.pop()
    g: Params = {"out.w": hidden.T @ d, "out.b": d.sum(axis=0)}
    d = d @ p["out.w"].T * tape.pop() * (dense > 0)
    g |= {"dense.w": normed.T @ d, "dense.b": d.sum(axis=0)}
    d = d @ p["dense.w"].T
    g |= {"norm.gain": (d * unit).sum(axis=0), "norm.bias": d.sum(axis=0)}
    d = d * p["norm.gain"]
    d = scale * (d - d.mean(axis=1, keepdims=True) - unit * (d * unit).mean(axis=1, keepdims=True))
    g |= {"project.w": pooled.T @ d, "project.b": d.sum(axis=0)}
    d = d @ p["project.w"].T
    mean, most = np.split(d, 2, axis=1)
    up = np.repeat(mean[:, None] / y.shape[1], y.shape[1], axis=1)
    at = y.argmax(axis=1)
    np.add.at(up, (np.arange(n)[:, None], at, np.arange(y.shape[2])[None]), most)
    for layer in reversed(range(shape.layers)):
        kept_a, kept_b = tape.pop()
        h = shape.hidden
        down = unscan(up[:, :, :h], p, f"lstm{layer}.forward", kept_a, g)
        down = down + unscan(up[:, ::-1, h:], p, f"lstm{layer}.backward", kept_b, g)[:, ::-1]
        up = down * tape.pop() if layer else down
    return loss, g


def clipped(g: Params, limit: float | None) -> Params:
    """Gradients scaled to a joint L2 norm of limit at most."""
    if not limit:
        return g
    norm = float(np.sqrt(sum((v.astype(float) ** 2).sum() for v in g.values())))
    return {k: v * min(1.0, limit / (norm + 1e-6)) for k, v in g.items()}


class Adam:
    """Moments of the gradients; weight decay is added to the gradient."""

    def __init__(self, rate: float, decay: float, first: Params | None = None, second: Params | None = None, step: int = 0):
        self.rate, self.decay, self.first, self.second, self.step = rate, decay, first or {}, second or {}, step

    def update(self, p: Params, g: Params) -> Params:
        self.step += 1
        out = {}
        for k, v in p.items():
            d = g[k] + self.decay * v
            self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * d
            self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * d * d
            move = self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)
            out[k] = (v - self.rate * move).astype(np.float32)
        return out
