"""A small reverse-mode differentiator over NumPy, for models that train inside Arrow tasks."""

from __future__ import annotations

import numpy as np


class Var:
    """A value in a computation whose gradient can be asked for."""

    __array_priority__ = 100

    def __init__(self, value, parents: tuple = (), back=None):
        self.value = np.asarray(value, dtype=np.float64)
        self.parents, self.back, self.grad = parents, back, None

    @property
    def shape(self):
        return self.value.shape

    def __add__(self, other):
        other = as_var(other)
        return Var(self.value + other.value, (self, other), lambda g: (_fit(g, self.shape), _fit(g, other.shape)))

    __radd__ = __add__

    def __neg__(self):
        return Var(-self.value, (self,), lambda g: (-g,))

    def __sub__(self, other):
        return self + (-as_var(other))

    def __rsub__(self, other):
        return as_var(other) + (-self)

    def __mul__(self, other):
        other = as_var(other)
        return Var(self.value * other.value, (self, other), lambda g: (_fit(g * other.value, self.shape), _fit(g * self.value, other.shape)))

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self * power(as_var(other), -1.0)

    def __matmul__(self, other):
        other = as_var(other)
        if other.value.ndim == 2 and self.value.ndim > 2:  # one product, not one for each of the leading places
            rows, out = self.value.reshape(-1, self.shape[-1]), other.shape[1]
            return Var((rows @ other.value).reshape(*self.shape[:-1], out), (self, other), lambda g: ((g.reshape(-1, out) @ other.value.T).reshape(self.shape), rows.T @ g.reshape(-1, out)))
        return Var(self.value @ other.value, (self, other), lambda g: (_fit(g @ np.swapaxes(other.value, -1, -2), self.shape), _fit(np.swapaxes(self.value, -1, -2) @ g, other.shape)))

    def __getitem__(self, key):
        parts = key if isinstance(key, tuple) else (key,)

        def back(g):
            out = np.zeros(self.shape)
            if all(isinstance(k, (int, slice)) for k in parts):
                out[key] = g
            elif len(parts) == 2 and isinstance(parts[0], slice) and parts[0] == slice(None) and isinstance(parts[1], np.ndarray) and parts[1].dtype.kind == "i" and self.value.ndim == 3 and parts[1].size * self.shape[1] <= 4096:
                hit = np.zeros((self.shape[1], parts[1].size))
                hit[parts[1].ravel(), np.arange(parts[1].size)] = 1.0
                out = hit @ g.reshape(self.shape[0], parts[1].size, -1)
            else:
                np.add.at(out, key, g)
            return (out,)

        return Var(self.value[key], (self,), back)

    def sum(self, axis=None, keepdims=False):
        def back(g):
            g = g if keepdims or axis is None else np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.shape),)

        return Var(self.value.sum(axis=axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims=False):
        n = self.value.size if axis is None else self.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def max(self, axis):
        top = self.value.max(axis=axis, keepdims=True)
        hit = self.value == top
        hit = hit / hit.sum(axis=axis, keepdims=True)
        return Var(top.squeeze(axis), (self,), lambda g: (np.expand_dims(g, axis) * hit,))

    def reshape(self, *shape):
        return Var(self.value.reshape(*shape), (self,), lambda g: (g.reshape(self.shape),))

    def swap(self, a: int = -1, b: int = -2):
        return Var(np.swapaxes(self.value, a, b), (self,), lambda g: (np.swapaxes(g, a, b),))

    def backward(self) -> None:
        """Gradients of this scalar in ``grad`` of everything it depends on."""
        order, seen = [], set()

        def visit(v: Var) -> None:
            stack = [(v, False)]
            while stack:
                node, done = stack.pop()
                if done:
                    order.append(node)
                elif id(node) not in seen:
                    seen.add(id(node))
                    stack.append((node, True))
                    stack += [(p, False) for p in node.parents]

        visit(self)
        self.grad = np.ones(self.shape)
        for node in reversed(order):
            if node.back is None or node.grad is None:
                continue
            for parent, g in zip(node.parents, node.back(node.grad), strict=True):
                parent.grad = g if parent.grad is None else parent.grad + g


def sum_at(at: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by place, for n places each of which has one at least."""
    out, place, own = np.empty((n, g.shape[1])), np.empty(n, np.int64), np.arange(len(at))
    out[at], place[at] = g, own  # the last of equal places stands
    if n < len(at):
        rest = np.flatnonzero(place[at] != own)
        np.add.at(out.reshape(-1), (at[rest, None] * g.shape[1] + np.arange(g.shape[1])).ravel(), g[rest].ravel())
    return out


def weighted_sum(x: Var, w: np.ndarray) -> Var:
    """Sums over the second axis of ``x`` with fixed weights (rows, places)."""
    return Var((w[:, None, :] @ x.value)[:, 0], (x,), lambda g: (w[:, :, None] * g[:, None, :],))


def take_rows(x: Var, at: np.ndarray) -> Var:
    """``x[at]`` where every row of ``x`` is taken at least once."""
    def back(g):
        return (sum_at(at.ravel(), g.reshape(-1, x.shape[1]), x.shape[0]),)

    return Var(x.value[at], (x,), back)


def as_var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """Sum a gradient over the axes along which its operand was broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def _unary(x: Var, value: np.ndarray, slope: np.ndarray) -> Var:
    return Var(value, (x,), lambda g: (g * slope,))


def exp(x):
    v = np.exp(as_var(x).value)
    return _unary(as_var(x), v, v)


def log(x):
    return _unary(as_var(x), np.log(as_var(x).value), 1 / as_var(x).value)


def power(x, p: float):
    v = as_var(x).value
    return _unary(as_var(x), v**p, p * v ** (p - 1))


def relu(x):
    v = as_var(x).value
    return _unary(as_var(x), np.maximum(v, 0), (v > 0).astype(float))


def leaky_relu(x, slope: float = 0.2):
    v = as_var(x).value
    return _unary(as_var(x), np.where(v > 0, v, slope * v), np.where(v > 0, 1.0, slope))


def elu(x):
    v = as_var(x).value
    e = np.exp(np.minimum(v, 0))
    return _unary(as_var(x), np.where(v > 0, v, e - 1), np.where(v > 0, 1.0, e))


def tanh(x):
    v = np.tanh(as_var(x).value)
    return _unary(as_var(x), v, 1 - v * v)


def sigmoid(x):
    v = 1 / (1 + np.exp(-np.clip(as_var(x).value, -500, 500)))
    return _unary(as_var(x), v, v * (1 - v))


def softplus(x):
    v = as_var(x).value
    return _unary(as_var(x), np.logaddexp(0, v), 1 / (1 + np.exp(-np.clip(v, -500, 500))))


def softmax(x, axis: int = -1):
    x = as_var(x)
    e = exp(x - x.value.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def log_softmax(x, axis: int = -1):
    x = as_var(x)
    s = x - x.value.max(axis=axis, keepdims=True)
    return s - log(exp(s).sum(axis=axis, keepdims=True))


def concat(parts: list, axis: int = -1):
    parts = [as_var(p) for p in parts]
    cuts = np.cumsum([p.shape[axis] for p in parts])[:-1]
    return Var(np.concatenate([p.value for p in parts], axis), tuple(parts), lambda g: tuple(np.split(g, cuts, axis)))


def stack(parts: list, axis: int = 1):
    parts = [as_var(p) for p in parts]
    return Var(np.stack([p.value for p in parts], axis), tuple(parts), lambda g: tuple(np.moveaxis(g, axis, 0)))


def rms_norm(x, scale, eps: float = 1e-8):
    x = as_var(x)
    return x * power((x * x).mean(-1, True) + eps, -0.5) * scale


def unit(x, eps: float = 1e-12):
    x = as_var(x)
    return x * power((x * x).sum(-1, True) + eps, -0.5)
