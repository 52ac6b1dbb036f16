"""The convolutional layer that the byte-level networks share, in numpy.

A byte has 256 values, so a filter is a table of one number per (offset, byte) and a
convolution is a sum of table rows.
"""

from __future__ import annotations

import numpy as np


def convolve(table: np.ndarray, bias: np.ndarray, rows: np.ndarray, real: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(maxima, where): each filter's rectified maximum over the first ``real`` positions of every row of bytes.

    ``table`` is (kernel, 256, filters); ``rows`` (n, width) bytes.
    """
    kernel, _, filters = table.shape
    positions = (rows.shape[1] - kernel) // stride + 1
    z = np.broadcast_to(bias, (len(rows), positions, filters)).astype(np.float32)
    for k in range(kernel):
        z += table[k][rows[:, k:k + (positions - 1) * stride + 1:stride]]
    np.maximum(z, 0, out=z)
    z[np.arange(positions)[None, :] >= real[:, None]] = 0
    where = z.argmax(axis=1)
    return np.take_along_axis(z, where[:, None, :], axis=1)[:, 0], where


def table_gradient(table: np.ndarray, rows: np.ndarray, where: np.ndarray, dtop: np.ndarray, stride: int) -> np.ndarray:
    """The gradient of ``table``: each maximum's gradient goes to the bytes under its position."""
    g = np.zeros_like(table)
    c, f = np.nonzero(dtop)
    for k in range(len(table)):
        np.add.at(g[k], (rows[c, where[c, f] * stride + k], f), dtop[c, f])
    return g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Parameters by name, updated in place by their gradients."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p, self.step = params, 0
        self.m = {k: np.zeros_like(x) for k, x in params.items()}
        self.v = {k: np.zeros_like(x) for k, x in params.items()}

    def update(self, grads: dict, rate: float) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * np.square(g)
            d = (self.m[k] / (1 - 0.9 ** self.step)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.step)) + 1e-8)
            self.p[k] = (self.p[k] - rate * d).astype(self.p[k].dtype)
