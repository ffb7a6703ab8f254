"""Logistic regression on numpy arrays, for samples of bounded size."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(
    rows: np.ndarray,
    cols: np.ndarray,
    values: np.ndarray,
    y: np.ndarray,
    width: int,
    l2: float,
    steps: int = 300,
    weight: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """(weights, bias) by accelerated gradient steps on the mean log loss of a sparse matrix plus l2 / 2 |w|^2.

    weight: of each row, with mean 1.
    """
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    norms = np.bincount(rows, values**2, n) + 1
    step = 1 / (0.25 * float(np.mean(weight * norms)) + l2)
    w, b = np.zeros(width), 0.0
    v, c = w.copy(), b
    for k in range(steps):
        error = (sigmoid(np.bincount(rows, values * v[cols], n) + c) - y) * weight
        new_w = v - step * (np.bincount(cols, values * error[rows], width) / n + l2 * v)
        new_b = c - step * error.mean()
        pull = k / (k + 3)
        v, c = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The chance that a random positive scores above a random negative; ties count half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    rank = np.empty(len(s))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    last = np.append(first[1:], len(s))
    rank[order] = np.repeat((first + last + 1) / 2, last - first)
    pos = y == 1
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))
