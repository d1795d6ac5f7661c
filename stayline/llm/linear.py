"""A small logistic regression over sparse binary rows, for bounded training samples."""

from __future__ import annotations


def fit_logistic(rows, targets, weights, width: int, l2: float = 1e-3, steps: int = 300, rate: float = 0.1, scale=None):
    """Coefficients and intercept.

    ``rows``: a list of arrays of column numbers; ``targets`` in 0..1; ``scale``: a value for each column that
    its entries have instead of 1. Full-batch Adam: deterministic, and no more than the sample in memory.
    """
    import numpy as np

    lengths = np.array([len(r) for r in rows], np.int64)
    cols = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    values = np.ones(len(cols)) if scale is None else np.asarray(scale, float)[cols]
    y, w = np.asarray(targets, float), np.asarray(weights, float)
    w = w / max(w.sum(), 1e-12)
    coef, bias = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, coef[cols] * values, minlength=len(rows)) + bias
        err = w * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g = np.bincount(cols, err[owner] * values, minlength=width) + l2 * coef
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        coef -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / ((vb / b) ** 0.5 + 1e-8)
    return coef, float(bias)
