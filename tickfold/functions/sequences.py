"""Small numeric helpers on one sequence, for the kernels that Spark calls on a group or a row."""

from __future__ import annotations

import math

import numpy as np


def lempel_ziv(word: str) -> float:
    """Phrases of the 1976 parsing, over n / log2 n."""
    n = len(word)
    if n < 2:
        return 0.0
    start = phrases = 0
    while start < n:
        size = 1
        while start + size <= n and word[start : start + size] in word[: start + size - 1]:
            size += 1
        phrases += 1
        start += size
    return phrases / (n / math.log2(n))


def kontoyiannis(word: str) -> float:
    """Mean over i = 1 .. n - 1 of log2(i + 1) / (1 + longest match of what follows i within the i symbols before it)."""
    n = len(word)
    terms = []
    for i in range(1, n):
        size = 0
        while size < i and i + size < n and word[i : i + size + 1] in word[:i]:
            size += 1
        terms.append(math.log2(i + 1) / (1 + size))
    return sum(terms) / len(terms) if terms else 0.0


def fractional_weights(d: float, tau: float, most: int = 100_000) -> np.ndarray:
    """Weights of (1 - lag)^d from lag 0, up to the first of size below ``tau``."""
    w = [1.0]
    for k in range(1, most):
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < tau:
            break
        w.append(nxt)
    return np.array(w)


def adf(y: np.ndarray, lags: int = 1) -> tuple[float, int]:
    """t statistic of the level in a Dickey-Fuller regression with a constant, and its rows."""
    dy = np.diff(y)
    n = len(dy) - lags
    if n < 4 + lags:
        return math.nan, max(n, 0)
    x = np.column_stack([y[lags:-1], np.ones(n), *(dy[lags - j : len(dy) - j] for j in range(1, lags + 1))])
    target = dy[lags:]
    xtx = x.T @ x
    try:
        inv = np.linalg.inv(xtx)
    except np.linalg.LinAlgError:
        return math.nan, n
    b = inv @ (x.T @ target)
    e = target - x @ b
    s2 = e @ e / (n - x.shape[1])
    v = s2 * inv[0, 0]
    return (float(b[0] / math.sqrt(v)) if v > 0 else math.nan), n


def inverses(a: np.ndarray) -> np.ndarray:
    """The inverse of every matrix of a stack, NaN where there is none."""
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        half = len(a) // 2
        return np.concatenate([inverses(a[:half]), inverses(a[half:])]) if half else np.full(a.shape, math.nan)


def adfs(y: np.ndarray, lags: int = 1) -> np.ndarray:
    """``adf``'s t statistic of every row of ``y``."""
    dy = np.diff(y, axis=1)
    n = dy.shape[1] - lags
    if n < 4 + lags or not len(y):
        return np.full(len(y), math.nan)
    x = np.stack([y[:, lags:-1], np.ones((len(y), n)), *(dy[:, lags - j : dy.shape[1] - j] for j in range(1, lags + 1))], 1)
    target = dy[:, lags:, None]
    inv = inverses(x @ x.transpose(0, 2, 1))
    b = inv @ (x @ target)
    e = target - x.transpose(0, 2, 1) @ b
    v = (e * e).sum((1, 2)) / (n - x.shape[1]) * inv[:, 0, 0]  # NaN where a row has no inverse
    return np.divide(b[:, 0, 0], np.sqrt(np.where(v > 0, v, 1.0)), out=np.full(len(y), math.nan), where=v > 0)


def adf_critical(n: int) -> float:
    """5 % critical value with a constant, for one variable (MacKinnon 2010)."""
    return -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3
