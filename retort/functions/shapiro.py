"""Shapiro-Wilk test of normality by Royston's approximation (algorithm AS R94)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# Fixed values of the published algorithm: polynomial coefficients, lowest power first.
C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
C6 = (-0.4803, -0.082676, 0.0030302)
G = (-2.273, 0.459)

_NORMAL = NormalDist()


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def _weights(n: int) -> np.ndarray:
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, root = float(m @ m), 1 / math.sqrt(n)
    a = m.copy()
    last = _poly(C1, root) + m[-1] / math.sqrt(square)
    if n > 5:
        second = _poly(C2, root) + m[-2] / math.sqrt(square)
        scale = math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a /= scale
        a[-2], a[1] = second, -second
    else:
        a /= math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    return a


def shapiro_p(values) -> float:
    """p-value; 1 if all values are equal or there are fewer than three."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0
    x = x - np.median(x)
    d = x - x.mean()
    w = min(1.0, float(_weights(n) @ x) ** 2 / float(d @ d))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return 1.0
    y, log_n = math.log(1 - w), math.log(n)
    if n <= 11:
        gamma = _poly(G, n)
        if y >= gamma:
            return 1e-99
        y, mean, spread = -math.log(gamma - y), _poly(C3, n), math.exp(_poly(C4, n))
    else:
        mean, spread = _poly(C5, log_n), math.exp(_poly(C6, log_n))
    return 0.5 * math.erfc((y - mean) / spread / math.sqrt(2))
