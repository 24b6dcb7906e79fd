"""Gamma function's logarithm and its first two derivatives, vectorised in numpy.

Arguments are positive; each is raised by ten with the recurrence, where the
asymptotic series is exact to rounding.
"""

from __future__ import annotations

import numpy as np

UP = 10


def lgamma(x):
    x = np.asarray(x, float)
    z = x + UP
    below = sum(np.log(x + i) for i in range(UP))
    s = 1 / z**2
    tail = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - below


def digamma(x):
    x = np.asarray(x, float)
    z = x + UP
    below = sum(1 / (x + i) for i in range(UP))
    s = 1 / z**2
    return np.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132)))) - below


def trigamma(x):
    x = np.asarray(x, float)
    z = x + UP
    below = sum(1 / (x + i) ** 2 for i in range(UP))
    s = 1 / z**2
    return 1 / z + 0.5 * s + s / z * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66)))) + below
