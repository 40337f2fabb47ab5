"""Local temperature of a furnace: cubic splines along its length, linear between set temperatures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Measured profiles, position in cm and temperature, by set temperature.
PROFILES = {
    750: ([0, 7, 14, 20, 28, 35, 42], [665, 715, 758, 775, 789, 775, 734]),
    800: ([0, 5.886, 11.771, 17.657, 23.543, 29.429, 35.314, 41.2], [674, 746, 790, 822, 842, 845, 831, 786]),
    850: ([7, 14, 21, 28, 35, 42], [795, 851, 878, 880, 880, 855]),
}
LENGTH, MEMBRANES = 41.2, 10
LABEL_CM = {"mid": 29.4, "middle": 29.4, "top": 11.7, "bottom": 41.2}


def spline(x: list[float], y: list[float]) -> list[tuple[float, float, float, float, float]]:
    """Not-a-knot cubic: for each interval its start and four coefficients."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, h = len(x), np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    return [(float(x[i]), float(y[i]), float((y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6), float(m[i] / 2), float((m[i + 1] - m[i]) / (6 * h[i]))) for i in range(n - 1)]


def _along(position: Column, set_temp: int) -> Column:
    out = None
    for x0, c0, c1, c2, c3 in reversed(spline(*PROFILES[set_temp])):
        d = position - x0
        value = c0 + d * (c1 + d * (c2 + d * c3))
        out = value if out is None else F.when(position >= after, out).otherwise(value)
        after = x0
    return out


def actual_temp(set_temp: Column, position: Column) -> Column:
    """profiles extrapolate along the furnace; outside their range the nearest one holds."""
    temps = sorted(PROFILES)
    curve = {t: _along(position, t) for t in temps}
    out = F.when(set_temp <= temps[0], curve[temps[0]])
    for lo, hi in zip(temps[:-1], temps[1:], strict=True):
        out = out.when(set_temp <= hi, curve[lo] + (curve[hi] - curve[lo]) * (set_temp - lo) / (hi - lo))
    return out.when(set_temp > temps[-1], curve[temps[-1]])


def membrane_cm(membrane: Column) -> Column:
    """ten membranes spread evenly."""
    return F.when(membrane.between(1, MEMBRANES), (membrane - 1) * (LENGTH / (MEMBRANES - 1)))


def label_cm(label: Column) -> Column:
    out = None
    for key, cm in LABEL_CM.items():
        hit = F.lower(label).contains(key)
        out = F.when(hit, cm) if out is None else out.when(hit, cm)
    return out
