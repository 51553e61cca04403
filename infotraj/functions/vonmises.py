"""Modified Bessel functions and the von Mises kernel, in numpy."""

from __future__ import annotations

import math

import numpy as np

#: Places at which a circle's density is looked at: each degree from 0 to 360.
GRID = np.deg2rad(np.arange(361.0))


def scaled_bessel(n: int, x: float) -> float:
    """I_n(x) e^-x for x >= 0: the mean of e^(x (cos t - 1)) cos nt over the circle, exact to rounding by equal steps."""
    points = 64 + 8 * math.ceil(math.sqrt(abs(x)) * 4 + n)
    t = np.arange(points) * (2 * math.pi / points)
    return float(np.mean(np.exp(x * (np.cos(t) - 1)) * np.cos(n * t)))


def smoothing(n: int, kappa: float) -> float:
    """[3 N k^2 I2(2k) / (4 sqrt(pi) I0(k)^2)]^(2/5); the exponential scales cancel."""
    return (3 * n * kappa**2 * scaled_bessel(2, 2 * kappa) / (4 * math.sqrt(math.pi) * scaled_bessel(0, kappa) ** 2)) ** 0.4


def weights(nu: float, least: float = 1e-16) -> np.ndarray:
    """I_k(nu) / I_0(nu) for k = 0, 1, 2, ... while above `least`: how much of a circle's k-th moment the kernel lets through.

    They fall off like exp(-k^2 / 2 nu), so their number grows with the root of nu.
    """
    most = 8 + math.ceil(math.sqrt(80 * max(nu, 1.0)))
    points = 64 + 8 * math.ceil(math.sqrt(abs(nu)) * 4 + most)
    t = np.arange(points) * (2 * math.pi / points)
    kernel = np.exp(nu * (np.cos(t) - 1))
    w = np.fft.rfft(kernel).real[: most + 1]
    w = w / w[0]
    low = np.flatnonzero(w <= least)
    return w[: low[0]] if low.size else w


def density_of_moments(cosines: np.ndarray, sines: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """(3, circles, places): density, gradient and second derivative on GRID from sums of cos kx and sin kx (circles, k), k from 0 on, over n angles."""
    k = np.arange(len(w))
    w = np.where(k == 0, 0.5, w)
    c, s = np.cos(np.outer(k, GRID)), np.sin(np.outer(k, GRID))
    a, b = cosines * (w / (math.pi * n)), sines * (w / (math.pi * n))
    return np.stack([a @ c + b @ s, (b * k) @ c - (a * k) @ s, -(a * k * k) @ c - (b * k * k) @ s])


def minima(gradient: np.ndarray, second: np.ndarray, most: int, step: float, rounds: int, tolerance: float) -> list[float]:
    """The angles (radians, ascending) that part the `most` sharpest maxima of a density on GRID; none where it has none.

    A maximum lies between two degrees where the gradient changes sign and the second derivative is below -1e-4; the
    first nine count. Minima start midway between neighbours and go downhill on the gradient between degrees, five
    degrees at a time at most. One maximum alone is parted from itself at the opposite side.
    """
    at = np.flatnonzero((gradient[:-1] * gradient[1:] <= 0) & (second[1:] < -1e-4))[:9]
    if not at.size:
        return []
    sharp = (second[at] + second[at + 1]) / 2
    tops = np.sort(at[np.argsort(sharp, kind="stable")[:most]] + 0.5)
    if len(tops) == 1:
        return [math.radians((tops[0] - 180) % 360)]
    found = []
    for before, top in zip(np.append(tops[-1] - 360, tops[:-1]), tops, strict=True):
        x = ((before + top) / 2) % 360
        for _ in range(rounds):
            whole = int(x)
            slope = (whole + 1 - x) * gradient[whole] + (x - whole) * gradient[whole + 1]
            if abs(slope) < tolerance:
                break
            x = (x - max(-5.0, min(5.0, step * slope))) % 360
        found.append(math.radians(x))
    return sorted(found)
