"""Background cosmology and elliptic integrals: scalars and small tables on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Centimetres in a megaparsec, seconds in a gigayear, centimetres in a kilometre,
# gigayears of 1 / (km/s/Mpc), and the mean density of matter in 1e11 solar masses at H = 100.
MPC, GYR, KM = 3.08e24, 3.154e16, 1e5
HUBBLE_GYR = 977.78
MATTER = 2.78782

_X, _W = np.polynomial.legendre.leggauss(200)


def integral(f, a: float, b: float) -> float:
    """Gauss-Legendre in log x, for positive a and b."""
    la, lb = math.log(a), math.log(b)
    x = np.exp(0.5 * (lb - la) * _X + 0.5 * (la + lb))
    return float(0.5 * (lb - la) * (_W * f(x) * x).sum())


@dataclass(frozen=True)
class Background:
    """Matter and vacuum densities and the Hubble constant (km/s/Mpc) today."""

    omega_m: float = 0.3333
    omega_l: float = 0.6667
    h0: float = 66.667

    @property
    def omega_k(self) -> float:
        return 1 - self.omega_m - self.omega_l

    def rate(self, a: float) -> float:
        """H(a) in km/s/Mpc."""
        return self.h0 * math.sqrt(self.omega_m / a**3 + self.omega_k / a**2 + self.omega_l)

    def age(self, a: float = 1.0) -> float:
        """Gigayears since the beginning at expansion a."""
        def f(x: np.ndarray) -> np.ndarray:
            return 1 / np.sqrt(self.omega_m * x**5 + self.omega_k * x**4 + self.omega_l * x**2)

        return HUBBLE_GYR / self.h0 * integral(f, 1 / a, 10001.0)

    def table(self, n: int = 5000) -> np.ndarray:
        """Columns a, t (Gyr) and conformal u (negative before a = 1), on a grid that is even in sqrt a."""
        a = np.linspace(0, 1, n)[1:] ** 2
        mid = (a[1:] + a[:-1]) / 2
        e = np.sqrt(self.omega_m / mid**3 + self.omega_l)
        step_u, step_t = 1 / (mid**3 * e), MPC / (self.h0 * KM * GYR) / (mid * e)
        a = a[1:]
        area = lambda y: 0.5 * (y[1:] + y[:-1]) * np.diff(a)
        t = np.concatenate([[0], np.cumsum(area(step_t))])
        u = -np.concatenate([np.cumsum(area(step_u)[::-1])[::-1], [0]])
        return np.stack([a, t, u], 1)

    def box_mass(self, side: float) -> float:
        """Matter in a box of ``side`` comoving Mpc, in 1e11 solar masses."""
        return MATTER * side**3 * (self.h0 / 100) ** 2 * self.omega_m

    def virial_overdensity(self, a: float = 1.0, accuracy: float = 1e-6) -> float:
        """Density over the mean of a top hat that collapses at expansion a."""
        half = self.age(a) / HUBBLE_GYR * self.h0 / 2
        low, high = 1.0, 1e7

        def time(om: float) -> float:
            def f(x: np.ndarray) -> np.ndarray:
                v = om * x**5 - (om + self.omega_l) * x**4 + self.omega_l * x**2
                return np.where(v > 0, 1 / np.sqrt(np.maximum(v, 1e-300)), 0.0)

            # x = 1 + y^2 takes the root at turnaround out
            y = np.sqrt(100.0) * (_X + 1) / 2
            x = 1 + y * y
            near = float((np.sqrt(100.0) / 2 * _W * f(x) * 2 * y).sum())
            return near + integral(f, 101.0, 10001.0)

        om = 0.5 * (low + high)
        while high - low > accuracy * om:
            om = 0.5 * (low + high)
            if time(om) > half:
                low = om
            else:
                high = om
        eta = 2 * self.omega_l / om / a**3
        collapse = 0.5 if eta == 0 else cubic_root(2 * eta, 0.0, -(2 + eta), 1.0)
        return om / self.omega_m / collapse**3 * a**3


def cubic_root(a: float, b: float, c: float, d: float) -> float:
    """The only real root of a x^3 + b x^2 + c x + d, or the smallest positive of three (else the largest)."""
    if a == 0:
        raise ValueError("not a cubic")
    roots = np.roots([a, b, c, d])
    real = sorted(float(r.real) for r in roots if abs(r.imag) < 1e-9 * max(1.0, abs(r)))
    if len(real) < 3:
        return real[0]
    positive = [r for r in real if r > 0]
    return positive[0] if positive else real[-1]


def carlson_rf(x: float, y: float, z: float) -> float:
    """The symmetric elliptic integral of the first kind, by duplication."""
    x, y, z = float(x), float(y), float(z)
    while True:
        m = (x + y + z) / 3
        dx, dy, dz = 1 - x / m, 1 - y / m, 1 - z / m
        if max(abs(dx), abs(dy), abs(dz)) < 2e-3:
            e2, e3 = dx * dy + dy * dz + dz * dx, dx * dy * dz
            return (1 - e2 / 10 + e3 / 14 + e2 * e2 / 24 - 3 * e2 * e3 / 44) / math.sqrt(m)
        root = math.sqrt(x * y) + math.sqrt(y * z) + math.sqrt(z * x)
        x, y, z = (x + root) / 4, (y + root) / 4, (z + root) / 4


def ellipsoid_potential(m: float, a: float, b: float, c: float, gravity: float = 430.1) -> float:
    """-(3/5) G m^2 R_F(a^2, b^2, c^2) of a homogeneous ellipsoid."""
    return -0.6 * gravity * m * m * carlson_rf(a * a, b * b, c * c)


def critical_density(h0: float, a: float) -> float:
    """Solar masses per cubic kiloparsec at expansion a, as h0^2 a^-3."""
    return 3 * h0**2 / (8 * math.pi * 430.1) * 1e11 / 1e9 * a**-3
