"""Column functions: geometry, units, kernels, magnitudes and names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gravity constant in (km/s)^2 Mpc / 1e11 solar masses.
G = 430.1
#: Masses are kept in units of so many solar masses.
MASS_UNIT = 1e11

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


_PERIODIC: ContextVar[bool] = ContextVar("periodic", default=True)


@contextmanager
def boundary(periodic: bool) -> Iterator[None]:
    """Plans that are built inside take the box as periodic, or as open: then differences are taken as they are."""
    token = _PERIODIC.set(periodic)
    try:
        yield
    finally:
        _PERIODIC.reset(token)


def is_periodic() -> bool:
    """Whether plans that are built here take the box as periodic (they do unless ``boundary`` says otherwise)."""
    return _PERIODIC.get()


def min_image(d: Col, side: float = 1.0) -> Column:
    """The shortest periodic image of a difference, d - rint(d / side) * side; in an open box (``boundary``) the difference itself."""
    d = col(d)
    if not is_periodic():
        return d
    return d - F.rint(d / side) * side if side != 1.0 else d - F.rint(d)


def norm2(x: Col, y: Col, z: Col) -> Column:
    return col(x) * col(x) + col(y) * col(y) + col(z) * col(z)


def wrap(x: Col) -> Column:
    """A coordinate in box units folded into [0, 1)."""
    return col(x) - F.floor(col(x))


def cell_side(level: Col) -> Column:
    return F.pow(F.lit(2.0), -col(level).cast("double"))


def cell_mass(rho: Col, level: Col, unit: float = 1.0) -> Column:
    """Mass of a mesh cell, rho * 2^(-3 level) / unit."""
    return col(rho) * F.pow(F.lit(2.0), -3.0 * col(level)) / unit


def temperature(p: Col, rho: Col, unit: float = 1.0) -> Column:
    return F.try_divide(col(p), col(rho)) / unit


def is_cold(p: Col, rho: Col, unit: float = 1.0) -> Column:
    return temperature(p, rho, unit) < 1e4


def is_dense(p: Col, rho: Col, unit: float = 1.0, per_cc: float = 1.0, least: float = 5.0) -> Column:
    return is_cold(p, rho, unit) & (col(rho) / per_cc > least)


def octant(x: Col, y: Col, z: Col) -> Column:
    """0 to 7: bit 0 for x >= 0, bit 1 for y, bit 2 for z."""
    bit = lambda c: (col(c) >= 0).cast("int")
    return bit(x) + 2 * bit(y) + 4 * bit(z)


def spline_kernel(x: Col) -> Column:
    """Cubic spline of a scaled distance, without its 1/(pi h^3)."""
    x = col(x)
    return F.when(x <= 1, 1 - 1.5 * x * x + 0.75 * x * x * x).when(x <= 2, 0.25 * (2 - x) * (2 - x) * (2 - x)).otherwise(0.0)


def luminosity(mag: Col) -> Column:
    return F.pow(F.lit(10.0), -0.4 * col(mag))


def magnitude(lum: Col) -> Column:
    """-2.5 log10 of a positive luminosity, else null."""
    return F.when(col(lum) > 0, -2.5 * F.log10(col(lum)))


def contaminated(mass: Col, least: Col) -> Column:
    return col(mass) > col(least) * 1.00001


def valid_star(age: Col, metal: Col, mass: Col) -> Column:
    """All finite and positive."""
    ok = F.lit(True)
    for c in (age, metal, mass):
        ok = ok & F.coalesce((col(c) > 0) & ~F.isnan(col(c)) & (col(c) < math.inf), F.lit(False))
    return ok


def fortran_bool(text: Col) -> Column:
    """True for .true., true, t, yes, y, 1 in any case; false for their opposites; else null."""
    t = F.lower(F.trim(col(text)))
    return F.when(t.isin(".true.", "true", "t", "yes", "y", "1"), True).when(t.isin(".false.", "false", "f", "no", "n", "0"), False)


def fortran_double(text: Col) -> Column:
    """A number whose exponent may be written with D."""
    return F.regexp_replace(F.trim(col(text)), "[dD]", "e").try_cast("double")


def octal(text: Col) -> Column:
    """A number written in octal digits, with or without 0o or 0 before them; null where another character stands."""
    digits = F.regexp_replace(F.lower(F.trim(col(text))), "^0o", "")
    return F.when(digits.rlike("^[0-7]{1,20}$"), F.conv(digits, 8, 10).cast("long"))


def unquoted(text: Col) -> Column:
    return F.regexp_replace(F.trim(col(text)), "^(['\"])(.*)\\1$", "$2")


def path_tag(path: Col) -> Column:
    """The last part of a path, with all but letters, digits, dot, dash and underscore made underscores."""
    last = F.element_at(F.split(F.regexp_replace(col(path), "/+$", ""), "/"), -1)
    return F.regexp_replace(last, "[^A-Za-z0-9._-]", "_")


def root_ellipsoid(a: Col, b: Col, c: Col) -> Column:
    """Geometric mean of three axes."""
    return F.cbrt(col(a) * col(b) * col(c))
