"""Numeric expressions, including the three binning rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_CLIP = 50.0
RATE_CAP = 1e8
EPS = 2.0**-52


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def clip_eta(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(RATE_CLIP)), F.lit(-RATE_CLIP))


def spacing(x: Column) -> Column:
    """Gap from abs(x) to the next larger double (the floating-point ulp)."""
    a = F.abs(x)
    exponent = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1e-300))))
    return F.pow(F.lit(2.0), exponent - 52)


def edge_bin(t: Column, dt: float, n_bins: Column) -> Column:
    """Bin by comparing with the edges b*dt; null outside the grid.

    floor(t/dt) can land one bin off the edge product, so it is corrected
    against the actual edges. The last bin is closed at its right edge.
    """
    d = F.lit(float(dt))
    guess = F.floor(t / d)
    b = (
        F.when(t < guess * d, guess - 1)
        .when(t >= (guess + 1) * d, guess + 1)
        .otherwise(guess)
    )
    last_edge = (n_bins - 1) * d + d
    b = F.when(t == last_edge, n_bins - 1).otherwise(b)
    return F.when((b >= 0) & (b < n_bins), b).cast("long")


def onset_bin(t_on: Column, dt: float) -> Column:
    """Bin of an onset: floor with a small forward tolerance."""
    offset = t_on / F.lit(float(dt))
    tol = F.greatest(F.lit(1e-9), spacing(offset))
    return F.floor(offset + tol).cast("long")


def cover_bins(t_on: Column, t_off: Column, dt: float) -> tuple[Column, Column]:
    """First and last bin covered by [t_on, t_off); empty when last < first."""
    d = F.lit(float(dt))
    tol = F.greatest(F.lit(math.ulp(float(dt))), spacing(t_off))
    first = F.floor(t_on / d).cast("long")
    last = (F.ceil((t_off - tol) / d) - 1).cast("long")
    return first, last


def n_grid_bins(extent: Column, dt: float) -> Column:
    return (F.floor(extent / F.lit(float(dt)) + F.lit(0.5)) + 1).cast("long")


def log_factorial(y: Column) -> Column:
    """ln(y!) of a count."""
    small = F.log(F.factorial(F.least(y, F.lit(20)).cast("int")).cast("double"))
    # Stirling's series; from 21 on its first left-out term is below 1e-12.
    x = F.greatest(y.cast("double"), F.lit(1.0))
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    large = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(y <= 20, small).otherwise(large)


def raised_cosine(lag_s: Column, center: Column, half_width: Column) -> Column:
    phi = (lag_s - center) / half_width
    return F.when(F.abs(phi) <= 1, 0.5 * (F.cos(F.lit(math.pi) * phi) + 1)).otherwise(F.lit(0.0))
