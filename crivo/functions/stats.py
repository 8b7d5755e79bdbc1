"""Statistical column functions, written with built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guards and tolerances of the reference.
EPSILON = 1e-12
SIGNIFICANT_Z = 1.96
ABS_TOLERANCE = 1e-5
REL_TOLERANCE = 1e-5


def log_gamma_sql(a: str) -> str:
    """Log of the gamma function for a > 0: Stirling's series, shifted up by ten below ten."""
    def stirling(z: str) -> str:
        return (
            f"(({z}) - 0.5D) * ln({z}) - ({z}) + {0.5 * math.log(2 * math.pi)!r}D"
            f" + 1.0D / (12.0D * ({z})) - 1.0D / (360.0D * pow({z}, 3))"
            f" + 1.0D / (1260.0D * pow({z}, 5)) - 1.0D / (1680.0D * pow({z}, 7))"
        )
    product = " * ".join(f"({a} + {step}.0D)" for step in range(10))
    return f"if({a} < 10, {stirling(a + ' + 10.0D')} - ln({product}), {stirling(a)})"


def upper_gamma_sql(a: str, x: str) -> str:
    """Regularised upper incomplete gamma function for positive ``a`` and ``x``.

    A power series below ``a + 1`` and a backward continued fraction above it, each
    folded over ``300 + 20 sqrt(a)`` terms. ``a`` and ``x`` should be plain names.
    """
    terms = f"cast(300 + 20 * sqrt({a}) as int)"
    steps = f"transform(sequence({terms}, 1, -1), n -> cast(n as double))"
    scale = f"exp(-{x} + {a} * ln({x}) - ({log_gamma_sql(a)}))"
    series = f"aggregate({steps}, 0.0D, (acc, n) -> (1.0D + acc) * {x} / ({a} + n))"
    fraction = (
        f"aggregate({steps}, {x} + 1.0D - {a} + 2.0D * {terms},"
        f" (acc, n) -> {x} + 2.0D * n - 1.0D - {a} - n * (n - {a}) / acc)"
    )
    return f"if({x} < {a} + 1.0D, 1.0D - {scale} * ({series} + 1.0D) / {a}, {scale} / {fraction})"


def chi2_sf(score: str, dof: str) -> Column:
    """Upper tail of the chi-square distribution for two columns given by name.

    A score of zero or less, or no degree of freedom, gives 1; a missing score gives
    null. The one-element transform names both halves once for all steps, and degenerate
    inputs get harmless stand-ins so that no branch divides by zero.
    """
    usable = f"{score} > 0 and {dof} > 0 and not isnan({score})"
    half = (
        f"struct(if({usable}, cast({score} as double) / 2, 1.0D) as x,"
        f" if({usable}, cast({dof} as double) / 2, 1.0D) as a)"
    )
    tail = f"get(transform(array({half}), h -> {upper_gamma_sql('h.a', 'h.x')}), 0)"
    return F.expr(
        f"case when {score} is null or isnan({score}) then cast(null as double)"
        f" when {dof} <= 0 or {score} <= 0 then 1.0D else {tail} end"
    )


def sigmoid(z: Column) -> Column:
    """Logistic function, in the form that cannot overflow."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def log_loss(z: Column, y: Column) -> Column:
    """Log loss of a 0/1 label ``y`` at score ``z``."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def is_close(a: Column, b: Column, atol: float = ABS_TOLERANCE, rtol: float = REL_TOLERANCE) -> Column:
    """Equal within ``atol + rtol * |b|``; a missing value is close to nothing."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def simple_v(score: Column, n: Column) -> Column:
    """``sqrt(score / n)``, null where the score is negative."""
    return F.when(score >= 0, F.sqrt(score / n))


def corrected_v(chi2: Column, n: Column, rows: Column, cols: Column) -> Column:
    """Bias-corrected Cramer's V; null when a side has a single category."""
    phi2 = F.greatest(F.lit(0.0), F.try_divide(chi2, n) - F.try_divide((cols - 1.0) * (rows - 1.0), n - 1))
    r = rows - F.try_divide((rows - 1.0) * (rows - 1.0), n - 1)
    k = cols - F.try_divide((cols - 1.0) * (cols - 1.0), n - 1)
    smaller = F.least(k - 1.0, r - 1.0)
    return F.when(smaller > 0, F.sqrt(F.try_divide(phi2, smaller)))


def adjusted_residual(observed: Column, expected: Column, row: Column, col: Column, n: Column) -> Column:
    """``(O - E) / sqrt(E (1 - row/n) (1 - col/n))``; null where the spread is zero."""
    spread = F.sqrt(expected * (1.0 - row / n) * (1.0 - col / n))
    return F.try_divide(observed - expected, spread)


def direction(z: Column) -> Column:
    """Whether a residual shows attraction or repulsion."""
    return F.when(z > 0, F.lit("attraction")).otherwise(F.lit("repulsion"))


def number_text(c: Column, decimals: int = 4) -> Column:
    """A fixed-point number for a report."""
    return F.format_string(f"%.{decimals}f", c)


def scientific_text(c: Column, decimals: int = 2) -> Column:
    """A number in scientific notation for a report."""
    return F.format_string(f"%.{decimals}e", c)


def time_text(c: Column) -> Column:
    """A day-first date and time for a report."""
    return F.date_format(c, "dd/MM/yyyy HH:mm:ss")
