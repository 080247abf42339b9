"""Scalar column expressions on measurements, residuals and axes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Deviation targets of the calibration metrics; None means lower is better. Fixed values.
METRIC_TARGETS = {"std_z": 1.0, "chi2_red": 1.0, "rmse": None, "mad_z": 0.6745}

# Dispersion of air, (n - 1) * 1e8 = C0 + C1 / (130 - s2) + C2 / (38.9 - s2) with s in 1/um. Fixed values.
AIR_C0, AIR_C1, AIR_P1, AIR_C2, AIR_P2 = 8342.54, 2406147.0, 130.0, 15998.0, 38.9
AIR_STEPS = 10


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def inverse_variance(sigma: Column) -> Column:
    """``1 / sigma**2``; null where sigma is zero, so that the cell counts as missing."""
    return F.try_divide(F.lit(1.0), sigma * sigma)


def present(y: Column, w: Column) -> Column:
    """A cell is present when both its value and its weight are finite numbers."""
    return is_finite(y) & is_finite(w)


def zero_if_missing(x: Column, y: Column, w: Column) -> Column:
    return F.when(present(y, w), x).otherwise(F.lit(0.0))


def absolute_magnitude(apparent: Column, parallax_mas: Column) -> Column:
    return apparent + F.lit(5.0) * F.log10(parallax_mas / F.lit(1000.0)) + F.lit(5.0)


def z_score(r: Column, w: Column, robust: Column) -> Column:
    return r * F.sqrt(w) * F.sqrt(robust)


def display_residual(r: Column, robust: Column) -> Column:
    """Residual magnified where the model distrusts the cell."""
    return F.try_divide(r, robust * robust)


def log_deviation(value: Column, target: float | None) -> Column:
    """Distance of a calibration metric from its target on a log scale; the value itself without one."""
    if target is None:
        return value
    return F.log(F.abs(value - F.lit(target)) + F.lit(1e-10))


def metric_deviation(metric: Column, value: Column, log: bool = False) -> Column:
    """Distance of a metric from its target, picked by the metric's name."""
    out = F.lit(None).cast("double")
    for name, target in METRIC_TARGETS.items():
        if log:
            dev = log_deviation(value, target)
        else:
            dev = value if target is None else F.abs(value - F.lit(target))
        out = F.when(metric == name, dev).otherwise(out)
    return out


def air_to_vacuum(x_nm: Column, decimals: int | None = None) -> Column:
    """Vacuum wavelength by a fixed number of fixed-point steps, optionally rounded."""

    def refine(vac: Column, _: Column) -> Column:
        s2 = F.pow(F.lit(1000.0) / vac, F.lit(2.0))
        n1 = F.lit(AIR_C0) + F.lit(AIR_C1) / (F.lit(AIR_P1) - s2) + F.lit(AIR_C2) / (F.lit(AIR_P2) - s2)
        return x_nm * (F.lit(1.0) + n1 * F.lit(1e-8))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(AIR_STEPS)), x_nm.cast("double"), refine)
    return out if decimals is None else F.round(out, decimals)


def air_to_vacuum_text(written: Column) -> Column:
    """The same for numbers as they are written: each answer has as many decimals as its own text. Null for what is no number."""
    decimals = F.length(F.coalesce(F.get(F.split(F.trim(written), "[.]"), F.lit(1)), F.lit("")))
    vacuum = air_to_vacuum(written.try_cast("double"))
    return F.when(vacuum.isNotNull(), F.printf(F.concat(F.lit("%."), decimals.cast("string"), F.lit("f")), vacuum))
