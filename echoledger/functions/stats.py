"""Rounding and interval arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Half-up percentage kept in decimal until rounded; NULL where whole is zero."""
    ratio = (F.lit(100) * part).cast("decimal(24,6)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(ratio, digits).cast("double")


def money(amount: Column, digits: int) -> Column:
    """Half-up rounding of a summed amount, settled at nine decimals first: double sums
    vary in their last bits with the order of summation, and a report must not."""
    return F.round(amount.cast("decimal(28,9)"), digits).cast("double")


def percent_half_even(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded by the double's exact binary value, half to even; 0.0 where whole is zero."""
    x = part / whole * 100
    low = F.floor(x)
    # x minus its floor is exact and so are its tenths in units of 2^-59; what lies below them is under any half.
    unit, ten = 1 << 59, 10**digits
    tenths = ((x - low) * F.lit(float(unit))).cast("bigint")
    whole_units = low * ten
    for _ in range(digits):
        step = tenths * 10
        digit = ((step - F.pmod(step, F.lit(unit))) / unit).cast("bigint")
        whole_units = whole_units + digit * (ten // 10)
        ten //= 10
        tenths = F.pmod(step, F.lit(unit))
    up = (tenths > unit // 2) | ((tenths == unit // 2) & (F.pmod(whole_units, F.lit(2)) == 1))
    return F.when(whole > 0, (whole_units + up.cast("bigint")) / 10**digits).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): score interval of k out of n, clipped to [0, 1]; (0, 0) when n is 0."""
    kd, nd = k.cast("double"), n.cast("double")
    z2 = F.lit(z * z)
    p = kd / nd
    denom = 1.0 + z2 / nd
    centre = (p + z2 / (2.0 * nd)) / denom
    half = (F.lit(z) * F.sqrt(p * (1.0 - p) / nd + z2 / (4.0 * nd * nd))) / denom
    zero = F.lit(0.0)
    return F.struct(
        F.when(nd == 0, zero).otherwise(F.greatest(zero, centre - half)).alias("low"),
        F.when(nd == 0, zero).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"),
    )
