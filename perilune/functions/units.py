"""Units, clamps, truncations, bit masks and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds between the Unix epoch and J2000 (2000-01-01 12:00) without leap seconds.
J2000_UNIX = 946728000.0
#: The constant that one of the mission's two implementations subtracts.
J2000_CONSTANT = 946727936.0
# Unix times at which a leap second had just been added, and TAI - UTC from then on.
LEAP_SECONDS = ((915148800, 32), (1136073600, 33), (1230768000, 34), (1341100800, 35), (1435708800, 36), (1483228800, 37))
TT_TAI = 32.184


def tai_minus_utc(unix: Column) -> Column:
    out = F.lit(32)
    for since, offset in LEAP_SECONDS[1:]:
        out = F.when(unix >= since, offset).otherwise(out)
    return out


def unix_to_j2000(unix: Column, model: str = "et") -> Column:
    """Ephemeris seconds past J2000. et: with leap seconds (within 2 ms); constant: a fixed offset."""
    if model == "constant":
        return unix.cast("double") - J2000_CONSTANT
    return unix.cast("double") - J2000_UNIX + tai_minus_utc(unix) + TT_TAI


def dps_to_rad(x: Column) -> Column:
    return x * (3.141592653589793 / 180)


def raw_gyro_dps(raw: Column, lsb_per_dps: float = 262.4) -> Column:
    return raw / F.lit(lsb_per_dps)


def raw_mag_ut(raw: Column) -> Column:
    return raw * F.lit(0.3)


def raw_temperature_c(raw: Column) -> Column:
    return raw / F.lit(512.0) + 23


def percent(used: Column, total: Column) -> Column:
    """Truncated, never rounded, and held to 0..100; null if total isn't positive."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(used * 100 / total)))).cast("int")


def set_bits(mask: Column, width: int) -> Column:
    """The numbers of the bits that are set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(mask.cast("long"), i) != 0)


def downscaled(size: Column, factor: Column) -> Column:
    """max(1, round half to even(size / factor)); a factor that isn't positive counts as 10."""
    return F.greatest(F.lit(1), F.bround(size / F.when(factor > 0, factor).otherwise(10), 0)).cast("int")


def low_high(low: Column, high: Column) -> Column:
    """A range, or null where both ends are 0."""
    return F.when((low != 0) | (high != 0), F.struct(low.alias("low"), high.alias("high")))


def processing_flags(flags: Column) -> dict[str, Column]:
    """What a level-of-processing byte asks for."""
    bit = lambda k: F.getbit(flags.cast("long"), F.lit(k)) != 0
    return {"downscale": bit(0), "prefilter": bit(1), "inference": bit(2), "prefilter_only": bit(1) & ~bit(2)}


def register_bits(value: Column, low: int, width: int) -> Column:
    return F.shiftright(value.cast("int"), low).bitwiseAND((1 << width) - 1)
