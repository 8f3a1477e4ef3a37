"""Column expressions for levels, pitch and encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def midi_to_hz(note: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (note - 69) / 12.0)


def hz_to_midi(hz: Column) -> Column:
    return F.lit(69.0) + 12.0 * F.log2(hz / 440.0)


def fold_cents(cents: Column) -> Column:
    """The distance to the nearest octave, from -600 up to but not including 600."""
    return F.pmod(cents + 600.0, F.lit(1200.0)) - 600.0


def decibels(amplitude: Column) -> Column:
    """20 log10; minus infinity for an amplitude that isn't positive."""
    return F.when(amplitude > 0, 20.0 * F.log10(amplitude)).otherwise(F.lit(-INF))


def gain_to(peak: Column, target_db: float = -1.0) -> Column:
    """The factor that brings ``peak`` to ``target_db`` below full scale; 1 for silence."""
    return F.when(peak > 0, F.lit(10.0 ** (target_db / 20.0)) / peak).otherwise(F.lit(1.0))


def side_level(mid_rms: Column, side_rms: Column) -> Column:
    """Level of the side against the mid signal in dB: -inf for equal channels, +inf where only the side is left."""
    return (
        F.when((side_rms <= 0), F.lit(-INF))
        .when(mid_rms <= 0, F.lit(INF))
        .otherwise(20.0 * F.log10(side_rms / mid_rms))
    )


def near_multiple(length: Column, period: Column, slack: float = 0.1) -> Column:
    """Whether ``length`` is within ``slack`` periods of a multiple, from either side."""
    rest = F.pmod(length, period)
    return F.least(rest, period - rest) < slack * period


def signed_q31(fraction: Column, scale: int = 2**31) -> Column:
    """A fraction from -1 to 1 as eight hexadecimal digits of a 32-bit integer in two's complement, half to even."""
    whole = F.least(F.greatest(F.bround(fraction * float(scale), 0), F.lit(-float(scale))), F.lit(float(scale - 1))).cast("long")
    return F.lpad(F.hex(whole.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")


def thousandths(fraction: Column) -> Column:
    """0..1 as an integer of 0..1000, half to even."""
    return F.least(F.greatest(F.bround(fraction * 1000.0, 0), F.lit(0.0)), F.lit(1000.0)).cast("int")


def fitted_rate(rate: Column, low: int = 5000, high: int = 96000) -> Column:
    """The rate halved, in whole numbers, or doubled until it lies from ``low`` to ``high``; null where it is less than 1."""
    r = rate.cast("long")
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(63)), r, lambda x, _: F.when(x > high, F.shiftright(x, 1)).otherwise(x))
    doubled = F.aggregate(F.sequence(F.lit(1), F.lit(63)), halved, lambda x, _: F.when(x < low, x * 2).otherwise(x))
    return F.when(r >= 1, doubled).cast("double")


def crossfade_ms(amplitude_step: Column, slope_step: Column, hz: Column, floor: float = 0.0) -> Column:
    """Length of a loop's crossfade: 1.5 to 4 periods by how rough the seam is, 3 to 60 ms."""
    rough = F.least(F.greatest(F.lit(floor), amplitude_step / 0.25, slope_step / 0.50), F.lit(1.0))
    return F.least(F.greatest((1.5 + 2.5 * rough) * 1000.0 / hz, F.lit(3.0)), F.lit(60.0))


def piecewise_log(value: Column, points: list[tuple[float, float]]) -> Column:
    """A calibrated curve: logarithmic in the first segment, linear in the others, held at both ends."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        if (x0, y0) == points[0]:
            share = (F.ln(value) - math.log(x0)) / (math.log(x1) - math.log(x0))
        else:
            share = (value - x0) / (x1 - x0)
        out = F.when(value <= x1, y0 + share * (y1 - y0)).otherwise(out)
    return F.when(value <= points[0][0], F.lit(points[0][1])).otherwise(out)
