"""Loudness and sample formats on arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET_RMS, MAX_GAIN, PEAK_CEILING, SILENT = 0.1, 4.0, 0.98, 1e-6


def rms(samples: Column) -> Column:
    squares = F.aggregate(samples, F.lit(0.0), lambda a, s: a + s.cast("double") * s.cast("double"))
    return F.sqrt(squares / F.greatest(F.lit(1), F.size(samples)))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda s: F.abs(s.cast("double")))), F.lit(0.0))


def gain(rms_: Column, peak_: Column) -> Column:
    raw = F.least(F.try_divide(F.lit(TARGET_RMS), rms_), F.lit(MAX_GAIN))
    safe = F.when(peak_ * raw > PEAK_CEILING, F.try_divide(F.lit(PEAK_CEILING), peak_)).otherwise(raw)
    return F.when((rms_ < SILENT) | (peak_ < SILENT), F.lit(1.0)).otherwise(safe)


def normalise(samples: Column, factor: Column) -> Column:
    return F.transform(samples, lambda s: s.cast("double") * factor)


def pcm16(samples: Column) -> Column:
    """16-bit samples: clamped, negative ones times 32768, others times 32767, truncated."""

    def one(s):
        c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.cast("double")))
        return F.when(c < 0, c * 32768).otherwise(c * 32767).cast("int")

    return F.transform(samples, one)


def interleave(channels: Column) -> Column:
    """Arrays of equal length, sample by sample."""
    n = F.size(F.get(channels, F.lit(0)))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(channels, lambda c: F.get(c, i))))).otherwise(F.expr("cast(array() as array<int>)"))


def _little(v: Column, n_bytes: int) -> Column:
    """Hex digits of an integer, lowest byte first."""
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(v, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n_bytes)))


def wav_bytes(pcm: Column, channels: int, rate: int) -> Column:
    """A RIFF file of interleaved 16-bit samples."""
    size, text = F.size(pcm) * 2, lambda s: F.lit(s.encode().hex())
    number = lambda v, n: _little(v if isinstance(v, Column) else F.lit(v), n)
    head = [text("RIFF"), number(size + 36, 4), text("WAVEfmt "), number(16, 4), number(1, 2), number(channels, 2), number(rate, 4), number(rate * channels * 2, 4), number(channels * 2, 2), number(16, 2), text("data"), number(size, 4)]
    return F.unhex(F.concat(*head, F.array_join(F.transform(pcm, lambda v: _little(v, 2)), "")))


def volume(v: Column) -> Column:
    """Applied volume from 0 to 1; no number means full."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(100.0)) / 100))
