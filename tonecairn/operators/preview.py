"""Four-second previews: tiling, mixing, shaping and simple synthesis."""

from __future__ import annotations

import numpy as np

from ..sources.riff import encode, resampled

RATE, SECONDS, PEAK = 48000, 4, 0.89


def tiled(x: np.ndarray, start: int, end: int, length: int) -> np.ndarray:
    """The signal up to its loop's end, then the loop again and again."""
    k = np.arange(length)
    return x[..., np.where(k < end, k, start + (k - start) % (end - start))]


def fitted(x: np.ndarray, length: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, length - x.shape[1]))))[:, :length]


def faded(x: np.ndarray, rate: int = RATE, attack_s: float = 0.005, release_s: float = 0.25) -> np.ndarray:
    n = x.shape[1]
    up, down = min(int(attack_s * rate), n), min(int(release_s * rate), n)
    gain = np.ones(n)
    gain[:up] *= np.linspace(0, 1, up)
    gain[n - down :] *= np.linspace(1, 0, down)
    return x * gain


def normalised(x: np.ndarray, peak: float = PEAK) -> np.ndarray:
    top = np.abs(x).max(initial=0.0)
    return x * (peak / top) if top > 0 else x


def mixed(hits: list[np.ndarray], length: int) -> np.ndarray:
    """Hits laid over each other at even distances."""
    out = np.zeros((2, length))
    for k, x in enumerate(hits):
        at = k * length // max(1, len(hits))
        n = min(x.shape[1], length - at)
        out[:, at : at + n] += x[:, :n]
    return out


def adsr(length: int, rate: int, attack: float, decay: float, sustain: float, release: float) -> np.ndarray:
    a, d, r = (int(t * rate) for t in (attack, decay, release))
    held = max(0, length - a - d - r)
    return np.concatenate([np.linspace(0, 1, a), np.linspace(1, sustain, d), np.full(held, sustain), np.linspace(sustain, 0, r)])[:length]


def oscillated(table: np.ndarray, hz: float, length: int, position: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A wavetable read at a pitch while its frame position (0 to 1) moves; linear between samples and frames."""
    frames, size = table.shape
    phase = np.arange(length) * hz / rate % 1.0 * size
    place = np.clip(position, 0, 1) * (frames - 1)
    i, f = phase.astype(int), place.astype(int)
    g, u, v = np.minimum(f + 1, frames - 1), phase - i, place - f
    j = (i + 1) % size
    low = table[f, i] * (1 - u) + table[f, j] * u
    return low * (1 - v) + (table[g, i] * (1 - u) + table[g, j] * u) * v


def low_passed(x: np.ndarray, hz: float, rate: int = RATE) -> np.ndarray:
    """Second-order Butterworth magnitude, applied to the spectrum."""
    spectrum = np.fft.rfft(x, axis=-1)
    f = np.fft.rfftfreq(x.shape[-1], 1 / rate)
    return np.fft.irfft(spectrum / np.sqrt(1 + (f / hz) ** 4), x.shape[-1], axis=-1)


def grain_cloud(x: np.ndarray, position: float, length: int, rate: int = RATE, grain_s: float = 0.12, seed: int = 1) -> np.ndarray:
    """Overlapping windowed grains around a spot of a stereo source."""
    size, rng = min(int(grain_s * rate), x.shape[1]), np.random.default_rng(seed)
    out, window = np.zeros((2, length)), np.hanning(size)
    for at in range(0, max(length - size, 0) + 1, max(1, size // 4)):
        centre = int(np.clip(position + rng.uniform(-0.02, 0.02), 0, 1) * (x.shape[1] - size))
        out[:, at : at + size] += (x[:, centre : centre + size] * window)[:, : length - at]
    return out


def preview(x: np.ndarray, rate: int, loop: tuple[int, int] | None = None) -> bytes:
    """WAV bytes of four stereo seconds at 48 kHz and 24 bits."""
    x = np.atleast_2d(np.asarray(x, float))
    x = np.repeat(x, 2, 0) if x.shape[0] == 1 else x[:2]
    if loop:
        x = tiled(x, *loop, rate * SECONDS)
    if rate != RATE:
        x = resampled(x, RATE / rate)
    return encode(RATE, faded(normalised(fitted(x, RATE * SECONDS))), 24)
