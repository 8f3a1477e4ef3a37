"""Spectral kernels: numpy over Arrow batches of signals held as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """By FFT, padded to twice the length so that it doesn't wrap."""
    n = len(x)
    spectrum = np.fft.rfft(x, 2 * n)
    return np.fft.irfft(spectrum * np.conj(spectrum), 2 * n)[:n]


def pitch_lag(x: np.ndarray, shortest: int = 2, gate: float = 0.3) -> int | None:
    """The lag of the first greatest autocorrelation of the windowed signal, if strong enough."""
    x = x - x.mean()
    r = autocorrelation(x * np.hanning(len(x)))
    longest = len(x) // 2
    if longest <= shortest or r[0] <= 0:
        return None
    best = int(np.argmax(r[shortest:longest])) + shortest
    return best if r[best] / r[0] >= gate else None


def band_shares(x: np.ndarray, bands: int = 3) -> list[float]:
    """Shares of the power in equal bands of the spectrum, without its constant part."""
    power = np.abs(np.fft.rfft(x)) ** 2
    power[0] = 0.0
    total = power.sum()
    parts = [float(p.sum()) for p in np.array_split(power, bands)]
    return [p / total if total > 0 else 0.0 for p in parts]


def spectral_features(signals: DataFrame) -> DataFrame:
    """sample_id, lag (null if none), bands, centroid for signals (sample_id, xs); an empty signal has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lags, bands, centres = [], [], []
            for xs in batch.column("xs").to_pylist():
                x = np.array([v for v in xs or () if v is not None], float)
                if not len(x):
                    lags.append(None), bands.append(None), centres.append(None)
                    continue
                size = np.abs(np.fft.rfft(x))
                size[0] = 0.0
                lags.append(pitch_lag(x))
                bands.append([round(b, 6) for b in band_shares(x)])
                centres.append(round(float((size * np.arange(len(size))).sum() / size.sum()), 6) if size.sum() > 0 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample_id"), pa.array(lags, pa.int64()), pa.array(bands, pa.list_(pa.float64())), pa.array(centres, pa.float64())],
                names=["sample_id", "lag", "bands", "centroid"],
            )

    return signals.select("sample_id", "xs").mapInArrow(run, "sample_id long, lag long, bands array<double>, centroid double")
