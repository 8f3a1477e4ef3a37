"""Wavetables of 2048-sample frames: features, archetype, fingerprint; and the stillest spot of a grain source."""

from __future__ import annotations

import numpy as np

FRAME = 2048


def frames(x: np.ndarray) -> np.ndarray:
    """Whole frames; a partial one at the end is ignored."""
    return np.asarray(x, float)[: len(x) // FRAME * FRAME].reshape(-1, FRAME)


def features(x: np.ndarray) -> dict[str, np.ndarray]:
    """Centroid in bins, tonality and hollowness of every frame; a silent one has 0, 1 and a half."""
    size = np.abs(np.fft.rfft(frames(x), axis=1))
    size[:, :1] = 0
    power = size**2
    total = power.sum(1)
    silent = total <= 1e-18
    safe = np.where(silent, 1, total)
    centre = (size * np.arange(size.shape[1])).sum(1) / np.where(silent, 1, size.sum(1))
    tonal = np.sort(power, 1)[:, -32:].sum(1) / safe
    odd, even = size[:, 3::2].sum(1), size[:, 2::2].sum(1)
    faint = odd + even < 0.02 * size[:, 1]
    hollow = np.where(faint, 0.5, odd / np.where(odd + even > 0, odd + even, 1))
    return {"centroid": np.where(silent, 0, centre), "tonality": np.where(silent, 1, tonal), "hollowness": np.where(silent, 0.5, hollow)}


def archetype(x: np.ndarray, bias: float = 0.0) -> dict:
    """Class, tag and start parameters of a table; flags where a limit is near or samples are left over."""
    if len(x) < FRAME:
        return {"archetype": "sustaining", "tag": "pad", "wt_position": 0.0, "lfo2_rate": 0.15, "lfo2_depth": 0.45, "filter_cutoff": 0.35, "flags": ["shorter than a frame"]}
    f = features(x)
    c, tonal, hollow = f["centroid"], float(f["tonality"].mean()), float(f["hollowness"].mean())
    moves, centre = float(c.max() - c.min()), float(c.mean())
    evolving = tonal < 0.65 or moves > 150
    tag = "drone" if evolving and tonal < 0.65 else "evolving" if evolving else "bass" if centre < 60 else "lead" if centre > 227 and hollow >= 0.5 else "pad"
    n = len(c)
    position = 0.0 if evolving or n < 2 else float(np.argmin(c)) / (n - 1)
    rate, depth = (0.55, 0.75) if moves > 150 else (0.30, 0.60) if moves > 50 else (0.15, 0.45)
    flags = [name for name, value, limit in (("tonality", tonal, 0.65), ("movement", moves, 150.0)) if abs(value - limit) <= 0.05 * limit]
    if len(x) % FRAME:
        flags.append("partial last frame")
    return {
        "archetype": "evolving" if evolving else "sustaining", "tag": tag, "wt_position": position, "lfo2_rate": rate, "lfo2_depth": min(depth, 1 - position),
        "filter_cutoff": float(np.clip(0.35 + centre / 600 + bias, 0.05, 0.95)), "flags": flags,
    }


def fingerprint(x: np.ndarray) -> np.ndarray | None:
    """Twenty numbers that say how a table sounds and moves: 16 bands, centre, travel, change, length."""
    table = frames(x)
    if not len(table):
        return None
    share = np.abs(np.fft.rfft(table, axis=1))[:, 1:129]
    share /= share.sum(1, keepdims=True) + 1e-12
    centre = share @ np.arange(1, 129)
    bands = share.mean(0).reshape(16, 8).sum(1)
    change = float(np.abs(np.diff(share, axis=0)).sum(1).mean()) if len(table) > 1 else 0.0
    rest = [np.log10(centre.mean() + 1), np.log10(np.ptp(centre) + 1), np.log10(change + 1e-3), np.log2(len(table))]
    return np.concatenate([np.log10(bands + 1e-5), rest])


def stillest(x: np.ndarray, rate: int, width: int = 4096, hop: int = 2048, window_s: float = 0.6, edge: float = 0.05) -> float:
    """Position from 0 to 1 of the stretch that is loud and changes least, away from both ends."""
    if len(x) < 2 * width:
        return 0.5
    view = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), width)[::hop]
    size = np.abs(np.fft.rfft(view * np.hanning(width), axis=1))
    share = size / np.maximum(size.sum(1, keepdims=True), 1e-12)
    flux = np.concatenate([[0], np.abs(np.diff(share, axis=0)).sum(1)])
    loud = np.sqrt((view**2).mean(1))
    k = max(1, min(round(window_s * rate / hop), len(loud)))
    mean = lambda v: np.convolve(v, np.ones(k) / k, "valid")
    score = mean(loud) / max(loud.max(), 1e-12) / (0.05 + mean(flux))
    at = (np.arange(len(score)) + k / 2) * hop / len(x)
    score[(at < edge) | (at > 1 - edge)] = -1
    return float(np.clip(at[int(score.argmax())], edge, 1 - edge))
