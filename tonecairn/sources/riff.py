"""RIFF and WAV bytes: chunks, format headers, loops, decoding, encoding and conforming."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
_GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")


@dataclass(frozen=True)
class WavFormat:
    codec: int
    channels: int
    rate: int
    bits: int
    fmt_offset: int
    fmt_size: int
    extensible: bool = False


@dataclass(frozen=True)
class Rules:
    """What a device plays."""

    pcm_bits: tuple[int, ...] = (16, 24, 32)
    float_bits: tuple[int, ...] = (32,)
    max_channels: int = 2
    min_rate: int = 5000
    max_rate: int = 96000


def chunks(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(id, offset of the body, size) of every chunk; a size beyond the file is cut to it."""
    at = 12
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        size = min(size, len(raw) - at - 8)
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def chunk(raw: bytes, name: bytes) -> bytes | None:
    return next((raw[a : a + n] for k, a, n in chunks(raw) if k == name), None)


def with_chunk(raw: bytes, name: bytes, body: bytes, before: bytes | None = None) -> bytes:
    """The file with a chunk put last, or ahead of the chunk ``before``; an older one of that name is left out."""
    new, parts = name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1), []
    for k, a, n in chunks(raw):
        if k == before and new not in parts:
            parts.append(new)
        if k != name:
            parts.append(raw[a - 8 : a + n] + b"\0" * (n & 1))
    data = b"WAVE" + b"".join(parts if new in parts else [*parts, new])
    return b"RIFF" + struct.pack("<I", len(data)) + data


def wav_format(raw: bytes) -> WavFormat | None:
    """None if it is no WAV file or has no whole format chunk; EXTENSIBLE resolves to its sub-format."""
    for name, at, size in chunks(raw):
        if name == b"fmt " and size >= 16:
            codec, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at)
            extensible = codec == EXTENSIBLE and size >= 40
            if extensible:
                codec = struct.unpack_from("<H", raw, at + 24)[0]
            return WavFormat(codec, channels, rate, bits, at, size, extensible)
    return None


def loop_points(raw: bytes) -> tuple[int, int] | None:
    """First loop of the sampler chunk as (start, past the end); None without one or if it is empty."""
    body = chunk(raw, b"smpl")
    if body is None or len(body) < 60 or struct.unpack_from("<I", body, 28)[0] < 1:
        return None
    start, last = struct.unpack_from("<II", body, 36 + 8)
    return (start, last + 1) if last > start else None


def loop_chunk(start: int, end: int, rate: int, note: int = 60) -> bytes:
    head = struct.pack("<9I", 0, 0, round(1e9 / rate), note, 0, 0, 0, 1, 0)
    return head + struct.pack("<6I", 0, 0, start, end - 1, 0, 0)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, float32 of shape (2, frames)); mono is doubled, of more than two channels the first two are kept."""
    form, body = wav_format(raw), chunk(raw, b"data")
    if form is None or body is None or form.channels < 1:
        raise ValueError("not a WAV file with data")
    width = form.bits // 8
    body = body[: len(body) // (width * form.channels) * width * form.channels]
    if form.codec == FLOAT and form.bits in (32, 64):
        x = np.frombuffer(body, f"<f{width}").astype(np.float32)
    elif form.codec == PCM and form.bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif form.codec == PCM and form.bits == 16:
        x = np.frombuffer(body, "<i2").astype(np.float32) / 32768
    elif form.codec == PCM and form.bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = (wide.reshape(-1).view("<i4") / 2147483648).astype(np.float32)
    elif form.codec == PCM and form.bits == 32:
        x = (np.frombuffer(body, "<i4") / 2147483648).astype(np.float32)
    else:
        raise ValueError(f"codec {form.codec} with {form.bits} bits")
    x = x.reshape(-1, form.channels).T
    return form.rate, np.ascontiguousarray(np.repeat(x, 2, 0) if form.channels == 1 else x[:2])


def quantised(x: np.ndarray, bits: int) -> bytes:
    top = (1 << (bits - 1)) - 1
    whole = np.clip(np.rint(np.asarray(x, np.float64) * top), -top - 1, top).astype("<i4")
    if bits == 24:
        return (whole << 8).view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    return whole.astype(f"<i{bits // 8}").tobytes()


def encode(rate: int, x: np.ndarray, bits: int = 24, codec: int = PCM, loop: tuple[int, int] | None = None) -> bytes:
    """A WAV file of (channels, frames)."""
    x = np.atleast_2d(x)
    inter = x.T.reshape(-1)
    body = inter.astype("<f4").tobytes() if codec == FLOAT else quantised(inter, bits)
    width = x.shape[0] * bits // 8
    form = struct.pack("<HHIIHH", codec, x.shape[0], rate, rate * width, width, bits)
    parts = [(b"fmt ", form), (b"data", body)]
    if loop:
        parts.append((b"smpl", loop_chunk(*loop, rate)))
    data = b"WAVE" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in parts)
    return b"RIFF" + struct.pack("<I", len(data)) + data


def violations(form: WavFormat, rules: Rules = Rules()) -> list[str]:
    """What the device refuses in a file: header, format, channels or rate."""
    out = ["header"] if form.extensible else []
    allowed = rules.pcm_bits if form.codec == PCM else rules.float_bits if form.codec == FLOAT else ()
    if form.bits not in allowed:
        out.append("format")
    if not 1 <= form.channels <= rules.max_channels:
        out.append("channels")
    if not rules.min_rate <= form.rate <= rules.max_rate:
        out.append("rate")
    return out


def fitting_rate(rate: int, rules: Rules = Rules()) -> int:
    """Halved, in whole numbers, or doubled until it is in the device's range. A rate of 0 never is."""
    if rate < 1:
        raise ValueError("no rate")
    while rate > rules.max_rate:
        rate //= 2
    while rate < rules.min_rate:
        rate *= 2
    return rate


def resampled(x: np.ndarray, ratio: float) -> np.ndarray:
    """Band-limited, by cutting or padding the spectrum of each channel."""
    n = x.shape[-1]
    m = max(1, round(n * ratio))
    spectrum = np.fft.rfft(x, axis=-1)
    out = np.zeros((*x.shape[:-1], m // 2 + 1), complex)
    keep = min(out.shape[-1], spectrum.shape[-1])
    out[..., :keep] = spectrum[..., :keep]
    return np.fft.irfft(out, m, axis=-1) * (m / n)


def conform(raw: bytes, rules: Rules = Rules()) -> tuple[bytes, float]:
    """(bytes that the device plays, ratio of the new rate to the old).

    A playable file passes as it is; an extensible header over playable data is
    rewritten; anything else is transcoded, even channels to the left, odd ones to the right.
    """
    form = wav_format(raw)
    if form is None:
        raise ValueError("not a WAV file")
    broken = violations(form, rules)
    if not broken:
        return raw, 1.0
    if broken == ["header"]:
        plain = struct.pack("<H", form.codec) + raw[form.fmt_offset + 2 : form.fmt_offset + 16]
        head = raw[: form.fmt_offset - 4] + struct.pack("<I", 16) + plain
        out = head + raw[form.fmt_offset + form.fmt_size :]
        return out[:4] + struct.pack("<I", len(out) - 8) + out[8:], 1.0
    body = chunk(raw, b"data") or b""
    mono = [decode(encode_channel(form, body, c))[1][0] for c in range(form.channels)]
    if not mono:
        raise ValueError("no channels")
    left, right = np.mean(mono[::2], 0), np.mean(mono[1::2] or mono[::2], 0)
    x = np.stack([left, right]) if form.channels > 1 else left[None]
    rate = fitting_rate(form.rate, rules)
    ratio = rate / form.rate
    if ratio != 1.0:
        x = resampled(x, ratio)
    bits = form.bits if form.codec == PCM and form.bits in rules.pcm_bits else max(rules.pcm_bits[:2])
    return encode(rate, x, bits), ratio


def encode_channel(form: WavFormat, body: bytes, channel: int) -> bytes:
    """One channel of interleaved data as a mono file of the same sample format."""
    width = form.bits // 8
    frames = np.frombuffer(body[: len(body) // (width * form.channels) * width * form.channels], np.uint8).reshape(-1, form.channels, width)
    data = frames[:, channel].tobytes()
    head = struct.pack("<HHIIHH", form.codec, 1, form.rate, form.rate * width, width, form.bits)
    parts = b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def scaled_loop(loop: tuple[int, int], ratio: float) -> tuple[int, int]:
    return round(loop[0] * ratio), round(loop[1] * ratio)


def decibels_to_share(db: float) -> float:
    return math.pow(10.0, db / 20.0)
