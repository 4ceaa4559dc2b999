"""RIFF/WAVE bytes: payload sniffing, header walk, decoding, writing. Plain Python for use inside Arrow functions."""

from __future__ import annotations

import base64
import binascii
import struct
from typing import NamedTuple

import numpy as np

#: Sizes that recorders write when they do not know the length.
OPEN_SIZES = (0xFFFFFFFF, 0x7FFFFFFF, 0x7FFFF000)


# Bits of a sample by format, 1 for whole numbers and 3 for floating point.
WIDTHS = {1: (8, 16, 24, 32), 3: (32, 64)}


class WavInfo(NamedTuple):
    rate: int
    channels: int
    bits: int
    kind: int
    start: int
    stop: int

    @property
    def frames(self) -> int:
        width = self.channels * self.bits // 8
        return (self.stop - self.start) // width if width else 0


def sniff(payload: bytes | None) -> bytes | None:
    """Audio bytes of a payload: as they are if they start like a RIFF file, else base64 text decoded.

    Line breaks, the URL alphabet, a data-URI head and missing padding are accepted; what is neither stays as it is.
    """
    if not payload or payload[:4] in (b"RIFF", b"RIFX", b"RF64", b"fLaC", b"OggS"):
        return payload
    text = payload
    if text[:5] == b"data:" and b"," in text[:80]:
        text = text.split(b",", 1)[1]
    text = b"".join(text.split()).translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
    try:
        return base64.b64decode(text[: len(text) - (len(text) % 4 == 1)] + b"=" * (-len(text) % 4 if len(text) % 4 != 1 else 0), validate=True)
    except (binascii.Error, ValueError):
        return payload


def header(raw: bytes | None) -> WavInfo | None:
    """Chunk walk over a RIFF/WAVE file; None if it cannot be read. A data chunk of open or too large size ends with the bytes."""
    if not raw or len(raw) < 12 or raw[:4] not in (b"RIFF", b"RIFX", b"RF64") or raw[8:12] != b"WAVE":
        return None
    end = ">" if raw[:4] == b"RIFX" else "<"
    at, form, wide = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack(end + "I", raw[at + 4 : at + 8])[0]
        body = at + 8
        if name == b"ds64" and body + 16 <= len(raw):
            wide = struct.unpack("<Q", raw[body + 8 : body + 16])[0]
        elif name == b"fmt ":
            if size < 16 or body + 16 > len(raw):
                return None
            kind, channels, rate, _, _, bits = struct.unpack(end + "HHIIHH", raw[body : body + 16])
            if kind == 0xFFFE and size >= 26 and body + 26 <= len(raw):
                kind = struct.unpack(end + "H", raw[body + 24 : body + 26])[0]
            if not channels or bits not in WIDTHS.get(kind, ()):
                return None
            form = (rate, channels, bits, kind)
        elif name == b"data":
            if form is None:
                return None
            left = len(raw) - body
            if size in OPEN_SIZES:
                size = wide if wide is not None and wide <= left else left
            return WavInfo(*form, body, body + min(size, left))
        at = body + size + (size & 1)
    return None


def samples(raw: bytes, info: WavInfo, big: bool = False) -> np.ndarray:
    """Frames of the data chunk, channels averaged; 8 bits are unsigned around 128. Up to 16 bits in float32, which holds them exactly, else in float64."""
    width = info.bits // 8
    n = info.frames * info.channels
    buf = raw[info.start : info.start + n * width]
    order = ">" if raw[:4] == b"RIFX" or big else "<"
    if info.kind == 3:
        x = np.frombuffer(buf, f"{order}f{width}").astype(np.float64)
    elif width == 1:
        x = np.frombuffer(buf, np.uint8).astype(np.float32)
        x -= 128
    elif width == 3:
        b = np.frombuffer(buf, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if order == ">" else b
        x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8).astype(np.float64)
    else:
        x = np.frombuffer(buf, f"{order}i{width}").astype(np.float32 if width == 2 else np.float64)
    return x.reshape(-1, info.channels).mean(axis=1, dtype=np.float64) if info.channels > 1 else x


def write(rate: int, channels: int, bits: int, data: bytes, kind: int = 1) -> bytes:
    """A minimal WAV file around PCM bytes."""
    width = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, kind, channels, rate, rate * width, width, bits, b"data", len(data))
    return head + data


def flac_info(raw: bytes | None) -> tuple[int, int] | None:
    """Sample rate (20 bits) and total samples (36 bits) of a FLAC STREAMINFO block."""
    if not raw or raw[:4] != b"fLaC" or len(raw) < 26:
        return None
    packed = int.from_bytes(raw[18:26], "big")
    return packed >> 44, packed & ((1 << 36) - 1)
