"""FLAC files of verbatim frames: lossless and readable by any decoder, without compression, for there is no encoder library here."""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 4096


def _crc_table(width: int, polynomial: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


#: Remainders of each byte by its distance from the end, made as far as a frame has needed.
_crc16_from_end = np.array([_CRC16], np.uint16)


def crc16(data: bytes) -> int:
    """The remainder of all bytes together: those of single bytes, each as far from the end as it stands, add up."""
    global _crc16_from_end
    n = len(data)
    if n > len(_crc16_from_end):
        rows, table = [_crc16_from_end], np.array(_CRC16, np.uint16)
        last = _crc16_from_end[-1]
        for _ in range(n - len(_crc16_from_end)):
            last = (last << np.uint16(8)) ^ table[last >> np.uint16(8)]
            rows.append(last[None, :])
        _crc16_from_end = np.concatenate(rows)
    return int(np.bitwise_xor.reduce(_crc16_from_end[np.arange(n - 1, -1, -1), np.frombuffer(data, np.uint8)])) if n else 0


def _number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 form that frame headers use."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (5 * more + 6):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | (n >> (6 * more))] + [0x80 | ((n >> (6 * i)) & 0x3F) for i in reversed(range(more))])


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A mono file of 16 bits from int16 samples."""
    x = np.ascontiguousarray(samples, dtype="<i2")
    blocks = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
    packed = (rate << 44) | (0 << 41) | (15 << 36) | len(x)
    info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(x.tobytes()).digest()
    out = [b"fLaC", b"\x80", len(info).to_bytes(3, "big"), info]
    for i, b in enumerate(blocks):
        # sync, fixed blocks; size in 16 bits at the end, rate as in the stream; one channel, 16 bits
        head = b"\xff\xf8\x70\x08" + _number(i) + (len(b) - 1).to_bytes(2, "big")
        frame = head + bytes([crc8(head)]) + b"\x02" + b.astype(">i2").tobytes()
        out.append(frame + crc16(frame).to_bytes(2, "big"))
    return b"".join(out)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of a file that :func:`encode` wrote; ValueError on anything else."""
    from nyuzi.functions import wav

    info = wav.flac_info(raw)
    if info is None:
        raise ValueError("no FLAC stream")
    at, got = 8 + int.from_bytes(raw[5:8], "big"), []
    while at < len(raw):
        size = 4
        lead = raw[at + 4] if at + 4 < len(raw) else 0
        size += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
        head = raw[at : at + size + 2]
        if head[:4] != b"\xff\xf8\x70\x08" or raw[at + size + 2] != crc8(head) or raw[at + size + 3] != 2:
            raise ValueError("not a verbatim frame")
        n = int.from_bytes(head[-2:], "big") + 1
        end = at + size + 4 + 2 * n
        if int.from_bytes(raw[end : end + 2], "big") != crc16(raw[at:end]):
            raise ValueError("a frame is damaged")
        got.append(np.frombuffer(raw[end - 2 * n : end], ">i2"))
        at = end + 2
    return info[0], np.concatenate(got).astype(np.int16) if got else np.zeros(0, np.int16)
