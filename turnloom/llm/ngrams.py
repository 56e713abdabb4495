"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")
_LAST = np.uint64(0xFF51AFD7ED558CCD)


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text between zeros, and where each text starts; one more start for the end."""
    joined = "\0" + "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "u4")
    sizes = np.fromiter((len(t) for t in texts), "i8", len(texts))
    return codes, np.concatenate([[1], 1 + np.cumsum(sizes + 1)])


def grams(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket (of 2**bits) of the n-gram that starts at each code point; the last n-1 wrap to nothing."""
    if len(codes) < n:
        return np.zeros(0, "u8")
    wide, h = codes.astype("u8") + np.uint64(1), None
    for k in range(n):
        part = wide[k : len(codes) - n + 1 + k] * _MIX[k % 8] ** np.uint64(1 + k // 8)
        h = part if h is None else h ^ ((part << np.uint64(7 * k % 64)) | (part >> np.uint64((64 - 7 * k % 64) % 64)))
    h ^= h >> np.uint64(29)
    return (h * _LAST) >> np.uint64(64 - bits)
