"""Sorted keys and counts as compact bytes, for the exchanges of the counting operators."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    return a.dtype.str.encode().ljust(4) + zstandard.compress(a.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b[4:]), np.dtype(b[:4].strip().decode()))


def pack_planes(a: np.ndarray) -> bytes:
    """Numbers of which most are small: all their lowest bytes first, and so on."""
    return a.dtype.str.encode().ljust(4) + zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unpack_planes(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].strip().decode())
    planes = np.frombuffer(zstandard.decompress(b[4:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences."""
    d = np.diff(keys, prepend=np.uint64(0))
    small = len(d) < 2 or int(d[1:].max()) < 1 << 32
    return keys[:1].tobytes().ljust(8, b"\0") + pack(d[1:].astype(np.uint32) if small else d[1:]) if len(keys) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    d = unpack(b[8:]).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(b[:8], np.uint64), d]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
