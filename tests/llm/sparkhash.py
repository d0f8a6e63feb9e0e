"""Spark's xxhash64 of strings, longs and ints, for brute-force versions."""

import struct

import xxhash


def xx(*values, seed=42):
    """values: str, int (long), ("i", int) for an int, None. Returns a signed long."""
    h = seed
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        if isinstance(v, tuple):
            h = _int(v[1], h)
            continue
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def _int(v, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", v), seed=seed)
