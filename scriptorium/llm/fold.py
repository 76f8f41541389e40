"""Skip-and-fold tables over code points, and polynomial hashes of what they keep.

A table maps each code point to 0 (skip it) or to the code point it folds to. Hashes are taken straight from the
code points of a whole batch of strings: no canonical string is ever built.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_END = 0x110000
_PLANES = ((0, 0x40000), (0xE0000, 0xE1000))
#: Odd multipliers, so that powers of them never vanish modulo 2**64.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=4)
def fold_table(kept: tuple[str, ...]) -> np.ndarray:
    """kept: the general categories to keep, as prefixes ('L' for letters, 'Nd' for decimal digits)."""
    t = np.zeros(_END, np.uint32)
    for lo, hi in _PLANES:
        for o in range(lo, hi):
            c = chr(o)
            if unicodedata.category(c).startswith(kept) and not 0xFE00 <= o <= 0xFE0F:
                up = c.upper()
                low = (up if len(up) == 1 else c).lower()
                t[o] = ord(low) if len(low) == 1 else o
    return t


def letters() -> np.ndarray:
    return fold_table(("L", "M"))


def letters_and_digits() -> np.ndarray:
    return fold_table(("L", "Nd"))


def code_points(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the batch in one array, and where each string begins (one more entry than strings)."""
    lengths = np.fromiter((0 if v is None else len(v) for v in values), np.int64, len(values))
    data = "".join(v for v in values if v is not None).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), np.concatenate(([0], np.cumsum(lengths)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # by doubling: powers up to 2k are the first k times base**k
        take = min(done, n - done)
        out[done : done + take] = out[:take] * (out[done - 1] * base)
        done += take
    return out


def poly_hashes(values: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of each string's kept code points, and how many were kept. NULL hashes as ''."""
    codes, begins = code_points(values)
    folded = table[np.minimum(codes, _END - 1)]
    keep = folded != 0
    before = np.concatenate(([0], np.cumsum(keep)))
    starts = before[begins]
    count = starts[1:] - starts[:-1]
    kept = folded[keep].astype(np.uint64)
    place = np.arange(len(kept)) - np.repeat(starts[:-1], count)
    longest = int(count.max()) if len(count) else 0
    with np.errstate(over="ignore"):
        mixed = (kept + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        out = []
        for base in _BASES:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(base, longest)[place], dtype=np.uint64)))
            out.append((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64))
    return out[0], out[1], count


def same_kept(a: str | None, b: str | None, table: np.ndarray) -> bool:
    """Two pointers that skip what the table skips: are the kept sequences equal?"""
    a, b = a or "", b or ""
    i = j = 0
    while True:
        while i < len(a) and not table[ord(a[i])]:
            i += 1
        while j < len(b) and not table[ord(b[j])]:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if table[ord(a[i])] != table[ord(b[j])]:
            return False
        i, j = i + 1, j + 1
