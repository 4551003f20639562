"""64-bit hashes of words and shingles in numpy."""

from __future__ import annotations

import numpy as np
import xxhash


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def joined(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` neighbours."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, "uint64")
    for k in range(size):
        out = mixed(out + codes[k : k + n] + np.uint64(k + 1))
    return out


def coded(words: list[bytes]) -> np.ndarray:
    """A text's words, in UTF-8, as hashes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, sorted."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
