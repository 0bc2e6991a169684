"""Words and hashed word shingles of a text, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash


def words_of(text: str) -> list[bytes]:
    """Bytes lower-case A-Z alone and are split at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `size` space-joined words, in order; of all words where they are fewer."""
    line, n = b" ".join(words), len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip((ends - sizes).tolist(), ends[size - 1 :].tolist(), strict=False)), np.uint64, n)
