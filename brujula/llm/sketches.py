"""Word sets, frequent words and SuperMinHash signatures, vectorised per batch."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M64 = np.uint64(0xBF58476D1CE4E5B9)
N64 = np.uint64(0x94D049BB133111EB)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * M64
        x = (x ^ (x >> np.uint64(27))) * N64
        return x ^ (x >> np.uint64(31))


def super_min_hash(hashes: np.ndarray, offsets: np.ndarray, slots: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures (sets x slots) of sets of 32-bit word hashes.

    Every element deals the numbers 0..slots-1 to the slots by its own random permutation and
    adds a random fraction; a slot keeps the least value it is dealt. The permutation makes
    the slots' values depend on each other negatively, which lowers the variance against
    independent hashes. Elements deal in rounds of ascending number; a set stops as soon as
    all its slots hold values below the next round's. The value's low 32 bits are the hash
    of the element that won the slot. Sets without elements get the greatest value.
    """
    if not 0 < slots <= 64:
        raise ValueError("1 to 64 slots")
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.full(n * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    if n == 0 or len(hashes) == 0:
        return out.reshape(n, slots)
    distinct, inverse = np.unique(hashes, return_inverse=True)
    base = mixed(distinct.astype(np.uint64) ^ (np.uint64(seed) << np.uint64(40)))
    perm = np.repeat(np.arange(slots, dtype=np.int16)[None, :], len(distinct), axis=0)
    rows = np.arange(len(distinct))
    owner = np.repeat(np.arange(n), sizes)
    active = np.arange(len(hashes))
    low = distinct.astype(np.uint64)
    for j in range(slots):
        base = mixed(base)
        k = j + (base >> np.uint64(33)).astype(np.int64) % (slots - j)
        perm[rows, j], perm[rows, k] = perm[rows, k], perm[rows, j]
        value = (np.uint64(j) << np.uint64(58)) | ((base & np.uint64((1 << 26) - 1)) << np.uint64(32)) | low
        d = inverse[active]
        np.minimum.at(out, owner[active] * slots + perm[d, j], value[d])
        open_sets = out.reshape(n, slots).max(axis=1) >= np.uint64(j + 1) << np.uint64(58)
        active = active[open_sets[owner[active]]]
        if not len(active):
            break
    return out.reshape(n, slots)


def frequent_words(classes: DataFrame, words: str = "palabras", over: int = 50, size: int = 32_768) -> list[str]:
    """Words that more than `over` sets hold, at most the `size` commonest; all sets are counted.

    Both bounds are parameters; the list doesn't grow with the data beyond `size`.
    """
    counts = classes.select(F.explode(F.split(words, " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > over)
    return [r[0] for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]
