"""64-bit hashes of words and of word windows, in NumPy, the same in every process."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import xxhash

#: Words that a Python worker remembers before it starts afresh.
REMEMBER = 500_000
_U = np.uint64


class WordHashes(dict):
    """The hash of a word given as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()
#: What operators remember in this Python worker: a name, and the call that forgets it.
HELD: dict[str, Callable[[], None]] = {"words": WORDS.clear}
_last: list[str] = []


def only(name: str) -> None:
    """At a task's start: forget what other operators' tasks have left. Spark uses workers again, and idle ones hold on beside the JVM."""
    if _last != [name]:
        _last[:] = [name]
        for other, forget in HELD.items():
            if other != name:
                forget()
        gc.collect()  # some of it refers to itself


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all input bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of every window of n consecutive hashes; empty if there are fewer.

    A polynomial in an odd 64-bit base, mixed at the end; windows of a power of two are doubled.
    """
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15 + 2 * seed
    out, have, power = mix(hashes + _U(seed)), 1, base
    single = out
    for bit in bin(n)[3:]:
        out = out[: len(out) - have] * _U(power) + out[have:]
        have, power = 2 * have, power * power % 2**64
        if bit == "1":
            out = out[: len(single) - have] * _U(base) + single[have:]
            have, power = have + 1, power * base % 2**64
    return mix(out)
