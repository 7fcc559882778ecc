"""SplitMix64 and draws from it, and stream seeds. Kernels take numpy generators seeded by tuples instead."""

from __future__ import annotations

import numpy as np

GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class SplitMix64:
    def __init__(self, seed: int):
        self.state = (seed + GOLDEN) & _MASK

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & _MASK
        return _mixed(self.state)

    def uniform(self) -> float:
        return (self.next() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        return self.next() % n


def _mixed(z: int) -> int:
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def binary_digits(p: float, n: int = 12) -> list[int]:
    """The first n binary digits of a probability below 1, cut off."""
    out = []
    for _ in range(n):
        p *= 2
        out.append(int(p >= 1))
        p -= out[-1]
    return out


def bernoulli(generator: np.random.Generator, p: float, shape) -> np.ndarray:
    return generator.random(shape) < p
