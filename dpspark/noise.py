"""Laplace noise, drawn once on the driver: a lazy plan would draw it anew with every action, for anyone to average."""

from __future__ import annotations

import math
import random
import secrets
from collections.abc import Iterator

_SECURE = secrets.SystemRandom()


def laplace(scale: float, uniform: float) -> float:
    """The inverse of the distribution function at ``uniform``, above -1/2 and below 1/2."""
    return -scale * math.copysign(1.0, uniform) * math.log1p(-2.0 * abs(uniform))


class Noise:
    """Draws from the operating system, or, with a seed, for tests: then the guarantee is void."""

    def __init__(self, seed: int | None = None):
        self.void = seed is not None
        self._random = random.Random(seed) if self.void else _SECURE
        self.scales: list[float] = []

    def laplace(self, scale: float) -> float:
        self.scales.append(scale)
        while True:
            u = self._random.random() - 0.5
            if u > -0.5:
                return laplace(scale, u)

    def above(self, gate: float, scale: float) -> float:
        """Laplace noise that is known to be ``gate`` or more, which is 0 at least: beyond it, it is exponential."""
        self.scales.append(scale)
        return gate - scale * math.log1p(-self._random.random())

    def places(self, total: int, gate: float, scale: float) -> Iterator[int]:
        """The places from 0 to ``total`` at which Laplace noise is ``gate`` or more, each by itself; what lies between is skipped at once."""
        chance, at = math.exp(-gate / scale) / 2, -1
        while True:
            at += 1 + int(min(total, math.log1p(-self._random.random()) / math.log1p(-chance))) if chance > 0 else total + 1
            if at >= total:
                return
            yield at

    def discrete_laplace(self, scale: float) -> int:
        """The difference of two geometric numbers: whole, and free of the gaps of floating point."""
        self.scales.append(scale)

        def geometric() -> int:
            # in runs that end with probability 1 - exp(-1/scale)
            n = 0
            while self._random.random() < math.exp(-1.0 / scale):
                n += 1
            return n

        return geometric() - geometric()
