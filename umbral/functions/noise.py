"""Seeded noise as column expressions.

Uniform bits come from md5 of (seed, tag, key), so any engine can draw the same numbers and a lost task
draws them again. This serves reproducible tests; it is no privacy-grade randomness.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 7


def uniform_bits(tag: str, *key: Column, seed: int = SEED) -> Column:
    """32 uniform bits for each key, as a long."""
    text = F.concat(F.lit(f"{seed}|{tag}|"), F.concat_ws("|", *[k.cast("string") for k in key]))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(tag: str, *key: Column, seed: int = SEED) -> Column:
    """A double in (0, 1)."""
    return (uniform_bits(tag, *key, seed=seed) + F.lit(0.5)) / F.lit(4294967296.0)


def geometric(eps: float, tag: str, *key: Column, seed: int = SEED) -> Column:
    """P(g) proportional to exp(-eps * g), g = 0, 1, ..."""
    return F.floor(F.log(uniform(tag, *key, seed=seed)) / F.lit(-eps))


@dataclass(frozen=True)
class TGeom:
    """Truncated geometric noise: two-sided, clamped to its mean; shifted draws lie in [0, 2 * mean].

    literal_width: the width ignores the sensitivity and only the shift grows with it.
    """

    eps: float
    delta: float
    sensitivity: int = 1
    literal_width: bool = False

    @property
    def mean(self) -> int:
        return int(self.sensitivity / self.eps * math.log(2 / self.delta)) + self.sensitivity - 1

    @property
    def rate(self) -> float:
        return self.eps if self.literal_width else self.eps / self.sensitivity

    def two_sided(self, tag: str, *key: Column, seed: int = SEED) -> Column:
        # The difference of two one-sided geometric numbers is two-sided geometric.
        return geometric(self.rate, f"{tag}a", *key, seed=seed) - geometric(self.rate, f"{tag}b", *key, seed=seed)

    def shifted(self, tag: str, *key: Column, seed: int = SEED) -> Column:
        return F.least(F.greatest(self.two_sided(tag, *key, seed=seed) + self.mean, F.lit(0)), F.lit(2 * self.mean)).cast("long")

    def plain(self, tag: str, *key: Column, seed: int = SEED) -> Column:
        return F.least(F.greatest(self.two_sided(tag, *key, seed=seed), F.lit(-self.mean)), F.lit(self.mean)).cast("long")


def laplace(scale: float, tag: str, *key: Column, seed: int = SEED) -> Column:
    u = uniform(tag, *key, seed=seed) - 0.5
    return F.lit(-scale) * F.signum(u) * F.log(F.lit(1.0) - 2 * F.abs(u))
