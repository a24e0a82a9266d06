"""Privacy budgets and the sizes that follow from them."""

import math
from dataclasses import dataclass

from .noise import TGeom

#: Children of a node of the noisy hierarchy.
FAN_OUT = 16


@dataclass(frozen=True)
class Budget:
    """Shares of the budget for the directory, the records and the compaction. Defaults are the usual ones."""

    eps_d: float = 0.02
    eps_r: float = 0.26
    eps_c: float = 0.02

    @property
    def total(self) -> float:
        return self.eps_d + self.eps_r + self.eps_c

    @staticmethod
    def delta(rows: int) -> float:
        return float(max(1, rows)) ** -1.3 if rows > 1 else 0.5


@dataclass(frozen=True)
class HistogramPlan:
    """How the hierarchical histogram splits its budget over a domain of integers."""

    lo: int
    hi: int
    rows: int
    pk_fk: bool = False
    budget: Budget = Budget()

    @property
    def domain(self) -> int:
        return self.hi - self.lo + 1

    @property
    def height(self) -> int:
        """Levels, the leaves included."""
        levels, width = 1, 1
        while width < self.domain:
            width *= FAN_OUT
            levels += 1
        return levels

    @property
    def delta(self) -> float:
        return Budget.delta(self.rows) * (2 if self.pk_fk else 1)

    @property
    def eps(self) -> float:
        return self.budget.eps_d + self.budget.eps_r

    @property
    def histogram_noise(self) -> TGeom:
        return TGeom(0.2 * self.eps, 0.2 * self.delta, self.height)

    @property
    def bucket_noise(self) -> TGeom:
        return TGeom(self.eps - 0.2 * self.eps, self.delta - 0.2 * self.delta)

    @property
    def unit(self) -> int:
        return int(2 / self.budget.total * math.log(1 / self.delta))

    def parts(self, noisy_total: int, constant: float = 1.0) -> int:
        """The wished-for number of buckets; at least one."""
        return max(1, math.ceil((noisy_total // max(1, self.unit)) * self.height * constant))
