"""The three query shapes over the three partitioners, each built once and then queried."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.budget import Budget, HistogramPlan
from ..functions.noise import TGeom
from ..operators import catalog, grouping, htree, join, padding, privtree, select


@dataclass
class RangeSelect:
    """Selections on one attribute of one table. partitioner: histogram or tree."""

    df: DataFrame
    key: str
    bins: DataFrame

    @staticmethod
    def build(df: DataFrame, key: str, partitioner: str = "histogram", constant: float = 1.0, budget: Budget = Budget()) -> "RangeSelect":
        if partitioner == "histogram":
            plan = catalog.plan_for((df, key), budget=budget)
            return RangeSelect(df, key, htree.single_buckets(df, key, plan, constant))
        plan = privtree.TreePlan(1, df.where(F.col(key).isNotNull()).count(), kind="select", budget=budget)
        found = privtree.leaves([(df, [key])], plan)
        return RangeSelect(df, key, found.select("bin_id", F.col("lo_0").alias("lo"), F.col("hi_0").alias("hi"), F.col("real1").alias("real"), F.col("padded1").alias("padded")))

    def run(self, workload: DataFrame, mode: str = "exact") -> DataFrame:
        if mode == "exact":
            return select.exact_workload(self.df, self.key, workload)
        if mode == "bins":
            return select.touched(self.bins, workload)
        if mode == "padded":
            return select.response(self.df, self.key, self.bins, workload)
        if mode == "sizes":
            return select.blow_up(self.df, self.key, self.bins, workload)
        raise ValueError(f"unknown mode {mode!r}")


@dataclass
class EquiJoin:
    """Joins of two tables on one integer key. partitioner: histogram, tree or grouping; kind: general or pk_fk (left holds the primary key)."""

    left: DataFrame
    left_key: str
    right: DataFrame
    right_key: str
    partitioner: str = "histogram"
    kind: str = "general"
    constant: float = 1.0
    budget: Budget = Budget()

    def __post_init__(self) -> None:
        pk_fk = self.kind == "pk_fk"
        sides = (self.left, self.left_key, self.right, self.right_key)
        self.plan: HistogramPlan = catalog.plan_for((self.left, self.left_key), (self.right, self.right_key), pk_fk=pk_fk, budget=self.budget)
        self._members = None
        if self.partitioner == "histogram":
            self.bins = htree.shared_buckets(*sides, self.plan, self.constant)
        elif self.partitioner == "tree":
            n1, n2 = (df.where(F.col(k).isNotNull()).count() for df, k in (sides[:2], sides[2:]))
            tree = privtree.TreePlan(1, n1, n2, "pk_fk" if pk_fk else "join", self.budget)
            self.bins = privtree.leaves([(self.left, [self.left_key]), (self.right, [self.right_key])], tree).withColumnsRenamed({"lo_0": "lo", "hi_0": "hi"})
        elif self.partitioner == "grouping":
            plan = grouping.GroupingPlan(self.plan.rows, pk_fk, self.budget)
            self._members = grouping.members(*sides, plan)
            self.bins = grouping.bins(self._members, plan)
        else:
            raise ValueError(f"unknown partitioner {self.partitioner!r}")

    def _side(self, n: int) -> DataFrame:
        df, key = ((self.left, self.left_key), (self.right, self.right_key))[n - 1]
        rows = padding.placed_by_key(df, key, self._members) if self._members is not None else padding.placed(df, key, self.bins)
        return padding.padded(rows, self.bins, F.col(f"padded{n}") - F.col(f"real{n}"))

    def exact(self, attribute: str | None = None, qs: int = 0, qe: int = 0) -> DataFrame:
        if attribute is not None:
            return join.select_join(self.left, self.left_key, self.right, self.right_key, attribute, qs, qe)
        form = join.pk_fk_join if self.kind == "pk_fk" else join.equi_join
        return form(self.left, self.left_key, self.right, self.right_key)

    def slots(self, attribute: str | None = None, qs: int = 0, qe: int = 0) -> DataFrame:
        """The padded join; a range on the key also skips bins outside it."""
        where = None if attribute is None else F.col(attribute).between(qs, qe)
        skips = attribute in (self.left_key, self.right_key) and "lo" in self.bins.columns
        near = lambda side: side.join(catalog.overlapping(self.bins, qs, qe).select("bin_id"), "bin_id", "left_semi") if skips else side
        if self.kind == "pk_fk":
            return join.padded_pk_fk(self.left, self.left_key, near(self._side(2)), self.right_key, where)
        return join.padded_slots(near(self._side(1)), self.left_key, self._side(2), self.right_key, where=where)

    def sizes(self) -> DataFrame:
        """Slots of the padded join."""
        if self.kind == "pk_fk":
            return self.bins.agg(F.coalesce(F.sum("padded2"), F.lit(0)).cast("long").alias("slots"))
        return grouping.output_size(self.bins)

    def compaction(self) -> TGeom:
        largest = self.bins.agg(F.max(F.greatest("padded1", "padded2"))).first()[0] or 0
        return join.compaction_noise(self.budget.eps_c, Budget.delta(self.plan.rows), largest)

    def compacted(self) -> DataFrame:
        """Matches and dummies up to the noisy output size. Primary-to-foreign joins keep all slots instead."""
        if self.kind == "pk_fk":
            return self.slots()
        slots = self.slots()
        noise = self.left.sparkSession.range(1).select(self.compaction().shifted("c", F.lit(0))).first()[0]
        keep = [c for c in slots.columns if c not in ("bin_id1", "bin_id2", "is_dummy1", "is_dummy2", "is_match")]
        return padding.compacted(join.matches(slots).select(*keep), self.sizes().first()[0], noise)


@dataclass
class TreeSelectJoin:
    """Joins with a range on another attribute of the right table, over trees.

    The left tree divides the key, the right tree the key and the attribute. A query takes the right
    leaves that its range overlaps, and with each the left leaves that share key values.
    """

    left: DataFrame
    left_key: str
    right: DataFrame
    right_key: str
    attribute: str
    budget: Budget = Budget()

    def __post_init__(self) -> None:
        n1, n2 = (df.dropna(subset=cols).count() for df, cols in ((self.left, [self.left_key]), (self.right, [self.right_key, self.attribute])))
        self.left_leaves = privtree.leaves([(self.left, [self.left_key])], privtree.TreePlan(1, n1, budget=self.budget))
        self.right_leaves = privtree.leaves([(self.right, [self.right_key, self.attribute])], privtree.TreePlan(2, n2, budget=self.budget))

    def pairs(self, qs: int, qe: int) -> DataFrame:
        """bin_id1, bin_id2, padded1, padded2 of the leaves that a query joins."""
        one = lambda df: df.select("bin_id", F.col("lo_0").alias("lo"), F.col("hi_0").alias("hi"), F.col("padded1").alias("padded"))
        return join.bin_pairs(one(self.left_leaves), one(privtree.touched(self.right_leaves, 1, qs, qe)))

    def slots(self, qs: int, qe: int) -> DataFrame:
        """A slot for each pair of padded rows of these leaves; a match where keys are equal and the range holds."""
        extra = F.col("padded1") - F.col("real1")
        a = padding.padded(privtree.placed(self.left, [self.left_key], self.left_leaves), self.left_leaves, extra)
        b = padding.padded(privtree.placed(self.right, [self.right_key, self.attribute], self.right_leaves), self.right_leaves, extra)
        return join.padded_slots(a, self.left_key, b, self.right_key, self.pairs(qs, qe), F.col(self.attribute).between(qs, qe))
