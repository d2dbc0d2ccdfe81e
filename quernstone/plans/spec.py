"""Declarative queries: filter, project, group, aggregate, order, limit, sample. compile() makes one DataFrame; Catalyst does the rest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_of
from ..operators import distinct as d
from ..operators import histogram as h
from ..operators import quantile as q
from ..operators import sample as s


@dataclass(frozen=True)
class Value:
    """An aggregate that SQL has: count(*), sum(x), min(x), max(x), avg(x) ..."""

    name: str
    expression: str


def count(name: str = "count") -> Value:
    return Value(name, "count(*)")


def special_count(name: str, weight: str) -> Value:
    """Events, samples or stored samples: a sum of the rows' weight."""
    return Value(name, f"coalesce(sum({weight}), 0)")


@dataclass(frozen=True)
class Distinct:
    name: str
    columns: tuple[str, ...]
    mode: str = "exact"


@dataclass(frozen=True)
class WeightedDistinct:
    name: str
    columns: tuple[str, ...]
    weight: str


@dataclass(frozen=True)
class Percentiles:
    value: str
    percents: dict[str, float]
    weight: str | None = None


@dataclass(frozen=True)
class Histogram:
    name: str
    value: str
    size: int
    low: float | None = None
    high: float | None = None
    width: float | None = None
    weight: str | None = None
    shared_range: bool = False


@dataclass(frozen=True)
class Bins:
    name: str
    value: str
    separators: tuple[float, ...]
    weight: str | None = None


@dataclass
class QuerySpec:
    """where: SQL over the source. columns: computed columns by name. keys: group keys by name. having: SQL over the result. order: names, with - for descending. limit, first (any rows), reservoir (random rows, with seed)."""

    where: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    aggregates: list = field(default_factory=list)
    having: str | None = None
    order: list[str] = field(default_factory=list)
    limit: int | None = None
    first: int | None = None
    reservoir: int | None = None
    seed: int = 0
    group_cap: int | None = None

    def compile(self, source: DataFrame) -> DataFrame:
        rows = source.filter(self.where) if self.where else source
        if self.keys or self.aggregates:
            rows = self._grouped(rows)
        elif self.columns:
            rows = rows.select(*(F.expr(e).alias(n) for n, e in self.columns.items()))
        if self.having:
            rows = rows.filter(self.having)
        if self.reservoir is not None:
            rows = s.reservoir(rows, self.reservoir, self.seed)
        if self.first is not None:
            rows = s.first_n(rows, self.first)
        if self.order:
            return s.order_by(rows, self.order, self.limit)
        return rows if self.limit is None else rows.limit(self.limit)

    def _grouped(self, rows: DataFrame) -> DataFrame:
        keys = list(self.keys)
        rows = rows.withColumns({n: F.expr(e) for n, e in {**self.columns, **self.keys}.items()})
        plain: list[Column] = []
        apart: list[DataFrame] = []
        for a in self.aggregates:
            if isinstance(a, Value):
                plain.append(F.expr(a.expression).alias(a.name))
            elif isinstance(a, Distinct):
                plain.append(d.distinct(*map(F.col, a.columns), mode=a.mode).alias(a.name))
            elif isinstance(a, WeightedDistinct):
                apart.append(d.weighted(rows, keys, list(a.columns), a.weight, a.name))
            elif isinstance(a, Percentiles):
                apart.append(q.percentiles(rows, keys, a.value, a.percents, a.weight))
            elif isinstance(a, Histogram):
                apart.append(h.binned_struct(h.histogram(rows, keys, a.value, a.size, a.low, a.high, a.width, a.weight, a.shared_range), keys, a.name))
            elif isinstance(a, Bins):
                apart.append(h.binned_struct(h.explicit_bins(rows, keys, a.value, list(a.separators), a.weight), keys, a.name))
            else:
                raise TypeError(f"no aggregate: {a!r}")
        result = rows.groupBy(*keys).agg(*(plain or [F.count("*").alias("_rows")]))
        for part in apart:  # each has one row a key at most
            names = [c for c in part.columns if c not in keys]
            side = part.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *names)
            same = all_of([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
            result = result.join(side, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))
        result = result if plain else result.drop("_rows")
        if self.group_cap is not None and result.limit(self.group_cap + 1).count() > self.group_cap:
            raise RuntimeError(f"more than {self.group_cap} groups")
        return result
