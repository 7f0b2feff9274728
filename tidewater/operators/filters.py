"""Session filters, compiled from task parameters to Column predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.sources.tasks import TaskParams


@dataclass(frozen=True)
class SessionFilter:
    """Conditions on enriched sessions; a missing (None or empty) parameter passes everything.

    An age range with one bound is ignored; bounds are inclusive. A null attribute never
    passes a condition on it. Keywords and categories pass on any common element.
    """

    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[int, ...] | None = None

    @classmethod
    def of(cls, p: TaskParams) -> SessionFilter:
        return cls(p.start_age, p.end_age, p.professionals, p.cities, p.sex, p.keywords, p.category_ids)

    def predicates(self) -> list[Column]:
        out = []
        if self.start_age is not None and self.end_age is not None:
            out.append(F.col("age").between(self.start_age, self.end_age))
        if self.professionals:
            out.append(F.col("professional").isin(*self.professionals))
        if self.cities:
            out.append(F.col("city").isin(*self.cities))
        if self.sex:
            out.append(F.col("sex") == self.sex)
        if self.keywords:
            out.append(F.arrays_overlap("search_keywords", F.array(*map(F.lit, self.keywords))))
        if self.category_ids:
            out.append(F.arrays_overlap("click_category_ids", F.array(*(F.lit(x).cast("bigint") for x in self.category_ids))))
        return out

    def condition(self) -> Column:
        return reduce(lambda a, b: a & b, self.predicates(), F.lit(True))

    def apply(self, sessions: DataFrame) -> DataFrame:
        return sessions.where(self.condition())
