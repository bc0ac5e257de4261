"""All queries by name: the operator applied to relations of the bridge, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradelake.plans.bridge import relation, with_relations
from gradelake.sources.shared import dealt_out


@dataclass(frozen=True)
class Query:
    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    sql: str | None
    heavy: bool = False  # much work for each row of the first relation

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        first, *others = (relation(spark, sf_dir, r) for r in self.reads)
        if self.heavy:
            made_of = {"pages": "pages", "attempts": "orders"}.get(self.reads[0], "documents")
            first = dealt_out(first, f"{sf_dir}/{made_of}.parquet")
        return self.make(first, *others)


ALL: dict[str, Query] = {}


def query(name: str, *reads: str, sql: str | None = None, heavy: bool = False) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ALL:
            raise ValueError(f"{name} is registered twice")
        ALL[name] = Query(name, reads, f, with_relations(sql) if sql else None, heavy)
        return f

    return add
