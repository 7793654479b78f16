"""Models: a table described once (columns, key, defaults, relations) and queried lazily."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.order import Order


@dataclass(frozen=True)
class Relation:
    """A foreign key: ``column`` of the owning model holds ``target``'s key."""

    column: str
    target: Model
    optional: bool = True


@dataclass(frozen=True)
class ManyToMany:
    """Two hops through a link table: its ``near`` column is our key, its ``far`` column the target's."""

    through: Model
    near: str
    far: str
    target: Model


@dataclass(frozen=True)
class Model:
    """One table. ``columns`` maps names to SQL types and is the canonical projection.

    ``where`` and ``order`` are defaults that every query starts with (proxy models); ``edges``
    are the self-referencing columns; ``tenant`` names the column that a tenant filter needs.
    """

    name: str
    columns: dict[str, str]
    key: str
    where: Column | None = None
    order: tuple[Order, ...] = ()
    edges: tuple[str, ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)
    many: dict[str, ManyToMany] = field(default_factory=dict)
    deleted_at: str = "deleted_at"
    tenant: str | None = None

    def scan(self, source: DataFrame) -> DataFrame:
        """The canonical columns of ``source``, by name and type: never ``*``, so scans are pruned."""
        return source.select(*[F.col(c).cast(t).alias(c) for c, t in self.columns.items()])

    def table(self, spark: SparkSession, path: str) -> DataFrame:
        """The model's Parquet table under ``path``."""
        return self.scan(spark.read.parquet(f"{path}/{self.name}.parquet"))

    def objects(self, source: DataFrame, tenant=None):
        """A query over ``source``. A model with a tenant column needs a tenant; there is no way around it."""
        from millrace.queryset import QuerySet

        rows = self.scan(source)
        if self.tenant:
            if tenant is None:
                raise ValueError(f"{self.name} is per tenant: name one")
            rows = rows.where(F.col(self.tenant) == tenant)
        q = QuerySet(self, rows, order=self.order)
        return q if self.where is None else q.filter(self.where)
