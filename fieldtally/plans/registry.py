"""Where the named queries live, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldtally.plans import views
from fieldtally.plans.sql_views import compose

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


@dataclass(frozen=True)
class Tables:
    """Views of one data folder: ``t.event`` is the event view, ``t.raw('orders')`` a plain table."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return views.read(self.spark, self.sf_dir, name)

    def backup(self, side: str) -> DataFrame:
        return views.backup(self.spark, self.sf_dir, side)

    def device(self, side: str) -> DataFrame:
        return views.device(self.spark, self.sf_dir, side)

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(views, name)(self.spark, self.sf_dir)

    @property
    def flat(self) -> DataFrame:
        from fieldtally.operators.star import flatten

        return flatten(self.occurrence, self.event, self.station, self.taxon, self.project, self.campaign)

    @property
    def star(self) -> DataFrame:
        """The flat records as a written table, for queries that read them several times."""
        from fieldtally.operators.star import write_star

        return write_star(self.flat)

    def on_star(self, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A report on that table, written with the columns the report reads."""
        from fieldtally.operators.star import on_star

        return on_star(self.flat, report)


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, **extra_views: str) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} registered twice")
    REGISTRY[name] = (build, None if sql is None else compose(sql, **extra_views))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bind(build) for name, (build, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}


def _load() -> None:
    import importlib

    for module in ("scalars", "reports", "places", "devices", "exchange", "intake", "requirements", "speech", "streams"):
        importlib.import_module(f"fieldtally.plans.{module}")
