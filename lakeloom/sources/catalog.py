"""A manifest applied: listing tables under bare names, versioned ones made, registered and, by whom made them, filled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .manifest import CatalogDef, Manifest
from .storage import Storage
from .versioned import Lakehouse, NoSuchTable


@dataclass(frozen=True)
class Scope:
    """Whose tables: an account's catalogs and warehouses are its own; listing tables are everyone's."""

    account_id: int | None = None

    def catalog(self, name: str) -> str:
        return name if self.account_id is None else f"acct_{self.account_id}__{name}"

    def warehouse(self, root: str) -> str:
        return root if self.account_id is None else f"{root.rstrip('/')}/acct_{self.account_id}"


@dataclass
class Catalogs:
    """What names stand for. lakehouses: by the name in SQL. listings: bare name -> Parquet path."""

    spark: SparkSession
    lakehouses: dict[str, Lakehouse] = field(default_factory=dict)
    listings: dict[str, str] = field(default_factory=dict)
    #: made by the program: name -> DataFrame; they have no version
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def register_listing(self, tables: dict[str, str]) -> None:
        self.listings |= {n.lower(): p for n, p in tables.items()}

    def register_frame(self, name: str, df: DataFrame) -> None:
        self.frames[name.lower()] = lambda: df

    def lakehouse(self, name: str) -> Lakehouse:
        if name not in self.lakehouses:
            raise NoSuchTable(f"catalog {name}")
        return self.lakehouses[name]


def open_lakehouse(spark: SparkSession, storage: Storage, c: CatalogDef, scope: Scope) -> Lakehouse:
    return Lakehouse(spark, scope.catalog(c.name), scope.warehouse(storage.path(c.warehouse)), c.backend)


def apply_manifest(spark: SparkSession, storage: Storage, manifest: Manifest, scope: Scope = Scope(), into: Catalogs | None = None) -> Catalogs:
    """Applying a manifest again, or from several processes, makes and fills each table once."""
    manifest.validate()
    storage.configure(spark)
    out = into or Catalogs(spark)
    for c in manifest.catalogs:
        house = None
        if c.warehouse:
            house = out.lakehouses[c.name] = open_lakehouse(spark, storage, c, scope)
        for n in c.namespaces:
            if house and any(t.format == "versioned" for t in n.tables):
                house.ensure_namespace(n.name)
            for t in n.tables:
                path = storage.path(t.parquet) if t.parquet else None
                if t.format == "listing":
                    out.register_listing({t.name: path})
                    continue
                source = spark.read.parquet(path) if path else None
                schema = t.struct() or source.schema
                if house.ensure_table(n.name, t.name, schema) and source is not None:
                    house.table(n.name, t.name).append(source.select(*[f"`{f.name}`" for f in schema.fields]))
    return out
