"""Table manifests in TOML: catalogs, namespaces and tables, checked as a whole before anything is made of them."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

PLAIN = {
    **dict.fromkeys(("boolean", "bool"), T.BooleanType()),
    **dict.fromkeys(("int32", "int"), T.IntegerType()),
    **dict.fromkeys(("int64", "bigint", "long"), T.LongType()),
    **dict.fromkeys(("float32", "float"), T.FloatType()),
    **dict.fromkeys(("float64", "double"), T.DoubleType()),
    **dict.fromkeys(("string", "utf8", "varchar", "text"), T.StringType()),
    **dict.fromkeys(("date", "date32"), T.DateType()),
}
_DECIMAL = re.compile(r"decimal\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)$")
#: Beyond the plain names: what Parquet tables hold and Spark can declare.
_DDL = re.compile(r"(timestamp|timestamp_ntz|binary|smallint|tinyint|array<.*>|map<.*>|struct<.*>)$")


class ManifestError(ValueError):
    """The manifest says something that can't be."""


def data_type(name: str) -> T.DataType:
    low = name.strip().lower()
    if low in PLAIN:
        return PLAIN[low]
    if m := _DECIMAL.match(low):
        p, s = int(m[1]), int(m[2])
        if not (1 <= p <= 38 and s <= p):
            raise ManifestError(f"decimal({p},{s}) is out of range")
        return T.DecimalType(p, s)
    if _DDL.match(low):
        return T.DataType.fromDDL(low)
    raise ManifestError(f"unsupported data_type {name!r}")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    data_type: str
    nullable: bool = True


@dataclass(frozen=True)
class TableDef:
    """format: versioned (transactional) or listing (Parquet as it lies). parquet: a path; None makes an empty table."""

    name: str
    format: str = "versioned"
    parquet: str | None = None
    schema: tuple[ColumnDef, ...] | None = None

    def struct(self) -> T.StructType | None:
        return T.StructType([T.StructField(c.name, data_type(c.data_type), c.nullable) for c in self.schema]) if self.schema is not None else None


@dataclass(frozen=True)
class NamespaceDef:
    name: str
    tables: tuple[TableDef, ...] = ()


@dataclass(frozen=True)
class CatalogDef:
    """backend: memory (of this process), sql (shared and durable) or rest (named, not served)."""

    name: str
    backend: str = "memory"
    uri: str | None = None
    warehouse: str | None = None
    namespaces: tuple[NamespaceDef, ...] = ()


@dataclass(frozen=True)
class Manifest:
    catalogs: tuple[CatalogDef, ...] = field(default=())

    @classmethod
    def from_path(cls, path: str) -> Manifest:
        return cls.from_toml(Path(path).read_text())

    @classmethod
    def from_toml(cls, text: str) -> Manifest:
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ManifestError(f"not TOML: {e}") from e
        try:
            out = cls(tuple(_catalog(c) for c in raw.get("catalogs", [])))
        except (KeyError, TypeError, AttributeError) as e:
            raise ManifestError(f"missing or misplaced field: {e}") from e
        out.validate()
        return out

    def validate(self) -> None:
        def once(kind: str, name: str, seen: set[str]) -> None:
            if not name or not name.strip():
                raise ManifestError(f"a {kind} without a name")
            if name in seen:
                raise ManifestError(f"duplicate {kind} {name!r}")
            seen.add(name)

        catalogs: set[str] = set()
        bare: set[str] = set()
        for c in self.catalogs:
            once("catalog", c.name, catalogs)
            if c.backend not in ("memory", "sql", "rest"):
                raise ManifestError(f"catalog {c.name!r}: unknown backend {c.backend!r}")
            if c.uri is not None and not c.uri.strip():
                raise ManifestError(f"catalog {c.name!r}: its uri is blank")
            if c.backend == "rest" and c.uri is None:
                raise ManifestError(f"catalog {c.name!r}: a rest backend needs a uri")
            names: set[str] = set()
            for n in c.namespaces:
                once("namespace", n.name, names)
                tables: set[str] = set()
                for t in n.tables:
                    once("table", t.name, tables)
                    where = f"{c.name}.{n.name}.{t.name}"
                    if t.format not in ("versioned", "listing"):
                        raise ManifestError(f"{where}: unknown format {t.format!r}")
                    t.struct()
                    if t.parquet is None and t.schema is None:
                        raise ManifestError(f"{where}: an empty table needs a schema")
                    if t.format == "listing":
                        if t.parquet is None:
                            raise ManifestError(f"{where}: a listing table needs a Parquet source")
                        if t.name in bare:
                            raise ManifestError(f"duplicate listing table {t.name!r}")
                        bare.add(t.name)
                    elif not c.warehouse:
                        raise ManifestError(f"{where}: a versioned table needs a warehouse")


def _catalog(raw: dict) -> CatalogDef:
    backend = raw.get("backend", {"kind": "memory"})
    spaces = []
    for n in raw.get("namespaces", []):
        tables = []
        for t in n.get("tables", []):
            source = t["source"]
            if source["type"] not in ("parquet", "empty"):
                raise ManifestError(f"table {t['name']!r}: unknown source {source['type']!r}")
            schema = t.get("schema")
            # manifests written for other engines call the transactional format by its own name
            form = "listing" if t.get("format") == "listing" else "versioned" if t.get("format", "versioned") in ("versioned", "iceberg") else t["format"]
            tables.append(TableDef(t["name"], form, source["path"] if source["type"] == "parquet" else None, tuple(ColumnDef(c["name"], c["data_type"], c.get("nullable", True)) for c in schema) if schema is not None else None))
        spaces.append(NamespaceDef(n["name"], tuple(tables)))
    return CatalogDef(raw["name"], backend["kind"], backend.get("uri"), raw.get("warehouse"), tuple(spaces))


TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def tpch_manifest(catalog: str, namespace: str, subdir: str, form: str = "listing", warehouse: str | None = None, tables: tuple[str, ...] = TPCH_TABLES) -> Manifest:
    """A manifest of <subdir>/<table>.parquet for each table."""
    defs = tuple(TableDef(t, form, f"{subdir.rstrip('/')}/{t}.parquet") for t in tables)
    out = Manifest((CatalogDef(catalog, warehouse=warehouse, namespaces=(NamespaceDef(namespace, defs),)),))
    out.validate()
    return out
