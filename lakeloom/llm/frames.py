"""Columns by position: what else a table holds is carried along, whatever its names and types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def position(df: DataFrame, name: str) -> int:
    """Where the column of this name is: exactly, else as Spark compares names."""
    if name in df.columns:
        return df.columns.index(name)
    hits = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} columns named {name}")
    return hits[0]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


@dataclass
class Carried:
    """A table as (carried columns c0.., text _text): what a stage over texts reads, and how its result is named.

    Columns that the result replaces (names compared without case, as Spark does) are left out.
    """

    base: DataFrame
    id: str
    fields: list[StructField]
    text_at: int
    names: list[str]

    @property
    def n(self) -> int:
        return len(self.fields)

    def schema(self, *more: tuple[str, DataType]) -> StructType:
        return StructType([*self.fields, *(StructField(n, t) for n, t in more)])

    def result(self, out: DataFrame, text: str, *more: tuple[str, str]) -> DataFrame:
        """out's columns in the table's order, with text in its place, then (column of out, name)."""
        cols = [f.name for f in self.fields]
        cols.insert(self.text_at, text)
        return out.select(*cols, *[c for c, _ in more]).toDF(*self.names, *[n for _, n in more])


def carry(df: DataFrame, id_col: str, text_col: str, *replaced: str) -> Carried:
    i, t = position(df, id_col), position(df, text_col)
    gone = {r.lower() for r in replaced}
    keep = [k for k, c in enumerate(df.columns) if k in (i, t) or c.lower() not in gone]
    plain = numbered(df)
    fields = [StructField(f"c{k}", df.schema.fields[k].dataType) for k in keep if k != t]
    base = plain.select(*[f.name for f in fields], F.col(f"c{t}").alias("_text"))
    return Carried(base, f"c{i}", fields, keep.index(t), [df.columns[k] for k in keep])


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows that have both."""
    plain = numbered(df)
    return plain.select(F.col(f"c{position(df, id_col)}").alias("id"), F.col(f"c{position(df, text_col)}").alias("text")).filter("id is not null and text is not null")


def kind(df: DataFrame, name: str) -> DataType:
    return df.schema.fields[position(df, name)].dataType
