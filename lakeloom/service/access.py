"""Privileges on catalogs, namespaces, tables and warehouses, and what a statement needs. What isn't known is refused."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.resolve import Refused, Statement, object_name
from .allowed import FUNCTIONS, NODES, UNRESOLVED

PRIVILEGES = ("SELECT", "INSERT", "DELETE", "UPDATE", "USAGE", "CANCEL", "ALL")
SEGMENTS = {"catalog": 1, "namespace": 2, "table": 3, "warehouse": None}


class Denied(PermissionError):
    """The principal lacks a grant; the message names it."""


def is_denial(e: BaseException | None) -> bool:
    while e is not None:
        if isinstance(e, Denied):
            return True
        e = e.__cause__ or e.__context__
    return False


@dataclass(frozen=True, order=True)
class Object:
    kind: str
    name: str

    def __str__(self) -> str:
        return f"{self.kind} {self.name}"

    def validate(self) -> Object:
        if self.kind not in SEGMENTS:
            raise ValueError(f"unknown kind of object {self.kind!r}")
        if not self.name or self.name != self.name.strip():
            raise ValueError(f"{self.name!r} can't be the name of a {self.kind}")
        parts, want = self.name.split("."), SEGMENTS[self.kind]
        if want is None and len(parts) > 1:
            raise ValueError(f"a warehouse has a bare name, not {self.name!r}")
        if want is not None and (len(parts) != want or not all(parts)):
            raise ValueError(f"a {self.kind} has {want} names with dots between them, not {self.name!r}")
        return self

    def covers(self, other: Object) -> bool:
        """Catalogs hold namespaces and tables, namespaces tables; a warehouse is only itself."""
        if self == other:
            return True
        inside = {"catalog": ("namespace", "table"), "namespace": ("table",)}.get(self.kind, ())
        mine, theirs = self.name.split("."), other.name.split(".")
        return other.kind in inside and len(theirs) == SEGMENTS[other.kind] and theirs[: len(mine)] == mine


@dataclass(frozen=True, order=True)
class Grant:
    privilege: str
    on: Object

    def __str__(self) -> str:
        return f"{self.privilege} on {self.on}"

    def validate(self) -> Grant:
        if self.privilege not in PRIVILEGES:
            raise ValueError(f"unknown privilege {self.privilege!r}")
        self.on.validate()
        return self

    def satisfies(self, need: Grant) -> bool:
        return self.privilege in (need.privilege, "ALL") and self.on.covers(need.on)


@dataclass(frozen=True)
class Authorization:
    """What one user may do; None in place of this object means that nobody asks."""

    user: str
    grants: tuple[Grant, ...]

    def missing(self, needs: list[Grant]) -> list[Grant]:
        return [n for n in needs if not any(g.satisfies(n) for g in self.grants)]

    def check(self, needs: list[Grant]) -> None:
        """All that is missing in one message."""
        if lack := self.missing(needs):
            raise Denied(f"{self.user} lacks {'; '.join(map(str, lack))}")


def required(st: Statement) -> list[Grant]:
    """The grants that a statement needs, those of its subqueries and common table expressions among them."""
    if st.kind in ("command", "merge"):
        raise Denied(f"this kind of statement is not served under access control: {st.sql[:60]!r}")
    strange = sorted((st.nodes - NODES) | (st.unresolved - UNRESOLVED) | {f"{f}()" for f in st.functions - FUNCTIONS})
    if strange:
        raise Denied(f"not served under access control: {', '.join(strange)}")
    for r in st.refs:
        if len(r.parts) not in (1, 3):
            raise Refused(f"{'.'.join(r.parts)} is not the name of a table")
    needs = {Grant("SELECT", Object("table", object_name(r.parts))) for r in st.refs}
    if st.target:
        on = Object("table", object_name(st.target.parts))
        needs.add(Grant(st.kind.upper(), on))
    return sorted(needs)
