"""INSERT, DELETE and UPDATE on versioned tables: copy on write, optimistic commits, retries from the statement's text."""

from __future__ import annotations

import re
import secrets
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.resolve import Refused, Resolved, Statement, lex, parse, resolve
from ..sources.catalog import Catalogs
from ..sources.versioned import CommitConflict

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 0.025, 1.0


class WrongCatalog(Refused):
    """The statement writes to a catalog other than the one it was given to."""


@dataclass(frozen=True)
class DmlOutcome:
    kind: str
    rows_changed: int
    snapshot_id: int | None
    base_snapshot_id: int | None
    attempts: int

    @property
    def committed(self) -> bool:
        return self.snapshot_id != self.base_snapshot_id


def _split(sql: str, at: int, words: tuple[str, ...] = (), signs: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """The words and signs at depth 0 from position at on: (text in lower case, start, end)."""
    depth, found = 0, []
    for kind, t, start in lex(sql[at:]):
        if kind == "sign" and t in "([{":
            depth += 1
        elif kind == "sign" and t in ")]}":
            depth -= 1
        elif depth == 0 and ((kind == "word" and t.lower() in words) or (kind == "sign" and t in signs)):
            found.append((t.lower(), at + start, at + start + len(t)))
    return found


def check(st: Statement, catalog: str | None = None) -> None:
    """Refuse what has no defined meaning here, saying why."""
    if st.kind == "merge":
        raise Refused("MERGE is not served: a source that matches one row twice has no defined result")
    if st.target is None:
        raise Refused("not an INSERT, DELETE or UPDATE")
    if len(st.target.parts) == 1:
        raise Refused(f"{st.target.parts[0]}: name the table as catalog.namespace.table")
    if st.target.aliased:
        raise Refused("an alias on the written table is not served")
    if catalog is not None and len(st.target.parts) == 3 and st.target.parts[0] != catalog:
        raise WrongCatalog(f"{'.'.join(st.target.parts)} is not in catalog {catalog}")
    if st.kind == "insert":
        if st.plan.overwrite():
            raise Refused("INSERT OVERWRITE is not served; DELETE, then INSERT")
        if st.plan.partitionSpec().size():
            raise Refused("versioned tables have no partitions")


def _assignments(sql: str, start: int, end: int, columns: list[str]) -> dict[str, str]:
    text, out = sql[start:end], {}
    edges = [-1, *(s for _, s, _ in _split(text, 0, signs=(",",))), len(text)]
    for a, b in zip(edges, edges[1:], strict=False):
        piece = text[a + 1 : b]
        eq = _split(piece, 0, signs=("=",))
        if not eq:
            raise Refused(f"{piece.strip()!r} is not an assignment")
        name = "".join(t for _, t, _ in lex(piece[: eq[0][1]]))
        if name.startswith("("):
            raise Refused("assigning to a list of columns is not served")
        if "." in re.sub(r"`[^`]*`", "", name):
            raise Refused(f"{name}: name the column alone")
        bare = name[1:-1].replace("``", "`") if name.startswith("`") else name
        hit = [c for c in columns if c.lower() == bare.lower()]
        if not hit:
            raise Refused(f"there is no column {bare}")
        if hit[0] in out:
            raise Refused(f"{bare} is assigned twice")
        out[hit[0]] = piece[eq[0][2] :].strip()
    return out


def _insert(spark: SparkSession, r: Resolved) -> DmlOutcome:
    t, base = r.target.table, r.target.snapshot
    after = r.sql.find(r.target.view) + len(r.target.view)
    names = [st for st in (r.statement.plan.userSpecifiedCols().apply(i) for i in range(r.statement.plan.userSpecifiedCols().size()))]
    body = r.sql[after:]
    if names:
        depth = 0
        for kind, tok, start in lex(body):
            depth += (tok == "(") - (tok == ")") if kind == "sign" else 0
            if depth == 0:
                body = body[start + 1 :]
                break
    by_name = re.match(r"\s*by\s+name\b", body, re.I)
    rows = spark.sql(body[by_name.end() :] if by_name else body)
    fields = base.struct.fields
    if by_name:
        names = rows.columns
    if names:
        if len(names) != len(rows.columns):
            raise ValueError(f"{len(names)} columns are named and {len(rows.columns)} given")
        low = [n.lower() for n in names]
        if len(set(low)) < len(low) or not {f.name.lower() for f in fields} >= set(low):
            raise Refused(f"the columns {', '.join(names)} are not distinct columns of {t.name}")
        plain = rows.toDF(*[f"_{i}" for i in range(len(low))])
        rows = plain.select(*[(F.col(f"_{low.index(f.name.lower())}") if f.name.lower() in low else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    new = t.append(rows)
    added = int(new.summary.get("added-records", 0)) if new.version != base.version else 0
    return DmlOutcome("insert", added, new.snapshot_id, base.snapshot_id, 1)


def _rewrite(spark: SparkSession, r: Resolved, kind: str) -> tuple[int, DataFrame | None]:
    """(rows that match, the new contents or None where nothing is left)."""
    view, sql = r.target.view, r.sql
    after = sql.find(view) + len(view)
    where = _split(sql, after, words=("where",))
    # line breaks, since the text may end in a comment
    predicate = f"coalesce((\n{sql[where[0][2] :].strip()}\n), false)" if where else "true"
    n = spark.sql(f"SELECT count(*) FROM {view} WHERE {predicate}").collect()[0][0]
    if kind == "delete":
        return n, spark.sql(f"SELECT * FROM {view} WHERE NOT {predicate}") if where else None
    columns = [f.name for f in r.target.snapshot.struct.fields]
    head = _split(sql, after, words=("set",))
    new = _assignments(sql, head[0][2], where[0][1] if where else len(sql), columns)
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in columns}
    # one projection: every right-hand side reads the row as it was
    items = [f"CASE WHEN {predicate} THEN (\n{new[c]}\n) ELSE {q} END AS {q}" if c in new else q for c, q in quoted.items()]
    return n, spark.sql(f"SELECT {', '.join(items)} FROM {view}")


def execute(spark: SparkSession, catalogs: Catalogs, sql: str, catalog: str | None = None, before_commit=None) -> DmlOutcome:
    """Run one statement. A null predicate matches no row; no match makes no snapshot.

    A writer that loses the race plans again on the winner's snapshot, at most ATTEMPTS times. before_commit is called
    between staging and commit, for tests.
    """
    st = parse(spark, sql)
    check(st, catalog)
    wait = FIRST_WAIT
    for attempt in range(1, ATTEMPTS + 1):
        r = resolve(spark, catalogs, st)
        part = None
        try:
            if r.target.table is None:
                raise Refused(f"{r.target.name} is not a versioned table")
            if st.kind == "insert":
                return _insert(spark, r)
            if catalogs.lakehouse(st.target.parts[0]).backend != "sql":
                raise Refused(f"{st.kind.upper()} needs a shared (sql) catalog")
            t, base = r.target.table, r.target.snapshot
            n, rows = _rewrite(spark, r, st.kind)
            if not n:
                return DmlOutcome(st.kind, 0, base.snapshot_id, base.snapshot_id, attempt)
            part = t.stage(rows, base.struct) if rows is not None else None
            if before_commit:
                before_commit()
            new = t.commit(base, (part,) if part else (), part, "overwrite" if part else "delete")
            return DmlOutcome(st.kind, n, new.snapshot_id, base.snapshot_id, attempt)
        except CommitConflict:
            if part:
                r.target.table.discard(part.path)
            if attempt == ATTEMPTS:
                raise CommitConflict(f"{r.target.name}: other writers were first {ATTEMPTS} times") from None
            time.sleep(wait * (0.5 + secrets.randbelow(1000) / 1000))
            wait = min(LONGEST_WAIT, wait * 2)
        finally:
            r.release(spark)
    raise AssertionError
