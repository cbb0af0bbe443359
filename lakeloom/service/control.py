"""The services database (SQLite): accounts, users, keys, roles, grants, warehouses, history, leases and slots."""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import re
import secrets
import sqlite3
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from .access import Authorization, Grant, Object

SCHEMA = [
    """
CREATE TABLE accounts (id INTEGER PRIMARY KEY, name TEXT UNIQUE NOT NULL, created REAL NOT NULL);
CREATE TABLE users (id INTEGER PRIMARY KEY, account_id INTEGER NOT NULL REFERENCES accounts, name TEXT NOT NULL, disabled INTEGER NOT NULL DEFAULT 0, UNIQUE (account_id, name));
CREATE TABLE api_keys (id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL REFERENCES users, prefix TEXT NOT NULL, hash BLOB NOT NULL, created REAL NOT NULL, expires REAL, revoked REAL);
CREATE INDEX api_keys_prefix ON api_keys (prefix);
CREATE TABLE roles (id INTEGER PRIMARY KEY, account_id INTEGER NOT NULL REFERENCES accounts, name TEXT NOT NULL, UNIQUE (account_id, name));
CREATE TABLE user_roles (user_id INTEGER NOT NULL REFERENCES users, role_id INTEGER NOT NULL REFERENCES roles, PRIMARY KEY (user_id, role_id));
CREATE TABLE grants (role_id INTEGER NOT NULL REFERENCES roles, privilege TEXT NOT NULL, kind TEXT NOT NULL, name TEXT NOT NULL, PRIMARY KEY (role_id, privilege, kind, name));
CREATE TABLE warehouses (id INTEGER PRIMARY KEY, account_id INTEGER NOT NULL REFERENCES accounts, name TEXT NOT NULL, size INTEGER NOT NULL CHECK (size > 0), state TEXT NOT NULL, UNIQUE (account_id, name));
CREATE TABLE queries (id TEXT PRIMARY KEY, account_id INTEGER NOT NULL, warehouse TEXT, sql TEXT NOT NULL, state TEXT NOT NULL, submitted REAL NOT NULL, started REAL, finished REAL, rows INTEGER, error TEXT, coordinator TEXT);
CREATE INDEX queries_active ON queries (state) WHERE state IN ('queued', 'running');
CREATE TABLE coordinators (slot TEXT PRIMARY KEY, incarnation TEXT NOT NULL, renewed REAL NOT NULL);
CREATE TABLE admission_slots (warehouse_id INTEGER NOT NULL, n INTEGER NOT NULL, holder TEXT NOT NULL, query_id TEXT NOT NULL, PRIMARY KEY (warehouse_id, n));
CREATE TABLE result_cache (account_id INTEGER NOT NULL, digest TEXT NOT NULL, key TEXT NOT NULL, payload BLOB NOT NULL, stored REAL NOT NULL, used REAL NOT NULL, PRIMARY KEY (account_id, digest));
""",
]
KEY_PREFIX, LOOKUP, MAX_ERROR = "loom_", 12, 4000
RENEW_SECONDS, MISSED = 10.0, 3
NEVER_STARTED, DIED = "its coordinator ended before the query began", "its coordinator ended while the query ran"
ABANDONED = "the client left before the query ended"


class AuthError(PermissionError):
    """reason: missing, invalid, revoked, expired or disabled."""

    def __init__(self, reason: str):
        super().__init__(f"the credential is {reason}")
        self.reason = reason


@dataclass(frozen=True)
class Principal:
    account_id: int
    user_id: int
    user: str


@dataclass(frozen=True)
class Warehouse:
    id: int
    account_id: int
    name: str
    size: int
    state: str


class Services:
    """Every method is one transaction; times are seconds since 1970 and can be set for tests."""

    def __init__(self, path: str = ":memory:", now=time.time):
        self.db = sqlite3.connect(path, check_same_thread=False, isolation_level=None, timeout=30)
        self.db.row_factory = sqlite3.Row
        self.lock, self.now, self.path = threading.RLock(), now, path
        self.migrate()

    @contextlib.contextmanager
    def tx(self) -> Iterator[sqlite3.Connection]:
        with self.lock:
            self.db.execute("BEGIN IMMEDIATE")
            try:
                yield self.db
            except BaseException:
                self.db.execute("ROLLBACK")
                raise
            self.db.execute("COMMIT")

    def one(self, sql: str, *args) -> sqlite3.Row | None:
        with self.lock:
            return self.db.execute(sql, args).fetchone()

    def all(self, sql: str, *args) -> list[sqlite3.Row]:
        with self.lock:
            return self.db.execute(sql, args).fetchall()

    def migrate(self) -> int:
        """The schema's version after applying what was missing."""
        with self.lock:
            have = self.db.execute("PRAGMA user_version").fetchone()[0]
            for v in range(have, len(SCHEMA)):
                self.db.executescript(f"BEGIN IMMEDIATE; {SCHEMA[v]} PRAGMA user_version = {v + 1}; COMMIT;")
            return len(SCHEMA)

    def healthy(self) -> bool:
        return self.one("SELECT 1")[0] == 1

    # accounts and users
    def create_account(self, name: str) -> int:
        if not name.strip():
            raise ValueError("an account needs a name")
        with self.tx() as db:
            return db.execute("INSERT INTO accounts (name, created) VALUES (?, ?)", (name, self.now())).lastrowid

    def account(self, name: str) -> int | None:
        row = self.one("SELECT id FROM accounts WHERE name = ?", name)
        return row and row["id"]

    def ensure_account(self, name: str) -> int:
        with self.tx() as db:
            db.execute("INSERT OR IGNORE INTO accounts (name, created) VALUES (?, ?)", (name, self.now()))
        return self.account(name)

    def list_accounts(self) -> list[str]:
        return [r["name"] for r in self.all("SELECT name FROM accounts ORDER BY id")]

    def create_user(self, account_id: int, name: str) -> int:
        with self.tx() as db:
            return db.execute("INSERT INTO users (account_id, name) VALUES (?, ?)", (account_id, name)).lastrowid

    def user(self, account_id: int, name: str) -> int | None:
        row = self.one("SELECT id FROM users WHERE account_id = ? AND name = ?", account_id, name)
        return row and row["id"]

    def list_users(self, account_id: int) -> list[tuple[str, bool]]:
        return [(r["name"], bool(r["disabled"])) for r in self.all("SELECT name, disabled FROM users WHERE account_id = ? ORDER BY id", account_id)]

    def set_disabled(self, user_id: int, disabled: bool) -> None:
        with self.tx() as db:
            db.execute("UPDATE users SET disabled = ? WHERE id = ?", (int(disabled), user_id))

    # keys
    def create_key(self, user_id: int, lifetime: float | None = None) -> tuple[int, str]:
        """(key id, token): the token is shown this once; only its hash is kept."""
        token = KEY_PREFIX + secrets.token_urlsafe(32)
        with self.tx() as db:
            row = db.execute("INSERT INTO api_keys (user_id, prefix, hash, created, expires) VALUES (?, ?, ?, ?, ?)", (user_id, token[:LOOKUP], hashlib.sha256(token.encode()).digest(), self.now(), self.now() + lifetime if lifetime is not None else None))
            return row.lastrowid, token

    def list_keys(self, user_id: int) -> list[dict]:
        return [dict(r) for r in self.all("SELECT id, prefix, created, expires, revoked FROM api_keys WHERE user_id = ? ORDER BY id", user_id)]

    def revoke_key(self, key_id: int) -> bool:
        with self.tx() as db:
            return db.execute("UPDATE api_keys SET revoked = ? WHERE id = ? AND revoked IS NULL", (self.now(), key_id)).rowcount == 1

    def authenticate(self, token: str | None) -> Principal:
        if not token:
            raise AuthError("missing")
        want, found = hashlib.sha256(token.encode()).digest(), None
        for row in self.all("SELECT k.*, u.account_id, u.name AS user, u.disabled FROM api_keys k JOIN users u ON u.id = k.user_id WHERE k.prefix = ?", token[:LOOKUP]):
            if hmac.compare_digest(row["hash"], want):
                found = row
        if found is None:
            raise AuthError("invalid")
        if found["revoked"] is not None:
            raise AuthError("revoked")
        if found["expires"] is not None and found["expires"] <= self.now():
            raise AuthError("expired")
        if found["disabled"]:
            raise AuthError("disabled")
        return Principal(found["account_id"], found["user_id"], found["user"])

    # roles and grants
    def create_role(self, account_id: int, name: str) -> int:
        with self.tx() as db:
            return db.execute("INSERT INTO roles (account_id, name) VALUES (?, ?)", (account_id, name)).lastrowid

    def role(self, account_id: int, name: str) -> int | None:
        row = self.one("SELECT id FROM roles WHERE account_id = ? AND name = ?", account_id, name)
        return row and row["id"]

    def list_roles(self, account_id: int) -> list[str]:
        return [r["name"] for r in self.all("SELECT name FROM roles WHERE account_id = ? ORDER BY id", account_id)]

    def assign(self, user_id: int, role_id: int) -> None:
        """A role of another account can't be assigned."""
        with self.tx() as db:
            if not db.execute("SELECT 1 FROM users u JOIN roles r ON r.account_id = u.account_id WHERE u.id = ? AND r.id = ?", (user_id, role_id)).fetchone():
                raise ValueError("the user and the role are not of one account")
            db.execute("INSERT OR IGNORE INTO user_roles VALUES (?, ?)", (user_id, role_id))

    def unassign(self, user_id: int, role_id: int) -> bool:
        with self.tx() as db:
            return db.execute("DELETE FROM user_roles WHERE user_id = ? AND role_id = ?", (user_id, role_id)).rowcount == 1

    def roles_of(self, user_id: int) -> list[str]:
        return [r["name"] for r in self.all("SELECT r.name FROM user_roles x JOIN roles r ON r.id = x.role_id WHERE x.user_id = ? ORDER BY r.name", user_id)]

    def grant(self, role_id: int, g: Grant) -> None:
        g.validate()
        with self.tx() as db:
            db.execute("INSERT OR IGNORE INTO grants VALUES (?, ?, ?, ?)", (role_id, g.privilege, g.on.kind, g.on.name))

    def revoke(self, role_id: int, g: Grant) -> bool:
        """This very grant; one that covers it stays."""
        with self.tx() as db:
            return db.execute("DELETE FROM grants WHERE role_id = ? AND privilege = ? AND kind = ? AND name = ?", (role_id, g.privilege, g.on.kind, g.on.name)).rowcount == 1

    def grants_of(self, role_id: int) -> list[Grant]:
        return sorted(Grant(r["privilege"], Object(r["kind"], r["name"])) for r in self.all("SELECT * FROM grants WHERE role_id = ?", role_id))

    def authorization(self, p: Principal) -> Authorization:
        rows = self.all("SELECT DISTINCT g.privilege, g.kind, g.name FROM user_roles x JOIN grants g ON g.role_id = x.role_id WHERE x.user_id = ?", p.user_id)
        return Authorization(p.user, tuple(sorted(Grant(r["privilege"], Object(r["kind"], r["name"])) for r in rows)))

    # warehouses
    def create_warehouse(self, account_id: int, name: str, size: int) -> Warehouse:
        if not re.fullmatch(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", name):
            raise ValueError(f"{name!r}: a warehouse is named with a-z, 0-9 and - and at most 63 signs")
        if size < 1:
            raise ValueError("a warehouse has a size of 1 at least")
        with self.tx() as db:
            db.execute("INSERT INTO warehouses (account_id, name, size, state) VALUES (?, ?, ?, 'running')", (account_id, name, size))
        return self.warehouse(account_id, name)

    def ensure_warehouse(self, account_id: int, name: str, size: int) -> Warehouse:
        with contextlib.suppress(sqlite3.IntegrityError):
            return self.create_warehouse(account_id, name, size)
        return self.warehouse(account_id, name)

    def warehouse(self, account_id: int, name: str) -> Warehouse | None:
        row = self.one("SELECT * FROM warehouses WHERE account_id = ? AND name = ?", account_id, name)
        return Warehouse(**dict(row)) if row else None

    def list_warehouses(self, account_id: int) -> list[Warehouse]:
        return [Warehouse(**dict(r)) for r in self.all("SELECT * FROM warehouses WHERE account_id = ? ORDER BY name", account_id)]

    def resize_warehouse(self, w: Warehouse, size: int) -> Warehouse:
        if size < 1:
            raise ValueError("a warehouse has a size of 1 at least")
        with self.tx() as db:
            db.execute("UPDATE warehouses SET size = ? WHERE id = ?", (size, w.id))
        return self.warehouse(w.account_id, w.name)

    def set_warehouse_state(self, w: Warehouse, state: str) -> Warehouse:
        """running -> suspended -> running; to set what already is, is an error."""
        before = {"suspended": "running", "running": "suspended"}[state]
        with self.tx() as db:
            if db.execute("UPDATE warehouses SET state = ? WHERE id = ? AND state = ?", (state, w.id, before)).rowcount != 1:
                raise ValueError(f"warehouse {w.name} is not {before}")
        return self.warehouse(w.account_id, w.name)

    def delete_warehouse(self, w: Warehouse) -> bool:
        with self.tx() as db:
            return db.execute("DELETE FROM warehouses WHERE id = ?", (w.id,)).rowcount == 1

    # history
    def submit(self, query_id: str, account_id: int, warehouse: str | None, sql: str, coordinator: str | None) -> None:
        with self.tx() as db:
            db.execute("INSERT INTO queries (id, account_id, warehouse, sql, state, submitted, coordinator) VALUES (?, ?, ?, ?, 'queued', ?, ?)", (query_id, account_id, warehouse, sql, self.now(), coordinator))

    def mark_running(self, query_id: str) -> bool:
        with self.tx() as db:
            return db.execute("UPDATE queries SET state = 'running', started = ? WHERE id = ? AND state = 'queued'", (self.now(), query_id)).rowcount == 1

    def finish(self, query_id: str, state: str, rows: int | None = None, error: str | None = None) -> bool:
        """An ended query stays as it ended."""
        with self.tx() as db:
            return db.execute("UPDATE queries SET state = ?, finished = ?, rows = ?, error = ? WHERE id = ? AND state IN ('queued', 'running')", (state, self.now(), rows, error[:MAX_ERROR] if error else None, query_id)).rowcount == 1

    def history(self, account_id: int, limit: int = 100, active: bool = False) -> list[dict]:
        more = "AND state IN ('queued', 'running') " if active else ""
        return [dict(r) for r in self.all(f"SELECT * FROM queries WHERE account_id = ? {more}ORDER BY submitted DESC, id LIMIT ?", account_id, limit)]

    def peak_concurrency(self, account_id: int) -> int:
        """The most queries that ran at one time; an end and a beginning at one moment don't overlap."""
        edges = []
        for r in self.all("SELECT started, finished FROM queries WHERE account_id = ? AND started IS NOT NULL", account_id):
            edges += [(r["started"], 1), (r["finished"] if r["finished"] is not None else float("inf"), -1)]
        now = most = 0
        for _, step in sorted(edges):
            now += step
            most = max(most, now)
        return most

    # leases
    def register(self, slot: str) -> str:
        """A new incarnation of the coordinator; the former one's lease is over."""
        incarnation = secrets.token_hex(16)
        with self.tx() as db:
            db.execute("INSERT INTO coordinators VALUES (?, ?, ?) ON CONFLICT (slot) DO UPDATE SET incarnation = excluded.incarnation, renewed = excluded.renewed", (slot, incarnation, self.now()))
        return incarnation

    def renew(self, slot: str, incarnation: str) -> bool:
        """False if another incarnation has taken the slot."""
        with self.tx() as db:
            return db.execute("UPDATE coordinators SET renewed = ? WHERE slot = ? AND incarnation = ?", (self.now(), slot, incarnation)).rowcount == 1

    def deregister(self, slot: str, incarnation: str) -> None:
        with self.tx() as db:
            db.execute("DELETE FROM coordinators WHERE slot = ? AND incarnation = ?", (slot, incarnation))

    def live(self) -> set[str]:
        return {r["incarnation"] for r in self.all("SELECT incarnation FROM coordinators WHERE renewed > ?", self.now() - RENEW_SECONDS * MISSED)}

    def reapable(self, limit: int = 500) -> list[dict]:
        live = sorted(self.live()) or [""]
        marks = ", ".join("?" * len(live))
        return [dict(r) for r in self.all(f"SELECT * FROM queries WHERE state IN ('queued', 'running') AND coordinator IS NOT NULL AND coordinator NOT IN ({marks}) ORDER BY submitted LIMIT ?", *live, limit)]

    def reap(self, limit: int = 500) -> int:
        """Close the rows of coordinators that are no more, and free their slots."""
        if not 1 <= limit <= 10_000:
            raise ValueError("the limit is from 1 to 10,000")
        n = sum(self.finish(q["id"], "failed", error=DIED if q["state"] == "running" else NEVER_STARTED) for q in self.reapable(limit))
        live = sorted(self.live()) or [""]
        with self.tx() as db:
            db.execute(f"DELETE FROM admission_slots WHERE holder NOT IN ({', '.join('?' * len(live))})", live)
        return n

    # slots of the whole fleet
    def claim_slot(self, w: Warehouse, slots: int, holder: str, query_id: str) -> int | None:
        with self.tx() as db:
            live = self.live() | {holder}
            taken = set()
            for r in db.execute("SELECT n, holder FROM admission_slots WHERE warehouse_id = ?", (w.id,)).fetchall():
                if r["holder"] in live:
                    taken.add(r["n"])
                else:
                    db.execute("DELETE FROM admission_slots WHERE warehouse_id = ? AND n = ?", (w.id, r["n"]))
            free = [n for n in range(slots) if n not in taken]
            if not free:
                return None
            db.execute("INSERT INTO admission_slots VALUES (?, ?, ?, ?)", (w.id, free[0], holder, query_id))
            return free[0]

    def release_slot(self, w: Warehouse, n: int, query_id: str) -> None:
        with self.tx() as db:
            db.execute("DELETE FROM admission_slots WHERE warehouse_id = ? AND n = ? AND query_id = ?", (w.id, n, query_id))


class Lease:
    """Renews a coordinator's lease on a thread; a failed renewal is tried again, a stolen slot is given up."""

    def __init__(self, services: Services, slot: str, every: float = RENEW_SECONDS):
        self.services, self.slot, self.every = services, slot, every
        self.incarnation = services.register(slot)
        self.lost, self._end = False, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self._end.wait(self.every):
            with contextlib.suppress(sqlite3.Error):
                if not self.services.renew(self.slot, self.incarnation):
                    self.lost = True
                    return

    def close(self) -> None:
        self._end.set()
        self.thread.join()
        self.services.deregister(self.slot, self.incarnation)
