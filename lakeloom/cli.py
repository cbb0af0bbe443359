"""python -m lakeloom.cli run|migrate|account|warehouse|auth|history|reap"""

from __future__ import annotations

import argparse
import sys

from .service.access import Grant, Object
from .service.control import Services


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeloom")
    p.add_argument("--services", default="lakeloom-services.db", help="path of the services database")
    sub = p.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run", help="one statement over a manifest's tables")
    run.add_argument("sql")
    run.add_argument("--manifest", required=True)
    run.add_argument("--root", default=".")
    run.add_argument("--master")
    run.add_argument("--token", help="run as the key's user, through the query service")
    run.add_argument("--warehouse")
    run.add_argument("--explain", action="store_true")
    sub.add_parser("migrate")
    account = sub.add_parser("account")
    account.add_argument("action", choices=("create", "list"))
    account.add_argument("name", nargs="?")
    w = sub.add_parser("warehouse")
    w.add_argument("action", choices=("create", "list", "resize", "suspend", "resume", "delete"))
    w.add_argument("account")
    w.add_argument("name", nargs="?")
    w.add_argument("--size", type=int, default=1)
    a = sub.add_parser("auth")
    a.add_argument("action", choices=("user", "key", "revoke-key", "disable", "enable", "role", "assign", "unassign", "grant", "revoke", "grants"))
    a.add_argument("account")
    a.add_argument("args", nargs="*", help="user: NAME; key: USER [SECONDS]; revoke-key: ID; role: NAME; assign: USER ROLE; grant: ROLE PRIVILEGE KIND NAME")
    h = sub.add_parser("history")
    h.add_argument("account")
    h.add_argument("--active", action="store_true")
    r = sub.add_parser("reap")
    r.add_argument("--limit", type=int, default=500)
    r.add_argument("--dry-run", action="store_true")
    return p


def _run(o: argparse.Namespace, services: Services) -> None:
    from . import engine
    from .session import build_session
    from .sources.catalog import apply_manifest
    from .sources.manifest import Manifest
    from .sources.storage import Storage

    spark, storage, manifest = build_session(master=o.master), Storage(root=o.root), Manifest.from_path(o.manifest)
    if o.token:
        if not o.warehouse:
            raise SystemExit("--token needs --warehouse")
        coordinator = engine.Coordinator(spark, storage, manifest, services)
        try:
            print(coordinator.submit(o.token, o.warehouse, o.sql).to_pandas().to_string(index=False))
        finally:
            coordinator.close()
        return
    catalogs = apply_manifest(spark, storage, manifest)
    if o.explain:
        engine.query(spark, catalogs, o.sql).explain("formatted")
    else:
        print(engine.execute(spark, catalogs, o.sql).to_pandas().to_string(index=False))


def _need(value, what: str):
    if value is None:
        raise SystemExit(f"there is no {what}")
    return value


def _auth(o: argparse.Namespace, s: Services) -> None:
    account = _need(s.account(o.account), f"account {o.account}")
    user = lambda n: _need(s.user(account, n), f"user {n}")
    role = lambda n: _need(s.role(account, n), f"role {n}")
    match o.action, o.args:
        case "user", [name]:
            print(s.create_user(account, name))
        case "key", [name, *rest]:
            print(*s.create_key(user(name), float(rest[0]) if rest else None))
        case "revoke-key", [key]:
            print(s.revoke_key(int(key)))
        case ("disable" | "enable") as to, [name]:
            s.set_disabled(user(name), to == "disable")
        case "role", [name]:
            print(s.create_role(account, name))
        case "assign", [name, r]:
            s.assign(user(name), role(r))
        case "unassign", [name, r]:
            print(s.unassign(user(name), role(r)))
        case ("grant" | "revoke") as to, [r, privilege, kind, name]:
            getattr(s, to)(role(r), Grant(privilege.upper(), Object(kind, name)).validate())
        case "grants", [r]:
            print(*s.grants_of(role(r)), sep="\n")
        case _:
            raise SystemExit(f"auth {o.action}: the arguments don't fit")


def _warehouse(o: argparse.Namespace, s: Services) -> None:
    account = _need(s.account(o.account), f"account {o.account}")
    if o.action == "list":
        print(*(f"{w.name} {w.size} {w.state}" for w in s.list_warehouses(account)), sep="\n")
        return
    if o.action == "create":
        print(s.create_warehouse(account, o.name, o.size).id)
        return
    w = _need(s.warehouse(account, o.name), f"warehouse {o.name}")
    match o.action:
        case "resize":
            s.resize_warehouse(w, o.size)
        case "suspend":
            s.set_warehouse_state(w, "suspended")
        case "resume":
            s.set_warehouse_state(w, "running")
        case "delete":
            s.delete_warehouse(w)


def main(argv: list[str] | None = None) -> int:
    o = _parser().parse_args(argv)
    s = Services(o.services)
    match o.what:
        case "run":
            _run(o, s)
        case "migrate":
            print(s.migrate())
        case "account":
            print(s.create_account(o.name) if o.action == "create" else "\n".join(s.list_accounts()))
        case "warehouse":
            _warehouse(o, s)
        case "auth":
            _auth(o, s)
        case "history":
            for q in s.history(_need(s.account(o.account), f"account {o.account}"), active=o.active):
                print(q["id"], q["state"], q["rows"], q["sql"][:80])
        case "reap":
            print(len(s.reapable(o.limit)) if o.dry_run else s.reap(o.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
