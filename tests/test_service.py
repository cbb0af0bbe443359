import threading
import time

import pytest

from lakeloom.engine import Coordinator, NotRunning
from lakeloom.service.access import Authorization, Denied, Grant, Object, is_denial
from lakeloom.service.admission import Cancelled, QueueFull, Scheduler, ShuttingDown
from lakeloom.service.control import DIED, NEVER_STARTED, AuthError, Services
from lakeloom.sources.manifest import Manifest
from lakeloom.sources.storage import Storage

TOML = """
[[catalogs]]
name = "shop"
warehouse = "wh"
backend = { kind = "sql" }
[[catalogs.namespaces]]
name = "sales"
[[catalogs.namespaces.tables]]
name = "orders"
source = { type = "empty" }
schema = [ { name = "id", data_type = "int64" } ]
"""


@pytest.fixture
def db():
    return Services()


def member(db, account, name, *grants):
    user = db.create_user(account, name)
    role = db.create_role(account, f"{name}-role")
    db.assign(user, role)
    for g in grants:
        db.grant(role, g)
    return user, role, db.create_key(user)[1]


def test_containment():
    cat, ns, t, w = Object("catalog", "c"), Object("namespace", "c.n"), Object("table", "c.n.t"), Object("warehouse", "c")
    assert cat.covers(t) and ns.covers(t) and cat.covers(ns) and not t.covers(ns) and not cat.covers(w) and not w.covers(t)
    assert not Object("catalog", "c").covers(Object("table", "cc.n.t")) and Grant("ALL", cat).satisfies(Grant("DELETE", t))
    for bad in (Object("table", "a.b"), Object("warehouse", "a.b"), Object("catalog", " a"), Object("namespace", "a.")):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(Denied, match="SELECT on table a.b.c; UPDATE on table a.b.d") as e:
        Authorization("u", ()).check([Grant("SELECT", Object("table", "a.b.c")), Grant("UPDATE", Object("table", "a.b.d"))])
    assert is_denial(e.value)


def test_credentials(db):
    clock = [100.0]
    db.now = lambda: clock[0]
    a = db.create_account("acme")
    assert db.ensure_account("acme") == a and db.list_accounts() == ["acme"]
    user = db.create_user(a, "ann")
    key, token = db.create_key(user, 50)
    assert db.authenticate(token).user == "ann" and token.startswith("loom_") and db.list_keys(user)[0]["prefix"] == token[:12]
    for t, reason in ((None, "missing"), ("loom_nope", "invalid"), (token[:12] + "x", "invalid")):
        with pytest.raises(AuthError) as e:
            db.authenticate(t)
        assert e.value.reason == reason
    db.set_disabled(user, True)
    with pytest.raises(AuthError, match="disabled"):
        db.authenticate(token)
    db.set_disabled(user, False)
    clock[0] += 60
    with pytest.raises(AuthError, match="expired"):
        db.authenticate(token)
    assert db.revoke_key(key) and not db.revoke_key(key)
    with pytest.raises(AuthError, match="revoked"):
        db.authenticate(token)


def test_roles(db):
    a, b = db.create_account("a"), db.create_account("b")
    user, role, token = member(db, a, "ann", Grant("SELECT", Object("catalog", "c")))
    with pytest.raises(ValueError):
        db.assign(user, db.create_role(b, "r"))
    assert not db.revoke(role, Grant("SELECT", Object("table", "c.n.t")))
    p = db.authenticate(token)
    assert db.authorization(p).missing([Grant("SELECT", Object("table", "c.n.t"))]) == []
    assert db.unassign(user, role) and db.roles_of(user) == [] and db.authorization(p).grants == ()


def test_warehouses(db):
    a = db.create_account("a")
    w = db.create_warehouse(a, "etl-1", 2)
    assert db.ensure_warehouse(a, "etl-1", 9) == w and db.resize_warehouse(w, 5).size == 5
    w = db.set_warehouse_state(w, "suspended")
    with pytest.raises(ValueError):
        db.set_warehouse_state(w, "suspended")
    assert db.set_warehouse_state(w, "running").state == "running"
    for name, size in (("Bad", 1), ("a" * 64, 1), ("ok", 0)):
        with pytest.raises(ValueError):
            db.create_warehouse(a, name, size)
    assert db.delete_warehouse(w) and db.list_warehouses(a) == []


def test_leases_and_reaper(db):
    clock = [0.0]
    db.now = lambda: clock[0]
    a = db.create_account("a")
    one, two = db.register("s1"), db.register("s2")
    for q, who in (("q1", one), ("q2", one), ("q3", two)):
        db.submit(q, a, "w", "SELECT 1", who)
    db.mark_running("q2")
    clock[0] += 29
    assert db.renew("s2", two) and db.reapable() == []
    clock[0] += 2
    assert [q["id"] for q in db.reapable()] == ["q1", "q2"] and db.reap() == 2 and db.reap() == 0
    by = {q["id"]: q for q in db.history(a)}
    assert by["q1"]["error"] == NEVER_STARTED and by["q2"]["error"] == DIED and by["q3"]["state"] == "queued"
    assert db.register("s2") != two and not db.renew("s2", two)
    assert not db.finish("q1", "succeeded")


def test_peak_concurrency(db):
    a = db.create_account("a")
    for k, (s, f) in enumerate([(1, 4), (2, 3), (3, 5), (6, None)]):
        db.submit(str(k), a, "w", "x", None)
        with db.tx() as c:
            c.execute("UPDATE queries SET started = ?, finished = ? WHERE id = ?", (s, f, str(k)))
    assert db.peak_concurrency(a) == 2


def test_admission(db):
    w = db.create_warehouse(db.create_account("a"), "w", 1)
    s, never = Scheduler(db, db.register("s"), running=1, queued=1), threading.Event()
    entered, leave, stop = threading.Event(), threading.Event(), threading.Event()
    seen = []

    def hold():
        with s.slot(w, "q1", never):
            entered.set()
            leave.wait(10)

    def wait():
        try:
            with s.slot(w, "q2", stop):
                seen.append("in")
        except Cancelled:
            seen.append("cancelled")

    t1 = threading.Thread(target=hold)
    t1.start()
    entered.wait(10)
    t2 = threading.Thread(target=wait)
    t2.start()
    while s.snapshot()["queued"] < 1:
        time.sleep(0.01)
    with pytest.raises(QueueFull), s.slot(w, "q3", never):
        pass
    stop.set()
    t2.join(10)
    assert seen == ["cancelled"] and s.snapshot()["running"] == 1
    leave.set()
    t1.join(10)
    with s.slot(w, "q4", never):
        pass
    s.close()
    with pytest.raises(ShuttingDown), s.slot(w, "q5", never):
        pass
    assert s.snapshot() == {"admitted": 2, "refused": 1, "released": 2, "running": 0, "queued": 0}


def test_coordinator(spark, tmp_path):
    db = Services()
    a, b = db.create_account("a"), db.create_account("b")
    use = Grant("USAGE", Object("warehouse", "w"))
    user, role, token = member(db, a, "ann", use, Grant("ALL", Object("catalog", "shop")))
    _, _, other = member(db, b, "bob", use, Grant("ALL", Object("catalog", "shop")), Grant("CANCEL", Object("warehouse", "w")))
    db.create_warehouse(a, "w", 1)
    db.create_warehouse(b, "w", 1)
    c = Coordinator(spark, Storage(root=str(tmp_path)), Manifest.from_toml(TOML), db)
    try:
        assert c.submit(token, "w", "INSERT INTO shop.sales.orders VALUES (1), (2)").to_pylist()[0]["rows_changed"] == 2
        assert c.submit(token, "w", "SELECT count(*) AS n FROM shop.sales.orders").to_pylist() == [{"n": 2}]
        assert c.submit(other, "w", "SELECT count(*) AS n FROM shop.sales.orders").to_pylist() == [{"n": 0}]
        assert c.submit(token, "w", "DELETE FROM shop.sales.orders WHERE id = 1").to_pylist()[0]["rows_changed"] == 1
        with pytest.raises(Denied):
            c.submit(token, "unknown", "SELECT 1")
        db.revoke(role, Grant("ALL", Object("catalog", "shop")))
        with pytest.raises(Denied):
            c.submit(token, "w", "SELECT count(*) AS n FROM shop.sales.orders")
        states = [q["state"] for q in db.history(a)]
        assert sorted(states) == ["failed", "succeeded", "succeeded", "succeeded"]
        db.grant(role, Grant("CANCEL", Object("warehouse", "w")))
        started, got = threading.Event(), []

        def run():
            try:
                c.submit(token, "w", "SELECT sum(id % 7) AS s FROM range(0, 10000000000000, 1, 4)", "slow", started.set)
            except Cancelled:
                got.append("cancelled")

        t = threading.Thread(target=run)
        t.start()
        assert started.wait(20)
        with pytest.raises(NotRunning):
            c.cancel(other, "slow")
        deadline = time.time() + 60
        while t.is_alive() and time.time() < deadline:  # the job may not have begun at the first call
            try:
                c.cancel(token, "slow")
            except NotRunning:
                break
            t.join(0.5)
        t.join(30)
        assert got == ["cancelled"] and db.history(a, 1)[0]["state"] == "cancelled" and c.scheduler.snapshot()["running"] == 0
    finally:
        c.close()
