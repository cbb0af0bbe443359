import threading

import pytest

from lakeloom.engine import execute, query
from lakeloom.operators import dml
from lakeloom.plans.resolve import Refused, normalized, parse, scanned_data_files
from lakeloom.plans.result_cache import ResultCache, decode, encode
from lakeloom.service.access import Authorization, Denied, Grant, Object, required
from lakeloom.service.control import Services
from lakeloom.sources.catalog import Scope, apply_manifest
from lakeloom.sources.manifest import Manifest, ManifestError, data_type, tpch_manifest
from lakeloom.sources.storage import Storage
from lakeloom.sources.versioned import CommitConflict, NoSuchTable

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
schema = [ { name = "id", data_type = "int64", nullable = false }, { name = "label", data_type = "string" }, { name = "qty", data_type = "bigint" } ]
[[catalogs.namespaces.tables]]
name = "customers"
format = "listing"
source = { type = "parquet", path = "customers.parquet" }
[[catalogs.namespaces.tables]]
name = "seeded"
source = { type = "parquet", path = "customers.parquet" }
"""


@pytest.fixture
def shop(spark, tmp_path):
    spark.createDataFrame([(1, "ada"), (2, "grace")], "id bigint, name string").write.parquet(str(tmp_path / "customers.parquet"))
    cats = apply_manifest(spark, Storage(root=str(tmp_path)), Manifest.from_toml(TOML))
    execute(spark, cats, "INSERT INTO shop.sales.orders VALUES (1,'a',10),(2,'b',20),(3,NULL,30),(4,'d',40),(5,'e',NULL)")
    return cats


def rows(spark, cats, sql):
    return sorted(map(tuple, query(spark, cats, sql).collect()), key=str)


def test_delete_and_update(spark, shop):
    t = shop.lakehouse("shop").table("sales", "orders")
    o = dml.execute(spark, shop, "DELETE FROM shop.sales.orders WHERE id = 2")
    assert o.rows_changed == 1 and o.committed and t.snapshot().summary["total-records"] == "4"
    o = dml.execute(spark, shop, "DELETE FROM shop.sales.orders WHERE label = 'zzz'")
    assert o.rows_changed == 0 and not o.committed and t.current_snapshot_id() == o.base_snapshot_id
    o = dml.execute(spark, shop, "UPDATE shop.sales.orders SET label='x', qty=qty+100 WHERE id >= 4")
    assert o.rows_changed == 2 and t.snapshot().operation == "overwrite"
    assert rows(spark, shop, "SELECT * FROM shop.sales.orders") == [(1, "a", 10), (3, None, 30), (4, "x", 140), (5, "x", None)]
    assert dml.execute(spark, shop, "UPDATE shop.sales.orders SET id = id*10").rows_changed == 4
    assert [r[0] for r in rows(spark, shop, "SELECT id FROM shop.sales.orders")] == [10, 30, 40, 50]
    assert dml.execute(spark, shop, "DELETE FROM shop.sales.orders").rows_changed == 4
    assert t.snapshot().operation == "delete" and rows(spark, shop, "SELECT * FROM shop.sales.orders") == []
    execute(spark, shop, "INSERT INTO shop.sales.orders VALUES (99, 'back', 1)")
    assert rows(spark, shop, "SELECT * FROM shop.sales.orders") == [(99, "back", 1)]


def test_right_hand_sides_read_the_row_as_it_was(spark, shop):
    dml.execute(spark, shop, "UPDATE shop.sales.orders SET id = qty, qty = id WHERE label IN (SELECT lower('A'))")
    assert (10, "a", 1) in rows(spark, shop, "SELECT * FROM shop.sales.orders")
    dml.execute(spark, shop, "DELETE FROM shop.sales.orders WHERE id IN (SELECT id FROM shop.sales.seeded) OR qty > 35")
    assert [r[0] for r in rows(spark, shop, "SELECT id FROM shop.sales.orders")] == [10, 3, 5]


def test_inserts(spark, shop):
    execute(spark, shop, "INSERT INTO shop.sales.orders (qty, id) SELECT id, id + 100 FROM customers")
    execute(spark, shop, "INSERT INTO shop.sales.orders WITH c AS (SELECT 7 AS id) SELECT id, 'w', 1 FROM c")
    got = rows(spark, shop, "SELECT * FROM shop.sales.orders o WHERE o.id > 5")
    assert got == [(101, None, 1), (102, None, 2), (7, "w", 1)]
    before = shop.lakehouse("shop").table("sales", "orders").current_snapshot_id()
    with pytest.raises(Exception, match="can't be null"):
        execute(spark, shop, "INSERT INTO shop.sales.orders SELECT NULL, 'n', id FROM customers")
    execute(spark, shop, "INSERT INTO shop.sales.orders SELECT id, name, id FROM customers WHERE id > 9")
    assert shop.lakehouse("shop").table("sales", "orders").current_snapshot_id() == before


def test_refusals(spark, shop):
    for sql in (
        "DELETE FROM shop.sales.orders AS o WHERE o.id = 1",
        "UPDATE shop.sales.orders SET shop.sales.orders.id = 1",
        "UPDATE shop.sales.orders SET id = 1, id = 2",
        "UPDATE shop.sales.orders SET nope = 1",
        "MERGE INTO shop.sales.orders t USING customers s ON t.id = s.id WHEN MATCHED THEN DELETE",
        "INSERT OVERWRITE shop.sales.orders SELECT 1, 'a', 1",
        "DELETE FROM orders",
    ):
        with pytest.raises(Refused):
            dml.execute(spark, shop, sql)
    with pytest.raises(dml.WrongCatalog):
        dml.execute(spark, shop, "DELETE FROM shop.sales.orders", catalog="other")
    for sql in ("SELECT * FROM parquet.`/etc`", "DROP TABLE customers", "EXPLAIN SELECT 1", "CREATE TABLE x AS SELECT 1", "COPY (SELECT 1) TO 'x'", "SET a=b"):
        with pytest.raises(Refused):
            execute(spark, shop, sql)
    with pytest.raises(NoSuchTable):
        query(spark, shop, "SELECT * FROM shop.sales.nothing")


def test_reads_are_pinned(spark, shop):
    df = query(spark, shop, "SELECT count(*) AS n FROM shop.sales.orders")
    plain = query(spark, shop, "SELECT id FROM shop.sales.orders")
    files = scanned_data_files(plain)
    execute(spark, shop, "INSERT INTO shop.sales.orders VALUES (6, 'f', 1)")
    assert df.collect()[0][0] == 5 and plain.count() == 5 and len(files) >= 1
    assert query(spark, shop, "SELECT id FROM shop.sales.orders").count() == 6
    plan = query(spark, shop, "SELECT label FROM shop.sales.orders WHERE id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "qty" not in plan


def test_names_everywhere(spark, shop):
    sql = "WITH q AS (SELECT * FROM shop.sales.orders) SELECT q.id, customers.name FROM q JOIN customers ON q.id = customers.id WHERE q.id IN (SELECT id FROM shop.sales.seeded) AND EXISTS (SELECT 1 FROM shop.sales.orders o WHERE o.id = q.id)"
    assert rows(spark, shop, sql) == [(1, "ada"), (2, "grace")]
    assert [str(g.on) for g in required(parse(spark, sql))] == ["table main.public.customers", "table shop.sales.orders", "table shop.sales.seeded"]
    assert rows(spark, shop, "SELECT orders.id FROM shop.sales.orders WHERE orders.id = (SELECT max(id) FROM customers)") == [(2,)]


def test_concurrent_updates_all_land(spark, shop):
    errors = []

    def work():
        try:
            for _ in range(20):  # five attempts a statement; the statement is repeated until it lands
                try:
                    dml.execute(spark, shop, "UPDATE shop.sales.orders SET qty = coalesce(qty, 0) + 1 WHERE id = 1")
                    return
                except CommitConflict:
                    continue
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and rows(spark, shop, "SELECT qty FROM shop.sales.orders WHERE id = 1") == [(14,)]


def test_a_loser_plans_again(spark, shop):
    once = []

    def rival():
        if not once:
            once.append(1)
            execute(spark, shop, "INSERT INTO shop.sales.orders VALUES (8, 'late', 1)")

    o = dml.execute(spark, shop, "UPDATE shop.sales.orders SET qty = 0", before_commit=rival)
    assert o.attempts == 2 and o.rows_changed == 6
    assert {r[0] for r in rows(spark, shop, "SELECT qty FROM shop.sales.orders")} == {0}


def test_manifest(spark, tmp_path):
    m = Manifest.from_toml(TOML)
    assert [t.name for t in m.catalogs[0].namespaces[0].tables] == ["orders", "customers", "seeded"]
    assert data_type(" Decimal(15,2) ").simpleString() == "decimal(15,2)"
    for old, new in (("name = \"seeded\"", "name = \"orders\""), ("warehouse = \"wh\"\n", ""), ("source = { type = \"empty\" }\nschema", "source = { type = \"empty\" }\nother"), ("kind = \"sql\"", "kind = \"sql\", uri = \" \""), ("data_type = \"string\"", "data_type = \"varbit\"")):
        with pytest.raises(ManifestError):
            Manifest.from_toml(TOML.replace(old, new))
    assert len(tpch_manifest("c", "n", "x").catalogs[0].namespaces[0].tables) == 7
    assert Scope(3).catalog("shop") == "acct_3__shop" and Scope(3).warehouse("/w/") == "/w/acct_3"


def test_applying_twice_seeds_once(spark, shop, tmp_path):
    again = apply_manifest(spark, Storage(root=str(tmp_path)), Manifest.from_toml(TOML))
    assert rows(spark, again, "SELECT * FROM shop.sales.seeded") == [(1, "ada"), (2, "grace")]
    other = apply_manifest(spark, Storage(root=str(tmp_path)), Manifest.from_toml(TOML), Scope(7))
    assert rows(spark, other, "SELECT * FROM shop.sales.orders") == []


def test_result_cache(spark, shop):
    clock = [1000.0]
    cache = ResultCache(Services(now=lambda: clock[0]))
    ask = lambda sql, auth=None: execute(spark, shop, sql, auth, cache).to_pylist()
    a = ask("SELECT count(*) AS n FROM shop.sales.orders")
    assert ask("select COUNT(*)  as n from shop.sales.orders;") == a and cache.counts["hit"] == 1 and cache.counts["execution"] == 1
    execute(spark, shop, "INSERT INTO shop.sales.orders VALUES (6, 'f', 1)")
    assert ask("SELECT count(*) AS n FROM shop.sales.orders") == [{"n": 6}] and cache.counts["execution"] == 2
    clock[0] += 25 * 3600
    ask("SELECT count(*) AS n FROM shop.sales.orders")
    assert cache.counts["execution"] == 3
    for sql in ("SELECT rand() AS r FROM shop.sales.orders", "SELECT now() AS t FROM shop.sales.orders", "SELECT * FROM customers"):
        before = cache.counts["store"]
        ask(sql)
        assert cache.counts["store"] == before
    with pytest.raises(Denied):
        ask("SELECT count(*) AS n FROM shop.sales.orders", Authorization("eve", ()))
    may = Authorization("ann", (Grant("SELECT", Object("namespace", "shop.sales")),))
    assert ask("SELECT count(*) AS n FROM shop.sales.orders", may) == [{"n": 6}]
    t = execute(spark, shop, "SELECT * FROM shop.sales.orders WHERE id < 0")
    assert decode(encode(t)).schema == t.schema
    assert normalized("SELECT  'A b' , X FROM T -- c\n") == "select 'A b' , x from t"


def test_access_control_refuses_what_it_does_not_know(spark, shop):
    nobody, reader = Authorization("nobody", ()), Authorization("reader", (Grant("ALL", Object("catalog", "shop")),))
    for sql in (
        "SELECT TRANSFORM(x) USING 'id -un' AS (y STRING) FROM VALUES (1) AS t(x)",
        "SELECT reflect('java.lang.System', 'getProperty', 'java.version')",
        "SELECT java_method('java.lang.System', 'getProperty', 'java.version')",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'java.version')",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'java.version')",
        "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'java.version')",
        "WITH c AS (SELECT reflect('a', 'b') AS x) SELECT * FROM c",
        "SELECT 1 WHERE 'x' IN (SELECT reflect('a', 'b'))",
        "SELECT filter(array(1), x -> reflect('a', 'b') = 'c')",
        "SELECT IDENTIFIER('reflect')('a', 'b')",
        "SELECT * FROM collations()",
        "SELECT * FROM IDENTIFIER('shop.sales.orders')",
        "SELECT some_udf(1)",
        "SELECT input_file_name() FROM shop.sales.orders",
        "DELETE FROM shop.sales.orders WHERE label = reflect('a', 'b')",
        "INSERT INTO shop.sales.orders SELECT TRANSFORM(x) USING 'id' AS (a STRING, b STRING, c STRING) FROM VALUES (1) AS t(x)",
    ):
        for who in (nobody, reader):
            with pytest.raises((Denied, Refused)):
                execute(spark, shop, sql, who)
    assert execute(spark, shop, "SELECT upper('a') AS a, count(*) FILTER (WHERE x > 1) AS n FROM VALUES (1), (2) AS t(x)", nobody).to_pylist() == [{"a": "A", "n": 1}]
    got = execute(spark, shop, "SELECT o.id, e.i FROM shop.sales.orders o LATERAL VIEW explode(sequence(1, 2)) e AS i WHERE o.id = 1", reader)
    assert got.num_rows == 2


def test_names_with_dots_are_refused(spark, shop):
    space = Authorization("ann", (Grant("SELECT", Object("namespace", "shop.sales")),))
    for sql in ("SELECT * FROM shop.`sales.secret`.pay", "SELECT * FROM `shop.sales`.x.orders", "SELECT * FROM `a.b`", "DELETE FROM shop.`sales.secret`.pay"):
        with pytest.raises((Denied, Refused)):
            execute(spark, shop, sql, space)
    with pytest.raises(ValueError):
        shop.lakehouse("shop").ensure_namespace("sales.secret")
    assert not Object("namespace", "shop.sales").covers(Object("table", "shop.sales.secret.pay"))
    assert execute(spark, shop, "SELECT id FROM shop.sales.orders", space).num_rows == 5


def test_every_catalogue_query_passes_the_allow_lists(spark):
    from lakeloom.plans import catalogue

    for sql in catalogue.SPARK.values():
        required(parse(spark, sql))


def test_comments_in_writes(spark, shop):
    assert dml.execute(spark, shop, "DELETE FROM shop.sales.orders WHERE id = 2 -- just this one").rows_changed == 1
    assert dml.execute(spark, shop, "UPDATE shop.sales.orders SET /* the */ label = 'x' -- why\n, qty = 1 -- and this").rows_changed == 4
    assert dml.execute(spark, shop, "UPDATE shop.sales.orders SET label = 'y' -- why\n WHERE id = 1 /* one */").rows_changed == 1
    assert rows(spark, shop, "SELECT * FROM shop.sales.orders WHERE id < 4") == [(1, "y", 1), (3, "x", 1)]
