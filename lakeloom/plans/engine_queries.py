"""Queries that go through the engine: parse, authorize, pin, look up, run, store, commit. Each makes tables of its own, and has DuckDB SQL for what must come out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .. import engine
from ..operators import dml
from ..service.access import Authorization, Denied, Grant, Object, required
from ..service.control import Services
from ..sources.catalog import Catalogs, Scope, apply_manifest
from ..sources.manifest import Manifest, tpch_manifest
from ..sources.storage import Storage, scratch_root
from .resolve import Refused, file_scan_count, normalized, parse, scanned_data_files
from .result_cache import ResultCache, decode, encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DUCK: dict[str, str] = {}

MANIFEST = """
[[catalogs]]
name = "mart"
warehouse = "{wh}"
backend = {{ kind = "sql" }}
[[catalogs.namespaces]]
name = "live"
[[catalogs.namespaces.tables]]
name = "orders"
source = {{ type = "parquet", path = "{data}/orders.parquet" }}
[[catalogs.namespaces.tables]]
name = "nation"
source = {{ type = "parquet", path = "{data}/nation.parquet" }}
[[catalogs.namespaces.tables]]
name = "bare"
source = {{ type = "empty" }}
schema = [ {{ name = "k", data_type = "int64", nullable = false }}, {{ name = "label", data_type = "string" }}, {{ name = "qty", data_type = "int64" }} ]
[[catalogs.namespaces.tables]]
name = "customer"
format = "listing"
source = {{ type = "parquet", path = "{data}/customer.parquet" }}
"""


def tables(spark: SparkSession, sf_dir: str) -> Catalogs:
    """A fresh warehouse in the shared folder: versioned orders, nation and bare, and customer as it lies."""
    wh = f"{scratch_root(spark)}/mart-{uuid.uuid4().hex}"
    return apply_manifest(spark, Storage(root="/"), Manifest.from_toml(MANIFEST.format(wh=wh, data=sf_dir.rstrip("/"))))


def registered(duck: str) -> Callable:
    def add(f: Callable[[SparkSession, Catalogs], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, tables(spark, sf_dir))
        DUCK[f.__name__] = duck
        return f

    return add


def facts(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@registered("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def engine_listing_scan(spark: SparkSession, cats: Catalogs) -> DataFrame:
    return engine.query(spark, cats, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")


@registered("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(max(o_orderkey) AS BIGINT) AS hi FROM orders GROUP BY o_orderstatus")
def engine_versioned_scan(spark: SparkSession, cats: Catalogs) -> DataFrame:
    return engine.query(spark, cats, "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS hi FROM mart.live.orders GROUP BY o_orderstatus")


@registered("SELECT o_orderkey, o_custkey FROM orders")
def engine_pinned_scan(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """What was planned before a write doesn't see it."""
    df = engine.query(spark, cats, "SELECT o_orderkey, o_custkey FROM mart.live.orders")
    engine.execute(spark, cats, "DELETE FROM mart.live.orders WHERE o_orderkey > 10")
    engine.execute(spark, cats, "INSERT INTO mart.live.nation SELECT 77, 'LATE', 1")
    return df


@registered("SELECT n_nationkey, n_name FROM nation")
def engine_snapshot_by_id(spark: SparkSession, cats: Catalogs) -> DataFrame:
    t = cats.lakehouse("mart").table("live", "nation")
    old = t.current_snapshot_id()
    engine.execute(spark, cats, "UPDATE mart.live.nation SET n_name = lower(n_name)")
    return t.read(t.snapshot_of(old)).select("n_nationkey", "n_name")


@registered("SELECT CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS qty WHERE 1 = 0")
def engine_empty_table(spark: SparkSession, cats: Catalogs) -> DataFrame:
    return engine.query(spark, cats, "SELECT * FROM mart.live.bare")


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', 4 UNION ALL SELECT 98, NULL, 3 UNION ALL SELECT n_nationkey + 200, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def engine_insert(spark: SparkSession, cats: Catalogs) -> DataFrame:
    engine.execute(spark, cats, "INSERT INTO mart.live.nation VALUES (99, 'NOWHERE', 4)")
    engine.execute(spark, cats, "INSERT INTO mart.live.nation (n_regionkey, n_nationkey) VALUES (3, 98)")
    engine.execute(spark, cats, "INSERT INTO mart.live.nation SELECT n_nationkey + 200, n_name, n_regionkey FROM mart.live.nation WHERE n_regionkey = 1 AND n_nationkey < 90")
    return engine.query(spark, cats, "SELECT n_nationkey, n_name, n_regionkey FROM mart.live.nation")


@registered("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def engine_delete(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """Rows whose predicate is null stay."""
    engine.execute(spark, cats, "DELETE FROM mart.live.orders WHERE nullif(o_orderstatus, 'P') = 'F' -- done ones")
    return engine.query(spark, cats, "SELECT o_orderkey, o_orderstatus FROM mart.live.orders")


@registered("SELECT o_orderkey * 10 AS o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def engine_update_with_subqueries(spark: SparkSession, cats: Catalogs) -> DataFrame:
    engine.execute(spark, cats, "DELETE FROM mart.live.orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
    engine.execute(spark, cats, "UPDATE mart.live.orders SET o_orderstatus = 'BIG' WHERE o_totalprice > 200000")
    engine.execute(spark, cats, "UPDATE mart.live.orders SET o_orderkey = o_orderkey * 10")
    return engine.query(spark, cats, "SELECT o_orderkey, o_orderstatus FROM mart.live.orders")


@registered("SELECT * FROM (VALUES (1, 'insert', 5, true, 5), (2, 'delete', 1, true, 4), (3, 'delete', 0, false, 4), (4, 'update', 2, true, 4), (5, 'update', 4, true, 4), (6, 'delete', 4, true, 0), (7, 'insert', 1, true, 1)) AS t(step, kind, rows_changed, committed, total)")
def engine_dml_outcomes(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """Match counts, snapshots made or not, and the records that the snapshot's summary tells."""
    steps = ["INSERT INTO mart.live.bare VALUES (1,'a',10),(2,'b',20),(3,NULL,30),(4,'d',40),(5,'e',NULL)", "DELETE FROM mart.live.bare WHERE k = 2", "DELETE FROM mart.live.bare WHERE label = 'zzz'", "UPDATE mart.live.bare SET label = 'x', qty = qty + 100 WHERE k >= 4", "UPDATE mart.live.bare SET k = k * 10", "DELETE FROM mart.live.bare", "INSERT INTO mart.live.bare VALUES (99, 'back', 1)"]
    out = []
    for k, sql in enumerate(steps, 1):
        o = dml.execute(spark, cats, sql)
        out.append((k, o.kind, o.rows_changed, o.committed, int(cats.lakehouse("mart").snapshot_summary("live", "bare")["total-records"])))
    return facts(spark, out, "step int, kind string, rows_changed int, committed boolean, total int")


@registered("SELECT CAST(2 AS INTEGER) AS attempts, CAST(count(*) + 1 AS BIGINT) AS rows_changed, CAST(count(*) + 1 AS BIGINT) AS n FROM nation")
def engine_conflict_retry(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """A writer that loses the race plans again on the winner's snapshot."""
    rivals = iter([lambda: engine.execute(spark, cats, "INSERT INTO mart.live.nation VALUES (50, 'RIVAL', 0)")])
    o = dml.execute(spark, cats, "UPDATE mart.live.nation SET n_regionkey = 9", before_commit=lambda: next(rivals, lambda: None)())
    n = engine.query(spark, cats, "SELECT count(*) FROM mart.live.nation WHERE n_regionkey = 9").collect()[0][0]
    return facts(spark, [(o.attempts, o.rows_changed, n)], "attempts int, rows_changed bigint, n bigint")


@registered("SELECT * FROM (VALUES ('execution', 2), ('hit', 2), ('error', 0)) AS t(what, n)")
def engine_result_cache(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """A repeat is a hit, whatever its case and spacing; a write makes the next one run again."""
    cache = ResultCache(Services())
    for sql in ("SELECT count(*) AS n FROM mart.live.nation", "select COUNT(*)  AS n from mart.live.nation;", "INSERT INTO mart.live.nation VALUES (60, 'X', 1)", "SELECT count(*) AS n FROM mart.live.nation", "SELECT count(*) AS n FROM mart.live.nation"):
        engine.execute(spark, cats, sql, cache=cache)
    return facts(spark, [(k, cache.counts[k]) for k in ("execution", "hit", "error")], "what string, n int")


@registered("SELECT 'append' AS operation, CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS added FROM orders")
def engine_snapshot_summary(spark: SparkSession, cats: Catalogs) -> DataFrame:
    s = cats.lakehouse("mart").snapshot_summary("live", "orders")
    return facts(spark, [(s["operation"], int(s["total-records"]), int(s["added-records"]))], "operation string, total bigint, added bigint")


@registered("SELECT * FROM (VALUES (2, 1, 3)) AS t(folders, scans, versions)")
def engine_files_read(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """Folders of files that a pinned scan reads, one for each write; scans in the plan; records in the log."""
    engine.execute(spark, cats, "INSERT INTO mart.live.nation VALUES (60, 'X', 1)")
    df = engine.query(spark, cats, "SELECT n_name FROM mart.live.nation")
    folders = {f.rsplit("/", 1)[0] for f in scanned_data_files(df)}
    return facts(spark, [(len(folders), file_scan_count(df), len(cats.lakehouse("mart").table("live", "nation").versions()))], "folders int, scans int, versions int")


@registered("SELECT n_nationkey, n_name FROM nation")
def engine_arrow_codec(spark: SparkSession, cats: Catalogs) -> DataFrame:
    got = engine.execute(spark, cats, "SELECT n_nationkey, n_name FROM mart.live.nation")
    return spark.createDataFrame(decode(encode(got)))


@registered("SELECT c_custkey, n_name, x.w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (VALUES (0, 'a'), (1, 'b')) AS x(r, w) ON n_regionkey = x.r WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def engine_join_all_kinds_of_tables(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """A listing, two versioned tables, a frame of the program, a common table expression and a subquery."""
    cats.register_frame("words", spark.createDataFrame([(0, "a"), (1, "b")], "r int, w string"))
    return engine.query(spark, cats, "WITH n AS (SELECT * FROM mart.live.nation) SELECT c_custkey, n_name, words.w FROM customer JOIN n ON c_nationkey = n_nationkey JOIN words ON n_regionkey = words.r WHERE c_custkey IN (SELECT o_custkey FROM mart.live.orders)")


@registered("SELECT r_name AS w, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) > 9")
def engine_memory_table_empty_result(spark: SparkSession, cats: Catalogs) -> DataFrame:
    cats.register_frame("words", spark.createDataFrame([(0, "a"), (1, "b")], "r int, w string"))
    return engine.query(spark, cats, "SELECT w, count(*) AS n FROM words JOIN mart.live.nation ON r = n_regionkey GROUP BY w HAVING count(*) > 9")


STATEMENTS = ["DELETE FROM mart.live.nation AS n WHERE n.n_nationkey = 1", "UPDATE mart.live.nation SET n_name = 'a', n_name = 'b'", "UPDATE mart.live.nation SET nope = 1", "MERGE INTO mart.live.nation t USING customer s ON t.n_nationkey = s.c_nationkey WHEN MATCHED THEN DELETE", "INSERT OVERWRITE mart.live.nation SELECT 1, 'a', 1", "DELETE FROM customer", "SELECT * FROM parquet.`/etc`", "DROP TABLE customer", "SELECT * FROM IDENTIFIER('mart.live.nation')", "INSERT INTO mart.live.bare VALUES (1)", "SELECT * FROM mart.`live.x`.nation"]


@registered(f"SELECT CAST(i AS INTEGER) AS i, true AS refused FROM range({len(STATEMENTS)}) t(i)")
def engine_refusals(spark: SparkSession, cats: Catalogs) -> DataFrame:
    out = []
    for i, sql in enumerate(STATEMENTS):
        try:
            engine.execute(spark, cats, sql)
            out.append((i, False))
        except (Refused, ValueError, PySparkException):
            out.append((i, True))
    return facts(spark, out, "i int, refused boolean")


@registered("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, true), (4, false), (5, false), (6, false), (7, true)) AS t(i, allowed)")
def engine_privileges(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """Tables in subqueries and expressions count; so does the written one; what isn't known is refused."""
    may = Authorization("ann", (Grant("SELECT", Object("namespace", "mart.live")), Grant("DELETE", Object("table", "mart.live.nation"))))
    asked = ["SELECT n_name FROM mart.live.nation", "SELECT n_name FROM mart.live.nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)", "INSERT INTO mart.live.nation VALUES (1, 'a', 1)", "DELETE FROM mart.live.nation WHERE n_nationkey = 1", "UPDATE mart.live.nation SET n_name = 'x'", "SELECT reflect('java.lang.System', 'getProperty', 'java.version')", "SELECT TRANSFORM(n_name) USING 'cat' AS (x STRING) FROM mart.live.nation", "SELECT upper(n_name) FROM mart.live.nation WHERE n_nationkey = (SELECT max(k) FROM mart.live.bare)"]
    out = []
    for i, sql in enumerate(asked):
        try:
            engine.execute(spark, cats, sql, may)
            out.append((i, True))
        except (Denied, Refused):
            out.append((i, False))
    return facts(spark, out, "i int, allowed boolean")


@registered("SELECT * FROM (VALUES ('SELECT', 'customer'), ('SELECT', 'orders'), ('UPDATE', 'nation')) AS t(privilege, name)")
def engine_required_grants(spark: SparkSession, cats: Catalogs) -> DataFrame:
    st = parse(spark, "UPDATE mart.live.nation SET n_name = (SELECT max(c_name) FROM customer) WHERE n_nationkey IN (SELECT o_custkey FROM mart.live.orders)")
    return facts(spark, [(g.privilege, g.on.name.split(".")[-1]) for g in required(st)], "privilege string, name string")


@registered("SELECT * FROM (VALUES ('query'), ('insert'), ('delete'), ('update'), ('merge'), ('command')) AS t(kind)")
def engine_classify(spark: SparkSession, cats: Catalogs) -> DataFrame:
    texts = ["SELECT 1", "INSERT INTO a.b.c VALUES (1)", "DELETE FROM a.b.c", "UPDATE a.b.c SET x = 1", "MERGE INTO a.b.c t USING d s ON t.x = s.x WHEN MATCHED THEN DELETE", "SET x = 1"]
    return facts(spark, [(parse(spark, t).kind,) for t in texts], "kind string")


@registered("SELECT 'select ''A b'' , x from t' AS text, CAST(7 AS INTEGER) AS tables, 'acct_3__mart' AS scoped")
def engine_names(spark: SparkSession, cats: Catalogs) -> DataFrame:
    """Normalized statements, the manifest of the standard tables, and a tenant's name for a catalog."""
    many = len(tpch_manifest("c", "n", "x").catalogs[0].namespaces[0].tables)
    return facts(spark, [(normalized("SELECT  'A b' , X FROM T -- c\n"), many, Scope(3).catalog("mart"))], "text string, tables int, scoped string")
