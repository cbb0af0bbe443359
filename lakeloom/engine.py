"""The one way that statements take: parse, authorize, pin, look up, run, store. And the service around it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .operators import dml
from .plans.resolve import Refused, parse, resolve
from .plans.result_cache import ResultCache, cache_key, cacheable
from .service.access import Authorization, Grant, Object, required
from .service.admission import Cancelled, Scheduler
from .service.control import ABANDONED, Lease, Principal, Services
from .sources.catalog import Catalogs, Scope, apply_manifest
from .sources.manifest import Manifest
from .sources.storage import Storage


def query(spark: SparkSession, catalogs: Catalogs, sql: str) -> DataFrame:
    """The DataFrame of one query, every table pinned at its snapshot of now."""
    st = parse(spark, sql)
    if st.kind != "query":
        raise Refused(f"{st.kind}: not a query")
    r = resolve(spark, catalogs, st)
    try:
        return spark.sql(r.sql)
    finally:
        r.release(spark)


def execute(spark: SparkSession, catalogs: Catalogs, sql: str, auth: Authorization | None = None, cache: ResultCache | None = None, account: int = 0) -> pa.Table:
    """A statement's result; of a write, its outcome as one row. Grants are checked before the cache is asked."""
    st = parse(spark, sql)
    if auth is not None:
        auth.check(required(st))
    if st.kind in ("insert", "delete", "update", "merge"):
        o = dml.execute(spark, catalogs, sql)
        return pa.table({"kind": [o.kind], "rows_changed": [o.rows_changed], "snapshot_id": pa.array([o.snapshot_id], pa.int64()), "attempts": [o.attempts]})
    if st.kind == "command":
        raise Refused(f"not served: {st.sql[:60]!r}")
    r = resolve(spark, catalogs, st)
    try:
        df = spark.sql(r.sql)
        key = cache_key(account, r, df) if cache is not None and cacheable(r, df) else None
        if key is not None and (hit := cache.lookup(account, key)) is not None:
            return hit
        out = df.toArrow()
        if cache is not None:
            cache.counts["execution"] += 1
            if key is not None:
                cache.store(account, key, out)
            else:
                cache.counts["skip"] += 1
        return out
    finally:
        r.release(spark)


class NotRunning(LookupError):
    """No such query runs, or it is someone else's: which, isn't told."""


@dataclass
class Running:
    account_id: int
    warehouse: str
    cancelled: threading.Event
    session: SparkSession | None = None


class TenantSessions:
    """A session and catalogs for each account, made once."""

    def __init__(self, spark: SparkSession, storage: Storage, manifest: Manifest):
        self.spark, self.storage, self.manifest = spark, storage, manifest
        self.made: dict[int, tuple[SparkSession, Catalogs]] = {}
        self.lock = threading.Lock()

    def get(self, account_id: int) -> tuple[SparkSession, Catalogs]:
        with self.lock:
            if account_id not in self.made:
                session = self.spark.newSession()
                self.made[account_id] = session, apply_manifest(session, self.storage, self.manifest, Scope(account_id))
            return self.made[account_id]


class Coordinator:
    """The query service: who asks comes from the credential alone."""

    def __init__(self, spark: SparkSession, storage: Storage, manifest: Manifest, services: Services, slot: str = "coordinator", running: int = 4, queued: int = 128):
        self.services, self.sessions, self.cache = services, TenantSessions(spark, storage, manifest), ResultCache(services)
        self.lease = Lease(services, slot)
        self.scheduler = Scheduler(services, self.lease.incarnation, running, queued)
        self.live: dict[str, Running] = {}
        self.lock = threading.Lock()

    def _admit(self, p: Principal, privilege: str, warehouse: str) -> Authorization:
        auth = self.services.authorization(p)
        auth.check([Grant(privilege, Object("warehouse", warehouse))])
        return auth

    def submit(self, token: str | None, warehouse: str, sql: str, query_id: str | None = None, on_start: Callable[[], None] | None = None) -> pa.Table:
        """Run a statement to its end. USAGE is checked before the warehouse is looked up, so names can't be probed."""
        p = self.services.authenticate(token)
        auth = self._admit(p, "USAGE", warehouse)
        w = self.services.warehouse(p.account_id, warehouse)
        if w is None:
            raise LookupError(f"there is no warehouse {warehouse}")
        if w.state != "running":
            raise RuntimeError(f"warehouse {warehouse} is {w.state}")
        qid, run = query_id or uuid.uuid4().hex, Running(p.account_id, warehouse, threading.Event())
        self.services.submit(qid, p.account_id, warehouse, sql, self.lease.incarnation)
        with self.lock:
            self.live[qid] = run
        state, rows, error = "failed", None, ABANDONED
        try:
            with self.scheduler.slot(w, qid, run.cancelled):
                if not self.services.mark_running(qid):
                    raise Cancelled(qid)
                spark, catalogs = self.sessions.get(p.account_id)
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{p.account_id}-{warehouse}")
                spark.sparkContext.addJobTag(f"query-{qid}")
                with self.lock:
                    run.session = spark
                try:
                    if on_start:
                        on_start()
                    if run.cancelled.is_set():
                        raise Cancelled(qid)
                    out = execute(spark, catalogs, sql, auth, self.cache, p.account_id)
                finally:
                    spark.sparkContext.removeJobTag(f"query-{qid}")
            state, rows, error = "succeeded", out.num_rows, None
            return out
        except Exception as e:
            error = str(e)
            if run.cancelled.is_set():
                state = "cancelled"
                raise Cancelled(qid) from e
            raise
        finally:
            with self.lock:
                self.live.pop(qid, None)
            self.services.finish(qid, "cancelled" if run.cancelled.is_set() and state == "failed" else state, rows, error)

    def cancel(self, token: str | None, query_id: str) -> None:
        """Needs CANCEL on the query's warehouse."""
        p = self.services.authenticate(token)
        with self.lock:
            run = self.live.get(query_id)
        if run is None or run.account_id != p.account_id:
            raise NotRunning(query_id)
        self._admit(p, "CANCEL", run.warehouse)
        run.cancelled.set()
        with self.lock:
            session = run.session
        if session is not None:
            session.sparkContext.cancelJobsWithTag(f"query-{query_id}")

    def close(self) -> None:
        self.scheduler.close()
        self.lease.close()
