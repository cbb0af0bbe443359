"""Where tables lie: a local root, a temporary folder or an object store, and the path rule over them."""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


@dataclass(frozen=True)
class Storage:
    """kind: local (root must exist), memory (a folder that ends with the process) or s3 (bucket, region, endpoint)."""

    kind: str = "local"
    root: str = ""
    bucket: str = ""
    region: str = ""
    endpoint: str = ""
    allow_http: bool = False
    _made: list[str] = field(default_factory=list, compare=False, repr=False)

    def __post_init__(self):
        if self.kind not in ("local", "memory", "s3"):
            raise ValueError(f"unknown storage kind {self.kind!r}")
        if self.kind == "local" and not os.path.isdir(self.root):
            raise ValueError(f"the storage root {self.root!r} doesn't exist")
        if self.kind == "s3" and not self.bucket:
            raise ValueError("s3 storage needs a bucket")

    def base(self) -> str:
        if self.kind == "local":
            return os.path.abspath(self.root)
        if self.kind == "s3":
            return f"s3a://{self.bucket}"
        if not self._made:
            self._made.append(tempfile.mkdtemp(prefix="lakeloom-mem-"))
        return self._made[0]

    def path(self, p: str) -> str:
        """Absolute paths and those with a scheme pass through; others are under the base."""
        return p if p.startswith("/") or _SCHEME.match(p) else f"{self.base().rstrip('/')}/{p}"

    def configure(self, spark: SparkSession) -> None:
        """Hadoop options of the object store; credentials come from its default provider chain."""
        if self.kind == "memory" and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("memory storage can't be read by other machines; name a shared root")
        if self.kind != "s3":
            return
        conf = spark._jsc.hadoopConfiguration()
        if self.endpoint:
            conf.set("fs.s3a.endpoint", self.endpoint)
            conf.set("fs.s3a.path.style.access", "true")
            conf.set("fs.s3a.connection.ssl.enabled", str(not self.allow_http).lower())
            if self.endpoint.startswith("http://") and not self.allow_http:
                raise ValueError("a plaintext endpoint must be allowed with allow_http")
        if self.region:
            conf.set("fs.s3a.endpoint.region", self.region)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of this machine only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found
