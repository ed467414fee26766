"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a Parquet table under the folder that
``spark.checkpoint.dir`` names.  All executors share that folder, so a lost executor costs a
re-read and no recomputation.  Tables of finished rounds are dropped as soon as nothing reads them; those that a result
still reads go with ``Stage.close``, at the end of ``runs()`` or of the application.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .session import ship

_own_folder: list[str] = []
_open: list["Stage"] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, a local session gets one of its own;
    on a cluster that would be a folder the executors do not share, so it is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="conceptmill-"))
    return _own_folder[0]


class Stage:
    """Tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._tables: list[str] = []
        _open.append(self)

    def write(self, df: DataFrame, tag: str, partition_by: str | None = None, **counts) -> DataFrame | tuple[DataFrame, dict]:
        """Write ``df`` and give the table back.  ``counts`` are aggregate columns observed by the
        same job, so that loops learn their size without another pass."""
        self._n += 1
        path = f"{self.folder}/{self._n:04d}-{tag}"
        schema = df.schema
        seen = None
        if counts:
            seen = Observation(f"{tag}{self._n}-{uuid.uuid4().hex[:6]}")
            df = df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()])
        w = df.write.option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
        back = self.spark.read.schema(schema).parquet(path).select(*schema.names)
        back._stage_path = path  # type: ignore[attr-defined]
        return (back, seen.get) if seen is not None else back

    def mailbox(self, tag: str, schema: str) -> "Mailbox":
        self._n += 1
        return Mailbox(self, f"{self.folder}/{self._n:04d}-{tag}", schema)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._stage_path)  # type: ignore[attr-defined]

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def own(self, table: str) -> str:
        """A table of the session's catalogue that goes when this run is closed."""
        self._tables.append(table)
        return table

    def close(self) -> None:
        """Delete every table of this run; frames built on them cannot be read any more."""
        if self in _open:
            _open.remove(self)
        for t in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._delete(self.folder)


@contextmanager
def runs():
    """Closes every run that begins within it; for results that are written or collected before its end."""
    before = set(map(id, _open))
    try:
        yield
    finally:
        for s in [s for s in _open if id(s) not in before]:
            s.close()


class Mailbox:
    """Rows sent to numbered receivers, in one table partitioned by receiver (``to``).  What a receiver got is one
    folder, however many senders it had, and can be dropped alone."""

    def __init__(self, stage: Stage, path: str, schema: str):
        self.stage, self.path, self.schema = stage, path, schema

    def send(self, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").partitionBy("to").parquet(self.path)

    def take(self, to: int) -> DataFrame:
        spark, folder = self.stage.spark, f"{self.path}/to={to}"
        if not self.stage._exists(folder):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(folder)

    def drop(self, to: int) -> None:
        self.stage._delete(f"{self.path}/to={to}")


@atexit.register
def _close_all() -> None:
    """On whatever file system the folders are, as long as the session lives; a stopped one can have local folders only."""
    import shutil

    for s in list(_open):
        try:
            if s.spark.sparkContext._jsc is None:
                raise RuntimeError("stopped")
            s.close()
        except Exception:
            shutil.rmtree(s.folder.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
    for f in _own_folder:
        shutil.rmtree(f.removeprefix("file://"), ignore_errors=True)
