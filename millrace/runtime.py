"""Session-level services: shipping the package, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package (once an application), so Python stages can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="millrace-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, root)))
    sc.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one of our own only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="millrace-shared-")
    return _own_dir[app]


class Workspace:
    """Tables that cut lineage: Parquet in the shared folder, so a lost executor loses nothing.

    ``save`` writes a frame and returns the frame that reads it; ``drop`` deletes one that
    nothing reads any more. What is left goes when the application ends.
    """

    _all: list["Workspace"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0
        Workspace._all.append(self)

    def save(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self.release()
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if path := self._paths.pop(id(frame), None):
                _delete(self.spark, path)
        self.release()

    def release(self) -> None:
        """Let the driver's cleaner find the shuffle files of finished jobs now rather than later."""
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the application is ending and its JVM may be gone already
            pass


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _close_all() -> None:
    for w in Workspace._all:
        if w.spark.sparkContext._jsc is not None:
            w.close()


def rekey(column: str) -> Column:
    """A long join key with the same equalities that no existing partitioning satisfies.

    An aggregate's output is already hash partitioned by its key, so a join on that key would
    reuse it and adaptive execution could not split a hot partition. Joining on this key makes
    both sides plain exchanges, which it can split.
    """
    return F.col(column).bitwiseXOR(F.lit(0x5DEECE66D).cast("long"))


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast: whatever else the table has cannot clash with an operator's own."""
    first = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{k}" for k in range(len(df.columns))])  # by place: names may differ in case only
    return plain.select(*[(plain[f"_{first[n]}"] if n in first else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
