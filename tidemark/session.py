"""Session construction and the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE, Arrow). For tests and single machines: on a
    cluster the session is the cluster's own, and only its zone has to be UTC."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session, where that is unset, gets a temporary
    one; on a cluster a folder of one machine would be lost to the others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration() if hasattr(spark, "_jsc") else spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder belongs to the cluster's own cleaning
        pass


#: Tables of the open scopes, innermost last.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables materialised inside are deleted at the end of the block; results must be written or counted by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _delete(spark, path)


def materialize(df: DataFrame, label: str, delete_at_exit: bool = True) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage is cut, and the rows survive the loss
    of any executor. Unlike ``checkpoint()`` the table is columnar and compressed, so later passes prune columns. It is
    deleted at the end of the innermost :func:`scratch` block, else at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES and delete_at_exit:
        _SCOPES[-1].append((spark, path))
    elif delete_at_exit:
        atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
