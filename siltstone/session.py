"""Session helpers: table access and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CLEAN_NULLS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or an own one in a local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/siltstone/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltstone_path = path  # for release()
    if not _WRITTEN:  # runs before the session is stopped, as it is registered after it was started
        atexit.register(release_all, df.sparkSession)
    _WRITTEN.add(path)
    return out


_WRITTEN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release_all(spark: SparkSession) -> None:
    """Delete every table :func:`materialize` has written for results that were read by now; also done when the driver ends."""
    for path in list(_WRITTEN):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone
            break
        _WRITTEN.discard(path)


def release(*dfs: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_siltstone_path", None)
        if path:
            _delete(df.sparkSession, path)
            _WRITTEN.discard(path)


def blank_or_null(c: Column, words: tuple[str, ...] = CLEAN_NULLS) -> Column:
    """True for null, blank and the null words, whatever their case and outer white space."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return c.isNull() | (t == "") | t.isin(*words)
