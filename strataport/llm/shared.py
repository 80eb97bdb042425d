"""Session plumbing that every operator of this subpackage uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path (a cluster without that path ships it with
    ``--py-files``), and bound an Arrow batch by bytes, so that long texts don't make a batch large."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *(p for p in paths if p)])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset and
    everything runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataport-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths of tables and files that this process has written and not removed.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strataport/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and what was computed survives a lost
    executor. Returns the frame and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made:
            _made.remove(path)


def mark() -> int:
    """The point up to which paths have been made."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Delete what was written since a mark, once the results that were computed from it are written or done with: a
    result reads the tables that its operator wrote until then."""
    remove(spark, *[p for p in _made[since:] if p not in but])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names, in any case, the operator's own output takes."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
