"""Shared plumbing: staged tables, bounded Arrow batches, deterministic samples."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python.  Texts can be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


#: Rows (8 to 40 bytes each) that a join may broadcast; above it the join shuffles.  Results are the same.
BROADCAST_ROWS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a master in this one process (tests); a cluster,
    whose executors could not see it, is refused.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gristmill.scratch", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        where = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.gristmill.scratch", where)
    return where.rstrip("/")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, counted first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a replicated table.

    ``files``: at most so many, for tables whose size is known to be small.  The folder goes when
    the driver's JVM ends, or earlier through ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gristmill-{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    fs, target = _filesystem(spark, path)
    fs.deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._gm_path = path  # type: ignore[attr-defined]
    return back


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a staged table that nothing will read again."""
    path = getattr(df, "_gm_path", None)
    if path:
        fs, target = _filesystem(df.sparkSession, path)
        fs.delete(target, True)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Hold Arrow batches to ``rows`` rows and ``size`` bytes, so that a batch of long texts fits a Python worker.

    The limits are the session's, as plans read them when they run; a smaller one that is set stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = (spark.conf.get(key) or "").rstrip("bB")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(id_column: str) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3


def training_sample(labels: DataFrame, id_column: str, label: str, limit: int, salt: str) -> DataFrame:
    """At most about ``limit`` labelled rows of the learning folds, picked by a hash of the id.

    Conflicting labels of one id: the larger counts.  Null ids and labels are left out.
    """
    rows = (
        labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .where(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1)
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(salt), F.col("_id")), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    return rows


def logistic(x: Any, y: Any, l2: float = 1.0, steps: int = 40) -> Any:
    """Newton's method for a small ridge-penalised logistic regression; the intercept is the last weight."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
