"""Session settings, partition sizing and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", app: str = "folioquarry", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def input_bytes(df: DataFrame) -> int:
    """What the tables under ``df`` hold on disk, by their statistics; nothing is run. Frames made in the driver count as unlimited."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Round-robin ``df`` over all cores where its tables have less than ``most`` bytes a core, before work that is heavy per row.

    A small file may be one row group, hence one task. Tables beyond that have splits enough and aren't shuffled. The plan
    is judged by its statistics, so that nothing of it runs twice.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_bytes(df) < most * cores else df


def small(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes as text, else as it is, for a shuffled join.

    The count runs the plan of ``df``: pass scans of tables, or what ``cut_lineage`` wrote.
    """
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a folder of this machine only where none is set and the master is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "folioquarry-checkpoints"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from a table written to the shared folder, so that a lost executor costs no recomputation and many readers cost one run.

    A table, unlike checkpoint(), is compressed and read by column. It is deleted when this process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/folioquarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass
