"""What every job needs from its session: workers that can import this package, and a checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package, and see that checkpoint() has a folder.

    The folder is the one that the session names in ``spark.checkpoint.dir``; a local one is made only
    where neither the setting nor the context has any, as in tests on one machine.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder: lineage ends here, and lost executors cost nothing before it."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), by a Parquet table in the checkpoint folder: smaller than a checkpoint, for many rows."""
    spark = ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table marked for broadcast if it has ``most`` rows at most; else as it is, so that joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def added(rows: DataFrame, keys: list[str], column: str, tasks: int | None = None) -> DataFrame:
    """Sums of arrays of doubles (binary ``column``) by ``keys``, in two steps: no group gathers more than some root of the tasks' rows.

    Where ``tasks`` says that 64 tasks at most have made the rows, each with one row a key, one step is enough.
    """

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_buffer()) for c in part[column].chunks for v in c], axis=0)
        return part.slice(0, 1).set_column(part.column_names.index(column), column, pa.array([total.tobytes()], pa.binary()))

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    if tasks is not None and tasks <= 64:
        return rows.groupBy(*keys).applyInArrow(lambda t: add(t), kinds)
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = salted.groupBy(*keys, "salt").applyInArrow(lambda t: add(t), f"{kinds}, salt int").drop("salt")
    return once.groupBy(*keys).applyInArrow(lambda t: add(t), kinds)
