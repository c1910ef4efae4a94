"""Session construction and the few settings the library depends on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one `spark.checkpoint.dir` names, else the context's own.

    Where neither is set, a local session gets a private folder of its own; on a cluster such a folder
    would be invisible to the other machines, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gradeline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing has to be removed first."""
    return f"{shared_dir(spark)}/gradeline-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for iterative work that must survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a fanned-out table that a task gets, about: so many are sorted or grouped in its memory, without a spill.
TASK_ROWS = 1 << 21


def task_count(df: DataFrame, fan_out: int = 1) -> int:
    """Tasks for a table whose every row becomes `fan_out` rows; counts the rows, so `df` should be cheap to read."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * fan_out // TASK_ROWS))


def spread(df: DataFrame, *keys: str, fan_out: int = 1, tasks: int | None = None) -> DataFrame:
    """Hash-partition a narrow table by `keys` before every row becomes `fan_out` rows.

    The partitioning survives projections and generators, so later aggregations whose grouping keys
    include `keys` need no exchange of the (much larger) fanned-out rows. Adaptive coalescing would
    size partitions by the narrow input, so the count is explicit: `tasks`, else that of `task_count`.
    The size on disk does not tell it, as columns that compress well fan out to as many rows as others.
    """
    return df.repartition(tasks or task_count(df, fan_out), *keys)
