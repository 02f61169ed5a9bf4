"""Session settings and lineage cuts shared by jobs, tests and the benchmark."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "colloquy", **conf: str) -> SparkSession:
    """A session with the settings the plans expect; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; make one only where it is unset and all runs on this machine.

    On a cluster a folder of one machine would give incomplete tables, so there an unset
    folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {context.master} share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


_CUTS: list[str] = []


def cut(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    Later branches read the stored columns they need instead of recomputing the
    plan, a lost executor costs only its own tasks, and the stored sizes let Spark
    choose joins by size.  ``wide`` prepares the table for heavy row-wise work: a
    small table that landed in fewer files than there are cores is stored once more
    with one file per core.  :func:`stages` deletes the tables of a block.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)

    def stored(rows: DataFrame) -> DataFrame:
        target = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
        _CUTS.append(target)
        rows.write.parquet(target)
        return spark.read.schema(df.schema).parquet(target)

    out = stored(df)
    if wide:
        again = spread(out)
        out = out if again is out else stored(again)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stored stages now; else they stay until the driver happens to collect its garbage.

    The scheduler holds on to its last job, so that one is made a small one first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`cut` makes inside the block at its end; write or collect results inside it."""
    before = len(_CUTS)
    try:
        yield
    finally:
        for path in _CUTS[before:]:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        del _CUTS[before:]


def spread(stored: DataFrame, worth_bytes: int = 20_000) -> DataFrame:
    """Use all cores for row-wise work on a stored table that arrives in very few partitions.

    ``stored`` must be a plain scan: its partitions and size are known without
    running anything.  Tables with at least one partition per core, as on a cluster,
    and tiny ones are left alone.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    execution = stored._jdf.queryExecution()
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) < worth_bytes:
        return stored
    return stored.repartition(cores) if execution.toRdd().getNumPartitions() < cores else stored
