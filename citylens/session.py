"""Session defaults, shared scratch space and small parameter tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from citylens.sources.schemas import schema as parse_schema

# Settings every plan relies on: one time zone for all naive timestamps, loud casts, runtime
# re-planning with skew handling.  Sizes (partitions, memory) are left to the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "citylens", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, shuffled_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Set the number of shuffle partitions for an expected volume; AQE merges small ones later.

    AQE never adds partitions, so a large run needs enough of them from the start.
    """
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shuffled_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(number))
    return number


# Rows travel to Python in batches of 10,000, whatever their length; long texts need a bound in bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, batch_bytes: int = 2 << 20) -> None:
    """Let Arrow batches hold about so many bytes, or one row; a bound set by the deployment stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(batch_bytes))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A local master may fall back to a new temporary folder; a cluster without the setting is an
    error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="citylens-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, inside the shared folder."""
    return f"{shared_dir(spark)}/citylens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Later steps restart from the files if executors are lost, and the planner knows their size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``stage`` that also returns aggregates of the rows, found while they are written.

    A task may count again when an executor is lost, so measures should not mind a repeated row: min, max, sets, any and all.
    """
    seen = Observation(name)
    staged = stage(df.observe(seen, *[value.alias(key) for key, value in measures.items()]), name)
    return staged, seen.get


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def clear_stages(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote in this application; results still read from it are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/citylens/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def together(*jobs: Callable[[], object]) -> list:
    """Run independent Spark jobs at the same time, so small ones do not leave the cluster idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]


def parameter_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Fixed parameters (labels, holidays, positions) as a table whose exact size Catalyst knows.

    Inline values become a local relation, so the planner can compare its true size with
    ``spark.sql.autoBroadcastJoinThreshold``; a list would become an RDD of unknown size.
    """
    fields = parse_schema(schema).fields
    if not rows:
        return spark.createDataFrame([], parse_schema(schema))
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"`{f.name}`" for f in fields)
    casts = [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields]
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").selectExpr(*casts)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)
