"""Result files and stages that are built only once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citylens.session import stage


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet files; an existing result is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV files, each with a header row."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_report(sheets: dict[str, DataFrame], folder: str, overwrite: bool = True) -> dict[str, str]:
    """Named result tables as Parquet and CSV below one folder; returns the Parquet paths."""
    paths = {}
    for name, df in sheets.items():
        paths[name] = f"{folder}/{name}.parquet"
        write_parquet(df, paths[name], overwrite)
        write_csv(df, f"{folder}/{name}.csv", overwrite)
    return paths


def has_output(spark: SparkSession, path: str) -> bool:
    """Whether a finished result is there: its success marker, which writers leave last."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of what lies under files, folders or patterns: names, lengths and times of all files.

    A path that is not there counts too.  Files that writers hide (``_`` or ``.`` first) are left out.
    """
    lines = []
    for path in paths:
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for top in system.globStatus(pattern) or []:
            files = system.listFiles(top.getPath(), True)
            while files.hasNext():
                file = files.next()
                name = file.getPath().toString()
                if not any(part.startswith(("_", ".")) for part in name[len(top.getPath().toString()):].split("/")):
                    lines.append(f"{name} {file.getLen()} {file.getModificationTime()}")
        lines.append(f"{path} is read")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


def _stored_fingerprint(spark: SparkSession, path: str, put: str | None = None) -> str | None:
    """The fingerprint kept with a stage; ``put`` writes one."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_INPUTS")
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if put is not None:
        stream = system.create(file, True)
        stream.writeBytes(put)
        stream.close()
        return put
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        return stream.readLine()
    finally:
        stream.close()


def materialize_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False, inputs: list[str] | None = None
) -> DataFrame:
    """Build a stage only if its output is absent or its input has changed, then read it back.

    Reading back cuts the lineage, and gives the planner the true size of the stage, so that a
    small one is broadcast and a big one is not.  ``inputs`` are the paths it is made from: with other files there than
    when it was built, it is built again.  Without ``inputs`` only absence counts.  ``refresh=True`` builds it again.
    """
    seen = None if inputs is None else input_fingerprint(spark, inputs)
    if refresh or not has_output(spark, path) or (seen is not None and _stored_fingerprint(spark, path) != seen):
        write_parquet(build(), path, overwrite=True)
        if seen is not None:
            # last, and from before the build: files that come meanwhile lead to another build
            _stored_fingerprint(spark, path, seen)
    return spark.read.parquet(path)


def finished_parts(spark: SparkSession, path: str) -> list[str]:
    """Folders below ``path`` that hold a finished result."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    parts = [status.getPath().toString() for status in system.listStatus(folder) if status.isDirectory()]
    return [part for part in parts if has_output(spark, part)]


def grow_once(
    asked: DataFrame, keys: list[str], path: str, build: Callable[[DataFrame], DataFrame], refresh: bool = False
) -> DataFrame:
    """A stored table of results by key that is extended by keys it does not know yet.

    ``build`` makes rows (any number per key) for keys; only those of ``asked`` without a stored row are
    built, into a folder of their own that counts once it is finished.  Keys without rows are asked again.
    """
    spark = asked.sparkSession
    known = [] if refresh else finished_parts(spark, path)
    wanted = asked.select(*keys).distinct()
    if known:
        wanted = wanted.join(spark.read.parquet(*known).select(*keys).distinct(), keys, "left_anti")
    wanted = stage(wanted, "new-keys")
    if known and wanted.isEmpty():
        return spark.read.parquet(*known)
    part = f"{path}/part-{uuid.uuid4().hex}"
    write_parquet(build(wanted), part)
    return spark.read.parquet(*known, part)


def create_table(df: DataFrame, name: str, replace: bool = False, path: str | None = None) -> DataFrame:
    """CREATE TABLE AS: keep an existing table unless ``replace``; returns the table.

    ``path`` makes it an external table in that folder.
    """
    spark = df.sparkSession
    if replace or not spark.catalog.tableExists(name):
        writer = df.write.mode("overwrite" if replace else "errorifexists").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)
