"""Atomic, immutable publication of stages, JSON reports and pointers, on whatever file system a path names.

All file operations go through the session's Hadoop file systems, so a stage
written by executors to a shared store is published there, not on the driver's
machine. Nothing here depends on symbolic links, which object stores lack.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at ``path``, even a local link that leads nowhere."""
    fs, p = _at(spark, path)
    return fs.exists(p) or (fs.getScheme() == "file" and os.path.lexists(p.toUri().getPath()))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, target: str, write: Callable[[str], None]) -> str:
    """Fill a hidden folder beside ``target`` by ``write``, then rename it into place.

    An existing target is refused; a failure leaves nothing.
    """
    target = target.rstrip("/")
    if exists(spark, target):
        raise FileExistsError(target)
    staged = f"{os.path.dirname(target)}/.stage-{uuid.uuid4().hex}"
    fs, p = _at(spark, staged)
    fs.mkdirs(p)
    try:
        write(staged)
        if exists(spark, target) or not fs.rename(p, _at(spark, target)[1]):
            raise FileExistsError(target)
    except BaseException:
        fs.delete(p, True)
        raise
    return target


def claim(spark: SparkSession, path: str) -> None:
    """Take ``path`` by creating an empty file there; whoever comes second gets an error."""
    fs, p = _at(spark, path)
    try:
        if not fs.createNewFile(p):
            raise FileExistsError(path)
    except FileExistsError:
        raise
    except Exception as e:
        raise FileExistsError(path) from e


def write_json(spark: SparkSession, path: str, report: dict | list) -> None:
    """Write through a temporary file that replaces the old one, so that a reader sees all or nothing."""
    fs, temp = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temp)
    try:
        out.write(bytearray(json.dumps(report, indent=2, ensure_ascii=False, default=str).encode()))
        out.hsync()
    finally:
        out.close()
    _replace(spark, temp, path)


def _replace(spark: SparkSession, temp, path: str) -> None:
    sc = spark.sparkContext
    rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    dest = sc._jvm.org.apache.hadoop.fs.Path(path)
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(dest.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration()).rename(temp, dest, how)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def failure_report(spark: SparkSession, path: str, stage: str, error: BaseException, counts: dict | None = None) -> None:
    """What failed and where, without the error's text, which may hold secrets."""
    write_json(spark, path, {"stage": stage, "error": type(error).__name__, "counts": counts or {}})


def save(df: DataFrame, path: str) -> None:
    """CSV or Parquet by suffix, through a hidden folder; an existing path is refused."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in (".csv", ".parquet"):
        raise ValueError("only .csv and .parquet are written")
    publish(df.sparkSession, path, lambda at: (df.write.mode("append").option("header", True).csv(at) if kind == ".csv" else df.write.mode("append").parquet(at)))


def switch(spark: SparkSession, folder: str, targets: dict[str, str]) -> None:
    """Let ``folder``/current.json name new targets, all of them or none.

    The wish is written down first; a crash after that is settled by ``recover``.
    """
    absent = [t for t in targets.values() if not exists(spark, t)]
    if absent:
        raise FileNotFoundError(absent[0])
    recover(spark, folder)
    write_json(spark, f"{folder}/pending.json", targets)
    recover(spark, folder)


def recover(spark: SparkSession, folder: str) -> str:
    """Settle a switch that broke off: ``completed`` if all it names is there, ``dropped`` if not, ``clean`` without one."""
    pending = f"{folder}/pending.json"
    if not exists(spark, pending):
        return "clean"
    targets = read_json(spark, pending)
    whole = all(exists(spark, t) for t in targets.values())
    if whole:
        write_json(spark, f"{folder}/current.json", targets)
    remove(spark, pending)
    return "completed" if whole else "dropped"


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    return read_json(spark, f"{folder}/current.json")
