"""Stages whose results are kept: a stage is known by its name, its parameters and its input files, and is computed once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change) of all files below a path, by name, from the file system's own records: no job runs."""
    at, fs = _file_system(spark, path)
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    return sorted(out)


def key_of(spark: SparkSession, name: str, inputs: list[str], parameters: dict) -> str:
    """A digest that changes with the stage's name, its parameters (of JSON's kinds) and any input file."""
    told = json.dumps([name, parameters, [files_of(spark, p) for p in inputs]], sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()


def stage(spark: SparkSession, store: str, name: str, inputs: list[str], parameters: dict, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The stored result of make() over the input files, computed only where the store doesn't hold it whole.

    A result is written aside and moved to its place when complete, so that a lost driver leaves no half result under a key, and of two runs
    at once the first to end stays. fresh: computed anew in any case, in place of what is stored."""
    path = f"{store.rstrip('/')}/{name}-{key_of(spark, name, inputs, parameters)}"
    at, fs = _file_system(spark, path)
    if fresh or not fs.exists(at):
        aside = f"{store.rstrip('/')}/_aside-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        if fresh:
            fs.delete(at, True)
        made, _ = _file_system(spark, aside)
        if fs.exists(at) or not fs.rename(made, at):
            fs.delete(made, True)
    return spark.read.parquet(path)
