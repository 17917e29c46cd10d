"""What the operators need from a cluster: shared tables, models for executors, batch sizes."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from corvid.tables import Scratch, materialise, remove, shared_folder

__all__ = ["Scratch", "Shipped", "free_column", "materialise", "remove", "returns_memory", "shared_folder", "small_batches", "trimmed"]


class Shipped:
    """A broadcast of a value of this package's classes, pickled by value, as executors need not have the package."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.unpacked = None

    @property
    def value(self):
        if self.unpacked is None:
            self.unpacked = pickle.loads(self.packed.value)
        return self.unpacked

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "unpacked": None}


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def trimmed(run):
    """``run`` (a function of a group's key and table), giving freed memory back after each group."""

    @functools.wraps(run)
    def whole(key, table):
        out = run(key, table)
        del table
        _trim()
        return out

    return whole


def returns_memory(run):
    """``run`` (a function from Arrow batches to Arrow batches), giving freed memory back once a task is through.

    Python workers live on between tasks and stages, and what their allocators keep counts as the executor's.
    """

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        _trim()

    return whole


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Inside, Arrow batches have at most ``rows`` rows where the session sets no number, as texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name, None) is None
    if own:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(name)


def free_column(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
