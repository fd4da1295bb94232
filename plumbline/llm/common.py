"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session (as in tests) gets a folder of its own; on a cluster it is an error.
    Nothing in it is removed by itself, as results may still be read lazily:
    call ``remove_scratch`` once they are written.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "plumbline-shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has used."""
    return f"{shared_dir(spark)}/plumbline-llm/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Removes the tables that ``fresh_path`` placed; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/plumbline-llm")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Returns this Python process's freed memory to the system, as at the end of a task whose worker serves other stages next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over batches, whose worker gives its freed memory back at the end: idle workers stay as long as stages follow each other."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        trim()

    return run


def give_back(spark: SparkSession) -> None:
    """Returns the driver's freed memory to the system; Spark then also removes shuffles and checkpoints that nothing refers to."""
    trim()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pd.Series) -> list[str]:
    """Values of a text column, null as empty."""
    return [x if isinstance(x, str) else "" for x in column]


def slices(batch: pd.DataFrame, column: str, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Consecutive parts of a batch with about ``chars`` characters of text each, a longer text alone; one for an empty batch."""
    size = [len(x) + 1 if isinstance(x, str) else 1 for x in batch[column]]
    at, held = 0, 0
    for k, n in enumerate(size):
        if held and held + n > chars:
            yield batch.iloc[at:k]
            at, held = k, 0
        held += n
    yield batch.iloc[at:]


def crc_mod(column: str, n: int):
    """crc32 of a column's text form, modulo n (null: of the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroups batches of a partition sorted by ``keys`` so that no run of equal keys is split.

    It holds one batch and the run that is open at its end.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        if held:
            last = held[-1][keys].iloc[-1].tolist()
            if batch[keys].iloc[-1].tolist() == last and batch[keys].iloc[0].tolist() == last:
                held.append(batch)
                continue
        whole = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
        last_row = whole[keys].iloc[-1]
        same = (whole[keys] == last_row).all(axis=1).to_numpy()
        start = len(whole) - int(same[::-1].argmin()) if not same.all() else 0
        if start:
            yield whole.iloc[:start].reset_index(drop=True)
        held = [whole.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)
