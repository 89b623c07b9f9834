"""Helpers shared by the operators: table access, hold-outs, bounded samples, shared storage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    A session of one machine that names none gets a local folder; on a cluster that would lose data, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/seamark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts lineage and outlives executors."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored`` and the path, for ``dropped`` once nothing reads it any more."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``stored_at``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """While it lasts, rows go to Python in batches of about n_bytes at most; for jobs that run within it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def tidy(task: Callable) -> Callable:
    """A task function whose worker gives what it has freed back to the system when it ends, as the process lives on."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def bounded(df: DataFrame, at_most: int, *key: str, text: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """At most ``at_most`` rows of df for fitting a model: the least by a hash of ``key``, however the rows are laid out.

    max_bytes: fewer rows, so that ``text`` comes to about that many bytes at most. No one text may have more.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)) if text and max_bytes else F.lit(0)
    if text and max_bytes:
        df = df.where(size <= max_bytes)
    n, total = df.agg(F.count("*"), F.sum(size)).first()
    if max_bytes and total and total > max_bytes:
        at_most = min(at_most, max(1, n * max_bytes // total))
    spread = 1 << 30
    if n > at_most:
        share = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(spread))
        df = df.where(share < int(spread * min(1.0, (1.1 * at_most + 20) / n))).orderBy(share, *key, *([text] if text else [])).limit(at_most)
    return df


def labelled(docs: DataFrame, labels: DataFrame, at_most: int, doc_id: str = "doc_id") -> DataFrame:
    """docs joined with an even sample of at most ``at_most`` rows of labels, chosen by their ids alone.

    Only the sample is sent to the tasks; no text is shuffled for it.
    """
    return docs.join(F.broadcast(bounded(labels, at_most, doc_id)), doc_id)
