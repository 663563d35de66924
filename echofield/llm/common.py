"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session whose executors are threads of the
    driver gets a temporary one where that is unset (tests); on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="echofield-"))
    return context.getCheckpointDir()


def fresh(frame: DataFrame) -> str:
    """A prefix with which no column of the frame begins: names of working columns that start with it cannot clash."""
    prefix = "_"
    while any(c.startswith(prefix) for c in frame.columns):
        prefix += "_"
    return prefix


def columns_of(frame: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in frame.columns]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Frames made within it drop their shuffle files when their action ends, not when the driver happens to collect its
    garbage: for actions that write what they find."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and go on from there, so that a lost executor costs one step at most."""
    shared_folder(frame.sparkSession)
    with freed(frame.sparkSession):
        return frame.select("*").checkpoint(eager=True)


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """Like cut, as a compressed table for rows that are many, and its folder, which the caller removes."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with freed(spark):
        frame.select("*").write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder), folder


#: Rows with whole texts that Python gets at a time.
TEXT_ROWS = 1000


def by_text(frame: DataFrame) -> DataFrame:
    """The frame, in a session that hands Python at most TEXT_ROWS rows at a time: the session's usual number is meant for rows
    of numbers, and a batch of texts is held by the JVM and by Python alike."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return frame


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Within it, actions hand Python so many rows at a time: for rows that hold long texts or many of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo five; rows without an id count as fold 0, so nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def first_by_hash(frame: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of the columns: a bounded sample that reruns repeat."""
    return frame.orderBy(F.xxhash64(*columns), *columns).limit(n)
