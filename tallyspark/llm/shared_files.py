"""Files of bytes in the shared folder, written and read by tasks on any executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.runtime import scratch_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below the shared one; a bare path is given the scheme file."""
    base = scratch_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def open_fs(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address (file, hdfs, s3, gs, ...) and the path in it."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(address)


def write_file(folder: str, name: str, parts: Iterable[bytes]) -> int:
    """Write a file under a name of its own and move it to ``name``, so that a repeated or broken-off task leaves one whole file."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    own, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    fs.move(own, f"{path}/{name}")
    return size


def ranges(files: DataFrame, block: int) -> DataFrame:
    """``file, size, start, stop`` for the byte ranges of ``files`` (columns file, size), spread over tasks by a shuffle of this small table."""
    cut = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + block, F.col("size"))).repartition("file", "start")
