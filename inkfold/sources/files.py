"""Single files on any file system that Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    return fs.makeQualified(at).toString()


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a directory holds; nothing where there is none."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) and fs.getFileStatus(at).isDirectory() else []


def inside(spark: SparkSession, path: str, top: str) -> bool:
    """Whether a path is `top` or lies below it."""
    a, b = qualified(spark, path).rstrip("/"), qualified(spark, top).rstrip("/")
    return a == b or a.startswith(b + "/")


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file in one step: staged beside its place, synced, then renamed."""
    at, fs = _at(spark, path)
    staged, _ = _at(spark, f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(data))
        out.hsync()
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(staged, at):
        raise OSError(f"{path} could not be put in place")


def read(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
