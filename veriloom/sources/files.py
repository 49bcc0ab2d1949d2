"""Small files in whatever store a path names: logs, markers and names, through the session's own file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as Spark's sources name files."""
    place, system = _place(spark, path)
    return system.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    place, system = _place(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file, whole or not at all; False if there is one already. Of several writers one gets True."""
    place, system = _place(spark, path)
    system.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(place), none)
    except Exception as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _place(spark, path)
    source = system.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def swap(spark: SparkSession, a: str, b: str) -> None:
    """Exchanges two files' places."""
    (x, system), (y, _) = _place(spark, a), _place(spark, b)
    held = spark._jvm.org.apache.hadoop.fs.Path(x.getParent(), f".{uuid.uuid4().hex}")
    for source, target in ((x, held), (y, x), (held, y)):
        if not system.rename(source, target):
            raise OSError(f"{source} cannot be renamed to {target}")
