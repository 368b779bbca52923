"""Small files of a store through Hadoop's file systems, and publishing a name exactly once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _of(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    _, p, fs = _of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _of(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _of(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    jvm, p, fs = _of(spark, old)
    if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not become {new}")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole under a name that nobody else has taken; False where it is taken.

    The text is written under another name of the same folder first. Then it gets its own: on a local disk by a hard link, elsewhere by a
    rename that never replaces. Both either happen or not.
    """
    jvm, p, fs = _of(spark, path)
    folder = p.getParent()
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            local = lambda x: x.toUri().getPath()
            try:
                os.link(local(draft), local(p))
            except FileExistsError:
                return False
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(p), none)
        except Exception as error:  # the driver's bridge wraps Java errors
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def joined(spark: SparkSession, folder: str, target: str) -> None:
    """The part files of a folder, in order of their names, as one file: by concatenation within the file system where it can, else copied through."""
    jvm, p, fs = _of(spark, target)
    parts = [jvm.org.apache.hadoop.fs.Path(folder, n) for n in names(spark, folder) if n.startswith("part-")]
    fs.delete(p, False)
    if fs.getScheme() == "hdfs" and len(parts) > 1:
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for i, x in enumerate(parts[1:]):
            rest[i] = x
        fs.concat(parts[0], rest)
        fs.rename(parts[0], p)
        return
    out = fs.create(p, True)
    try:
        for part in parts:
            stream = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
