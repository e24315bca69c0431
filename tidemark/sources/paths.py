"""Steps on paths of any file system that Spark can write to."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    own = _path(spark, path)
    return _system(spark, own).exists(own)


def remove(spark: SparkSession, path: str) -> None:
    own = _path(spark, path)
    _system(spark, own).delete(own, True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that nothing has; False, and the source is gone, if something has it."""
    jvm, old, new = spark.sparkContext._jvm, _path(spark, source), _path(spark, target)
    system = _system(spark, old)
    system.mkdirs(new.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(system.makeQualified(old), system.makeQualified(new), no_options)
    except Py4JJavaError:
        if not system.exists(new):
            raise
        system.delete(old, True)
        return False
    return True


def publish_new(spark: SparkSession, text: str, target: str) -> bool:
    """Make a file with this text under a name that nothing has; False if something has it.

    The file appears whole. It is written under another name first, and given its own
    by a step that fails if the name is taken: a hard link on a local disk, a rename
    elsewhere, which is one step where the file system's renames are.
    """
    new = _path(spark, target)
    system = _system(spark, new)
    system.mkdirs(new.getParent())
    staged = _path(spark, f"{target.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = system.create(staged, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    qualified = system.makeQualified(new).toUri()
    if qualified.getScheme() == "file":
        try:
            os.link(system.makeQualified(staged).toUri().getPath(), qualified.getPath())
        except FileExistsError:
            return False
        finally:
            system.delete(staged, False)
        return True
    return rename_new(spark, staged.toString(), target)
