"""Claims: files that only one of several writers can create.

Creating a file without overwriting is the compare-and-set that shared file
systems offer: of two sessions that try the same name, one succeeds. A claim
holds its owner's name. (HDFS and mounted disks create so; an object store must
be one whose connector refuses to create an existing object.)
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_UNKNOWN_FOR_S = 2 * 3600  # a claim whose run never showed up in the log counts this long


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def take(spark: SparkSession, path: str, owner: str) -> bool:
    """Create the claim ``path`` for ``owner``; False if it exists."""
    fs, where = _file(spark, path)
    fs.mkdirs(where.getParent())
    folder = fs.resolvePath(where.getParent())
    if folder.toUri().getScheme() == "file":
        return _take_local(spark, f"{folder.toUri().getPath().rstrip('/')}/{where.getName()}", owner)
    try:
        stream = fs.create(where, False)
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    stream.write(bytearray(owner, "utf-8"))
    stream.close()
    return True


def _take_local(spark: SparkSession, path: str, owner: str) -> bool:
    """On a mounted disk Hadoop looks first and creates then; a hard link fails if its name exists, in one step."""
    jvm = spark.sparkContext._jvm
    target = jvm.java.io.File(path)
    written = jvm.java.io.File.createTempFile(".claim", ".tmp", target.getParentFile())
    try:
        stream = jvm.java.io.FileOutputStream(written)
        stream.write(bytearray(owner, "utf-8"))
        stream.close()
        jvm.java.nio.file.Files.createLink(target.toPath(), written.toPath())
        return True
    except Py4JJavaError:
        if target.exists():
            return False
        raise
    finally:
        written.delete()


def owner_of(spark: SparkSession, path: str) -> str | None:
    """Who holds the claim; None if nobody, "" while its owner is being written."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The claims in ``folder``."""
    fs, where = _file(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return [n for n in found if not n.startswith(".")]


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, False)


def _generations(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[2:]) for n in names(spark, folder) if n.startswith("g=") and n[2:].isdigit())


def take_turn(spark: SparkSession, folder: str, owner: str, is_over: Callable[[str], bool | None]) -> bool:
    """Become the holder of ``folder``, whose claims are numbered turns; False while another holds it.

    ``is_over(holder)`` tells whether that holder has finished; None if nothing
    is known of it (it may just have begun, or died before it left a trace).
    The next turn can be created once, so of several that find the holder
    finished one gets it. The holder itself may take its turn again.
    """
    turns = _generations(spark, folder)
    if turns:
        path = f"{folder}/g={turns[-1]}"
        holder = owner_of(spark, path)
        if holder == owner:
            return True
        over = is_over(holder) if holder else None
        if over is None:
            fs, where = _file(spark, path)
            over = time.time() - fs.getFileStatus(where).getModificationTime() / 1000 > _UNKNOWN_FOR_S
        if not over:
            return False
    if not take(spark, f"{folder}/g={turns[-1] + 1 if turns else 0}", owner):
        return False
    for n in turns[:-1]:
        drop(spark, f"{folder}/g={n}")
    return True


def give_back(spark: SparkSession, folder: str, owner: str) -> None:
    """Undo the turn that ``owner`` has just taken and not used."""
    turns = _generations(spark, folder)
    if turns and owner_of(spark, f"{folder}/g={turns[-1]}") == owner:
        drop(spark, f"{folder}/g={turns[-1]}")
