"""Folders that jobs share: versions of stored tables, work folders.

A stored table is a folder with data below ``_data`` and, below ``_versions``,
a numbered file for each version that names what it is made of. A writer fills
new folders first and then creates the next number; only one writer can. So
readers find one whole version whatever happens to writers, and one who comes
too late reads again and tries the number after.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

#: Spark's readers skip names that begin so.
VERSIONS, DATA = "_versions", "_data"
#: Times that a writer tries to be the next.
TRIES = 50


class Version(NamedTuple):
    """``parts`` takes the name of a part to its folder below the table's data; a table that is written whole has one part, ``""``."""

    number: int
    parts: dict[str, str]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.mkdtemp(prefix="spark-storeops-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _store(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _read(spark: SparkSession, path: str) -> dict[str, str]:
    fs, at = _store(spark, path)
    stream = spark.sparkContext._jvm.java.util.Scanner(fs.open(at), "UTF-8").useDelimiter("\\A")
    try:
        return json.loads(stream.next())
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/{VERSIONS}") if re.fullmatch(r"\d{12}", n))


def latest(spark: SparkSession, path: str) -> Version | None:
    """The last version at ``path``, None where nothing was published."""
    for number in reversed(versions(spark, path)):
        return Version(number, _read(spark, f"{path}/{VERSIONS}/{number:012d}"))
    return None


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last version of a table that is written whole; the path itself where it holds files that came another way, None where it holds nothing."""
    found = latest(spark, path)
    if found:
        return f"{path}/{DATA}/{found.parts['']}"
    fs, at = _store(spark, path)
    plain = fs.exists(at) and (fs.getFileStatus(at).isFile() or any(n[0] not in "_." for n in _names(spark, path)))
    return path if plain else None


def _claim(spark: SparkSession, path: str, version: Version) -> bool:
    """Creates the file of a version, whole, unless there is one; whether it did."""
    fs, staged = _store(spark, f"{path}/{VERSIONS}/_{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    out = fs.create(staged, False)
    out.write(json.dumps(version.parts).encode())
    out.close()
    _, target = _store(spark, f"{path}/{VERSIONS}/{version.number:012d}")
    try:
        if fs.getUri().getScheme() == "file":  # where Hadoop looks before it renames, in two steps
            jvm.java.nio.file.Files.createLink(*(jvm.java.nio.file.Path.of(p.toUri()) for p in (target, staged)))
        else:
            never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, target, never)
        return True
    except Py4JError:
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(staged, False)


def commit(spark: SparkSession, path: str, change: Callable[[Version | None], dict[str, str] | None]) -> Version | None:
    """Publishes the parts that ``change`` makes of the last version.

    ``change`` fills new folders (:func:`new_data`) and returns what the next
    version is made of, or None to leave all as it is. Where another writer
    was first, it is called again with that writer's version, so nothing is
    lost. A file system other than the local one must rename in one step and
    refuse to rename onto a file, as HDFS does.
    """
    for _ in range(TRIES):
        base = latest(spark, path)
        parts = change(base)
        if parts is None:
            return None
        version = Version(base.number + 1 if base else 1, parts)
        if _claim(spark, path, version):
            return version
    raise RuntimeError(f"{path}: {TRIES} times another writer was first")


def new_data() -> str:
    return f"v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> Version:
    """Lets ``write`` fill a new folder and makes it the whole content of ``path``; of several who do so, the last stays."""
    name = new_data()
    write(f"{path}/{DATA}/{name}")
    return commit(spark, path, lambda _: {"": name})


def clean(spark: SparkSession, path: str, hours: float = 168) -> list[str]:
    """Deletes versions that were replaced over so many hours ago, and the data that only those name; what it deleted.

    Data that no version names is left alone, since its writer may be about to publish it.
    """
    numbers = versions(spark, path)
    before = (time.time() - 3600 * hours) * 1000
    gone = []
    for number, after in zip(numbers, numbers[1:], strict=False):
        fs, at = _store(spark, f"{path}/{VERSIONS}/{after:012d}")
        if fs.getFileStatus(at).getModificationTime() > before:
            break
        gone.append(number)
    parts = {n: _read(spark, f"{path}/{VERSIONS}/{n:012d}") for n in numbers}
    kept = {f for n in numbers if n not in gone for f in parts[n].values()}
    old = sorted({f for n in gone for f in parts[n].values()} - kept)
    for number in gone:  # first, so that no version names data that is gone
        remove(spark, f"{path}/{VERSIONS}/{number:012d}")
    for name in old:
        remove(spark, f"{path}/{DATA}/{name}")
    return old


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that fit a pattern."""
    fs, at = _store(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(at) or []]


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _store(spark, path)
    fs.delete(at, True)
