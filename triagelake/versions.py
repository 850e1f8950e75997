"""Versions of a stored table: readers follow a manifest, and one of two writers wins.

A version is a data folder and a manifest that names it. Manifests are numbered and are put in
place in one step that fails where one of that number is there already: a hard link on a local
file system, a rename elsewhere, which HDFS refuses onto a file that exists. (A store whose rename
replaces files gives readers whole versions too, but does not tell two writers apart.) Nothing a
reader may be using is changed: it sees the old version or the new one. Manifests are never
deleted, so a late writer cannot take a number again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from triagelake.session import delete_path

#: Versions whose data stays for readers that started earlier.
KEPT = 2
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has published that version."""


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    target, system = _target(spark, folder)
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target))


def root_of(spark: SparkSession, path: str) -> str:
    """Where the versions lie: in the folder itself, or beside a single file."""
    target, system = _target(spark, path)
    single = system.exists(target) and system.getFileStatus(target).isFile()
    return path.rstrip("/") + (".versions" if single else "")


def newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and data folder of the newest version; (0, None) without any."""
    root = root_of(spark, path)
    found = [n for n in _names(spark, f"{root}/manifest") if n.isdigit()]
    if not found:
        return 0, None
    target, system = _target(spark, f"{root}/manifest/{found[-1]}")
    stream = system.open(target)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(found[-1]), f"{root}/data/{name}"


def _put(spark: SparkSession, written: str, place: str) -> bool:
    source, system = _target(spark, written)
    target, _ = _target(spark, place)
    system.mkdirs(target.getParent())
    if system.getUri().getScheme() == "file":
        local = [unquote(urlparse(system.makeQualified(p).toString()).path)
                 for p in (source, target)]
        try:
            os.link(*local)
        except FileExistsError:
            return False
        return True
    return not system.exists(target) and system.rename(source, target)


def publish(spark: SparkSession, path: str, number: int, name: str) -> None:
    """Makes the data folder ``name`` version ``number``, or raises ``Conflict``."""
    root = root_of(spark, path)
    written = f"{root}/pending/{uuid.uuid4().hex}"
    target, system = _target(spark, written)
    out = system.create(target, False)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    won = _put(spark, written, f"{root}/manifest/{number:012d}")
    delete_path(spark, written)
    if not won:
        raise Conflict(f"version {number} of {path} exists already")


def forget_old(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Deletes the data of versions before the last ``kept``, also of writers that did not win."""
    root = root_of(spark, path)
    number, _ = newest(spark, path)
    for name in _names(spark, f"{root}/data"):
        if int(name.split("-")[0]) <= number - kept:
            delete_path(spark, f"{root}/data/{name}")


def update(
    spark: SparkSession, path: str, build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None],
) -> int:
    """Writes what ``build`` makes of the newest version as the next one; returns its number.

    ``build`` reads the newest version itself. If another writer was faster, it is called again
    on that writer's version, so neither update is lost.
    """
    for _ in range(ATTEMPTS):
        number = newest(spark, path)[0] + 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        write(build(), f"{root_of(spark, path)}/data/{name}")
        try:
            publish(spark, path, number, name)
        except Conflict:
            continue
        forget_old(spark, path)
        return number
    raise Conflict(f"{path} was changed by others {ATTEMPTS} times in a row")
