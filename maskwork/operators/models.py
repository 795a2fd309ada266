"""Model files for injected engines: sent to every worker once, and made into an engine once in each worker process."""

from __future__ import annotations

import hashlib
import os
import shutil
import threading
import uuid
import warnings
from collections.abc import Callable
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_engines: dict[tuple[str, str], Any] = {}
_lock = threading.Lock()


def kept(key: tuple[str, str], make: Callable[[], Any]) -> Any:
    """What ``make`` returned the first time in this process.  Workers are used again for later tasks, unless
    ``spark.python.worker.reuse`` is off, and so outlive the task that made it."""
    with _lock:
        if key not in _engines:
            _engines[key] = make()
        return _engines[key]


def model_loader(spark: SparkSession, path: str, build: Callable[[str], Any]) -> Callable[[], Any] | None:
    """A ``load`` for the operators that take one: ``build(local path of the file)``, once in each worker process.

    The file is read here and sent to the workers by ``addFile``; engines are known by its content and by what builds them, so
    another file under the same path is another engine, and one file under two paths is one.  Where there is no such file,
    there is a warning and no ``load``: operators then find nothing, and what needs no model goes on.
    """
    if not os.path.isfile(path):
        warnings.warn(f"there is no model at {path}; what it would find is left out", stacklevel=2)
        return None
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    name = f"{digest.hexdigest()[:32]}-{os.path.basename(path)}"
    _send(spark, path, name)
    key = (digest.hexdigest(), f"{build.__module__}.{build.__qualname__}")
    return lambda: kept(key, lambda: build(SparkFiles.get(name)))


_sent: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str, name: str) -> None:
    """Send the file under a name of its content: two files of one base name do not meet, and one is sent once."""
    app = spark.sparkContext.applicationId
    with _lock:
        if (app, name) in _sent:
            return
        folder = os.path.join(SparkFiles.getRootDirectory(), f"models-{uuid.uuid4().hex}")
        os.makedirs(folder)
        shutil.copyfile(path, os.path.join(folder, name))  # no link, as files are sent under the name that a link leads to
        spark.sparkContext.addFile(os.path.join(folder, name))
        _sent.add((app, name))
