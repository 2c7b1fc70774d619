"""Folders for intermediate files: in the cluster's shared folder, or a private one where none is configured."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_own: str | None = None
_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; the folder is removed when the driver ends."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if _own is None:
            _own = tempfile.mkdtemp(prefix="slotloom-")
            _made.append(_own)
        root = _own
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _clear() -> None:
    for path in _made:
        place = urlparse(path)
        if place.scheme in ("", "file"):
            shutil.rmtree(place.path, True)
            continue
        from pyarrow import ArrowException, fs

        try:
            store, target = fs.FileSystem.from_uri(path)
            store.delete_dir(target)
        except (OSError, ArrowException):  # not there, or out of reach by now
            pass
