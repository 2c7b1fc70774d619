"""Whole texts as named files, and their digests: executors stream them, the driver publishes or discards them.

The data source takes rows (file_name, span, offset, bytes), dealt by name and span of bytes and ordered, and writes each
span to a hidden, compressed part file, so a text of any size spreads over tasks.  One task for each name then streams its
parts one after another into a hidden file, block by block; the driver renames the files once all are done, and removes the
parts and what lost executors or failed tasks left.  Digests of whole texts are taken the same way from parts or files:
by their definition bytes follow one another, so one task reads a text, but no task holds more than a block of it.  No byte
passes the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from slotloom.plans.schema import DEFAULT, Registry
from slotloom.sources.scratch import scratch

#: Bytes of a text that one part file holds, of a block that is read at once, and names above which tasks have several.
SPAN = 64 << 20
_BLOCK = 4 << 20
_TASKS = 512
_PACKED = "zstd"


class _Folder:
    """A folder, local or on a file system that Arrow reaches."""

    def __init__(self, path: str):
        from pyarrow import fs

        place = urlparse(path)
        if place.scheme in ("", "file"):
            self.store, self.path = fs.LocalFileSystem(), os.path.abspath(place.path)
        else:
            self.store, self.path = fs.FileSystem.from_uri(path)

    def open(self, name: str, packed: str | None = None):
        self.store.create_dir(self.path, recursive=True)
        return self.store.open_output_stream(f"{self.path}/{name}", compression=packed)

    def blocks(self, name: str, packed: str | None = None) -> Iterator[bytes]:
        with self.store.open_input_stream(f"{self.path}/{name}", compression=packed) as source:
            while block := source.read(_BLOCK):
                yield block

    def move(self, name: str, to: str) -> None:
        self.store.move(f"{self.path}/{name}", f"{self.path}/{to}")

    def names(self) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True)) if f.is_file)

    def clear(self, begin: str) -> None:
        """Remove files whose names begin so."""
        for name in self.names():
            if name.startswith(begin):
                self.store.delete_file(f"{self.path}/{name}")


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[str, str, int]]


class _Writer(DataSourceWriter):
    """Hidden files carry the write's mark, so that what lost executors left can be told and removed."""

    def __init__(self, path: str, mark: str):
        self.path, self.mark = path, mark

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        folder, done, out, last = _Folder(self.path), [], None, None
        task = f"{self.mark}{uuid.uuid4().hex}-"
        try:
            for row in rows:
                if last != (row.file_name, row.span):
                    if out is not None:
                        out.close()
                    last = (row.file_name, row.span)
                    done.append((row.file_name, f"{task}{len(done)}", row.span))
                    out = folder.open(done[-1][1], _PACKED)
                out.write(bytes(row.bytes))
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            folder.clear(task)
            raise
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [p for message in messages if message for p in message.parts]
        with _Folder(self.path).open(f"{self.mark}parts") as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _Folder(self.path).clear(self.mark)


class Downloads(DataSource):
    """Sink ``slot_downloads``; ``path`` is the folder of the files, ``mark`` begins the names of parts."""

    @classmethod
    def name(cls) -> str:
        return "slot_downloads"

    def schema(self) -> str:
        return "file_name string, span long, offset long, bytes binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["mark"])


def _parts(pieces: DataFrame, folder: str, mark: str) -> dict[str, list[str]]:
    """Write pieces (file_name, offset, bytes) to part files; each name's parts in order, one for each ``SPAN`` bytes."""
    pieces.sparkSession.dataSource.register(Downloads)
    spanned = pieces.select("file_name", F.floor(F.col("offset") / SPAN).alias("span"), "offset", "bytes")
    dealt = spanned.repartition("file_name", "span").sortWithinPartitions("file_name", "span", "offset")
    dealt.write.format("slot_downloads").option("path", folder).option("mark", mark).mode("append").save()
    found: dict[str, list[str]] = {}
    for name, hidden, _ in sorted(json.loads(b"".join(_Folder(folder).blocks(f"{mark}parts"))), key=lambda p: (p[0], p[2])):
        found.setdefault(name, []).append(hidden)
    return found


def _streamed(spark: SparkSession, folder: str, parts: dict[str, list[str]], packed: str | None, into: str | None = None) -> list[Row]:
    """name, hidden, byte_length, digest of each name's parts one after another; with ``into`` they go to files whose names begin so."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Folder(folder)
        for batch in batches:
            for name, own in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                hidden = f"{into}{uuid.uuid4().hex}" if into else ""
                out, hashed, size = place.open(hidden) if into else None, hashlib.md5(usedforsecurity=False), 0
                for part in own:
                    for block in place.blocks(part, packed):
                        hashed.update(block)
                        size += len(block)
                        if out is not None:
                            out.write(block)
                if out is not None:
                    out.close()
                yield pa.RecordBatch.from_pydict({"name": [name], "hidden": [hidden], "byte_length": pa.array([size], pa.int64()), "digest": [hashed.hexdigest()]})

    if not parts:
        return []
    tasks = min(len(parts), _TASKS)
    rows = spark.createDataFrame([(k % tasks, name, own) for k, (name, own) in enumerate(sorted(parts.items()))], "task int, name string, parts array<string>")
    return rows.repartitionById(tasks, F.col("task")).mapInArrow(streamed, "name string, hidden string, byte_length long, digest string").collect()


def write_named(pieces: DataFrame, folder: str) -> None:
    """Write pieces (file_name, offset, bytes) to the files that they name below ``folder``."""
    mark, place = f".{uuid.uuid4().hex}-", _Folder(folder)
    try:
        done = _streamed(pieces.sparkSession, folder, _parts(pieces, folder, mark), _PACKED, f"{mark}whole-")
        for row in done:
            place.move(row.hidden, row.name)
    finally:
        place.clear(mark)


def written(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, byte_length, digest (MD5) of the files of a folder as they are read back."""
    names = [n for n in _Folder(folder).names() if not n.startswith(".")]
    return _frame(spark, "file_name", _streamed(spark, folder, {n: [n] for n in names}, None))


def text_digests(pieces: DataFrame, key: str) -> DataFrame:
    """key, byte_length, digest (MD5) of whole texts given as pieces (key: a string, offset, bytes), one row for each text."""
    spark, mark = pieces.sparkSession, f".{uuid.uuid4().hex}-"
    folder = scratch(spark, "texts")
    try:
        return _frame(spark, key, _streamed(spark, folder, _parts(pieces.withColumnRenamed(key, "file_name"), folder, mark), _PACKED))
    finally:
        _Folder(folder).clear(mark)


def _frame(spark: SparkSession, key: str, rows: list[Row]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.byte_length, r.digest) for r in rows], f"{key} string, byte_length long, digest string")


def write(entries: DataFrame, folder: str, registry: Registry = DEFAULT) -> None:
    """Write each registered slot's text to the file that its download names, byte for byte, in pieces of bounded size."""
    from slotloom.operators.chunks import chunks
    from slotloom.sources.files import download_names

    names = F.broadcast(download_names(entries.sparkSession, registry))  # dealing chunks by slot would put each slot in one task
    pieces = chunks(entries).join(names, "file_key").select("file_name", "offset", "bytes")
    write_named(pieces.unionByName(names.select("file_name", F.lit(0).cast("long").alias("offset"), F.lit(b"").alias("bytes"))), folder)
