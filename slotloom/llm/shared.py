"""Shared folder, intermediate tables and byte-level text access for the training-data operators.

Intermediate tables and model files go to the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor never takes an intermediate result with it.  Only
where that setting is absent (tests, a laptop) is a local temporary folder used.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_own_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI or path; a private temporary one only if none is configured."""
    global _own_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="slotloom-")
        atexit.register(shutil.rmtree, _own_root, True)
    return _own_root


_work: set[str] = set()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; the folder is removed when the driver ends, or by ``clean_up``."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _work.add(path)
    return path


def remove(path: str) -> None:
    """Remove a work folder, on any file system; one that is not there, or cannot be reached any more, is left."""
    _work.discard(path)
    if is_local(path):
        shutil.rmtree(local_path(path), True)
        return
    from pyarrow import fs

    try:
        store, target = fs.FileSystem.from_uri(path)
        store.delete_dir(target)
    except (OSError, pa.ArrowException):
        pass


@atexit.register
def clean_up() -> None:
    """Remove all work folders of this driver; results that have not been written yet can then not be read."""
    for path in list(_work):
        remove(path)


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local_path(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and survives lost executors."""
    return stored_at(df, label, compression)[0]


def stored_at(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for tables that are removed once the next one is written."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def put_file(path: str, pieces) -> int:
    """Write byte pieces to ``path`` in the shared folder; a rename at the end makes retries harmless."""
    size = 0
    if is_local(path):
        target = local_path(path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            for piece in pieces:
                size += out.write(piece)
        os.replace(part, target)
        return size
    from pyarrow import fs

    store, target = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(target), recursive=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    store.move(part, target)
    return size


_KINDS = ("u1", "<u2", "<u4", "<u8", "<i8", "<f8")
_opened: dict[str, np.ndarray | None] = {}


def put_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after another, each from a place that is a multiple of 8, after a table of kinds and lengths."""
    head = np.array([len(arrays), *(n for x in arrays for n in (_KINDS.index(x.dtype.str.lstrip("|")), len(x)))], "<i8")
    put_file(path, [head.tobytes(), *(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays)])


def open_arrays(path: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; none if there is no such file.

    A worker maps each file once, and fetches a remote one once, into a copy without a name; it lets go of them
    when it opens files of another folder.
    """
    if _opened and path.rpartition("/")[0] != next(iter(_opened)).rpartition("/")[0]:
        _opened.clear()
    if path not in _opened:
        try:
            _opened[path] = mapped(path)
        except FileNotFoundError:
            _opened[path] = None
    data = _opened[path]
    return [] if data is None else _parted(data)


def read_arrays(path: str) -> list[np.ndarray]:
    """The arrays of a file that is read once, whole."""
    return _parted(np.frombuffer(get_file(path), np.uint8))


def _parted(data: np.ndarray) -> list[np.ndarray]:
    head = data[8 : 8 + 16 * int(data[:8].view("<i8")[0])].view("<i8").reshape(-1, 2).tolist()
    at, found = 8 + 16 * len(head), []
    for kind, n in head:
        size = n * np.dtype(_KINDS[kind]).itemsize
        found.append(data[at : at + size].view(_KINDS[kind]))
        at += size + -size % 8
    return found


def mapped(path: str) -> np.ndarray:
    """A file's bytes, mapped into memory; of a remote one a copy without a name."""
    if is_local(path):
        return np.memmap(local_path(path), np.uint8, "r")
    from pyarrow import fs

    store, target = fs.FileSystem.from_uri(path)
    handle, copy = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, store.open_input_stream(target) as source:
            shutil.copyfileobj(source, out)
        return np.memmap(copy, np.uint8, "r")
    finally:
        os.unlink(copy)


def drop_file(path: str) -> None:
    """Remove a file of the shared folder, if it is there."""
    try:
        if is_local(path):
            os.unlink(local_path(path))
        else:
            from pyarrow import fs

            store, target = fs.FileSystem.from_uri(path)
            store.delete_file(target)
    except FileNotFoundError:
        pass


def get_file(path: str) -> bytes:
    if is_local(path):
        with open(local_path(path), "rb") as source:
            return source.read()
    from pyarrow import fs

    store, target = fs.FileSystem.from_uri(path)
    with store.open_input_stream(target) as source:
        return source.read()


def key_crc(column: str) -> Column:
    """Unsigned crc32 of a key written as text; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut a batch so that no piece holds much over ``most_bytes`` of text (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


#: Rows of an Arrow batch; a batch of ten thousand long texts would not fit beside the worker's own data.
BATCH_ROWS = 2_000


def release() -> None:
    """Give freed memory back to the system: workers live on and would keep it from the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows (a setting of the session) and memory released after each task."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def labelled_sample(labels: DataFrame, grade: str, most_rows: int, modulus: int) -> DataFrame:
    """Ids and grades of at most about ``most_rows`` labelled rows, none of them held out.

    Held-out ids (crc32 of the id as text divisible by ``modulus``) never enter.  Rows are taken by the
    order of a hash of the id, so the sample does not depend on partitioning.  Null ids and grades are
    ignored; of repeated ids the greatest grade counts.
    """
    rows = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(grade).cast("int").alias("grade"))
        .where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & (key_crc("doc_id") % modulus != 0))
        .groupBy("doc_id")
        .agg(F.max("grade").alias("grade"))
    )
    total = rows.count()
    if total <= most_rows:
        return rows
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return rows.where(spread < int((1 << 30) * most_rows / total))
