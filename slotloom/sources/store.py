"""Versioned store of partitioned tables: a write costs what it touches, and of two writers at once one is refused.

A table's parts are folders: entries by slot and by run of places, revisions by slot, the others whole.  A write puts
the new content of the parts that it touches into a version folder of its own and publishes a numbered state,
which lists the versions that make up each part.  Nothing is written where it is read, and a writer that dies leaves
the last state as it was.  A state's number can be published once: who worked on an older state gets a
``Conflict``, and nothing of that write remains.  Parts that none of the last states lists are removed.
Ids come from a high-water mark that only rises.
"""

from __future__ import annotations

import copy
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotloom.plans.schema import ENTRIES, GRAM_COUNTS, GRAMS, LIST_REVISIONS, REVISION_PIECES, REVISIONS, TERM_LISTS, UPLOADS

TABLES = {
    "entries": ENTRIES, "term_lists": TERM_LISTS, "revisions": REVISIONS, "revision_pieces": REVISION_PIECES, "list_revisions": LIST_REVISIONS, "grams": GRAMS, "gram_counts": GRAM_COUNTS, "uploads": UPLOADS,
}
#: Columns whose values name a table's parts, from the outside in.
PARTS = {"entries": ("file_key", "run"), "revisions": ("file_key",), "revision_pieces": ("file_key", "seq"), "grams": ("bucket",), "gram_counts": ("bucket",)}
#: Tables whose parts are too large for a task each: columns by whose ranges their rows are dealt instead.
RANGES = {"grams": ("bucket", "gram", "block"), "gram_counts": ("bucket", "gram")}
#: Values of a column that one task has of a part, where a part is too large for a task.
SHARES = {"entries": ("entry_index", 1 << 13), "revision_pieces": ("piece", 16)}
#: What rows are ordered by within a part, so that files and their pages have narrow ranges.
ORDER = {"entries": "id", "revisions": "seq", "revision_pieces": "piece", "grams": "gram", "gram_counts": "gram"}
#: Places of a slot that one part holds; last states whose files are kept, so long may a reader work on one of them.
PLACES = 1 << 18
KEEP = 2
_NEW = {"number": 0, "tables": {}, "next_id": 1, "next_seq": 1, "streams": {}, "marks": {}}


class Conflict(Exception):
    """Another writer published a state first; nothing of the refused write remains."""


@dataclass
class Change:
    """New rows of a table, and the parts that they stand in for: all if None; none if empty, which adds rows.

    Rows may be made of those that the same write has put into a table before it, which are then read and not computed again.
    """

    rows: DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame] | None
    replaces: Iterable[str] | None = None


class Store:
    """Tables of one folder, on any file system that Spark's Hadoop layer can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # states

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/states")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self, number: int) -> dict:
        source, held = self._fs.open(self._path(f"{self.path}/states/{number}.json")), self._jvm.java.io.ByteArrayOutputStream()
        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, held, 4096, True)
        return json.loads(held.toString(self._jvm.java.nio.charset.StandardCharsets.UTF_8))

    def state(self) -> dict:
        """The last state: versions of each part, the id mark, the revision sequence, each stream's last batch, and marks."""
        numbers = self._numbers()
        return self._state(numbers[-1]) if numbers else copy.deepcopy(_NEW)

    def _publish(self, state: dict) -> None:
        """Put a state under its number, whole and only if there is none yet."""
        target, part = f"{self.path}/states/{state['number']}.json", f"{self.path}/states/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(urlparse(part).path, urlparse(target).path)  # a rename would check and act in two steps here
            else:
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(self._path(part), self._path(target), options)
        except FileExistsError as e:
            raise Conflict(f"state {state['number']} is there already") from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"state {state['number']} is there already") from e
            raise
        finally:
            self._fs.delete(self._path(part), False)

    # reading

    def parts(self, table: str, state: Mapping | None = None, slots: Iterable[str] | None = None) -> list[str]:
        """The parts of a table, or of some slots (by file_key) only."""
        every = (state or self.state())["tables"].get(table, {})
        if slots is None:
            return sorted(every)
        wanted = {f"file_key={s}" for s in slots}
        return sorted(p for p in every if p.split("/")[0] in wanted)

    def read(self, table: str, state: Mapping | None = None, parts: Iterable[str] | None = None, run: bool = False) -> DataFrame:
        """A table, or some of its parts only; predicates on the columns that name parts reach the choice of files."""
        state, schema = state or self.state(), TABLES[table]
        every = state["tables"].get(table, {})
        own = T.StructType([*schema.fields, *([T.StructField("run", T.LongType())] if table == "entries" else [])])
        paths = [self._folder(table, p, v) for p in (every if parts is None else parts) for v in every[p]]
        columns = [*schema.names, *(["run"] if run else [])]
        if not paths:
            return self.spark.createDataFrame([], own).select(*columns)
        return self.spark.read.schema(own).option("basePath", f"{self.path}/{table}").parquet(*paths).select(*columns)

    def _folder(self, table: str, part: str, version: str) -> str:
        return f"{self.path}/{table}/version={version}" + (f"/{part}" if part else "")

    def files(self, state: Mapping | None = None) -> dict[str, set[str]]:
        """Data files by part (``table/part``)."""
        state, found = state or self.state(), {}
        for table, parts in state["tables"].items():
            for part, versions in parts.items():
                names = (f.getPath() for v in versions for f in self._fs.listStatus(self._path(self._folder(table, part, v))))
                found[f"{table}/{part}"] = {n.toString() for n in names if n.getName().startswith("part-")}
        return found

    # writing

    def commit(self, base: Mapping, changes: Mapping[str, Change], next_id: int = 1, streams: Mapping[str, int] | None = None, marks: Mapping | None = None) -> dict:
        """Write changes of some tables and publish them together as the state after ``base``."""
        new = copy.deepcopy(dict(base))
        new["number"] += 1
        new["next_id"], new["next_seq"] = max(new["next_id"], next_id), new["next_seq"] + 1
        new["streams"] |= streams or {}
        new["marks"] |= marks or {}
        written, fresh = [], {}

        def just_written(table: str) -> DataFrame:
            return self.read(table, {"tables": {table: fresh[table]}})

        try:
            for table, change in changes.items():
                parts = new["tables"].setdefault(table, {})
                for part in list(parts) if change.replaces is None else change.replaces:
                    parts.pop(part, None)
                if change.rows is not None:
                    version = f"v{uuid.uuid4().hex}"
                    written.append(f"{self.path}/{table}/version={version}")
                    rows = change.rows if isinstance(change.rows, DataFrame) else change.rows(just_written)
                    own = self._write(table, rows, written[-1])
                    fresh[table] = {part: [version] for part in own}
                    for part in own:
                        parts.setdefault(part, []).append(version)
                    if not own:  # there were no rows
                        self._fs.delete(self._path(written[-1]), True)
            self._publish(new)
        except BaseException:
            for folder in written:
                self._fs.delete(self._path(folder), True)
            raise
        self._sweep()
        return new

    def _write(self, table: str, rows: DataFrame, folder: str) -> list[str]:
        by = PARTS.get(table, ())
        columns = [F.col(f.name).cast(f.dataType) for f in TABLES[table]]
        if "run" in by:
            columns.append(F.floor(F.col("entry_index") / PLACES).alias("run"))
        rows = rows.select(*columns)
        if not by:
            rows.write.parquet(folder)
            return [""]
        share = [F.floor(F.col(column) / size) for column, size in [SHARES[table]]] if table in SHARES else []
        dealt = rows.repartitionByRange(*RANGES[table]) if table in RANGES else rows.repartition(*by, *share)
        dealt.sortWithinPartitions(*by, ORDER[table]).write.partitionBy(*by).parquet(folder)
        depth = len(self._path(folder).toUri().getPath().rstrip("/")) + 1
        found = self._fs.globStatus(self._path(folder + "/*=*" * len(by)))
        return [f.getPath().toUri().getPath()[depth:] for f in found]

    def _sweep(self) -> None:
        """Remove states but the last ``KEEP``, and parts that only removed states list."""
        numbers = self._numbers()
        old, kept = numbers[:-KEEP], [self._state(n) for n in numbers[-KEEP:]]
        listed = lambda states: {self._folder(t, p, v) for s in states for t, parts in s["tables"].items() for p, own in parts.items() for v in own}
        needed = listed(kept)
        for number in old:
            for folder in listed([self._state(number)]) - needed:
                self._fs.delete(self._path(folder), True)
                above = self._path(folder).getParent()
                while above.getName() not in TABLES and self._fs.exists(above) and not any(f.isDirectory() for f in self._fs.listStatus(above)):
                    self._fs.delete(above, True)
                    above = above.getParent()
            self._fs.delete(self._path(f"{self.path}/states/{number}.json"), False)

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Remove version folders that no state lists and that are older than some seconds: what writers that died left behind."""
        states = [self._state(n) for n in self._numbers()]
        listed = {f"{t}/version={v}" for s in states for t, parts in s["tables"].items() for own in parts.values() for v in own}
        limit, removed = (time.time() - older_than) * 1000, []
        for table in TABLES:
            for folder in self._fs.globStatus(self._path(f"{self.path}/{table}/version=*")) or []:
                name = f"{table}/{folder.getPath().getName()}"
                if name not in listed and folder.getModificationTime() < limit:
                    self._fs.delete(folder.getPath(), True)
                    removed.append(name)
        return removed

    def with_ids(self, rows: DataFrame, first: int) -> tuple[DataFrame, int]:
        """``rows`` (file_key, entry_index, ...) with ids from ``first`` on, and the first id not used.

        Places are numbered from 1 without gaps in each slot, so an id is its slot's start and the place; the
        slots' starts come from their counts, one row for each slot.
        """
        counts = rows.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
        starts = counts.select("file_key", (F.sum("n").over(Window.orderBy("file_key")) - F.col("n") + first).alias("start"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return rows.join(starts, "file_key").withColumn("id", F.col("start") + F.col("entry_index") - 1).drop("start"), first + total
