"""The engine: the reads and writes that a client of the slots makes, with typed outcomes.

Writes compute new parts of tables as DataFrames and publish them as one state.  The time is an argument.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import datetime
from enum import Enum

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from slotloom.functions.text import slot_key, trim
from slotloom.operators import entries as E
from slotloom.operators import chunks, digests, gramindex, migration, replacing, revisions, search, terms
from slotloom.plans.schema import DEFAULT, ENTRIES, REVISIONS, Registry
from slotloom.sources import downloads, files
from slotloom.sources.legacy import probe
from slotloom.sources.store import Change, Conflict, Store


class Outcome(Enum):
    """What became of a request."""

    # fixed values: codes that clients rely on
    SAVED = "saved"
    UPLOADED = "uploaded"
    CLEARED = "cleared"
    LISTS_SAVED = "entity_lists_saved"
    RESULTS_SAVED = "search_results_saved"
    RESULTS_DELETED = "search_results_deleted"
    RESULT_MISSING = "search_result_missing"
    REPLACED = "search_replace_saved"
    REPLACE_NO_MATCHES = "search_replace_no_matches"
    REPLACE_MISSING = "search_replace_missing"
    UPLOAD_MISSING = "upload_missing"
    UPLOAD_INVALID = "upload_invalid"
    UPLOAD_UNREADABLE = "upload_read_failed"
    RESTORED = "revision_restored"
    REVISION_MISSING = "revision_missing"
    # an extension: another writer was faster, and nothing has changed
    CONFLICT = "write_conflict"


#: Ids up to which they are looked up by value, which lets the scan skip what cannot hold them.
FEW_IDS = 1_000
#: A place behind all entries of a slot.
_LAST = 1 << 62
#: Pages that are taken from the top of all hits; a hundred pages of hits fit in any task.
FIRST_PAGES = 100


class Engine:
    """Slots, term lists and their histories in one store.

    Every write works on the state that it read first; where another writer was faster, the outcome is a
    conflict and nothing has changed.  A write reads and rewrites the parts of the slots that it touches.
    """

    def __init__(self, spark: SparkSession, path: str, registry: Registry = DEFAULT, legacy: DataFrame | str | None = None, now: datetime | None = None):
        """Open a store; a legacy table (or the name or folder of one, if it is there) is migrated once."""
        self.spark, self.registry, self.store = spark, registry, Store(spark, path)
        if legacy is not None:
            self._migrate(legacy, now or datetime.now())

    def _migrate(self, legacy: DataFrame | str, now: datetime) -> None:
        base = self.store.state()
        if base["marks"].get("migrated"):
            return
        found = probe(self.spark, legacy) if isinstance(legacy, str) else legacy
        if found is None:
            return
        moved, after = self._stamped(base, migration.migrate(found, self.store.read("entries", base), self.registry), now)
        try:
            self.store.commit(base, {"entries": Change(moved, ())} | self._indexed(base, moved), after, marks={"migrated": True})
        except Conflict:  # another client has opened the store meanwhile
            self._migrate(legacy, now)

    # reads

    def entries(self) -> DataFrame:
        return self.store.read("entries")

    def slot(self, slot: str) -> DataFrame:
        """The entries of one slot in order; only its files are read."""
        return E.of_slot(self.entries(), slot, self.registry)

    def text(self, slot: str) -> str:
        key = E._normal(slot, self.registry)
        return E.compose(self.entries().where(F.col("file_key") == key), self.registry).where(F.col("file_key") == key).first().content

    def search(self, keyword: str = "", chosen: Mapping[int, str] | None = None, page: int = 1) -> DataFrame:
        """One page of hits for a keyword and one chosen term of each list; choices that are no members are ignored.

        The first pages are the top of one pass; later ones are sought by rank, in two.
        """
        found = self.hits(keyword, chosen)
        return search.page(found, page, self.registry) if page <= FIRST_PAGES else search.page_by_rank(found, page, self.registry)

    def hits(self, keyword: str = "", chosen: Mapping[int, str] | None = None) -> DataFrame:
        """All hits; with an index, only entries that share rare pieces with a needle are looked at."""
        state = self.store.state()
        rows = self.spark.createDataFrame(sorted((chosen or {}).items()), "list_index int, choice string")
        valid = search.selected_terms(self.store.read("term_lists", state), rows).orderBy("list_index").collect()
        terms_, entries = [r.term for r in valid], self.store.read("entries", state)
        if state["marks"].get("indexed"):
            postings, counts = self.store.read("grams", state), self.store.read("gram_counts", state)
            entries = gramindex.narrowed(entries, postings, counts, search.needles(keyword, terms_))
        return search.search(entries, keyword, terms_)

    def preview(self, slot: str, find: str, replacement: str) -> DataFrame:
        return replacing.preview(self.entries(), slot, find.strip(" \n\r\t\x0b\x00"), replacement, self.registry)

    def history(self, slot: str) -> DataFrame:
        key, state = E._normal(slot, self.registry), self.store.state()
        heads = self.store.read("revisions", state, self.store.parts("revisions", state, [key]))
        pieces = self.store.read("revision_pieces", state, self.store.parts("revision_pieces", state, [key]))
        texts = pieces.groupBy("file_key", "seq").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY piece)").alias("content"))
        rows = heads.join(texts, ["file_key", "seq"]).select("file_key", "seq", "content", "saved_at")
        return revisions.stored_revisions(rows, self.registry).where(F.col("file_key") == key).orderBy("position")

    # writes

    def save(self, slot: str, text: str, now: datetime, outcome: Outcome = Outcome.SAVED) -> Outcome:
        """Save a slot whole; its old text becomes a revision if the new one differs in any entry."""
        own = self.spark.createDataFrame([(E._normal(slot, self.registry), text)], "file_key string, content string")
        return self._save(slot, lambda old: E.with_entries(own), now, outcome)

    def _save(self, slot: str, new: Callable[[DataFrame], DataFrame], now: datetime, outcome: Outcome, base: dict | None = None, **more) -> Outcome:
        """Save what ``new`` makes of the slot's old entries: its new ones (file_key, entry_index, content); no text is composed."""
        key, base = E._normal(slot, self.registry), base or self.store.state()
        parts = self.store.parts("entries", base, [key])
        old = self.store.read("entries", base, parts).where(F.col("file_key") == key)
        entries = new(old)
        rows, after = self._stamped(base, entries, now)
        changes = {"entries": Change(rows, parts)} | self._snapshot(base, [key], old, now, entries) | self._indexed(base, rows) | more.pop("changes", {})
        return self._commit(base, changes, outcome, next_id=after, **more)

    def clear(self, slot: str, now: datetime) -> Outcome:
        return self.save(slot, "", now, Outcome.CLEARED)

    def append_file(self, slot: str, path: str | None, now: datetime) -> Outcome:
        if not path:
            return Outcome.UPLOAD_MISSING
        if not self.spark.range(1).where(files.has_valid_extension(F.lit(path))).count():
            return Outcome.UPLOAD_INVALID
        try:
            found = files.read_uploads(self.spark, path).select(F.col("content").alias("upload")).withColumn("of", F.lit(E._normal(slot, self.registry)))
        except PySparkException:  # what Spark says of files that are not there or cannot be read
            return Outcome.UPLOAD_UNREADABLE
        return self._save(slot, lambda old: self._appended(old, found), now, Outcome.UPLOADED)

    @staticmethod
    def _appended(old: DataFrame, uploads: DataFrame) -> DataFrame:
        """file_key, entry_index, content of the entries after uploads (of, upload) stand behind the last ones."""
        last = uploads.select(F.col("of").alias("file_key"), F.lit(_LAST).cast("long").alias("entry_index"), F.lit(0).cast("long").alias("id"), F.col("upload").alias("content"))
        parts = digests.parts(old.select(*last.columns).unionByName(last))
        return parts.select("file_key", (F.col("place") + 1).cast("long").alias("entry_index"), F.col("part").alias("content"))

    def append_uploads(self, uploads: DataFrame, now: datetime, streams: Mapping[str, int] | None = None) -> Outcome:
        """Append uploads (file_key, name, content, place) to their slots, in order of place and name, as one state.

        What was appended where is kept in the table of uploads.
        """
        base = self.store.state()
        named = uploads.select(slot_key(F.col("file_key"), self.registry).alias("file_key"), "name", "content", "place").persist()
        try:
            slots = [r.file_key for r in named.select("file_key").distinct().collect()]  # registered ones at most
            parts = self.store.parts("entries", base, slots)
            solid = named.select("file_key", trim(F.col("content")).alias("c"), "place", "name").where("c <> ''")
            joined = solid.groupBy(F.col("file_key").alias("of")).agg(F.expr("listagg(c, '\n\n') WITHIN GROUP (ORDER BY struct(place, name))").alias("upload"))
            old = self.store.read("entries", base, parts)
            entries = self._appended(old, joined)
            rows, after = self._stamped(base, entries, now)
            log = named.select("file_key", "name", "place", F.octet_length("content").cast("long").alias("byte_length"), F.lit(base["number"] + 1).cast("long").alias("state"))
            changes = {"entries": Change(rows, parts), "uploads": Change(log, ())} | self._snapshot(base, slots, old, now, entries) | self._indexed(base, rows)
            return self._commit(base, changes, Outcome.UPLOADED, next_id=after, streams=dict(streams or {}))
        finally:
            named.unpersist()

    def apply_edits(self, edits: Mapping[int, str], now: datetime) -> Outcome:
        return self._edit(edits, now, Outcome.RESULTS_SAVED, Outcome.RESULT_MISSING)

    def apply_replacement(self, find: str, edits: Mapping[int, str], now: datetime) -> Outcome:
        """Save previewed rows as they were sent."""
        if not find.strip(" \n\r\t\x0b\x00") or not edits:
            return Outcome.REPLACE_MISSING
        return self._edit(edits, now, Outcome.REPLACED, Outcome.REPLACE_NO_MATCHES)

    def delete(self, ids: Iterable[int], now: datetime) -> Outcome:
        """Delete entries; the slots that lose any are numbered anew, after their texts became revisions."""
        base, wanted = self.store.state(), E.id_frame(self.spark, ids)
        owners = sorted({p.split("/")[0] for p in self._owning(base, wanted)})
        slots = [p.removeprefix("file_key=") for p in owners]
        parts = self.store.parts("entries", base, slots)
        rows = self.store.read("entries", base, parts)
        left = E.delete(rows, wanted, F.lit(now).cast("timestamp_ntz"))
        changes = {"entries": Change(left, parts)} | self._snapshot(base, slots, revisions.rows_for_ids(rows, wanted, self.registry), now)
        return self._commit(base, changes if slots else {}, Outcome.RESULTS_DELETED if slots else Outcome.RESULT_MISSING)

    def restore(self, slot: str, index: int, now: datetime) -> Outcome:
        key, base = E._normal(slot, self.registry), self.store.state()
        ring = self._rings(base, [key]).get(key, [])
        if not 0 <= index < len(ring):
            return Outcome.REVISION_MISSING
        kept = self.store.read("revision_pieces", base, [f"file_key={key}/seq={ring[index].seq}"])
        found = digests.parts(kept.select("file_key", F.col("piece").alias("entry_index"), F.lit(0).cast("long").alias("id"), "content"))
        new = found.select("file_key", (F.col("place") + 1).cast("long").alias("entry_index"), F.col("part").alias("content"))
        return self._save(slot, lambda old: new, now, Outcome.RESTORED, base)

    def save_lists(self, lists: Mapping[int, str], now: datetime, outcome: Outcome = Outcome.LISTS_SAVED) -> Outcome:
        """Save all term lists; the old ones become a revision if any differs."""
        names = list(enumerate(self.registry.term_lists, 1))
        new = terms.saved(self.spark.createDataFrame([(i, lists.get(i, "")) for i, _ in names], "list_index int, text string"))
        base = self.store.state()
        old = terms.all_lists(self.store.read("term_lists", base), self.registry).select("list_index", "text")
        both = old.join(new.withColumnRenamed("text", "new_text"), "list_index")
        changes = {"term_lists": Change(new)}
        if not terms.equivalent(both, "text", "new_text").first().equivalent:
            log = old.agg(F.map_from_entries(F.collect_list(F.struct("list_index", "text"))).alias("lists"))
            row = log.select(F.lit(base["next_seq"]).cast("long").alias("seq"), "lists", F.unix_timestamp(F.lit(now)).alias("saved_at"))
            kept = revisions.list_ring(self.store.read("list_revisions", base).unionByName(row), registry=self.registry).drop("position")
            changes["list_revisions"] = Change(kept)
        return self._commit(base, changes, outcome)

    def restore_lists(self, index: int, now: datetime) -> Outcome:
        found = revisions.stored_list_revisions(self.store.read("list_revisions"), registry=self.registry).where(F.col("position") == index + 1).first()
        if found is None:
            return Outcome.REVISION_MISSING
        return self.save_lists({i: found[f"text_{i}"] for i in range(1, len(self.registry.term_lists) + 1)}, now, Outcome.RESTORED)

    def build_index(self) -> None:
        """Index all entries for searches; later writes add what they write.  Building it again drops what is out of date."""
        base = self.store.state()
        changes = {"grams": Change(None), "gram_counts": Change(None)}
        self.store.commit(base, changes | self._indexed({"marks": {"indexed": True}}, self.store.read("entries", base), None), marks={"indexed": True})

    def export(self, folder: str) -> None:
        downloads.write(self.entries(), folder, self.registry)

    # how writes are put together

    def _commit(self, base: dict, changes: dict[str, Change], outcome: Outcome, **more) -> Outcome:
        try:
            self.store.commit(base, changes, **more)
        except Conflict:
            return Outcome.CONFLICT
        return outcome

    def _stamped(self, base: dict, rows: DataFrame, now: datetime) -> tuple[DataFrame, int]:
        """New entries with ids and their time, and the first id not used."""
        numbered, after = self.store.with_ids(rows, base["next_id"])
        return numbered.withColumn("updated_at", F.lit(now).cast("timestamp_ntz")).select(*ENTRIES.names), after

    def _indexed(self, base: Mapping, rows: DataFrame, replaces: tuple | None = ()) -> dict[str, Change]:
        """What new contents add to the index, if there is one."""
        if not base["marks"].get("indexed"):
            return {}
        return {"grams": Change(gramindex.postings(rows), replaces), "gram_counts": Change(lambda written: gramindex.counts(written("grams")), replaces)}

    def _owning(self, base: dict, ids: DataFrame) -> list[str]:
        """The parts that hold any of ``ids``; few ids are looked up by value."""
        wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
        first = [r.id for r in wanted.limit(FEW_IDS + 1).collect()]
        rows = self.store.read("entries", base, run=True).select("id", "file_key", "run")
        rows = rows.where(F.col("id").isin(first)) if len(first) <= FEW_IDS else rows.join(wanted, "id", "left_semi")
        return sorted(f"file_key={r.file_key}/run={r.run}" for r in rows.select("file_key", "run").distinct().collect())

    def _edit(self, edits: Mapping[int, str], now: datetime, saved: Outcome, missing: Outcome) -> Outcome:
        frame = self.spark.createDataFrame(list(edits.items()), "id long, content string")
        outcome = saved if E.saved_count(frame).first().saved_count else missing
        return Outcome.CONFLICT if self.edit_all(frame, now) is Outcome.CONFLICT else outcome

    def edit_all(self, edits: DataFrame, now: datetime, streams: Mapping[str, int] | None = None) -> Outcome:
        """Apply edits (id, content), after the texts of the slots they touch became revisions, as one state.

        Only parts that hold an edited entry are written.
        """
        base = self.store.state()
        parts = self._owning(base, E.accepted_edits(edits))
        slots = sorted({r.file_key for r in self._slots_of(base, edits)})
        rows = self.store.read("entries", base, parts)
        new = E.apply_edits(rows, edits, F.lit(now).cast("timestamp_ntz"))
        whole = self.store.read("entries", base, self.store.parts("entries", base, slots))
        changes = self._snapshot(base, slots, revisions.rows_for_ids(whole, edits, self.registry), now) if slots else {}
        if parts:
            changes["entries"] = Change(new, parts)
            changes |= self._indexed(base, new.join(E.accepted_edits(edits).select("id").distinct(), "id", "left_semi"))
        return self._commit(base, changes, Outcome.RESULTS_SAVED, streams=dict(streams or {}))

    def _slots_of(self, base: dict, ids: DataFrame) -> list:
        """Slots that own any of ``ids``, accepted or not: their texts become revisions."""
        return E.slots_of(self.store.read("entries", base), ids, self.registry).collect()  # registered ones at most

    def _rings(self, base: Mapping, slots: list[str]) -> dict[str, list[Row]]:
        """What is known of the newest revisions of some slots, newest first; texts are not read."""
        found: dict[str, list[Row]] = {}
        heads = self.store.read("revisions", base, self.store.parts("revisions", base, slots))
        for row in heads.orderBy(F.desc("seq")).collect():  # a ring for each registered slot at most
            found.setdefault(row.file_key, []).append(row)
        return {slot: ring[: self.registry.revision_limit] for slot, ring in found.items()}

    def _snapshot(self, base: dict, slots: list[str], rows: DataFrame, now: datetime, new: DataFrame | None = None) -> dict[str, Change]:
        """The rings of ``slots`` with the texts of entries ``rows`` at their end, in pieces.

        Digests of the entries tell which texts repeat the newest one, or what is saved in their stead (``new``: file_key,
        entry_index, content).  Pieces of revisions that stay are not written again.
        """
        mark = lambda r: (r.n, r.low, r.high)
        size = F.sum(F.octet_length(trim(F.col("content"))).cast("long") + 2) - 2
        sizes = {r.file_key: r.n for r in rows.where(trim(F.col("content")) != "").groupBy("file_key").agg(size.alias("n")).collect()}
        saved = {r.file_key: mark(r) for r in digests.merged(new.select("file_key", (F.col("entry_index") - 1).alias("place"), F.col("content").alias("part"))).collect()} if new is not None and sizes else {}
        rings = self._rings(base, slots)
        heads, dropped, changed = [], [], []
        for r in digests.digest(rows).collect() if sizes else []:  # registered slots at most
            ring = rings.get(r.file_key, [])
            if mark(r) in (saved.get(r.file_key), mark(ring[0]) if ring else None):
                continue
            changed.append(r.file_key)
            kept = ring[: self.registry.revision_limit - 1]
            heads += [(r.file_key, base["next_seq"], None, sizes[r.file_key], *mark(r)), *map(tuple, kept)]
            dropped += [f"file_key={r.file_key}/seq={old.seq}" for old in ring[len(kept) :]]
        if not changed:
            return {}
        frame = self.spark.createDataFrame(heads, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REVISIONS))
        stamped = frame.withColumn("saved_at", F.coalesce("saved_at", F.unix_timestamp(F.lit(now))))
        pieces = chunks.pieces(rows.where(F.col("file_key").isin(changed))).withColumn("seq", F.lit(base["next_seq"]).cast("long"))
        return {"revisions": Change(stamped, self.store.parts("revisions", base, changed)), "revision_pieces": Change(pieces, dropped)}
