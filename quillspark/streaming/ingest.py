"""Incremental ingestion: the file source, micro-batches, tables that a replay leaves as they are, and state per note."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.markdown import index_note
from quillspark.operators.graph import written
from quillspark.sources.vault import append_missing, files, read_notes, replace_rows
from quillspark.sources.versions import Tables

REVISION = ["path", "hash", "size", "mtime", "read_error"]


def index_notes(notes: DataFrame) -> DataFrame:
    """path, hash, title, tags, ordinal, headings, content: the chunks of readable notes."""
    parsed = notes.where("read_error IS NULL").select("path", "hash", index_note("text", "path").alias("note"))
    return parsed.select("path", "hash", "note.title", "note.tags", F.explode("note.chunks").alias("chunk")).select("path", "hash", "title", "tags", "chunk.*")


def newest(notes: DataFrame) -> DataFrame:
    """Of several states of a path in a batch the one last modified."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime"), "hash"))
    return notes.withColumn("__last", last).where("__last = 1").drop("__last")


def ingest_notes(tables: Tables, notes: DataFrame, gone: DataFrame | None = None, mark: tuple[str, int] | None = None) -> int:
    """A batch of notes as one version of the tables "revisions", "notes" and "chunks".

    Revisions (path, hash) are appended where new; each note's newest state, and its chunks, replace those of its path. A
    note that is empty, unreadable or gone (path) has no chunks any more, one that is gone has no state.
    """
    base = tables.latest()
    if mark and tables.manifest(base)["marks"].get(mark[0], -1) >= mark[1]:
        return base
    now = newest(notes)
    paths = now.select("path") if gone is None else now.select("path").union(gone.select("path"))
    revisions = append_missing(tables, "revisions", notes.select(*REVISION), ["path", "hash"], base)
    state = replace_rows(tables, "notes", now.select(*REVISION), paths, "path", base)
    return tables.commit({"revisions": revisions, "notes": state, "chunks": replace_rows(tables, "chunks", index_notes(now), paths, "path", base)}, base, mark)


def rescan(spark: SparkSession, root: str, tables: str, excluded: list[str] | None = None) -> int:
    """Ingests what differs from the notes known: new and edited ones, and those that are gone. Returns the version.

    A stream takes each path once for its checkpoint; what is edited in place, renamed or deleted is found here.
    Spark's readers pass over files of no bytes, so such a file counts as gone.
    """
    store = Tables(spark, tables)
    disk = written(read_notes(files(spark, root, excluded)))
    known = store.read("notes", schema=disk.select(*REVISION).schema)
    changed, gone = disk.join(known, ["path", "hash"], "left_anti"), known.join(disk, "path", "left_anti").select("path")
    return store.latest() if changed.isEmpty() and gone.isEmpty() else ingest_notes(store, changed, gone)


def watch(spark: SparkSession, root: str, tables: str, checkpoint: str, excluded: list[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Ingests what is new below root, once or at intervals (such as "15 minutes"), each batch as one version of the
    tables (see ingest_notes). Each batch is read and parsed once, and a replayed one changes nothing."""

    def batch(raw: DataFrame, number: int) -> None:
        ingest_notes(Tables(spark, tables), written(read_notes(raw)), mark=(checkpoint, number))

    writer = files(spark, root, excluded, streaming=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


STATE = "current string, state string, known array<string>, deleted boolean"
OUTCOME = "path string, hash string, outcome string, queued boolean"


def observe(observations: DataFrame) -> DataFrame:
    """path, hash, outcome and queued of each observation (path, hash or null for a vanished note, read_error, seen_at) of a stream.

    Each note's state is its current content, what became of it, the contents it had, and whether it is deleted. A new
    content is new, or failed if it couldn't be read; the current one is unchanged, or restored after a deletion; an
    older one is queued again.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, status, known, deleted = state.get if state.exists else (None, None, [], False)
        known, rows = list(known), []
        for r in pd.concat(list(frames)).sort_values("seen_at", kind="stable").itertuples():
            bad = isinstance(r.read_error, str)
            if not isinstance(r.hash, str):
                outcome, queued, deleted = "deleted", False, True
            elif r.hash not in known:
                outcome, queued = ("failed", False) if bad else ("new", True)
                known, deleted = [*known, r.hash], False
                current, status = r.hash, "failed" if bad else "indexed"
            elif r.hash == current and status == "failed" and bad:
                outcome, queued, deleted = "unchanged", False, False
            elif r.hash == current and not deleted:
                outcome, queued = "unchanged", False
            else:
                outcome, queued = "restored" if r.hash == current else "requeued", True
                current, status, deleted = r.hash, "indexed", False
            rows.append((key[0], r.hash if isinstance(r.hash, str) else None, outcome, queued))
        state.update((current, status, known, deleted))
        yield pd.DataFrame(rows, columns=["path", "hash", "outcome", "queued"])

    return observations.groupBy("path").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)
