"""A text index that grows: postings in segments, tombstones by note, document frequencies beside them.

A batch of edits writes a segment of its own: the postings of its notes' chunks, parted by a hash of the term and sorted
by it; the terms of these chunks, parted by note; tombstones, which hide what older segments hold of these notes; and by
how much the number of chunks with each term changes, for which it reads the terms of the notes concerned and nothing
else. All of it is one version of the tables. A search reads the parts of its terms in every segment. `merge` writes the
live rows of all segments as one.

Words of a large batch are neither shuffled nor kept beside the index: they are cut, sorted and written where their
chunks lie. So a caller deals chunks by doc_id, in pieces of some thousand notes.

Searches take what `rows` gives: live postings with the columns of `search.postings`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import search
from quillspark.operators.graph import written
from quillspark.sources.versions import Parts, Tables, part_of

POSTING = "doc_id long, chunk_id long, pos int, term string, weight double, segment long"
TOMBSTONE = "doc_id long, segment long"
NOTE_TERMS = "doc_id long, chunk_id long, terms string, words int, segment long"
FREQUENCY = "term string, n long"
PIECE = 250_000  # rows of a part that one task sorts and writes; a part with more has several files
TASK = 8  # pieces that are sorted at once, of all parts, where chunks lie
SENT = 1_000_000  # notes of a batch whose numbers are sent to every task that reads the terms they had


def term_part(term: Column, parts: int) -> Column:
    return part_of(term, parts)


def note_part(parts: int) -> Column:
    """As Spark deals by doc_id: notes that are dealt into a multiple of the parts need no other shuffle to be written."""
    return F.pmod(F.hash("doc_id"), F.lit(parts))


class TextIndex:
    def __init__(self, tables: Tables, parts: int = 64, most_segments: int = 16):
        self.tables, self.spark, self.parts, self.most_segments = tables, tables.spark, parts, most_segments

    def segments(self, version: int | None = None) -> list[int]:
        return sorted({int(p) // self.parts for name in ("postings", "tombstones") for p in self.tables.parts(name, version)})

    def _of(self, name: str, version: int, numbers: list[int] | None, schema: str) -> DataFrame:
        """The rows of a table in every segment, of the given parts."""
        wanted = None if numbers is None else [p for p in self.tables.parts(name, version) if int(p) % self.parts in set(numbers)]
        return self.tables.read(name, version, wanted, schema)

    def _staged(self, name: str, rows: DataFrame, part: Column, segment: int, sort: list[str], size: int = 0) -> tuple[str, Parts]:
        """Rows in the parts of a segment; size: about how many there are. A part of many is dealt by notes, a common term too."""
        pieces = -(-size // (self.parts * PIECE)) or 1
        dealt = rows.repartition(part) if pieces == 1 else rows.repartition(self.parts * pieces, part, F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(pieces)))
        return self._there(name, dealt, part, segment, sort)

    def _there(self, name: str, rows: DataFrame, part: Column, segment: int, sort: list[str]) -> tuple[str, Parts]:
        """Rows in the parts of a segment, sorted and written by the tasks that have them. Parts are numbers, which sort fast."""
        return self.tables.stage(name, rows.withColumn("part", F.lit(segment * self.parts) + part), sort=sort)

    def _folder(self, name: str, staged: tuple[str, Parts]) -> DataFrame:
        """The rows that have been staged and are in no version yet."""
        schema = T.StructType.fromJson(json.loads(staged[0]))
        folders = [f"{self.tables.root}/{f}" for own in staged[1].values() for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def update(self, chunks: DataFrame, gone: DataFrame | None = None, mark: tuple[str, int] | None = None) -> int:
        """These chunks (doc_id, chunk_id, content, and heading where there is one) instead of all that the index has of
        their notes; notes of `gone` (doc_id) leave. A note without chunks any more is one that has gone."""
        base = self.tables.latest()
        if mark and self.tables.manifest(base)["marks"].get(mark[0], -1) >= mark[1]:
            return base
        segment = max(self.segments(base), default=0) + 1
        of = F.lit(segment).cast("long").alias("segment")
        rows = search.postings(chunks).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in POSTING.split(", ")[:-1]], of)
        terms = search.chunk_terms(chunks).select(F.col("doc_id").cast("long"), F.col("chunk_id").cast("long"), "terms", "words", of)
        # terms are written first, and what else is counted is read from them: the text is read for them and for postings
        staged = self._there("notes", terms, note_part(self.parts), segment, ["doc_id", "chunk_id"])
        new = self._folder("notes", staged)
        notes = new.select("doc_id")
        notes = written((notes if gone is None else notes.union(gone.select(F.col("doc_id").cast("long")))).distinct())
        touched = [r[0] for r in notes.select(note_part(self.parts)).distinct().collect()]
        # what they had is cut to them before it meets tombstones, and a batch is sent to it: the index isn't shuffled
        known = self._of("notes", base, touched, NOTE_TERMS).join(search.hint(notes, SENT)(notes), "doc_id", "left_semi")
        known = self._live(known, base, touched)
        each = lambda chunks, n: chunks.where("chunk_id IS NOT NULL").select(F.explode(F.split("terms", " ")).alias("term"), F.lit(n).cast("long").alias("n")).where("term <> ''")
        change = each(new, 1).unionByName(each(known, -1)).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
        size = new.agg(F.sum("words")).first()[0] or 0
        # only notes that older segments hold need a tombstone
        hidden = known.select("doc_id").distinct().select("doc_id", of)
        part, sort = term_part(F.col("term"), self.parts), ["term", "doc_id", "chunk_id", "pos"]
        if size <= self.parts * PIECE:
            postings = self._staged("postings", rows, part, segment, sort)
        else:
            tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // (TASK * PIECE)))
            postings = self._there("postings", rows.coalesce(tasks), part, segment, sort)
        changes = {
            "postings": postings,
            "notes": staged,
            "tombstones": self._staged("tombstones", hidden, note_part(self.parts), segment, ["doc_id"]),
            "frequencies": self._staged("frequencies", change, part, segment, ["term"]),
        }
        version = self.tables.commit(changes, base, mark)
        return self.merge() if len(self.segments(version)) > self.most_segments else version

    def _live(self, rows: DataFrame, version: int, numbers: list[int] | None = None) -> DataFrame:
        """Rows with a doc_id and a segment that no later tombstone hides."""
        if not self.tables.parts("tombstones", version):
            return rows
        last = self._of("tombstones", version, numbers, TOMBSTONE).groupBy("doc_id").agg(F.max("segment").alias("__hidden"))
        return rows.join(last, "doc_id", "left").where(F.col("__hidden").isNull() | (F.col("segment") >= F.col("__hidden"))).drop("__hidden")

    def rows(self, terms: DataFrame | None = None, version: int | None = None, most: int = 10_000) -> DataFrame:
        """Live postings, of some terms (term) where given: named in the scan and by their parts if they are few.

        Those of some terms are dealt by doc_id, so that what is counted per chunk or query needs no other shuffle and no
        task's counts grow with the index; a task's are a quarter of PIECE, since many queries may ask for a common term.
        """
        version = self.tables.latest() if version is None else version
        if terms is None:
            return self._live(self._of("postings", version, None, POSTING), version).select("doc_id", "chunk_id", "pos", "term", "weight")
        asked = terms.select("term").distinct()
        known = [r.term for r in asked.limit(most + 1).collect()]
        if len(known) > most:
            chosen = lambda name, schema: self._of(name, version, None, schema).join(asked, "term", "left_semi")
        else:
            numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in known], "term string").select(term_part(F.col("term"), self.parts)).distinct().collect()]
            chosen = lambda name, schema: self._of(name, version, numbers, schema).where(F.col("term").isin(known))
        size = chosen("frequencies", FREQUENCY).agg(F.sum("n")).first()[0] or 0
        pieces = max(self.spark.sparkContext.defaultParallelism, -(-4 * size // PIECE))
        return self._live(chosen("postings", POSTING).repartition(pieces, "doc_id"), version).select("doc_id", "chunk_id", "pos", "term", "weight")

    def frequencies(self, version: int | None = None) -> DataFrame:
        """term and n, the number of live chunks that hold it; no posting is read."""
        rows = self._of("frequencies", self.tables.latest() if version is None else version, None, FREQUENCY)
        return rows.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")

    def merge(self) -> int:
        """All segments as one, without what tombstones hide."""
        base = self.tables.latest()
        segment = max(self.segments(base), default=0) + 1
        of = F.lit(segment).cast("long")
        changes = {}
        total = self._of("frequencies", base, None, FREQUENCY).agg(F.sum("n")).first()[0] or 0
        by_term, by_note = term_part(F.col("term"), self.parts), note_part(self.parts)
        for name, rows, part, sort, size in (
            ("postings", self._live(self._of("postings", base, None, POSTING), base).withColumn("segment", of), by_term, ["term", "doc_id", "chunk_id", "pos"], total),
            ("notes", self._live(self._of("notes", base, None, NOTE_TERMS), base).withColumn("segment", of), by_note, ["doc_id", "chunk_id"], total),
            ("frequencies", self.frequencies(base), by_term, ["term"], 0),
        ):
            schema, parts = self._staged(name, rows, part, segment, sort, size)
            changes[name] = (schema, {**{p: [] for p in self.tables.parts(name, base)}, **parts})
        schema = self.tables.manifest(base)["tables"].get("tombstones", {}).get("schema")
        if schema:
            changes["tombstones"] = (schema, {p: [] for p in self.tables.parts("tombstones", base)})
        return self.tables.commit(changes, base)
