"""Vectors of texts by content: a store of one model, which is filled by any number of runs side by side.

A text's key is a digest of the model and the text, so equal texts are embedded once, whatever chunk or revision they
stand in. A run claims the keys that the store lacks and no other run holds, embeds what it has claimed and writes the
vectors and the end of its claims as one version. A claim has an end in time: what a run that died held goes to the next.
The model is a function from texts to vectors, called in the tasks; whatever it raises fails the run, not the store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.graph import written
from quillspark.sources.versions import Conflict, Parts, Tables, part_of

Embed = Callable[[list[str]], list[list[float]]]
VECTOR, CLAIM = "key string, embedding array<double>", "key string, owner string, until double"


def text_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), text).cast("binary"), 256)


class EmbeddingStore:
    def __init__(self, tables: Tables, model: str, dims: int | None = None, parts: int = 64):
        self.tables, self.spark, self.model, self.dims, self.parts = tables, tables.spark, model, dims, parts
        self.rows, self.claims = f"embeddings-{model}", f"claims-{model}"

    def keyed(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        return texts.withColumn("key", text_key(self.model, F.col(text_col)))

    def _touched(self, keys: DataFrame) -> list[str]:
        return [str(r[0]) for r in keys.select(part_of(F.col("key"), self.parts)).distinct().collect()]

    def _staged(self, name: str, rows: DataFrame) -> tuple[str, Parts]:
        return self.tables.stage(name, rows.withColumn("part", part_of(F.col("key"), self.parts)).repartition("part"))

    def missing(self, texts: DataFrame) -> DataFrame:
        """key and text of what the store lacks, each key once; texts: text."""
        once = self.keyed(texts.where("text IS NOT NULL")).groupBy("key").agg(F.first("text").alias("text"))
        return once.join(self.tables.read(self.rows, schema=VECTOR).select("key"), "key", "left_anti")

    def claim(self, texts: DataFrame, owner: str, lease: float = 3600.0, now: float | None = None, most: int | None = None) -> DataFrame:
        """key and text of those (key, text) that are this owner's from now on; most: no more than so many of them."""
        touched = self._touched(texts)
        while True:
            base, at = self.tables.latest(), time.time() if now is None else now
            held = self.tables.read(self.claims, base, touched, CLAIM).where((F.col("until") > at) & (F.col("owner") != owner))
            known = self.tables.read(self.rows, base, touched, VECTOR)
            free = texts.join(known.select("key"), "key", "left_anti").join(held.select("key"), "key", "left_anti")
            free = written(free if most is None else free.orderBy("key").limit(most))
            rows = held.unionByName(free.select("key", F.lit(owner).alias("owner"), F.lit(at + lease).alias("until")))
            schema, own = self._staged(self.claims, rows)
            try:
                self.tables.commit({self.claims: (schema, {p: own.get(p, []) for p in touched})}, base)
                return free
            except Conflict:
                continue

    def write(self, vectors: DataFrame, owner: str) -> None:
        """Adds vectors (key, embedding) and ends the owner's claims on them."""
        vectors = written(vectors)
        touched = self._touched(vectors)
        schema, fresh = self._staged(self.rows, vectors)
        while True:
            base = self.tables.latest()
            known = self.tables.parts(self.rows, base)
            claims = self.tables.read(self.claims, base, touched, CLAIM)
            left = claims.join(vectors.where(F.lit(True)).select("key", F.lit(owner).alias("owner")), ["key", "owner"], "left_anti")
            claim_schema, own = self._staged(self.claims, left)
            changes = {self.rows: (schema, {p: [*known.get(p, []), *f] for p, f in fresh.items()}), self.claims: (claim_schema, {p: own.get(p, []) for p in touched})}
            try:
                self.tables.commit(changes, base)
                return
            except Conflict:
                continue

    def fill(self, texts: DataFrame, embed: Embed, current: Callable[[], DataFrame] | None = None, batch: int = 64, lease: float = 3600.0, most: int | None = None, owner: str | None = None) -> int:
        """Embeds the texts (text) that the store lacks and no other run has claimed; returns how many these were.

        current gives what is still to be embedded (text) once the claims are made: a text of a revision that has been
        superseded meanwhile is passed over, and its claim ends.
        """
        owner = owner or uuid.uuid4().hex
        mine = self.claim(written(self.missing(texts)), owner, lease, most=most)
        wanted = mine if current is None else mine.join(self.keyed(current()).select("key").distinct(), "key", "left_semi")
        vectors = written(wanted.mapInPandas(embedder(embed, batch, self.dims), VECTOR))
        n = vectors.count()
        self.write(vectors, owner)
        if current is not None:
            self.release(mine.select("key"), owner)
        return n

    def release(self, keys: DataFrame, owner: str) -> None:
        """Ends the owner's claims on keys."""
        touched = self._touched(keys)
        while touched:
            base = self.tables.latest()
            left = self.tables.read(self.claims, base, touched, CLAIM).join(keys.select("key", F.lit(owner).alias("owner")), ["key", "owner"], "left_anti")
            schema, own = self._staged(self.claims, left)
            try:
                self.tables.commit({self.claims: (schema, {p: own.get(p, []) for p in touched})}, base)
                return
            except Conflict:
                continue

    def vectors(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows with the embedding of their text, null where the store has none yet."""
        return self.keyed(rows, text_col).join(self.tables.read(self.rows, schema=VECTOR).dropDuplicates(["key"]), "key", "left")


def embedder(embed: Embed, batch: int, dims: int | None):
    """(key, text) -> (key, embedding), some texts a call."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = embed(part.text.tolist())
                if len(found) != len(part) or dims is not None and any(len(v) != dims for v in found):
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts, or not of {dims} dimensions")
                yield pd.DataFrame({"key": part.key.tolist(), "embedding": [[float(x) for x in v] for v in found]})

    return emit
