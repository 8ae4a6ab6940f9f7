"""The vault: a folder of Markdown files, read as a stream or a batch, and the tables that hold its state."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.versions import Parts, Tables, part_of, shared_folder

FILES = "path string, modificationTime timestamp, length long, content binary"
MAX_BYTES = 1 << 20
BUCKETS = 64  # parts of a table by its key


def glob_to_regex(pattern: str) -> str:
    """** crosses folders (also none), * and ? don't."""
    out, k = "^", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = pattern[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c), k + 1
    return out + "$"


def candidate(path: Column, excluded: list[str]) -> Column:
    keep = F.endswith(F.lower(path), F.lit(".md"))
    for pattern in excluded:
        keep &= ~path.rlike(glob_to_regex(pattern))
    return keep


def files(spark: SparkSession, root: str, excluded: list[str] | None = None, streaming: bool = False) -> DataFrame:
    """path (relative), modificationTime, length, content of the notes below root; a listing error fails the job."""
    reader = spark.readStream.schema(FILES) if streaming else spark.read
    raw = reader.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return raw.withColumn("path", relative).where(candidate(F.col("path"), excluded or []))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def read_notes(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """text, hash and read_error of each file: UTF-8 without NUL and BOM, line ends as \\n, NFC.

    The content of a file above max_bytes isn't read: the filter on its length reaches the scan.
    """
    raw = raw.where(F.col("length") <= max_bytes).unionByName(raw.where(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n")
    error = F.when(F.col("length") > max_bytes, "too_large").when(text.isNull() | F.contains(text, F.lit("\x00")), "encoding")
    out = raw.withColumn("read_error", error).withColumn("text", F.when(error.isNull(), nfc(plain)))
    mtime = F.unix_micros("modificationTime")
    digest = (
        F.when(F.col("read_error") == "too_large", F.sha2(F.concat_ws(":", F.lit("too_large"), F.col("length"), mtime * 1000).cast("binary"), 256))
        .when(F.col("read_error") == "encoding", F.sha2("content", 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    )
    return out.select("path", F.col("length").alias("size"), mtime.alias("mtime"), "text", digest.alias("hash"), "read_error")


def append_missing(tables: Tables, name: str, new: DataFrame, key: list[str], base: int, parts: int = BUCKETS) -> tuple[str, Parts]:
    """Staged parts with the rows whose key the table lacks beside those it has: replays add nothing. Only the parts of
    the table that these keys lie in are read, and none is written anew."""
    new = written_rows(new.dropDuplicates(key).withColumn("part", part_of(F.col(key[0]), parts)))
    touched = [str(r[0]) for r in new.select("part").distinct().collect()]
    known = tables.read(name, base, touched, new.drop("part").schema).select(*key)
    schema, fresh = tables.stage(name, new.join(known, key, "left_anti"))
    before = tables.parts(name, base)
    return schema, {p: [*before.get(p, []), *own] for p, own in fresh.items()}


def replace_rows(tables: Tables, name: str, fresh: DataFrame, keys: DataFrame, key: str, base: int, parts: int = BUCKETS) -> tuple[str, Parts]:
    """Staged parts with these rows instead of those that the table has of the keys. Only the parts that the keys lie in
    are read and written anew; one that is left without rows vanishes."""
    gone = keys.select(key).distinct()
    touched = [str(r[0]) for r in gone.select(part_of(F.col(key), parts)).distinct().collect()]
    old = tables.read(name, base, touched, fresh.schema).join(gone, key, "left_anti")
    schema, own = tables.stage(name, fresh.unionByName(old).withColumn("part", part_of(F.col(key), parts)))
    return schema, {p: own.get(p, []) for p in touched}


def written_rows(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def snapshot(tables: Tables, target: Tables, version: int | None = None) -> int:
    """Live sources with their current revisions and chunks as tables of `target`, all of one version; returns it.

    What is written to `tables` meanwhile doesn't show. The texts of revisions are left blank.
    """
    version = tables.latest() if version is None else version
    sources, revisions, chunks = (tables.read(name, version) for name in ("sources", "revisions", "chunks"))
    live = sources.where("deleted_at IS NULL AND current_revision_id IS NOT NULL")
    current = live.select(F.col("current_revision_id").alias("id"))
    states = revisions.join(current, "id", "left_semi")
    if "raw_text" in states.columns:
        states = states.withColumn("raw_text", F.lit(""))
    base = target.latest()
    rows = {"sources": live, "revisions": states, "chunks": chunks.join(current.withColumnRenamed("id", "revision_id"), "revision_id", "left_semi")}
    changes = {}
    for name, df in rows.items():
        schema, own = target.stage(name, df.withColumn("part", F.lit(0)))
        changes[name] = (schema, {**{p: [] for p in target.parts(name, base)}, **own})
    target.commit(changes, base)
    return version
