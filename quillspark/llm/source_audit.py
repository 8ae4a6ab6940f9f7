"""Divergence of sources within languages: sorted runs of terms, scanned in a stream.

1. An Arrow pass counts each document's terms and sums them up over neighbouring documents of a group (lang, source),
   as far as `rows_held` rows allow: a combiner, so a term in every document leaves a task as a few rows. A row is
   (lang, term, source, document): the first document it stands for, with how many there are and their occurrences.
2. Spark deals the rows by (lang, term) and sorts them by these, source and document within partitions. A scan of
   the run lengths, which holds one run at a time, yields each term's document frequency and its counts by source;
   terms below `least_documents` go. Each run is written once, as a row with its sources.
3. Group sums over the kept terms give every estimate. A second scan of the runs emits partial pairs, summed over a
   block of runs, and the best terms; Spark adds them up.

A pair's terms that neither source or only one has are not visited: they follow from how many terms a source has with
each count. So the work is the pairs of sources that share a term, plus the pairs of sources, which are the result.

Defined results: null text, lang and source are ''; each row is a document of its own, whatever its id; repeated rows
count each; other columns are ignored; an empty table gives no rows; groups without terms take part with the count 0;
a lang without kept terms gives pairs of the value 0. Very long texts are counted whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.byte_bpe import cut_blocks
from quillspark.llm.common import Scratch, ascii_lower, checkpointed, require

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
COUNTED = "lang string, term string, source string, document long, documents long, n long"
RUN = "lang string, term string, documents long, sources array<string>, counts array<long>"


def combined(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("document", "min"), ("documents", "sum"), ("n", "sum")])
    return out.select(["group", "term", "document_min", "documents_sum", "n_sum"]).rename_columns(["group", "term", "document", "documents", "n"])


def counter(rows_held: int, block_bytes: int):
    """(row, words, lang, source) -> (lang, term, source, document, documents, n)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}

        def rows_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([g[k] for g in numbers], pa.string()) for k in (0, 1))
            for at in range(0, table.num_rows, 20_000):
                part = table.slice(at, 20_000).combine_chunks()
                group, term, *counts = (c.combine_chunks() for c in part.columns)
                yield pa.RecordBatch.from_arrays([langs.take(group), term.cast(pa.string()), sources.take(group), *counts], names=["lang", "term", "source", "document", "documents", "n"])

        held, size = [], 0
        for batch in batches:
            done = 0
            for rows, sizes, places, data, edges in cut_blocks(batch, block_bytes) if batch.num_rows else ():
                own = batch.slice(done, len(rows))
                done += len(rows)
                if not len(places):
                    continue
                group = np.array([numbers.setdefault(g, len(numbers)) for g in zip(own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True)], np.int64)
                n_words = len(edges) - 1
                pair, n = np.unique(np.repeat(np.arange(len(rows)), sizes) * n_words + places, return_counts=True)
                row, code = pair // n_words, group[pair // n_words] * n_words + pair % n_words
                order = np.argsort(code, kind="stable")  # pairs are in the order of rows
                code, row, n = code[order], row[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                texts = pa.Array.from_buffers(pa.large_string(), n_words, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
                columns = [
                    pa.array(code[first] // n_words), texts.take(pa.array(code[first] % n_words)), rows.take(pa.array(row[first])),
                    pa.array(np.diff(np.append(first, len(code)))), pa.array(np.add.reduceat(n, first)),
                ]
                held.append(pa.Table.from_arrays(columns, names=["group", "term", "document", "documents", "n"]))
                size += len(first)
                if size > rows_held:
                    held = [combined(held)]
                    size = held[0].num_rows
                    if 2 * size > rows_held:
                        yield from rows_of(held[0])
                        held, size = [], 0
        if held:
            yield from rows_of(combined(held))

    return emit


def scan(least_documents: int):
    """Sorted (lang, term, source, document, documents, n) -> one row per run of (lang, term) with enough documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, documents, sources, counts = None, 0, [], []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "term", "documents", "sources", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # runs of equal (lang, term, source) within the batch, added up before they are looked at
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in range(3):
                column = batch.column(c)
                new[1:] |= np.asarray(pa.compute.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False), bool)
            first = np.flatnonzero(new)
            at = pa.array(first)
            own = zip(*(batch.column(c).take(at).to_pylist() for c in range(3)), *(np.add.reduceat(batch.column(c).to_numpy(), first).tolist() for c in (4, 5)), strict=True)
            for lang, term, source, d, n in own:
                if key != (lang, term):
                    if documents >= least_documents:
                        out.append((*key, documents, sources, counts))
                    key, documents, sources, counts = (lang, term), 0, [], []
                documents += d
                if sources and sources[-1] == source:
                    counts[-1] += n
                else:
                    sources.append(source)
                    counts.append(n)
            if len(out) >= 10_000:
                yield flush()
                out = []
        if documents >= least_documents:
            out.append((*key, documents, sources, counts))
        yield flush()

    return emit


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(of: np.ndarray, p: np.ndarray, z: np.ndarray, begin: np.ndarray, widths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, part), a < b, of runs: of group numbers in order, p their estimates, z those of terms they don't have.

    part is what both having a term adds to the sums of their single terms. At most `most` pairs are held at a time.
    """

    def added(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        part = distance(p[i], p[j]) - distance(p[i], z[j]) - distance(z[i], p[j]) + distance(z[i], z[j])
        order = np.lexsort((of[j], of[i]))
        a, b = of[i][order], of[j][order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.add.reduceat(part[order], first)

    for width in np.unique(widths[widths > 1]).tolist():
        at = begin[widths == width]
        if width * width <= most:
            x, y = np.triu_indices(width, 1)
            step = most // (width * width)
            for k in range(0, len(at), step):
                yield added((at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel())
        else:  # very many sources: one of them against the later ones at a time
            for k in at.tolist():
                for x in range(k, k + width - 1):
                    later = np.arange(x + 1, k + width)
                    yield added(np.full(len(later), x), later)


def partial_pairs(most: int):
    """Sorted (lang, term, at, p, zero) -> (lang, a, b, part), summed over the runs of a batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for lang in pa.compute.unique(rows["lang"]).to_pylist():
                own = rows.filter(pa.compute.equal(rows["lang"], lang))
                codes = own["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                of, p, z = (own[c].to_numpy() for c in ("at", "p", "zero"))
                begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                for a, b, part in pair_sums(of, p, z, begin, np.diff(np.append(begin, len(codes))), most):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(part)], names=["lang", "a", "b", "part"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # all but the last run, which may go on
            end, last = batch.num_rows - 1, (batch.column(0)[-1], batch.column(1)[-1])
            while end and (batch.column(0)[end - 1], batch.column(1)[end - 1]) == last:
                end -= 1
            if end:
                yield from summed(pa.Table.from_batches([*held[:-1], batch.slice(0, end)]))
                held = [batch.slice(end)]
        if held:
            yield from summed(pa.Table.from_batches(held))

    return emit


def estimate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)"))).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_runs(docs: DataFrame, least_documents: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rows_held: int = 800_000, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per lang and kept term: its documents, and its sources with their counts."""
    plain = require(docs, [text_col, lang_col, source_col]).toDF("text", "lang", "source").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    words = plain.select(F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("words"), "lang", "source")
    counted = words.mapInArrow(counter(rows_held, block_bytes), COUNTED)
    # the term before its lang: a sort looks at the first bytes of its first column before anything else
    order = ["term", "lang", "source", "document"]
    return counted.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(scan(least_documents), RUN)


def source_audit(
    docs: DataFrame, least_documents: int = 10, terms_shown: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pairs_held: int = 1 << 18
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank.

    What grows with the terms stays in runs and their scans; groups and their histograms of counts meet in joins by lang
    that adaptive execution broadcasts by size.
    """
    with Scratch(docs.sparkSession) as scratch:
        runs = scratch.save(term_runs(docs, least_documents, text_col, lang_col, source_col))
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("total")
        entries = runs.select("lang", "term", total, F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
        # how many terms a group has with each count
        histogram = scratch.save(entries.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("times")))
        sums = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("times")).alias("n"), F.sum("times").alias("own"))
        named = require(docs, [lang_col, source_col]).toDF("lang", "source").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        groups = named.join(sums, ["lang", "source"], "left").join(runs.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").na.fill(0, ["n", "own", "v"])
        zero = F.when(F.col("v") > 0, estimate(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1).cast("long"))
        groups = scratch.save(groups.withColumns({"zero": zero, "at": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")}))
        langs = groups.groupBy("lang").agg(F.sum("n").alias("all_n"))
        own = scratch.save(
            entries.join(groups.select("lang", "source", "at", "zero", "n", "v"), ["lang", "source"]).join(langs, "lang")
            .select("lang", "source", "term", "at", "zero", estimate(F.col("count"), F.col("n"), F.col("v")).alias("p"), estimate(F.col("total"), F.col("all_n"), F.col("v")).alias("q"))
        )
        # a group's terms against the estimate that another group has for a term it doesn't have
        levels = groups.select("lang", F.col("zero").alias("level")).distinct()
        counts = histogram.join(groups, ["lang", "source"]).select("lang", "at", estimate(F.col("count"), F.col("n"), F.col("v")).alias("p"), "times").join(levels, "lang")
        alone = scratch.save(counts.groupBy("lang", "at", "level").agg(F.sum(apart(F.col("p"), F.col("level")) * F.col("times")).alias("alone")))
        sorted_runs = own.select("lang", "term", "at", "p", "zero").repartition("lang", "term").sortWithinPartitions("term", "lang", "at")
        both = scratch.save(sorted_runs.mapInArrow(partial_pairs(pairs_held), "lang string, a long, b long, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part")))
        both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
        side = lambda n: groups.select("lang", *[F.col(c).alias(c + n) for c in ("at", "source", "zero", "own")])
        pairs = groups.select("lang", "source", "at", "zero", "own", "v").join(side("2"), "lang").where("at <> at2")
        first = alone.select("lang", "at", F.col("level").alias("zero2"), "alone")
        second = alone.select("lang", F.col("at").alias("at2"), F.col("level").alias("zero"), F.col("alone").alias("alone2"))
        pairs = (
            pairs.join(first, ["lang", "at", "zero2"], "left").join(second, ["lang", "at2", "zero"], "left")
            .join(both.withColumnsRenamed({"a": "at", "b": "at2"}), ["lang", "at", "at2"], "left").na.fill(0, ["alone", "alone2", "part"])
        )
        value = F.col("alone") + F.col("alone2") + F.col("part") + (F.col("v") - F.col("own") - F.col("own2")) * apart(F.col("zero"), F.col("zero2"))
        found = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("source2").alias("item"), F.when(F.col("v") > 0, value).otherwise(F.lit(0)).cast("long").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        found = found.withColumn("rank", F.row_number().over(order))
        shown = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        shown = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_shown)
        return checkpointed(found.unionByName(shown))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
