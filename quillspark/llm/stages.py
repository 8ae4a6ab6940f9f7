"""Stages of a corpus pipeline: each takes (spark, docs, sf_dir) and keeps the columns of the documents, but the last.

Defined results, besides those of the operators: rows with a null id or an id that repeats with another text are judged
by their own text; of rows repeated with id and text the deduplicating stages keep one; a null text stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import table, text_key


def keep_marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose id and text are marked as kept; of rows repeated with one id and text, one."""
    # the mark of a row: its id (nulls apart) and its text
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("__text")]
    rows = docs.withColumn("__text", text_key("text"))
    kept = rows.select("*", key[0]).join(marks.where("kept").select(key[0], F.col("text_key").alias("__text")).distinct(), ["__id", "__text"], "left_semi")
    again = F.row_number().over(Window.partitionBy("__id", "__text").orderBy("__text"))
    return kept.withColumn("__again", again).where("__again = 1").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    from quillspark.llm.toxicity import text_scorer, train

    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(text_scorer(model)("text") < 0.5)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    from quillspark.llm.exact_dedup import exact_dedup

    return keep_marked(docs, exact_dedup(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays."""
    from quillspark.llm.minhash_dedup import near_duplicates

    return keep_marked(docs, near_duplicates(docs, width=5, percent=80))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur twice are cut out; every document stays."""
    from quillspark.llm.suffix_dedup import remove_repeats

    return remove_repeats(docs, window=200).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    from quillspark.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, closing=0)
