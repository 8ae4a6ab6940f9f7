"""Chat over notes: sessions and turns, retrieval of numbered sources, and the messages for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import deep_link
from quillspark.operators import search

FLOOR, HISTORY = 0.45, 10


def numbered(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds seq, from 1 in each session."""
    return turns.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def last_turns(turns: DataFrame, n: int = HISTORY, session: str = "conv_id", order: str = "turn") -> DataFrame:
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("__back", back).where(F.col("__back") <= n).drop("__back")


def sessions(turns: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each session with its number of turns, its last one and its opening words."""
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.max(order).alias("last_turn"), F.min_by(text, order).alias("title"))


def relevant(hits: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Hits that a word found, or whose similarity reaches the floor."""
    return hits.where(F.col("by_text") | F.coalesce(F.col("similarity") >= floor, F.lit(False)))


def retrieve(hits: DataFrame, contents: DataFrame, limit: int = 8, budget: int = 8000, floor: float = FLOOR, vault: str = "My vault") -> DataFrame:
    """Numbered sources of each question and the mode of its search.

    hits: query_id, doc_id, chunk_id, rank, score, by_text, by_vector, similarity, of which twice the limit is taken;
    contents: chunk_id, path, heading, content.
    """
    taken = hits.where(F.col("rank") <= 2 * limit)
    mode = hits.groupBy("query_id").agg(F.when(F.bool_or("by_vector"), "hybrid").otherwise("text_only").alias("mode"))
    full = relevant(taken, floor).join(contents, "chunk_id")
    sized = full.select("query_id", "rank", "doc_id", F.char_length("content").alias("size"))
    chosen = search.evidence(sized, limit=limit, budget=budget).select("query_id", "n", "rank")
    return chosen.join(full, ["query_id", "rank"]).join(mode, "query_id").select(
        "query_id", "n", "doc_id", "path", "heading", "score", F.col("content").alias("snippet"), deep_link(F.lit(vault), F.col("path")).alias("link"), "mode"
    )


def angles(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rendered(sources: DataFrame) -> DataFrame:
    """query_id and its sources as one text, in their order; note text can't open or close a tag."""
    head = F.concat(F.lit("["), F.col("n"), F.lit("] "), angles(F.col("path")), F.when(F.coalesce(F.col("heading"), F.lit("")) != "", F.concat(F.lit(" — "), angles(F.col("heading")))).otherwise(""))
    block = F.struct("n", F.concat(head, F.lit("\n"), angles(F.col("snippet"))).alias("text"))
    return sources.select("query_id", block.alias("b")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n\n").alias("sources"))


def messages(questions: DataFrame, sources: DataFrame, history: DataFrame) -> DataFrame:
    """query_id, place, role, content: the session's last ten turns, then the question with its sources.

    questions: query_id, session_id, question; history: session_id, turn, question, answer.
    """
    past = last_turns(history, HISTORY, "session_id", "turn").join(questions.select("query_id", "session_id"), "session_id")
    said = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    turns = past.select("query_id", "turn", F.explode(said).alias("m")).select("query_id", "turn", "m.*")
    asked = questions.join(rendered(sources), "query_id", "left").select(
        "query_id", F.lit((1 << 63) - 1).alias("turn"), F.lit(0).alias("part"), F.lit("user").alias("role"),
        F.concat(F.lit("<sources>\n"), F.coalesce("sources", F.lit("(no matching sources)")), F.lit("\n</sources>\n\nQuestion: "), F.col("question")).alias("content"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "part"))
    return turns.withColumn("turn", F.col("turn").cast("long")).unionByName(asked).select("query_id", place.alias("place"), "role", "content")
