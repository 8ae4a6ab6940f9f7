"""Retrieval quality: ranks, recall, reciprocal rank, paired bootstrap intervals, flips and the verdict."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH, RESAMPLES, SEED = 10, 2000, 20261002
POISSON = [math.ceil(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(7)]  # 16-bit edges of the counts 0 to 7


def first_rank(hits: DataFrame, targets: DataFrame, k: int = DEPTH) -> DataFrame:
    """query_id and the place of its first target among distinct paths, null beyond k; hits: query_id, position, path."""
    distinct = hits.groupBy("query_id", "path").agg(F.min("position").alias("position"))
    placed = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    found = placed.where(F.col("rank") <= k).join(targets, ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return targets.select("query_id").distinct().join(found, "query_id", "left")


def summary(ranks: DataFrame, *by: str) -> DataFrame:
    n = F.count(F.lit(1))
    return ranks.groupBy(*by).agg(
        n.alias("n"), F.round(F.count("rank") / n, 6).alias("recall"),
        F.round(F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)) / n, 6).alias("mrr"), F.round(F.count_if(F.col("rank") == 1) / n, 6).alias("hit1"),
    )


def percentile(column: str, p: float) -> Column:
    """Interpolated between the neighbours in order; 0 without values."""
    return F.coalesce(F.percentile(column, F.lit(p)), F.lit(0.0))


def gains(ranks: DataFrame, incumbent: DataFrame) -> DataFrame:
    """system, query_id and gain: 1 where only the system finds the query's target, -1 where only the incumbent does, else 0."""
    old = incumbent.select("query_id", F.col("rank").isNotNull().cast("int").alias("old"))
    both = ranks.select("system", "query_id", F.col("rank").isNotNull().cast("int").alias("new")).join(old, "query_id")
    return both.select("system", "query_id", (F.col("new") - F.col("old")).alias("gain"))


def poisson_counts(digest: Column, at: int) -> Column:
    """A count with mean 1 from the at-th four digits of a hexadecimal digest."""
    u = F.conv(F.substring(digest, 4 * at + 1, 4), 16, 10).cast("int")
    return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0))


def bootstrap_counts(ranks: DataFrame, incumbent: DataFrame, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """low and high of each system, as `bootstrap` gives them, with Poisson counts instead of draws.

    A resample takes each query as often as a count with mean 1 says, which follows from a hash of the seed, the query
    and the resample (eight resamples a digest); the mean is over the queries taken. So each row is drawn where it lies,
    the same for all systems and at any number of partitions, and sums are combined before they are shuffled.
    """
    block = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("block").cast("string")).cast("binary"))
    rows = gains(ranks, incumbent).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 8) - 1)))).withColumn("digest", block)
    drawn = rows.select("system", "gain", "block", F.posexplode(F.array(*[poisson_counts(F.col("digest"), k) for k in range(8)])).alias("k", "times"))
    drawn = drawn.select("system", (8 * F.col("block") + F.col("k")).alias("resample"), "gain", "times").where((F.col("times") > 0) & (F.col("resample") < resamples))
    means = drawn.groupBy("system", "resample").agg((F.sum(F.col("gain") * F.col("times")) / F.sum("times")).alias("gain"))
    return means.groupBy("system").agg(F.round(percentile("gain", 0.025), 6).alias("low"), F.round(percentile("gain", 0.975), 6).alias("high"))


def bootstrap(ranks: DataFrame, incumbent: DataFrame, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """low and high of each system: the 2.5 and 97.5 percentiles of its gain in found queries over the incumbent.

    ranks: system, query_id, rank (null: not found); incumbent: query_id, rank. Queries are drawn jointly for both, by
    one seeded generator, so results repeat draw by draw. A system's gains, a byte a query, are in one row and drawn in
    one call: for a query set that people write. Beyond that, `bootstrap_counts` draws in every task.
    """
    gain = gains(ranks, incumbent)
    order = F.row_number().over(Window.partitionBy("system").orderBy("query_id")) - 1
    vectors = gain.withColumn("at", order).groupBy("system").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "gain"))), lambda x: x["gain"].cast("byte")).alias("gains"))

    def draws(pdf: pd.DataFrame) -> pd.Series:
        out = []
        for gains in pdf.gains:
            rng, n = random.Random(seed), len(gains)
            out.append([sum(gains[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples)])
        return pd.Series(out)

    means = vectors.select("system", F.explode(F.pandas_udf(draws, "array<double>")(F.struct("gains"))).alias("gain"))
    return means.groupBy("system").agg(F.round(percentile("gain", 0.025), 6).alias("low"), F.round(percentile("gain", 0.975), 6).alias("high"))


def flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries that only one of two runs finds: gained (b alone) or lost (a alone); both: query_id, rank."""
    both = a.select("query_id", F.col("rank").alias("before")).join(b.select("query_id", F.col("rank").alias("after")), "query_id")
    flip = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "gained").when(F.col("before").isNotNull() & F.col("after").isNull(), "lost")
    return both.select("query_id", flip.alias("flip")).where("flip IS NOT NULL")


def verdict(systems: DataFrame, incumbent: Column) -> DataFrame:
    """Adds wins (recall 0.05 above the incumbent's, no lower reciprocal rank, a p95 under 300 ms) and best, of the winners
    the one with the highest recall, then reciprocal rank; systems: name, recall, mrr, p95."""
    base = systems.where(incumbent).select(F.col("recall").alias("__recall"), F.col("mrr").alias("__mrr")).limit(1)
    wins = (F.col("recall") >= F.col("__recall") + 0.05 - 1e-9) & (F.col("mrr") >= F.col("__mrr") - 1e-9) & (F.col("p95") < 300)
    judged = systems.join(F.broadcast(base)).withColumn("wins", wins & ~incumbent).drop("__recall", "__mrr")
    top = judged.where("wins").orderBy(F.desc("recall"), F.desc("mrr"), "name").limit(1).select("name", F.lit(True).alias("best"))
    return judged.join(F.broadcast(top), "name", "left").withColumn("best", F.coalesce("best", F.lit(False)))


def missing_targets(queries: DataFrame, live: DataFrame) -> DataFrame:
    """query_id and target of targets that no live path has; queries: query_id, targets; live: path."""
    return queries.select("query_id", F.explode("targets").alias("target")).join(live.select(F.col("path").alias("target")), "target", "left_anti").select("query_id", "target")


def bake_off(queries: DataFrame, runs: DataFrame, latencies: DataFrame, incumbent: str) -> tuple[DataFrame, DataFrame]:
    """(scores, intervals) of systems that searched the same queries.

    queries: query_id, targets; runs: system, query_id, position, path; latencies: system, query_id, ms. Scores: name,
    n, recall, mrr, hit1, p95, wins, best.
    """
    wanted = queries.select("query_id", F.explode("targets").alias("path"))
    systems = runs.select("system").distinct()
    distinct = runs.groupBy("system", "query_id", "path").agg(F.min("position").alias("position"))
    placed = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("system", "query_id").orderBy("position"))).where(F.col("rank") <= DEPTH)
    hits = placed.join(wanted, ["query_id", "path"]).groupBy("system", "query_id").agg(F.min("rank").alias("rank"))
    ranks = systems.join(queries.select("query_id")).join(hits, ["system", "query_id"], "left")
    p95 = latencies.groupBy(F.col("system").alias("name")).agg(percentile("ms", 0.95).alias("p95"))
    scores = summary(ranks, "system").withColumnRenamed("system", "name").join(p95, "name", "left").withColumn("p95", F.coalesce("p95", F.lit(0.0)))
    old = ranks.where(F.col("system") == incumbent).select("query_id", "rank")
    return verdict(scores, F.col("name") == incumbent), bootstrap(ranks.where(F.col("system") != incumbent), old)
