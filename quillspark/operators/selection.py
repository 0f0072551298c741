"""Best-of-N selection, seed sweeps and comparison reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.metrics import token_jaccard

WIN_MARGIN = 0.01
Scorer = Callable[[Column, Column], Column]


def best_of_n(groups: DataFrame, score: Scorer = token_jaccard) -> DataFrame:
    """Rows (pmcid, input, gt, greedy, candidates) with the chosen output and its scores.

    The first best candidate wins; the greedy output wins ties with it. Scored in place: no shuffle.
    """
    scores = F.transform("candidates", lambda c: score(c, F.col("gt")))
    return chosen(groups.withColumn("_scores", scores).withColumn("_greedy", score(F.col("greedy"), F.col("gt"))), "_scores", "_greedy")


def chosen(groups: DataFrame, scores: str, greedy_score: str) -> DataFrame:
    """best_of_n of rows whose scores are there: an array along ``candidates``, and the greedy output's."""
    scored = F.transform(F.arrays_zip(F.col(scores).alias("s"), F.col("candidates").alias("c")), lambda x, i: F.struct(x["s"].alias("score"), (-i).alias("back"), x["c"].alias("text")))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.greatest(F.size(scores), F.lit(1))
    out = groups.select("pmcid", "input", "greedy", F.col(greedy_score).alias("greedy_score"), F.array_max(scored).alias("_best"), mean.alias("mean_score"))
    out = out.withColumn("best_score", F.coalesce(F.col("_best.score"), F.lit(-1.0)))
    greedy = F.col("greedy_score") >= F.col("best_score")
    return out.select(
        "pmcid",
        "input",
        F.when(greedy, F.col("greedy")).otherwise(F.col("_best.text")).alias("output"),
        F.greatest("greedy_score", "best_score").alias("chosen_score"),
        "greedy_score",
        "best_score",
        "mean_score",
        greedy.alias("used_greedy"),
    )


def selection_stats(chosen: DataFrame) -> DataFrame:
    """One row: means of greedy, chosen and mean candidate scores, rows, and how often a candidate beat greedy."""
    return chosen.agg(
        F.avg("greedy_score").alias("greedy_mean"),
        F.avg("chosen_score").alias("best_mean"),
        F.avg("mean_score").alias("candidate_mean"),
        F.count("*").alias("n"),
        F.count_if(F.col("best_score") > F.col("greedy_score")).alias("beat_greedy"),
    )


def running_mean(df: DataFrame, order: str, value: str, every: int = 20, block: int = 10_000) -> DataFrame:
    """The mean of all rows so far at every 20th row of a whole-number order without repeats.

    Rows are ranked inside blocks of the order, and only the blocks' totals, one row each, are ordered in one task.
    """
    rows = df.select(F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), F.floor(F.col(order) / block).alias("_b"))
    totals = rows.groupBy("_b").agg(F.count("*").alias("n"), F.sum("_v").alias("s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, zero: F.coalesce(F.sum(c).over(before), F.lit(zero))
    starts = totals.select("_b", so_far("n", 0).alias("n0"), so_far("s", 0.0).alias("s0"))
    own = Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.select("_b", "_o", F.count("*").over(own).alias("i"), F.sum("_v").over(own).alias("t"))
    n = F.col("n0") + F.col("i")
    out = ranked.join(starts, "_b").select(F.col("_o").alias(order), n.alias("rows"), ((F.col("s0") + F.col("t")) / n).alias("mean"))
    return out.where(F.col("rows") % every == 0)


def compare(df: DataFrame, a: str, b: str, margin: float = WIN_MARGIN) -> DataFrame:
    """One row: wins of each score over the other by more than the margin, ties, and both means."""
    diff = F.col(a) - F.col(b)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(diff > margin).alias(f"wins_{a}"),
        F.count_if(diff < -margin).alias(f"wins_{b}"),
        F.count_if(F.abs(diff) <= margin).alias("ties"),
        F.avg(a).alias(f"mean_{a}"),
        F.avg(b).alias(f"mean_{b}"),
    )


def best_seed(predictions: DataFrame) -> DataFrame:
    """Of rows (ord, seed, predicted, reference) the seed of most agreement; the first of equals."""
    each = predictions.groupBy("ord", "seed").agg(F.count_if(F.col("predicted") == F.col("reference")).alias("agreed"))
    return each.agg(
        F.max_by("seed", F.struct("agreed", (-F.col("ord")).alias("back"))).alias("seed"), F.max("agreed").alias("agreed")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def spliced(base: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """``base`` with one column taken from ``patch`` where that has the key, columns in order."""
    new = patch.select(key, F.col(column).alias("_new"))
    joined = base.join(new, key, "left").withColumn(column, F.coalesce("_new", column))
    return joined.select(*base.columns)
