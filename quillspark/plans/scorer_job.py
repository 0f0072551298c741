"""Best-of-N scoring as a job that can be broken off and started again.

The job's folder holds ``input`` (the candidate groups, dealt once into ranges of a hash), ``scored`` (the chosen outputs with their
scores, a folder a range), ``ledger`` (a row a finished range, with its sums), and at the end ``train`` (JSON lines pmcid, input, output) and ``stats``
(one JSON object). A range counts as finished by its ledger row alone, which is written after the range's rows. What a range
left half-written is written over, so a job that was stopped anywhere and started again ends as one that was never stopped.

Each range reads only its own folder, and is a Spark job of its own: ``ranges`` should leave each large enough to fill the cluster. Sums are exact
decimals, so no order of rows or ranges changes the figures. Nothing but ledger rows reaches the driver.

Defined results: repeated rows are all kept; null candidates are no candidates, null texts score 0; no groups give empty outputs and null means; other columns are
left out. A folder goes on with the input that it was started with; another number of ranges there is refused (ValueError).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import lineage, selection
from quillspark.operators.tagger import Tagger
from quillspark.operators.taxonomy import Taxonomy
from quillspark.plans import inference
from quillspark.sources import tables

RANGES = 16
GROUP = ("pmcid", "input", "gt", "greedy", "candidates")
MEANS = {"greedy": "greedy_score", "best": "chosen_score", "candidate": "mean_score"}
_SUM = "decimal(38,15)"
LEDGER = f"range int, n long, beat_greedy long, {', '.join(f'{k} {_SUM}' for k in MEANS)}"


def fm3s_chosen(tagger: Tagger, words: Taxonomy | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``run``: selection by FM3S from plain text. A gold text is tagged once, each output once."""

    def score(groups: DataFrame) -> DataFrame:
        # a row's number is written with it, as reading may divide the rows otherwise each time
        groups = groups.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
        groups = lineage.kept(groups.withColumn("_row", F.monotonically_increasing_id().cast("string")))
        gold = inference.annotated(groups.select("_row", "gt", "greedy", "candidates"), "_row", tagger, _gold="gt")
        outputs = gold.select("_row", "gt", "_gold", F.posexplode(F.concat(F.array("greedy"), "candidates")).alias("place", "text"))
        outputs = outputs.withColumn("_output", F.concat_ws(" ", "_row", F.col("place").cast("string")))
        scored = inference.fm3s_scored(outputs, "_output", "text", "gt", tagger, words, "score", "_gold")
        # as many entries as a group has candidates
        listed = F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("score", F.lit(0.0)).alias("score")))), lambda x: x["score"])
        scores = scored.groupBy("_row").agg(listed.alias("_scores"))
        rows = groups.join(scores, "_row").withColumn("_greedy", F.col("_scores")[0]).withColumn("_scores", F.slice("_scores", F.lit(2), F.size("candidates")))
        return selection.chosen(rows, "_scores", "_greedy")

    return score


def run(groups: DataFrame, folder: str, score: Callable[[DataFrame], DataFrame], ranges: int = RANGES) -> DataFrame:
    """Scores all groups, or what is left of them, and returns all scored rows."""
    spark = groups.sparkSession
    _stage(groups, folder, ranges)
    source = spark.read.schema(groups.select(*GROUP).schema.add("range", "integer")).parquet(f"{folder}/input")
    done = finished(spark, folder)
    for k in range(ranges):
        if k not in done:
            _score_range(spark, source.where(F.col("range") == k).select(*GROUP), folder, k, score)
    scored = spark.read.parquet(*(f"{folder}/scored/range={k}" for k in range(ranges)))
    tables.write_examples(scored.select("pmcid", "input", "output"), f"{folder}/train")
    tables.write_stats(statistics(spark, folder), f"{folder}/stats")
    return scored


def _stage(groups: DataFrame, folder: str, ranges: int) -> None:
    """Deals the groups into ranges, once: the plan's mark is the last that is written."""
    spark = groups.sparkSession
    if not tables.exists(spark, f"{folder}/plan/_SUCCESS"):
        dealt = groups.select(*GROUP, F.pmod(F.xxhash64("pmcid", "input", "gt", "greedy"), F.lit(ranges)).cast("int").alias("range"))
        dealt.hint("rebalance", F.col("range")).write.mode("overwrite").partitionBy("range").parquet(f"{folder}/input")
        spark.range(ranges, ranges + 1, 1, 1).toDF("ranges").write.mode("overwrite").parquet(f"{folder}/plan")
    planned = spark.read.parquet(f"{folder}/plan").first()["ranges"]
    if planned != ranges:
        raise ValueError(f"the job in {folder} has {planned} ranges")


def _score_range(spark: SparkSession, groups: DataFrame, folder: str, k: int, score: Callable[[DataFrame], DataFrame]) -> None:
    path = f"{folder}/scored/range={k}"
    score(groups).write.mode("overwrite").parquet(path)
    sums = (F.coalesce(F.sum(F.col(c).cast(_SUM)), F.lit(0).cast(_SUM)).cast(_SUM).alias(n) for n, c in MEANS.items())
    entry = spark.read.parquet(path).agg(F.lit(k).alias("range"), F.count("*").alias("n"), F.count_if(F.col("best_score") > F.col("greedy_score")).alias("beat_greedy"), *sums)
    entry.write.mode("append").parquet(f"{folder}/ledger")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A row a finished range; one that two runs finished counts once."""
    path = f"{folder}/ledger"
    rows = spark.read.schema(LEDGER).parquet(path) if tables.exists(spark, path) else spark.createDataFrame([], LEDGER)
    return rows.dropDuplicates(["range"])


def finished(spark: SparkSession, folder: str) -> set[int]:
    """Ranges whose rows are whole."""
    return {r["range"] for r in ledger(spark, folder).select("range").collect()}


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """One row as selection.selection_stats gives it, from the sums in the ledger."""
    n = F.sum("n")
    means = (F.try_divide(F.sum(k).cast("double"), n).alias(f"{k}_mean") for k in MEANS)
    return ledger(spark, folder).agg(*means, F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(F.sum("beat_greedy"), F.lit(0)).alias("beat_greedy"))
