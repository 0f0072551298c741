"""Training examples: filters, lengths, splits; linear study-type model; hooks for fine-tuning."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import collapsed, first_filled

# Fixed values
LEAST_OUTPUT, LEAST_INPUT = 30, 100
#: Keys that the driver shuffles at most.
SHUFFLED = 1_000_000
LABELS = ("INTERVENTIONAL", "OBSERVATIONAL")
FEATURES, LEAST_TEXTS = 5000, 10


def usable_examples(df: DataFrame) -> DataFrame:
    """Rows (input, output) fit to learn from."""
    output = F.trim(F.coalesce("output", F.lit("")))
    return df.where((output != "") & (output != "None") & (F.length(output) >= LEAST_OUTPUT) & (F.length("input") >= LEAST_INPUT))


def skipped(df: DataFrame) -> DataFrame:
    """One row: how many rows (input, output) are used, and how many are left out for each reason, the first that holds."""
    output = F.trim(F.coalesce("output", F.lit("")))
    reason = F.when((output == "") | (output == "None"), "no_output").when(F.length(output) < LEAST_OUTPUT, "short_output")
    reason = reason.when(F.coalesce(F.length("input") < LEAST_INPUT, F.lit(True)), "short_input").otherwise("used")
    kinds = ("used", "no_output", "short_output", "short_input")
    return df.agg(*(F.count_if(reason == k).alias(k) for k in kinds))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """n, median, longest and the 95th percentile as the element at floor(0.95 n) of the ascending lengths.

    Lengths are counted first, so the window runs over distinct lengths, not over rows.
    """
    sizes = df.select(F.length(column).alias("n")).where("n is not null").groupBy("n").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("rows").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = sizes.select("n", upto.alias("upto"), total.alias("total"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    middle = (at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2
    return ranked.agg(F.max("total").alias("n_rows"), middle.alias("median"), F.max("n").alias("longest"), at(F.floor(F.col("total") * 0.95)).alias("p95"))


def validation_size(n: int) -> int:
    return max(20, n // 10)


def shuffled_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``split`` by a seeded shuffle of the keys in order, for sets of at most SHUFFLED keys; hashed_split is for any size."""
    keys = [r[0] for r in df.select(key).orderBy(key).limit(SHUFFLED + 1).collect()]
    if len(keys) > SHUFFLED:
        raise ValueError(f"over {SHUFFLED} keys: use hashed_split")
    random.Random(seed).shuffle(keys)
    held = keys[: validation_size(len(keys))]
    kind = T.StructType([T.StructField(key, df.schema[key].dataType)])
    out = df.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(held)], kind).withColumn("split", F.lit("val"))
    # at most a tenth of SHUFFLED keys, so their side is broadcast
    return df.join(F.broadcast(out), df[key].eqNullSafe(out[key]), "left").select(df["*"], F.coalesce("split", F.lit("train")).alias("split"))


def hashed_split(df: DataFrame, key: str, percent: int = 10) -> DataFrame:
    """Adds ``split`` by a hash of the key: no order, no gathering, any size."""
    fold = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(fold < percent, "val").otherwise("train"))


def model_text(title: Column, body: Column, abstract: Column, strip: bool = False) -> Column:
    """The whole text that a study type is learned from."""
    text = collapsed(F.lower(F.concat(title, F.lit(" "), first_filled(body, abstract))))
    return F.trim(text) if strip else text


def label_of(c: Column) -> Column:
    """A valid study type, else null."""
    name = F.upper(F.trim(c))
    return F.when(name.isin(*LABELS), name)


def fit_study_type(df: DataFrame) -> StudyTypeModel | None:
    """TF-IDF of words and word pairs with a balanced logistic regression on rows (text, label).

    Log term counts times ln((1 + n) / (1 + df)) + 1, in unit length. None with fewer than ten texts or one class.
    """
    df = df.where(F.col("label").isin(*LABELS) & (F.col("text") != "")).select("text", "label").persist()
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    n = sum(counts.values())
    if n < LEAST_TEXTS or len(counts) < 2:
        return None
    weighted = df.withColumn("weight", F.when(F.col("label") == LABELS[0], n / (2.0 * counts[LABELS[0]])).otherwise(n / (2.0 * counts[LABELS[1]])))
    grams = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\w{2,}", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
    ]
    names = _frequent(grams[0].transform(df).select("words"), FEATURES)
    counted = PipelineModel(stages=[*grams, CountVectorizerModel.from_vocabulary(names, inputCol="grams", outputCol="counts")])
    seen = IDF(inputCol="counts", outputCol="unused").fit(counted.transform(weighted)).docFreq
    idf = [math.log((1 + n) / (1 + d)) + 1 for d in seen]
    vectors = _features(counted.transform(weighted), idf).withColumn("y", (F.col("label") == LABELS[1]).cast("double"))
    linear = LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000
    )
    fitted = linear.fit(vectors)
    df.unpersist()
    return StudyTypeModel(counted, idf, fitted)


def _pairs(rows: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(gram, count) of neighbouring words that both stand in ``words`` (gram, count) with ``least`` at least: no other pair can be as frequent."""
    last = F.greatest(F.size("words") - 1, F.lit(0))
    both = F.explode(F.arrays_zip(F.slice("words", F.lit(1), last).alias("a"), F.slice("words", F.lit(2), last).alias("b")))
    pairs = rows.select(both.alias("x")).select("x.a", "x.b")
    known = words.where(F.col("count") >= least)
    for c in ("a", "b"):
        pairs = pairs.join(F.broadcast(known.select(F.col("gram").alias(c))), c, "left_semi")
    return pairs.groupBy(F.concat("a", F.lit(" "), "b").alias("gram")).count()


def _frequent(rows: DataFrame, most: int) -> list[str]:
    """The most frequent words and word pairs of rows (words), ties by the smaller one."""
    words = rows.select(F.explode("words").alias("gram")).groupBy("gram").count().persist()
    order = (F.desc("count"), "gram")
    top = words.orderBy(*order).limit(most).collect()
    pairs = _pairs(rows, words, top[-1]["count"] if len(top) == most else 1).orderBy(*order).limit(most).collect()
    words.unpersist()
    return [r["gram"] for r in sorted([*top, *pairs], key=lambda r: (-r["count"], r["gram"]))[:most]]


def _features(counted: DataFrame, idf: list[float]) -> DataFrame:
    """Adds ``features``, unit vectors of log counts times idf. Only a text's own terms are touched: nothing is as wide as the vocabulary.

    A text without a known term has an empty vector.
    """
    table = np.asarray(idf, dtype=np.float64)
    width = len(idf)

    @F.pandas_udf(VectorUDT())
    def weighed(counts: pd.DataFrame) -> pd.DataFrame:
        indices, values = counts["indices"].to_list(), counts["values"].to_list()
        rows = np.repeat(np.arange(len(values)), [len(v) for v in values])
        if len(rows):
            flat = (1 + np.log(np.concatenate(values))) * table[np.concatenate(indices)]
            flat /= np.sqrt(np.bincount(rows, flat * flat, len(values)))[rows]
            values = np.split(flat, np.searchsorted(rows, np.arange(1, len(values))))
        return pd.DataFrame({"type": np.zeros(len(values), np.int8), "size": np.full(len(values), width, np.int32), "indices": indices, "values": values})

    return counted.withColumn("features", weighed(F.unwrap_udt("counts")))


@dataclass
class StudyTypeModel:
    counted: PipelineModel
    idf: list[float]
    linear: LogisticRegressionModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``study_type`` to rows with a text."""
        scored = self.linear.transform(_features(self.counted.transform(df), self.idf))
        named = scored.withColumn("study_type", F.when(F.col("prediction") == 1.0, LABELS[1]).otherwise(LABELS[0]))
        return named.select(*df.columns, "study_type")

    def save(self, path: str) -> None:
        self.counted.write().overwrite().save(f"{path}/counts")
        self.linear.write().overwrite().save(f"{path}/linear")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.idf,)], "idf array<double>").write.mode("overwrite").parquet(f"{path}/idf")

    @classmethod
    def load(cls, path: str) -> StudyTypeModel:
        idf = SparkSession.getActiveSession().read.parquet(f"{path}/idf").first()["idf"]
        return cls(PipelineModel.load(f"{path}/counts"), list(idf), LogisticRegressionModel.load(f"{path}/linear"))


def fine_tune(train: DataFrame, trainer: Callable[[DataFrame], object], seeds: tuple[int, ...] = (7,)) -> dict[int, object]:
    """Runs an external trainer once a seed; training itself is outside the engine."""
    return {seed: trainer(train.withColumn("seed", F.lit(seed))) for seed in seeds}
