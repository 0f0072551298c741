"""Interaction audit of filters: what each removes in every order, and its Shapley share of all removals.

Every document has a mask of the filters that it fails; counts by part and mask are all that leaves the documents. They
make each part's removal polynomial, the multilinear extension of "documents removed by a set of filters":

    f(x) = sum over masks m of n[m] * (1 - product over i in m of (1 - x[i]))  =  sum over sets T of a[T] * product over i in T of x[i]

with a[T] = (-1)^(|T| + 1) times the documents that fail all of T. A corner of the cube is a set of applied filters, and
its value the documents that the set removes; survivors, removals and redundancy in an order are differences of corners.
A filter's Shapley value is the integral of its partial derivative along the diagonal, sum over T with i of a[T] / |T|:
rationals with a common denominator, so scaled by n! (120 for five filters) they are whole numbers, added exactly.
A second and a third polynomial count documents of good and of toxic label.

Identity of texts is by SHA-256. The least id of a text is found by an aggregate, and joined back on (text, id), a key that
copies of one text do not share; so no group of copies meets in one task.

Defined results: a null text is an empty one; a null part is the empty string; a document without an id has no smaller one and is no
other's; rows that share an id are documents of their own, good if any label row of their id says so; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

LETTERS = "ABCDE"
BREAK = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> list[Column]:
    """Failures A to D of a text that is not null."""
    words = F.filter(F.split(text, BREAK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 50, F.lit(100) * distinct < F.lit(65) * n, F.lit(100) * capitals.cast("long") > F.lit(5) * F.length(text), text.rlike(r"[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic): one row per document; bit i of the mask is failure of LETTERS[i]."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(text))), F.lit(0))
    # read twice by what follows, and narrow: written once
    rows = common.checkpointed(docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits")))
    least = rows.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(has("quality"), has("toxic")).where(F.col("quality") | F.col("toxic"))
    mask = F.col("bits") + F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    marked = lambda c: F.coalesce(c, F.lit(False))
    named = rows.where(F.col("id").isNotNull()).join(least, ["digest", "id"], "left").join(marks, "id", "left")
    named = named.select("part", mask.alias("mask"), marked("quality").alias("good"), marked("toxic").alias("toxic"))
    return named.unionByName(rows.where(F.col("id").isNull()).select("part", F.col("bits").alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def polynomials(rows: DataFrame, filters: int) -> DataFrame:
    """(part, n, f, good, toxic): coefficients of the removal polynomials by set, a bit mask, from rows of ``masked``."""
    one = {"f": F.lit(1), "good": F.col("good").cast("int"), "toxic": F.col("toxic").cast("int")}
    counts = rows.groupBy("part", "mask").agg(*(F.sum(v).alias(f"n_{k}") for k, v in one.items()))

    def coefficient(kind: str, s: int) -> Column:
        fails = F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) == s, F.col(f"n_{kind}"))), F.lit(0)).cast("long")
        return F.lit(0).cast("long") if s == 0 else fails if s.bit_count() % 2 else -fails

    return counts.groupBy("part").agg(F.sum("n_f").alias("n"), *(F.array(*(coefficient(k, s) for s in range(1 << filters))).alias(k) for k in one))


def _corners(coefficients: Column, filters: int) -> Column:
    """The polynomial's values at all corners: the sum of the coefficients of each set's subsets."""
    pick = lambda s: sum((coefficients[t] for t in range(1, 1 << filters) if t & s == t), F.lit(0).cast("long"))
    return F.array(*(pick(s) for s in range(1 << filters)))


def _shapley(coefficients: Column, i: int, filters: int) -> Column:
    """n! times the integral over t in [0, 1] of the polynomial's derivative by x[i] at (t, ..., t)."""
    whole = math.factorial(filters)
    # the derivative's power of t is |T| - 1, which integrates to 1 / |T|: a whole number of parts of n!
    return sum((coefficients[s] * (whole // s.bit_count()) for s in range(1, 1 << filters) if s >> i & 1), F.lit(0).cast("long"))


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The report over all orders of the filters, from rows (part, mask, good, toxic); n! * n rows a part."""
    n = len(letters)
    full = (1 << n) - 1
    values = polynomials(rows, n).select("part", "n", *(_corners(F.col(k), n).alias(k) for k in ("f", "good", "toxic")), F.array(*(_shapley(F.col("f"), i, n) for i in range(n))).alias("shares"))
    steps = [
        {"filter_order": order, "step": k + 1, "i": letters.index(c), "own": 1 << letters.index(c), "before": sum(1 << letters.index(x) for x in order[:k])}
        for order in map("".join, permutations(letters))
        for k, c in enumerate(order)
    ]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, own: int, before: int>>")
    out = values.select("*", F.inline(plan))
    own = F.col("own")
    after = F.col("before").bitwiseOR(own)
    at = lambda k, s: F.get(F.col(k), s)
    lost = lambda k: (at(k, after) - at(k, F.col("before")))
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - at("f", after)).alias("kept"),
        lost("f").alias("removed"),
        (at("f", own) - lost("f")).alias("redundant"),
        (at("f", F.lit(full)) - at("f", F.lit(full).bitwiseXOR(own))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        at("shares", F.col("i")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masked(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")))
