"""Age, sex and study-type queries over carrier texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ages, rules
from quillspark.plans import carriers as C


def documents(spark: SparkSession, sf_dir: str, **carried: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select("doc_id", *(F.expr(sql).alias(name) for name, sql in carried.items()))


def _aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, elig=C.ELIGIBILITY, meth=C.METHODS)
    return ages.with_ages(df, F.col("elig"), F.col("meth"))


def incl_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, elig=C.ELIGIBILITY)
    return df.select("doc_id", ages.inclusion_sentences(F.col("elig")).alias("sentences"))


def age_range_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ages.ranges(ages.normalised(F.col("elig")))
    df = documents(spark, sf_dir, elig=C.ELIGIBILITY).select("doc_id", found.alias("r"))
    low, high = F.array_min(F.transform("r", lambda x: x["low"])), F.array_max(F.transform("r", lambda x: x["high"]))
    return df.select("doc_id", F.size("r").cast("long").alias("n_ranges"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def age_min_max_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, elig=C.ELIGIBILITY)
    low, high = ages.bound(F.col("elig"), ages.LOWER), ages.bound(F.col("elig"), ages.UPPER)
    return df.select("doc_id", low.cast("long").alias("lower"), high.cast("long").alias("upper"))


def age_fold_two_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aged(spark, sf_dir).select("doc_id", F.col("age_low").cast("long"), F.col("age_high").cast("long"), "minimum_age", "maximum_age")


def max_age_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aged(spark, sf_dir).groupBy("maximum_age").agg(F.count("*").alias("n"))


def sex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, title=C.TITLE, abstract=C.ABSTRACT)
    none = F.lit("")
    return df.select("doc_id", rules.sex(F.col("title"), F.col("abstract"), none, none).alias("sex"))


def study_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, title=C.TITLE, abstract=C.ABSTRACT)
    scored = df.select("doc_id", rules.study_score(F.col("title"), F.col("abstract"), F.lit("")).cast("long").alias("score"))
    return scored.withColumn("study_type", rules.study_type(F.col("score")))


def nct_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, abstract=C.ABSTRACT)
    return df.select("doc_id", F.col("abstract").rlike(rf"(?U)\b{rules.TRIAL_ID}\b").alias("named"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (incl_sentences, age_range_extract, age_min_max_patterns, age_fold_two_texts, max_age_histogram, sex_rules, study_rule_score, nct_flag)
}


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sentences(text: str) -> str:
    return f"array_to_string(list_filter(regexp_extract_all({text}, '[^.;\\n]*[.;\\n]|[^.;\\n]+'), lambda s: regexp_matches(s, '{ages.CUES}', 'i')), ' ')"


def _ranges(text: str) -> str:
    group = lambda g: f"list_transform(regexp_extract_all({text}, '{_q(ages.RANGE)}', {g}, 'i'), lambda x: TRY_CAST(x AS BIGINT))"
    zipped = f"list_zip({group(1)}, {group(2)})"
    return f"list_filter({zipped}, lambda p: p[1] BETWEEN 1 AND 120 AND p[2] BETWEEN 1 AND 120 AND p[1] < p[2])"


def _low(r: str) -> str:
    return f"list_min(list_transform({r}, lambda p: p[1]))"


def _high(r: str) -> str:
    return f"list_max(list_transform({r}, lambda p: p[2]))"


def _bound(text: str, patterns: tuple[str, ...]) -> str:
    one = lambda p: f"TRY_CAST(nullif(regexp_extract({text}, '{_q(p)}', 1, 'i'), '') AS BIGINT)"
    return "coalesce(" + ", ".join(f"CASE WHEN {one(p)} BETWEEN 1 AND 120 THEN {one(p)} END" for p in patterns) + ")"


_FOLD = f"""
WITH d AS (SELECT doc_id, {C.ELIGIBILITY} AS e, {C.METHODS} AS m FROM documents),
s AS (SELECT *, {_sentences("e")} AS ei, {_sentences("m")} AS mi, trim(e) <> '' AS er, trim(m) <> '' AS mr FROM d),
a1 AS (SELECT *, CASE WHEN er THEN {_low(_ranges("ei"))} END AS l1, CASE WHEN er THEN {_high(_ranges("ei"))} END AS h1 FROM s),
a2 AS (SELECT *, CASE WHEN er AND l1 IS NULL THEN {_low(_ranges("e"))} ELSE l1 END AS l2,
  CASE WHEN er AND l1 IS NULL THEN greatest(h1, {_high(_ranges("e"))}) ELSE h1 END AS h2 FROM a1),
a3 AS (SELECT *, coalesce(l2, CASE WHEN er THEN {_bound("ei", ages.LOWER)} END) AS l3, coalesce(h2, CASE WHEN er THEN {_bound("e", ages.UPPER)} END) AS h3 FROM a2),
b0 AS (SELECT *, mr AND NOT (l3 IS NOT NULL AND h3 IS NOT NULL) AS go FROM a3),
b1 AS (SELECT *, CASE WHEN go THEN least(l3, {_low(_ranges("mi"))}) ELSE l3 END AS l4, CASE WHEN go THEN greatest(h3, {_high(_ranges("mi"))}) ELSE h3 END AS h4 FROM b0),
b2 AS (SELECT *, CASE WHEN go AND l4 IS NULL THEN {_low(_ranges("m"))} ELSE l4 END AS l5,
  CASE WHEN go AND l4 IS NULL THEN greatest(h4, {_high(_ranges("m"))}) ELSE h4 END AS h5 FROM b1),
f AS (SELECT doc_id, coalesce(l5, CASE WHEN go THEN {_bound("mi", ages.LOWER)} END) AS age_low, coalesce(h5, CASE WHEN go THEN {_bound("m", ages.UPPER)} END) AS age_high FROM b2),
r AS (SELECT doc_id, age_low, age_high, '18 Years' AS minimum_age, coalesce(concat(CAST(age_high AS VARCHAR), CASE WHEN age_high IS NULL THEN NULL ELSE ' Years' END), '') AS x FROM f),
o AS (SELECT doc_id, age_low, age_high, minimum_age, CASE WHEN x = '' THEN 'Not Specified' ELSE x END AS maximum_age FROM r)
"""


def _score() -> str:
    text = "concat(title, ' ', abstract)"
    parts = [f"CASE WHEN regexp_matches({text}, '\\b{p}\\b', 'i') THEN {w} ELSE 0 END" for w, ps in rules.STUDY_WEIGHTS.items() for p in ps]
    parts.append(f"CASE WHEN regexp_matches(abstract, '\\b(?:{rules.OBSERVATIONAL_ABSTRACT})\\b', 'i') THEN -3 ELSE 0 END")
    parts.append(f"CASE WHEN regexp_matches(abstract, '\\b(?:{rules.INTERVENTIONAL_ABSTRACT})\\b', 'i') THEN 3 ELSE 0 END")
    parts.append(f"CASE WHEN regexp_matches(abstract, '\\b{rules.TRIAL_ID}\\b') THEN 1 ELSE 0 END")
    return " + ".join(parts)


_MALE, _FEMALE = ("|".join(side) for side in (rules.MALE, rules.FEMALE))

ORACLES = {
    "incl_sentences": f"WITH d AS (SELECT doc_id, {C.ELIGIBILITY} AS e FROM documents) SELECT doc_id, {_sentences('e')} AS sentences FROM d",
    "age_range_extract": f"""WITH d AS (SELECT doc_id, {C.ELIGIBILITY} AS e FROM documents), r AS (SELECT doc_id, {_ranges("e")} AS r FROM d)
        SELECT doc_id, CAST(len(r) AS BIGINT) AS n_ranges, {_low("r")} AS low, {_high("r")} AS high FROM r""",
    "age_min_max_patterns": f"""WITH d AS (SELECT doc_id, {C.ELIGIBILITY} AS e FROM documents)
        SELECT doc_id, {_bound("e", ages.LOWER)} AS lower, {_bound("e", ages.UPPER)} AS upper FROM d""",
    "age_fold_two_texts": _FOLD + "SELECT doc_id, age_low, age_high, minimum_age, maximum_age FROM o",
    "max_age_histogram": _FOLD + "SELECT maximum_age, count(*) AS n FROM o GROUP BY maximum_age",
    "sex_rules": f"""WITH d AS (SELECT doc_id, concat({C.TITLE}, ' ', {C.ABSTRACT}) AS t FROM documents),
        h AS (SELECT doc_id, regexp_matches(t, '{_MALE}', 'i') AS m, regexp_matches(t, '{_FEMALE}', 'i') AS f FROM d)
        SELECT doc_id, CASE WHEN m AND NOT f THEN 'MALE' WHEN f AND NOT m THEN 'FEMALE' ELSE 'ALL' END AS sex FROM h""",
    "study_rule_score": f"""WITH d AS (SELECT doc_id, {C.TITLE} AS title, {C.ABSTRACT} AS abstract FROM documents),
        s AS (SELECT doc_id, CAST({_score()} AS BIGINT) AS score FROM d)
        SELECT doc_id, score, CASE WHEN score < 0 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type FROM s""",
    "nct_flag": f"WITH d AS (SELECT doc_id, {C.ABSTRACT} AS a FROM documents) SELECT doc_id, regexp_matches(a, '\\b{rules.TRIAL_ID}\\b') AS named FROM d",
}
