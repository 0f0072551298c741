"""Joins, splits, selection and report queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.prompts import TASK_PREFIX
from quillspark.operators import decoding, lineage, selection, sweep, tokens, training
from quillspark.plans import carriers as C
from quillspark.plans import scorer_job, similarity
from quillspark.plans.extraction import documents
from quillspark.sources.tables import clean_sheet, ids


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def label_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents whose output is fit to learn from."""
    docs = documents(spark, sf_dir, input=C.ABSTRACT, output="CASE WHEN doc_id % 9 = 0 THEN 'None' ELSE substring(coalesce(text, ''), 1, 200) END")
    usable = training.usable_examples(docs).join(_labels(spark, sf_dir).select("doc_id", "quality"), "doc_id")
    return usable.select("doc_id", "quality", F.length("output").cast("long").alias("chars"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a sheet with ids held as numbers, blanks and padded headers, cleaned."""
    raw = _labels(spark, sf_dir).select(
        F.col("doc_id").cast("double").alias(" pmcids "), F.expr("CASE WHEN quality = 1 THEN ' INTERVENTIONAL ' END").alias("study_type ")
    )
    return clean_sheet(raw).select("pmcids", training.label_of(F.col("study_type")).alias("study_type"))


def default_row_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the defaults where it has no label."""
    named = _labels(spark, sf_dir).select("doc_id", F.when(F.col("quality") == 1, "OBSERVATIONAL").otherwise("INTERVENTIONAL").alias("study_type"))
    out = documents(spark, sf_dir).join(named, "doc_id", "left")
    return out.select("doc_id", F.coalesce("study_type", F.lit("INTERVENTIONAL")).alias("study_type"), F.lit("18 Years").alias("minimum_age"))


def column_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = documents(spark, sf_dir, study_type="CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END", sex="'ALL'")
    patch = _labels(spark, sf_dir).select("doc_id", F.concat(F.lit("Q"), "quality").alias("study_type"))
    return selection.spliced(base, patch, "doc_id", "study_type")


def semi_join_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = _labels(spark, sf_dir).select(F.col("doc_id").cast("double").cast("string"))
    present = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("pmcid"))
    return ids(sheet).join(present, "pmcid", "left_semi")


def train_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, t=C.TEXT)
    out = training.length_stats(df, "t")
    return out.select("n_rows", F.col("median").cast("double"), F.col("longest").cast("long"), F.col("p95").cast("long"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.hashed_split(documents(spark, sf_dir), "doc_id")


def shuffled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded shuffle of the ordered ids, on the labelled ones."""
    return training.shuffled_split(_labels(spark, sf_dir).select("doc_id"), "doc_id")


_WORD = "concat('age ', 10 + doc_id % {0}, ' years with disease ', doc_id % {1})"
_GROUPS = {
    "input": C.TITLE,
    "gt": _WORD.format(50, 7),
    "greedy": _WORD.format(40, 7),
    "candidates": f"array({_WORD.format(30, 5)}, {_WORD.format(50, 5)}, {_WORD.format(50, 5)}, {_WORD.format(20, 7)}, 'age')",
}


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, **_GROUPS).withColumn("pmcid", F.col("doc_id").cast("string"))
    return selection.best_of_n(df)


def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("chosen_score", "greedy_score", "best_score", "mean_score")]
    return _chosen(spark, sf_dir).select("pmcid", "output", *rounded, "used_greedy")


def raft_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.selection_stats(_chosen(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in ("greedy_mean", "best_mean", "candidate_mean")), "n", "beat_greedy")


def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, value="doc_id * 7 % 101").groupBy("doc_id").agg(F.min("value").alias("value"))
    out = selection.running_mean(df, "doc_id", "value", block=250)
    return out.select("doc_id", "rows", F.round("mean", 6).alias("mean"))


def ab_win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, a="CAST(doc_id % 11 AS DOUBLE) / 10", b="CAST(doc_id % 7 AS DOUBLE) / 6")
    out = selection.compare(df, "a", "b")
    return out.select("n", "wins_a", "wins_b", "ties", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


def seed_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir, ord="doc_id % 5", seed="(doc_id % 5) * 11", predicted="doc_id % 3", reference="doc_id % 2")
    return selection.best_seed(df)


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.class_counts(_labels(spark, sf_dir), "quality")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.accuracy(_labels(spark, sf_dir), "quality", "toxic")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"))


def tfidf_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study type from a model fitted on the labelled carriers, for every document."""
    df = documents(spark, sf_dir, title=C.TITLE, body=C.ABSTRACT)
    text = training.model_text(F.col("title"), F.lit(""), F.col("body"))
    df = df.select("doc_id", text.alias("text"))
    label = F.when(F.col("quality") == 1, training.LABELS[0]).otherwise(training.LABELS[1])
    fitted = training.fit_study_type(df.join(_labels(spark, sf_dir), "doc_id").select("text", label.alias("label")))
    return df.select("doc_id", F.lit(training.LABELS[0]).alias("study_type")) if fitted is None else fitted.transform(df).select("doc_id", "study_type")


#: Seeds of the sweep; every so many-th labelled document is held out as the reference.
SWEPT, HELD = (7, 42, 1), 3


def _swept(spark: SparkSession, sf_dir: str) -> tuple[sweep.Sweep, DataFrame]:
    """A model a seed from two thirds of the labelled carriers, and all documents with their predictions; the other third's labels are the reference."""
    label = F.when(F.col("quality") == 1, training.LABELS[0]).otherwise(training.LABELS[1])
    named = _labels(spark, sf_dir).select("doc_id", label.alias("label"))
    df = documents(spark, sf_dir, title=C.TITLE, body=C.ABSTRACT)
    df = df.select("doc_id", training.model_text(F.col("title"), F.lit(""), F.col("body"), strip=True).alias("text")).join(named, "doc_id", "left")
    held = F.col("doc_id") % HELD == 0
    models = sweep.train(df.where(~held), "doc_id", "text", "label", SWEPT)
    return models, lineage.kept(models.predicted(df, "text").select("doc_id", "predicted", F.when(held, F.col("label")).alias("reference")))


def seed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a seed: agreement with the reference, predicted interventional, and whether it is the one chosen."""
    models, rows = _swept(spark, sf_dir)
    return models.results(rows, "reference").select("seed", "agreed", "interventional", "n", (F.col("ord") == models.chosen(rows, "reference")).alias("chosen"))


def seed_sweep_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's study type by the chosen seed."""
    models, rows = _swept(spark, sf_dir)
    return rows.select("doc_id", F.col("predicted")[models.chosen(rows, "reference")].alias("study_type"))


def _job(spark: SparkSession, sf_dir: str, score: Callable[[DataFrame], DataFrame]) -> tuple[str, DataFrame]:
    folder = f"{lineage.folder(spark)}/scorer-{uuid.uuid4().hex}"
    groups = documents(spark, sf_dir, **_GROUPS).withColumn("pmcid", F.col("doc_id").cast("string"))
    return folder, scorer_job.run(groups, folder, score, ranges=3)


def scorer_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of N by FM3S from plain text, as a job in ranges."""
    _, rows = _job(spark, sf_dir, scorer_job.fm3s_chosen(similarity.document_tagger(spark, sf_dir)))
    return rows.select("pmcid", "output", *(F.round(c, 6).alias(c) for c in ("chosen_score", "mean_score")), "used_greedy")


def scorer_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a job's ledger, by token overlap."""
    folder, _ = _job(spark, sf_dir, selection.best_of_n)
    return scorer_job.statistics(spark, folder).select(*(F.round(c, 6).alias(c) for c in ("greedy_mean", "best_mean", "candidate_mean")), "n", "beat_greedy")


def word_successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each context of one or two words over all documents: what follows it, in kinds and in all."""
    return decoding.contexts(documents(spark, sf_dir, t=C.TEXT), "t")


def decoded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best beam and eight samples, from a model of two thirds of the eligibility carriers."""
    df = documents(spark, sf_dir, gold=C.ELIGIBILITY, prompt=C.METHODS)
    model = decoding.train(df.where(F.col("doc_id") % HELD != 0), "gold")
    out = decoding.decoded(df, "doc_id", "prompt", model, longest=32)
    return out.select("doc_id", "greedy", F.array_join("candidates", "|").alias("candidates"))


def tokenised_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a training example in token ids: their numbers and checksums."""
    import public_tokenizers as public

    df = documents(spark, sf_dir, input=C.ABSTRACT, output=C.ELIGIBILITY)
    out = tokens.tokenised(df, "input", "output", public.path("byte_bpe_50k.json"), TASK_PREFIX)
    of = lambda c, n: (F.size(c).cast("long").alias(f"{n}_tokens"), F.crc32(F.array_join(c, ",").cast("binary")).alias(f"{n}_crc32"))
    return out.select("doc_id", *of("input_ids", "input"), *of("labels", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        label_join_filter, sheet_rows, default_row_left_join, column_splice, semi_join_present, train_split_stats, hash_split, shuffled_split,
        best_of_n, raft_stats, running_mean, ab_win_counts, seed_argmax, class_counts, accuracy, tfidf_lr, seed_sweep, seed_sweep_column,
        scorer_job_rows, scorer_job_stats, word_successions, decoded_candidates, tokenised_examples,
    )
}

_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_JAC = "(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))))"
_CAND = _GROUPS["candidates"].removeprefix("array(").removesuffix(")")
_CHOSEN = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS pmcid, {_GROUPS["gt"]} AS gt, {_GROUPS["greedy"]} AS greedy, [{_CAND}] AS c FROM documents),
    s AS (SELECT *, list_transform(c, lambda x: {_JAC.format(_TOK.format("x"), _TOK.format("gt"))}) AS sc, {_JAC.format(_TOK.format("greedy"), _TOK.format("gt"))} AS g FROM d),
    b AS (SELECT *, list_max(sc) AS best, list_sum(sc) / len(sc) AS mean FROM s)"""

ORACLES = {
    "hash_split": "SELECT doc_id, CASE WHEN CAST(concat('0x', substring(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 10 THEN 'val' ELSE 'train' END AS split FROM documents",
    "label_join_filter": f"""WITH d AS (SELECT doc_id, {C.ABSTRACT} AS input, CASE WHEN doc_id % 9 = 0 THEN 'None' ELSE substring(coalesce(text, ''), 1, 200) END AS output FROM documents)
        SELECT doc_id, quality, length(output) AS chars FROM d JOIN labels USING (doc_id) WHERE output NOT IN ('', 'None') AND length(output) >= 30 AND length(input) >= 100""",
    "sheet_rows": "SELECT CAST(doc_id AS VARCHAR) AS pmcids, CASE WHEN quality = 1 THEN 'INTERVENTIONAL' END AS study_type FROM labels",
    "default_row_left_join": """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type, '18 Years' AS minimum_age
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "column_splice": """SELECT d.doc_id, coalesce('Q' || CAST(quality AS VARCHAR), CASE WHEN d.doc_id % 2 = 0 THEN 'A' ELSE 'B' END) AS study_type, 'ALL' AS sex
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "semi_join_present": "SELECT CAST(doc_id AS VARCHAR) AS pmcid FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "train_split_stats": f"""WITH d AS (SELECT length({C.TEXT}) AS n FROM documents), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM d)
        SELECT count(*) AS n_rows, CAST(median(n) AS DOUBLE) AS median, max(n) AS longest, max(CASE WHEN i = CAST(floor(0.95 * c) AS BIGINT) THEN n END) AS p95 FROM s""",
    "best_of_n": _CHOSEN
    + """SELECT pmcid, CASE WHEN g >= best THEN greedy ELSE c[list_position(sc, best)] END AS output, round(greatest(g, best), 6) AS chosen_score, round(g, 6) AS greedy_score,
        round(best, 6) AS best_score, round(mean, 6) AS mean_score, g >= best AS used_greedy FROM b""",
    "raft_stats": _CHOSEN
    + """SELECT round(avg(g), 6) AS greedy_mean, round(avg(greatest(g, best)), 6) AS best_mean, round(avg(mean), 6) AS candidate_mean, count(*) AS n,
        count(*) FILTER (best > g) AS beat_greedy FROM b""",
    "scorer_job_stats": _CHOSEN
    + """SELECT round(avg(g), 6) AS greedy_mean, round(avg(greatest(g, best)), 6) AS best_mean, round(avg(mean), 6) AS candidate_mean, count(*) AS n,
        count(*) FILTER (best > g) AS beat_greedy FROM b""",
    "word_successions": """WITH d AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT w, unnest(range(1, len(w) + 2)) AS i FROM d WHERE len(w) > 0),
        r AS (SELECT ' ' AS a, w[i - 1] AS b, w[i] AS c FROM p WHERE i > 1 UNION ALL SELECT ' ', NULL, w[1] FROM p WHERE i = 1
            UNION ALL SELECT CASE WHEN i > 2 THEN w[i - 2] END, w[i - 1], w[i] FROM p WHERE i > 1),
        n AS (SELECT a, b, c, count(*) AS n FROM r GROUP BY ALL)
        SELECT coalesce(a, '-') AS a, coalesce(b, '-') AS b, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL""",
    "running_mean": """WITH d AS (SELECT doc_id, CAST(min(doc_id * 7 % 101) AS DOUBLE) AS v FROM documents GROUP BY doc_id),
        w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rows, avg(v) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS m FROM d)
        SELECT doc_id, rows, round(m, 6) AS mean FROM w WHERE rows % 20 = 0""",
    "ab_win_counts": """WITH d AS (SELECT CAST(doc_id % 11 AS DOUBLE) / 10 AS a, CAST(doc_id % 7 AS DOUBLE) / 6 AS b FROM documents)
        SELECT count(*) AS n, count(*) FILTER (a - b > 0.01) AS wins_a, count(*) FILTER (a - b < -0.01) AS wins_b, count(*) FILTER (abs(a - b) <= 0.01) AS ties,
        round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM d""",
    "seed_argmax": """WITH e AS (SELECT doc_id % 5 AS ord, (doc_id % 5) * 11 AS seed, count(*) FILTER (doc_id % 3 = doc_id % 2) AS agreed FROM documents GROUP BY 1, 2)
        SELECT seed, agreed FROM e ORDER BY agreed DESC, ord LIMIT 1""",
    "class_counts": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "accuracy": "SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels",
}
