"""Retrieval, selection, splits, sheets, the linear model, and every query against its SQL."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quillspark.operators import retrieval, selection, training
from quillspark.plans import registry
from quillspark.sources import tables

SMALL = Path("/root/testdata/sf0.001")


def test_top_k_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[7] = x[3]
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (None, [1.0] * 5)], "id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.top_k(df, df, 3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    for q in range(60):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-score[q, i], -i))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == order


def test_few_shot_skips_rows_without_a_list(spark):
    hits = spark.createDataFrame([(0, i, i) for i in range(1, 7)], "query_id int, id int, rank int")
    index = spark.createDataFrame([(i, "['x']" if i % 2 else "") for i in range(1, 7)], "id int, conditions string")
    assert sorted(r["id"] for r in retrieval.few_shot(hits, index, 4).collect()) == [1, 3, 5]


def test_best_of_n(spark):
    score = lambda c, g: c.try_cast("double")
    rows = [("a", "i", "g", "0.5", ["0.4", "0.7", "0.70"]), ("b", "i", "g", "0.7", ["0.7"]), ("c", "i", "g", "0.2", [])]
    df = spark.createDataFrame(rows, "pmcid string, input string, gt string, greedy string, candidates array<string>")
    out = {r["pmcid"]: r for r in selection.best_of_n(df, score).collect()}
    assert out["a"]["output"] == "0.7" and not out["a"]["used_greedy"]
    assert out["b"]["used_greedy"] and out["c"]["output"] == "0.2"
    stats = selection.selection_stats(selection.best_of_n(df, score)).first()
    assert stats["n"] == 3 and stats["beat_greedy"] == 1


def test_first_of_equal_seeds_wins(spark):
    rows = [(o, s, "x" if i < n else "y", "x") for o, (s, n) in enumerate([(7, 400), (42, 410), (1, 410)]) for i in range(500)]
    df = spark.createDataFrame(rows, "ord int, seed int, predicted string, reference string")
    assert tuple(selection.best_seed(df).first()) == (42, 410)


def test_splits_and_lengths(spark):
    assert [training.validation_size(n) for n in (15, 100, 500)] == [20, 20, 50]
    df = spark.range(100)
    split = {r["id"]: r["split"] for r in training.shuffled_split(df, "id").collect()}
    keys = list(range(100))
    random.Random(42).shuffle(keys)
    assert {i for i, s in split.items() if s == "val"} == set(keys[:20])
    sizes = spark.createDataFrame([("x" * n,) for n in range(1, 21)], "t string")
    assert training.length_stats(sizes, "t").first()["p95"] == 20


def test_running_mean_over_blocks(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) as v")
    got = {r["id"]: r["mean"] for r in selection.running_mean(df, "id", "v", block=7).collect()}
    assert got == {19: 9.5, 39: 19.5, 59: 29.5, 79: 39.5, 99: 49.5}


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text(" pmcids ,study_type\n12.0, RCT \n,x\n13,\n")
    assert sorted(map(tuple, tables.sheet(spark, str(tmp_path / "s.csv")).collect())) == [("12", "RCT"), ("13", "")]


def test_linear_study_type(spark, tmp_path):
    rows = [(f"randomized placebo trial number {i}", "INTERVENTIONAL") for i in range(12)] + [(f"retrospective cohort registry {i}", "OBSERVATIONAL") for i in range(6)]
    df = spark.createDataFrame(rows, "text string, label string")
    model = training.fit_study_type(df)
    assert model.transform(df).where("study_type <> label").count() == 0
    model.save(str(tmp_path / "m"))
    again = training.StudyTypeModel.load(str(tmp_path / "m"))
    assert again.transform(df).where("study_type <> label").count() == 0
    assert training.fit_study_type(df.limit(5)) is None


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})")
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(cursor.fetchall(), key=key)


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if SMALL.exists():
        assert entry.entry(spark).columns == ["maximum_age", "n"]


def test_number_words_count_as_numbers(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import metrics

    rows = [("Eighteen years", "18 Years", 1.0), ("twenty-five", "20 and 5", 1.0), ("someone", "", 1.0), ("None", "zero", 0.0), (None, "", 1.0), ("two hundred", "2", 0.5)]
    out = spark.createDataFrame(rows, "p string, g string, want double").select("want", metrics.number_similarity(F.col("p"), F.col("g")).alias("got"))
    assert all(r["want"] == r["got"] for r in out.collect())


def test_examples_are_appended_once_and_skips_are_counted(spark, tmp_path):
    rows = [("1", "x" * 120, "y" * 40), ("2", "x" * 120, "None"), ("3", "x" * 120, "short"), ("4", "x", "y" * 40), ("5", None, "y" * 40), ("6", "x" * 120, None)]
    df = spark.createDataFrame(rows, "pmcid string, input string, output string")
    assert training.skipped(df).first().asDict() == {"used": 1, "no_output": 2, "short_output": 1, "short_input": 2}
    path = str(tmp_path / "out")
    assert tables.append_examples(df.limit(2), path) == 2 and tables.append_examples(df, path) == 4 and tables.append_examples(df, path) == 0
    assert spark.read.json(path).count() == 6
    tables.write_stats(training.skipped(df), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first()["used"] == 1


def test_shuffled_split_refuses_large_sets(spark, monkeypatch):
    monkeypatch.setattr(training, "SHUFFLED", 5)
    with pytest.raises(ValueError):
        training.shuffled_split(spark.range(6), "id")


def test_conditions_chain(spark):
    from quillspark.operators import adapters
    from quillspark.plans import inference

    shape = "pmcid string, title string, abstract_text string, methods_text string, keywords array<string>, body_sections array<struct<title: string, text: string>>"
    articles = spark.createDataFrame([("1", "heart attack", "of men", "", ["k"], []), ("2", None, None, None, None, None)], shape)
    gold = [("1", [1.0, 0.0], "['Own']", "own text"), ("7", [0.9, 0.1], "['Heart''s \"Attack\"', 'Stroke']".replace("''", "\\'"), "near text"), ("8", [0.0, 1.0], "", "no list")]
    index = spark.createDataFrame(gold, "id string, vector array<double>, conditions string, article_text string")

    class Fixed:
        def embed(self, texts):
            return [[1.0, 0.0] if t.strip() else [0.0, 0.0] for t in texts]

    out = {r["pmcid"]: r["conditions"] for r in inference.conditions(articles, index, Fixed, adapters.StubChat, more=True).collect()}
    assert eval(out["1"]) == ["Heart's \"Attack\"", "Stroke"] and set(out) == {"1", "2"}
    bare = inference.conditions(articles, index.limit(0), Fixed, adapters.StubChat).collect()
    assert {r["conditions"] for r in bare} == {"['Not Specified']"}
