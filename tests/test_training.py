"""Sparse TF-IDF, the seed sweep and the scorer job against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import selection, sweep, tagger, training
from quillspark.plans import inference, scorer_job

INT, OBS = training.LABELS


def test_features_equal_a_plain_version_and_stay_sparse(spark):
    texts = [f"randomized placebo trial number {i} number of placebo trial" for i in range(12)] + [f"retrospective cohort registry {i * 11}" for i in range(6)]
    df = spark.createDataFrame([(t, INT if i < 12 else OBS) for i, t in enumerate(texts)], "text string, label string")
    model = training.fit_study_type(df)
    names = model.counted.stages[-1].vocabulary
    grams = lambda t: (w := re.findall(r"\b\w\w+\b", t)) + [" ".join(p) for p in zip(w, w[1:])]
    seen = Counter(g for t in texts for g in set(grams(t)))
    asked = [*texts, "", "unknown words only", "placebo unknown"]
    made = training._features(model.counted.transform(spark.createDataFrame([(t,) for t in asked], "text string").coalesce(1)), model.idf)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "vector_to_array" not in plan and "posexplode" not in plan
    for text, row in zip(asked, made.select("features").collect(), strict=True):
        want = {g: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + seen[g])) + 1) for g, c in Counter(grams(text)).items() if g in seen}
        norm = math.sqrt(sum(v * v for v in want.values())) or 1
        got = {names[i]: v for i, v in zip(row["features"].indices, row["features"].values, strict=True)}
        assert got == pytest.approx({g: v / norm for g, v in want.items()})


def _trials(spark, n=240):
    rng = np.random.default_rng(5)
    words = {INT: ["randomized", "placebo", "arm", "dose"], OBS: ["cohort", "registry", "survey", "records"]}
    rows = []
    for i in range(n):
        label = INT if i % 3 else OBS
        mixed = [*rng.choice(words[label], 3), *rng.choice(sum(words.values(), []), 3), *rng.choice(["of", "the", "patients", "été"], 3)]
        rows.append((i, " ".join(mixed), label))
    return rows, spark.createDataFrame(rows, "id long, text string, label string")


def _places(text):
    w = re.findall(r"\b\w\w+\b", text.lower())
    return np.array([zlib.crc32(g.encode()) % sweep.FEATURES for g in w + [" ".join(p) for p in zip(w, w[1:])]], dtype=np.int64)


def test_sweep_equals_a_sequential_run(spark):
    rows, df = _trials(spark)
    train, test = [r for r in rows if r[0] % 4], [r for r in rows if not r[0] % 4]
    seeds = (7, 42, 1)
    models = sweep.train(df.where("id % 4 <> 0").repartition(7), "id", "text", "label", seeds)
    tie = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.struct(F.col("text").alias("t"), F.col("label").alias("l"))).alias("h")).collect()}
    order = sorted(train, key=lambda r: (str(r[0]), tie[r[0]]))
    plain = {s: sweep.fitted([(_places(t), int(label == OBS)) for _, t, label in order], s) for s in seeds}
    assert all(np.array_equal(models.weights[i], plain[s]) for i, s in enumerate(seeds))
    assert not np.array_equal(plain[7], plain[42])
    want = {}
    for s in seeds:
        pred = []
        for _, t, _ in test:
            seen, x = sweep.unit(_places(t))
            pred.append(training.LABELS[int(plain[s][seen] @ x + plain[s][-1] > 0)])
        want[s] = (sum(p == r[2] for p, r in zip(pred, test, strict=True)), pred.count(INT), len(test))
    out = models.predicted(df.where("id % 4 = 0"), "text")
    got = {r["seed"]: (r["agreed"], r["interventional"], r["n"]) for r in models.results(out, "label").collect()}
    assert got == want
    assert seeds[models.chosen(out, "label")] == max(seeds, key=lambda s: (want[s][0], -seeds.index(s)))
    assert max(a for a, *_ in want.values()) > 0.8 * len(test)


def test_sweep_over_shards_is_the_same_on_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(sweep, "SHARD_ROWS", 50)
    _, df = _trials(spark)
    df = df.unionByName(df.limit(9))
    a, b = (sweep.train(df.repartition(n), "id", "text", "label", (3, 4)) for n in (2, 9))
    assert np.array_equal(a.weights, b.weights)
    out = a.predicted(df, "text")
    assert a.results(out, "label").where("agreed < 0.8 * n").count() == 0


def test_sweep_of_odd_rows(spark):
    _, df = _trials(spark, 30)
    odd = spark.createDataFrame([(None, "x y", INT), (1, None, OBS), (2, "", OBS), (3, "word", "OTHER"), (4, "word", None)], "id long, text string, label string")
    models = sweep.train(df.unionByName(odd), "id", "text", "label", (1,))
    assert np.array_equal(models.weights, sweep.train(df, "id", "text", "label", (1,)).weights)
    named = odd.withColumn("places", F.lit(1)).withColumnRenamed("id", "made.it")
    out = models.predicted(named, "text", "places.by")
    assert out.columns == ["made.it", "text", "label", "places", "places.by"] and out.count() == 5
    assert models.predicted(odd.limit(0), "text").count() == 0
    for bad in (df.limit(0), df.where("label = 'OBSERVATIONAL'")):
        with pytest.raises(ValueError):
            sweep.train(bad, "id", "text", "label", (1,))
    for seeds in ((), (1, 1)):
        with pytest.raises(ValueError):
            sweep.train(df, "id", "text", "label", seeds)


GROUP = "pmcid string, input string, gt string, greedy string, candidates array<string>"


def _groups(spark, n=40):
    rows = [(str(i), f"in {i}", f"age {i % 7} years with disease {i % 3}", f"age {i % 5} years", [f"disease {i % 2}", f"age {i % 7} years", None][: i % 4]) for i in range(n)]
    odd = [rows[3], rows[3], (None, None, None, None, None), ("e", "", "", "", []), ("x", "i", "age 1", None, None)]
    return spark.createDataFrame(rows + odd, GROUP)


def test_broken_off_job_equals_an_uninterrupted_one(spark, tmp_path):
    groups = _groups(spark)
    whole = scorer_job.run(groups, str(tmp_path / "a"), selection.best_of_n, 5)
    calls = []

    def dies(part):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return selection.best_of_n(part)

    folder = str(tmp_path / "b")
    with pytest.raises(KeyboardInterrupt):
        scorer_job.run(groups, folder, dies, 5)
    done = scorer_job.finished(spark, folder)
    assert done == {0, 1}
    # a range whose rows were written, but not its ledger row
    selection.best_of_n(groups.limit(2)).write.parquet(f"{folder}/scored/range=2")
    calls.clear()
    again = scorer_job.run(groups.limit(0), folder, lambda part: calls.append(1) or selection.best_of_n(part), 5)
    assert len(calls) == 3
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again) == key(whole) == key(selection.best_of_n(groups))
    for out in ("train", "stats"):
        a, b = (spark.read.json(str(tmp_path / x / out)) for x in "ab")
        assert key(a) == key(b)
    assert spark.read.json(f"{folder}/train").count() == groups.count()
    got, want = spark.read.json(f"{folder}/stats").first().asDict(), selection.selection_stats(selection.best_of_n(groups.where("pmcid is not null"))).first().asDict()
    assert want["n"] + 1 == got["n"] and want["beat_greedy"] == got["beat_greedy"]
    assert key(scorer_job.run(groups, folder, dies, 5)) == key(whole)
    with pytest.raises(ValueError):
        scorer_job.run(groups, folder, selection.best_of_n, 6)


def test_job_without_groups(spark, tmp_path):
    out = scorer_job.run(_groups(spark).limit(0), str(tmp_path / "j"), selection.best_of_n, 2)
    assert out.count() == 0 and spark.read.schema("n long, greedy_mean double").json(str(tmp_path / "j" / "stats")).first().asDict() == {"n": 0, "greedy_mean": None}


def test_scorer_by_fm3s_equals_single_pairs(spark, tmp_path):
    token = "struct<text:string,tag:string,lemma:string>"
    tagged = [("age", "NN"), ("years", "NNS"), ("with", "IN"), ("disease", "NN")]
    sentences = spark.createDataFrame([([(w, t, w) for w, t in tagged],)] * 3, f"tokens array<{token}>")
    model = tagger.train(sentences)
    groups = _groups(spark, 12)
    got = scorer_job.run(groups, str(tmp_path / "f"), scorer_job.fm3s_chosen(model), 2).collect()
    assert len(got) == groups.count()
    rows = groups.collect()
    texts = sorted({(t or "", r["gt"] or "") for r in rows for t in (r["greedy"], *(r["candidates"] or []))})
    pairs = spark.createDataFrame([(str(i), *p) for i, p in enumerate(texts)], "k string, p string, g string")
    score = {(r["p"], r["g"]): r["s"] for r in inference.fm3s_scored(pairs, "k", "p", "g", model, None, "s").collect()}
    want = []
    for r in rows:
        each = [score[c or "", r["gt"] or ""] for c in r["candidates"] or []]
        greedy, best = score[r["greedy"] or "", r["gt"] or ""], max(each, default=-1.0)
        output = r["greedy"] if greedy >= best else r["candidates"][each.index(best)]
        want.append((r["pmcid"], output, max(greedy, best), sum(each) / max(len(each), 1), greedy >= best))
    assert sorted(map(str, want)) == sorted(str((r["pmcid"], r["output"], r["chosen_score"], r["mean_score"], r["used_greedy"])) for r in got)
    assert any(r["chosen_score"] > 0 for r in got)


def test_sweep_cuts_a_text_once_and_holds_rows_in_few_bytes(spark):
    df = spark.createDataFrame([("Été a bb_1 bb_1 c3-dd x",), ("",), (None,), ("solo",)], "text string")
    out = sweep.placed(df, F.col("text"), "p")
    assert [sorted(r["p"]) for r in out.collect()] == [sorted(_places(t or "")) for (t,) in df.collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    places = np.arange(500).repeat(3)
    seen, counts = sweep.short(places)
    assert seen.nbytes + counts.nbytes <= 6 * 500 and seen.tolist() == list(range(500)) and set(counts.tolist()) == {3}
    big = np.full(70_000, 9)
    assert sweep.short(big)[1].tolist() == [70_000]


def test_frequent_grams_count_no_pair_of_rare_words(spark):
    rng = np.random.default_rng(6)
    lists = [[f"w{int(x)}" for x in rng.zipf(1.6, size=n) if x < 60] for n in rng.integers(0, 25, 80)]
    rows = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    count = Counter(g for w in lists for g in w + [" ".join(p) for p in zip(w, w[1:])])
    ranked = sorted(count, key=lambda g: (-count[g], g))
    for most in (1, 5, 20, 37, len(ranked), 10_000):
        assert training._frequent(rows, most) == ranked[:most]
    words = rows.select(F.explode("words").alias("gram")).groupBy("gram").count()
    least = count["w3"]
    got = {r["gram"]: r["count"] for r in training._pairs(rows, words, least).collect()}
    assert got and got == {g: n for g, n in count.items() if " " in g and min(count[w] for w in g.split()) >= least}


def test_study_types_are_learned_from_whole_texts(spark):
    """What tells the classes apart stands behind the first 6000 characters."""
    rows = [(f"filler {'word ' * 1200} {'randomized placebo' if i % 3 else 'retrospective cohort'}", INT if i % 3 else OBS) for i in range(24)]
    df = spark.createDataFrame(rows, "body string, label string")
    text = training.model_text(F.lit("title"), F.lit(""), F.col("body"))
    df = df.select(text.alias("text"), "label")
    assert df.where("text like '%placebo' or text like '%cohort'").count() == 24
    assert training.fit_study_type(df).transform(df).where("study_type <> label").count() == 0


def test_sweep_reads_whole_texts_and_long_ones_make_more_shards(spark, monkeypatch):
    rows = [(i, f"{'word ' * 1200} {'randomized placebo' if i % 3 else 'retrospective cohort'} ", INT if i % 3 else OBS) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, body string, label string")
    df = df.select("id", training.model_text(F.lit("title"), F.lit(""), F.col("body"), strip=True).alias("text"), "label")
    whole = sweep.train(df, "id", "text", "label", (1,))
    assert whole.predicted(df, "text").where("predicted[0] <> label").count() == 0
    monkeypatch.setattr(sweep, "SHARD_PLACES", 60 * 2405 // 3)
    dealt = sweep.train(df, "id", "text", "label", (1,))
    assert not np.array_equal(dealt.weights, whole.weights)
    assert np.array_equal(dealt.weights, sweep.train(df.repartition(5), "id", "text", "label", (1,)).weights)
