"""The parser on a worked example, malformed input, lookups and the whole extraction."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import adapters
from quillspark.plans import inference
from quillspark.sources import nxml, tables

XML = (
    "<article article-type='research-article'><front><article-meta><title-group><article-title>Trial of <italic>X</italic><xref>1</xref> in adults"
    "</article-title></title-group><abstract><sec><title>Background</title><p>Bg text.</p></sec></abstract><kwd-group><kwd>alpha</kwd>"
    "<kwd><italic>beta</italic> two</kwd></kwd-group></article-meta></front><body><p>Loose.</p><sec id='s1'><title>Methods</title>"
    "<p>We enrolled [<xref>2</xref>] adults.</p><sec id='s1a'><title>Inclusion criteria</title><p>Aged 18 to 65 years.</p></sec>"
    "<fig><caption><p>Fig cap.</p></caption></fig></sec></body></article>"
)
S1 = "We enrolled [] adults.Inclusion criteriaAged 18 to 65 years."


def _rows(spark, *contents):
    return spark.createDataFrame([(str(i), None if x is None else bytearray(x.encode())) for i, x in enumerate(contents)], "pmcid string, content binary")


def test_worked_example(spark):
    row = nxml.articles(nxml.parse(_rows(spark, XML))).first()
    assert row["title"] == "Trial of X in adults" and row["article_type"] == "research-article"
    assert row["abstract_text"] == "BackgroundBg text." and row["abstract_sections"] == {"Background": "Bg text."}
    assert [(s["id"], s["title"], s["depth"], s["text"]) for s in row["body_sections"]] == [
        ("s1", "Methods", 0, S1),
        ("s1a", "Inclusion criteria", 1, "Aged 18 to 65 years."),
    ]
    assert row["eligibility_text"] == "Aged 18 to 65 years." and row["methods_text"] == S1
    assert row["full_body_text"] == f"Methods\n{S1}"
    assert row["all_paragraphs"] == ["Loose.", "We enrolled [] adults.", "Aged 18 to 65 years.", "Fig cap."]
    assert row["keywords"] == ["alpha", "beta two"] and row["parse_ok"]


def test_repeated_abstract_titles_keep_the_last(spark):
    sec = "<sec><title>A</title><p>{}</p></sec>"
    xml = f"<article><abstract>{sec.format('1')}<sec><p>n</p></sec>{sec.format('2')}</abstract></article>"
    assert nxml.parse(_rows(spark, xml)).first()["abstract_sections"] == {"A": "2", "Abstract": "n"}


def test_malformed_missing_and_defaults(spark):
    parsed = nxml.articles(nxml.parse(_rows(spark, XML, "<article><body>", None)))
    assert [r["parse_ok"] for r in parsed.orderBy("pmcid").collect()] == [True, False, False]
    fields = inference.extracted(parsed.where("parse_ok"))
    ids = spark.createDataFrame([("0",), ("1",), ("9",)], "pmcid string")
    out = {r["pmcids"]: r for r in inference.submission(ids, fields).collect()}
    assert out["0"]["maximum_age"] == "65 Years" and out["1"]["maximum_age"] == "Not Specified" and out["9"]["sex"] == "ALL"
    assert out["9"]["conditions"] == "['Not Specified']"
    assert nxml.survey(parsed).first()["n"] == 1 and nxml.summary(parsed.where("parse_ok")).first()["n_sections"] == 2


def test_files_stream_and_submission(spark, tmp_path):
    from quillspark.streaming.articles import extract_stream

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"PMC{i}.nxml").write_text("<!DOCTYPE article>" + XML)
    files = nxml.scan(spark, str(tmp_path / "in"))
    assert sorted(r["pmcid"] for r in files.collect()) == ["0", "1", "2"]
    found = nxml.lookup(files, spark.createDataFrame([("1",), ("7",)], "pmcid string"))
    assert {r["pmcid"]: r["content"] is not None for r in found.collect()} == {"1": True, "7": False}
    extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.count() == 3
    rows = inference.submission(streamed.select("pmcid"), streamed)
    tables.write_submission(rows, str(tmp_path / "csv"))
    again = tables.submission(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    tables.write_submission_file(rows, str(tmp_path / "one.csv"))
    assert Path(tmp_path / "one.csv").read_text().splitlines()[0] == ",".join(tables.SUBMISSION)


def test_views_and_adapters(spark):
    df = nxml.articles(nxml.parse(_rows(spark, XML)))
    nxml.register(df)
    assert spark.sql("SELECT count(*) FROM sections").first()[0] == 2
    embedded = adapters.embedded(df.select("pmcid", "title"), "title").first()
    assert len(embedded["embedding"]) == 64
    assert adapters.classified(df.select("pmcid", "title"), "title").first()["classified"] is None
    assert adapters.generated(df.select("title"), "title", lambda: adapters.StubGenerator(3)).select(F.size("generated")).first()[0] == 3


def test_optional_corpus(spark):
    corpus = Path(nxml.EngineConfig().nxml_dir)
    if not corpus.exists():
        pytest.skip("NXML_DIR names no corpus")
    df = nxml.parse(nxml.scan(spark, str(corpus)), ("article_type", "abstract_text", "body_sections")).cache()
    row = df.selectExpr("count(*) n", "count_if(parse_ok) ok", "count_if(abstract_text = '') bare").first()
    assert row["n"] == row["ok"] == len(list(corpus.glob("*.nxml")))
    depth = {r["depth"]: r["count"] for r in nxml.sections(df).groupBy("depth").count().collect()}
    assert depth[0] > 0 and min(depth) == 0


def test_only_what_is_asked_for_is_parsed(spark):
    """Joined texts are made of what was parsed; nothing else of an article is carried along."""
    df = nxml.articles(nxml.parse(_rows(spark, XML), ("title", "body_sections")))
    whole = nxml.articles(nxml.parse(_rows(spark, XML)))
    assert df.columns == ["pmcid", "title", "body_sections", "parse_ok", "parse_error", "eligibility_text", "methods_text", "full_body_text"]
    assert df.first().asDict() == whole.select(*df.columns).first().asDict()


def test_kept_tables_are_compressed_and_can_be_released(spark):
    import os

    from quillspark.operators import lineage

    df = lineage.kept(spark.range(2000).selectExpr("id", "repeat('abc ', 1000) AS text"))
    path = df._kept.removeprefix("file:")
    assert df.count() == 2000 and sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < 2_000_000
    lineage.release(df)
    assert not os.path.exists(path)
