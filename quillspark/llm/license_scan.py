"""License scans with DataFrame functions only: a positional index of rare licence words.

A text's words (A-Z lower-cased) are looked up in an index of the templates' words, those of ``COMMON`` apart. Each
occurrence at place p meets the word's postings (template, place q), and p - q is the place where the template would
begin. A template's coverage is the largest share of its postings, weighed by the inverse document frequency counted over
all documents, that agree on one beginning; every template of a file is measured by all its words.
A template is a label if its coverage reaches ``COVERED`` and all its mandatory key phrases stand in the text.

Index and frequencies are bounded by the templates, so both travel in the plan; one pass counts, one narrow pass scans.
Texts without any first word of a base or mandatory phrase are passed by a plain search.

Defined results: a null or empty text has no words, places or labels and score 0; repeated rows get equal results; an
empty table gives no rows; other columns are kept by ``scan`` (those of the names it adds are replaced) and ignored by the query.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label -> (notice, mandatory key phrases), in words of the scan.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "free of charge"),
    ),
    "mit-name": ("released under the mit license", ("mit license",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-notice": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("redistribute it", "gnu general public license"),
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    "bsd-notice": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "all-rights-reserved": ("copyright all rights reserved", ("all rights reserved",)),
}
#: Words too common in running text to be looked up.
COMMON = frozenset("a all an and are as at by can following for free in is it may met of on or other that the this to under use version with you 0 2 3 4".split())
COVERED = 0.6

BREAK = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), f"[{BREAK}]+"), lambda w: w != "")


def postings() -> dict[str, dict[str, list[int]]]:
    """template -> word -> places, of the words that are looked up."""
    out: dict[str, dict[str, list[int]]] = {}
    for name, (notice, _) in TEMPLATES.items():
        places = out[name] = defaultdict(list)
        for i, w in enumerate(notice.split()):
            if w not in COMMON:
                places[w].append(i)
    return out


def vocabulary() -> list[str]:
    return sorted({w for places in postings().values() for w in places})


def frequencies(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each looked-up word over all documents; one row a word reaches the driver."""
    words = vocabulary()
    held = F.array_distinct(F.filter(words_of(F.col(text).cast("string")), lambda w: w.isin(*words)))
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in counts}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1e-6 for w in words}


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def scan(docs: DataFrame, idf: dict[str, float], text: str = "text") -> DataFrame:
    """Adds n_words, places (array of the words where a base phrase starts), base (labels), added (labels) and score."""
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    first = sorted({p.split()[0] for p, _ in BASE} | {p.split()[0] for _, must in TEMPLATES.values() for p in must})
    any_case = lambda x: "".join(f"[{c}{c.upper()}]" for c in x)
    anchor = f"(?<!{RAW_WORD[:-1]})(?:{'|'.join(map(any_case, first))})(?!{RAW_WORD[:-1]})"
    out = docs.withColumn("n_words", F.regexp_count(source, F.lit(RAW_WORD)).cast("long"))
    out = out.withColumn("__license_w", F.when(source.rlike(anchor), words_of(source)).otherwise(F.array().cast("array<string>")))
    w = F.col("__license_w")

    def starts(phrase: str) -> Column:
        def here(x: Column, i: Column) -> Column:
            head, *rest = phrase.split()
            ok = x == head
            for k, word in enumerate(rest, 1):
                ok = ok & (F.get(w, i + k) == word)
            return F.when(ok, i)

        return F.filter(F.transform(w, here), lambda i: i.isNotNull())

    for p, label in BASE:
        out = out.withColumn(f"__license_{label}", starts(p))
    labels = F.array(*(F.when(F.size(f"__license_{label}") > 0, F.lit(label)) for _, label in BASE))
    out = out.withColumn("places", F.concat(*(F.col(f"__license_{label}") for _, label in BASE)))
    out = out.withColumn("base", F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))))
    # looked-up words with their places
    table = _map(idf)
    hits = F.filter(
        F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda h: h["word"].isin(*idf)
    )
    out = out.withColumn("__license_hits", hits)
    out = out.withColumn("__license_joined", F.concat(F.lit(" "), F.array_join("__license_w", " "), F.lit(" ")))
    found = []
    for name, places in postings().items():
        own = _map({x: ",".join(map(str, p)) for x, p in places.items()})
        use = F.filter("__license_hits", lambda h: h["word"].isin(*places))
        begins = F.array_sort(
            F.flatten(
                F.transform(
                    use,
                    lambda h: F.transform(
                        F.split(own[h["word"]], ","), lambda q: F.struct((h["at"] - q.cast("int")).alias("at"), table[h["word"]].alias("idf"))
                    ),
                )
            )
        )
        zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(acc["at"] == x["at"], acc["run"] + x["idf"]).otherwise(x["idf"])
            return F.struct(x["at"].alias("at"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        all_of = sum(idf[x] * len(p) for x, p in places.items())
        must = F.lit(True)
        for p in TEMPLATES[name][1]:
            must = must & F.contains("__license_joined", F.lit(f" {p} "))
        share = F.least(F.aggregate(begins, zero, step, lambda acc: acc["best"]) / F.lit(max(all_of, 1e-9)), F.lit(1.0))
        found.append(F.when((F.size("__license_w") > 0) & must, F.struct(F.lit(name).alias("label"), share.alias("share"))))
    out = out.withColumn("__license_found", F.filter(F.array(*found), lambda x: x.isNotNull()))
    out = out.withColumn("added", F.transform(F.filter("__license_found", lambda x: x["share"] >= COVERED), lambda x: x["label"]))
    base_score = F.when(F.size("places") > 0, 1.0).otherwise(0.0)
    out = out.withColumn("score", F.greatest(base_score, F.coalesce(F.array_max(F.transform("__license_found", lambda x: x["share"])), F.lit(0.0))))
    return out.drop("__license_w", "__license_hits", "__license_joined", "__license_found", *(f"__license_{label}" for _, label in BASE))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, frequencies(docs)).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "added"))), ",").alias("labels"),
        "score",
    )
