"""Secret scans with DataFrame functions only.

Three fixed patterns (assignments of a password-like name, access keys, long hex runs) give the base spans. On top of
them every run of at least ``MIN_RUN`` key characters is scored by two character Markov models, one of random strings and
one of ordinary identifiers: the sum over its bigrams of log P(b|a, random) - log P(b|a, ordinary). A run whose sum
reaches ``LOG_ODDS`` is a ``markov`` span unless it overlaps a base span. Both models are trained by counting bigrams of
labelled samples; by default the samples are made by rule (digests in several alphabets, and identifiers joined from a
fixed word list), and a table of labelled tokens can be given instead.

All offsets are code points, end exclusive. Matches are located by anchoring each next match to the end of the last, so
a text costs one pass a pattern, and their places are sums over what lies before, taken in chunks; work grows in proportion to
the text. Texts without a match are passed by a plain search first. No shuffle, no Python.

Defined results: a null or empty text has no spans; repeated rows get equal results; an empty table gives no rows; other
columns are kept by ``scan`` and ``redact`` and ignored by the query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

NAMES = "password|passwd|secret|token|api_?key"
#: kind -> (pattern with the value as its own group, least length of the value), in the order of kinds.
BASE = {
    "assign": (rf"(?i:{NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    # a match is a maximal run, so its least length can stand in the pattern
    "access": (r"(AKIA[A-Z0-9]{16,})", 20),
    "hex": (r"([0-9a-f]{24,})", 24),
}
#: What a text must hold for a kind to be looked for at all.
GUARD = {"assign": rf"(?i:{NAMES})[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
KINDS = [*BASE, "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
MIN_RUN, LOG_ODDS = 20, 20.0
SAMPLES, SMOOTH = 4000, 0.5
#: Elements of an array that are folded at once; a fold copies what it has made at each step.
CHUNK = 256

#: Words that ordinary identifiers are joined from.
WORDS = (
    "get set list map user name value index count total order item path file line text data table column row key type "
    "node tree list queue stack cache store load save read write open close start stop begin end first last next previous "
    "parse format print error warning message request response server client session config option default result status "
    "verschiedene entwicklung wissenschaft gesellschaft verantwortung einstellung geschwindigkeit zusammenarbeit "
    "information organisation international development environment understanding relationship government different "
    "something everything together between through according university community important national "
    "developpement gouvernement particulierement environnement administration politique historique "
    "desarrollo conocimiento universidad administracion internacional especialmente comunicacion"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Rows (token, random): n digests in hex of both cases, dashed hex, base64, base32-like and letter alphabets; n joined identifiers, rules, numbers and dates."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    wide = F.base64(F.unhex(digest))
    short = F.translate(F.upper(F.base64(F.unhex(F.sha2(digest, 256)))), "+/=", "QZK")
    letters = F.translate(wide, "+/=", "xyz")
    loud = F.upper(F.substring(digest, 1, 40))
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    dashed = F.when(F.col("id") % 4 == 1, F.upper(F.concat_ws("-", *cut))).otherwise(F.concat_ws("-", *cut))
    random = F.element_at(F.array(digest, wide, short, letters, loud, dashed), (F.col("id") % 6 + 1).cast("int"))
    words = F.lit(" ".join(WORDS))
    pick = lambda k: F.element_at(
        F.split(words, " "), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int")
    )
    number = F.pmod(F.xxhash64("id", F.lit("number")), F.lit(100)).cast("string")
    title = lambda k: F.initcap(pick(k))
    mark = F.element_at(F.array(*(F.lit(c) for c in "-_=/+")), (F.pmod(F.xxhash64("id", F.lit("mark")), F.lit(5)) + 1).cast("int"))
    ordinary = F.element_at(
        F.array(
            F.concat_ws("_", pick(1), pick(2), pick(3)),
            F.concat(pick(1), title(2), title(3)),
            F.concat_ws("-", pick(1), pick(2), pick(3), number),
            F.upper(F.concat_ws("_", pick(1), pick(2), pick(3))),
            F.concat_ws("/", pick(1), pick(2), pick(3)),
            F.concat(pick(1), pick(2), pick(3)),
            F.concat(title(1), title(2), number),
            F.concat(pick(4), pick(5), pick(6), pick(7)),
            # rules of tables and signatures, long numbers, dates, paths, and longer names
            F.repeat(mark, F.pmod(F.xxhash64("id", F.lit("length")), F.lit(60)).cast("int") + 8),
            F.concat(F.repeat(F.lit("-"), F.lit(12)), mark, F.repeat(F.lit("="), F.lit(9)), mark, F.repeat(F.lit("_"), F.lit(9))),
            F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 15), 16, 10),
            F.concat_ws("-", F.concat(F.lit("20"), F.lpad(number, 2, "0")), F.lpad(number, 2, "0"), F.lit("12"), F.lit("00"), number),
            F.concat(F.lit("/"), F.concat_ws("/", pick(1), title(2), pick(3), F.concat(pick(4), number))),
            F.concat(pick(1), title(2), title(3), title(4), title(5)),
            F.upper(F.concat_ws("-", pick(1), pick(2), number, pick(3))),
        ),
        (F.col("id") % 15 + 1).cast("int"),
    )
    ids = spark.range(n)
    return ids.select(random.alias("token"), F.lit(True).alias("random")).unionByName(
        ids.select(ordinary.alias("token"), F.lit(False).alias("random"))
    )


def train(samples: DataFrame) -> list[float]:
    """Log ratio for each bigram of ALPHABET, row by row, from rows (token, random). At most 2 * 67**2 counts are fetched."""
    k = len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr(F.col("token"), i, F.lit(2))))
    counts = (
        samples.where(F.length("token") > 1)
        .select("random", pair.alias("pair"))
        .where(F.col("pair").rlike(f"^{RUN}{{2}}$"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    n = {(r["random"], r["pair"]): r["count"] for r in counts}
    rows = {(c, a): sum(n.get((c, a + b), 0) for b in ALPHABET) for c in (True, False) for a in ALPHABET}
    log = lambda c, a, b: math.log((n.get((c, a + b), 0) + SMOOTH) / (rows[c, a] + SMOOTH * k))
    return [log(True, a, b) - log(False, a, b) for a in ALPHABET for b in ALPHABET]


def prefix(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of array<int>, all up to it under an associative ``op``: chunks alone first, then with what comes before them."""

    def fold(array: Column) -> Column:
        add = lambda acc, x: F.array_append(acc, F.when(F.size(acc) > 0, op(F.get(acc, F.size(acc) - 1), x)).otherwise(x))
        return F.aggregate(array, F.array().cast("array<int>"), add)

    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    folded = F.transform(chunks, fold)
    both = F.struct(folded.alias("own"), fold(F.transform(folded, lambda a: F.get(a, F.size(a) - 1))).alias("all"))
    moved = lambda f: F.flatten(F.transform(f["own"], lambda a, k: F.transform(a, lambda x: F.when(k > 0, op(F.get(f["all"], k - 1), x)).otherwise(x))))
    once = F.get(F.transform(F.array(both), moved), F.lit(0))  # a lambda's argument is computed once
    return F.when(F.size(values) > 0, once).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, guard: str, value: bool) -> Column:
    """array<struct<gap, hit, size>> of leftmost non-overlapping matches: code points before it, its text, and the size of the pattern's group (with ``value``) or of the match."""
    whole = rf"(?s)\G(.*?)({pattern})"
    take = lambda g: F.regexp_extract_all(text, F.lit(whole), F.lit(g))
    if value:
        parts = F.zip_with(F.arrays_zip(take(1).alias("gap"), take(2).alias("hit")), take(3), lambda x, v: F.struct(F.length(x["gap"]).alias("gap"), x["hit"], F.length(v).alias("size")))
    else:
        parts = F.zip_with(take(1), take(2), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"), F.length(hit).alias("size")))
    return F.when(text.rlike(guard), parts).otherwise(F.array().cast("array<struct<gap:int,hit:string,size:int>>"))


def with_located(df: DataFrame, text: Column, kinds: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """Adds for each (column: pattern, guard, value) array<struct<start, end, size, hit>>."""
    work = {c: f"{c}_m" for c in kinds}
    df = df.withColumns({work[c]: matches(text, *kinds[c]) for c in kinds})
    ends = {f"{c}_e": prefix(F.transform(work[c], lambda x: x["gap"] + F.length(x["hit"])), lambda a, b: a + b) for c in kinds}
    df = df.withColumns(ends)

    def placed(c: str) -> Column:
        end = lambda i: F.get(F.col(f"{c}_e"), i)
        return F.transform(work[c], lambda x, i: F.struct((end(i) - F.length(x["hit"])).alias("start"), end(i).alias("end"), x["size"], x["hit"]))

    return df.withColumns({c: placed(c) for c in kinds}).drop(*work.values(), *ends)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_odds(token: Column, ratios: Column) -> Column:
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))) - 1
    add = lambda acc, i: acc + F.get(ratios, at(i) * len(ALPHABET) + at(i + 1))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), add)


def scan(docs: DataFrame, ratios: list[float], text: str = "text", out: str = "found") -> DataFrame:
    """Adds column ``out``: array<struct<start, kind, end>> sorted by start and kind, kind being the place in KINDS.

    A column of that name is replaced; the working columns' names start with ``__secret``.
    """
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    kinds = {f"__secret_{kind}": (p, GUARD[kind], kind == "assign") for kind, (p, _) in BASE.items()}
    df = with_located(docs, source, kinds | {"__secret_runs": (f"({RUN}{{{MIN_RUN},}})", f"{RUN}{{{MIN_RUN}}}", False)})
    base = F.concat(
        *(
            F.transform(
                F.filter(F.col(f"__secret_{kind}"), lambda x: x["size"] >= least),
                lambda x: F.struct(x["start"], F.lit(i).alias("kind"), x["end"]),
            )
            for i, (kind, (_, least)) in enumerate(BASE.items())
        )
    )
    df = df.withColumn("__secret_base", base)
    likely = F.filter("__secret_runs", lambda r: log_odds(r["hit"], table) >= LOG_ODDS)
    # all in order of their starts; a run is dropped if a base span reaches into it from before, or starts in it
    spans = F.array_sort(F.concat("__secret_base", F.transform(likely, lambda r: F.struct(r["start"], F.lit(len(BASE)).alias("kind"), r["end"]))))
    own = lambda x: x["kind"] < len(BASE)

    def clear(all_spans: Column) -> Column:
        reach = prefix(F.transform(all_spans, lambda x: F.when(own(x), x["end"]).otherwise(-1)), F.greatest)
        after = F.reverse(prefix(F.reverse(F.transform(all_spans, lambda x: F.when(own(x), x["start"]).otherwise(2**31 - 1))), F.least))
        return once(F.struct(all_spans.alias("s"), reach.alias("reach"), after.alias("after")), kept)

    def kept(x: Column) -> Column:
        return F.filter(x["s"], lambda r, i: own(r) | ((F.get(x["reach"], i) <= r["start"]) & (F.get(x["after"], i) >= r["end"])))

    found = once(spans, clear)
    return df.withColumn("__secret_out", found).drop(out, "__secret_base", "__secret_runs", *kinds).withColumnRenamed("__secret_out", out)


def redact(docs: DataFrame, ratios: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span, overlapping ones as one, by ``mark``; rows without spans keep their text, null included.

    The text is cut at every CHUNK-th span first, so a span's place is not looked for from the text's start.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names may hold anything
    text = f"c{names.index(text)}"
    source, spans = F.col(text), F.col("__secret_spans")
    reach = "__secret_reach"  # how far the spans up to each one go
    found = scan(docs, ratios, text, "__secret_spans").withColumn(reach, prefix(F.transform("__secret_spans", lambda s: s["end"]), F.greatest))
    before = lambda i: F.when(i > 0, F.get(F.col(reach), i - 1)).otherwise(0)
    last = F.floor((F.size(spans) - 1) / CHUNK).cast("int")

    def chunk(c: Column) -> Column:
        """Spans c * CHUNK and on, each with the text before it that no span covers."""
        begin = before(c * CHUNK)
        end = F.get(F.col(reach), F.least((c + 1) * CHUNK, F.size(spans)) - 1)
        piece = F.struct(begin.alias("at"), F.substr(source, begin + 1, end - begin).alias("text"))
        own = F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.size(spans)) - 1)

        def marked(p: Column) -> Column:
            def one(i: Column) -> Column:
                start = F.get(spans, i)["start"]
                gap = F.substr(p["text"], before(i) - p["at"] + 1, F.greatest(start - before(i), F.lit(0)))
                return F.when(start >= before(i), F.concat(gap, F.lit(mark))).otherwise("")

            return F.array_join(F.transform(own, one), "")

        return F.get(F.transform(F.array(piece), marked), F.lit(0))

    tail = F.substr(source, F.get(F.col(reach), F.size(spans) - 1) + 1, F.length(source))
    clean = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), chunk), ""), tail)
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(source)).select(*docs.columns).toDF(*names)


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark)))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *(count(k) for k in range(len(BASE))),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
