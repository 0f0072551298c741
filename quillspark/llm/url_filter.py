"""URL filters: fixed host and path rules, then association rules mined from labelled URLs.

FP-growth mines combinations of URL tokens (host labels, host suffixes, path segments, query keys) together with the
label; rules whose consequent is a label and whose support and confidence reach the limits are kept, and a rule that a
shorter one with at least its confidence covers is pruned. A URL's tokens look up the inverted index token -> rule ids
in Arrow batches; a rule fires when all its tokens are there; the most confident rule decides, then the longest, then
block before allow. The rules are bounded by the support floor and pruned, so they travel in the closure.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and, having no tokens, the
verdict allow; equal URLs get equal verdicts; without labelled URLs there are no mined rules and what no fixed rule
decides is allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common

#: (rule, verdict): host and path of the production list.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: Tokens of a URL that FP-growth combines: its frequent tokens that tell most of the label, at most 2 ** MINED sets. The rest is completed level by level.
MINED = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h:host label, s:suffix of the last two labels, p:segment without digits, q:query key, www/m."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffix = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("s:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array())
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1)
    mark = lambda a, kind: F.transform(a, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(mark(labels, "h:"), suffix, mark(segments, "p:"), mark(query, "q:")))


def _token_counts(rows: DataFrame, least: float) -> list[dict]:
    """Of each token that at least ``least`` rows hold: how many do, how many of them are to be blocked, and a fingerprint of which.

    At most the mean number of a URL's tokens times total / least rows reach the driver.
    """
    each = rows.withColumn("_h", F.xxhash64("_row")).select(F.explode("tokens").alias("token"), "label", "_h")
    low, high = F.col("_h").bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned("_h", 33)
    block = F.count_if(F.col("label") == "block")
    counts = each.groupBy("token").agg(F.count("*").alias("n"), block.alias("block"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    return [r.asDict() for r in counts.where(F.col("n") >= least).orderBy("token").collect()]


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple]:
    """Rules (tokens, verdict, confidence, support) from rows (tokens array, label allow or block), pruned, best first.

    FP-growth combines only tokens with both labels: a token of one label alone is a rule of confidence 1 that covers all its
    combinations. Tokens that always stand together are combined as one, the first by name. Of what is left a URL
    gives FP-growth its MINED tokens that tell most of the label, so the sets are bounded before they are built; support and confidence of the
    sets so found are counted again on all tokens of all rows, and those decide. Where a URL has more tokens, ``completed`` finds the sets that
    the cut hides, so the rules are those of whole token sets.
    """
    rows = labelled.where(F.col("label").isin("allow", "block")).select(F.array_distinct("tokens").alias("tokens"), "label")
    rows = rows.withColumn("_row", F.array_join(F.array_sort("tokens"), "\n"))
    total, blocked = rows.agg(F.count("*"), F.count_if(F.col("label") == "block")).first()
    if not total:
        return []
    counts = _token_counts(rows, min_support * total)
    found = []
    for c in counts:
        for verdict, n in (("allow", c["n"] - c["block"]), ("block", c["block"])):
            if n >= min_support * total and n / c["n"] >= min_confidence:
                found.append((frozenset([c["token"]]), verdict, n / c["n"], n / total))
    leaders: dict[tuple, dict] = {}
    for c in counts:
        if 0 < c["block"] < c["n"]:
            leaders.setdefault((c["n"], c["block"], c["low"], c["high"]), c)
    told = sorted(leaders.values(), key=lambda c: (-abs(c["block"] / c["n"] - blocked / total) * c["n"] ** 0.5, c["token"]))
    if len(told) > 1:
        rank = F.create_map(*(F.lit(x) for k, c in enumerate(told) for x in (c["token"], k)))
        ranked = F.array_sort(F.filter(F.transform("tokens", lambda t: F.struct(F.try_element_at(rank, t).alias("k"), t.alias("t"))), lambda x: x["k"].isNotNull()))
        items = F.transform(F.slice(ranked, 1, MINED), lambda x: x["t"])
        # rows with equal items mean the same basket many times over; FP-growth counts them, so they stay
        baskets = rows.select(F.array_append(items, F.concat(F.lit("label="), "label")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        sets = {frozenset(x for x in r["items"] if not x.startswith("label=")) for r in model.freqItemsets.collect()}
        counted_sets = recounted(rows, sorted((x for x in sets if len(x) > 1), key=sorted))
        if rows.select(F.size(ranked).alias("n")).where(F.col("n") > MINED).limit(1).count():
            counted_sets |= completed(rows, told, min_support * total)
        for items, counted in counted_sets.items():
            for verdict, n in counted.items():
                if n >= min_support * total and n / sum(counted.values()) >= min_confidence:
                    found.append((items, verdict, n / sum(counted.values()), n / total))
    found.sort(key=lambda r: (len(r[0]), sorted(r[0]), r[1]))
    kept: list[tuple] = []
    by_token: dict[str, list[int]] = {}
    for rule in found:  # shorter first: a rule is redundant if a subset says the same at least as surely
        near = {i for t in rule[0] for i in by_token.get(t, [])}
        if any(kept[i][0] < rule[0] and kept[i][1] == rule[1] and kept[i][2] >= rule[2] for i in near):
            continue
        for t in rule[0]:
            by_token.setdefault(t, []).append(len(kept))
        kept.append(rule)
    return sorted(kept, key=lambda r: (-r[2], -len(r[0]), r[1] != "block", sorted(r[0])))


def completed(rows: DataFrame, told: list[dict], least: float) -> dict[frozenset, dict[str, int]]:
    """The sets of two and more tokens that ``least`` rows of one label hold, with their counts by label, but for those that a smaller set makes redundant.

    Level by level, a pass each. A set of one label alone, or of the same rows as a smaller one, gives no better rule with more tokens, so it is not extended;
    every subset of what is left is left too, so no rule is lost.
    """
    level = {frozenset([c["token"]]): {"allow": c["n"] - c["block"], "block": c["block"]} for c in told}
    level = {k: v for k, v in level.items() if max(v.values()) >= least}
    out: dict[frozenset, dict[str, int]] = {}
    while level:
        by_start: dict[tuple, list[str]] = {}
        for items in sorted(map(sorted, level)):
            by_start.setdefault(tuple(items[:-1]), []).append(items[-1])
        asked = (frozenset((*start, a, b)) for start, ends in by_start.items() for a, b in combinations(ends, 2))
        asked = [x for x in asked if all(x - {t} in level for t in x)]
        found = {x: n for x, n in recounted(rows, asked).items() if max(n.values()) >= least} if asked else {}
        out |= found
        level = {x: n for x, n in found.items() if len(n) > 1 and all(sum(level[x - {t}].values()) > sum(n.values()) for t in x)}
    return out


def recounted(rows: DataFrame, sets: list[frozenset]) -> dict[frozenset, dict[str, int]]:
    """How many rows (tokens, label) hold each set among all their tokens, by label.

    Baskets are cut, so their counts only name the sets. FP-growth names at most 2 ** MINED / support of them: the closure holds them and the driver their counts.
    A row's own combinations of the sets' size are looked up where they are fewer than the sets that its tokens are in.
    """
    index: dict[str, list[int]] = {}
    for i, items in enumerate(sets):
        for t in items:
            index.setdefault(t, []).append(i)
    needs = [len(x) for x in sets]
    width, place = (needs[0], {x: i for i, x in enumerate(sets)}) if len(set(needs)) == 1 else (0, {})

    def held(tokens: list[str]) -> Iterable[int]:
        own = [t for t in tokens if t in index]
        if width and comb(len(own), width) < sum(len(index[t]) for t in own):
            return [place[x] for x in map(frozenset, combinations(own, width)) if x in place]
        return [i for i, n in Counter(i for t in own for i in index[t]).items() if n == needs[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in common.small_batches(batches):
            for tokens, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update((i, label) for i in held(tokens or []))
        columns = list(zip(*((i, label, n) for (i, label), n in total.items()), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["i", "label", "n"])

    out: dict[frozenset, dict[str, int]] = {}
    for r in rows.select("tokens", "label").mapInArrow(run, "i int, label string, n long").groupBy("i", "label").agg(F.sum("n").alias("n")).collect():
        out.setdefault(sets[r["i"]], {})[r["label"]] = r["n"]
    return out


def judge(pages: DataFrame, rules: list[tuple]) -> DataFrame:
    """Adds mined_verdict and mined_tokens (nulls where no rule fires) to rows with a ``tokens`` array."""
    index: dict[str, list[int]] = {}
    for i, (tokens, *_) in enumerate(rules):
        for t in tokens:
            index.setdefault(t, []).append(i)
    needs = [len(r[0]) for r in rules]

    def best(tokens: list[str] | None) -> tuple[str | None, str | None]:
        seen: dict[int, int] = {}
        for t in tokens or []:
            for i in index.get(t, ()):
                seen[i] = seen.get(i, 0) + 1
        fired = min((i for i, n in seen.items() if n == needs[i]), default=None)
        return (None, None) if fired is None else (rules[fired][1], " ".join(sorted(rules[fired][0])))

    def make(column: Callable[[str], pa.Array]) -> list[pa.Array]:
        out = [best(x) for x in column("tokens").to_pylist()]
        return [pa.array([o[k] for o in out], pa.string()) for k in (0, 1)]

    return common.carried(pages, [T.StructField(n, T.StringType()) for n in ("mined_verdict", "mined_tokens")], make).drop("tokens")


def url_filter(pages: DataFrame, fixed: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_tokens) for every page.

    ``labelled`` has url and label (allow or block). By default the URLs that a fixed rule decides are the labelled ones.
    """
    url = F.col("url").cast("string")
    host, path = F.col("host"), F.col("path")

    def with_tokens(df: DataFrame) -> DataFrame:
        df = df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
        return df.withColumn("tokens", tokens_of(F.when(host != "", url), host, path))

    rule, says = fixed_rule(host, path, fixed)
    rows = with_tokens(pages.select(F.col("page_id").cast("long"), "url")).select(
        "page_id", "host", "path", rule.alias("rule"), says.alias("label"), "tokens"
    )
    rules = mine(rows if labelled is None else with_tokens(labelled))
    return judge(rows, rules).select(
        "page_id", "host", "path", "rule", F.coalesce("label", "mined_verdict", F.lit("allow")).alias("verdict"), "mined_tokens"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(common.read(spark, sf_dir, "pages"))
