"""Page extraction, vector codes and the filter audit: against known pages and brute force."""

import hashlib
import html
import math
import random
import re
import string
import uuid
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common, filter_audit, html_extract, queries, secret_scan, url_filter, vector_codes

LINE = "A line of prose that is long enough to be dense, and it says so at some length. "
SMALL = Path("/root/testdata/sf0.001")

PAGES = [
    # one column beside boilerplate without an article element
    (f"<body><header><a href=/>Site</a></header><div class=c><h1>Head</h1><p>{LINE}<p>{LINE} &amp; &#233;</div><div class='side sidebar'><p>{LINE}</div><footer>{LINE}</footer>", f"Head\n\n{LINE.strip()}\n\n{LINE.strip()} & é"),
    # the article in two parts, an advert between them, its title outside
    (f"<div><h1>Head</h1><div><p>{LINE}<p>{LINE}</div><div class=ad-slot>buy</div><div><p>{LINE}</p></div></div>", f"Head\n\n{LINE.strip()}\n\n{LINE.strip()}\n\n{LINE.strip()}"),
    # readers write more than the author
    (f"<article><h2>T</h2><p>short</p></article><section id=comments><article class=comment><p>{LINE * 9}</p></article><article><p>{LINE * 9}</article></section>", "T\n\nshort"),
    ("<body class='has-sidebar'><div class='layout-sidebar'><main><p>x <b>y</b><br>z</p></main></div>", "x y z"),
    (f"<form id=f><div><p>{LINE}</p><p>{LINE}</p></div></form><nav>n</nav>", f"{LINE.strip()}\n\n{LINE.strip()}"),
    (f"<article><p>{LINE}</p><ul><li><a href=1>more</a></li><li><a href=2>of it</a></li></ul><ul><li>item <a href=3>x</a></li></ul><form><input><label>Name</label></form><aside>{LINE}</aside></article>", f"{LINE.strip()}\n\nitem x"),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>a &lt;b&gt; &copy c&nbsp;&nbsp;d<!-- e > f --></p><div role=alert>g</div><div class='cookie-notice'>h</div>", "a <b> © c d"),
    ("<p title='a>b' class=x>q</p><p don't>r</p>", "q\n\nr"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "a\n\nb\n\nc"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
    ("bare text", "bare text"),
    ("<article>cut <b>off <scr", "cut off"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_known_pages(page, text):
    assert html_extract.main_text(page) == text


def test_density_of_a_small_tree():
    tree = html_extract.Page("<div><p>abcd</p><p>ab <a href=x>cd</a></p></div><div>xy</div>")
    tree.measure()
    div, plain, linked = 1, 2, 3
    assert [tree.name[i] for i in (div, plain, linked)] == ["div", "p", "p"] and tree.chars[0] == 10

    def density(c, t, lc, lt):
        base = max(math.log(c * lc / max(c - lc, 1) + 2 / 10 * c + math.e), math.e)
        return c / t * max(math.log(c * t / (max(lc, 1) * max(lt, 1)), base), 0)

    assert tree.density[plain] == pytest.approx(density(4, 1, 0, 0)) and tree.density[linked] == pytest.approx(density(4, 1, 2, 1))
    assert tree.density[div] == pytest.approx(density(8, 3, 2, 1)) and tree.total[div] == pytest.approx(tree.density[plain] + tree.density[linked])


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</b>" * 20_000, "<a " * 60_000, "<p>" * 20_000 + "x", "<script>" * 40_000, "<li>x" * 20_000, "<b>" * 3000 + "<p>x" * 3000, "<x a='" * 40_000, "<x a=\"'" * 40_000 + "<p>y", "&" * 200_000, "<!--" * 50_000])
def test_broken_pages_cost_in_proportion(page):
    html_extract.main_text(page)  # each is far slower than a test may be if a step is quadratic


def test_pages_in_a_table(spark):
    rows = [(i, None if i % 3 else "u", page, "x", 7) for i, (page, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `n.chars` int")
    out = html_extract.extracted(df).collect()
    assert len(out) == len(rows)
    want = {i: t for i, (_, t) in enumerate(PAGES)} | {None: PAGES[0][1]}
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_pages_of_the_small_table(spark):
    def plain(block):
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", block.replace("<br>", " "))).split())

    pages = common.read(spark, str(SMALL), "pages").collect()
    got = {r["page_id"]: r["text"] for r in queries.op11_html_extract(spark, str(SMALL)).collect()}
    for r in pages:
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == "\n\n".join(filter(None, map(plain, re.split(r"</?(?:p|h1)>", body))))


def brute_codes(rows, parts, entries, rounds, scale):
    """(id, code, error, digest) of rows (id, vector) of one length, in plain integers."""
    rows = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    n = len(rows[0][1])
    cut = [(n * p // parts, n * (p + 1) // parts) for p in range(parts)]
    books = [[v[a:b] for _, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]] for a, b in cut]

    def nearest(piece, book):
        return min((sum((x - y) ** 2 for x, y in zip(piece, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = {}
            for _, v in rows:
                groups.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    best = [[nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cut)] for _, v in rows]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in x), min(2**63 - 1, sum(d for d, _ in x)), digest) for (i, _), x in zip(rows, best, strict=True)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, n int"


@pytest.mark.parametrize(("n", "size", "block"), [(60, 1.0, 8192), (60, 1.0, 7), (60, 1e9, 7), (5, 1.0, 8192), (1, 1.0, 8192)])
def test_vector_codes(spark, monkeypatch, n, size, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = random.Random(n)
    good = [(rng.choice([None, *range(40)]), [rng.gauss(0, size) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(n)]
    good += good[:1]
    bad = [(1, None, 1), (2, [1.0, None] + [0.0] * 6, None), (3, [float("nan")] * 8, 1), (4, [float("-inf")] * 8, 2)]
    df = spark.createDataFrame([(*r, "c", "e", 0) for r in good + bad], VECTORS)
    rows, book = vector_codes.compressed(df, 4, 6, 5, 100)
    out = vector_codes.with_label_errors(rows).collect()
    want = brute_codes([(i, v) for i, v, _ in good], 4, 6, 5, 100)
    assert Counter((r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in out) == Counter(want)
    sums = Counter()
    for (_, _, label), (_, _, error, _) in zip(good, want, strict=True):
        sums[label] += error
    assert Counter(r["label_error"] for r in out) == Counter(min(2**63 - 1, sums[label]) for _, _, label in good)
    assert [len(b) for b in book[8]] == [min(6, len(good))] * 4


def test_vector_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [], 1, "", "", 0), (2, [], None, "", "", 0), (3, [0.5, 0.25, 0.125], 1, "", "", 0), (4, [1.0, 0.0, 0.0], 1, "", "", 0)], VECTORS)
    rows, book = vector_codes.compressed(df)
    out = {r["vec_id"]: (r["code"], r["error"]) for r in rows.collect()}
    assert out == {1: ("00" * 8, 0), 2: ("00" * 8, 0), 3: ("00" * 8, 0), 4: ("01" * 3 + "00" * 5, 0)}
    assert vector_codes.with_label_errors(vector_codes.compressed(df.limit(0))[0]).count() == 0


def test_label_errors_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a" if i % 3 else None, "c", i, "s") for i in range(50)], "vec_id long, label string, code string, error long, codebooks_sha256 string")
    want = sorted(tuple(r) for r in vector_codes.with_label_errors(rows).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r[c] for c in ("vec_id", "code", "error", "codebooks_sha256", "label_error")) for r in vector_codes.with_label_errors(rows).collect()) == want
    assert {r[-1] for r in want} == {sum(range(0, 50, 3)), sum(i for i in range(50) if i % 3)}


def brute_audit(rows, labels):
    """The report by running every order over every document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = {}
    for i, t, source in rows:
        text = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (i is not None and i > least[text])
        good, toxic = (i is not None and any(a == i and x[k] == 1 for a, *x in labels) for k in (0, 1))
        parts.setdefault(source or "", []).append((fails, good, toxic))
    for part, docs in parts.items():
        removed = Counter()
        out = []
        for order in map("".join, permutations("ABCDE")):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                own = sum(f in d[0] for d in docs)
                removed[f] += len(gone)
                out.append((f, (part, order, step, len(alive), len(gone), own - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        yield from ((*row, removed[f]) for f, row in out)


def test_filter_audit(spark, messy):
    rng = random.Random(3)
    rows = [(r[0], r[1], rng.choice(["a", "b", None, ""])) for r in messy]
    rows += [(100 + i, rng.choice(["same text", "A B C # d", "  "]), rng.choice("ab")) for i in range(40)] + [(None, "same text", "a")] * 3
    labels = [(rng.choice([None, *range(1, 60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, 1, "m", True) for r in rows], "doc_id long, text string, source string, mask int, part string, first boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.masked(docs, marks))
    want = list(brute_audit(rows, labels))
    assert len(want) == 600 * 3 and Counter(map(tuple, out.collect())) == Counter(want)
    assert filter_audit.audit(filter_audit.masked(docs.limit(0), marks)).count() == 0


def test_shares_of_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", m, False, False) for m in (0, 1, 3, 3, 2, 7)], "part string, mask int, good boolean, toxic boolean")
    out = filter_audit.audit(rows, "XYZ").collect()
    assert len(out) == 18
    for f in "XYZ":
        assert sum(r["removed"] for r in out if r["filter_order"][r["step"] - 1] == f) == next(r["shapley"] for r in out if r["filter_order"][r["step"] - 1] == f)


@pytest.mark.parametrize("name", ["op11_html_extract", "op12_vector_codes", "op13_filter_audit"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, str(SMALL))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_confidences_of_urls_with_many_tokens(spark):
    """Far more tokens of both labels than a basket takes: every reported figure is that of whole token sets."""
    rng = random.Random(6)
    rows = []
    for _ in range(1500):
        tokens = {f"n{rng.randrange(24)}" for _ in range(30)}
        pair = rng.random() < 0.15
        if pair:
            tokens |= {"x", "y"}
        elif rng.random() < 0.4:
            tokens.add(rng.choice("xy"))
        rows.append((sorted(tokens), "block" if pair and rng.random() < 0.95 or not pair and rng.random() < 0.2 else "allow"))
    found = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert any(r[0] == {"x", "y"} and r[1] == "block" for r in found)
    for items, verdict, confidence, support in found:
        held = [label for t, label in rows if items <= set(t)]
        assert confidence == pytest.approx(held.count(verdict) / len(held)) and support == pytest.approx(held.count(verdict) / len(rows))
        assert confidence >= url_filter.MIN_CONFIDENCE and support >= url_filter.MIN_SUPPORT


def test_rules_stay_and_keys_of_other_alphabets_go(spark):
    rng = random.Random(12)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, words = "0123456789ABCDEF", "river mountain handler factory yellow account payment shipping tracker engine stream".split()
    secrets = [f() for _ in range(60) for f in (lambda: make(hexes, 32), lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: make(string.ascii_letters + string.digits, 32))]
    plain = ["-" * 40, "_" * 40, "=" * 25, "|---------------------------------|", "-" * 22 + "+" + "-" * 30, "2024-05-06-07-08-09-10-11"]
    plain += [f() for _ in range(60) for f in (lambda: rng.choice(words) + "".join(rng.choice(words).title() for _ in range(4)), lambda: "/".join(rng.choice(words) for _ in range(5)), lambda: "_".join(rng.choice(words).upper() for _ in range(4)))]
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(secrets + plain)], "id int, text string")
    out = {r["id"]: r["text"] for r in secret_scan.redact(df, ratios).collect()}
    caught = [out[i] != f"see {t} here" for i, t in enumerate(secrets + plain)]
    assert sum(caught[: len(secrets)]) >= 0.97 * len(secrets) and not any(caught[len(secrets) :])


def test_runs_that_touch_base_spans_are_dropped(spark):
    """The same runs as by comparing all pairs."""
    rng = random.Random(13)
    pieces = ["token=", "AKIA", "-", " ", " plain words ", "/"]
    word = lambda: "".join(rng.choice(rng.choice(["0123456789abcdef", string.ascii_letters + string.digits])) for _ in range(rng.choice([8, 24, 40])))
    texts = ["".join(rng.choice(pieces) + word() for _ in range(rng.randint(1, 12))) for _ in range(80)]
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    at = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    odds = lambda t: sum(ratios[at[a] * len(at) + at[b]] for a, b in zip(t, t[1:], strict=False))
    some = 0
    for r in secret_scan.scan(df, ratios).collect():
        base = [(x["start"], x["end"]) for x in r["found"] if x["kind"] < 3]
        runs = [(m.start(), m.end()) for m in re.finditer(secret_scan.RUN + "{20,}", r["text"]) if odds(m[0]) >= secret_scan.LOG_ODDS]
        want = [(a, b) for a, b in runs if not any(c < b and a < d for c, d in base)]
        assert [(x["start"], x["end"]) for x in r["found"] if x["kind"] == 3] == want
        some += len(want)
    assert some


def test_pipeline_keeps_odd_columns(spark, documents):
    rows = documents.where("text is not null").withColumn("x.y", F.lit(1)).withColumn("__secret_spans", F.lit("s"))
    out = corpus_pipeline.secrets(spark, rows, "")
    assert out.columns == rows.columns and {r["__secret_spans"] for r in out.collect()} == {"s"}
