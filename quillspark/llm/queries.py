"""Queries of the subpackage and, where SQL can express one, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.embedding_dedup import op5_embedding_dedup
from quillspark.llm.filter_audit import op13_filter_audit
from quillspark.llm.html_extract import op11_html_extract
from quillspark.llm.kneser_ney import op10_quality_classifier
from quillspark.llm.license_scan import op6_license_scan
from quillspark.llm.merge_dropout import op3_merge_dropout
from quillspark.llm.near_dup import op9_near_dedup
from quillspark.llm.packing import op8_packing
from quillspark.llm.quality_rules import op1_quality_rules
from quillspark.llm.secret_scan import op2_secret_scan
from quillspark.llm.toxicity import op7_toxicity
from quillspark.llm.url_filter import op4_url_filter
from quillspark.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, op12_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_quality_rules,
        op2_secret_scan,
        op3_merge_dropout,
        op4_url_filter,
        op5_embedding_dedup,
        op6_license_scan,
        op7_toxicity,
        op8_packing,
        op9_near_dedup,
        op10_quality_classifier,
        op11_html_extract,
        op12_vector_codes,
        op13_filter_audit,
    )
    return {f.__name__: f for f in made}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every row of ``n`` (id) with the least id that links ``l`` (a, b) lead to.
_COMPONENTS = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(id, c) AS (SELECT id, id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
    k AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""

#: White space in SQL's expressions.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _codes() -> str:
    """All rounds in a row: r holds rows by part, b0 to b6 the codebooks, a0 to a6 the nearest entries."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, any_value(s) AS s, min(list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + k) AS best
            FROM r JOIN b{k} USING (p) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT p, best % {ENTRIES} AS k, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM a{k}),
            t{k} AS (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM m{k} GROUP BY ALL),
            u{k} AS (SELECT p, k, list((t - ((t % n) + n) % n) // n ORDER BY j) AS c FROM t{k} GROUP BY ALL),
            b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.k, coalesce(u{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN u{k} ON b{k}.p = u{k}.p AND b{k}.k = u{k}.k)""")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        r AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS s FROM v, (SELECT unnest(range({PARTS})) AS p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, s AS c FROM r QUALIFY k < {ENTRIES}), {", ".join(steps)},
        h AS (SELECT p, k, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM b{ROUNDS}),
        o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) FROM h) AS codebooks_sha256 FROM o"""


ORACLES = {
    # the pages of these tables mark their article, its blocks are h1 and p, and few character references occur in it
    "op11_html_extract": f"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
        b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(a, '<br>', ' '), '</?(?:p|h1)>'), lambda x:
            replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), chr(1), '&')) AS b FROM a),
        t AS (SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), lambda x: x <> '') AS t FROM b)
        SELECT page_id, url, array_to_string(t, chr(10) || chr(10)) AS text, CAST(length(array_to_string(t, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM t""",
    "op12_vector_codes": _codes(),
    "op13_filter_audit": """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
            CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
            CASE WHEN d.doc_id > least THEN 'E' ELSE '' END) AS fails FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
        g AS (SELECT part, regexp_extract_all(fails, '[A-E]') AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
        s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
        p AS (SELECT concat(a.s, b.s, c.s, d.s, e.s) AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
        q AS (SELECT filter_order, step, filter_order[step] AS own, regexp_extract_all(filter_order[1:step - 1], '[A-E]') AS earlier FROM p, (SELECT unnest(range(1, 6)) AS step)),
        y AS (SELECT *, list_contains(fails, own) AS own_fails, len(list_intersect(fails, earlier)) > 0 AS gone FROM g, q),
        z AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT own_fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND own_fails), 0) AS removed,
            coalesce(sum(n) FILTER (gone AND own_fails), 0) AS redundant, coalesce(sum(n) FILTER (own_fails AND len(fails) = 1), 0) AS unique_fails,
            coalesce(sum(good) FILTER (NOT gone AND own_fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND own_fails), 0) AS toxic_lost FROM y GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z""",
    "op5_embedding_dedup": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        u AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM n
            WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        l AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id < y.id AND len(x.v) = len(y.v) AND x.s > 0 AND y.s > 0
            WHERE list_dot_product(x.v, y.v) / (x.s * y.s) >= 0.95), {_COMPONENTS},
        d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT k.id AS vec_id, coalesce(d.n, 0) AS n_links, k.c AS component_id, k.id = k.c AS kept FROM k LEFT JOIN d ON d.a = k.id""",
    "op9_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        n AS (SELECT id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        t AS (SELECT id, unnest(s) AS t FROM n),
        p AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * m >= 85 * (len(x.s) + len(y.s) - m)), {_COMPONENTS}
        SELECT n.id AS doc_id, CAST(len(n.s) AS BIGINT) AS n_shingles, k.c AS component_id, n.id = k.c AS kept FROM n JOIN k USING (id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
