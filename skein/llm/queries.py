"""Queries of the training-data operators over the whole of their tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import decontaminate, exact_dedup, line_dedup, near_dedup, packing, pii, suffix_dedup, token_files, toxicity, warc
from skein.llm.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_records(_table(spark, sf_dir, "pages")))
    joined = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return out.select("record_id", "url", "status", "source_id", "digest", joined.alias("headers"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(_table(spark, sf_dir, "documents"), digest=True).drop("row_key")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.repeated_lines(_table(spark, sf_dir, "documents")).drop("row_key")
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op6_line_dedup_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op6_line_dedup, at a Jaccard similarity of 0.9."""
    out = line_dedup.repeated_lines(_table(spark, sf_dir, "documents"), percent=90).drop("row_key")
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), packing.word_tokens())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] < pii.BASE)
    return found.select("doc_id", *[count(k) for k in pii.KINDS[: pii.BASE]], F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(spans).alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL = (
    op1_decontamination,
    op2_near_dedup,
    op3_revisits,
    op4_exact_dedup,
    op5_toxicity,
    op6_line_dedup,
    op6_line_dedup_90,
    op7_packing,
    op8_pii,
    op9_suffix_dedup,
    op10_token_files,
)
QUERIES = {f.__name__: _shipped(f) for f in _ALL}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PII_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_PII_DIGITS})), lambda i: CASE WHEN i % 2 = 1
    THEN CAST(substr({_PII_DIGITS}, length({_PII_DIGITS}) - i, 1) AS INT) * 2 // 10 + CAST(substr({_PII_DIGITS}, length({_PII_DIGITS}) - i, 1) AS INT) * 2 % 10
    ELSE CAST(substr({_PII_DIGITS}, length({_PII_DIGITS}) - i, 1) AS INT) END)) % 10 = 0"""

ORACLE_SQL = {
    "op1_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        x AS (SELECT id, 13 AS m, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)
              UNION ALL SELECT id, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND 12),
        s AS (SELECT DISTINCT m FROM x),
        dw AS (SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, s WHERE len(w) >= m)),
        h AS (SELECT doc_id, k, m, id FROM dw JOIN x USING (m, g)),
        p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id),
        o AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items, sha256(coalesce(o.ids, '')) AS items_sha256,
               coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN o USING (doc_id)
    """,
    "op2_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, doc_id = min(r.c) AS kept
        FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n
    """,
    "op8_pii": rf"""
        WITH k(kind, ord, pattern) AS (VALUES
            ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
            ('card', 2, '[0-9](?:[ -]?[0-9])+'), ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]'), ('iban', 4, '\b[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\b')),
        d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        e AS (SELECT doc_id, kind, ord, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS gaps FROM d, k),
        f AS (SELECT doc_id, kind, ord, hits[i] AS m,
                     CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
              FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM e)),
        g AS (SELECT doc_id, kind, ord, s, s + length(m) AS z FROM f WHERE CASE kind
            WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(right(ltrim(p, '0'), 3) AS INT), 0) <= 255))
            WHEN 'card' THEN length({_PII_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}
            WHEN 'phone' THEN length({_PII_DIGITS}) BETWEEN 10 AND 15
            WHEN 'iban' THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(m[5:] || m[1:4], ''), lambda c: CAST(ascii(c) AS BIGINT))),
                 lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1
            ELSE true END),
        a AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_email, count(*) FILTER (ord = 1) AS n_ip, count(*) FILTER (ord = 2) AS n_card, count(*) FILTER (ord = 3) AS n_phone,
                     string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, ord) FILTER (ord < 4) AS base, string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, ord) AS spans FROM g GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)
    """,
    "op6_line_dedup_90": """
        WITH l AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line, generate_subscripts(string_split(lower(coalesce(text, '')), chr(10)), 1) - 1 AS no FROM documents),
        t AS (SELECT doc_id, no, doc_id * 10000000 + no AS place, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda x: x <> ''))) AS s FROM l),
        k AS (SELECT *, CASE WHEN len(s) > 0 THEN array_to_string(s, ' ') END AS c FROM t),
        c AS (SELECT c, any_value(s) AS s, len(any_value(s)) AS n, min(place) AS place FROM k WHERE c IS NOT NULL GROUP BY c),
        w AS (SELECT c, n, unnest(s) AS w FROM c WHERE n * 100 >= (n + 1) * 90),
        f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
        p AS (SELECT c, n, w FROM (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS i FROM w JOIN f USING (w)) WHERE i <= n - ceil(n * 90 / 100.0) + 1),
        q AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.w = b.w AND a.c < b.c AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90),
        e AS (SELECT a, b, x.place < y.place AS first FROM q JOIN c x ON a = x.c JOIN c y ON b = y.c WHERE len(list_intersect(x.s, y.s)) * 190 >= 90 * (x.n + y.n)),
        d AS (SELECT c, count(*) AS links, bool_or(late) AS late FROM (SELECT a AS c, NOT first AS late FROM e UNION ALL SELECT b, first FROM e) GROUP BY c),
        j AS (SELECT k.doc_id, k.no, coalesce(k.place <> c.place OR d.late, k.place <> c.place, false) AS gone, coalesce(d.links, 0) AS links FROM k LEFT JOIN c USING (c) LEFT JOIN d USING (c))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links, coalesce(string_agg(no, ',' ORDER BY no) FILTER (gone), '') AS removed
        FROM j GROUP BY doc_id
    """,
    "op6_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(lower(translate(coalesce(text, ''), chr(9) || chr(13) || chr(12) || chr(11), '    ')), chr(10))) AS line, generate_subscripts(string_split(lower(translate(coalesce(text, ''), chr(9) || chr(13) || chr(12) || chr(11), '    ')), chr(10)), 1) - 1 AS no FROM documents),
        t AS (SELECT doc_id, no, doc_id * 10000000 + no AS place, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda x: x <> ''))) AS s FROM l),
        k AS (SELECT *, CASE WHEN len(s) > 0 THEN array_to_string(s, ' ') END AS c FROM t),
        c AS (SELECT c, any_value(s) AS s, len(any_value(s)) AS n, min(place) AS place FROM k WHERE c IS NOT NULL GROUP BY c),
        w AS (SELECT c, n, unnest(s) AS w FROM c WHERE n * 100 >= (n + 1) * 85),
        f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
        p AS (SELECT c, n, w FROM (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS i FROM w JOIN f USING (w)) WHERE i <= n - ceil(n * 85 / 100.0) + 1),
        q AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.w = b.w AND a.c < b.c AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85),
        e AS (SELECT a, b, x.place < y.place AS first FROM q JOIN c x ON a = x.c JOIN c y ON b = y.c WHERE len(list_intersect(x.s, y.s)) * 185 >= 85 * (x.n + y.n)),
        d AS (SELECT c, count(*) AS links, bool_or(late) AS late FROM (SELECT a AS c, NOT first AS late FROM e UNION ALL SELECT b, first FROM e) GROUP BY c),
        j AS (SELECT k.doc_id, k.no, coalesce(k.place <> c.place OR d.late, k.place <> c.place, false) AS gone, coalesce(d.links, 0) AS links FROM k LEFT JOIN c USING (c) LEFT JOIN d USING (c))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links, coalesce(string_agg(no, ',' ORDER BY no) FILTER (gone), '') AS removed
        FROM j GROUP BY doc_id
    """,
    "op9_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 398)) AS i FROM d WHERE length(h) >= 800)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
        k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r)),
        s AS (SELECT doc_id, min(i) AS lo, max(i) + 399 AS hi FROM k GROUP BY doc_id, k),
        p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a FROM s),
        c AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, string_agg(substr(h, 2 * a - 1, 2 * (lo - a)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
              FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op3_revisits": r"""
        WITH p AS (
            SELECT page_id, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS etag, sha256(coalesce(html, '')) AS sha,
                   1704067200 + page_id * 60 AS sec,
                   regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
            FROM pages),
        c AS (
            SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(?:80|443)$', '', 'g')
                   || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
                       lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|fbclid|gclid|ref)(?:=|$)'))), '&') AS q
            FROM p),
        u AS (SELECT *, stem || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM c),
        m AS (
            SELECT a.page_id, a.url, a.sec, a.etag, b.page_id AS src, b.sha AS src_sha, b.sec AS src_sec, b.etag AS src_etag,
                   row_number() OVER (PARTITION BY a.page_id ORDER BY b.sec DESC, b.page_id DESC) AS rn
            FROM u a LEFT JOIN u b ON a.url = b.url AND b.sec < a.sec + 86400)
        SELECT page_id * 2 + 1 AS record_id, url,
               CASE WHEN src IS NULL THEN 'orphan' WHEN etag = src_etag THEN 'resolved' ELSE 'changed' END AS status,
               src * 2 AS source_id,
               CASE WHEN etag = src_etag THEN src_sha END AS digest,
               CASE WHEN etag = src_etag THEN 'Cache-Control: max-age=3600' || chr(10) || 'Content-Type: text/html' || chr(10)
                    || 'Date: ' || (sec + 86400) || chr(10) || 'ETag: W/' || etag END AS headers
        FROM m WHERE rn = 1
    """,
}
