"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, collocations, decontaminate, line_dedup, merkle, ngram_jaccard, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity, url_filter
from .common import ascii_lower, table


#: Whoever runs the query for real names a key of their own.
PII_KEY = "veridoc example key"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, listed = url_filter.default_lists(spark)
    pages = table(spark, sf_dir, "pages")
    out = url_filter.judge_urls(pages, rules, listed.unionByName(url_filter.urls_of_sites(pages)), keep=("page_id",))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fitted(docs.where(~toxicity.held_out()), labels)
    out = quality_classifier.score_documents(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "text_score", "metadata_score", "score", "predicted", (F.col("predicted") == 1).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_documents(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), key=PII_KEY)
    return out.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"), "text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), **line_dedup.WHOLE)
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), received={"text": tampered})


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_quality_classifier, op3_quality_rules, op4_ngram_jaccard, op5_toxicity, op6_byte_bpe, op7_pii, op8_token_counts, op9_line_dedup, op10_benchmark_decontamination, op11_merkle_manifest, op12_collocations, op13_suffix_dedup)}

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": rf"""
        WITH p AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}) AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(rh, rp, v)),
        fit AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
                FROM (SELECT DISTINCT host, path, page_id FROM p) q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
        SELECT p.page_id, p.host, p.path, fit.rule,
               coalesce(fit.v, CASE WHEN regexp_replace(p.host || p.path, '/+$', '') IN ('ads.example.org/click', 'tracker.example.com/pixel', 'mirror.example.org/spam')
                                OR regexp_matches(p.host, '(^|[.:])(casino-win|free-bets|cheap-pills)([.:]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN fit USING (page_id, host, path)""",
    "op4_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT y, c FROM reach JOIN link ON x = a WHERE c < y)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)""",
    "op9_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, th, i - 1 AS line, (CAST(doc_id AS HUGEINT) * 1152921504606846976 + th) * 10000000 + i AS place, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w
          FROM (SELECT doc_id, th, s[i] AS x, i FROM (SELECT doc_id, th, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT DISTINCT doc_id, CAST(concat('0x', substring(md5(text), 1, 15)) AS BIGINT) AS th, string_split(text, chr(10)) AS s FROM documents)))),
        f AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, any_value(len(w)) AS n, min(place) AS place FROM l WHERE len(w) > 0 GROUP BY 1),
        h AS (SELECT place, n, w, m, array_to_string(w[1:m // 2], ' ') AS k1, array_to_string(w[n - (m - m // 2) + 1:n], ' ') AS k2 FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 5)),
        pair AS (
          SELECT x.place AS a, y.place AS b, x.w AS v, y.w AS w FROM h x JOIN h y ON x.m = y.m AND x.k1 = y.k1 WHERE x.m = x.n AND x.place <> y.place
          UNION ALL SELECT x.place, y.place, x.w, y.w FROM h x JOIN h y ON x.m = y.m AND x.k2 = y.k2 WHERE x.m = x.n AND x.place <> y.place),
        spot AS (SELECT *, coalesce(list_position(list_transform(range(1, len(v) + 1), lambda i: v[i] = w[i]), false), len(v) + 1) AS p FROM pair),
        near AS (SELECT DISTINCT greatest(a, b) AS place FROM spot WHERE v[p + 1:] = w[p + 1:] AND len(v) = len(w) OR len(w) = len(v) + 1 AND v[p:] = w[p + 1:]),
        gone AS (SELECT place, 1 AS near FROM near UNION ALL SELECT l.place, 0 FROM l JOIN f ON array_to_string(l.w, ' ') = f.t WHERE len(l.w) > 0 AND l.place <> f.place),
        made AS (SELECT doc_id, th, count(*) AS n_lines, count(near) AS n_dropped, coalesce(sum(near), 0) AS n_near,
                        coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (near IS NULL), '') AS text FROM l LEFT JOIN gone USING (place) GROUP BY 1, 2)
        SELECT d.doc_id, n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, length(made.text) AS n_chars, sha256(made.text) AS text_sha256
        FROM documents d LEFT JOIN made ON made.doc_id = d.doc_id AND made.th = CAST(concat('0x', substring(md5(d.text), 1, 15)) AS BIGINT)""",
    "op10_benchmark_decontamination": rf"""
        WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, {_UPPER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS t, least(len(w), 10) AS l
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
        dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
        hit AS (SELECT c.doc_id, c.p, c.l, win.item_id FROM
                  (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS t FROM spot CROSS JOIN (SELECT DISTINCT l FROM win) WHERE p + l - 1 <= len(w)) c JOIN win USING (t)),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY 1),
        i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY 1)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op12_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
        i AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
        g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY 1, 2, 3),
        c AS (SELECT * FROM g WHERE m > 1 AND f >= 100),
        k AS (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM c),
        cut AS (SELECT k.lang, k.phrase, k.m, k.f AS a, k.k, x.f AS l, y.f AS r, n.n, CAST((1000 * CAST(k.f AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
                FROM k JOIN n USING (lang) JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:k.m], ' ')),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM cut),
        gone AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND t.m > s.m AND t.f >= s.f AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
        kept AS (SELECT best.* FROM best LEFT JOIN gone ON gone.lang = best.lang AND gone.phrase = best.phrase WHERE first = 1 AND gone.phrase IS NULL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
