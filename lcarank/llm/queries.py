"""One registered query for each operator, over whole tables, and its DuckDB statement where SQL can
express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lcarank.llm import bpe, collocations, decontaminate, hard_negatives, html_extract, jaccard_join, language_id, pii, quality_classifier, quality_rules, simhash, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_quality_classifier, op3_jaccard_join, op4_decontamination, op5_quality_rules, op6_language_id, op7_warc,
                                   op8_substring_dedup, op9_pii, op10_bpe, op11_hard_negatives, op12_collocations, op13_simhash_dedup)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    """A-Z only."""
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


_SPACED = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE = {
    "op3_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, {_SPACED}) AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
        SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.r) AS component_id
        FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, {_LETTERS}) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_lower("text")}, {_LETTERS}) AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
               FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                     FROM (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0))),
        dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
               FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM bw))),
        hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.size = dw.size),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
        kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS text, count(*) AS n
                 FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u
                 LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p WHERE gone.p IS NULL GROUP BY u.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
    "op11_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score
              FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS k
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
    "op12_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        f AS (SELECT lang, p, m, count(*) AS f
              FROM (SELECT lang, m, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m)))
              GROUP BY lang, p, m),
        c AS (SELECT lang, p, m, f AS a FROM f WHERE m > 1 AND f >= 30),
        cuts AS (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
                 FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:m]),
        low AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS q FROM cuts),
        longer AS (SELECT lang, p, max(a) AS a
                   FROM (SELECT lang, a, p[i:i + s - 1] AS p FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)))
                   GROUP BY lang, p),
        kept AS (SELECT low.lang, array_to_string(low.p, ' ') AS phrase, low.a, l, r, score
                 FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.p = low.p WHERE q = 1 AND (longer.a IS NULL OR 100 * longer.a < 80 * low.a)),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
        top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT top.lang, rank, phrase, a, l, r, n, score FROM top JOIN n ON n.lang = top.lang WHERE rank <= 2000""",
}
