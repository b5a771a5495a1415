"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, htmltext, huffman, jaccard, langid, mixing, pii, sharding, sortmeans, topk, urlfilter
from .common import table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return huffman.ids_from_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_windows", "changed")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(table(spark, sf_dir, "documents"), path, pattern)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.clustered(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))


OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), u AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM w
), five AS (
    SELECT doc_id, spot, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3, lead(word, 3) OVER x AS w4, lead(word, 4) OVER x AS w5 FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY spot)
), s AS (
    SELECT DISTINCT doc_id, concat_ws(' ', word, w2, w3, w4, w5) AS shingle FROM five WHERE w5 IS NOT NULL OR spot = 1
), sets AS (
    SELECT doc_id, COUNT(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS same FROM s GROUP BY doc_id
), node AS (
    SELECT same, MIN(doc_id) AS node, COUNT(*) AS copies, MIN(n) AS n FROM sets GROUP BY same
), t AS (
    SELECT node.node, node.n, s.shingle FROM node JOIN s ON s.doc_id = node.node
), met AS (
    SELECT a.node AS u, b.node AS v, a.n AS nu, b.n AS nv, COUNT(*) AS shared
    FROM t a JOIN t b ON a.shingle = b.shingle AND a.node < b.node AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL
), half AS (
    SELECT u, v FROM met WHERE 100 * shared >= 75 * (nu + nv - shared)
), link AS (
    SELECT u, v FROM half UNION ALL SELECT v, u FROM half
), reach AS (
    SELECT node AS u, node AS root FROM node UNION SELECT l.v, r.root FROM reach r JOIN link l ON l.u = r.u
), class AS (
    SELECT u, MIN(root) AS root FROM reach GROUP BY u
), others AS (
    SELECT l.u, SUM(m.copies) AS links FROM link l JOIN node m ON m.node = l.v GROUP BY l.u
)
SELECT d.doc_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, CAST(coalesce(k.copies - 1 + coalesce(o.links, 0), 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sets e ON e.doc_id = d.doc_id LEFT JOIN node k ON k.same = e.same LEFT JOIN class c ON c.u = k.node LEFT JOIN others o ON o.u = k.node
"""

OP11_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), p AS (
    SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
           list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS g
    FROM d
), c AS (
    SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain'
                WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM p
), x AS (
    SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
    FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM x
"""


def op12_sql(rounds: int = 3) -> str:
    """Every distance of every round."""
    steps = [
        """WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q
    FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT 16)
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
    SELECT rid, arg_min(k, d * 1000 + k) AS k, min(d) AS d
    FROM (SELECT v.rid, c.k, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r} c)
    GROUP BY rid
)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS q
    FROM (SELECT a.k, p, CAST(sum(v.q[p]) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} a USING (rid), range(1, 65) t(p) GROUP BY a.k, p)
    GROUP BY k
), c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (k))"""
            )
    return (
        ", ".join(steps)
        + f"""
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON a.k = c.k
"""
    )


OP13_SQL = r"""
WITH q AS (
    SELECT doc_id, 0.5::DOUBLE + avg(quality) * 1.5::DOUBLE AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
           -ln((CAST(CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0::DOUBLE) / coalesce(w, 1.0) AS key
    FROM documents LEFT JOIN q USING (doc_id)
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (  -- in the order in which a rising level meets the bounds
    SELECT *, row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, source) AS place, (SELECT sum(source_size) FROM s) AS whole FROM s
), l AS (
    SELECT *, (whole - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
    SELECT source, source_size, least(w * (SELECT arg_min(level, place) FROM l WHERE level * w <= 3 * source_size), (3 * source_size)::DOUBLE) AS target FROM s
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
           CAST(round(target) AS BIGINT) - CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size * source_size ELSE 0 END AS rest FROM t
), r AS (
    SELECT d.doc_id, d.source, size, source_size, target, epochs,
           greatest(0, least(size, rest - (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size))) AS part
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target, CAST(size * epochs + part AS BIGINT) AS taken,
       CAST(epochs + CASE WHEN part = size AND size > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(CASE WHEN part = size THEN 0 ELSE part END AS BIGINT) AS part
FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_personal_data": op1_personal_data,
        "op2_token_files": op2_token_files,
        "op3_sharding": op3_sharding,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_url_filters": op6_url_filters,
        "op7_html_text": op7_html_text,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_sort_means": op12_sort_means,
        "op13_mixing": op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": OP8_SQL, "op9_ngram_jaccard": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_sort_means": op12_sql(), "op13_mixing": OP13_SQL}
