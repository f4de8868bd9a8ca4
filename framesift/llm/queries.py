"""The training-data operators as queries over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm.collocations import mine_collocations
from framesift.llm.embedding_dedup import embedding_near_duplicates
from framesift.llm.exact_dedup import exact_duplicates
from framesift.llm.html_text import extract_text
from framesift.llm.language_id import identify_languages
from framesift.llm.lexical_search import rank_documents
from framesift.llm.mixing import mix, quality_domains
from framesift.llm.packing import pack
from framesift.llm.pii import replace_personal_data
from framesift.llm.simhash import simhash_near_duplicates
from framesift.llm.suffix_dedup import remove_repeats
from framesift.llm.topk_search import top_k_search
from framesift.llm.warc import archived_pages
from framesift.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archived_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


#: Target weights of the domains by tokens.
MIXTURE = {"high": 0.86, "low": 0.12, "toxic": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality_domains(table(spark, sf_dir, "labels"))
    return mix(table(spark, sf_dir, "documents"), labels, MIXTURE)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), key="key of the registered query")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


Query = Callable[[SparkSession, str], DataFrame]


def _shipped(build: Query) -> Query:
    """``build``, with this package sent to the Python workers first."""
    return wraps(build)(lambda spark, sf_dir: build(ship_package(spark), sf_dir))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_topk_search": op13_topk_search,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: _shipped(build) for name, build in QUERIES.items()}

ORACLE: dict[str, str] = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op1_exact_dedup": r"""
        WITH squeezed AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY body ORDER BY n_points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER (PARTITION BY body ORDER BY n_points DESC, doc_id) = 1 AS kept,
               sha256(body) AS text_sha256,
               n_points
        FROM squeezed""",
    "op2_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        latest AS (
            SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                   max(page_id) OVER (PARTITION BY body) AS last_id
            FROM payloads)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN last_id END AS refers_to
        FROM latest""",
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
              AND list_count(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(id, seen) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.id),
        components AS (SELECT id AS vec_id, min(seen) AS component_id FROM reach GROUP BY id),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM components LEFT JOIN counts USING (vec_id)""",
    "op11_lexical_search": r"""
        WITH doc_terms AS (
            SELECT doc_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
        sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
        whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, whole GROUP BY term),
        middles AS (SELECT doc_id, 100 - 90 + (90 * n * n_docs) // length AS m FROM sizes, whole),
        item_terms AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN middles USING (doc_id)
            GROUP BY item_id, doc_id),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                   doc_id, score
            FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT row_number() OVER () AS piece, lang, words
            FROM (
                SELECT lang, list_filter(string_split_regex(body, '[\x20\x09]+'), lambda w: w <> '') AS words
                FROM (
                    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]')) AS body
                    FROM documents))
            WHERE len(words) > 0),
        places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS spot FROM pieces),
        occurrences AS (
            SELECT lang, size, list_slice(words, spot, spot + size - 1) AS phrase
            FROM places, (VALUES (1), (2), (3), (4), (5)) sizes(size)
            WHERE spot + size - 1 <= len(words)),
        counts AS (SELECT lang, phrase, size, count(*) AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 100),
        totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
        candidates AS (SELECT lang, phrase, size, f AS a FROM counts WHERE size > 1),
        cuts AS (
            SELECT c.lang, c.phrase, c.size, c.a, k, h.f AS l, t.f AS r, n,
                   (1000 * CAST(c.a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(h.f AS HUGEINT) * CAST(t.f AS HUGEINT)) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
            JOIN counts h ON h.lang = c.lang AND h.phrase = list_slice(c.phrase, 1, k)
            JOIN counts t ON t.lang = c.lang AND t.phrase = list_slice(c.phrase, k + 1, c.size)
            JOIN totals ON totals.lang = c.lang),
        scored AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first_cut FROM cuts)
            WHERE first_cut = 1),
        shorter AS (
            SELECT lang, a, list_slice(phrase, spot, spot + inner_size - 1) AS phrase
            FROM (SELECT *, unnest(range(2, size)) AS inner_size FROM candidates) c, (VALUES (1), (2), (3), (4)) places(spot)
            WHERE spot + inner_size - 1 <= size),
        held AS (SELECT lang, phrase, max(a) AS longer FROM shorter GROUP BY lang, phrase),
        ranked AS (
            SELECT s.lang, row_number() OVER (
                       PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.phrase, ' ')) AS rank,
                   array_to_string(s.phrase, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
            FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
            WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op13_topk_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        scores AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.parts, v.parts) AS BIGINT) AS score
            FROM whole q JOIN whole v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scores)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
