"""The same results as plain SQL over the driver's tables."""

from __future__ import annotations

from framesift.plans.inputs import EXTENSIONS
from framesift.plans.queries import QUERY_TEXT, SAMPLE_TEXT, SHIFTED_FROM, THRESHOLD
from framesift.schemas import FOLDER_TERMS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(content: str) -> str:
    """128 hex digits the stand-in encoder makes 64 components of."""
    return f"sha256('0:' || {content}) || sha256('1:' || {content})"


def _bytes(digest: str) -> str:
    return f"[('0x' || substring({digest}, 2 * i + 1, 2))::INTEGER for i in range(64)]"


def _vector(digest: str) -> str:
    return f"[((b - 127.5) / 127.5)::FLOAT::DOUBLE for b in {_bytes(digest)}]"


def _components(digest: str) -> str:
    return f"array_to_string({_bytes(digest)}, ',')"


PATH = "'/data/' || source || '/' || doc_id || '.jpg'"
NESTED = (
    "'/data/' || source || '/data/' || lang || '/' || doc_id || CASE lang "
    + " ".join(f"WHEN '{lang}' THEN '{ext}'" for lang, ext in EXTENSIONS.items())
    + " ELSE '.txt' END"
)

IMAGES = f"""images AS (
  SELECT doc_id, {PATH} AS file_path, doc_id || '.jpg' AS file_name, source AS folder,
         octet_length(encode(text))::BIGINT AS size_bytes, text
  FROM documents)"""

EMBEDDED = f"""{IMAGES}, embedded AS (
  SELECT i.doc_id, i.file_path, i.file_name, i.folder, i.size_bytes, e.embedding::DOUBLE[] AS v
  FROM images i LEFT JOIN embeddings e ON i.doc_id = e.vec_id)"""


def _score(a: str, b: str, metric: str = "cosine") -> str:
    function = {"cosine": "list_cosine_similarity", "dot": "list_inner_product", "l2": "list_distance"}[metric]
    return f"round({function}({a}, {b}), 6)"


def _knn(k: int, metric: str = "cosine", where: str = "true", vector: str = "embedding::DOUBLE[]") -> str:
    order = "score" if metric == "l2" else "score DESC"
    return f"""
WITH vectors AS (SELECT vec_id, label, {vector} AS v FROM embeddings),
q AS (SELECT v FROM vectors WHERE vec_id = 0),
scored AS (
  SELECT vec_id, label, {_score('v', '(SELECT v FROM q)', metric)} AS score
  FROM vectors WHERE {where}),
ranked AS (SELECT *, row_number() OVER (ORDER BY {order}, vec_id)::INTEGER AS rank FROM scored)
SELECT vec_id, label, score, rank FROM ranked WHERE rank <= {k}"""


#: Vectors drawn to eight far corners.
CORNERED = "[(embedding[i + 1] + CASE WHEN i = vec_id % 8 THEN 2.0 ELSE 0.0 END)::FLOAT::DOUBLE for i in range(64)]"


def _knn_batch(where: str = "true", metric: str = "cosine") -> str:
    return f"""
WITH scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         {_score('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]', metric)} AS score
  FROM embeddings a, embeddings b WHERE {where}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {"" if metric == "l2" else "DESC"}, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10"""


def _text_search(columns: str, where: str = "true") -> str:
    return f"""
WITH hashed AS (SELECT *, {_digest('text')} AS h FROM documents WHERE {where}),
scored AS (
  SELECT {columns}, {_score(_vector('h'), _vector(_digest(_quoted(SAMPLE_TEXT))))} AS score FROM hashed),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored)
SELECT * FROM ranked WHERE rank <= 2"""


def _matches(terms: tuple[str, ...], column: str = "folder") -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{term.lower()}')" for term in terms) + ")"


def _image_search(terms: tuple[str, ...] = (), filter_first: bool = False) -> str:
    """CTEs ending in hits(file_path, file_name, folder, score, rank)."""
    before = _matches(terms) if terms and filter_first else "true"
    after = _matches(terms) if terms else "true"
    limit = 12 if terms else 50
    return f"""
WITH {EMBEDDED}, scored AS (
  SELECT file_path, file_name, folder,
         {_score('v', _vector(_digest(_quoted(QUERY_TEXT))))} AS score
  FROM embedded WHERE v IS NOT NULL AND {before}),
top AS (SELECT * FROM scored ORDER BY score DESC, file_path LIMIT 50),
hits AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, file_path)::INTEGER AS rank FROM top
  WHERE {after} QUALIFY rank <= {limit})"""


SNAPSHOTS = f"""
old AS (SELECT {PATH} AS file_path, text FROM documents),
new AS (
  SELECT {PATH} AS file_path,
         replace(regexp_replace(text, ' +\\n', chr(10), 'g'), chr(10) || chr(10), chr(10)) AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL
  SELECT '/data/benchmark/' || item_id || '.jpg', text FROM benchmark)"""

SYNCED = """
WITH v AS (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM embeddings),
twice AS (SELECT vec_id, sqrt(list_inner_product(d, d)) AS length FROM (
  SELECT vec_id, [(x * 2)::FLOAT::DOUBLE for x in embedding] AS d FROM embeddings))
SELECT v.vec_id, label,
       round(CASE WHEN v.vec_id % 5 = 0 AND v.vec_id % 35 <> 7 THEN twice.length ELSE v.length END, 5) AS norm
FROM v JOIN twice USING (vec_id)
WHERE (v.vec_id % 5 <> 1 AND (v.vec_id % 7 <> 0 OR v.vec_id % 5 = 0)) OR v.vec_id % 35 = 7"""

FILES = """
SELECT doc_id || '.jpg' AS file_name, source AS folder, octet_length(encode(text))::BIGINT AS length, sha256(text) AS digest FROM documents"""

MENTIONS = """
WITH hits AS (
  SELECT doc_id, 'NAME' AS entity, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS word FROM documents
  UNION ALL
  SELECT doc_id, 'NUMBER', unnest(regexp_extract_all(text, '[0-9]+')) FROM documents)
SELECT doc_id, entity, word, count(*) AS mentions, sum(length(word))::BIGINT AS mentioned_chars
FROM hits GROUP BY ALL"""

EXACT = """
grouped AS (
  SELECT doc_id AS key, min(doc_id) OVER (PARTITION BY sha256(text)) AS group_id,
         count(*) OVER (PARTITION BY sha256(text)) AS n, source AS folder,
         octet_length(encode(text))::BIGINT AS size_bytes
  FROM documents),
decided AS (
  SELECT key, group_id, folder, size_bytes,
         first_value(key) OVER (PARTITION BY group_id ORDER BY size_bytes DESC, key) AS keep_key
  FROM grouped WHERE n > 1)"""

PAIRS = f"""pairs AS (
  SELECT a.vec_id AS key_a, b.vec_id AS key_b,
         {_score('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE {_score('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} >= {THRESHOLD})"""

REACH = """links AS (
  SELECT key_a AS a, key_b AS b FROM pairs UNION SELECT key_b, key_a FROM pairs),
reach(key, seen) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.key),
groups AS (SELECT key, min(seen) AS group_id FROM reach GROUP BY key)"""

GROUPS = f"{PAIRS}, {REACH}"

SHIFTED = f"""v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL
  SELECT vec_id + {SHIFTED_FROM},
         [(embedding[i + 1]::DOUBLE + CASE WHEN (i + vec_id) % 2 = 0 THEN 0.005 ELSE -0.005 END)::FLOAT::DOUBLE for i in range(64)]
  FROM embeddings)"""

DECIDED = f"""{GROUPS}, decided AS (
  SELECT g.key, g.group_id, d.source AS folder, octet_length(encode(d.text))::BIGINT AS size_bytes,
         first_value(g.key) OVER (
           PARTITION BY g.group_id ORDER BY octet_length(encode(d.text)) DESC, g.key) AS keep_key
  FROM groups g JOIN documents d ON d.doc_id = g.key)"""

SAVINGS = """
SELECT folder, count(*) AS grouped_files,
       count(*) FILTER (key <> keep_key) AS dropped_files,
       coalesce(sum(size_bytes) FILTER (key <> keep_key), 0)::BIGINT AS saved_bytes
FROM decided GROUP BY folder"""


def _embedded_components(relation: str, keys: str, content: str = "text") -> str:
    return f"""
WITH hashed AS (SELECT *, {_digest(content)} AS h FROM {relation})
SELECT {keys}, 64::INTEGER AS dim, {_components('h')} AS components FROM hashed"""


ORACLE: dict[str, str] = {
    "scanned_files": f"{FILES} WHERE octet_length(encode(text)) > 0",
    "scanned_files_strict": FILES,
    "listed_files": "SELECT doc_id || '.jpg' AS file_name, source AS folder, octet_length(encode(text))::BIGINT AS size_bytes FROM documents",
    "hit_files": f"{FILES} WHERE octet_length(encode(text)) > 0 ORDER BY doc_id LIMIT 20",
    "image_sizes": """
SELECT doc_id || '.png' AS file_name, (1 + doc_id % 3)::INTEGER AS height, (1 + doc_id % 7)::INTEGER AS width,
       CASE WHEN doc_id % 2 = 1 THEN 3 ELSE 1 END AS channels, doc_id % 2 = 0 AS needs_rgb FROM documents""",
    "synced_files": f"""
WITH files AS (SELECT *, CASE WHEN doc_id % 5 = 1 THEN text || 'more' ELSE text END AS body FROM documents WHERE doc_id % 5 <> 0),
hashed AS (SELECT *, {_digest('body')} AS h FROM files WHERE octet_length(encode(body)) > 0)
SELECT doc_id || '.jpg' AS file_name, source AS folder, octet_length(encode(body))::BIGINT AS size_bytes, {_components('h')} AS components
FROM hashed""",
    "embed_reasons": """
WITH told AS (
  SELECT CASE lang WHEN 'de' THEN 'no input' WHEN 'es' THEN 'not base64'
              ELSE CASE WHEN octet_length(encode(text)) > 2000 THEN 'ValueError: more than 2000 bytes' ELSE '' END END AS error
  FROM documents)
SELECT error, count(*) AS rows, (SELECT count(*) FROM told WHERE error <> '') AS rejected, (SELECT count(*) FROM told) AS all_rows
FROM told GROUP BY error""",
    "embed_long_texts": f"""
WITH windows AS (
  SELECT doc_id, substring(text, (n * 77 + 1)::BIGINT, 77) AS piece
  FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 77.0)::BIGINT))) AS n FROM documents)),
hashed AS (SELECT doc_id, greatest(1, length(piece)) AS w, {_digest('piece')} AS h FROM windows),
summed AS (SELECT doc_id, w, list_sum({_vector('h')}) AS total FROM hashed)
SELECT doc_id, round(sum(w * total) / sum(w), 3) AS total FROM summed GROUP BY doc_id""",
    "empty_query_refused": "SELECT label, count(*) AS vectors, true AS refused FROM embeddings GROUP BY label",
    "image_records": f"""
WITH {IMAGES}
SELECT file_path, file_name, folder, size_bytes, (doc_id * 3600)::BIGINT AS created_epoch,
       base64(encode(text)) AS image_base64 FROM images""",
    "image_paths": f"""
WITH p AS (SELECT doc_id, {NESTED} AS path FROM documents),
f AS (
  SELECT doc_id, path, parse_filename(path) AS file_name,
         ltrim(replace(regexp_replace(path, '/+[^/]*$', ''), '/data', ''), '/') AS folder FROM p)
SELECT doc_id, file_name, folder,
       regexp_matches(lower(path), '\\.(jpg|jpeg)$') AS is_jpeg,
       regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|bmp)$') AS is_displayable,
       {_matches(('SRC1', '/fr'))} AS folder_matches FROM f""",
    "rejected_files": f"SELECT {PATH} AS file_path FROM documents WHERE lang = 'es'",
    "folder_stats": f"""
WITH {IMAGES}
SELECT folder, count(*) AS files, sum(size_bytes)::BIGINT AS total_bytes FROM images GROUP BY folder""",
    "base64_decode": """
SELECT doc_id, length(base64(encode(text)))::INTEGER AS encoded_chars,
       CASE WHEN lang <> 'es' THEN octet_length(from_base64(base64(encode(text)))) ELSE 0 END::INTEGER AS decoded_bytes,
       lang <> 'es' AS restored FROM documents""",
    "json_records": """
SELECT doc_id, to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars})::VARCHAR
       AS payload FROM documents""",
    "model_requests": """
SELECT doc_id, substring(text, 1, 77) AS request, length(text)::INTEGER AS text_chars FROM documents""",
    "embed_text": _embedded_components("documents", "doc_id"),
    "embed_turns": _embedded_components("conversations", "conv_id, turn, role"),
    "embed_images": f"""
WITH hashed AS (SELECT doc_id, lang, {_digest('text')} AS h FROM documents)
SELECT doc_id, lang IN ('es', 'de') AS failed,
       CASE WHEN lang NOT IN ('es', 'de') THEN {_components('h')} END AS components FROM hashed""",
    "embed_once_per_value": _embedded_components("documents", "doc_id"),
    "ai_query_text": _embedded_components("documents", "doc_id"),
    "ai_query_image": f"""
WITH {IMAGES}, hashed AS (SELECT *, {_digest('text')} AS h FROM images)
SELECT file_path, 64::INTEGER AS dim, {_components('h')} AS components FROM hashed""",
    "embed_pending": f"""
WITH hashed AS (
  SELECT doc_id, {_digest('text')} AS h FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))
SELECT doc_id, 64::INTEGER AS dim, {_components('h')} AS components FROM hashed""",
    "entities": MENTIONS,
    "entities_in_windows": MENTIONS,
    "entity_counts": """
SELECT conv_id, turn,
       (len(regexp_extract_all(text, '[A-Z][a-z]+')) + len(regexp_extract_all(text, '[0-9]+')))::INTEGER AS entities
FROM conversations""",
    "index_rows": f"""
WITH {EMBEDDED}
SELECT file_path, file_name, folder, len(v)::INTEGER AS dim, round(sqrt(list_inner_product(v, v)), 6) AS norm
FROM embedded WHERE v IS NOT NULL AND len(v) = 64""",
    "text_index_rows": f"""
WITH hashed AS (SELECT *, {_digest('text')} AS h FROM documents), vectors AS (
  SELECT doc_id, lang, {_vector('h')} AS v FROM hashed)
SELECT doc_id, lang, len(v)::INTEGER AS dim, round(sqrt(list_inner_product(v, v)), 5) AS norm FROM vectors""",
    "vector_profile": f"""
WITH {EMBEDDED}
SELECT count(*) AS total_rows, count(*) FILTER (v IS NULL) AS null_vectors,
       count(*) FILTER (len(v) <> 64) AS wrong_dimension, count(*) FILTER (len(v) = 64) AS searchable,
       count(*) FILTER (len(v) = 64 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS not_synced
FROM embedded""",
    "latest_row_per_key": """
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "knn_single": _knn(10),
    "knn_single_by_cell_index": _knn(10),
    "search_cells": _knn(10, vector=CORNERED),
    "search_cells_dot": _knn(10, "dot", vector=CORNERED),
    "search_cells_l2": _knn(10, "l2", vector=CORNERED),
    "search_cells_prefilter": _knn(10, where="label IN (3, 5)", vector=CORNERED),
    "knn_metric_dot": _knn(10, "dot"),
    "knn_metric_l2": _knn(10, "l2"),
    "knn_prefilter": _knn(10, where="label IN (3, 5)"),
    "knn_exclude": _knn(2, where="vec_id NOT IN (0, 137)"),
    "knn_exclude_sql": _knn(2, where="vec_id NOT IN (0, 137)"),
    "knn_batch": _knn_batch(),
    "knn_batch_by_cells": _knn_batch(),
    "knn_batch_dot": _knn_batch(metric="dot"),
    "knn_batch_dot_by_cells": _knn_batch(metric="dot"),
    "knn_batch_l2": _knn_batch(metric="l2"),
    "knn_batch_l2_by_cells": _knn_batch(metric="l2"),
    "knn_batch_others": _knn_batch("a.vec_id <> b.vec_id"),
    "search_text": _text_search("doc_id, text, lang, source, n_chars"),
    "search_text_excluding": _text_search("doc_id, lang", "source NOT IN ('src7', 'src13')"),
    "search_postfilter": _image_search(("SRC1", "src3")) + " SELECT * FROM hits",
    "search_prefilter": _image_search(("SRC1", "src3"), True) + " SELECT * FROM hits",
    "search_unfiltered": _image_search() + " SELECT * FROM hits",
    "search_like": f"""
WITH {EMBEDDED}, q AS (SELECT v FROM embedded WHERE file_path = '/data/src7/7.jpg'),
scored AS (
  SELECT file_path, folder, {_score('v', '(SELECT v FROM q)')} AS score FROM embedded
  WHERE v IS NOT NULL AND file_path <> '/data/src7/7.jpg'),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path)::INTEGER AS rank FROM scored)
SELECT * FROM ranked WHERE rank <= 10""",
    "hits_with_content": _image_search(("src1",))
    + """
SELECT h.file_path, h.rank, i.size_bytes, base64(encode(i.text)) AS image_base64
FROM hits h JOIN images i USING (file_path)""",
    "result_rows": _image_search(("src1",)) + ' SELECT rank AS "Rank", file_path, file_name, folder FROM hits',
    "result_documents": _image_search(("src1",))
    + " SELECT rank, file_path AS page_content, file_name, folder, 2::INTEGER AS metadata_fields FROM hits",
    "shortened_texts": """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS shown
FROM documents""",
    "displayable_hits": f"""
WITH rows AS (
  SELECT {NESTED} AS file_path, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id),
scored AS (
  SELECT file_path, {_score('v', _vector(_digest(_quoted(QUERY_TEXT))))} AS score FROM rows),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path)::INTEGER AS rank FROM scored)
SELECT * FROM ranked WHERE rank <= 50 AND regexp_matches(lower(file_path), '\\.(jpg|jpeg|png|gif|bmp)$')""",
    "smoke_check": f"""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (
  SELECT vec_id, {_score('embedding::DOUBLE[]', '(SELECT v FROM q)')} AS score FROM embeddings),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT vec_id, score, rank, vec_id = (SELECT vec_id FROM q) AS is_self FROM ranked WHERE rank <= 3""",
    "change_feed": f"""
WITH {SNAPSHOTS}
SELECT file_path, CASE WHEN old.text IS NULL THEN 'insert' WHEN new.text IS NULL THEN 'delete' ELSE 'update' END AS change
FROM old FULL OUTER JOIN new USING (file_path) WHERE old.text IS DISTINCT FROM new.text""",
    "logged_changes": f"""
WITH {SNAPSHOTS}
SELECT file_path, CASE WHEN old.text IS NULL THEN 'insert' WHEN new.text IS NULL THEN 'delete' ELSE 'update' END AS change,
       0 AS changed_by_last
FROM old FULL OUTER JOIN new USING (file_path) WHERE old.text IS DISTINCT FROM new.text""",
    "logged_index": f"WITH {SNAPSHOTS} SELECT file_path, text FROM new",
    "synced_snapshot": f"WITH {SNAPSHOTS} SELECT file_path, text FROM new",
    "sync_available_now": """
SELECT vec_id, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm
FROM embeddings""",
    "sync_updates": SYNCED,
    "sync_compacted": SYNCED,
    "table_overwritten": "SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 1000",
    "table_created_once": """
SELECT source, count(*) AS files, true AS refused, 'true' AS change_feed,
       (SELECT count(*) FROM documents)::INTEGER AS table_rows FROM documents GROUP BY source""",
    "table_replaced": "SELECT doc_id, source, n_chars * 2 AS n_chars FROM documents WHERE n_chars > 1000",
    "index_table": """
SELECT label, count(*) AS vectors, 1::INTEGER AS created, true AS ready, false AS still_there
FROM embeddings GROUP BY label""",
    "preview_through_pandas": "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 10",
    "embedded_preview": f"""
WITH hashed AS (SELECT *, {_digest('text')} AS h FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10))
SELECT doc_id, lang, source, {_components('h')} AS components FROM hashed""",
    "embed_images_strictly": f"""
WITH {IMAGES}, hashed AS (SELECT *, {_digest('text')} AS h FROM images)
SELECT file_path, 64::INTEGER AS dim, {_components('h')} AS components FROM hashed""",
    "retried_embeddings": f"""
WITH hashed AS (
  SELECT doc_id, {_digest('text')} AS h FROM documents
  WHERE doc_id % 4 = 0 OR doc_id NOT IN (SELECT vec_id FROM embeddings))
SELECT doc_id, 64::INTEGER AS dim, {_components('h')} AS components FROM hashed""",
    "kmeans_planted": """
SELECT vec_id % 8 AS corner, count(*) AS vectors, 1::BIGINT AS clusters, 1::INTEGER AS corners_per_cluster
FROM embeddings GROUP BY 1""",
    "exact_duplicates": f"""
SELECT sha256(text) AS digest, count(*) AS copies, min('file:' || {PATH}) AS first_key,
       (sum(octet_length(encode(text))) - max(octet_length(encode(text))))::BIGINT AS redundant_bytes
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "exact_duplicate_members": f"""
SELECT 'file:' || {PATH} AS key, min('file:' || {PATH}) OVER (PARTITION BY sha256(text)) AS group_id
FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1""",
    "keep_one_exact": f"WITH {EXACT} SELECT key, group_id, keep_key, key = keep_key AS kept FROM decided",
    "savings_exact": f"WITH {EXACT} {SAVINGS}",
    "cleaned_images": f"""
WITH {EXACT}
SELECT doc_id, source, n_chars FROM documents
WHERE doc_id NOT IN (SELECT key FROM decided WHERE key <> keep_key)""",
    "near_duplicates": f"WITH {PAIRS} SELECT key_a, key_b, score FROM pairs",
    "near_duplicates_by_cells": f"WITH {PAIRS} SELECT key_a, key_b, score FROM pairs",
    "near_duplicates_lsh": f"""
WITH {SHIFTED}
SELECT a.vec_id AS key_a, b.vec_id AS key_b, {_score('a.e', 'b.e')} AS score
FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE {_score('a.e', 'b.e')} >= 0.95""",
    "duplicate_groups_lsh": f"""
WITH RECURSIVE {SHIFTED},
w AS (SELECT * FROM v UNION ALL SELECT vec_id + {2 * SHIFTED_FROM}, e FROM v WHERE vec_id % 3 = 0),
pairs AS (
  SELECT a.vec_id AS key_a, b.vec_id AS key_b
  FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE {_score('a.e', 'b.e')} >= 0.95),
{REACH} SELECT key, group_id FROM groups""",
    "near_duplicates_by_finer_cells": f"WITH {PAIRS} SELECT key_a, key_b, score FROM pairs",
    "duplicate_groups_by_finer_cells": f"WITH RECURSIVE {GROUPS} SELECT key, group_id FROM groups",
    "duplicate_groups_by_cells": f"WITH RECURSIVE {GROUPS} SELECT key, group_id FROM groups",
    "duplicate_groups": f"WITH RECURSIVE {GROUPS} SELECT key, group_id FROM groups",
    "embedded_duplicate_groups": """
SELECT doc_id AS key, min(doc_id) OVER (PARTITION BY text) AS group_id FROM documents
QUALIFY count(*) OVER (PARTITION BY text) > 1""",
    "keep_one": f"WITH RECURSIVE {DECIDED} SELECT key, group_id, keep_key, key = keep_key AS kept FROM decided",
    "savings": f"WITH RECURSIVE {DECIDED} {SAVINGS}",
    "zero_shot_label": f"""
WITH terms AS (SELECT unnest([{', '.join(_quoted(t) for t in FOLDER_TERMS)}]) AS label),
labelled AS (SELECT label, {_vector(_digest('label'))} AS lv FROM terms),
scored AS (
  SELECT vec_id, l.label, {_score('embedding::DOUBLE[]', 'lv')} AS score FROM embeddings, labelled l)
SELECT vec_id, label, score FROM scored
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""",
}
