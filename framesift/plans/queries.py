"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import encoding, paths
from framesift.functions.encoders import register_ai_query, text_encoder
from framesift.operators import cell_index, change_log, changes, duplicates, embed, index, ingest, labels, lsh, search
from framesift.operators import near_duplicates as near
from framesift.operators.knn import knn_join
from framesift.plans import inputs as I
from framesift.schemas import FOLDER_TERMS
from framesift.sources import image_files, tables
from framesift.session import cut_lineage, drop_shared_path, new_shared_path, ship_package
from framesift.streaming.files import sync_files
from framesift.streaming.sync import arriving_rows, compact_index, read_index, sync_index, vacuum_index

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

THRESHOLD = 0.4
SHIFTED_FROM = 10_000_000
QUERY_TEXT = "farmer's wheat field at dusk"
SAMPLE_TEXT = "Greek myths"


def query(build: Query) -> Query:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(ship_package(spark), sf_dir)

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return run


# --- files ------------------------------------------------------------------


@contextmanager
def _written_files(spark, sf, *kind):
    root = I.written_files(spark, sf, *kind)
    try:
        yield root
    finally:
        drop_shared_path(spark, f"file:{root}")


def _file_facts(files, root):
    """Folder, name, length and digest of scanned files, read before the files are deleted."""
    content = F.sha2(F.col("content"), 256).alias("digest")
    folder = paths.folder_below(F.col("path"), root).alias("folder")
    return cut_lineage(files.select(paths.base_name(F.col("path")).alias("file_name"), folder, "length", content))


@query
def scanned_files(spark, sf):
    with _written_files(spark, sf) as root:
        return _file_facts(image_files.scan_files(spark, root), root)


@query
def scanned_files_strict(spark, sf):
    """By the POSIX source: read and stat in tasks; every file was changed since it was made."""
    with _written_files(spark, sf) as root:
        return _file_facts(image_files.scan_files_strict(spark, root).filter("changeTime >= modificationTime"), root)


@query
def listed_files(spark, sf):
    """Records of the files without a look at their contents."""
    with _written_files(spark, sf) as root:
        records = ingest.image_records(image_files.scan_files_strict(spark, root, with_content=False), root)
        return cut_lineage(records.select("file_name", "folder", "size_bytes"))


@query
def hit_files(spark, sf):
    """The files of a result list."""
    with _written_files(spark, sf) as root:
        lowest = I.table(spark, sf, "documents").filter("octet_length(text) > 0").orderBy("doc_id").limit(20)
        path = F.concat(F.lit(f"{root}/"), "source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("file_path")
        return _file_facts(image_files.read_hit_files(lowest.select(path)), root)


@query
def image_sizes(spark, sf):
    with _written_files(spark, sf, ".png", lambda number, text: I.png(number)) as root:
        found = image_files.image_profile(spark, root)
        return cut_lineage(found.withColumn("file_name", paths.base_name(F.col("file_path"))).drop("file_path"))


@query
def synced_files(spark, sf):
    """An index of image files: some change, some go and some come between two runs of the sync."""
    with _written_files(spark, sf) as root:
        index_path, progress = new_shared_path(spark, "index"), new_shared_path(spark, "progress")

        def embedded(records):
            return embed.embed_images(records, I.encoder, "image_base64").drop("image_base64")

        def later(batches):
            for batch in batches:
                for number, source in zip(batch["doc_id"].to_pylist(), batch["source"].to_pylist()):
                    path = os.path.join(root, source, f"{number}.jpg")
                    if number % 5 == 0:
                        os.remove(path)
                    elif number % 5 == 1:
                        with open(path, "ab") as file:
                            file.write(b"more")
                yield batch

        sync_files(spark, root, index_path, progress, embedded, I.DIMENSION)
        documents = I.table(spark, sf, "documents").select("doc_id", "source")
        documents.mapInArrow(later, documents.schema).count()
        found = sync_files(spark, root, index_path, progress, embedded, I.DIMENSION)
        result = cut_lineage(found.select("file_name", "folder", "size_bytes", I.components(F.col("embeddings")).alias("components")))
        for path in (index_path, progress):
            drop_shared_path(spark, path)
        return result


# --- files to records -------------------------------------------------------


@query
def image_records(spark, sf):
    created = F.unix_seconds("created_at").alias("created_epoch")
    return I.images(spark, sf).select("file_path", "file_name", "folder", "size_bytes", created, "image_base64")


@query
def image_paths(spark, sf):
    path = I.nested_path()
    folder = paths.folder_below(path, I.ROOT)
    return I.table(spark, sf, "documents").select(
        "doc_id",
        paths.base_name(path).alias("file_name"),
        folder.alias("folder"),
        paths.has_extension(path, ("jpg", "jpeg")).alias("is_jpeg"),
        paths.has_extension(path, ("jpg", "jpeg", "png", "gif", "bmp")).alias("is_displayable"),
        paths.matches_any_term(folder, ("SRC1", "/fr")).alias("folder_matches"),
    )


@query
def rejected_files(spark, sf):
    readable = I.table(spark, sf, "documents").select(
        F.concat(F.lit("file:/data/"), "source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("path"),
        F.when(F.col("lang") != "es", F.octet_length("text")).alias("length"),
    )
    return ingest.rejected_files(readable)


@query
def folder_stats(spark, sf):
    return ingest.folder_stats(I.images(spark, sf))


@query
def base64_decode(spark, sf):
    encoded = encoding.to_base64(F.col("text").cast("binary"))
    broken = F.when(F.col("lang") == "es", F.concat(F.lit("%"), encoded)).otherwise(encoded)
    decoded = encoding.from_base64(broken)
    return I.table(spark, sf, "documents").select(
        "doc_id",
        F.length(encoded).alias("encoded_chars"),
        F.coalesce(F.octet_length(decoded), F.lit(0)).alias("decoded_bytes"),
        F.coalesce(decoded.cast("string") == F.col("text"), F.lit(False)).alias("restored"),
    )


@query
def json_records(spark, sf):
    documents = I.table(spark, sf, "documents")
    return documents.select("doc_id", encoding.json_record(documents.columns).alias("payload"))


@query
def model_requests(spark, sf):
    """The short request of the text model beside the length of the whole text."""
    return I.table(spark, sf, "documents").select(
        "doc_id", encoding.model_text(F.col("text")).alias("request"), F.length("text").alias("text_chars")
    )


# --- inference --------------------------------------------------------------


def _components(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, F.size("embeddings").alias("dim"), I.components(F.col("embeddings")).alias("components")
    )


@query
def embed_text(spark, sf):
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    return _components(embed.embed_texts(documents, I.encoder, "text"), "doc_id")


@query
def embed_turns(spark, sf):
    turns = I.table(spark, sf, "conversations")
    return _components(embed.embed_texts(turns, I.encoder, "text"), "conv_id", "turn", "role")


@query
def embed_images(spark, sf):
    """NULL and broken images among good ones: their vectors are NULL, the rest is unaffected."""
    encoded = encoding.to_base64(F.col("text").cast("binary"))
    broken = F.when(F.col("lang") == "es", F.concat(F.lit("%"), encoded)).when(F.col("lang") != "de", encoded)
    images = I.table(spark, sf, "documents").select("doc_id", broken.alias("image_base64"))
    embedded = embed.embed_images(images, I.encoder, "image_base64")
    return embedded.select(
        "doc_id",
        F.col("embeddings").isNull().alias("failed"),
        I.components(F.col("embeddings")).alias("components"),
    )


@query
def embed_reasons(spark, sf):
    """NULL, broken and over-long images among good ones: how many of each there are, and the good ones' vectors by their count."""
    encoded = encoding.to_base64(F.col("text").cast("binary"))
    broken = F.when(F.col("lang") == "es", F.concat(F.lit("%"), encoded)).when(F.col("lang") != "de", encoded)
    images = I.table(spark, sf, "documents").select("doc_id", broken.alias("image_base64"))
    good, rejected, counts = embed.embed_reporting(images, I.picky_encoder, "image_base64", "image", dim=I.DIMENSION)
    rows = good.select(F.lit("").alias("error")).unionByName(rejected.select("error"))
    told = rows.groupBy("error").agg(F.count("*").alias("rows"))
    return told.withColumn("rejected", F.lit(counts["rejected"])).withColumn("all_rows", F.lit(counts["rows"]))


@query
def embed_long_texts(spark, sf):
    """Whole texts in windows of 77 characters: a text of one window has the model's vector, a longer one the mean."""
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    embedded = embed.embed_long_texts(documents, I.encoder, "text")
    total = F.aggregate("embeddings", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return embedded.select("doc_id", F.round(total, 3).alias("total"))


@query
def entities_in_windows(spark, sf):
    """`entities`, by a tagger that takes 512 characters at a time."""
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    tagged = embed.tag_entities(documents, I.tagger, window_chars=512, overlap_chars=256)
    return _mentions(tagged)


@query
def embed_once_per_value(spark, sf):
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    encode = text_encoder(I.encoder, "fail")
    return _components(embed.apply_once_per_value(documents, "text", "embeddings", encode), "doc_id")


@query
def ai_query_text(spark, sf):
    register_ai_query(spark, {"text-embedding": ("text", I.encoder), "image-embedding": ("image", I.encoder)})
    return _components(
        spark.sql(
            "SELECT doc_id, ai_query('text-embedding', request => text) AS embeddings FROM {documents}",
            documents=I.table(spark, sf, "documents"),
        ),
        "doc_id",
    )


@query
def ai_query_image(spark, sf):
    register_ai_query(spark, {"text-embedding": ("text", I.encoder), "image-embedding": ("image", I.encoder)})
    return _components(
        spark.sql(
            "SELECT file_path, ai_query('image-embedding', request => image_base64) AS embeddings FROM {images}",
            images=I.images(spark, sf),
        ),
        "file_path",
    )


@query
def embed_pending(spark, sf):
    """Only documents that have no vector yet are encoded."""
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    done = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    pending = embed.not_yet_embedded(documents, done, "doc_id")
    return _components(embed.embed_texts(pending, I.encoder, "text"), "doc_id")


@query
def entities(spark, sf):
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    return _mentions(embed.tag_entities(documents, I.tagger))


def _mentions(tagged):
    found = tagged.select("doc_id", F.explode("ner").alias("hit"))
    return found.groupBy("doc_id", "hit.entity", "hit.word").agg(
        F.count("*").alias("mentions"),
        F.sum((F.col("hit.end") - F.col("hit.start")).cast("long")).alias("mentioned_chars"),
    )


@query
def entity_counts(spark, sf):
    """Entities of conversation turns, each distinct text tagged once."""
    turns = I.table(spark, sf, "conversations")
    tagged = embed.tag_entities(turns, I.tagger, once_per_value=True)
    return tagged.select("conv_id", "turn", F.size("ner").alias("entities"))


# --- index ------------------------------------------------------------------


@query
def index_rows(spark, sf):
    rows = index.index_rows(I.image_embeddings(spark, sf), "file_path", "embeddings", I.DIMENSION)
    return rows.select(
        "file_path", "file_name", "folder", F.size("embeddings").alias("dim"), F.round("norm", 6).alias("norm")
    )


@query
def text_index_rows(spark, sf):
    documents = I.table(spark, sf, "documents").select("doc_id", "lang", "text")
    rows = index.text_index_rows(documents, "doc_id", "text", I.encoder, I.DIMENSION)
    return rows.select("doc_id", "lang", F.size("embeddings").alias("dim"), F.round("norm", 5).alias("norm"))


@query
def vector_profile(spark, sf):
    indexed = I.table(spark, sf, "labels").select("doc_id")
    return index.profile(I.image_embeddings(spark, sf), "doc_id", "embeddings", I.DIMENSION, indexed)


@query
def latest_row_per_key(spark, sf):
    return index.one_row_per_key(I.table(spark, sf, "conversations"), "conv_id", "turn")


# --- search -----------------------------------------------------------------


def _vectors(spark, sf):
    return I.table(spark, sf, "embeddings")


def _search_first(spark, sf, k=10, **options):
    vectors = _vectors(spark, sf)
    target = search.stored_vector(vectors, "vec_id", 0, "embedding")
    return search.search(vectors, target, k, "vec_id", "embedding", ["vec_id", "label"], **options)


@query
def knn_single(spark, sf):
    return _search_first(spark, sf)


@query
def knn_metric_dot(spark, sf):
    return _search_first(spark, sf, metric="dot")


@query
def knn_metric_l2(spark, sf):
    return _search_first(spark, sf, metric="l2")


@query
def knn_prefilter(spark, sf):
    return _search_first(spark, sf, filters={"label": (3, 5)})


@query
def knn_exclude(spark, sf):
    return _search_first(spark, sf, k=2, filters={"vec_id NOT": (0, 137)})


@query
def knn_exclude_sql(spark, sf):
    return _search_first(spark, sf, k=2, filters="vec_id NOT IN (0, 137)")


#: Rows per block so small that these tables make many cells, as large ones do of ordinary blocks.
SMALL_BLOCKS = 32

CELLS = {"max_broadcast_bytes": 8 * I.DIMENSION * 64, "block_rows": SMALL_BLOCKS}


def _batch(spark, sf, **options):
    vectors = I.keyed_vectors(spark, sf)
    joined = knn_join(vectors, vectors, 10, dim=I.DIMENSION, **options)
    return joined.select(F.col("query_key").alias("query_id"), F.col("key").alias("vec_id"), "score", "rank")


@query
def knn_batch(spark, sf):
    return _batch(spark, sf)


@query
def knn_batch_by_cells(spark, sf):
    """`knn_batch` as it runs once the queries outgrow the broadcast budget."""
    return _batch(spark, sf, **CELLS)


@query
def knn_batch_dot(spark, sf):
    return _batch(spark, sf, metric="dot")


@query
def knn_batch_dot_by_cells(spark, sf):
    return _batch(spark, sf, metric="dot", **CELLS)


@query
def knn_batch_l2(spark, sf):
    return _batch(spark, sf, metric="l2")


@query
def knn_batch_l2_by_cells(spark, sf):
    return _batch(spark, sf, metric="l2", **CELLS)


@query
def knn_batch_others(spark, sf):
    """Image to image for every row: its neighbours without itself."""
    return _batch(spark, sf, exclude_self=True)


def _search_cells(spark, sf, vectors, **options):
    """The first vector's neighbours, from an index stored in cells: from those that can matter."""
    path = new_shared_path(spark, "cells")
    cell_index.write_cell_index(vectors, path, "vec_id", "embedding", cells=16)
    stored = cell_index.read_cell_index(spark, path)
    query = search.stored_vector(vectors, "vec_id", 0, "embedding")
    return cell_index.search_cells(stored, query, 10, "vec_id", "embedding", ["vec_id", "label"], **options)


def _cornered(spark, sf):
    """Vectors drawn to eight far corners."""
    corner = F.pmod("vec_id", F.lit(8))
    drawn = F.transform("embedding", lambda x, i: (x + F.when(i == corner, 2.0).otherwise(0.0)).cast("float"))
    return _vectors(spark, sf).withColumn("embedding", drawn)


@query
def knn_single_by_cell_index(spark, sf):
    return _search_cells(spark, sf, _vectors(spark, sf))


@query
def search_cells(spark, sf):
    return _search_cells(spark, sf, _cornered(spark, sf))


@query
def search_cells_dot(spark, sf):
    return _search_cells(spark, sf, _cornered(spark, sf), metric="dot")


@query
def search_cells_l2(spark, sf):
    return _search_cells(spark, sf, _cornered(spark, sf), metric="l2")


@query
def search_cells_prefilter(spark, sf):
    return _search_cells(spark, sf, _cornered(spark, sf), filters={"label": [3, 5]})


def _text_index(spark, sf):
    """Documents with their vectors, built once and stored: what text searches read."""
    path = new_shared_path(spark, "text-index")
    rows = index.text_index_rows(I.table(spark, sf, "documents"), "doc_id", "text", I.encoder, I.DIMENSION)
    rows.write.parquet(path)
    return spark.read.parquet(path)


@query
def search_text(spark, sf):
    return search.search_text(
        _text_index(spark, sf), I.encoder, SAMPLE_TEXT, 2, "doc_id", columns=["doc_id", "text", "lang", "source", "n_chars"]
    )


@query
def empty_query_refused(spark, sf):
    """An empty search text is refused before anything is planned; by label, what was left unsearched."""
    vectors = _vectors(spark, sf)
    try:
        search.search_text(vectors, I.encoder, "", 3, "vec_id", vector="embedding")
        refused = False
    except ValueError:
        refused = True
    return vectors.groupBy("label").agg(F.count("*").alias("vectors")).withColumn("refused", F.lit(refused))


@query
def search_text_excluding(spark, sf):
    return search.search_text(
        _text_index(spark, sf),
        I.encoder,
        SAMPLE_TEXT,
        2,
        "doc_id",
        columns=["doc_id", "lang"],
        filters={"source NOT": ("src7", "src13")},
    )


@query
def search_postfilter(spark, sf):
    return search.search_images(I.image_embeddings(spark, sf), I.encoder, QUERY_TEXT, ["SRC1", "src3"])


@query
def search_prefilter(spark, sf):
    return search.search_images(
        I.image_embeddings(spark, sf), I.encoder, QUERY_TEXT, ["SRC1", "src3"], filter_first=True
    )


@query
def search_unfiltered(spark, sf):
    return search.search_images(I.image_embeddings(spark, sf), I.encoder, QUERY_TEXT)


@query
def search_like(spark, sf):
    images = I.image_embeddings(spark, sf)
    return search.search_like(images, "/data/src7/7.jpg", 10, "file_path", columns=["file_path", "folder"])


def _hits(spark, sf):
    return search.search_images(I.image_embeddings(spark, sf), I.encoder, QUERY_TEXT, ["src1"])


@query
def hits_with_content(spark, sf):
    hits = _hits(spark, sf).select("file_path", "rank")
    return search.with_content(hits, I.images(spark, sf), ["size_bytes", "image_base64"])


@query
def result_rows(spark, sf):
    return search.as_text_rows(_hits(spark, sf))


@query
def result_documents(spark, sf):
    documents = search.as_documents(_hits(spark, sf), ["file_path", "file_name", "folder"])
    return documents.select(
        "rank",
        F.col("document.page_content").alias("page_content"),
        F.col("document.metadata")["file_name"].alias("file_name"),
        F.col("document.metadata")["folder"].alias("folder"),
        F.size("document.metadata").alias("metadata_fields"),
    )


@query
def shortened_texts(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", encoding.shorten(F.col("text")).alias("shown"))


@query
def displayable_hits(spark, sf):
    """Ranks of the hits that can be shown; the others leave gaps."""
    documents = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), I.nested_path().alias("file_path")
    )
    rows = documents.join(_vectors(spark, sf), "vec_id")
    target = search.encode_query(rows, I.encoder, QUERY_TEXT)
    hits = search.search(rows, target, 50, "file_path", "embedding", ["file_path"])
    return search.displayable(hits).select("file_path", "score", "rank")


@query
def smoke_check(spark, sf):
    return search.smoke_check(_vectors(spark, sf), "vec_id", "embedding")


# --- sync -------------------------------------------------------------------


def _snapshots(spark, sf):
    """Documents before and after a clean-up: toxic ones gone, blanks trimmed, benchmark items added."""
    documents = I.table(spark, sf, "documents")
    old = documents.select(I.document_path().alias("file_path"), "text")
    toxic = I.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    kept = documents.join(toxic, "doc_id", "left_anti").select(
        I.document_path().alias("file_path"), F.regexp_replace("text", " +\n", "\n").alias("text")
    )
    kept = kept.withColumn("text", F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n")))
    added = I.table(spark, sf, "benchmark").select(
        F.concat(F.lit("/data/benchmark/"), "item_id", F.lit(".jpg")).alias("file_path"), "text"
    )
    return old, kept.unionByName(added)


@query
def change_feed(spark, sf):
    old, new = _snapshots(spark, sf)
    return changes.snapshot_changes(old, new, "file_path", ["text"])


@query
def synced_snapshot(spark, sf):
    """The old snapshot with the change feed applied."""
    old, new = _snapshots(spark, sf)
    feed = cut_lineage(changes.snapshot_changes(old, new, "file_path", ["text"]))  # used twice
    return changes.apply_changes(old, changes.rows_to_write(new, feed, "file_path"), feed, "file_path")


@query
def logged_changes(spark, sf):
    """A table written three times, the last time unchanged: its log since the first write."""
    old, new = _snapshots(spark, sf)
    with _table_name(spark) as name:
        for snapshot in (old, new, new):
            version = change_log.write_logged(snapshot, name, "file_path")
        unchanged = change_log.changes_since(spark, name, "file_path", version - 1).count()
        found = change_log.changes_since(spark, name, "file_path", 1)
        result = cut_lineage(found.withColumn("changed_by_last", F.lit(unchanged)))
        change_log.drop_logged(spark, name)
    return result


@query
def logged_index(spark, sf):
    """An index of a logged table brought up to date from the rows its log names."""
    old, new = _snapshots(spark, sf)
    with _table_name(spark) as name:
        before = change_log.write_logged(old, name, "file_path")
        held = cut_lineage(spark.table(name))  # the index as of that version
        change_log.write_logged(new, name, "file_path")
        feed = cut_lineage(change_log.changes_since(spark, name, "file_path", before))
        fresh = change_log.rows_since(spark, name, "file_path", before)
        result = cut_lineage(changes.apply_changes(held, fresh, feed, "file_path"))
        change_log.drop_logged(spark, name)
    return result


@query
def sync_available_now(spark, sf):
    arriving = arriving_rows(spark, f"{sf}/embeddings.parquet", _vectors(spark, sf).schema)
    return _synced(spark, [lambda: arriving])


def _synced(spark, runs, compacted=False, **options):
    """The index after one sync per stream of ``runs``; its folders are deleted."""
    index_path, progress = new_shared_path(spark, "index"), new_shared_path(spark, "progress")
    for arriving in runs:
        synced = sync_index(arriving(), index_path, progress, "vec_id", "embedding", I.DIMENSION, **options)
        if compacted:
            compact_index(spark, index_path, "vec_id", "embedding")
            vacuum_index(spark, index_path)
            synced = read_index(spark, index_path, "vec_id", "embedding")
    result = cut_lineage(synced.select("vec_id", "label", F.round("norm", 5).alias("norm")))
    drop_shared_path(spark, index_path)
    drop_shared_path(spark, progress)
    return result


def _updates(spark, sf, **options):
    vectors = _vectors(spark, sf)
    inbox = new_shared_path(spark, "inbox")

    def arrives(rows):
        def run():
            rows.write.mode("append").parquet(inbox)
            return arriving_rows(spark, inbox, rows.schema)

        return run

    kept = vectors.withColumn("gone", F.lit(False))
    doubled = vectors.withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    later = doubled.filter("vec_id % 5 IN (0, 1)").withColumn("gone", F.col("vec_id") % 5 == 1)
    runs = [arrives(kept.filter("vec_id % 7 != 0")), arrives(later), arrives(kept.filter("vec_id % 35 = 7"))]
    result = _synced(spark, runs, deleted="gone", **options)
    drop_shared_path(spark, inbox)
    return result


@query
def sync_updates(spark, sf):
    """Rows arrive, then some of them again with other vectors, some to be deleted and some new."""
    return _updates(spark, sf)


@query
def sync_compacted(spark, sf):
    """The same rows, the log compacted and what it replaced deleted after every run."""
    return _updates(spark, sf, compacted=True)


# --- tables -----------------------------------------------------------------


@contextmanager
def _table_name(spark):
    """A table name of its own for one query, dropped afterwards."""
    name = f"framesift_query_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        tables.drop_table(spark, name)


def _narrow(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", "source", "n_chars")


@query
def table_overwritten(spark, sf):
    """Saved twice; the second rows are the table."""
    rows = _narrow(spark, sf)
    with _table_name(spark) as name:
        tables.save_table(rows, name)
        tables.save_table(rows.filter("n_chars > 1000"), name)
        return cut_lineage(tables.read_table(spark, name))


@query
def table_created_once(spark, sf):
    """Created, refused a second time, given a property; by source, what the table holds then."""
    rows = _narrow(spark, sf)
    with _table_name(spark) as name:
        made = tables.create_table(rows, name)
        try:
            tables.create_table(rows, name)
            refused = False
        except AnalysisException:
            refused = True
        tables.set_properties(spark, name, tables.CHANGE_FEED)
        shown = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {tables.quoted(name)}").collect()}
        count = tables.row_count(made)
        return cut_lineage(
            made.groupBy("source").agg(
                F.count("*").alias("files"),
                F.lit(refused).alias("refused"),
                F.lit(shown.get("delta.enableChangeDataFeed")).alias("change_feed"),
                F.lit(count).alias("table_rows"),
            )
        )


@query
def table_replaced(spark, sf):
    """Replaced by rows made from itself."""
    with _table_name(spark) as name:
        old = tables.create_table(_narrow(spark, sf), name)
        longer = old.filter("n_chars > 1000").withColumn("n_chars", F.col("n_chars") * 2)
        return cut_lineage(tables.replace_table(longer, name))


@query
def index_table(spark, sf):
    """An index got or created twice, asked whether it is ready, and deleted; by label, what it held."""
    vectors = _vectors(spark, sf)
    doubled = vectors.unionAll(vectors.filter("vec_id % 3 = 0"))  # repeated keys get one row
    made = []
    with _table_name(spark) as source, _table_name(spark) as name:
        tables.save_table(doubled, source)

        def create():
            made.append(name)
            return index.create_index(spark, source, name, "vec_id", "embedding", I.DIMENSION)

        index.get_or_create_index(spark, name, create)
        held = index.get_or_create_index(spark, name, create).groupBy("label").agg(F.count("*").alias("vectors"))
        ready = index.is_ready(spark, name)
        held = cut_lineage(held.withColumns({"created": F.lit(len(made)), "ready": F.lit(ready)}))
        index.delete_index(spark, name)
        return held.withColumn("still_there", F.lit(spark.catalog.tableExists(name)))


@query
def preview_through_pandas(spark, sf):
    """The first documents as a small local table, and back."""
    shown = tables.preview(_narrow(spark, sf).orderBy("doc_id"))
    shown.createOrReplaceTempView("framesift_preview")
    local = tables.query_to_pandas(spark, "SELECT * FROM framesift_preview WHERE n_chars > :least", {"least": 0})
    spark.catalog.dropTempView("framesift_preview")
    return tables.rows_to_frame(spark, local, shown.schema)


@query
def embedded_preview(spark, sf):
    documents = I.table(spark, sf, "documents").select("doc_id", "text", "lang", "source").orderBy("doc_id")
    shown = embed.preview_embeddings(documents, lambda rows: embed.embed_texts(rows, I.encoder, "text"), "text")
    return shown.select("doc_id", "lang", "source", I.components(F.col("embeddings")).alias("components"))


@query
def embed_images_strictly(spark, sf):
    """Images under the failing policy, from the column a model reads when none is named."""
    images = I.images(spark, sf).select("file_path", F.col("image_base64").alias("input"))
    return _components(embed.embed_images(images, I.encoder, on_error="fail"), "file_path")


@query
def retried_embeddings(spark, sf):
    """Documents whose vector is missing or NULL are encoded, the others are not."""
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    embedded = I.image_embeddings(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("embeddings")).alias("embeddings")
    )
    pending = embed.not_yet_embedded(documents, embedded, "doc_id", vector="embeddings")
    return _components(embed.embed_texts(pending, I.encoder, "text"), "doc_id")


# --- duplicates -------------------------------------------------------------


@query
def exact_duplicates(spark, sf):
    files = I.files(spark, sf)
    return duplicates.exact_duplicate_groups(files, "path", F.col("content"), F.col("length"))


@query
def exact_duplicate_members(spark, sf):
    return duplicates.exact_duplicate_members(I.files(spark, sf), "path", F.col("content"))


def _decided_exact(spark, sf):
    documents = I.table(spark, sf, "documents")
    members = duplicates.exact_duplicate_members(documents, "doc_id", F.col("text"))
    facts = documents.select(
        F.col("doc_id").alias("key"), F.col("source").alias("folder"), F.octet_length("text").cast("long").alias("size_bytes")
    )
    return duplicates.keep_one(members.join(facts, "key"), ["size_bytes"], [True])


@query
def keep_one_exact(spark, sf):
    return _decided_exact(spark, sf).select("key", "group_id", "keep_key", "kept")


@query
def savings_exact(spark, sf):
    return duplicates.savings_report(_decided_exact(spark, sf))


@query
def cleaned_images(spark, sf):
    """The collection without the copies that were dropped."""
    documents = I.table(spark, sf, "documents")
    return duplicates.without_dropped(documents, _decided_exact(spark, sf), "doc_id").select("doc_id", "source", "n_chars")


@query
def near_duplicates(spark, sf):
    return near.near_duplicate_pairs(_vectors(spark, sf), "vec_id", "embedding", THRESHOLD)


@query
def near_duplicates_by_cells(spark, sf):
    return near.near_duplicate_pairs(_vectors(spark, sf), "vec_id", "embedding", THRESHOLD, block_rows=SMALL_BLOCKS)


def _shifted(spark, sf):
    """Vectors and copies of them shifted by 0.005 a component."""
    vectors = _vectors(spark, sf).select("vec_id", "embedding")
    shift = F.transform("embedding", lambda x, i: (x + F.when((i + F.col("vec_id")) % 2 == 0, 0.005).otherwise(-0.005)).cast("float"))
    shifted = vectors.select((F.col("vec_id") + SHIFTED_FROM).alias("vec_id"), shift.alias("embedding"))
    return vectors.unionByName(shifted)


#: Few pivots, as for a table too large for enough of them: most cells are cut again.
FINER = {"block_rows": SMALL_BLOCKS, "most_cells": 4, "split_blocks": 2}


@query
def near_duplicates_by_finer_cells(spark, sf):
    return near.near_duplicate_pairs(_vectors(spark, sf), "vec_id", "embedding", THRESHOLD, **FINER)


@query
def duplicate_groups_by_finer_cells(spark, sf):
    return _groups(spark, sf, **FINER)


@query
def near_duplicates_lsh(spark, sf):
    """The shifted copies are found by bands of bits."""
    return lsh.near_duplicate_pairs_lsh(_shifted(spark, sf), "vec_id", "embedding", 0.95)


@query
def duplicate_groups_lsh(spark, sf):
    """Vectors, shifted copies and exact copies: groups from candidates, without all cells."""
    rows = _shifted(spark, sf)
    copies = rows.filter("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 2 * SHIFTED_FROM)
    return lsh.near_duplicate_groups_lsh(rows.unionByName(copies), "vec_id", "embedding", 0.95)


def _groups(spark, sf, **options):
    return duplicates.near_duplicate_groups(_vectors(spark, sf), "vec_id", "embedding", THRESHOLD, **options)


@query
def duplicate_groups_by_cells(spark, sf):
    return _groups(spark, sf, block_rows=SMALL_BLOCKS)


@query
def duplicate_groups(spark, sf):
    return _groups(spark, sf)


@query
def embedded_duplicate_groups(spark, sf):
    """Groups of texts with the same vector: many exact copies, some of them large groups."""
    documents = I.table(spark, sf, "documents").select("doc_id", "text")
    embedded = cut_lineage(embed.embed_texts(documents, I.encoder, "text").select("doc_id", "embeddings"))
    return duplicates.near_duplicate_groups(embedded, "doc_id", "embeddings", 0.95)


def _decided_near(spark, sf):
    facts = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), F.col("source").alias("folder"), F.octet_length("text").cast("long").alias("size_bytes")
    )
    return duplicates.keep_one(_groups(spark, sf).join(facts, "key"), ["size_bytes"], [True])


@query
def keep_one(spark, sf):
    return _decided_near(spark, sf).select("key", "group_id", "keep_key", "kept")


@query
def savings(spark, sf):
    return duplicates.savings_report(_decided_near(spark, sf))


# --- clusters and labels ----------------------------------------------------


@query
def kmeans_sizes(spark, sf):
    clusters = labels.kmeans_clusters(_vectors(spark, sf), "vec_id", "embedding", 10)
    return clusters.groupBy("cluster").agg(F.count("*").alias("rows"))


@query
def kmeans_planted(spark, sf):
    """Vectors drawn to eight far corners: each corner becomes one cluster, and every vector is in one."""
    corner = F.pmod("vec_id", F.lit(8))
    drawn = F.transform("embedding", lambda x, i: (x * 0.1 + F.when(i == corner, 5.0).otherwise(0.0)).cast("float"))
    planted = _vectors(spark, sf).select("vec_id", drawn.alias("embedding"))
    clusters = labels.kmeans_clusters(planted, "vec_id", "embedding", 8)
    found = clusters.select(F.pmod("key", F.lit(8)).alias("corner"), "key", "cluster")
    by_corner = found.groupBy("corner").agg(F.count("*").alias("vectors"), F.countDistinct("cluster").alias("clusters"))
    shared = found.groupBy("cluster").agg(F.countDistinct("corner").alias("corners")).agg(F.max("corners").alias("corners"))
    return by_corner.withColumn("corners_per_cluster", F.lit(shared.first().corners))


@query
def zero_shot_label(spark, sf):
    vectors = _vectors(spark, sf)
    terms = labels.label_vectors(vectors, FOLDER_TERMS, I.encoder)
    nearest = labels.nearest_label(vectors, "vec_id", "embedding", terms)
    return nearest.select(F.col("key").alias("vec_id"), "label", "score")
