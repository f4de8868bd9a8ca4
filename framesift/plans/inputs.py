"""The driver's tables in the shape of image collections."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.plans.stand_ins import HashEncoder, PatternTagger, PickyEncoder
from framesift.operators.ingest import image_records
from framesift.session import new_shared_path

ROOT = "/data"
DIMENSION = 64

#: Rows of a batch that `written_files` makes Python objects at a time.
WRITTEN_ROWS = 256

#: Extension of a stand-in file by the language of its text; others get ".txt".
EXTENSIONS = {"en": ".jpg", "fr": ".JPEG", "de": ".png"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoder() -> HashEncoder:
    return HashEncoder(DIMENSION)


def picky_encoder() -> PickyEncoder:
    return PickyEncoder(DIMENSION, 2000)


def tagger() -> PatternTagger:
    return PatternTagger({"NAME": "[A-Z][a-z]+", "NUMBER": "[0-9]+"})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as the binary file source would give them: /data/<source>/<id>.jpg."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("file:/data/"), "source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("path"),
        F.timestamp_seconds(F.col("doc_id") * 3600).alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_records(files(spark, sf_dir), ROOT)


def document_path() -> Column:
    return F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit(".jpg"))


def nested_path() -> Column:
    """A path that repeats the root inside and has mixed extensions."""
    extension = F.lit(".txt")
    for lang, spelled in EXTENSIONS.items():
        extension = F.when(F.col("lang") == lang, spelled).otherwise(extension)
    return F.concat(F.lit("/data/"), "source", F.lit("/data/"), "lang", F.lit("/"), "doc_id", extension)


def image_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images, with the vector of the same number or NULL."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        document_path().alias("file_path"),
        F.concat("doc_id", F.lit(".jpg")).alias("file_name"),
        F.col("source").alias("folder"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("embeddings")
    )
    return documents.join(vectors, "doc_id", "left")


def keyed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))


def components(vector: Column) -> Column:
    """A vector of the stand-in encoder as readable text: its bytes, comma separated."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * 127.5 + 127.5).cast("int").cast("string")), ",")


def png(number: int) -> bytes:
    """A picture of 1 to 7 by 1 to 3 pixels, grey or in colour, by the number."""
    width, height, colour = 1 + number % 7, 1 + number % 3, number % 2

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = (b"\0" + bytes(width * (3 if colour else 1))) * height
    header = struct.pack(">IIBBBBB", width, height, 8, 2 if colour else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def written_files(
    spark: SparkSession, sf_dir: str, ending: str = ".jpg", content: Callable[[int, str], bytes] = lambda number, text: text.encode()
) -> str:
    """`documents` written by tasks as <root>/<source>/<id><ending>, below the shared folder; returns the root.

    The shared folder is a mounted path here, as the file sources need one.
    """
    root = new_shared_path(spark, "files").removeprefix("file://").removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for first in range(0, batch.num_rows, WRITTEN_ROWS):  # texts are Python objects some at a time
                some = batch.slice(first, WRITTEN_ROWS)
                for number, source, text in zip(*(some[c].to_pylist() for c in ("doc_id", "source", "text"))):
                    folder = os.path.join(root, source)
                    if folder not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    with open(os.path.join(folder, f"{number}{ending}"), "wb") as file:
                        file.write(content(number, text or ""))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return root
