"""Declared schemas, so that an empty directory still gives a typed table."""

from __future__ import annotations

from pyspark.sql import types as T

#: Shape of the binary file source; every file reader here yields it.
FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), True),
        T.StructField("length", T.LongType(), True),
        T.StructField("content", T.BinaryType(), True),
    ]
)

IMAGE_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_name", T.StringType(), True),
        T.StructField("folder", T.StringType(), True),
        T.StructField("size_bytes", T.LongType(), True),
        T.StructField("created_at", T.TimestampType(), True),
        T.StructField("image_base64", T.StringType(), True),
    ]
)

VECTOR_TYPE = T.ArrayType(T.FloatType())

EMBEDDING_SCHEMA = T.StructType([*IMAGE_SCHEMA.fields, T.StructField("embeddings", VECTOR_TYPE, True)])

ENTITY_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("entity", T.StringType()),
            T.StructField("word", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("score", T.FloatType()),
        ]
    )
)

#: The settings a user of the original workflow relies on.
EMBEDDING_DIMENSION = 768
MAX_TEXT_CHARS = 77
SEARCH_DEPTH = 50
FILTERED_RESULTS = 12
SMOKE_K = 3
PREVIEW_ROWS = 10
PREVIEW_CHARS = 200
JPEG_EXTENSIONS = ("jpg", "jpeg")
DISPLAYABLE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp")
FOLDER_TERMS = ("Maize", "Sugarcane", "Wheat", "Rice", "Jute")
RESULT_COLUMNS = ("file_path", "file_name", "folder")
