"""framesift: curate image collections as Spark tables.

Scan a directory tree into a table, embed it with any encoder, keep the
vectors in a refreshable index table, search it by vector or text, and find,
group and remove duplicates. Everything is a DataFrame job.
"""

__version__ = "0.1.0"
