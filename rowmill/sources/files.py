"""Files as rows: listings, hashes, detected types and changes between two listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Leading bytes (hex) and the type they mean.
_MAGIC = [("EFBBBF", "csv"), ("504B", "xlsx"), ("25504446", "pdf"), ("D0CFED", "xls")]
_IMAGE_MAGIC = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("424D", "bmp"), ("49492A00", "tiff"),
                ("4D4D002A", "tiff"), ("474946383761", "gif"), ("474946383961", "gif")]
IMAGE_EXTENSIONS = ("jpeg", "jpg", "png", "bmp", "webp", "tiff", "gif")


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of the files of a folder; Spark's readers do not see empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)


def content_hash(content: str = "content") -> Column:
    return F.md5(content)


def file_name(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: str = "path") -> Column:
    """Lower-case extension, '' if there is none; a leading dot does not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*\.([^.]*)$|^$", 1))


def type_by_extension(path: str = "path") -> Column:
    ext = extension(path)
    return F.when(ext == "xlsm", "xlsx").otherwise(ext)


def _by_magic(content: str, table) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    for magic, kind in reversed(table):
        found = F.when(head.startswith(magic), kind).otherwise(found)
    return found


def detect_type(path: str = "path", content: str = "content") -> Column:
    """Office extensions first, then leading bytes, then the extension, else ``unknown``."""
    ext = extension(path)
    return (
        F.when(ext.isin("xlsx", "xlsm"), "xlsx").when(ext.isin("docx", "pptx"), ext)
        .otherwise(F.coalesce(_by_magic(content, _MAGIC), F.when(ext != "", ext), F.lit("unknown")))
    )


def image_type(path: str = "path", content: str = "content") -> Column:
    """Type by leading bytes of a file with an image extension; null if either is not an image's."""
    head = F.hex(F.substring(content, 1, 12))
    webp = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    return F.when(extension(path).isin(*IMAGE_EXTENSIONS), F.coalesce(_by_magic(content, _IMAGE_MAGIC), webp))


def unix_lines(text: Column) -> Column:
    """CRLF as LF, for text with line breaks inside a cell."""
    return F.regexp_replace(text, "\r\n", "\n")


def file_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """created, modified and deleted files between two listings: type, path, size, timestamp."""
    was = before.select("path", F.col("length").alias("_size"), F.col("modificationTime").alias("_time"))
    now = after.select("path", "length", "modificationTime")
    both = was.join(now, "path", "full")
    kind = (
        F.when(F.col("_time").isNull(), "created").when(F.col("modificationTime").isNull(), "deleted")
        .when(F.col("_time") != F.col("modificationTime"), "modified")
    )
    return both.select(kind.alias("type"), "path", F.coalesce("length", "_size").alias("size"),
                       F.coalesce("modificationTime", "_time").alias("timestamp")).where("type is not null")
